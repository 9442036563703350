"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from tapeworks.llm import chat, hilbert, licences, quality

_SPACES = r"[\x20\x09-\x0D]"

ORACLES: dict[str, str] = {}

ORACLES["op7_line_frequency"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{_SPACES}+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - {quality.WINDOW} + 2)) AS i, ws FROM w WHERE len(ws) >= {quality.WINDOW}),
win2 AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {quality.WINDOW} - 1), ' ') AS g FROM win),
rep AS (SELECT doc_id, g FROM win2 GROUP BY doc_id, g HAVING count(*) > 1),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + {quality.WINDOW})) AS p FROM win2 JOIN rep USING (doc_id, g)),
nrep AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dupl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '{_SPACES}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dupl.n, 0)::BIGINT AS n_dup_lines, coalesce(nrep.n, 0)::BIGINT AS n_repeat_words, t
    FROM d JOIN w USING (doc_id) LEFT JOIN dupl USING (doc_id) LEFT JOIN nrep USING (doc_id)),
nl AS (SELECT doc_id, source, t, trim(regexp_replace(lower(l), '[\x20\t\x0B\f\r]+', ' ', 'g')) AS n
    FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS l FROM d)),
line AS (SELECT * FROM nl WHERE n <> ''),
freq AS (SELECT source, n, count(DISTINCT t) AS c, min(doc_id) AS first_id FROM line GROUP BY source, n),
size AS (SELECT source, count(DISTINCT t) AS of_host FROM d GROUP BY source),
above AS (SELECT source, n, first_id FROM freq JOIN size USING (source)
    WHERE c > {quality.MAX_DOCS} OR (c > {quality.MIN_DOCS} AND 100 * c > {quality.MAX_SHARE_PCT} * of_host)),
lost AS (SELECT doc_id, sum(len(string_split(n, ' ')))::BIGINT AS n_removed FROM line JOIN above USING (source, n)
    WHERE doc_id <> first_id GROUP BY doc_id),
f AS (SELECT base.*, coalesce(n_removed, 0)::BIGINT AS n_removed_words,
    n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed
    FROM base LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (n_words - n_removed_words < {quality.MIN_WORDS}
        OR 100 * n_removed_words > {quality.MAX_REMOVED_PCT} * n_words) AS kept, n_removed_words
FROM f
"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_KNOWN = ", ".join(f"({_text(n)}, {_text(s)})" for n, s in licences.SENTENCES.items())
_RULES = ", ".join(f"({_text(r.licence)}, {_text(r.kind)}, {_text('|' + '|'.join(r.sentences) + '|')})" for r in licences.RULES)

ORACLES["op6_licence_rules"] = f"""
WITH known(name, s) AS (VALUES {_KNOWN}), rules(licence, kind, seq) AS (VALUES {_RULES}),
parts AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM (
    SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '{licences.BREAK}') AS a FROM documents)),
clean AS (SELECT doc_id, i, regexp_replace(trim(regexp_replace(s, '{licences.NOISE}', ' ', 'g')), '[.]+( |$)', '\\1', 'g') AS s FROM parts),
n AS (SELECT doc_id, count(*)::BIGINT AS n_sentences FROM clean WHERE s <> '' GROUP BY doc_id),
hits AS (SELECT doc_id, string_agg(name, ',' ORDER BY i) AS found FROM clean JOIN known USING (s) GROUP BY doc_id),
met AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
    FROM hits JOIN rules ON contains('|' || replace(found, ',', '|') || '|', seq) GROUP BY doc_id)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(found, '') AS found, coalesce(licences, '') AS licences, coalesce(kinds, '') AS kinds
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN hits USING (doc_id) LEFT JOIN met USING (doc_id)
"""

_CRC = []
for _b in range(256):
    for _ in range(8):
        _b = (_b >> 1) ^ (0xEDB88320 if _b & 1 else 0)
    _CRC.append(_b)


def _hilbert_sql(dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = hilbert.BITS, shards: int = hilbert.SHARDS) -> str:
    step, follow = hilbert.curve_table(len(dims))
    axis = {"lang": 1, "source": 1}
    keys = [f"CASE WHEN {d} IS NOT NULL THEN rank() OVER (ORDER BY {d}) - 1 END" if d in axis else d for d in dims]
    cuts = ", ".join(f"list_sort(list_distinct(quantile_disc(d{i}, [{', '.join(str(k / (1 << bits)) for k in range(1, 1 << bits))}]))) AS q{i}" for i in range(len(dims)))
    cells = ", ".join(f"len(list_filter(q{i}, lambda x: x <= d{i})) AS c{i}" for i in range(len(dims)))
    sql = f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t, {', '.join(f'{k} AS d{i}' for i, k in enumerate(keys))} FROM documents),
cut AS (SELECT {cuts}, count(*) AS n FROM b),
l{bits} AS (SELECT doc_id, t, n, {cells}, 0::BIGINT AS h, 0 AS s FROM b, cut)"""
    for k in range(bits - 1, -1, -1):
        digit = " + ".join(f"((c{i} >> {k}) & 1) * {1 << i}" for i in range(len(dims)))
        sql += f""",
m{k} AS (SELECT *, s * {1 << len(dims)} + {digit} + 1 AS pos FROM l{k + 1}),
l{k} AS (SELECT * EXCLUDE (h, s, pos), h * {1 << len(dims)} + {list(step)}[pos] AS h, {list(follow)}[pos] AS s FROM m{k})"""
    return sql + f""",
bytes AS (SELECT doc_id, h, n, octet_length(encode(t))::BIGINT + 1 AS size, hex(encode(t)) AS x FROM l0),
crc AS (SELECT doc_id, h, n, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(x), 2),
    lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)), lambda c, v: xor(c >> 8, {_CRC}[(xor(c, v) & 255) + 1]))) AS text_crc32 FROM bytes),
r AS (SELECT *, row_number() OVER (ORDER BY h, text_crc32, doc_id) - 1 AS rank FROM crc),
sh AS (SELECT *, rank * {shards} // n AS shard FROM r)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
    (rank - (shard * n + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, h::BIGINT AS curve FROM sh"""


ORACLES["op3_hilbert_shards"] = _hilbert_sql()

ORACLES["op12_prefix_targets"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, role, text, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length('{chat.OPEN}') + length(replace(replace(replace(role, '%', '%25'), '>', '%3E'), '<', '%3C')) + 2
    + length(text) + len(regexp_extract_all(text, '<\\*/?turn')) + 1 + length('{chat.CLOSE.strip()}') + 1 AS chars
    FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM t),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS whole,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{chat.TARGET}'), '') AS loss,
    sum(upto) FILTER (role = '{chat.TARGET}' OR k = n)::BIGINT AS formatted_chars FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
