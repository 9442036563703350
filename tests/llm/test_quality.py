"""Quality rules against a plain Python version."""

import re
from collections import Counter, defaultdict

import duckdb
from odd_rows import CLASHES, ROWS

from tapeworks.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))


def lines_of(text):
    out = [re.sub(r"[\x20\t\x0b\f\r]+", " ", x).strip(" ") for x in (text or "").lower().split("\n")]
    return [x for x in out if x]


LIMITS = (quality.MIN_DOCS, quality.MAX_SHARE_PCT, quality.MAX_DOCS)


def above(rows, min_docs, share, most):
    """{(host, line): smallest id} of the lines above the limits."""
    texts, held, first = defaultdict(set), defaultdict(set), {}
    for i, text, host in rows:
        texts[host].add(text)
        for x in lines_of(text):
            held[host, x].add(text)
            if i is not None:
                first[host, x] = min(i, first.get((host, x), i))
    return {k: first.get(k) for k, v in held.items() if len(v) > most or len(v) > min_docs and 100 * len(v) > share * len(texts[k[0]])}


def cleaned(rows, *limits):
    """(id, text without the lines above the limits) of the rows that stay."""
    gone, out = above(rows, *limits), []
    for (i, text, host), v in zip(rows, brute(rows, *limits)):
        if v[-1]:
            stay = [x for x in text.split("\n") if not any((host, n) in gone and (i is None or gone[host, n] != i) for n in lines_of(x))]
            out.append((i, "\n".join(stay)))
    return out


def brute(rows, *limits):
    """(id, stats..., base_failed, kept) of (id, text, host) rows."""
    gone = above(rows, *limits)
    out = []
    for i, text, host in rows:
        s = stats(text)
        lost = sum(len(x.split(" ")) for x in lines_of(text) if (host, x) in gone and (i is None or gone[host, x] != i))
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        out.append((i, *s, failed, not failed and not (s[0] - lost < 10 or 100 * lost > 80 * s[0])))
    return out


def got(df):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_documents(spark, sf, documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    for limits in (LIMITS, (1, 1, 2)):
        out = quality.verdicts(documents, min_docs=limits[0], max_share_pct=limits[1], max_docs=limits[2])
        assert got(out) == sorted(brute(rows, *limits), key=str)


def test_odd_rows(odd, empty):
    rows = [(i, t, s) for i, t, _, s, _ in ROWS]
    assert got(quality.verdicts(odd, min_docs=0, max_share_pct=0)) == sorted(brute(rows, 0, 0, 100), key=str)
    assert quality.verdicts(empty).count() == 0
    kept = quality.keep(odd)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    want = [r[0] for r in brute(rows, *LIMITS) if r[-1]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert quality.keep(empty).count() == 0




def test_repeats_and_boilerplate(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    line = "Subscribe to   our newsletter today"
    rows = [(i, f"{line}\n{body(i)}", "h") for i in range(40)]  # boilerplate, but documents stay
    rows += [(100 + i, f"{line}\n" * 3 + "a b c", "h") for i in range(5)]  # little else: depleted
    rows += [(200 + i, body("copied"), "h") for i in range(50)]  # copies of one text are one document
    rows += [(300, "p q r s t u v " * 9, "h"), (301, "one two three four five x one two three four five y z u v w 1 2 3 4 5 6 7 8 9 10", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality.verdicts(df)
    assert got(out) == sorted(brute(rows, *LIMITS), key=str)
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert kept >= set(range(40)) | set(range(200, 250))
    assert not kept & {*range(101, 105), 300}


def test_small_and_hot_hosts(spark):
    """A line in all ten documents of a small host goes, and one in 150 of 4,000 of a hot host."""
    body = lambda h, i: " ".join(f"{h}{i}x{k}" for k in range(12))
    rows = [(i, f"{body('s', i)}\nAll rights reserved", "small") for i in range(10)]
    rows += [(100 + i, body("h", i) + ("\nShare this page" if i < 150 else "\nSeldom seen" if i < 190 else ""), "hot") for i in range(4000)]
    df = spark.createDataFrame([(*r, 0, "x", "x") for r in rows], "doc_id long, text string, source string, n_chars int, bad string, __k_id string")
    assert set(above(rows, *LIMITS)) == {("small", "all rights reserved"), ("hot", "share this page")}
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == cleaned(rows, *LIMITS)
    assert sum("Share" in t or "rights" in t for _, t in cleaned(rows, *LIMITS)) == 2


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.execute(queries.ORACLES["op7_line_frequency"])
    cols = [d[0] for d in rel.description]
    df = queries.QUERIES["op7_line_frequency"](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(rel.fetchall())
