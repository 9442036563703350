"""Quality rules: base statistics of each text, and cross-document line frequency per host.

DataFrame functions only. One pass takes the statistics and the hashed lines of each text and
writes them; the frequencies, the depleted documents and the result read that slim table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._rows import KEY, row_key
from tapeworks.session import materialize

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5
#: A line goes that stands in more than MAX_DOCS documents of a host, however large that is, or
#: in more than MAX_SHARE_PCT per cent of it, if these are more than MIN_DOCS, however small it is.
MIN_DOCS, MAX_SHARE_PCT = 4, 5
MAX_DOCS = 100
MAX_REMOVED_PCT = 80

# White space that parts words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _removed_by(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def base_stats(docs: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text column."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumns({"__t": t}).withColumns({"__w": F.array_remove(F.split("__t", f"{SPACE}+"), "")})
    raw = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.translate("__t", SPACES, "")).cast("long"),
        "n_symbols": _removed_by(F.col("__t"), SYMBOLS).cast("long"),
        "__raw": raw,
        # one hash for each window of five words
        "__win": F.when(F.size("__w") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("__w") - (WINDOW - 1), F.lit(1))),
            lambda i: F.xxhash64(F.slice("__w", i, WINDOW)),
        )).otherwise(F.array().cast("array<bigint>")),
    })
    df = df.withColumns({
        "n_dup_lines": (F.size("__raw") - F.size(F.array_distinct("__raw"))).cast("long"),
        "__rep": F.size(F.array_distinct("__win")) < F.size("__win"),
    })
    # windows in hash order: repeats are neighbours; only texts that have any are sorted
    df = df.withColumn("__srt", F.when(
        F.col("__rep"), F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hits = F.filter("__srt", lambda x, i: F.coalesce(F.get("__srt", i - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get("__srt", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("__hit", F.sort_array(F.transform(hits, lambda x: x["i"])))
    own = F.transform("__hit", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__hit", k + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(
        F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(0).cast("long")))
    return df.drop("__w", "__raw", "__win", "__rep", "__srt", "__hit")


def _flat(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\x20\t\x0B\f\r]+", " ")


def _lines() -> Column:
    """(hash, words) of each line that has a word: lower case, inner white space as one space."""
    lines = F.filter(F.transform(F.split(_flat(F.col("__t")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(
        F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).cast("long").alias("w")))


def verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
             min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, min_docs: int = MIN_DOCS,
             max_share_pct: int = MAX_SHARE_PCT, max_docs: int = MAX_DOCS, max_removed_pct: int = MAX_REMOVED_PCT) -> DataFrame:
    """One row per row of docs: row key, id, base statistics, n_removed_words, base_failed, kept.

    A line is above the limits if it stands in more than max_docs documents of one host, or in
    more than min_docs that are more than max_share_pct per cent of it. Copies of a text with one another count
    as one document, so a much-copied text does not make boilerplate of itself. Such a line is
    removed from every document but the first (smallest id) of the host that has it, so no
    text vanishes from the corpus; documents without an id lose it. A document is depleted if
    fewer than min_words words are left, or more than max_removed_pct per cent went. The
    share reaches the lines of small hosts, the number those of large ones.

    A null text is empty and fails; a null host is a host of its own; repeated rows get equal
    answers; other columns are ignored; an empty table gives no rows.
    """
    return _judge(docs, id_col, text_col, host_col, min_words, max_repeat_pct, min_docs, max_share_pct, max_docs, max_removed_pct)[0]


def _judge(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT,
           min_docs: int = MIN_DOCS, max_share_pct: int = MAX_SHARE_PCT, max_docs: int = MAX_DOCS, max_removed_pct: int = MAX_REMOVED_PCT) -> tuple[DataFrame, DataFrame]:
    """The verdicts, and (row key, h, w) of every line to be removed."""
    slim = docs.select(
        *row_key(docs[id_col], docs[host_col], docs[text_col]), docs[id_col].alias("id"),
        F.coalesce(F.concat(F.lit("h"), docs[host_col].cast("string")), F.lit("")).alias("host"),
        docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("copy"),
    )
    stats = base_stats(slim, "text").withColumn("lines", _lines()).drop("text", "__t")
    stats = stats.withColumn("base_failed", (F.col("n_words") < min_words)
                             | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    stats = materialize(stats, "quality")
    line = stats.select(*KEY, "id", "host", "copy", F.explode("lines").alias("l")).select(
        *KEY, "id", "host", "copy", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    held = line.groupBy("host", "h", "copy").agg(F.min("id").alias("id"))
    seen = held.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") > min(min_docs, max_docs))
    sizes = stats.groupBy("host", "copy").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("of"))
    common = (F.col("n") > min_docs) & (100 * F.col("n") > max_share_pct * F.col("of"))
    above = seen.join(sizes, "host").where((F.col("n") > max_docs) | common).select("host", "h", "first_id")
    marked = line.join(above, ["host", "h"]).where(F.coalesce(F.col("id") != F.col("first_id"), F.lit(True)))
    marked = materialize(marked.select(*KEY, "h", "w"), "marked-lines")
    # a row that is there c times has c times the sum, and c times the count of its copies
    lost = marked.groupBy(*KEY).agg(F.sum("w").alias("lost"))
    times = stats.join(lost.select(*KEY), list(KEY), "left_semi").groupBy(*KEY).agg(F.count("*").alias("c"))
    lost = lost.join(times, list(KEY)).select(*KEY, F.expr("lost div c").alias("lost"))
    out = stats.drop("lines", "host", "copy").join(lost, list(KEY), "left")
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumn("n_removed_words", F.coalesce("lost", F.lit(0).cast("long"))).drop("lost")
    depleted = (left < min_words) | (100 * F.col("n_removed_words") > max_removed_pct * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).withColumnRenamed("id", id_col), marked


def keep(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", size_col: str = "n_chars",
         **limits) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, without the lines above
    the limits; size_col, if docs has it, is the new length where lines went."""
    judged, marked = _judge(docs, id_col, text_col, host_col, **limits)
    bad = judged.where(~F.col("kept")).select(*KEY, F.lit(True).alias("bad"), F.lit(None).cast("bigint").alias("h"))
    both = bad.union(marked.select(*KEY, F.lit(False), "h"))
    todo = both.groupBy(*KEY).agg(F.max("bad").alias("bad"), F.collect_set("h").alias("gone"))
    # the columns of docs travel in one struct, so that no name of theirs meets one of these
    rows = docs.select(*row_key(docs[id_col], docs[host_col], docs[text_col]), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.join(todo, list(KEY), "left").where(~F.coalesce("bad", F.lit(False)))
    text = F.col("row")[text_col]
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(F.trim(_flat(x)))))
    rows = rows.withColumn("left", F.when(F.size("gone") > 0, F.array_join(left, "\n")))
    new = {text_col: F.coalesce("left", text)}
    if size_col in docs.columns:
        new[size_col] = F.coalesce(F.length("left").cast(docs.schema[size_col].dataType), F.col("row")[size_col])
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
