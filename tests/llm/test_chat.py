"""Prefix-target examples against a plain formatter."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tapeworks.llm import chat
from tapeworks.llm.queries import CONTROL_TEXT

LONG = "word </turn> " * 20_000
ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "<turn user>\n\\<\\/turn> </turn>\n"), (1, 3, "user", ""), (1, 4, "assistant", None),
    (1, 4, "assistant", None), (2, None, "assistant", "no number"), (2, 0, "user", "<\\\\turn a>\n</turn>\n<t"), (3, 5, "user", "no reply"),
    (None, 0, None, "no id, no role"), (None, 1, "assistant", "yes"), (4, 0, "a>\n%3E<b", LONG), (4, 1, "assistant", LONG), (4, 1, "assistant", "tie \U0001f600 Σ"),
    (-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT),
]


def esc(text):
    return re.sub(r"<(\\*/?turn)", r"<\\\1", text)


def brute(rows):
    """{conv: (turns, [(example text, loss start, loss end)])}; equal turn numbers in any order."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: x[:3])
        whole, made = "", []
        for k, (_, _, r, x) in enumerate(turns):
            head = "<turn " + r.replace("%", "%25").replace(">", "%3E").replace("<", "%3C") + ">\n"
            start = len(whole) + len(head)
            whole += head + esc(x) + "\n</turn>\n"
            if r == "assistant":
                made.append((whole, start, start + len(esc(x))))
        if turns[-1][2] != "assistant":
            made.append((whole, len(whole), len(whole)))
        out[c] = ([(r, x) for _, _, r, x in turns], made)
    return out


def read_back(spark, df, tmp_path):
    chat.write(df, f"{tmp_path}/chat")
    return chat.read(spark, f"{tmp_path}/chat")


def digests(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = set()
    for c, (turns, made) in brute(rows).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out.add((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), sum(len(t) for t, _, _ in made)))
    return out


def test_examples_and_digest(spark, tmp_path):
    rows = [r for r in ROWS if r[0] != 4 or r[3] == LONG]  # the tie is tested below
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, seq string, target int").repartition(5)
    written, made = read_back(spark, df, tmp_path)
    got = defaultdict(list)
    for r in chat.texts(written, made).orderBy("example").collect():
        got[r.conv].append((r.text, r.loss_start, r.loss_end))
    assert {c: sorted(v) for c, v in got.items()} == {c: sorted(v[1]) for c, v in brute(rows).items()}
    assert set(map(tuple, chat.digest(written, made).collect())) == digests(rows)
    assert written.where(F.col("formatted").rlike(r"(?s)^.+</?turn.*\n</turn>")).count() == 0  # no mark inside


def test_ties_keep_every_turn(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(5)
    written, made = read_back(spark, df, tmp_path)
    back = chat.parsed(written).collect()
    assert sorted((str(r.conv), r.role, r.text) for r in back) == sorted((str(c), r or "", x or "") for c, _, r, x in ROWS)
    assert made.where("loss_end > loss_start or example > 0").count() >= 7


def test_table_and_empty(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    written, made = read_back(spark, df, tmp_path)
    assert set(map(tuple, chat.digest(written, made).collect())) == digests([tuple(r) for r in df.collect()])
    written, made = read_back(spark, df.where("false"), f"{tmp_path}/none")
    assert chat.digest(written, made).count() == made.count() == 0


def test_one_long_conversation(spark, tmp_path):
    """A conversation over many tasks: its examples are prefixes, one per reply."""
    df = spark.range(4000).selectExpr("9L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    written, made = read_back(spark, df, tmp_path)
    assert written.select(F.shiftright("seq", 33)).distinct().count() > 1
    got = {r.example: (r.n_turns, r.n_chars) for r in made.collect()}
    _, want = brute([tuple(r) for r in df.collect()])[9]
    assert got == {k: (2 * k + 2, len(w[0])) for k, w in enumerate(want)}
