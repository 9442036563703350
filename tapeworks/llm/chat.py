"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context and it
alone is trainable. The examples of a conversation are prefixes of one formatted text, so the
turns are written once, in order, and an example is a row that says where its prefix ends and
which characters of it count for the loss. Written out, a conversation of n turns would take n
times its size; `texts` does so where whole strings are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm._order import running_before
from tapeworks.llm._rows import partitions

OPEN, CLOSE = "<turn ", "</turn>\n"
TARGET = "assistant"
TURNS = "conv {conv}, seq long, role string, target boolean, head int, formatted string, n_chars int"


def escaped(text: Column) -> Column:
    r"""The text without control strings: `<turn` and `</turn` get a backslash after the `<`, and
    where backslashes stand there already, one more, so nothing is ambiguous."""
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def escaped_role(role: Column) -> Column:
    """A role for the head of a turn, which `>` ends."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(">"), F.lit("%3E")), F.lit("<"), F.lit("%3C"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%3E"), F.lit(">")), F.lit("%25"), F.lit("%"))


def turns(convs: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, seq, role, target, head, formatted, n_chars): every turn in the template; seq is
    the order of the turns, also over conversations.

    Turns follow the turn number (null first), then role and a hash of the text; equal rows are
    turns of their own. A null role or text counts as empty; a null conversation id is a
    conversation. Ranges of (conversation, turn) become tasks, so a long conversation is many.
    `seq` holds once the rows are written.
    """
    role, text = F.coalesce(convs[role_col].cast("string"), F.lit("")), F.coalesce(convs[text_col].cast("string"), F.lit(""))
    slim = convs.select(convs[conv_col].alias("conv"), convs[turn_col].alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(text).alias("h"))
    order = ["conv", "turn", "role", "h"]
    ranged = slim.repartitionByRange(partitions(convs.sparkSession), *order).sortWithinPartitions(*order)
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(">\n"))
    made = ranged.select("conv", "role", head.alias("h"), F.concat(head, escaped(F.col("text")), F.lit("\n" + CLOSE)).alias("formatted"))
    return made.select(
        "conv", F.monotonically_increasing_id().alias("seq"), "role", (F.col("role") == TARGET).alias("target"), F.char_length("h").alias("head"),
        "formatted", F.char_length("formatted").alias("n_chars"))


def examples(written: DataFrame) -> DataFrame:
    """(conv, example, seq, n_turns, n_chars, loss_start, loss_end): an example for every assistant
    turn, its text the first n_chars characters of its conversation's formatted turns.

    The loss covers the reply's text alone, without head and end mark. Turns after the last
    reply, or a conversation without one, make one more example that trains nothing, so that no
    turn is lost. Only numbers move: running sums over ranges of each conversation.
    """
    slim = written.select("conv", F.coalesce(F.col("conv").cast("string"), F.lit(" ")).alias("key"), "seq", "target", "head", "n_chars")
    last = slim.groupBy("key").agg(F.max("seq").alias("last"))
    ran = running_before(slim, ["seq"], {"n_before": F.lit(1), "at": F.col("n_chars"), "replies": F.col("target").cast("int")}, "key")
    ends = ran.join(last.select(F.col("last").alias("seq"), F.lit(True).alias("is_last")), "seq", "left").where("target or is_last")
    at = F.col("at") + F.col("head")
    return ends.select(
        "conv", F.col("replies").cast("long").alias("example"), "seq", (F.col("n_before") + 1).alias("n_turns"), (F.col("at") + F.col("n_chars")).alias("n_chars"),
        F.when(F.col("target"), at).otherwise(F.col("at") + F.col("n_chars")).alias("loss_start"),
        F.when(F.col("target"), F.col("at") + F.col("n_chars") - len("\n" + CLOSE)).otherwise(F.col("at") + F.col("n_chars")).alias("loss_end"))


def write(convs: DataFrame, path: str, **columns: str) -> None:
    """Write the formatted turns and, made from these files, the examples below path."""
    spark = convs.sparkSession
    turns(convs, **columns).write.parquet(f"{path}/turns")
    kind = spark.read.parquet(f"{path}/turns").schema["conv"].dataType.simpleString()
    written = spark.read.schema(TURNS.format(conv=kind)).parquet(f"{path}/turns")
    examples(written).write.parquet(f"{path}/examples")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The written turns and examples."""
    return spark.read.parquet(f"{path}/turns"), spark.read.parquet(f"{path}/examples")


def texts(written: DataFrame, made: DataFrame) -> DataFrame:
    """(conv, example, text, loss_start, loss_end): each example's whole text.

    A conversation's turns meet in one row, and its text is cut at every example's end: as much
    as n examples of n turns are.
    """
    whole = written.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "formatted"))), lambda x: x["formatted"]), "").alias("all"))
    joined = made.join(whole.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
    return joined.select("conv", "example", F.substring(F.col("all"), F.lit(1), F.col("n_chars")).alias("text"), "loss_start", "loss_end")


def parsed(written: DataFrame, *keep: str) -> DataFrame:
    """(conv, seq, role, text): the turns back from their formatted text alone; and columns to keep."""
    body = F.col("formatted")
    end = F.locate(">\n", body)
    role = F.substring(body, F.lit(len(OPEN) + 1), end - len(OPEN) - 1)
    text = F.substring(body, end + 2, F.char_length(body) - end - 1 - len("\n" + CLOSE))
    return written.select("conv", "seq", unescaped_role(role).alias("role"), unescaped(text).alias("text"), *keep)


def digest(written: DataFrame, made: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the written files: turns and their hash, the text under all loss masks and its hash.

    A SHA-256 is taken of one message, so here a conversation's text meets in one row. The loss
    text is cut from the formatted turn by the example's mask.
    """
    mask = made.select("seq", F.col("n_chars").alias("upto"), "loss_start", "loss_end")
    turn = parsed(written, "formatted", "n_chars").join(mask, "seq", "left")
    at = F.col("loss_start") - (F.col("upto") - F.col("n_chars"))
    loss = F.coalesce(unescaped(F.substring(F.col("formatted"), (at + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))), F.lit(""))
    turn = turn.select("conv", "seq", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("t"), loss.alias("l"), "upto")
    row = F.sort_array(F.collect_list(F.struct("seq", "t", "l")))
    per = turn.groupBy("conv").agg(F.count("*").alias("n_turns"), row.alias("rows"), F.sum("upto").alias("formatted_chars"))
    per = per.withColumn("loss", F.array_join(F.transform("rows", lambda x: x["l"]), ""))
    return per.select(
        F.col("conv").alias(conv_col), "n_turns", F.sha2(F.array_join(F.transform("rows", lambda x: x["t"]), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
