"""Connected components by contraction, in a logarithmic number of rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._rows import delete
from tapeworks.session import durable_dir


def _scramble(c: Column) -> Column:
    """A bijection of the longs, so that "smallest" means another node in each round."""
    c = c.bitwiseXOR(F.shiftleft(c, 13))
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
    return c.bitwiseXOR(F.shiftleft(c, 17))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an undirected edge list of longs; root is a token that
    exactly the nodes of one component share.

    Each round every node moves to the smallest token within two steps, and the edges are
    rewritten between the tokens. Minima are combined before the shuffle, so a node with very
    many edges costs no more than others; a path halves. Each round's edges and tokens are
    written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    run = f"{durable_dir(spark)}/components-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{run}/{name}")
        return spark.read.schema(df.schema).parquet(f"{run}/{name}")

    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    links = stored(pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct(), "links-0")
    roots = stored(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct(), "roots-0")
    i = 0
    while not links.isEmpty():
        i += 1
        near = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = links.join(near.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("m").alias("m2"))
        to = stored(near.join(far, "u").select("u", F.least("m", "m2").alias("to")), f"to-{i}")
        ends = (
            links.join(to, "u").select("v", F.col("to").alias("x"))
            .join(to.withColumnRenamed("u", "v"), "v").where("x <> to")
        )
        links = stored(ends.select(_scramble(F.col("x")).alias("u"), _scramble(F.col("to")).alias("v")).distinct(), f"links-{i}")
        moved = roots.join(to, roots["root"] == to["u"], "left")
        roots = stored(moved.select("node", _scramble(F.coalesce("to", "root")).alias("root")), f"roots-{i}")
        for name in ("links", "roots"):
            delete(spark, f"{run}/{name}-{i - 1}")
        delete(spark, f"{run}/to-{i}")
    return roots
