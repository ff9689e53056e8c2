"""Connected components of a link table, with shuffles only: no link or label is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], by: str, count: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """Joins `many` with `one`, a row a key, where a key may hold any share of `many`.

    one[count] is the number of the key's rows in `many`, total their sum (counted where it isn't given; a larger one
    does no harm to the rows). A key with more than a quarter of an even task's rows is hot: its rows are dealt by
    their column `by` over as many parts as it holds such quarters, and its row of `one` is copied to each. There are
    fewer hot keys, and fewer copies, than twice four times the tasks, so the list of hot keys is safe to broadcast.
    """
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total is None:
        total = one.agg(F.sum(count)).first()[0] or 0
    share = max(total // (4 * tasks), 1)
    one = one.withColumn("__parts", F.ceil(F.col(count) / share).cast("int"))
    hot = F.broadcast(one.where("__parts > 1").select(*keys, "__parts"))
    many = many.join(hot, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    one = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__parts"), F.lit(1)) - 1))).drop("__parts")
    return many.join(one, [*keys, "__salt"], how).drop("__salt")


def dealt_join(x: DataFrame, y: DataFrame, keys: list[str], by: str, count: str, total: int) -> DataFrame:
    """Joins x with y, several rows a key on both sides, where a key may hold any share of them.

    Both sides carry `count`, at least the number of the key's rows in x, and total is at least all of x's. A key's
    rows in x are dealt by their column `by` over as many parts as they hold quarters of an even task's rows; its rows
    in y are copied to each part.
    """
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.greatest(F.ceil(F.col(count) / max(total // (4 * tasks), 1)).cast("int"), F.lit(1))
    x = x.withColumn("__salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop(count)
    y = y.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return x.join(y, [*keys, "__salt"]).drop("__salt")


def _smallest(edges: DataFrame) -> DataFrame:
    """For each node u of (u, v) the smaller of u and its smallest neighbour, and the number of its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("links"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected links (a, b); the component is the smallest node that
    can be reached. Large-star and small-star contraction alternate until the links are stars around the
    smallest nodes, in a number of rounds that grows with the logarithm of the longest path."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark, many = None, now.count()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = salted_join(both, _smallest(both), ["u"], "v", "links", 2 * many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = salted_join(down, _smallest(down), ["u"], "v", "links", 2 * many).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        now = stored(small, "links")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark, many = new, new[0]
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
