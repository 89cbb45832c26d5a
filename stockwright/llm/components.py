"""Connected components of an undirected graph by alternating large-star and
small-star rounds (Kiveris et al., 2014), as joins and partial aggregations.

A vertex with very many links is no hot group. Minima are aggregated map-side,
and the join that hands them out is salted (``hand_out``). Only two numbers a round come to the driver. Each round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rounds after which something must be wrong: the method needs O(log^2 n).
MAX_ROUNDS = 60
#: A key is frequent with more than ``MANY`` rows and one in ``SHARE`` of all.
MANY, SHARE, SALTS = 64, 1000, 128


def hand_out(rows: DataFrame, key: str, table: DataFrame, whole: int) -> DataFrame:
    """rows joined with table (key, n, further columns) on key, where n is the
    number of rows of each key and ``whole`` at least their sum. Rows of frequent
    keys are dealt over ``SALTS`` tasks, and those keys' table rows are repeated
    for each; all others meet in an ordinary join. Fewer than ``SHARE`` keys can
    be frequent, so the list of them is a bounded broadcast."""
    frequent = F.col("n") > max(MANY, whole // SHARE)
    hot = F.broadcast(table.where(frequent).select(F.col(key).alias("_hot")))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(-1)).drop("_hot")
    every = F.when(frequent, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    return dealt.join(table.withColumn("_salt", F.explode(every)).drop("n"), [key, "_salt"]).drop("_salt")


def _directed(edges: DataFrame) -> DataFrame:
    """Edges as (child, parent), child > parent, each once."""
    return edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct()


def _large_star(edges: DataFrame, whole: int) -> DataFrame:
    """Every vertex points its larger neighbours to its smallest one."""
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m"), F.count_if(F.col("y") > F.col("x")).alias("n")).select("x", "n", F.least("x", "m").alias("m"))
    return hand_out(both.where("y > x"), "x", least, whole).select(F.col("y").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, whole: int) -> DataFrame:
    """Every vertex points itself and its smaller neighbours to the smallest."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
    down = hand_out(edges, "v", least, whole)
    return down.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("v").alias("a"), F.col("m").alias("b")))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (vertex, root): every vertex of an edge between
    two different vertices with the smallest vertex that it reaches. No edges
    give no rows; loops and repeated edges change nothing."""
    now = scratch.keep(_directed(edges), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
        if mark == seen or not mark[0]:
            roots = now.select(F.col("v").alias("vertex"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("vertex"), F.col("u").alias("root")).distinct())
            # a table of its own: joins on it can be split where a vertex is frequent
            return scratch.keep(roots, "roots")
        seen, last = mark, now
        # a star round never has more edges than it was given
        large = scratch.keep(_directed(_large_star(now, mark[0])), "large")
        now = scratch.keep(_directed(_small_star(large, mark[0])), "edges")
        scratch.drop(last)
        scratch.drop(large)
    raise RuntimeError("components did not settle")
