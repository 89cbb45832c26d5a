"""Nested levels: totals of every node, accuracy by level, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.mathx import ratio

SEP = "/"


def totals(bottom: DataFrame, levels: Sequence[str], values: Sequence[str] = ("y",), extra: Sequence[str] = ("date",)) -> DataFrame:
    """(level, node, extra, values): sums of every node of a nested chain, one
    pass with grouping sets. level counts names in the path."""
    sets = ", ".join("(" + ", ".join([*levels[: k + 1], *extra]) + ")" for k in range(len(levels)))
    sums = ", ".join(f"sum({v}) AS {v}" for v in values)
    depth = " + ".join(f"(1 - grouping({c}))" for c in levels)
    path = f"concat_ws('{SEP}', {', '.join(levels)})"
    query = f"SELECT CAST({depth} AS INT) AS level, {path} AS node, {', '.join(extra)}, {sums} FROM {{df}} GROUP BY GROUPING SETS ({sets})"
    return bottom.sparkSession.sql(query, df=bottom)


def edges(bottom: DataFrame, levels: Sequence[str]) -> DataFrame:
    """(level, node, leaf): the summing matrix as (ancestor, leaf) rows."""
    leaves = bottom.select(*levels).distinct()
    paths = [F.struct(F.lit(k + 1).alias("level"), F.concat_ws(SEP, *levels[: k + 1]).alias("node")) for k in range(len(levels))]
    return leaves.select(F.explode(F.array(*paths)).alias("n"), F.concat_ws(SEP, *levels).alias("leaf")).select("n.level", "n.node", "leaf")


def bottom_up(forecast: DataFrame, edges_: DataFrame) -> DataFrame:
    """(level, node, date, p50): leaves' forecasts (series_id = leaf) summed."""
    return forecast.join(edges_, forecast.series_id == edges_.leaf).groupBy("level", "node", "date").agg(F.sum("p50").alias("p50"))


def by_level(actual: DataFrame, forecast: DataFrame, train_end, lag: int) -> DataFrame:
    """(level, n_nodes, mase, rmsse); nodes without a scale are skipped."""
    w = Window.partitionBy("level", "node").orderBy("date")
    past = actual.where(F.col("date") <= F.lit(train_end)).withColumn("d", F.col("y") - F.lag("y", lag).over(w))
    scale = past.groupBy("level", "node").agg(F.nullif(F.avg(F.abs("d")), F.lit(0.0)).alias("sm"), F.nullif(F.avg(F.col("d") * F.col("d")), F.lit(0.0)).alias("ss"))
    e = actual.join(forecast, ["level", "node", "date"]).withColumn("e", F.col("y") - F.col("p50")).groupBy("level", "node").agg(F.avg(F.abs("e")).alias("mae"), F.avg(F.col("e") * F.col("e")).alias("mse"))
    s = e.join(scale, ["level", "node"]).where("sm IS NOT NULL")
    return s.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg(ratio(F.col("mae"), F.col("sm"))).alias("mase"), F.avg(F.sqrt(ratio(F.col("mse"), F.col("ss")))).alias("rmsse"))


def compare_methods(tables: dict[str, DataFrame]) -> DataFrame:
    """Levels by method: mase of each and its change against base in per cent."""
    long = None
    for name, t in tables.items():
        t = t.select("level", F.lit(name).alias("method"), "mase")
        long = t if long is None else long.unionByName(t)
    wide = long.groupBy("level").pivot("method", list(tables)).agg(F.first("mase"))
    return wide.select("*", *[(100 * (ratio(F.col(m), F.col("base")) - 1)).alias(f"{m}_change") for m in tables if m != "base"])


def min_trace(forecast: DataFrame, residuals: DataFrame, edges_: DataFrame) -> DataFrame:
    """(level, node, date, p50) reconciled by MinT with a shrunk covariance
    (Wickramasuriya et al., 2019).

    One linear solve over all nodes, so the hierarchy must fit one task: use it
    for reporting hierarchies of some thousand nodes, bottom_up beyond.
    forecast and residuals have (level, node, date, p50 or e)."""
    edge = edges_.toPandas()

    def solve(f: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(zip(f["level"], f["node"], strict=True)))
        at = {n: i for i, n in enumerate(nodes)}
        leaves = {x: i for i, x in enumerate(sorted(edge["leaf"].unique()))}
        s = np.zeros((len(nodes), len(leaves)))
        for lv, n, leaf in edge.itertuples(index=False):
            s[at[(lv, n)], leaves[leaf]] = 1.0
        fc = f.assign(i=[at[x] for x in zip(f["level"], f["node"], strict=True)]).pivot_table(index="i", columns="date", values="p50")
        e = r.assign(i=[at[x] for x in zip(r["level"], r["node"], strict=True)]).pivot_table(index="i", columns="date", values="e").reindex(range(len(nodes))).fillna(0.0).to_numpy()
        t = max(2, e.shape[1])
        z = e - e.mean(axis=1, keepdims=True)
        cov = z @ z.T / (t - 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        u = z / sd[:, None]
        corr = u @ u.T / (t - 1)
        var = ((u**2) @ (u**2).T / t - (u @ u.T / t) ** 2) / t
        np.fill_diagonal(var, 0.0)
        off = corr - np.diag(np.diag(corr))
        shrink = float(np.clip(var.sum() / max((off**2).sum(), 1e-12), 0, 1))
        w = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + 1e-8 * np.eye(len(nodes))
        inv = np.linalg.pinv(w)
        g = np.linalg.solve(s.T @ inv @ s + 1e-10 * np.eye(len(leaves)), s.T @ inv)
        out = pd.DataFrame(s @ (g @ fc.to_numpy()), columns=fc.columns)
        out["level"], out["node"] = [n[0] for n in nodes], [n[1] for n in nodes]
        return out.melt(id_vars=["level", "node"], var_name="date", value_name="p50")

    one = lambda d: d.withColumn("g", F.lit(0)).groupBy("g")
    return one(forecast).cogroup(one(residuals)).applyInPandas(lambda f, r: solve(f, r)[["level", "node", "date", "p50"]], "level int, node string, date date, p50 double")
