"""Exact dedup by a log-structured merge index of text digests.

* Rows go to a log: SHA-256 digest, doc_id, row. A load fills ``MEMTABLES``
  memtables in parallel.
* A memtable is flushed as a run: one entry per digest (number of rows, and the
  row that stays), sorted and bucketed by digest, with a filter, a bitmap
  of some bits an entry. Entries are aggregated map-side first, so a group of
  copies that holds a third of all rows reaches a run as one entry a task.
* ``FANOUT`` runs of a level are compacted into one of the next level. All runs
  share their buckets, so compaction reads bucket by bucket, without an exchange,
  and keeps the smallest (or the largest) identifier of each digest.
* Later batches are looked up run by run; a run whose filter none of their
  digests hits is not read (``Index.probe``).
* Hits, digests with more than one row, get a filter too. Only rows that it
  hits are joined with the hits, read for byte verification, or moved at all:
  the others are single for sure. A filter over its bound is not
  broadcast; then all rows take the join.
* Byte verification compares the least and the greatest text of a digest; equal
  bytes there mean equal bytes throughout. Digests that cover different texts
  are split by the whole text.

All of it is DataFrame functions. Texts are equal when identical after no
change; a null text is an empty text. Of rows that share text and doc_id one
stays, and a null doc_id loses against any other. Other columns are ignored
(and kept by ``keep_one``); an empty table gives no rows.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, row_key
from .filters import Filter, make_filter

SHA256: Callable[[Column], Column] = lambda text: F.unhex(F.sha2(text, 256))
MEMTABLES, FANOUT = 4, 4

# ---------------------------------------------------------------------- index


@dataclass
class Run:
    number: int
    level: int
    entries: int
    filter: Filter


@dataclass
class Index:
    """Runs in one bucketed table; ``keep`` says which identifier stays."""

    spark: SparkSession
    keep: str = "smallest"
    fanout: int = FANOUT
    runs: list[Run] = field(default_factory=list)
    made: int = 0

    def __post_init__(self):
        if self.keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be smallest or largest, not {self.keep!r}")
        self.scratch = Scratch(self.spark, "index")
        self.table = f"digest_runs_{uuid.uuid4().hex}"
        self.path = self.scratch.path("runs")
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    # the order in which rows of a digest stay: a null identifier loses
    def _stays(self, row: Column) -> Column:
        if self.keep == "largest":
            return F.max(row)
        least = F.min(F.struct(row["doc_id"].isNull().alias("none"), row["doc_id"].alias("doc_id"), row["row"].alias("row")))
        return F.struct(least["doc_id"].alias("doc_id"), least["row"].alias("row"))

    def _write(self, entries: DataFrame, level: int) -> None:
        number, self.made = self.made, self.made + 1
        out = entries.withColumn("run", F.lit(number)).write.mode("append").partitionBy("run").bucketBy(self.buckets, "digest").sortBy("digest")
        out.option("path", self.path).saveAsTable(self.table)
        if not number:
            atexit.register(_forget, self.spark, self.table)
        mine = self.entries([number])
        n = mine.count()
        self.runs.append(Run(number, level, n, make_filter(self.scratch, mine, n)))

    def entries(self, numbers: list[int]) -> DataFrame:
        """(digest, group_size, stays: struct(doc_id, row)) of some runs."""
        return self.spark.table(self.table).where(F.col("run").isin(numbers)).drop("run")

    def add(self, log: DataFrame) -> None:
        """Flush a memtable, rows (digest, doc_id, row), as a run; compact levels
        that are full."""
        self._write(log.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), self._stays(F.struct("doc_id", "row")).alias("stays")), 0)
        level = 0
        while len(full := [r for r in self.runs if r.level == level]) >= self.fanout:
            self.compact(full)
            level += 1

    def _merged(self, runs: list[Run]) -> DataFrame:
        return self.entries([r.number for r in runs]).groupBy("digest").agg(F.sum("group_size").alias("group_size"), self._stays(F.col("stays")).alias("stays"))

    def compact(self, runs: list[Run]) -> None:
        """Merge runs into one of the next level."""
        self.runs = [r for r in self.runs if r not in runs]
        self._write(self._merged(runs), max(r.level for r in runs) + 1)

    def whole(self) -> DataFrame:
        """One entry per digest of the index."""
        return self.entries([self.runs[0].number]) if len(self.runs) == 1 else self._merged(self.runs)

    def probe(self, batch: DataFrame) -> tuple[DataFrame, list[int]]:
        """(digest, keep_id, group_size) of the batch's digests that the index
        holds, and the numbers of the runs that had to be read."""
        digests = self.scratch.keep(batch.select("digest").distinct(), "probe")
        found, read = None, []
        for run in self.runs:
            hits = run.filter.mark(digests, "_hit").where("_hit").select("digest")
            if hits.isEmpty():
                continue
            read.append(run.number)
            here = self.entries([run.number]).join(hits, "digest", "left_semi")
            found = here if found is None else found.unionByName(here)
        if found is None:
            found = self.entries([])
        g = found.groupBy("digest").agg(F.sum("group_size").alias("group_size"), self._stays(F.col("stays")).alias("stays"))
        return g.select("digest", F.col("stays.doc_id").alias("keep_id"), "group_size"), read


def _forget(spark: SparkSession, table: str) -> None:
    """Take a table out of the session's catalog; its files go with the scratch folder."""
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    try:
        if not spark.sparkContext._jsc.sc().isStopped():
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    except (Py4JError, PySparkException, AttributeError, OSError):
        pass


# ------------------------------------------------------------------- operator


@dataclass
class _Loaded:
    """A table of documents in an index."""

    log: DataFrame  # digest, doc_id, row, memtable
    index: Index
    hits: DataFrame  # entries with more than one row
    filter: Filter


def load(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = SHA256, memtables: int = MEMTABLES) -> _Loaded:
    """Log, flush and compact all rows of docs."""
    spark = docs.sparkSession
    index = Index(spark, keep)
    rows = docs.select(digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    log = index.scratch.keep(rows.withColumn("memtable", F.pmod(F.spark_partition_id(), F.lit(memtables))), "log")
    for m in range(memtables):
        index.add(log.where(F.col("memtable") == m))
    hits = index.scratch.keep(index.whole().where("group_size > 1"), "hits")
    return _Loaded(log, index, hits, make_filter(index.scratch, hits, hits.count()))


def _candidates(docs: DataFrame, found: _Loaded) -> DataFrame:
    """Rows of docs (with a column digest) that may be hits."""
    if found.filter.bounded:
        return found.filter.mark(docs, "_may").where("_may").drop("_may")
    return docs.join(found.hits.select("digest"), "digest", "left_semi")


def _differing(docs: DataFrame, found: _Loaded, text: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests that cover different texts."""
    texts = _candidates(docs.select(text.alias("text"), digest(text).alias("digest")), found)
    checked = texts.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same"))
    return found.index.scratch.keep(checked.where("not same").join(found.hits, "digest", "left_semi").select("digest"), "differ")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = SHA256) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept."""
    found = load(docs, id_col, text_col, keep, digest)
    text = F.coalesce(F.col(text_col), F.lit(""))
    differ = _differing(docs, found, text, digest)
    log = found.filter.mark(found.log, "_may") if found.filter.bounded else found.log.withColumn("_may", F.lit(True))
    single = log.where("NOT _may").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # a candidate that is no hit after all is single too
    mine = log.where("_may").join(found.hits, "digest", "left")
    columns = ["doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("row") == F.col("stays.row"), F.lit(True)).alias("kept")]
    if differ.isEmpty():
        return single.unionByName(mine.select(*columns))
    # one digest, several texts: those rows are told apart by the whole text
    rows = docs.select(text.alias("text"), digest(text).alias("digest"), F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row")).join(differ, "digest", "left_semi")
    rows = found.index.scratch.keep(rows, "by-text")
    groups = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"), found.index._stays(F.struct("doc_id", "row")).alias("stays"))
    split = rows.join(groups, ["digest", "text"]).select(*columns)
    return single.unionByName(mine.join(differ, "digest", "left_anti").select(*columns)).unionByName(split)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all columns of docs. Rows whose digest
    the hits' filter lacks pass where they are; only the others are exchanged."""
    found = load(docs, id_col, text_col, keep)
    text = F.coalesce(F.col(text_col), F.lit(""))
    differ = _differing(docs, found, text, SHA256)
    if not differ.isEmpty():  # no two known texts share a SHA-256 digest
        raise RuntimeError("texts that differ share a SHA-256 digest")
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # a clashing column is not in the way
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()], SHA256(text).alias("digest"))
    rows = found.filter.mark(rows, "_may") if found.filter.bounded else rows.withColumn("_may", F.lit(True))
    key = row_key(F.hex("digest"), F.col(own[id_col])).alias("_key")
    # the entries of all candidates, single ones included: rows meet them by digest
    # and identifier, so copies of one text are no hot key
    entries = found.index.whole()
    entries = found.filter.mark(entries, "_may").where("_may") if found.filter.bounded else entries
    stays = entries.select(row_key(F.hex("digest"), F.col("stays.doc_id")).alias("_key"))
    mine = rows.where("_may").select("*", key).join(stays, "_key", "left_semi").dropDuplicates(["_key"])
    return rows.where("NOT _may").select(*own.values()).unionByName(mine.select(*own.values())).toDF(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return assign(docs, id_col, text_col, keep).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
