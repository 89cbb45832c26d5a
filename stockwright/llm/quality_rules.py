"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Two multinomials over 2^14 buckets of hashed byte 4-grams: one of trusted text
(documents that ``labels`` marks quality 1), one of the raw corpus (every row).
A document's score is its summed log ratio over its number of n-grams; every
document whose score is at least ``THRESHOLD`` passes, so the same corpus gives the
same verdicts anywhere: log ratios are rounded to multiples of 2^-20 once, and
sums of integers don't depend on their order.

Both counts cover all their rows, at every size: labels and documents meet in an
ordinary join on the id.

Base rules come first: fewer than 10 words, or more than 20 % of the words in
5-word windows that occur twice or more, fail.

Defined results: null text is empty, has no words and fails; without trusted
text every ratio is zero and only base rules decide; a null doc_id is no
trusted row; repeated rows count as often as they occur. Other columns are
ignored (and kept by ``keep``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams, textstats

MIN_WORDS = 10
MAX_REPEAT = 20  # per cent of words
#: Least mean log ratio of an n-gram. Text like the trusted one is near zero
#: whatever its language; other kinds of text lose about a nat per n-gram.
THRESHOLD = -0.2

RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    + [T.StructField("log_ratio", T.DoubleType())]
)


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratios of all buckets."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    target, raw = ngrams.count_sides(rows, labels.where("quality = 1").select(F.col("doc_id").alias("_id")))
    return ngrams.log_ratio(target, raw)


def judge(text: bytes, ratios: np.ndarray, threshold: float = THRESHOLD) -> tuple:
    """The result row of one text."""
    words = text.split()
    repeated = textstats.repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT * len(words)
    total, n = ngrams.score(text, ratios)
    kept = not failed and total >= threshold * ngrams.SCALE * n
    return len(words), textstats.word_chars(text), textstats.symbols(text), textstats.dup_lines(text), repeated, failed, kept, total / ngrams.SCALE / n if n else 0.0


def judge_column(text: Column, ratios: np.ndarray, threshold: float = THRESHOLD) -> Column:
    """Struct of the base counts and the verdict."""

    @F.arrow_udf(RESULT)
    def verdicts(texts: pa.Array) -> pa.Array:
        rows = [judge(t.as_py(), ratios, threshold) for t in texts]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(RESULT)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RESULT.names)

    return verdicts(F.coalesce(text, F.lit("")).cast("binary"))


def rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base counts, base_failed, kept, log_ratio."""
    ratios = weights(docs, labels, id_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), judge_column(F.col(text_col), ratios).alias("v")).select("doc_id", *[f"v.{n}" for n in RESULT.names])


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all columns."""
    return docs.where(judge_column(F.col(text_col), weights(docs, labels, id_col, text_col))["kept"])
