"""Corpus counts and other results that no bound on rows may change."""

import numpy as np
from pyspark.sql import functions as F

from stockwright.llm import ngrams, quality_rules


def test_every_trusted_document_counts(spark):
    n = 20_500  # more than any fit takes
    docs = spark.range(n + 1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "abcd").otherwise("wxyz").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "abcd")], "doc_id long, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    labels = labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1), (n, 0), (n + 1, None)], "doc_id long, quality int"))
    target, raw = n * ngrams.counts(b"abcd"), (n + 1) * ngrams.counts(b"abcd") + 1000 * ngrams.counts(b"wxyz")
    assert np.array_equal(quality_rules.weights(docs, labels), ngrams.log_ratio(target, raw))


def test_pipeline_links_all_texts_of_jaccard_four_fifths(spark):
    import random

    import corpus_pipeline

    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(120)]
        rows.append((i, " ".join(words)))
        for j in (1, 2):  # one or two words changed, places apart: 5 or 10 shingles of 116
            for k in range(j):
                words[20 + 40 * k] = f"x{rng.randrange(500)}"
            rows.append((1000 * j + i, " ".join(words)))
        far = words[:]
        far[::6] = ["y"] * len(far[::6])
        rows.append((9000 + i, " ".join(far)))
    rows += [(20000, None), (20001, "")]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted(r.doc_id for r in kept) == [*range(60), *range(9000, 9060), 20000]


def test_files_in_parts_lose_no_link(spark):
    """Chains of texts that share a band: neighbours are alike, ends are not."""
    import random

    from stockwright.llm import jaccard

    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts, now = [], words[:300]
    for i in range(60):
        texts.append(" ".join(now))
        at = rng.randrange(290)
        now = now[:at] + [f"n{i}", f"m{i}"] + now[at + 2 :]
    texts += [" ".join(f"z{rng.randrange(50)}" for _ in range(40)) for _ in range(5)] + [texts[3], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [frozenset(tuple((t or "").split()[i : i + 5]) for i in range(max(0, len((t or "").split()) - 4))) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or both and both >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    for most in (2, 7, 512):
        got = {}
        for r in jaccard.alike(df, most=most).collect():
            got.setdefault(r.component_key, set()).add(r.doc_id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())), most
