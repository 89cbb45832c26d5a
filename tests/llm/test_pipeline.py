"""The pipeline's stages on a small corpus, and run() against them."""

import random
from collections import Counter

import corpus_pipeline as p


def test_stages(spark, tmp_path):
    words = "the of and to thanedble erin for on it is nter ould whing thorou esre ntes".split()


    def text(k: int) -> str:
        rng = random.Random(k)
        return " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(60))

    rows = [(i, text(i), "en", f"s{i % 3}", 0) for i in range(40)] + [(100 + i, text(i), "en", "s0", 0) for i in range(5)] + [(200, "too short", "en", "s1", 0), (201, None, None, None, None)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sizes = []
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        sizes.append(docs.count())
    assert sizes[0] == 45 and sizes[1] == 40 and sizes[3] == sizes[4]
    kept = spark.read.parquet(f"{d}/out1")
    assert {r.doc_id for r in kept.collect()} >= {100, 101, 102, 103, 104}
    assert Counter(map(tuple, p.run(spark, d).collect())) == Counter(map(tuple, docs.collect()))
    assert p.ORACLE_SQL is None and len(p.STAGES) == 5 and all(callable(f) for _, f in p.STAGES)


def test_empty_corpus(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert p.run(spark, d).collect() == []


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, repeated rows, a very long text and columns named like the
    operators' own go through every stage."""
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(None, None, None), (None, "a", "s"), (1, long, "s"), (1, long, "s"), (2, "", None), (3, "x " * 50, "t")] + [(i, " ".join(f"v{rng.randrange(999)}" for _ in range(30)), "t") for i in range(4, 30)]
    own = ["digest", "print", "row", "vertex", "_key", "_may", "copies_", "row_key_", "component_key"]
    docs = spark.createDataFrame([(*r, *["clash"] * len(own)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in own)).repartition(2)
    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, docs, d)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        kept = [r.doc_id for r in out.collect()]
        assert name == "bpe" and len(kept) == len(rows) or set(kept) >= set(range(4, 30)) or name == "mixing", name
