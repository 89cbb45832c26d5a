"""The pipeline's near-duplicate stage: its fingerprints, and how many links it makes."""

import random

import pyarrow as pa

import corpus_pipeline
from stockwright.llm import jaccard, simhash


def test_fingerprints_link_texts_that_jaccard_does_not(spark):
    rng, phrase = random.Random(5), "one two three four five six seven"
    rows = [(i, " ".join([phrase] * 60 + [f"w{rng.randrange(10**6)}" for _ in range(40)])) for i in range(6)]
    rows += [(10 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for i in range(4)]
    prints = [simhash.fingerprint(t.encode(), 5) for i, t in rows if i < 6]
    linked = [i for i in range(1, 6) if min(bin(prints[i] ^ p).count("1") for p in prints[:i]) <= simhash.MAX_DISTANCE]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows if i < 6]
    assert linked == [1, 2, 3, 4, 5] and max(len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]) < 0.5
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 10, 11, 12, 13]


def test_visits_grow_with_a_group_not_with_its_square():
    """Members that do not hang on the first, all alike, and visitors like them."""
    n, own, other = 40, list(range(100, 200)), list(range(500, 600))
    rows = [(1, 0, False, False, 1, own)] + [(1, 0, False, True, 10 + i, other) for i in range(n)] + [(1, 0, True, True, 1000 + i, other) for i in range(n)] + [(1, 0, True, True, 2000, own)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64())))], list("abcdef"))
    edges = [(r["a"], r["b"]) for out in jaccard._visits(0.8)(iter([batch])) for r in out.to_pylist()]
    assert len(edges) <= 2 * n + 1
    found = {v: v for v in (1, 2000, *range(10, 10 + n), *range(1000, 1000 + n))}
    for a, b in edges:
        old, new = found[a], found[b]
        found = {v: new if x == old else x for v, x in found.items()}
    assert len(set(found.values())) == 2 and found[1] == found[2000]
