"""Each operator against brute force on small tables with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stockwright.llm import bpe, exact_dedup, filters, html_extract, license_scan, mixing, quality_classifier, quality_rules, sharding, simhash, textstats, token_counts
from stockwright.llm.components import components
from stockwright.llm.common import Scratch
from stockwright.llm.queries import BPE_FILE, tokenizer_file

SCHEMA = "doc_id long, text string, source string, digest string, size int, fingerprint string"
WORDS = "the of and to thanedble erin for on it is nter ould ANat, whing. éeuxmentre".split()


def texts() -> list[tuple]:
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 60))) for _ in range(60)]
    near = [b.replace("the", "teh", 1) for b in base[:15]] + [b + " end" for b in base[15:25]]
    odd = [None, "", " \n\t ", "a", "A", "x " * 30, " 　", "one two three four", "One\ttwo\nthree four", "ß" * 500]
    rows = [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(base + near + odd + base[:8])]
    rows += [(3, base[3], "s3"), (None, "no id here", "s1"), (None, "no id here", "s1"), (None, base[0], "s2")]
    return [(i, t, s, "clash", 1, "clash") for i, t, s in rows]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 60, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


# -------------------------------------------------------------------- simhash


def brute_print(text: str | None) -> int:
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], limit: int = 4) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, rows, none):
    prints = [brute_print(r[1]) for r in rows]
    of = groups(prints)
    least = defaultdict(list)
    for r, g in zip(rows, of, strict=True):
        least[g].append(r[0])
    smallest = {g: min((i for i in ids if i is not None), default=None) for g, ids in least.items()}
    want = Counter((r[0], f"{p:016x}", smallest[g]) for r, p, g in zip(rows, prints, of, strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(of))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_files_over_the_limit_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    of = groups(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    for most in (2, 5, 4096):
        scratch = Scratch(spark, "test")
        found = {r.vertex: r.root for r in components(scratch, simhash.links(scratch, df, most=most)).collect()}
        roots = [found.get(p, p) for p in signed]
        assert len({*zip(roots, of, strict=True)}) == len(set(of)) == len(set(roots)), most


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (100, 101)]
    got = {r.vertex: r.root for r in components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# ---------------------------------------------------------------- exact dedup


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, rows, none, weak, keep):
    digest = (lambda c: F.unhex(F.substring(F.md5(c), 1, 2))) if weak else exact_dedup.SHA256
    got = exact_dedup.assign(docs, keep=keep, digest=digest).collect()
    ids = defaultdict(list)
    for r in rows:
        ids[r[1] or ""].append(r[0])
    pick = max if keep == "largest" else min
    best = {t: pick((i for i in v if i is not None), default=None) for t, v in ids.items()}
    want = Counter((r[0], best[r[1] or ""], len(ids[r[1] or ""])) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(ids)
    if not weak:
        out = exact_dedup.keep_one(docs, keep=keep)
        assert out.columns == docs.columns and sorted(r.text or "" for r in out.collect()) == sorted(ids)
        assert exact_dedup.report(none).count() == 0


def test_exact_dedup_reads_only_runs_whose_filter_hits(spark, docs):
    digested = lambda d: d.select(exact_dedup.SHA256(F.coalesce("text", F.lit(""))).alias("digest"), "doc_id", F.monotonically_increasing_id().alias("row"))
    a, b = docs.where("doc_id < 40"), docs.where("doc_id >= 40")
    index = exact_dedup.Index(spark, fanout=3)
    index.add(digested(a))
    index.add(digested(b))
    assert [(r.number, r.level) for r in index.runs] == [(0, 0), (1, 0)]
    batch = spark.createDataFrame([(999, "a"), (998, "nobody has this text")], "doc_id long, text string")
    held, read = index.probe(digested(batch))
    want = b.where("text = 'a'").agg(F.min("doc_id"), F.count(F.lit(1))).first()
    assert read == [1] and [(r.keep_id, r.group_size) for r in held.collect()] == [tuple(want)]
    assert index.probe(digested(batch.where("doc_id = 998")))[1] == []
    index.add(digested(batch))  # the third run fills the level
    assert [(r.number, r.level) for r in index.runs] == [(3, 1)]
    texts = docs.where("doc_id IS NOT NULL").select("text").unionByName(batch.select("text")).select(F.coalesce("text", F.lit("")).alias("t"))
    assert index.whole().count() == texts.distinct().count() and index.whole().agg(F.sum("group_size")).first()[0] == texts.count()
    plan = index._merged(index.runs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_exact_dedup_without_a_bounded_filter(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.report(docs).collect()))
    kept = sorted(map(str, exact_dedup.keep_one(docs).collect()))
    monkeypatch.setattr(filters, "BOUND", 0)
    assert sorted(map(str, exact_dedup.report(docs).collect())) == want
    assert len(exact_dedup.keep_one(docs).collect()) == len(kept)


# --------------------------------------------------------------------- mixing


def test_mixing(docs, rows, none):
    got = mixing.report(docs).collect()
    size = lambda t: len([w for w in (t or "").encode().split()])
    of = defaultdict(int)
    for r in rows:
        of[r[2]] += size(r[1])
    names = sorted((s for s in of if s is not None), key=lambda s: s.encode()) + ([None] if None in of else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(of.values())
    while True:
        rest = total - sum(3 * of[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * of[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * of[s]}
        if not over:
            break
        full |= over
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        taken[r.target, r.source_size] += r.taken
    largest = max(size(r[1]) for r in rows)
    for s in names:
        assert abs(taken[target[s], of[s]] - target[s]) <= 2 * largest
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.report(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in mixing.plan(docs).collect())
    assert mixing.report(none).count() == 0 and mixing.mix(none).count() == 0


# ------------------------------------------------------------------- sharding


def test_sharding(docs, rows, none):
    got = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    by_key = defaultdict(set)
    for r in got:
        by_key[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(v) == 1 for v in by_key.values())
    assert sharding.shard(none).count() == 0


def test_sharding_is_rendezvous(spark, docs):
    """The shard of greatest weight / -ln(u), by brute force over all shards."""
    weights = [1.0, 2.5, 1.0, 0.5]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    units = [F.xxhash64(key, F.lit(j)).alias(f"h{j}") for j in range(len(weights))]
    for r in docs.select("doc_id", *units, sharding.shard_of(F.col("doc_id"), weights).alias("s")).collect():
        u = [((r[f"h{j}"] % (1 << 64) >> 11) + 0.5) / (1 << 53) for j in range(len(weights))]
        scores = [w / -math.log(x) for w, x in zip(weights, u, strict=True)]
        assert r.s == scores.index(max(scores))


def test_sharding_by_weight(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = {r.shard: r["count"] for r in ids.select(sharding.shard_of(F.col("doc_id"), [1.0, 3.0]).alias("shard")).groupBy("shard").count().collect()}
    assert abs(n[1] / 20_000 - 0.75) < 0.02


# ---------------------------------------------------------------- quality


def test_quality_rules(docs, rows, none, labels):
    got = {}
    for r in quality_rules.rules(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        if i is None:
            continue
        t = t or ""
        words = [w for w in t.encode().split()]
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        r = next(x for x in got[i] if x.n_words == want[0] and x.word_chars == want[1])
        assert tuple(r)[1:6] == want and r.base_failed == failed and (not r.kept or not failed)
        assert r.kept == (not failed and r.log_ratio >= quality_rules.THRESHOLD)
    assert quality_rules.rules(none, labels).count() == 0
    assert quality_rules.keep(docs, labels).columns == docs.columns


def test_quality_verdicts_by_brute_force(docs, rows, labels):
    """The log-likelihood ratio counted anew, n-gram by n-gram."""
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}

    def grams(t):
        b = (t or "").encode()
        return [(int.from_bytes(b[i : i + 4], "little") * 2654435761 % (1 << 32)) >> 18 for i in range(len(b) - 3)]

    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(grams(t))
        if i is not None and i in trusted:
            target.update(grams(t))
    share = sum(target.values()) / sum(raw.values())
    want = Counter()
    for i, t, *_ in rows:
        g = grams(t)
        ratio = sum(round(math.log((target[b] + 10) / (raw[b] * share + 10)) * (1 << 20)) for b in g)
        words = (t or "").encode().split()
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want[i, not failed and ratio >= -0.2 * (1 << 20) * len(g)] += 1
    assert Counter((r.doc_id, r.kept) for r in quality_rules.rules(docs, labels).collect()) == want


def test_repeat_words_long_path(monkeypatch):
    words = [b"a", b"b", b"c", b"d", b"e", b"x", b"a", b"b", b"c", b"d", b"e"]
    assert textstats.repeat_words(words) == 10
    monkeypatch.setattr(textstats, "LONG", 0)
    assert textstats.repeat_words(words) == 10 and textstats.repeat_words([b"q", *b"abcdefgh"[:0]] * 3) == 0


def test_quality_classifier(spark, none):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(WORDS) for _ in range(40))) for i in range(300)]
    bad = [(1000 + i, " ".join(rng.choice(WORDS).upper() + "!!###" for _ in range(40))) for i in range(80)]
    odd = [(5000, None), (5001, ""), (None, good[0][1]), (None, None), (7, good[7][1]), (7, good[7][1]), (5002, "z" * 300_000)]
    df = spark.createDataFrame([(*r, "clash", 0, 1.0) for r in good + bad + odd], "doc_id long, text string, trusted string, half int, x double")
    lab = spark.createDataFrame([(i, 1) for i, _ in good[:200]] + [(i, 0) for i, _ in bad[:40]] + [(None, 1), (3, 1)], "doc_id long, quality int")
    rows = quality_classifier.classify(df, lab).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in good + bad + odd)
    got = {r.doc_id: r for r in rows}
    assert all(r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    assert np.mean([got[i].predicted for i, _ in good]) > 0.95 and np.mean([got[i].predicted for i, _ in bad]) < 0.05
    # labels of the held-out fold, and those of bad documents, move no score
    fold_2 = [(i, 1) for i, _ in bad if zlib.crc32(str(i).encode()) % 4 == 2]
    again = {r.doc_id: r.score for r in quality_classifier.classify(df, lab.where("quality = 1").unionByName(spark.createDataFrame(fold_2, "doc_id long, quality int"))).collect()}
    assert fold_2 and all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    assert quality_classifier.classify(none.select("doc_id", "text"), lab).count() == 0
    assert {r.score for r in quality_classifier.classify(df, lab.where("false")).collect()} == {quality_classifier.DEFAULT_PRIOR}


def _sides(n_good: int, n_bad: int, n_p: int, apart: float, seed: int):
    """(x, trusted): descriptions of trusted, and of good and bad unlabelled rows."""
    rng, k = np.random.default_rng(seed), quality_classifier.N_FEATURES
    x = np.vstack([rng.normal(apart, 1, (n_p, k)), rng.normal(apart, 1, (n_good, k)), rng.normal(-apart, 1, (n_bad, k))])
    return x, np.arange(len(x)) < n_p


def test_classifier_prior_is_read_from_unlabelled_scores():
    for share in (0.3, 0.6, 0.9):
        x, p = _sides(int(4000 * share), int(4000 * (1 - share)), 2000, 0.6, 4)
        sums = lambda part: part(x, p)
        n_p, n_u, mean, scale = quality_classifier.moments(sums)
        w = quality_classifier.separate(sums, mean, scale, n_p, n_u)
        assert abs(quality_classifier.estimate_prior(sums, mean, scale, w, n_p, n_u) - share) < 0.06


def test_classifier_minimises_the_non_negative_risk():
    x, p = _sides(600, 400, 3000, 0.25, 5)
    parts = [slice(0, 400), slice(400, 3400), slice(3400, None)]
    sums = lambda part: sum(part(x[s], p[s]) for s in parts)
    n_p, n_u, mean, scale = quality_classifier.moments(sums)
    d, prior = quality_classifier.design(x, mean, scale), 0.6

    def risk(w):
        f = d @ w
        negative = np.logaddexp(0, f[~p]).mean() - prior * np.logaddexp(0, f[p]).mean()
        return prior * np.logaddexp(0, -f[p]).mean() + max(0.0, negative) + quality_classifier.DECAY / 2 * w @ w, negative

    w, seen = quality_classifier.fit(sums, prior, mean, scale, n_p, n_u)
    assert min(seen) >= 0 and abs(risk(w)[1] - seen[-1]) < 1e-9
    rng = np.random.default_rng(0)
    for size in (0.3, 0.1, 0.03, 0.01):
        assert all(risk(w)[0] <= risk(w + rng.normal(0, size, len(w)))[0] + 1e-6 for _ in range(200))
    # with few trusted rows and too high a prior the second part would turn negative: the fit stops before
    x, p = _sides(600, 400, 30, 2.0, 6)
    n_p, n_u, mean, scale = quality_classifier.moments(sums := lambda part: part(x, p))
    w, seen = quality_classifier.fit(sums, 0.9, mean, scale, n_p, n_u)
    assert min(seen) >= 0 and seen[-1] < 0.05


# ------------------------------------------------------------------ licences


def license_windows(text, templates):
    """{license: (containment, start, windows)} of every window, by brute force."""
    import re

    cut = lambda t: [tuple(w[i : i + 5]) for w in [[x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]] for i in range(len(w) - 4)]
    grams, out = cut(text), {}
    for name, t in templates.items():
        want = cut(t)
        if not want:
            continue
        size = 1 << math.ceil(math.log2(len(want)))
        step = max(1, size // 2)
        hits = [(len(set(want) & set(grams[i : i + 2 * size])) / len(set(want)), -i) for i in range(0, len(grams), step)]
        good = [h for h in hits if h[0] >= 0.8]
        if good:
            out[name] = (max(good)[0], -max(good)[1], len(good))
    return out


def license_texts():
    rng = random.Random(11)
    fill = lambda n: " ".join(rng.choice(["erin", "thanedble", "of", "the", "license", "software", "under", "permission"]) for _ in range(n))
    out = [None, "", "under the MIT", "Released under the MIT License.", license_scan.TEMPLATES["MIT-text"].upper()]
    for name in license_scan.TEMPLATES:
        words = license_scan.TEMPLATES[name].split()
        for changes in (0, 1, 2, 3):
            w = list(words)
            for _ in range(changes):
                w.insert(rng.randrange(len(w)), fill(rng.randrange(1, 4)))
            out.append(f"{fill(rng.randrange(90))}\n{' '.join(w)} {fill(rng.randrange(90))}")
    return out + [fill(30_000) + " " + license_scan.TEMPLATES["MPL-2.0"] + " " + fill(3000), out[7], out[7]]


def test_license_scan(spark, none):
    texts_ = license_texts()
    df = spark.createDataFrame([(i if i % 50 else None, t, "clash", 3, "clash") for i, t in enumerate(texts_)], "doc_id long, text string, license string, row int, hashes string").repartition(3)
    want = Counter((i if i % 50 else None, name, round(c, 9), at, n) for i, t in enumerate(texts_) for name, (c, at, n) in license_windows(t, license_scan.TEMPLATES).items())
    got = Counter((r.doc_id, r.license, round(r.containment, 9), r.first_shingle, r.n_windows) for r in license_scan.scan(df).collect())
    assert {(i, name) for i, name, *_ in got} == {(i, name) for i, name, *_ in want}  # recall 1 of documents
    assert sum((got & want).values()) >= 0.99 * sum(want.values()) and len(got) == len(want)
    assert license_scan.scan(none).count() == 0


def test_license_anchors_find_what_all_windows_do(spark):
    some = {k: license_scan.TEMPLATES[k] for k in ("MIT", "MIT-text", "CC-BY-4.0", "ISC-text", "WTFPL")}
    df = spark.createDataFrame(list(enumerate(license_texts()[:40])), "doc_id long, text string")
    table = spark.createDataFrame(list(some.items()), "license string, text string")
    every = sorted(license_scan.scan(df, table, every=True).collect())
    assert every and every == sorted(license_scan.scan(df, some).collect())


# ---------------------------------------------------------------------- html

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body class="with-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>menu</a></li></ul></nav><div class="wrap"><div class="post-7"><h2>Title &amp; more</h2><p>One <b>two</b>
three&nbsp;four<br>five<p>Second &lt;x&gt;<div class="ad-box">buy</div><form><input value=">">f</form><p>tail</p></div>
<div class="sidebar"><p>side text side text side text side text side text side text</p></div><div id="comments"><p>long comment long comment</p></div></div><footer>foot</footer>"""


def test_html_extract(spark):
    pages = [(i, f"http://www.h.example/{i}", PAGE) for i in range(3)] + [(3, None, "<p>a<p>b <span class='ad'>no</span> c"), (4, "nonsense", None), (5, "http://h.example/x", "<article><p>only &am")]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0].text == "Title & more\nOne two three four five\nSecond <x>\ntail" and got[0].n_chars == len(got[0].text)
    assert (got[3].text, got[4].text, got[4].n_chars, got[5].text) == ("a\nb c", "", 0, "only &am")
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "source,want",
    [
        ('<body><div class="a"><p>first half here</p></div><div class="b"><p>second half here</p></div></body>', "first half here\nsecond half here"),
        ('<body><div class="post legal"><p>the article stands here in full</p></div><div class="sidebar">aside</div></body>', "the article stands here in full"),
        ('<div class="search-tips"><p>the article stands here in full</p></div><div class="popular">other things</div>', "the article stands here in full"),
        ('<body><div class="entry-header"><h1>My title</h1></div><div class="c"><p>' + "some text " * 60 + "</p></div></body>", "My title\n" + ("some text " * 60).strip()),
        ('<article><p>keep <span CLASS="ad">buy</span> this</p></article>', "keep this"),
        ('<article><p>text text text</p></article><div id="comments"><article class="c"><p>' + "I think so too " * 30 + "</p></article></div>", "text text text"),
        ('<form id="f"><div><p>a whole page in one form</p></div></form>', "a whole page in one form"),
        ('<div style="display: none">hidden</div><p>shown</p><p hidden>not</p>', "shown"),
        ('<article><header><h1>T</h1><p>by me</p></header><p>x &lt; y</p></article><header><h1>Site</h1></header>', "T\nx < y"),
        ("<p>a < b<p>c <3 d<scr", "a < b\nc <3 d"),
    ],
)
def test_html_cases(source, want):
    assert html_extract.extract(source) == want


def test_html_is_linear_in_nesting():
    import time

    for source in ("<div>" * 100_000 + "x" + "</div>" * 100_000, "<ul><div>" + "<blockquote>" * 50_000 + "</ul>" * 50_000, '<a "' * 50_000, "<b>" * 50_000 + "<p>x</p>" * 50_000):
        began = time.process_time()
        html_extract.extract(source)
        assert time.process_time() - began < 5


def test_html_templates_against_what_made_them(spark):
    """Generated pages: the text that went into a page must come out, whatever
    its host's template, also from pages that do not follow it."""
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice(WORDS).replace(",", "").replace(".", "") for _ in range(n))
    shapes = {
        "a": lambda b: f"<div id=top><ul><li><a href=/>home</a></li><li><a href=/x>more</a></li></ul></div><div class='content legal'>{b}</div><div class='right'><p>the same words on all pages of this host</p></div>",
        "b": lambda b: f"<div class='page has-sidebar'><div class=left>{b}</div><div class='sidebar'><p>{line(9)}</p></div></div><div class='site-footer'>{line(5)}</div>",
        "c": lambda b: f"<main><div class='x{rng.randrange(99)}'>{b}</div></main><div class='cookie-notice'>{line(40)}</div>",
        "d": lambda b: f"<table><tr><td class=menu>{line(6)}<td class=text>{b}</table>",
    }
    pages, want = [], {}
    for i in range(120):
        host = "abcd"[i % 4]
        blocks = [line(rng.randrange(12, 40)) for _ in range(rng.randrange(3, 7))]
        inner = "".join(f"<p>{x}" if k % 2 else f"<div><b>{x}</b></div>" for k, x in enumerate(blocks))
        shape = shapes["abcd"[(i + 1) % 4] if i % 15 == 0 else host]  # some pages have another host's template
        pages.append((i, f"https://www.{host}.example/{i}", f"<html><body>{shape(inner)}</body>"))
        want[i] = "\n".join(blocks)
    pages += [pages[5], pages[5], (500, "https://lone.example/", None), (501, None, "<p>no host")]
    want |= {500: "", 501: "no host"}
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, host string, path int")
    got = [(r.page_id, r.text) for r in html_extract.main_text(df.repartition(3)).collect()]
    assert len(got) == len(pages) and {i: t for i, t in got} == want
    decided = {r.host: r.path for r in html_extract.host_paths(df).collect()}
    assert len(set(decided.values())) > 2


# -------------------------------------------------------------------- tokens


def test_token_counts_against_greedy():
    rng = random.Random(0)
    pick = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6)))
    for _ in range(150):
        first, rest = {pick() for _ in range(6)}, {pick() for _ in range(6)}
        words = [pick() + pick() for _ in range(40)]

        def greedy(w):
            at = n = 0
            while at < len(w):
                end = next((e for e in range(len(w), at, -1) if w[at:e] in (rest if at else first)), None)
                if end is None:
                    return 1
                n, at = n + 1, end
            return n

        assert token_counts.Automaton(first, rest).lengths(words).tolist() == [greedy(w) for w in words]


def test_token_counts_query(docs, rows, none):
    initial, rest = map(set, token_counts.pieces(tokenizer_file(BPE_FILE)))

    def greedy(w):
        at = n = 0
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if w[at:e] in (rest if at else initial)), None)
            if end is None:
                return 1
            n, at = n + 1, end
        return n

    got = Counter(map(tuple, token_counts.token_counts(docs, tokenizer_file(BPE_FILE)).collect()))
    want = Counter()
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        want[i, len(words), sum(map(greedy, words))] += 1
    assert got == want
    assert token_counts.token_counts(none, tokenizer_file(BPE_FILE)).count() == 0


def test_bpe_refuses_other_tokenizers(tmp_path):
    import json

    file = json.load(open(tokenizer_file(BPE_FILE)))
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        bpe.load(str(tmp_path / "t.json"))


def test_bpe(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(BPE_FILE))
    got = Counter(map(tuple, bpe.encode(docs, tokenizer_file(BPE_FILE)).collect()))
    want = Counter()
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert got == want and bpe.encode(none, tokenizer_file(BPE_FILE)).count() == 0


def test_bpe_fuzz():
    import json

    from tokenizers import Tokenizer

    path = tokenizer_file(BPE_FILE)
    t, own, rng = Tokenizer.from_file(path), bpe.Bpe(json.load(open(path)), known=500), random.Random(4)
    for _ in range(60):
        some = ["".join(rng.choice(["a", "b", "The", " ", "  ", "\n", "'s", "é", "漢", "1", "--", "<|endoftext|>", "\t", "　", "thanedble", "==="]) for _ in range(rng.randrange(40))) for _ in range(20)] + ["ab" * 200]
        assert own.encode_batch(some) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(some, add_special_tokens=False)]
