"""Operators over the whole corpus against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxwright.llm import decontaminate, graph, near_dup
from boxwright.llm.common import least_hashes, lowered, shingles, text_buffers, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree twentyfour"


def grams(text, short=True):
    w = WORD.findall(text or "")
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w and short else []))


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if shared else 0.0


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [str(x) for x in rng.choice(words, 120)]
    made = [(2000, None), (2001, ""), (2002, "  "), (2003, ""), (2004, "a b c"), (2005, "a b c"), (2006, "a b c d"), (2007, BASE), (2008, BASE + " more"), (2009, "x " * 300), (2010, "x " * 310), (2011, "y " * 100 + "z"), (2007, BASE), (None, BASE)]
    for i in range(60):  # a chain of copies: each differs from the last by a word, so the ends are unlike
        base[int(rng.integers(0, 120))] = f"new{i}"
        made.append((2100 + i, " ".join(base)))
    made += [(2200 + i, " ".join([*base[:110], *(f"t{i}{k}" for k in range(3))])) for i in range(80)]  # a group of near copies
    df = spark.createDataFrame(made, "doc_id long, text string")
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return df.union(given).withColumn("key", F.lit("clash")).withColumn("root", F.lit(None).cast("int")).withColumn("g", F.lit(1)).cache()


def test_word_hashes():
    texts = ["a b  a", None, "", "\t", "a", "é b\n a a", "b\x0b"]
    h, before = word_hashes(*text_buffers(pa.array(texts)))
    words = [w for t in texts for w in WORD.findall(t or "")]
    assert list(np.diff(before)) == [len(WORD.findall(t or "")) for t in texts]
    by = defaultdict(set)
    for w, x in zip(words, h, strict=True):
        by[w].add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
    s, bounds = shingles(h, before)
    assert list(np.diff(bounds)) == [sum(grams(t).values()) for t in texts]


def test_lowered_slices():
    column = pa.array(["AÀb", None, "ÉéZ", "", "xY"])
    want = ["aÀb", "", "Ééz", "", "xy"]
    for kind in (pa.string(), pa.large_string()):
        for a in range(5):
            for n in range(6 - a):
                assert lowered(column.cast(kind).slice(a, n)).to_pylist() == want[a : a + n]


def test_least_hashes(spark):
    df = spark.range(3000).withColumn("x", F.col("id") * 2)
    whole = [r.x for r in df.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    assert [r.x for r in least_hashes(df, ["id"], 50, ["x"])] == whole
    assert len(least_hashes(df.withColumn("id", F.lit(1)), ["id"], 50, ["x"])) == 50 and len(least_hashes(df.limit(3), ["id"], 50, ["x"])) == 3


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 60).astype(np.uint64)
    off = []
    for _ in range(40):
        wa, wb = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
        a, b = np.repeat(hashes, wa), np.repeat(hashes, wb)
        hashes = rng.integers(0, 2**63, 60).astype(np.uint64)
        sig = near_dup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 400)
        off.append((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(off)) < 3 * 0.5 / np.sqrt(40 * 400) and np.std(off) < 0.04
    one = near_dup.signatures(np.array([7], np.uint64), np.array([0, 1, 1]), 100)
    assert np.isfinite(one[0]).all() and np.isinf(one[1]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 101), (5, 5), (300, 200), (200, 250)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10, 41), 10), 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_classes(rows):
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(grams(t))
    ids = sorted(d for d in texts if d is not None)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for d in ids:
        for g in texts[d]:
            for s in g:
                by[s].add(d)
    for i in ids:
        for j in {x for g in texts[i] for s in g for x in by[s] if x > i}:
            if find(i) != find(j) and any(jaccard(a, b) >= 0.8 for a in texts[i] for b in texts[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {d: find(d) for d in ids}


def test_overlaps_of_heavy_weights():
    rng = np.random.default_rng(3)
    t, h, w = np.repeat(np.arange(6), 50), np.tile(np.arange(50), 6), rng.integers(0, 4, 300) * rng.integers(1, 9000, 300)
    on = w > 0
    got = near_dup._overlaps(t[on], h[on].astype(np.uint64), w[on], 6)
    want = np.minimum(w.reshape(6, 1, 50), w.reshape(1, 6, 50)).sum(axis=2)
    assert np.array_equal(got, want)


def test_near_duplicates(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = expected_classes(rows)
    got = near_dup.classes(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == {**want, None: None}
    sizes = Counter(want.values())
    assert all(r.n_copies == sizes[r.class_id] for r in got if r.doc_id is not None)
    kept = near_dup.keep_one(docs)
    by_row = expected_classes([(k, t) for k, (_, t) in enumerate(rows)])
    least = {}
    for k, root in by_row.items():
        d = rows[k][0]
        least[root] = min(least.get(root, (True, 0)), (d is None, d or 0))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(None if null else d for null, d in least.values())
    usual = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert {r.doc_id for r in near_dup.keep_one(usual).collect()} == {r.class_id for r in near_dup.classes(usual).collect()}
    assert near_dup.classes(docs.limit(0)).count() == 0


def leaked(text, items):
    w, found = WORD.findall(text or ""), []
    for i, item in items:
        want = grams(item, short=False)
        n = sum(want.values())
        total = max(len(w) - 4, 0)
        if n and total:
            size = min(n, total)
            windows = [[tuple(w[s + k : s + k + 5]) for k in range(size)] for s in range(total - size + 1)]
            if any(jaccard(Counter(x), want) >= 0.8 for x in windows if want.keys() & set(x)):
                found.append(i)
    return found


def test_decontamination(spark, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, None), (901, "too short item"), (902, "rep eat it all " * 9), (903, BASE)]
    item = bench[3][1].split()
    more = [(3000, " ".join(["before"] * 7 + item + ["after"] * 6)), (3001, " ".join(item[:-1])), (3002, " ".join(item[: len(item) // 2])), (3003, " ".join([*item[:9], "new", *item[9:]])), (3004, "rep eat it all " * 30), (3005, " ".join(bench[4][1].split() + item + bench[5][1].split()))]
    more += [(3100 + k, " ".join([*item[:k], "changed", *item[k + 1 :]])) for k in range(0, len(item), 2)]
    both = docs.select("doc_id", "text", "g").union(spark.createDataFrame(more, "doc_id long, text string").withColumn("g", F.lit(2))).cache()
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("g", F.lit("clash"))
    got = Counter((r.doc_id, r.items) for r in decontaminate.find(both, items).collect())
    want = Counter((r.doc_id, ",".join(map(str, sorted(leaked(r.text, bench))))) for r in both.collect())
    assert got == want
    assert dict(x for x in got if x[0] in (3000, 3002)) == {3000: str(bench[3][0]), 3002: ""}
    clean = decontaminate.keep_clean(both, items)
    assert clean.columns == both.columns and clean.count() == sum(n for (_, i), n in want.items() if not i)
    assert decontaminate.find(both.limit(0), items).count() == 0
    assert decontaminate.find(both, items.limit(0)).filter("contaminated").count() == 0
