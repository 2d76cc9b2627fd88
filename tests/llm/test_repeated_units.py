"""Substring deduplication against brute force."""

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from boxwright.llm import repeated_units

SF = "/root/testdata/sf0.001"
LONG = "This passage has a good many words so that a run of it is long enough to be removed. It goes on here, and then\nin the next line too"
ROWS = [(5000, LONG), (5001, "Start here.\n" + LONG.upper() + "\nÉnd é there."), (5002, LONG + "\n" + LONG), (5003, None), (5004, ""), (5005, "Short one."), (5006, "Short one."), (None, LONG), (5001, "Start here.\n" + LONG.upper() + "\nÉnd é there."), (5007, "é " + LONG), (5007, LONG + " and more")]


def units(text):
    out, now = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if now and "\n" in text[now[-1].end() : m.start()]:
            out.append(now)
            now = []
        now.append(m)
        if m[0][-1] in ".!?":
            out.append(now)
            now = []
    return [(" ".join(m[0] for m in u).translate({c: c + 32 for c in range(65, 91)}), u[0].start(), u[-1].end(), len(u)) for u in [*out, now] if u]


def expected(rows, min_words=repeated_units.MIN_WORDS):
    first, spans = set(), defaultdict(list)
    for doc, text in sorted({(d, t) for d, t in rows if d is not None and t}):
        run = []
        for u in [*units(text), None]:
            if u and u[0] in first:
                run.append(u)
                continue
            if u:
                first.add(u[0])
            if sum(x[3] for x in run) >= min_words:
                spans[doc, text].append((run[0][1], run[-1][2]))
            run = []
    return spans


def test_repeated_units(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    # two texts of one id rank by a hash, so brute force takes them where the order doesn't matter
    docs = spark.createDataFrame([r for r in ROWS if r[0] != 5007], "doc_id long, text string").union(given).withColumn("digest", F.lit("clash")).withColumn("start", F.lit(None).cast("long")).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows)
    got = {r.doc_id: r for r in repeated_units.find(docs).collect()}
    assert got.keys() == {d for d, _ in rows} and len(want) > 3
    by = {d: s for (d, _), s in want.items()}
    assert {d: r.spans for d, r in got.items()} == {d: ",".join(f"{a}:{b}" for a, b in by.get(d, [])) for d in got}
    assert all(r.removed_chars == sum(b - a for a, b in by.get(d, [])) and r.n_spans == len(by.get(d, [])) for d, r in got.items())
    every = {d: s for (d, _), s in expected(rows, 1).items()}
    assert {r.doc_id: r.spans for r in repeated_units.find(docs, 1).collect()} == {d: ",".join(f"{a}:{b}" for a, b in every.get(d, [])) for d in got}
    cut = repeated_units.cut(docs)
    assert cut.columns == docs.columns

    def without(text, spans):
        for a, b in reversed(spans):
            text = text[:a] + text[b:]
        return text

    assert sorted((r.doc_id or -1, r.text or "") for r in cut.collect()) == sorted((d or -1, without(t, want.get((d, t), [])) if t else "") for d, t in rows)
    assert repeated_units.find(docs.limit(0)).count() == 0


def test_check_tells_colliding_texts_apart():
    """Two texts whose polynomials modulo 2**64 are equal, whatever stands for the letters."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    _, digest, check, *_ = repeated_units.units(pa.array([a, b, a]))
    assert digest[0] == digest[1] == digest[2] and check[0] != check[1] and check[0] == check[2]


def test_two_texts_of_one_id(spark):
    """One of the two keeps the passage and the other loses it, whichever ranks first, after 5000 is gone."""
    df = spark.createDataFrame([r for r in ROWS if r[0] == 5007], "doc_id long, text string")
    got = sorted(r.text for r in repeated_units.cut(df).collect())
    # the first sentences differ ("é This..."), the shared rest is too short to be a run
    assert got == sorted(r[1] for r in ROWS if r[0] == 5007)
    assert repeated_units.find(df).count() == 1
