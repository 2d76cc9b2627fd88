"""Language-model scores: the base against plain counting, the network against its own definition."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxwright.llm import attention_lm as lm
from boxwright.llm import registry

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(registry.BYTES)
ROWS = [(9001, None), (9002, ""), (9003, " "), (9004, "The the THE é É"), (9004, "The the THE é É"), (9005, "novel-word " * 3), (9006, "word " * 3000), (None, "no id"), (9007, "x" * 5000)]


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return spark.createDataFrame(ROWS, "doc_id long, text string").union(given).withColumn("h", F.lit("clash")).withColumn("score", F.lit(1)).cache()


@pytest.mark.parametrize("head", [lm.HEAD, 50])
def test_base(docs, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = [(r.doc_id, [*words(r.text), None]) for r in docs.collect()]
    c = Counter(w for d, t in rows if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for d, t in rows)
    got = lm.score(docs, PATH).collect()
    assert Counter((*r[:5], round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # copies of a row score alike
    assert len({r.score for r in got if r.doc_id == 9004}) == 1


def test_empty(docs):
    assert lm.score(docs.limit(0), PATH).count() == 0


def setting(lengths=(5, 40, 1)):
    rng = np.random.default_rng(0)
    n = np.array(lengths)
    before, target = lm._sequences(rng.integers(0, lm.CLASSES, n.sum()), 3, n)
    at, real, asked = lm.windows(n)
    return n, before, target, at, real, asked


def test_each_position_is_scored_once():
    n, _, _, at, _, asked = setting((5, 40, 1, 16, 17, 32))
    assert sorted(at[:, lm.STEP :][asked]) == list(range(n.sum()))


def test_attention_sees_only_the_past():
    _, before, target, at, real, asked = setting()
    p = lm.fresh()
    where = at[:, lm.STEP :][asked]
    score = lambda b: dict(zip(where, lm.log_probabilities(p, b[at], real, asked, target[where]), strict=True))
    one = score(before)
    for k in (7, 30):
        changed = before.copy()
        changed[k] = (changed[k] + 1) % lm.CLASSES
        two = score(changed)
        assert all(one[i] == pytest.approx(two[i]) for i in one if i < k or i >= 45) and one[k] != two[k]


def test_tables_score_as_the_definition():
    _, before, target, at, real, asked = setting((5, 40, 1, 16, 17, 300))
    where = at[:, lm.STEP :][asked]
    for scale in (1, 12):  # the larger one is beyond what goes without a shift
        p = {k: x * np.float32(scale) for k, x in lm.fresh().items()}
        p["near"] += np.linspace(0, 1, 2 * lm.STEP, dtype=np.float32)
        s = lm.Scorer(p)
        assert s.bounded == (scale == 1)
        assert s(before[at], real, asked, target[where]) == pytest.approx(lm.log_probabilities(p, before[at], real, asked, target[where]), abs=2e-4)


def test_tables_score_large_sums():
    """Two sums of exponentials that fit in a float each, but not their product."""
    _, before, target, at, real, asked = setting((5, 40, 17))
    where, p = at[:, lm.STEP :][asked], lm.fresh()
    p["b1"] += np.float32(50)
    p["b2"] += np.float32(50)
    s = lm.Scorer(p)
    assert s.bounded and s(before[at], real, asked, target[where]) == pytest.approx(lm.log_probabilities(p, before[at], real, asked, target[where]), abs=2e-4)


def test_gradients_of_large_weights():
    """Where exponentials need a shift, in the attention or in the classes."""
    _, before, target, at, real, asked = setting((5, 40, 1, 16, 300))
    asks = target[at[:, lm.STEP :]][asked]
    for names in (("e", "wq", "wk"), ("w1", "w2"), ("near",)):
        p = {k: x * np.float32(40 if k in names else 1) for k, x in lm.fresh().items()}
        p["near"] += np.linspace(0, 200 if "near" in names else 1, 2 * lm.STEP, dtype=np.float32)
        loss, g = lm.gradients(p, before[at], real, asked, asks)
        want = -lm.log_probabilities(p, before[at], real, asked, asks).mean()
        assert all(np.isfinite(x).all() for x in g.values())
        # a class whose chance is 0 in float32 has no finite logarithm
        assert loss == pytest.approx(want, rel=1e-3) or not math.isfinite(loss)


def test_followers():
    rng = np.random.default_rng(5)
    n = np.array([3, 1, 40, 9])
    flat, column = rng.integers(0, 7, n.sum()), np.array([0, 1, 2, 3, 3, 3, 3])
    met, want = np.zeros(28, np.int64), Counter()
    lm.followers(met, column, 4, flat, n)
    for text in np.split(flat, np.cumsum(n)[:-1]):
        want.update((text[i], column[text[i - g]]) for g in lm.GAPS for i in range(g, len(text)))
    assert all(met[i * 4 + c] == want[i, c] for i in range(7) for c in range(4))


def test_follower_counts_are_dealt_evenly():
    """Blocks of a vocabulary whose frequent ids are neighbours need about as many bytes each, and are the whole table."""
    rng = np.random.default_rng(9)
    size, wide = 50 * lm.MET_IDS - 7, 5
    met = rng.poisson(1e5 / np.arange(1, size + 1)[:, None], (size, wide)).ravel().astype(np.int64)
    made = lm._met_rows(lm._met_blocks(met, wide))
    sizes = np.array([len(x.as_py()) for x in made.column("met")])
    assert sizes.max() < 1.5 * np.median(sizes)
    again = np.zeros_like(met)
    for k, x in zip(made.column("block").to_pylist(), made.column("met"), strict=True):
        lm._met_blocks(again, wide)[k][:] = lm._met_table(x.as_py()).reshape(-1, wide)
    assert (again == met).all()


def test_hashes_tell_words_apart_wherever_they_stand():
    rng = np.random.default_rng(8)
    some = ["".join(rng.choice(list("ab\0é"), n)) for n in [*range(1, 20), 63, 64, 65, 66, 130, 4000] for _ in range(30)]
    some += ["a", "a\0", "a" * 8, "a" * 9, "a" * 16, "a" * 64, "a" * 65]
    lines = [*some, "", " ", " ".join(some), "\n".join(reversed(some)) + " "]
    h, before = lm._hashes(*lm.text_buffers(pa.array(lines)))
    got = {}
    for k, line in enumerate(lines):
        found = words(line)
        assert before[k + 1] - before[k] == len(found)
        for w, x in zip(found, h[before[k] : before[k + 1]].tolist(), strict=True):
            assert got.setdefault(w, x) == x
    assert len(set(got.values())) == len(got) == len({w for line in lines for w in words(line)})


def test_places():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 1000):
        known = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        h = np.concatenate([known, rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at, hit = lm._places(known, h)
        assert list(hit) == [x in set(known) for x in h] and (known[at[hit]] == h[hit]).all()


def test_probabilities_add_up():
    _, before, _, at, real, asked = setting((3,))
    p, where = lm.fresh(), at[:, lm.STEP :][asked]
    total = sum(np.exp(lm.log_probabilities(p, before[at], real, asked, np.full(len(where), c))) for c in range(lm.CLASSES))
    assert total == pytest.approx(np.ones(3), abs=1e-4)
    counts = np.random.default_rng(2).integers(0, 50, 3000)
    classes = lm.Classes(counts, [np.arange(2000)])
    inside = np.bincount(classes.of, 10.0**classes.within, lm.CLASSES)
    assert inside[np.unique(classes.of)] == pytest.approx(1.0)


def test_gradients():
    _, before, target, at, real, asked = setting()
    p = {k: x.astype(np.float64) for k, x in lm.fresh().items()}
    asks = target[at[:, lm.STEP :]][asked]
    loss = lambda: lm.gradients(p, before[at], real, asked, asks)
    g = loss()[1]
    assert loss()[0] == pytest.approx(-lm.log_probabilities(p, before[at], real, asked, asks).mean())
    for k, x in p.items():
        flat, i = x.ravel(), int(np.argmax(abs(g[k])))
        old = flat[i]
        flat[i] = old + 1e-4
        up = loss()[0]
        flat[i] = old - 1e-4
        down = loss()[0]
        flat[i] = old
        assert (up - down) / 2e-4 == pytest.approx(g[k].ravel()[i], rel=1e-3)


def test_held_out_texts_are_more_likely_than_by_frequency_alone(spark):
    """On held-out documents the network's ids are likelier than by the ids' training frequency."""
    from boxwright.llm.token_shards import encoder

    got = [r for r in registry.op7_language_model(spark, "/root/testdata/sf0.01").collect()]
    with open(PATH, encoding="utf-8") as f:
        encode = encoder(f.read())
    text = {r.doc_id: "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    counts = Counter(i for r in got if not r.held_out for i in [*encode(text[r.doc_id]), -1])
    n, v = sum(counts.values()), 50258
    by_count = sum(math.log10((counts[i] + 0.5) / (n + 0.5 * v)) for r in got if r.held_out for i in [*encode(text[r.doc_id]), -1])
    by_model = sum(r.score for r in got if r.held_out)
    assert by_model > 0.93 * by_count


def test_network_is_trained_on_all_windows(docs, monkeypatch):
    kept = {}
    monkeypatch.setattr(lm, "staged", lambda df, name, f=lm.staged: kept.setdefault(name, f(df, name)))
    lm.score(docs, PATH)
    lengths = np.array([r.n + 1 for r in kept["ids"].filter("not held_out").select("n").collect()])
    assert sum(r.n for r in kept["trained"].select("n").collect()) == len(lm.windows(lengths)[0])


def test_classes_come_from_all_followers(docs, monkeypatch):
    """Followers count in all training documents to their end, not in the first pass's sample."""
    kept, made = {}, []
    monkeypatch.setattr(lm, "WARM_DOCS", 20)
    monkeypatch.setattr(lm, "staged", lambda df, name, f=lm.staged: kept.setdefault(name, f(df, name)))
    whole = lm.Classes
    monkeypatch.setattr(lm, "Classes", lambda *a, f=whole: made.append((a, f(*a))) or made[-1][1])
    lm.score(docs, PATH)
    (args, got), end = made[0], len(made[0][0][0]) - 1
    batches = kept["ids"].filter("not held_out").select("ids", "n").toArrow().to_batches()
    every = [np.append(x, end).astype(np.int64) for _, some in lm._expanded(iter(batches)) for x in some]
    assert len(every) > len(args[1]) == 20
    want = whole(args[0], every)
    assert (got.of == want.of).all() and np.allclose(got.within, want.within)
