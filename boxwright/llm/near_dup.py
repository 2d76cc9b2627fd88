"""Near-duplicate classes by BagMinHash.

A text is the multiset of its WIDTH-word shingles. Each shingle owns Poisson processes over the dyadic
intervals [0,1), [1,2), [2,4), ... of its weight; a point has a time, a cell of the interval and one of
COMPONENTS components, and counts while its cell lies below the shingle's weight in the text. The earliest
time per component is the signature: components agree with the weighted Jaccard probability. Points are made
only up to the time by which all components are surely met (later if one is not), so the work per text
hardly depends on its weights.

Texts that agree on one of BANDS bands of ROWS components meet in a bucket. Equal texts count once there.
In a bucket, members are compared with one hub, the one that meets most others. Where that leaves several
classes, shingles that no other such text has bound each text's similarity from above; what can still be
similar is compared in blocks of about BLOCK texts, which give the links between different classes alone.
So a group of copies gives a star, no list of all its pairs is made, and no pair is spared that could join
two classes. A pair is linked at an exact multiset Jaccard of SIMILARITY or more. Recall of one pair at 0.8
is 1-(1-0.8**ROWS)**BANDS > 0.999.

Cases: null, empty and wordless texts are alone in their class, equal or not. A text of fewer words than
WIDTH has one shingle of all its words. Rows with the same doc_id are one document of all those texts for
its class; a null doc_id has a null class. keep_one compares rows, whatever their ids: of a group the row with
the least doc_id stays (null last; then any one). An empty table gives an empty result. Other columns are
ignored by classes and kept by keep_one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import lookup, mix64, shingles, slices, staged, text_buffers, tidy, word_hashes
from boxwright.llm.graph import components, nearer

WIDTH, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 20
COMPONENTS = ROWS * BANDS
SLACK = 6.0
#: Documents and shingles in a block, about; two blocks of a bucket are compared in one row. A longer text fills its block alone, or with few.
BLOCK, BLOCK_SHINGLES = 64, 64_000
#: Texts, and bytes of text, whose signatures are made at once; each text takes some COMPONENTS * (log COMPONENTS + SLACK) points.
TEXTS, TEXT_BYTES = 256, 1 << 19
#: Comparisons with one hub in a group of the join that brings its text.
SHARE = 64
#: So many document ids may be broadcast to pick their texts (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_U = np.uint64


def weighted(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text: text number, hash and weight."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    if not len(h):
        return t, h, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]))
    return t[new], h[new], np.diff(np.append(new, len(h)))


def _points(text, h, low, length, weight, until, m, sig) -> None:
    """Take the earliest time per text and component from all processes up to until[text]."""
    seed = mix64(h + low * _U(0x9E3779B97F4A7C15))
    time = np.zeros(len(h))
    rate = length.astype(float)
    step = 0
    while len(seed):
        ahead = int(np.clip(np.mean((until[text] - time) * rate) + 1, 1, 64))
        draw = (np.arange(step + 1, step + 1 + ahead, dtype=_U) * _U(0xD1342543DE82EF95))[None, :] + seed[:, None]
        one = mix64(draw)
        gap = -np.log(((one >> _U(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        gap[:, 0] += time
        at = np.cumsum(gap, axis=1)
        inside = at <= until[text][:, None]
        two = mix64(one ^ _U(0xA0761D6478BD642F))
        cell = low[:, None] + (((two >> _U(32)) * length[:, None]) >> _U(32))
        r, c = np.nonzero(inside & (cell < weight[:, None]))
        part = ((two[r, c] & _U(0xFFFFFFFF)) * _U(m)) >> _U(32)
        np.minimum.at(sig, text[r] * m + part.astype(np.int64), at[r, c])
        on = inside[:, -1]
        text, seed, low, length, weight, time, rate = text[on], seed[on], low[on], length[on], weight[on], at[on, -1], rate[on]
        step += ahead


def signatures(hashes: np.ndarray, bounds: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """One row of m times for each text; infinite for a text without shingles."""
    n = len(bounds) - 1
    sig = np.full(n * m, np.inf)
    text, h, weight = weighted(hashes, bounds)
    total = np.maximum(np.diff(bounds), 1)
    parts = [(text, h, np.zeros(len(h), _U), np.ones(len(h), _U), weight)]
    low = 1
    while len(weight) and low < weight.max():
        on = weight > low
        parts.append((text[on], h[on], np.full(on.sum(), low, _U), np.full(on.sum(), low, _U), weight[on]))
        low *= 2
    text, h, lows, lengths, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    weight = weight.astype(_U)
    until = m * (math.log(m) + SLACK) / total
    on = np.ones(len(h), bool)
    while on.any():
        _points(text[on], h[on], lows[on], lengths[on], weight[on], until, m, sig)
        short = np.isinf(sig.reshape(n, m)).any(axis=1)
        until = until * np.where(short, 3.0, 1.0)
        on = on & short[text]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    bits = sig.view(_U).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0xE7037ED1A0B428DB), (len(sig), bands)).copy()
    for k in range(rows):
        key = mix64(key + bits[:, :, k] * _U(0x9E3779B97F4A7C15) + _U(k + 1))
    return key


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", TEXT_BYTES, TEXTS):
            raw, at = text_buffers(batch.column("text"))
            words, before = word_hashes(raw, at)
            hashes, bounds = shingles(words, before, WIDTH)
            used = np.flatnonzero(np.diff(bounds) > 0)
            key = band_keys(signatures(hashes, bounds)[used], ROWS, BANDS).view(np.int64)
            repeat = np.repeat(used, BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column("digest").take(pa.array(repeat)), batch.column("doc_id").take(pa.array(repeat))], ["key", "digest", "doc_id"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts have a multiset Jaccard of SIMILARITY or more."""
    for whole in batches:
        for batch in slices(whole, "text_a", TEXT_BYTES):
            yield from _verified(batch)


def similarities(texts_a: pa.Array, texts_b: pa.Array) -> np.ndarray:
    """Exact multiset Jaccard of the shingles, row by row; 0 where both have none."""
    sides = []
    for k, column in enumerate((texts_a, texts_b)):
        hashes, bounds = shingles(*word_hashes(*text_buffers(column)), WIDTH)
        t, h, w = weighted(hashes, bounds)
        sides.append((t, h, w, np.full(len(t), k)))
    t, h, w, _ = (np.concatenate(x) for x in zip(*sides, strict=True))
    n = len(texts_a)
    if not len(t):
        return np.zeros(n)
    order = np.lexsort((h, t))
    t, h, w = t[order], h[order], w[order].astype(float)
    twin = np.flatnonzero((h[1:] == h[:-1]) & (t[1:] == t[:-1]))
    shared = np.bincount(t[twin], np.minimum(w[twin], w[twin + 1]), n)
    every = np.bincount(t, w, n) - shared
    return np.divide(shared, every, out=np.zeros(n), where=every > 0)


def _verified(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    hit = pa.array(similarities(batch.column("text_a"), batch.column("text_b")) >= SIMILARITY)
    yield batch.select(["a", "b"]).filter(hit)


def _sized(ids: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(ids) if rows <= BROADCAST_IDS else ids


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ids (doc_id), which go by broadcast up to BROADCAST_IDS."""
    ids = staged(ids.distinct(), "wanted")
    return docs.select("doc_id", "text").join(_sized(ids, ids.count()), "doc_id", "left_semi")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among pairs (hub, doc_id), which are distinct. A hub's text is dealt to groups of SHARE pairs."""
    used = _texts(texts, pairs.select("doc_id").union(pairs.select("hub")))
    shares = staged(pairs.groupBy("hub").agg(F.count("*").alias("n")).withColumn("shares", F.ceil(F.col("n") / SHARE)), "shares")
    dealt = lookup(pairs, shares, "hub", "n", pairs.count(), "inner").withColumn("share", F.pmod(F.xxhash64("doc_id"), "shares"))
    hubs = shares.select("hub", F.explode(F.sequence(F.lit(0), "shares")).alias("share")).join(used.select(F.col("doc_id").alias("hub"), F.col("text").alias("text_b")), "hub")
    met = dealt.join(used.withColumnRenamed("text", "text_a"), "doc_id").join(hubs, ["hub", "share"])
    return staged(met.select(F.col("doc_id").alias("a"), F.col("hub").alias("b"), "text_a", "text_b").mapInArrow(tidy(_linked), "a long, b long"), "links")


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, w): each distinct shingle of a text with its weight, and the total weight with h null."""
    for whole in batches:
        for batch in slices(whole, "text"):
            hashes, bounds = shingles(*word_hashes(*text_buffers(batch.column("text"))), WIDTH)
            t, h, w = weighted(hashes, bounds)
            n = batch.num_rows
            some = np.concatenate([np.zeros(len(h), bool), np.ones(n, bool)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate([t, np.arange(n)]))), pa.array(np.concatenate([h.view(np.int64), np.zeros(n, np.int64)]), mask=some), pa.array(np.concatenate([w, np.diff(bounds)]).astype(np.int64))], ["doc_id", "h", "w"])


def _shared(texts: DataFrame) -> DataFrame:
    """(doc_id, size, shared): the weight of a text's shingles, and of those that another text has too.

    A text shares no more than that with any other, which bounds its similarity from above.
    """
    rows = staged(texts.mapInArrow(tidy(_own), "doc_id long, h long, w long"), "own")
    lone = rows.filter("h is not null").groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.sum("w").alias("w")).filter("n = 1").groupBy("doc_id").agg(F.sum("w").alias("lone"))
    return rows.filter("h is null").groupBy("doc_id").agg(F.max("w").alias("size")).join(lone, "doc_id", "left").select("doc_id", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("shared"))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between texts of different roots in two blocks of a bucket (or one: right is null), for each
    text one for each root that it meets."""
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            sides = [x for x in (r["left"], r["right"]) if x]
            docs = [d for side in sides for d in side]
            hashes, bounds = shingles(*word_hashes(*text_buffers(pa.array([d["text"] for d in docs]))), WIDTH)
            t, h, w = weighted(hashes, bounds)
            roots = np.array([d["root"] for d in docs])
            n, cut = len(docs), len(sides[0]) if len(sides) > 1 else 0
            both = _overlaps(t, h, w, n)
            size = np.bincount(t, w, n)
            near = both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-9
            near &= roots[:, None] != roots[None, :]
            if cut:
                near[:cut, :cut] = near[cut:, cut:] = False
            a, b = np.nonzero(np.triu(near & (both > 0)))
            found += {(docs[i]["doc_id"], roots[j]): (docs[i]["doc_id"], docs[j]["doc_id"]) for i, j in zip(a, b, strict=True)}.values()
        yield pa.RecordBatch.from_arrays([pa.array([int(min(x)) for x in found], pa.int64()), pa.array([int(max(x)) for x in found], pa.int64())], ["a", "b"])


def _overlaps(t: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The multiset overlap of each two of n texts; one product for each weight that occurs."""
    names, at = np.unique(h, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    used = np.bincount(at, minlength=len(names)) > 1  # what one text alone has overlaps with nothing
    place = np.cumsum(used) - 1
    on = used[at]
    below = 0
    for level in np.unique(w[on]):  # min(x, y) adds up the steps between weights that both reach
        reach, step, below = on & (w >= level), float(level - below), level
        cols, col = np.unique(place[at[reach]], return_inverse=True)
        row = t[reach]
        for a in range(0, len(cols), 4096):
            some = (col >= a) & (col < a + 4096)
            has = np.zeros((n, min(4096, len(cols) - a)), np.float32)
            has[row[some], col[some] - a] = 1
            out += step * (has @ has.T)
    return out


def _regrouped(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """crowd with root replaced by the root that roots (node, root) has for it, if any."""
    return crowd.withColumnRenamed("root", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def _open(crowd: DataFrame, count: str | None = None, weight: str | None = None) -> DataFrame:
    """The rows of buckets whose members have several roots; count and weight name columns for the bucket's rows and sum of sizes."""
    more = [*([F.count("*").alias(count)] if count else []), *([F.sum("size").alias(weight)] if weight else [])]
    apart = crowd.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *more).filter("low <> high").drop("low", "high")
    return staged(lookup(crowd, apart, "key", "n", crowd.count(), "inner"), "open")


def _hubs(crowd: DataFrame, *more: str) -> DataFrame:
    """(key, hub, n): of each bucket the member of the highest rank, with more of its columns, and its rows."""
    return crowd.groupBy("key").agg(F.max(F.struct("rank", "doc_id", *more)).alias("hub"), F.count("*").alias("n")).filter("n > 1")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_copies (documents in the class), one row for each doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id").distinct()
    if _unique(docs):
        roots = _roots(docs.filter("doc_id is not null")).withColumnRenamed("node", "doc_id")
    else:
        rows = _rows(docs.filter("doc_id is not null"))
        first = rows.groupBy("doc_id").agg(F.min("__row").alias("row"), F.count("*").alias("n")).filter("n > 1")
        own = lookup(rows.select("doc_id", "__row"), first, "doc_id", "n", rows.count(), "inner").filter("__row <> row")
        found = _roots(rows.select(F.col("__row").alias("doc_id"), "text"), own.select(F.col("__row").alias("a"), F.col("row").alias("b")))
        named = staged(rows.select(F.col("__row").alias("node"), "doc_id").join(found, "node").select("doc_id", "root").distinct(), "named")
        least = named.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
        roots = lookup(named, least, "root", "n", named.count(), "inner").select("doc_id", F.col("least").alias("root"))
    roots = staged(roots, "roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    sized = lookup(roots, sizes.withColumn("n_copies", F.col("n")), "root", "n", roots.count(), "inner")
    return ids.join(sized, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_copies", F.lit(1))).cast("long").alias("n_copies"))


def _unique(docs: DataFrame) -> bool:
    """Whether no doc_id is repeated, null aside."""
    return not docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()


def _rows(docs: DataFrame) -> DataFrame:
    return staged(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def _roots(known: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(node, root) of the documents that share a class; known: doc_id, unique, and text. more: further edges (a, b)."""
    known = known.withColumn("digest", F.xxhash64("text", F.length("text")))
    marked = staged(known.mapInArrow(tidy(_buckets), "key long, digest long, doc_id long").groupBy("key", "digest").agg(F.min("doc_id").alias("doc_id")), "buckets")
    counted = marked.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("met", F.col("n"))
    crowd = staged(lookup(marked.select("key", "doc_id"), counted, "key", "n", marked.count(), "inner"), "crowd")
    texts = staged(_texts(known, crowd.select("doc_id")), "texts")

    # members against the one that meets most others over all its buckets
    hubs = _hubs(crowd.join(crowd.groupBy("doc_id").agg(F.sum("met").alias("rank")), "doc_id"))
    met = lookup(crowd.select("key", "doc_id"), hubs, "key", "n", crowd.count(), "inner").filter("doc_id <> hub.doc_id")
    tested = staged(met.select("doc_id", F.col("hub.doc_id").alias("hub")).distinct(), "pairs")
    edges = [_verify(tested, texts)]
    crowd = _open(_regrouped(crowd.select("key", "doc_id", F.col("doc_id").alias("root")), nearer(edges[0])))

    # where several roots are left, all that can be similar, in blocks of bounded documents and shingles
    bounds = _shared(_texts(texts, crowd.select("doc_id")))
    crowd = _open(staged(crowd.join(bounds, "doc_id").filter(f"shared >= {SIMILARITY} * size - 1e-9").select("key", "doc_id", "root", "size"), "able"), "rows", "weight")
    dealt = crowd.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("weight") / BLOCK_SHINGLES))))
    blocks = staged(dealt.join(texts, "doc_id").groupBy("key", "block").agg(F.collect_list(F.struct("doc_id", "root", "text")).alias("docs"), F.min("root").alias("low"), F.max("root").alias("high")), "blocks")
    one = blocks.filter("low <> high").select(F.col("docs").alias("left"), F.lit(None).cast(blocks.schema["docs"].dataType).alias("right"))
    other = blocks.select("key", F.col("block").alias("__block"), F.col("docs").alias("right"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    two = blocks.join(other, "key").filter("block < __block and (low <> high or __low <> __high or low <> __low)").select(F.col("docs").alias("left"), "right")
    edges.append(staged(one.unionByName(two).mapInArrow(tidy(_across), "a long, b long").distinct(), "links"))

    # equal texts, which met as one; md5 so that different ones are never taken for equal
    worded = known.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.md5("text").alias("copy"))
    copies = worded.groupBy("copy").agg(F.min("doc_id").alias("root"), F.count("*").alias("n")).filter("n > 1")
    same = lookup(worded, copies, "copy", "n", worded.count(), "inner").filter("root <> doc_id").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    for e in [*edges, *([more] if more is not None else [])]:
        same = same.unionByName(e)
    return components(same)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with its columns."""
    kept = docs.columns
    if _unique(docs) and not docs.filter("doc_id is null").limit(1).count():
        gone = _roots(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).filter("node <> root").select(F.col("node").alias("__gone"))
        return docs.join(_sized(gone := staged(gone, "gone"), gone.count()), F.col("doc_id") == F.col("__gone"), "left_anti")
    rows = _rows(docs)
    found = _roots(rows.select(F.col("__row").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).withColumnRenamed("node", "__row")
    ranked = staged(found.join(rows.select("__row", F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__row").alias("rank")), "__row"), "ranked")
    best = ranked.groupBy("root").agg(F.min("rank").alias("best"), F.count("*").alias("n"))
    gone = lookup(ranked, best, "root", "n", ranked.count(), "inner").filter("rank <> best").select(F.col("__row").alias("__gone"))
    return rows.join(_sized(gone := staged(gone, "gone"), gone.count()), F.col("__row") == F.col("__gone"), "left_anti").select(*(F.col(f"`{c}`") for c in kept))
