"""Benchmark decontamination by SimHash of item-sized windows, as DataFrame expressions only.

Texts become hashes of WIDTH-word shingles. A window has as many shingles as an item; those that share no
shingle with any item of their size cannot be similar, so windows are formed around shared shingles, at
every start that covers one. A window's fingerprint is the SimHash of its shingles, each as often as it
occurs. Fingerprints are cut into BLOCKS blocks; within RADIUS bits at least one block differs by at most
RADIUS // BLOCKS bits, and all such values of each item's blocks are indexed, so the lookup finds every item
of the size within RADIUS. Found pairs are kept at an exact multiset Jaccard of SIMILARITY or more.

The item tables grow with the benchmark alone; they are broadcast while their count is at most
BROADCAST_ROWS, else joined by shuffle. Rows of documents are picked by their 8-byte row_id, broadcast up to
BROADCAST_IDS of them. The starts of windows are kept as ranges and windows are cut one by one, so a long item in
a long text needs no more memory than the text.

Cases: null and empty texts have no shingles and are clean; items of fewer than WIDTH words match nothing;
a text shorter than an item is one window of its own size. Equal rows get equal results. An empty benchmark
leaves all clean. Other columns are ignored by find and kept by keep_clean.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import SPACE, staged

WIDTH, SIMILARITY = 5, 0.8
BLOCKS, RADIUS = 8, 20
BITS = 64 // BLOCKS
SLIPS = RADIUS // BLOCKS
BROADCAST_ROWS, BROADCAST_IDS = 200_000, 1_000_000
_BIG = 1 << 32


def _shingled(df: DataFrame, *keep: str) -> DataFrame:
    """keep and g, the shingle hashes of text in order.

    Filters on g must not come next (nor inner generators, which imply one): pushed below, they would put
    the hashing of all words inside the function of each shingle.
    """
    gram = ", ".join(f"get(__h, i + {k})" for k in range(WIDTH))
    words = df.select(*keep, F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE, -1), "").alias("__w"))
    hashed = words.select(*keep, F.expr("transform(__w, w -> xxhash64(w))").alias("__h"))
    return hashed.select(*keep, F.expr(f"if(size(__h) < {WIDTH}, cast(array() as array<bigint>), transform(sequence(0, size(__h) - {WIDTH}), i -> xxhash64({gram})))").alias("g"))


def _lane(longest: int) -> int:
    """Bits per counter: counts stay below a quarter of its range."""
    return next(w for w in (8, 16, 32) if longest < 1 << (w - 2))


def _simhash(column: str, lane: int) -> str:
    """SQL: the SimHash of an array of hashes. Counters of every lane-th bit are added up in one long."""
    ones = sum(1 << (lane * j) for j in range(64 // lane))
    parts = []
    for k in range(lane):
        count = f"aggregate({column}, 0L, (a, x) -> a + (shiftrightunsigned(x, {k}) & {ones}L))"
        over = f"shiftrightunsigned({count} + ({(1 << (lane - 2)) - 1}L - size({column}) div 2) * {ones}L, {lane - 2}) & {ones}L"
        parts.append(f"shiftleft({over}, {k})")
    return "(" + " | ".join(f"({p})" for p in parts) + ")"


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(rid, item_id): documents, by row_id(), that hold a window similar to an item."""
    spark = docs.sparkSession
    items = staged(_shingled(benchmark.select("item_id", "text"), "item_id").withColumn("n", F.size("g")), "items").filter("n > 0")
    longest = items.agg(F.max("n")).first()[0]
    if not longest:
        return spark.createDataFrame([], "rid long, item_id long")
    lane = _lane(longest)
    known = items.select(F.explode("g").alias("x"), "n").distinct()
    n_known, n_items = known.count(), items.count()

    # where documents share a shingle with an item, and the size of that item
    rows = docs.select(row_id().alias("rid"), "text")
    places = _shingled(rows, "rid").select("rid", F.posexplode_outer("g").alias("p", "x"))
    shared = places.join(_sized(known, n_known), "x").select("rid", "p", "n")
    anchors = staged(shared.groupBy("rid").agg(F.collect_set(F.col("n") * F.lit(_BIG) + F.col("p")).alias("anchors")), "anchors")

    # all windows of the size that cover such a place: ranges of starts, then starts, then windows
    n_hit, n_anchors = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()
    some = rows if n_hit > BROADCAST_IDS else rows.join(F.broadcast(anchors.select("rid")), "rid", "left_semi")
    near = _shingled(some.join(_sized(anchors, n_hit + n_anchors), "rid"), "rid", "anchors").select("rid", "g", F.sort_array("anchors").alias("s"))
    cuts = f"filter(sequence(0, size(s)), i -> i = 0 or i = size(s) or s[i] - s[i - 1] > s[i] div {_BIG}L)"
    near = near.select("rid", "g", "s", F.expr(cuts).alias("cut"))
    least, most = f"greatest(0L, least(s[cut[j]] % {_BIG}L - n + 1, size(g) - n))", f"greatest(0L, least(s[cut[j + 1] - 1] % {_BIG}L, size(g) - n))"
    least, most = (x.replace(" n", " (s[cut[j]] div " + f"{_BIG}L)") for x in (least, most))
    ranges = near.select("rid", "g", F.expr(f"explode_outer(transform(sequence(0, size(cut) - 2), j -> struct(cast(s[cut[j]] div {_BIG}L as int) as n, cast({least} as int) as low, cast({most} as int) as high)))").alias("r"))
    starts = ranges.select("rid", "g", "r.n", F.expr("explode_outer(sequence(r.low, r.high))").alias("start"))
    windows = starts.select("rid", "n", F.expr("slice(g, start + 1, n)").alias("w")).withColumn("print", F.expr(_simhash("w", lane)))
    mask = (1 << BITS) - 1
    probes = windows.select("rid", "n", "w", "print", F.posexplode_outer(F.array(*(F.shiftrightunsigned("print", BITS * b).bitwiseAND(F.lit(mask)) for b in range(BLOCKS)))).alias("block", "value"))

    # the items' blocks with up to SLIPS bits changed
    flips = [sum(1 << b for b in c) for k in range(SLIPS + 1) for c in combinations(range(BITS), k)]
    prints = items.select("item_id", "n", F.expr(_simhash("g", lane)).alias("item_print"))
    index = prints.select("item_id", "n", "item_print", F.posexplode_outer(F.array(*(F.shiftrightunsigned("item_print", BITS * b).bitwiseAND(F.lit(mask)) for b in range(BLOCKS)))).alias("block", "own"))
    index = index.select("item_id", "n", "item_print", "block", F.explode(F.array(*(F.col("own").bitwiseXOR(F.lit(f).cast("long")) for f in flips))).alias("value"))
    met = probes.join(_sized(index, n_items * BLOCKS * len(flips)), ["n", "block", "value"])
    differ = "(print ^ item_print)"
    earlier = f"block > 0 and exists(sequence(0, greatest(block - 1, 0)), k -> bit_count(shiftrightunsigned({differ}, {BITS} * k) & {mask}L) <= {SLIPS})"
    near_items = met.filter(f"bit_count({differ}) <= {RADIUS} and not ({earlier})").select("rid", "w", "item_id")
    full = near_items.join(_sized(items.select("item_id", "g"), n_items), "item_id")
    many = "aggregate(array_distinct(w), 0, (m, x) -> m + least(size(filter(w, y -> y = x)), size(filter(g, y -> y = x))))"
    both = f"if(size(array_distinct(w)) = size(w) or size(array_distinct(g)) = size(g), size(array_intersect(w, g)), {many})"
    similar = full.select("rid", "item_id", F.expr(both).alias("both"), (F.size("w") + F.size("g")).alias("sum"))
    return similar.filter(f"both >= {SIMILARITY} * (sum - both)").select("rid", "item_id").distinct()


def row_id():
    """The same for rows of equal doc_id and text."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return staged(hits(docs, benchmark).groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "hits")


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items: the ids of the items found, ascending, comma-joined; all documents."""
    found = _found(docs, benchmark)
    ids = docs.select("doc_id", row_id().alias("rid"))
    joined = ids.join(_sized(found, 20 * found.count()), "rid", "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without such a window, with their columns."""
    found = _found(docs, benchmark).select(F.col("rid").alias("__rid"))
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, row_id() == F.col("__rid"), "left_anti")
