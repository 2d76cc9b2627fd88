r"""Substring deduplication by unit hashes: of each repeated unit the earliest occurrence stays.

A unit is a line, or a sentence of a line (it ends after a word that ends in . ! or ?). Normalised, it is
its words in ASCII lower case with one space between. All digests are grouped over the corpus; occurrences
rank by doc_id, then place. Later occurrences are repeats; a digest and an independent check, 128 bits together,
must agree with the first's. Neighbouring repeats join into runs, and a run of at least min_words words is
removed: at 1 every repeat, at MIN_WORDS a stray short line or sentence that others also use stays. Spans keep
the code-point offsets of the original text, the end exclusive.

Cases: null, empty and wordless texts have no units. Rows with a null doc_id have no rank: they are neither
changed nor counted. An empty table gives an empty result; a long text is cut into its units like any other.
Rows of equal doc_id and text are one occurrence and are cut alike; different texts of
one doc_id rank by a hash of the text. Other columns are ignored by find and kept by cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm import common
from boxwright.llm.common import lookup, mix64, slices, staged, text_buffers, tidy, word_spans

MIN_WORDS = 20
#: So many spans may be broadcast to cut them out (about 16 bytes each); more meet their texts by shuffle.
BROADCAST_SPANS = 1_000_000
UNITS = "digest long, check long, doc_id long, place long, start int, end int, n_words int"
_ENDS = np.zeros(256, bool)
_ENDS[[0x21, 0x2E, 0x3F]] = True
_U = np.uint64


def _folded(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair of bounds."""
    up, down = common._powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def _checked(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another hash of values[start:end] for each pair of bounds, none of them empty: no polynomial of the values."""
    n = ends - starts
    first = np.cumsum(n) - n
    place = np.arange(n.sum(), dtype=np.int64) - np.repeat(first, n)
    return mix64(np.add.reduceat(mix64(values[np.repeat(starts, n) + place] + place.astype(_U) * _U(0xD6E8FEB86659FD93)), first))


def units(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of all texts: text number, digest, check, place, start and end (code points), number of words of each unit."""
    raw, at = text_buffers(column)
    starts, ends, before = word_spans(raw, at)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    words = _folded(common._BYTE[common.LOWER[raw]], starts, ends)
    lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    text = np.repeat(np.arange(len(at) - 1), np.diff(before))
    last = np.ones(len(starts), bool)
    last[:-1] = _ENDS[raw[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]]) | (text[1:] != text[:-1])
    stop = np.flatnonzero(last) + 1
    first = np.concatenate([[0], stop[:-1]])
    of = text[first]
    whole = _folded(mix64(words), before[:-1], before[1:])
    number = np.arange(len(first)) - np.searchsorted(of, of)
    place = ((whole[of] >> _U(33)).astype(np.int64) << 32) | number
    base = points[at[of]]
    check = _checked(_checked(common.LOWER[raw].astype(_U), starts, ends), first, stop)
    return of, _folded(words, first, stop).view(np.int64), check.view(np.int64), place, points[starts[first]] - base, points[ends[stop - 1]] - base, stop - first


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            of, digest, check, place, start, end, n = units(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(check), batch.column("doc_id").take(pa.array(of)), pa.array(place), *(pa.array(x.astype(np.int32)) for x in (start, end, n))], ["digest", "check", "doc_id", "place", "start", "end", "n_words"])


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, start, end, n_units): the spans to remove; version tells texts of one doc_id apart."""
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = staged(ids.mapInArrow(tidy(_units), UNITS), "units")
    met = every.groupBy("digest").agg(F.min(F.struct("doc_id", "place", "check")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = lookup(every, met, "digest", "n", every.count(), "inner")
    later = found.filter("check = first.check and (doc_id <> first.doc_id or place <> first.place)").select("doc_id", "place", "start", "end", "n_words").distinct()
    numbered = later.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy("doc_id").orderBy("place")))
    grouped = numbered.groupBy("doc_id", "run").agg(F.min("place").alias("place"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n"), F.count("*").alias("n_units"))
    return grouped.filter(F.col("n") >= min_words).select("doc_id", F.shiftright("place", 32).alias("version"), "start", "end", "n_units")


def find(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_spans, n_units, removed_chars and spans (start:end, comma-joined) for each doc_id."""
    found = runs(docs, min_words).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"), F.sum("n_units").alias("n_units"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return ids.join(staged(found, "runs"), "doc_id", "left").select("doc_id", n(F.when(F.col("s").isNotNull(), F.size("s"))).alias("n_spans"), n(F.col("n_units")).alias("n_units"), n(F.expr("aggregate(s, 0L, (a, x) -> a + x.end - x.start)")).alias("removed_chars"), F.coalesce(F.expr("array_join(transform(s, x -> concat(x.start, ':', x.end)), ',')"), F.lit("")).alias("spans"))


def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with __version, as runs() has it."""
    for batch in batches:
        raw, at = text_buffers(batch.column("text"))
        starts, ends, before = word_spans(raw, at)
        words = _folded(common._BYTE[common.LOWER[raw]], starts, ends) if len(starts) else np.zeros(0, _U)
        whole = _folded(mix64(words), before[:-1], before[1:])
        yield batch.append_column("__version", pa.array((whole >> _U(33)).astype(np.int64)))


def cut(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeats taken out of text."""
    kept = docs.columns
    spans = runs(docs, min_words).groupBy(F.col("doc_id").alias("__doc"), F.col("version").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    spans = staged(spans, "spans")
    n_spans = spans.agg(F.coalesce(F.sum(F.size("__spans")), F.lit(0))).first()[0]
    met = docs.mapInArrow(tidy(versions), f"{schema}, __version long").join(F.broadcast(spans) if n_spans <= BROADCAST_SPANS else spans, (F.col("doc_id") == F.col("__doc")) & (F.col("__version") == F.col("__of")), "left")
    # what lies between the spans, in order
    pieces = "concat(transform(__spans, (x, i) -> struct(if(i = 0, 0, get(__spans, i - 1).end) as a, x.start as b)), array(struct(element_at(__spans, -1).end as a, length(text) as b)))"
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.expr(f"array_join(transform({pieces}, p -> substring(text, p.a + 1, p.b - p.a)), '')"))
    return met.withColumn("text", text).select(*kept)
