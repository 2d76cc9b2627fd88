"""Token ids in binary shards: one zstandard dictionary for all, one frame for each document.

A shard holds documents in ascending doc_id order, null first (equal ids by text). Layout, little-endian:
8 bytes magic, 32 bytes SHA-256 of the dictionary (zeros without one), the frames, then an index of one
record for each document (doc_id, whether it is null, frame offset and length, number of ids), then the
index's offset and the number of documents as two u64. Ids are u16 where the vocabulary allows, u32 else. A reader
fetches the index and one frame for one document.

The dictionary is trained on SAMPLES pieces of texts, drawn from all documents and places: texts are thought
of as pieces of SAMPLE_CHARS code points, and those of the smallest hash of (doc_id, place) are taken. All
documents are encoded and written whole. A shard is written under a name of its own and renamed, so a task
that is tried again leaves the same file. Tasks are dealt by ranges of doc_id, so many that each has about
TASK_BYTES of text.

Cases: null and empty texts have just the end id. Without documents there is no shard. Rows of one doc_id are
written each, in the order of a hash of the text, then the text; equal rows are interchangeable. A long text is
one frame. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import least_hashes, staged, tidy, work_dir

MAGIC = b"BWTOKENS"
SAMPLES, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 16_384, 64 << 10
SHARD_BYTES, TASK_BYTES, LEVEL = 4 << 20, 64 << 20, 3
INDEX = np.dtype([("doc", "<i8"), ("null", "u1"), ("at", "<u8"), ("size", "<u4"), ("n", "<u8")])
SHARDS = "part int, seq int, path string, n_docs long, start long, n_ids long"
READ = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


# ---------------------------------------------------------------- encoding

_ENCODERS: dict[tuple[str, bool], object] = {}


def rank_file(tokenizer_json: str) -> tuple[dict[bytes, int], str]:
    """The ranks of a byte-level BPE file: its vocabulary with the byte alphabet undone."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in seen)}
    byte = {c: b for b, c in char.items()}
    added = {t["content"] for t in json.loads(tokenizer_json)["added_tokens"]}
    vocab = json.loads(tokenizer_json)["model"]["vocab"]
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}, r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(tokenizer_json: str, added: bool = False):
    """text -> ids. added: texts are split at the file's added tokens, as the tokenizers library does by default;
    else those are text like any other (the library with encode_special_tokens).

    A byte-level BPE whose vocabulary is in merge order is run by the faster tiktoken, but a text that holds an
    added token by the tokenizers library; test_token_shards and test_added_tokens hold both against the library.
    Any other file is run by the tokenizers library itself.
    """
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest(), added
    if key not in _ENCODERS:
        spec = json.loads(tokenizer_json)
        plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}) .get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and spec["model"]["type"] == "BPE"

        @functools.cache
        def library():
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(tokenizer_json)
            t.encode_special_tokens = not added
            return t

        whole = lambda text: library().encode(text, add_special_tokens=False).ids
        if plain:
            import tiktoken

            ranks, pattern = rank_file(tokenizer_json)
            fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            marks = [t["content"] for t in spec["added_tokens"]] if added else []
            _ENCODERS[key] = (lambda text: whole(text) if any(m in text for m in marks) else fast(text)) if marks else fast
        else:
            _ENCODERS[key] = whole
    return _ENCODERS[key]


def vocabulary(tokenizer_json: str) -> int:
    spec = json.loads(tokenizer_json)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1


# ---------------------------------------------------------------- one shard


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or none where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(raw: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


class ShardWriter:
    def __init__(self, dictionary: bytes, width: int):
        self.head = MAGIC[:7] + bytes([width]) + (hashlib.sha256(dictionary).digest() if dictionary else bytes(32))
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, **_dictionary(dictionary)).compress
        self.kind = f"<u{width}"
        self.clear()

    def clear(self) -> None:
        self.frames, self.size, self.index = [], len(self.head), []

    def add(self, doc: int | None, ids: list[int]) -> None:
        frame = self.squeeze(np.asarray(ids, self.kind).tobytes())
        self.index.append((doc or 0, doc is None, self.size, len(frame), len(ids)))
        self.frames.append(frame)
        self.size += len(frame)

    def bytes(self) -> bytes:
        return b"".join([self.head, *self.frames, np.array(self.index, INDEX).tobytes(), struct.pack("<QQ", self.size, len(self.index))])


class Shard:
    """A shard's documents: index first, then any frame alone."""

    def __init__(self, file, dictionary: bytes):
        self.file, size = file, file.size()
        at, n = struct.unpack("<QQ", file.read_at(16, size - 16))
        head = file.read_at(40, 0)
        if head[:7] != MAGIC[:7] or head[8:] != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError("not a shard of this dictionary")
        self.kind = f"<u{head[7]}"
        self.index = np.frombuffer(file.read_at(n * INDEX.itemsize, at), INDEX)
        self.expand = zstandard.ZstdDecompressor(**_dictionary(dictionary)).decompress

    def ids(self, row: int) -> np.ndarray:
        entry = self.index[row]
        return np.frombuffer(self.expand(self.file.read_at(int(entry["size"]), int(entry["at"]))), self.kind)


# ---------------------------------------------------------------- all documents


def write(docs: DataFrame, tokenizer_path: str, end_id: int, to: str | None = None, added: bool = False) -> tuple[DataFrame, bytes, str]:
    """Write all documents; the table of shards (start: ids before it in its part), the dictionary and the folder.

    to: a folder that executors share, as a URI; in the session's shared folder by default. It gets the
    shards, dictionary.zstd and, from finish(), manifest.json. added: as encoder() has it.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    to = to or work_dir(spark, "tokens")
    width = 2 if max(vocabulary(spec.value), end_id + 1) <= 1 << 16 else 4
    places = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.expr(f"int((greatest(1, length(text)) - 1) div {SAMPLE_CHARS})"))).alias("place"))
    picked = least_hashes(places, ["doc_id", "place"], SAMPLES, [F.expr(f"substring(text, place * {SAMPLE_CHARS} + 1, {SAMPLE_CHARS})").alias("text")])
    encode = encoder(spec.value, added)
    dictionary = train_dictionary([np.asarray([*encode(r.text or ""), end_id], f"<u{width}").tobytes() for r in picked])
    files, base = pyarrow.fs.FileSystem.from_uri(to)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/dictionary.zstd") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, done = TaskContext.get().partitionId(), 0, 0
        encode, writer = encoder(spec.value, added), ShardWriter(shared.value, width)
        files, base = pyarrow.fs.FileSystem.from_uri(to)

        def flush() -> pa.RecordBatch:
            nonlocal seq, done
            name, n = f"{base}/part-{part:06d}-{seq:06d}.tok", sum(x[4] for x in writer.index)
            own = f"{base}/.{uuid.uuid4().hex}"
            with files.open_output_stream(own) as f:
                f.write(writer.bytes())
            files.move(own, name)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": os.path.basename(name), "n_docs": len(writer.index), "start": done, "n_ids": n}], schema=out)
            seq, done = seq + 1, done + n
            writer.clear()
            return row

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                writer.add(doc, [*encode(text.as_py() or ""), end_id])
                if writer.size >= SHARD_BYTES:
                    yield flush()
        if writer.index:
            yield flush()

    out = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64())])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    # the hash and the text break ties, so that equal ids come in one order whoever sorts them, and may fall to several tasks
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(n, F.asc_nulls_first("doc_id"), "hash", "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash", "text")
    return staged(ordered.select("doc_id", "text").mapInArrow(tidy(run), SHARDS), "shards"), dictionary, to


def finish(shards: DataFrame, dictionary: bytes, to: str) -> dict[int, int]:
    """Ids before each part (one figure for each part of the job), also written to manifest.json."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for r in totals:
        before[r.part], at = at, at + r.n
    files, base = pyarrow.fs.FileSystem.from_uri(to)
    with files.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "ids": at, "start_of_part": before}).encode())
    return before


def read(shards: DataFrame, dictionary: bytes, to: str, before: dict[int, int]) -> DataFrame:
    """Every document of the shards: where its ids start among all, their number and their checksum."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast((dictionary, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, starts = shared.value
        files, base = pyarrow.fs.FileSystem.from_uri(to)
        for batch in batches:
            for r in batch.to_pylist():
                with files.open_input_file(f"{base}/{r['path']}") as f:
                    held = pa.BufferReader(f.read())
                shard = Shard(held, raw)
                n = shard.index["n"].astype(np.int64)
                start = starts[r["part"]] + r["start"] + np.cumsum(n) - n
                crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), r["part"], np.int32)), pa.array(shard.index["doc"], mask=shard.index["null"].astype(bool)), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards.count() * SHARD_BYTES // TASK_BYTES)
    return shards.select("part", "start", "path").repartition(n, "path").mapInArrow(tidy(run), READ).drop("part")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int, added: bool = False) -> DataFrame:
    shards, dictionary, to = write(docs, tokenizer_path, end_id, added=added)
    return read(shards, dictionary, to, finish(shards, dictionary, to))
