"""SentencePiece BPE encoding by a table of last tokens, and decoding.

For every prefix of a text, BPE leaves exactly one last token. An automaton lists the tokens that end at a
position; the one that is compatible with the last token of the prefix before it is the last token there.
Walking back from the end of the text through the table gives all ids. The table has a row for each unit:
a run of marks and the characters up to the next mark or line end, as no piece crosses those borders. Pieces of
several marks all have one score, the lowest, so they are merged last: the table serves the last mark and what
follows it, and the marks before it are merged among themselves. A model that is not like this (another
normaliser, user-defined pieces, marks within pieces) raises a ValueError.

Cases: null and empty texts have no ids and decode to an empty text. Code points outside the vocabulary
become byte pieces. Control pieces in a text are ordinary characters. Rows with equal texts or ids are
encoded alike, an empty table gives an empty result, and a long text costs linear time and one row's memory.
Other columns of the input are ignored by encode_digests and kept by encode.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from boxwright.llm.common import tidy

MARK = "▁"
#: Bytes, about, of encoded units that a Python worker keeps within a task; beyond it the older half goes.
KEEP_BYTES = 96 << 20
#: What a unit takes there beside its characters and ids.
UNIT_BYTES = 240
#: Tested pairs of tokens that it keeps.
KEEP_PAIRS = 300_000
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    def __init__(self, model: bytes, keep: int = KEEP_BYTES):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        _expect(model)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.score = [sp.get_score(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.surface = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.surface[self.unknown] = " ⁇ ".encode()
        self.is_byte = [sp.is_byte(i) for i in range(size)]
        self.is_control = [sp.is_control(i) for i in range(size)]
        self.text_of_id = [str(i) for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.marks = [p for p in self.ids if len(p) > 1 and not p.strip(MARK)]
        if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) or "\n" in p and len(p) > 1 for p in self.ids):
            raise ValueError("a piece crosses a unit's border")
        if self.marks and max(self.score[self.ids[p]] for p in self.marks) >= min((self.score[i] for p, i in self.ids.items() if p[0] == MARK != p and p.strip(MARK)), default=0):
            raise ValueError("marks are merged before words")
        self.units = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.fits: dict[int, bool] = {}  # by first id * 2**32 + second id
        self.whole: dict[int, bool] = {}
        self.ends: dict[int, tuple] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.keep, self.held = keep // 2, 0

    def merge(self, text: str) -> list[str]:
        """The merges themselves, best score first and leftmost among equals: the definition."""
        left, right = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        part: list[str | None] = list(text)
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, part[a] + part[b]))

        for a in range(len(text) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if part[a] is None or part[b] is None or right[a] != b or part[a] + part[b] != joined:
                continue
            part[a], part[b] = joined, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p is not None]

    def edges(self, token: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """What stands at the left and right end of a token while it is merged, and the rank of the merge
        that takes it away. Rank: the score's negative, so merges come in ascending rank."""
        found = self.ends.get(token)
        if found is None:
            part, left, right = list(self.pieces[token]), [], []
            while len(part) > 1:
                rank, at = min(((-self.score[i], k) for k in range(len(part) - 1) if (i := self.ids.get(part[k] + part[k + 1])) is not None), default=(0.0, -1))
                if at < 0:
                    break
                if at == 0:
                    left.append((part[0], rank))
                if at == len(part) - 2:
                    right.append((part[-1], rank))
                part[at : at + 2] = [part[at] + part[at + 1]]
            found = self.ends[token] = ([*left, (part[0], float("inf"))], [*right, (part[-1], float("inf"))])
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b as they are when b follows a: no pair that meets at their border is
        merged before one of the two goes into its own token. Among equal ranks the left merge comes first."""
        xs, ys = self.edges(a)[1], self.edges(b)[0]
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = xs[i], ys[j]
            joined = self.ids.get(x + y)
            if joined is not None and -self.score[joined] < until_x and -self.score[joined] <= until_y:
                return False
            if until_x <= until_y:
                if until_x == float("inf"):
                    return self.alone(a) and self.alone(b)
                i += 1
            else:
                j += 1

    def alone(self, a: int) -> bool:
        found = self.whole.get(a)
        if found is None:
            found = self.whole[a] = self.merge(self.pieces[a]) == [self.pieces[a]]
        return found

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        """The ids of one unit."""
        marks = len(unit) - len(unit.lstrip(MARK))
        if marks < 2:
            return self._by_table(unit)
        rest = self._by_table(unit[marks - 1 :])
        if rest[0] == self.ids.get(MARK):  # the last mark is not part of a word
            rest, marks = rest[1:], marks + 1
        return tuple(chain.from_iterable(self._spell(p) for p in self.merge(MARK * (marks - 1)))) + rest

    def _by_table(self, unit: str) -> tuple[int, ...]:
        n = len(unit)
        last = [-1] * (n + 1)  # -1: a code point outside the vocabulary
        size = [1] * (n + 1)
        fits = self.fits
        for at, (length, token) in self.automaton.iter(unit):
            at += 1
            if last[at] < 0:  # one token at most is compatible
                before = last[at - length] if at > length else -1
                if before < 0:
                    good = self.alone(token)
                else:
                    good = fits.get(pair := before << 32 | token)
                    if good is None:
                        if len(fits) >= KEEP_PAIRS:
                            fits.clear()
                        good = fits[pair] = self.compatible(before, token)
                if good:
                    last[at], size[at] = token, length
        back = []
        while n:
            token = last[n]
            if token < 0:
                back += self._spell(unit[n - 1])[::-1]
            else:
                back.append(token)
            n -= size[n]
        return tuple(back[::-1])

    def _spell(self, piece: str) -> tuple[int, ...]:
        if (i := self.ids.get(piece)) is not None:
            return (i,)
        return tuple(self.bytes.get(b, self.unknown) for b in piece.encode()) if self.bytes else (self.unknown,)

    def _fresh(self, unit: str) -> tuple[int, ...]:
        found = self.young.get(unit) or self.old.get(unit) or self.encode_unit(unit)
        if len(unit) <= 64:
            if self.held >= self.keep:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[unit] = found
            self.held += UNIT_BYTES + 2 * len(unit) + 8 * len(found)
        return found

    def forget(self) -> None:
        """Drop the encoded units."""
        self.young, self.old, self.held = {}, {}, 0

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        units = self.units.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.young.get, units))
        if None in found:
            fresh = self._fresh
            found = [fresh(u) if x is None else x for u, x in zip(units, found, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_slowly(ids)
        first = next((i for i in ids if not self.is_control[i]), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text

    def _decode_slowly(self, ids: list[int]) -> str:
        """Each byte that doesn't belong to a valid sequence becomes one replacement character."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + width]).decode())
                        at += width
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)


_LOADED: dict[str, PieceCodec] = {}


def _expect(model: bytes) -> None:
    """Raise where the model asks for what this codec does not do."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    n, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
    piece = sentencepiece_model_pb2.ModelProto.SentencePiece
    if spec.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix or kinds & {piece.USER_DEFINED, piece.UNUSED}:
        raise ValueError("not a plain merge model with a dummy prefix")


def forget_units() -> None:
    for c in _LOADED.values():
        c.forget()


def codec(model: bytes) -> PieceCodec:
    """One codec for each model and Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = PieceCodec(model)
    return _LOADED[key]


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the text decoded from them."""
    model = _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        sha, name = hashlib.sha256, c.text_of_id.__getitem__
        for batch in batches:
            n, digests, decoded = [], [], []
            for text in batch.column("text"):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                digests.append(sha(",".join(map(name, ids)).encode()).hexdigest())
                decoded.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run, forget_units), DIGESTS)


def encode(docs: DataFrame, model_path: str, ids: str = "piece_ids", decoded: str = "piece_text") -> DataFrame:
    """docs with two more columns: the ids of the text and the text decoded from them.

    A column of either name in docs is replaced.
    """
    model = _model(docs, model_path)
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for batch in batches:
            found = [c.encode(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(found, pa.list_(pa.int32())), pa.array([c.decode(x) for x in found], pa.string())], [*kept, ids, decoded])

    return docs.select(*kept).mapInArrow(tidy(run, forget_units), schema)
