"""Language-model scores: a unigram base over words and a causal self-attention model over subword ids.

Training documents are those whose crc32(doc_id as text) mod HOLD is not HELD (a null doc_id counts as an
empty text there). All text is taken in ASCII lower case.

Base. Word and end counts cover all training documents. The HEAD most frequent words go to the workers as
one table of fixed size; other words of a document meet their counts in a join, in which no word is
frequent. Words are told apart by 64-bit hashes.

Model. Subword ids (a public byte-level vocabulary) fall into CLASSES classes: the most frequent ids have a
class of their own, others share one. P(id) = P(group | context) P(class | group, context) P(id | class).
Counts of ids, and of the followers of the COMPANY most frequent ids, by which ids fall into classes and
classes into groups, cover all training documents. Within a class, P(id | class) is by frequency alone. The network is one causal attention layer of width WIDTH over
class embeddings, trained in numpy: it starts from WARM_DOCS training documents (smallest hash of doc_id),
then every task trains it further on all windows of its training documents, and the tasks' weights are
averaged by the number of windows. A text is scored in windows of STEP new
positions after STEP of context: windows overlap, each id is scored once, with batched masked attention.
The score is the log10 probability of the ids and one end.

Cases: null and empty texts have the end alone. Without training documents all counts are 0 and the network
is untrained. Equal rows are scored alike and all returned; other columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import least_hashes, lowered, mix64, slices, staged, text_buffers, word_hashes, word_spans
from boxwright.llm.token_shards import encoder, vocabulary

HOLD, HELD = 5, 1
HEAD = 200_000
KEEP_WORDS = 1_000_000
GROUPS = EACH = 32
CLASSES, SHARED = GROUPS * EACH, 128
#: Ids whose followers tell classes apart; with the vocabulary it bounds a table on the driver.
COMPANY = 128
WIDTH, STEP = 16, 16
WARM_DOCS, WARM_ROUNDS = 1500, 3
GAPS = (1, 2, 3, 5, 8)
#: Ids in one row of the follower counts.
MET_IDS = 1024
BATCH = 128
#: Windows that are scored at once: what they need stays in a processor's cache.
SCORED = 512
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc: Column) -> Column:
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % HOLD == HELD


def _held(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % HOLD == HELD for x in ids.to_pylist()], bool)


# ---------------------------------------------------------------- words


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")
#: Bytes of a word that are hashed eight at a time; longer words take the hash that costs the same for any length.
LONG = 64


def _hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes: a 64-bit hash of each word, and the number of words before each text."""
    starts, ends, before = word_spans(raw, at)
    size = ends - starts
    # eight bytes from every place on; those behind a word are masked
    eight = np.lib.stride_tricks.as_strided(np.concatenate([raw, np.zeros(8, np.uint8)])[:8].view("<u8"), (len(raw) + 1,), (1,))
    out = mix64((eight[starts] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    some = np.flatnonzero((size > 8) & (size <= LONG))
    for k in range(8, LONG, 8):
        left = size[some] - k
        out[some] = mix64((out[some] + (eight[starts[some] + k] & _MASKS[np.minimum(left, 8)])) * np.uint64(0xD1B54A32D192ED03))
        some = some[left > 8]
    if (size > LONG).any():
        out = np.where(size > LONG, word_hashes(raw, at)[0], out)
    return out, before


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h)))


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    h, train, every = (np.concatenate(x) for x in zip(*parts, strict=True))
    unique, at = np.unique(h, return_inverse=True)
    return unique, np.bincount(at, train, len(unique)).astype(np.int64), np.bincount(at, every, len(unique)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, train, total) of the words of a task, merged as long as they are KEEP_WORDS at most."""
    parts: list[tuple[np.ndarray, ...]] = []
    out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], ["h", "train", "total"])
    for whole in batches:
        for batch in slices(whole, "text"):
            h, before = _hashes(*text_buffers(lowered(batch.column("text"))))
            train = np.repeat(~_held(batch.column("doc_id")), np.diff(before))
            learnt, others = _counted(h[train]), _counted(h[~train])
            parts += [(*learnt, learnt[1]), (others[0], np.zeros_like(others[1]), others[1])]
            if len(parts) >= 16:
                parts = [_merged(parts)]
                if len(parts[0][0]) > KEEP_WORDS:
                    yield out(parts.pop())
    if parts:
        yield out(_merged(parts))


def _buckets(known: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """By how much a hash is shifted to its leading bits, and where each bucket of these starts in known (ascending)."""
    shift = np.uint64(64 - max(int(len(known)).bit_length(), 1))
    return shift, np.searchsorted(known, np.arange(1 << int(64 - shift), dtype=np.uint64) << shift)


def _places(known: np.ndarray, h: np.ndarray, buckets: tuple[np.uint64, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands in known (ascending), and whether it does; by the bucket of its leading bits."""
    shift, starts = buckets or _buckets(known)
    at = starts[h >> shift]
    todo = np.flatnonzero(at < len(known))
    while len(todo):  # a bucket holds few
        todo = todo[known[at[todo]] < h[todo]]
        at[todo] += 1
        todo = todo[at[todo] < len(known)]
    at = np.minimum(at, max(len(known) - 1, 0))
    return at, known[at] == h if len(known) else np.zeros(len(h), bool)


def _words(batches: Iterator[pa.RecordBatch], head: tuple[np.ndarray, np.ndarray], end: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (h null) with what the head and the end give, and one for each other word."""
    known, counts = head
    buckets = _buckets(known)
    for whole in batches:
        for batch in slices(whole, "text"):
            h, before = _hashes(*text_buffers(lowered(batch.column("text"))))
            n, docs = np.diff(before), batch.num_rows
            doc = np.repeat(np.arange(docs), n)
            at, hit = _places(known, h, buckets)
            c = counts[at[hit]] if len(known) else np.zeros(0)
            logs = np.bincount(doc[hit], np.log10(c + 0.5), docs) + np.log10(end + 0.5)
            seen = np.bincount(doc[hit], c > 0, docs).astype(np.int64) + (end > 0)
            d, w = doc[~hit], h[~hit]
            order = np.lexsort((w, d))
            d, w = d[order], w[order]
            new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])) if len(w) else np.zeros(0, np.int64)
            k = np.diff(np.append(new, len(w)))
            ids, rid = batch.column("doc_id"), batch.column("rid")
            rows = np.concatenate([np.arange(docs), d[new]])
            some = np.concatenate([np.zeros(docs, bool), np.ones(len(new), bool)])
            pad = lambda x: pa.array(np.concatenate([x, np.zeros(len(new), x.dtype)]), mask=some)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), rid.take(take), pa.array(np.concatenate([np.zeros(docs, np.int64), w[new].view(np.int64)]), mask=~some), pa.array(np.concatenate([np.zeros(docs, np.int64), k])), pad((n + 1).astype(np.int64)), pad(seen), pad(logs)],
                ["doc_id", "rid", "h", "k", "n_tokens", "known", "logs"],
            )


# ---------------------------------------------------------------- the network


def company(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The column of each id in the table of followers, and the number of columns: the last is for all but the most frequent ids."""
    near = min(COMPANY, len(counts))
    column = np.full(len(counts), near, np.int64)
    column[np.argsort(-counts, kind="stable")[:near]] = np.arange(near)
    return column, near + 1


def followers(met: np.ndarray, column: np.ndarray, wide: int, flat: np.ndarray, lengths: np.ndarray) -> None:
    """Add to met how often an id follows each column, by GAPS, in texts laid end to end."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    row, near = flat * wide, column.take(flat)
    for gap in GAPS:
        cell = row[gap:] + near[:-gap]
        np.add.at(met, cell[doc[gap:] == doc[:-gap]], 1)


class Classes:
    """Which class each id has, and its log10 probability within it. met: the followers of all texts; those of sample by default."""

    def __init__(self, counts: np.ndarray, sample: list[np.ndarray], met: np.ndarray | None = None):
        size = len(counts)
        order = np.argsort(-counts, kind="stable")
        own = min(CLASSES - SHARED, size)
        column, wide = company(counts)
        if met is None:
            met = np.zeros(size * wide, np.int64)
            for ids in sample:
                followers(met, column, wide, ids, np.array([len(ids)]))
        # a coordinate of the company that an id keeps
        share = met.astype(np.float32).reshape(size, wide)
        seen = share.sum(axis=1)
        share /= np.maximum(seen, 1)[:, None]
        np.sqrt(share, out=share)
        centre = share[order[:own]].mean(axis=0)
        axes = np.linalg.svd(share[order[:own]] - centre, full_matrices=False)[2][:2] if own > 2 else np.zeros((2, wide))
        x = share @ axes.T - centre @ axes.T
        rest = order[own:]
        rest = rest[np.lexsort((x[rest, 0], seen[rest] < 5))]
        mass = np.cumsum(counts[rest] + 0.5)
        label = np.empty(size, np.int64)
        label[order[:own]] = np.arange(own)
        label[rest] = own + np.minimum(SHARED - 1, (mass * SHARED / (mass[-1] if len(mass) else 1)).astype(np.int64))
        # classes in groups of alike company
        at = np.array([np.average(x[label == c], axis=0, weights=counts[label == c] + 0.5) if (label == c).any() else np.zeros(2) for c in range(CLASSES)])
        spot = np.empty(CLASSES, np.int64)
        rough = np.argsort(at[:, 0], kind="stable").reshape(8, -1)
        spot[np.concatenate([r[np.argsort(at[r, 1], kind="stable")] for r in rough])] = np.arange(CLASSES)
        self.of = spot[label].astype(np.int16)
        total = np.bincount(self.of, counts + 0.5, CLASSES)
        self.within = np.log10((counts + 0.5) / total[self.of])


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda *s: (r.standard_normal(s) * 0.25).astype(np.float32)
    zero = lambda *s: np.zeros(s, np.float32)
    return {"e": g(CLASSES, WIDTH), "wq": g(WIDTH, WIDTH), "wk": g(WIDTH, WIDTH), "wv": g(WIDTH, WIDTH), "near": zero(2 * STEP), "wx": g(WIDTH, WIDTH), "wo": g(WIDTH, WIDTH), "b": zero(WIDTH), "w1": g(WIDTH, GROUPS), "b1": zero(GROUPS), "w2": g(GROUPS, WIDTH, EACH), "b2": zero(GROUPS, EACH)}


_GAP = (np.arange(STEP)[:, None] + STEP) - np.arange(2 * STEP)[None, :]  # how far key j lies behind query t
_CAUSAL = _GAP >= 0
_LAGS = np.maximum(_GAP, 0)
_ONES, _KEYS = np.ones(EACH, np.float32), np.ones(2 * STEP, np.float32)
#: Exponentials of figures up to this one need no shift, in sums of float32.
LARGEST = 60.0


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: the key positions of each window, which are real, and which queries are."""
    blocks = -(-lengths // STEP)
    doc = np.repeat(np.arange(len(lengths)), blocks)
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    own = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = (own * STEP)[:, None] + np.arange(-STEP, STEP)[None, :]
    real = (at >= 0) & (at < lengths[doc][:, None])
    return np.where(real, at + start[doc][:, None], 0), real, real[:, STEP:]


def _joined(p: dict) -> np.ndarray:
    """For each group the weights of all groups and of its own classes, side by side; the last row has the biases."""
    w = np.empty((GROUPS, WIDTH + 1, GROUPS + EACH), p["w1"].dtype)
    w[:, :WIDTH, :GROUPS], w[:, WIDTH, :GROUPS] = p["w1"], p["b1"]
    w[:, :WIDTH, GROUPS:], w[:, WIDTH, GROUPS:] = p["w2"], p["b2"]
    return w


def _by_group(asked: np.ndarray, target: np.ndarray, h: np.ndarray, w: np.ndarray):
    """The asked positions in order of their targets' groups: that order, the positions, their states (with a one for
    the biases), the groups that occur with their slices, the logits by w, and where those of the targets stand."""
    group = target // EACH
    order = np.argsort(group.astype(np.uint8), kind="stable")
    group, on = group.take(order), np.flatnonzero(asked.ravel()).take(order)
    cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    full = [(c, i, j) for c, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    ha = np.ones((len(on), WIDTH + 1), h.dtype)
    ha[:, :WIDTH] = h.reshape(-1, WIDTH).take(on, 0)
    z = np.empty((len(on), GROUPS + EACH), h.dtype)
    for c, i, j in full:
        np.dot(ha[i:j], w[c], out=z[i:j])
    at = np.empty((len(on), 2), np.int64)
    at[:, 0], at[:, 1] = group, target.take(order) % EACH + GROUPS
    at += np.arange(0, z.size, GROUPS + EACH)[:, None]
    return order, on, ha, full, z, at.ravel()


def _heads(p: dict, keys: np.ndarray, real: np.ndarray):
    """keys: classes (windows, 2 STEP). The attention and the state of each query position."""
    scale = np.float32(WIDTH**-0.5)
    x = p["e"][keys]
    flat = x.reshape(-1, WIDTH)
    q = (x[:, STEP:].reshape(-1, WIDTH) @ (p["wq"] * scale)).reshape(-1, STEP, WIDTH)
    k, v = (flat @ p["wk"]).reshape(x.shape), (flat @ p["wv"]).reshape(x.shape)
    s = q @ k.transpose(0, 2, 1)
    s += np.where(_CAUSAL, p["near"][np.maximum(_GAP, 0)], np.float32(-1e4))
    s[~np.broadcast_to(real[:, None, :], s.shape)] = -1e4
    s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=2, keepdims=True)
    o = s @ v
    h = np.tanh((x[:, STEP:].reshape(-1, WIDTH) @ p["wx"]) + (o.reshape(-1, WIDTH) @ p["wo"]) + p["b"])
    return x, q, k, v, s, o, h


def _log_softmax(z: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), pick]
    np.exp(z, out=z)
    total = z.sum(axis=1)
    z /= total[:, None]
    return own - np.log(total), z


def log_probabilities(p: dict, keys: np.ndarray, real: np.ndarray, asked: np.ndarray, target: np.ndarray) -> np.ndarray:
    """ln P(class) for each asked query position, in order; target: the classes there."""
    h = _heads(p, keys, real)[-1][asked.ravel()]
    group, place = target // EACH, target % EACH
    out = _log_softmax(h @ p["w1"] + p["b1"], group)[0].astype(np.float64)
    order = np.argsort(group.astype(np.uint8), kind="stable")
    h, place = h[order], place[order]
    cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for g in range(GROUPS):
        a, b = cuts[g], cuts[g + 1]
        if b > a:
            out[order[a:b]] += _log_softmax(h[a:b] @ p["w2"][g] + p["b2"][g], place[a:b])[0]
    return out


class Scorer:
    """log_probabilities by tables: queries, keys and values of each class are made once for each model.

    Exponentials need no shift, as the tables bound what goes into them; beyond LARGEST they are shifted.
    """

    def __init__(self, p: dict):
        self.p = p
        q, k = (p["e"] @ p["wq"]) * np.float32(WIDTH**-0.5), p["e"] @ p["wk"]
        self.kv = np.concatenate([k, p["e"] @ (p["wv"] @ p["wo"])], 1)
        self.qx = np.concatenate([q, p["e"] @ p["wx"] + p["b"]], 1)
        self.w = _joined(p)
        self.near = np.where(_CAUSAL, np.exp(np.minimum(p["near"], LARGEST))[_LAGS], 0).astype(np.float32)
        largest = [np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max(), np.abs(p["near"]).max()]
        largest += [(np.abs(p[w]).sum(axis=-2) + np.abs(p[b])).max() for w, b in (("w1", "b1"), ("w2", "b2"))]
        self.bounded = max(largest[0] + largest[1], *largest[2:]) < LARGEST

    def __call__(self, keys: np.ndarray, real: np.ndarray, asked: np.ndarray, target: np.ndarray) -> np.ndarray:
        if not self.bounded:
            return log_probabilities(self.p, keys, real, asked, target)
        kv, qx = self.kv.take(keys, 0), self.qx.take(keys[:, STEP:], 0)
        s = qx[:, :, :WIDTH] @ kv[:, :, :WIDTH].transpose(0, 2, 1)
        np.exp(s, out=s)
        s *= self.near
        some = np.flatnonzero(~real.all(axis=1))
        s[some] *= real[some, None, :]
        total = s.reshape(-1, 2 * STEP) @ _KEYS
        h = s @ kv[:, :, WIDTH:]
        h *= (1 / np.maximum(total, np.float32(1e-30))).reshape(-1, STEP, 1)
        h += qx[:, :, WIDTH:]
        np.tanh(h, out=h)
        order, _, _, _, z, at = _by_group(asked, target, h, self.w)
        part = z.ravel().take(at)
        np.exp(z, out=z)
        part -= np.log(z.reshape(-1, EACH) @ _ONES)
        out = np.empty(len(order))
        out[order] = part[::2] + part[1::2]
        return out


def _sums_by_class(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of rows (n, width) for each class; keys: the class of each row. Columns are added two at a time, as complex numbers."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    ordered = keys.take(order)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.zeros((CLASSES, rows.shape[1]), rows.dtype)
    out[ordered[first]] = np.add.reduceat(rows.take(order, 0).view(np.result_type(rows, np.complex64)), first, axis=0).view(rows.dtype)
    return out


def _parts(n: int) -> int:
    """In how many parts n windows are multiplied: products of about a thousand rows or fewer are the fast ones."""
    return next(k for k in (8, 4, 2, 1) if n % k == 0)


def _over_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum over windows and positions of the products of the rows of x and y."""
    k = _parts(len(x))
    return np.matmul(x.reshape(k, -1, x.shape[-1]).transpose(0, 2, 1), y.reshape(k, -1, y.shape[-1])).sum(axis=0)


def _by_rows(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.matmul(y.reshape(_parts(len(y)), -1, y.shape[-1]), w).reshape(*y.shape[:-1], w.shape[1])


def _small(x: np.ndarray, more: float = 0.0) -> bool:
    """Whether x, with more added to it, is within LARGEST of 0."""
    return max(x.max(), -x.min()) + more < LARGEST


def gradients(p: dict, keys: np.ndarray, real: np.ndarray, asked: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Mean loss of the asked positions and its gradient.

    As in Scorer, what depends on a class alone is made once for each class, and exponentials are shifted only where
    they need it. Targets are sorted by group, so each group is one product of slices.
    """
    if not asked.any():
        return 0.0, {k: np.zeros_like(x) for k, x in p.items()}
    scale, own = np.float32(WIDTH**-0.5), keys[:, STEP:]
    e, vo = p["e"], p["wv"] @ p["wo"]
    by_k, by_q = np.concatenate([p["wk"], vo], 1), np.concatenate([p["wq"] * scale, p["wx"]], 1)
    table = e @ by_q
    table[:, WIDTH:] += p["b"]
    kv, qx = (e @ by_k).take(keys, 0), table.take(own, 0)
    k, v, q = kv[:, :, :WIDTH], kv[:, :, WIDTH:], qx[:, :, :WIDTH]
    s = q @ k.transpose(0, 2, 1)
    bounded = _small(s, np.abs(p["near"]).max())
    s += np.where(_CAUSAL, p["near"][_LAGS], np.float32(-1e4))
    some = np.flatnonzero(~real.all(axis=1))
    s[some] += np.where(real[some], np.float32(0), np.float32(-1e4))[:, None, :]
    if not bounded:
        s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s *= (1 / (s.reshape(-1, 2 * STEP) @ _KEYS)).reshape(-1, STEP, 1)
    o = s @ v
    h = o + qx[:, :, WIDTH:]
    np.tanh(h, out=h)

    # softmax over all groups and over the classes of the own one, side by side
    w = _joined(p)
    order, on, ha, full, d, at = _by_group(asked, target, h, w)
    n, both = len(on), d.reshape(-1, EACH)
    if not _small(d):
        both -= both.max(axis=1, keepdims=True)
    np.exp(d, out=d)
    both *= (1 / ((both @ _ONES) * np.float32(n)))[:, None]
    chance = d.ravel().take(at)  # by n
    d.reshape(-1)[at] = chance - d.dtype.type(1 / n)
    gw, dh = np.zeros_like(w), np.empty((n, WIDTH), h.dtype)
    for c, i, j in full:
        np.dot(ha[i:j].T, d[i:j], out=gw[c])
        np.dot(d[i:j], w[c, :WIDTH].T, out=dh[i:j])
    g1 = gw[:, :, :GROUPS].sum(axis=0)
    g: dict[str, np.ndarray] = {"w1": g1[:WIDTH], "b1": g1[WIDTH], "w2": gw[:, :WIDTH, GROUPS:], "b2": gw[:, WIDTH, GROUPS:]}

    # back through the state and the attention
    da = np.zeros_like(h)
    da.reshape(-1, WIDTH)[on] = dh
    np.square(h, out=h)
    da *= np.subtract(1, h, out=h)
    dkv, dqx = np.empty_like(kv), np.empty_like(qx)
    dqx[:, :, WIDTH:] = da
    np.matmul(s.transpose(0, 2, 1), da, out=dkv[:, :, WIDTH:])
    ds = da @ v.transpose(0, 2, 1)
    o *= da
    ds -= (o.reshape(-1, WIDTH) @ np.ones(WIDTH, o.dtype)).reshape(-1, STEP, 1)
    ds *= s
    np.matmul(ds, k, out=dqx[:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])
    lags = np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1)  # 0 where a key lies ahead
    g["near"] = np.bincount(_LAGS.ravel(), np.where(_CAUSAL.ravel(), lags, 0), 2 * STEP).astype(np.float32)

    # back to the classes
    x = e.take(keys, 0)
    by_kv, by_qx = _over_rows(x, dkv), _over_rows(x[:, STEP:], dqx)
    g["b"] = np.ones(da.size // WIDTH, da.dtype) @ da.reshape(-1, WIDTH)
    g["wk"], g["wq"], g["wx"] = by_kv[:, :WIDTH], by_qx[:, :WIDTH] * scale, by_qx[:, WIDTH:]
    g["wv"], g["wo"] = by_kv[:, WIDTH:] @ p["wo"].T, p["wv"].T @ by_kv[:, WIDTH:]
    dx = _by_rows(dkv, np.ascontiguousarray(by_k.T))
    dx[:, STEP:] += _by_rows(dqx, np.ascontiguousarray(by_q.T))
    g["e"] = _sums_by_class(keys.ravel(), dx.reshape(-1, WIDTH))
    return -float(np.log(chance * np.float32(n)).sum()) / n, g


class Adam:
    """Steps on the parameters of p, which become parts of one vector. m and v are kept as plain decaying sums."""

    def __init__(self, p: dict, rate: float):
        self.flat, self.rate, self.t, at = np.concatenate([x.ravel() for x in p.values()]), rate, 0, 0
        for k, x in p.items():
            p[k] = self.flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.names, (self.m, self.v) = list(p), np.zeros((2, at), np.float32)
        self.g, self.x = np.empty((2, at), np.float32)

    def step(self, g: dict) -> None:
        self.t += 1
        rate = np.float32(0.1 * self.rate * np.sqrt((1 - 0.98**self.t) / 0.02) / (1 - 0.9**self.t))
        np.concatenate([g[k].ravel() for k in self.names], out=self.g)
        self.m *= np.float32(0.9)
        self.m += self.g
        np.square(self.g, out=self.g)
        self.v *= np.float32(0.98)
        self.v += self.g
        np.sqrt(self.v, out=self.x)
        self.x += np.float32(1e-8 * 0.02**-0.5)
        np.divide(self.m, self.x, out=self.x)
        self.x *= rate
        self.flat -= self.x


def _sequences(classes: np.ndarray, end: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of texts laid end to end, each with its end: an input is the class before."""
    before = np.empty_like(classes)
    before[1:] = classes[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)])[:-1]] = end
    return before, classes


def train(p: dict, parts: Iterator[tuple[np.ndarray, ...]], rate: float) -> int:
    """Train p in place on batches of windows (keys, real, asked, targets by query); the number of windows."""
    adam, n = Adam(p, rate), 0
    for keys, real, asked, target in parts:
        for a in range(0, len(keys), BATCH):
            b = slice(a, a + BATCH)
            adam.step(gradients(p, keys[b], real[b], asked[b], target[b][asked[b]])[1])
            n += len(keys[b])
    return n


def _train_windows(classes: np.ndarray, end: int, lengths: np.ndarray, seed: int):
    before, target = _sequences(classes, end, lengths)
    at, real, asked = windows(lengths)
    pick = np.random.default_rng(seed).permutation(len(at))
    at, real = at.take(pick, 0), real.take(pick, 0)
    return before.astype(np.int64).take(at), real, real[:, STEP:], target.astype(np.int64).take(at[:, STEP:])


def packed(p: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for r in batch.to_pylist():
            p = unpacked(r["weights"])
            total = {k: x.astype(np.float64) * r["n"] + (total[k] if total else 0) for k, x in p.items()}
            n += r["n"]
    if n:
        yield pa.RecordBatch.from_pylist([{"n": n, "weights": packed({k: x / n for k, x in total.items()})}], schema=_WEIGHTS)


def _met_blocks(met: np.ndarray, wide: int) -> dict[int, np.ndarray]:
    """The rows of the table, dealt by turns to blocks of at most MET_IDS: frequent ids, whose rows are full, are neighbours."""
    rows = met.reshape(-1, wide)
    blocks = -(-len(rows) // MET_IDS)
    return {k: rows[k::blocks] for k in range(blocks)}


def _met_rows(tables: dict[int, np.ndarray]) -> pa.RecordBatch:
    """(block, met) of the tables that are not all 0."""
    squeeze, some = zstandard.ZstdCompressor(level=1).compress, {k: x for k, x in tables.items() if x.any()}
    return pa.RecordBatch.from_arrays([pa.array(list(some), pa.int32()), pa.array([squeeze(x.tobytes()) for x in some.values()], pa.binary())], ["block", "met"])


def _met_table(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)


def _met_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("block").to_pylist(), batch.column("met"), strict=True):
            total[k] = total.get(k, 0) + _met_table(raw.as_py())
    yield _met_rows(total)


_WEIGHTS = pa.schema([("n", pa.int64()), ("weights", pa.binary())])


# ---------------------------------------------------------------- all documents


def _encoded(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[pa.RecordBatch]:
    """rid, held_out and the ids of each text, two bytes each, compressed."""
    encode, squeeze = encoder(spec), zstandard.ZstdCompressor(level=1).compress
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = [np.asarray(encode(x.as_py()), np.uint16) for x in lowered(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(_held(batch.column("doc_id"))), pa.array([squeeze(x.tobytes()) for x in ids], pa.binary()), pa.array(list(map(len, ids)), pa.int64())], ["rid", "held_out", "ids", "n"])


def _expanded(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with their ids, about most ids at a time."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        row, n = 0, np.cumsum(np.concatenate([[0], np.asarray(batch.column("n"))]))
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(n, n[row] + most, "right")) - 1)
            part = batch.slice(row, stop - row)
            yield part, [np.frombuffer(expand(x.as_py()), np.uint16) if k else np.zeros(0, np.uint16) for x, k in zip(part.column("ids"), part.column("n").to_pylist(), strict=True)]
            row = stop


def _with_end(ids: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) + 1 for x in ids], np.int64)
    out = np.full(lengths.sum(), end, np.int64)
    last = np.cumsum(lengths) - 1
    mask = np.ones(len(out), bool)
    mask[last] = False
    out[mask] = np.concatenate(ids) if ids else []
    return out, lengths


def fit(coded: DataFrame, size: int, end: int) -> tuple[dict, Classes]:
    """The network and the classes, from the training rows of coded."""
    spark = coded.sparkSession
    known = coded.filter("not held_out")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, ids in _expanded(batches):
            total += np.bincount(_with_end(ids, end)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    # one figure for each id of the vocabulary: its size bounds what comes to the driver
    got = known.select("ids", "n").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in got:
        counts[r.id] = r.n
    column, wide = company(counts)
    table = spark.sparkContext.broadcast(column)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(size * wide, np.int64)
        for _, ids in _expanded(batches):
            followers(met, table.value, wide, *_with_end(ids, end))
        yield _met_rows(_met_blocks(met, wide))

    # the vocabulary by COMPANY + 1 figures, whatever the input's size
    rows = known.select("ids", "n").mapInArrow(meet, "block int, met binary").repartition(-(-size // MET_IDS), "block").mapInArrow(_met_sums, "block int, met binary").collect()
    met = np.zeros(size * wide, np.int64)
    blocks = _met_blocks(met, wide)
    for x in rows:
        blocks[x.block][:] = _met_table(bytes(x.met)).reshape(-1, wide)
    warm = least_hashes(known, ["rid"], WARM_DOCS, ["ids", "n"])
    expand = zstandard.ZstdDecompressor().decompress
    sample = [np.frombuffer(expand(bytes(r.ids)), np.uint16).astype(np.int64) if r.n else np.zeros(0, np.int64) for r in warm]
    sample = [np.append(x, end) for x in sample]
    classes = Classes(counts, sample, met)
    p = fresh()
    if sample:
        flat = classes.of[np.concatenate(sample)]
        lengths = np.array([len(x) for x in sample])
        for k in range(WARM_ROUNDS):
            train(p, iter([_train_windows(flat, int(classes.of[end]), lengths, k)]), 0.02 / (1 + k))
    start = spark.sparkContext.broadcast((packed(p), classes.of))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, of = start.value
        p = unpacked(raw)

        def parts():
            for _, ids in _expanded(batches):
                flat, lengths = _with_end(ids, end)
                yield _train_windows(of[flat], int(of[end]), lengths, 0)

        n = train(p, parts(), 0.002)
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "weights": packed(p)}], schema=_WEIGHTS)

    if sample:
        trained = staged(known.select("ids", "n").mapInArrow(further, "n long, weights binary"), "trained")
        few = max(1, int(trained.count() ** 0.5))
        got = list(trained.repartition(few).mapInArrow(_average, "n long, weights binary").toLocalIterator())
        if got:
            n = sum(r.n for r in got)
            p = {k: sum(unpacked(bytes(r.weights))[k].astype(np.float64) * (r.n / n) for r in got).astype(np.float32) for k in p}
    return p, classes


def model_scores(coded: DataFrame, p: dict, classes: Classes, end: int) -> DataFrame:
    """(rid, score) of every row."""
    shared = coded.sparkSession.sparkContext.broadcast((packed(p), classes.of, classes.within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, of, within = shared.value
        scorer = Scorer(unpacked(raw))
        for part, ids in _expanded(batches):
            flat, lengths = _with_end(ids, end)
            before, target = _sequences(of[flat].astype(np.int64), int(of[end]), lengths)
            at, real, asked = windows(lengths)
            scores, row = np.empty(len(flat)), 0
            for a in range(0, len(at), SCORED):
                b = slice(a, a + SCORED)
                # the positions asked follow each other
                stop = row + np.count_nonzero(asked[b])
                scores[row:stop] = scorer(before.take(at[b]), real[b], asked[b], target[row:stop])
                row = stop
            text = np.add.reduceat(scores / np.log(10) + within[flat], np.concatenate([[0], np.cumsum(lengths)])[:-1])
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(text)], ["rid", "score"])

    return coded.select("rid", "ids", "n").mapInArrow(run, "rid long, score double")


def score(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.withColumn("rid", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    size = vocabulary(spec.value) + 1
    end_id = size - 1
    if size > 1 << 16:
        raise ValueError("ids are kept in two bytes")

    words = staged(docs.mapInArrow(_count_words, "h long, train long, total long").groupBy("h").agg(F.sum("train").alias("train"), F.sum("total").alias("total")), "words")
    sums = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.when(F.col("train") > 0, 1))).first()
    end = docs.select("doc_id").filter(~held_out(F.col("doc_id"))).count()
    n, v = sums[0] + end, sums[1] + (end > 0)
    head = words.orderBy(F.desc("total"), "h").limit(HEAD).select("h", "train").toArrow()
    known = head["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], head["train"].to_numpy()[order].astype(float)))
    parts = staged(keyed.mapInArrow(lambda it: _words(it, shared.value, end), "doc_id long, rid long, h long, k long, n_tokens long, known long, logs double"), "parts")
    tail = parts.filter("h is not null").select("rid", "h", "k").join(words.select("h", "train"), "h").select("rid", F.when(F.col("train") > 0, F.col("k")).otherwise(0).alias("known"), (F.col("k") * F.log10(F.col("train") + 0.5)).alias("logs"))

    coded = staged(keyed.mapInArrow(lambda it: _encoded(it, spec.value), "rid long, held_out boolean, ids binary, n long"), "ids")
    scores = model_scores(coded, *fit(coded, size, end_id), end_id)
    none = lambda kind: F.lit(None).cast(kind)
    rows = parts.filter("h is null").select("rid", "doc_id", "n_tokens", F.col("known").alias("head_known"), F.col("logs").alias("head_logs"), none("long").alias("known"), none("double").alias("logs"), none("double").alias("score"), F.lit(1).alias("times"))
    rows = rows.unionByName(tail.withColumn("times", F.lit(0)), allowMissingColumns=True).unionByName(scores.withColumn("times", F.lit(0)), allowMissingColumns=True)
    # equal rows share a rid: what adds up over words is divided by their number
    one = rows.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("head_known").alias("head_known"), F.max("head_logs").alias("head_logs"), F.sum("known").alias("known"), F.sum("logs").alias("logs"), F.max("score").alias("score"), F.sum("times").alias("times"))
    each = one.withColumn("__", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    total = F.col("head_logs") + F.coalesce(F.col("logs") / F.col("times"), F.lit(0.0))
    norm = float(np.log10(n + 0.5 * (v + 1)))
    return each.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("head_known") + F.coalesce((F.col("known") / F.col("times")).cast("long"), F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (total - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
