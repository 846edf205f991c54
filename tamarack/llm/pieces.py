"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into units that no piece of the vocabulary crosses (spaces, then the
characters up to the next space or line end). The batch's distinct units are concatenated and indexed by a
suffix array, sorted as far as the longest piece. Each piece is searched by bisection for its range of
occurrences; these edges are put in order of position and length. Then the units are relaxed over the
edges. As the model at hand is a BPE model, whose encoding isn't the best-scored path but the result of
merges in order of score, relaxing is in that order: again and again the best edge over two adjacent
symbols, the leftmost of equal ones, makes them one.

Characters of no piece become byte pieces. A literal U+2581, which the model writes for a space, does too,
so that decoding gives back every text exactly.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tamarack.llm.common import tidy

#: Characters of distinct units indexed at a time, symbols of a unit above which it is relaxed with a heap,
#: distinct units kept from batch to batch, bytes of text encoded at a time.
BATCH_CHARS, LONG, KEPT, BATCH_BYTES = 1 << 19, 48, 200_000, 4 << 20


def _fields(b: bytes):
    """Fields (number, value) of a serialized protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            c = b[i]
            i += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            value = b[i : i + n]
            i += n
        yield tag >> 3, value


class Vocabulary:
    """Pieces of a model file: BPE with byte fallback, no normalisation, a space before the text."""

    def __init__(self, model: bytes):
        text, score, self.byte, self.raw = [], [], {}, []
        for f, v in _fields(model):
            if f == 1:
                piece = dict(_fields(v))
                text.append(piece[1].decode().replace("▁", " "))
                score.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kind = piece.get(3, 1)
                if kind == 6:
                    self.byte[int(text[-1][3:5], 16)] = len(text) - 1
                    self.raw.append(bytes([int(text[-1][3:5], 16)]))
                else:
                    self.raw.append(text[-1].encode() if kind == 1 else b"")
                if kind != 1:
                    text[-1] = ""
            elif f == 2:
                spec = dict(_fields(v))
                if spec.get(3, 1) != 2:
                    raise ValueError("only BPE models are supported")
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")
        if any(" " in t.lstrip(" ") or "\n" in t for t in text):
            raise ValueError("a piece crosses a unit's end")
        ids = np.array([i for i, t in enumerate(text) if t])
        self.single = {text[i]: int(i) for i in ids if len(text[i]) == 1}
        many = [i for i in ids if len(text[i]) > 1]
        self.ids = np.array(many, np.int32)
        self.length = np.array([len(text[i]) for i in many])
        self.longest = int(self.length.max(initial=1))
        # Ranks: 0 is merged first. Equal scores are one rank.
        _, self.rank = np.unique(-np.array([score[i] for i in many]), return_inverse=True)
        # Each piece's characters three to a number, and the greatest number that begins like a last, shorter one.
        steps = -(-self.longest // 3)
        self.triples, self.ceilings = np.zeros((len(many), steps), np.int64), np.zeros((len(many), steps), np.int64)
        for r, i in enumerate(many):
            for t in range(0, len(text[i]), 3):
                part = [ord(c) for c in text[i][t : t + 3]]
                self.triples[r, t // 3] = sum(c << 42 - 21 * k for k, c in enumerate(part))
                self.ceilings[r, t // 3] = self.triples[r, t // 3] | (1 << 21 * (3 - len(part))) - 1

    def codes_of(self, k: int) -> list[int]:
        """Characters of the k-th piece of ids."""
        return [int(x) for t in self.triples[k] for x in (t >> 42, t >> 21 & 0x1FFFFF, t & 0x1FFFFF) if x]


def _triples(codes: np.ndarray) -> np.ndarray:
    """The three characters from each position on as one number, 0 past the end."""
    c = np.concatenate((codes, np.zeros(2, codes.dtype))).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def suffix_array(rank: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the `depth` or more characters that start there, by doubling from ranks of triples."""
    n, k = len(rank), 3
    rank = rank + 1
    while True:
        key = rank * (n + 2)
        key[: max(0, n - k)] += rank[k:]
        order = np.argsort(key)
        if k * 2 >= depth:
            return order
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([1], 1 + np.cumsum(s[1:] != s[:-1])))
        rank = new
        k *= 2


def _ranges(sa: np.ndarray, values: np.ndarray, rank: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece the range of places in sa whose suffixes begin with it, by bisection three characters at a time.

    Suffixes that agree so far are a group; group and rank of the next triple make one sorted number.
    """
    n, m = len(sa), len(values) + 1
    lo, hi = np.zeros(len(v.ids), np.int64), np.zeros(len(v.ids), np.int64)
    open_ = np.arange(len(v.ids))
    group = np.zeros(len(v.ids), np.int64)
    place = np.zeros(n, np.int64)
    padded = np.concatenate((rank, np.zeros(v.longest + 3, np.int64)))
    for t in range(0, v.longest, 3):
        sorted_ = place * m + padded[sa + t]
        rest = v.length[open_] - t
        low = np.searchsorted(values, v.triples[open_, t // 3])
        part = rest < 3
        high = np.searchsorted(values, np.where(part, v.ceilings[open_, t // 3], v.triples[open_, t // 3]), "right")
        a = np.searchsorted(sorted_, group[open_] * m + low)
        z = np.searchsorted(sorted_, group[open_] * m + high)
        done = rest <= 3
        lo[open_[done]], hi[open_[done]] = a[done], z[done]
        place = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        more = ~done & (a < z)
        open_ = open_[more]
        group[open_] = place[a[more]]
        if not len(open_):
            break
    return lo, hi


def edges(codes: np.ndarray, v: Vocabulary) -> np.ndarray:
    """edges[position, length]: number of the piece (in v.ids) of that many characters there, or -1."""
    out = np.full((len(codes), v.longest + 1), -1, np.int32)
    if len(codes) > 1 and len(v.ids):
        # The triple of zeros is the first value, so that what is past the end has rank 0.
        values, rank = np.unique(np.concatenate(([0], _triples(codes))), return_inverse=True)
        rank = rank[1:].astype(np.int64)
        sa = suffix_array(rank, v.longest)
        lo, hi = _ranges(sa, values, rank, v)
        n = hi - lo
        piece = np.repeat(np.arange(len(n)), n)
        at = sa[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        order = np.argsort(at * (v.longest + 1) + v.length[piece])
        out[at[order], v.length[piece[order]]] = piece[order]
    return out


def _relax(first: np.ndarray, unit: np.ndarray, edge: np.ndarray, v: Vocabulary, end: np.ndarray):
    """Merge the symbols (starts `first`, sorted, of units `unit`): in each round the best edge of each unit."""
    done_first, done_next = [], []
    nxt = np.append(first[1:], 0)
    last = np.append(unit[1:] != unit[:-1], True)
    nxt[last] = end[unit[last]]
    no = len(v.ids) + 1
    while len(first):
        pair = np.full(len(first), no)
        a = np.flatnonzero(~last)
        span = nxt[a + 1] - first[a]
        fits = span <= v.longest
        e = edge[first[a[fits]], span[fits]]
        pair[a[fits]] = np.where(e >= 0, v.rank[e], no)
        starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.minimum.reduceat(pair, starts)
        open_ = np.repeat(best < no, np.diff(np.append(starts, len(first))))
        done_first.append(first[~open_])
        done_next.append(nxt[~open_])
        hit = open_ & (pair == np.repeat(best, np.diff(np.append(starts, len(first)))))
        # Of a unit's equal edges only the leftmost.
        h = np.flatnonzero(hit)
        h = h[np.append(True, unit[h[1:]] != unit[h[:-1]])] if len(h) else h
        nxt[h] = nxt[h + 1]
        keep = open_.copy()
        keep[h + 1] = False
        first, unit, nxt = first[keep], unit[keep], nxt[keep]
        last = np.append(unit[1:] != unit[:-1], True)[: len(unit)]
    f, n = np.concatenate(done_first), np.concatenate(done_next)
    order = np.argsort(f)
    return f[order], n[order]


def _relax_long(start: int, end: int, edge: np.ndarray, v: Vocabulary):
    """The same of one long unit with a heap of (rank, position)."""
    nxt = {p: p + 1 for p in range(start, end)}
    before = {p: p - 1 for p in range(start + 1, end)}
    heap: list = []

    def offer(p):
        q = nxt[p]
        if q < end and nxt[q] - p <= v.longest and (e := edge[p, nxt[q] - p]) >= 0:
            heapq.heappush(heap, (int(v.rank[e]), p, q, nxt[q]))

    for p in range(start, end - 1):
        offer(p)
    while heap:
        _, p, q, r = heapq.heappop(heap)
        if nxt.get(p) != q or nxt.get(q) != r:
            continue
        nxt[p] = r
        del nxt[q]
        if r < end:
            before[r] = p
        offer(p)
        if p > start:
            offer(before[p])
    f = np.fromiter(nxt, np.int64, len(nxt))
    return f, np.fromiter(nxt.values(), np.int64, len(nxt))


def encode_units(units: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each of the units."""
    codes = np.frombuffer("".join(units).encode("utf-32-le"), np.int32)
    size = np.fromiter(map(len, units), np.int64, len(units))
    end = np.cumsum(size)
    start = end - size
    # Pieces may not reach over a unit's end: one separator after each.
    spread = np.zeros(len(codes) + len(units), np.int32)
    unit = np.repeat(np.arange(len(units)), size)
    place = np.arange(len(codes)) + unit
    spread[place] = codes
    edge = edges(spread, v)
    start, end = start + np.arange(len(units)), end + np.arange(len(units))
    short = size <= LONG
    pick = short[unit]
    found = [_relax(place[pick], unit[pick], edge, v, end)] if pick.any() else []
    found += [_relax_long(int(start[k]), int(end[k]), edge, v) for k in np.flatnonzero(~short)]
    first = np.concatenate([x[0] for x in found]).astype(np.int64)
    nxt = np.concatenate([x[1] for x in found]).astype(np.int64)
    order = np.argsort(first)
    first, nxt = first[order], nxt[order]
    ids = np.empty(len(first), object)
    long_ = nxt - first > 1
    flat = np.full(len(first), -1, np.int64)
    flat[long_] = v.ids[edge[first[long_], (nxt - first)[long_]]]
    rest = np.flatnonzero(~long_)
    chars, back = np.unique(spread[first[rest]], return_inverse=True)
    one = [[v.single[chr(c)]] if chr(c) in v.single else [v.byte[x] for x in chr(c).encode()] for c in chars]
    width = np.ones(len(first), np.int64)
    width[rest] = np.fromiter(map(len, one), np.int64, len(one))[back] if len(rest) else 0
    single = width == 1
    flat[rest] = np.array([x[0] for x in one], np.int64)[back] if len(rest) else 0
    if single.all():
        out = flat.astype(np.int32)
    else:
        ids = np.repeat(flat, width)
        at = np.cumsum(width) - width
        for k in np.flatnonzero(~single):
            ids[at[k] : at[k] + width[k]] = one[back[np.searchsorted(rest, k)]]
        out = ids.astype(np.int32)
    bounds = np.concatenate(([0], np.cumsum(width)))[np.searchsorted(first, np.append(start, end[-1:] + 1))]
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_UNITS = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class Encoder:
    """Encodes batches of texts; keeps the ids of units from batch to batch, KEPT of them at most."""

    def __init__(self, model: bytes):
        self.v = Vocabulary(model)
        self._clear()

    def _clear(self):
        self.index: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]):
        ids: list[np.ndarray] = []
        at = 0
        while at < len(new):
            n, to = 0, at
            while to < len(new) and (n == 0 or n + len(new[to]) <= BATCH_CHARS):
                n += len(new[to]) + 1
                to += 1
            ids += encode_units(new[at:to], self.v)
            at = to
        self.flat = np.concatenate([self.flat, *ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])

    def encode(self, texts: list[str | None]):
        """(ids of all texts, offsets); a null text has none, like an empty one."""
        if len(self.index) > KEPT:
            self._clear()
        index, size, new, rows, count = self.index, len(self.index), [], [], []
        for t in texts:
            units = _UNITS.findall(" " + t) if t else ()
            count.append(len(units))
            for u in units:
                k = index.get(u)
                if k is None:
                    k = index[u] = size + len(new)
                    new.append(u)
                rows.append(k)
        if new:
            self._learn(new)
        row = np.array(rows, np.int64)
        a = self.bounds[row]
        n = self.bounds[row + 1] - a
        ends = np.cumsum(n)
        at = np.repeat(a - (ends - n), n)
        at += np.arange(len(at))
        offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(np.array(count, np.int64))))]
        return self.flat[at], offsets


def decode(ids: list[int], raw: list[bytes]) -> bytes:
    """Bytes of the text that has these ids."""
    return b"".join([raw[i] for i in ids])[1:]


@functools.lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def _encode(model: bytes):
    def run(batches):
        enc = _encoder(model)
        raw = enc.v.raw
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (size == 0 or size < BATCH_BYTES):
                    size += len(texts[to] or "") + 1
                    to += 1
                ids, off = enc.encode(texts[at:to])
                same = [t is not None and decode(ids[x:y].tolist(), raw) == t.encode() for t, x, y in zip(texts[at:to], off[:-1], off[1:], strict=True)]
                null = pa.array([t is None for t in texts[at:to]])
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids), mask=null)
                tokens = pa.array(np.diff(off))
                yield pa.record_batch([b.column(0).slice(at, to - at), tokens, lists, pa.array([None if t is None else s for t, s in zip(texts[at:to], same, strict=True)], pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])
                at = to
        enc._clear()

    return run


def _model(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens long, ids array<int>, round_trip boolean) of every row of docs (doc_id, text).

    ids are those of the model at model_path (by default the public 32,000-piece one of the installed
    tokenizer package), read on the driver and sent to the tasks: its size is the file's. round_trip: the
    ids, decoded, are the text again. A null text has null ids and round_trip and 0 tokens, an empty one no
    ids. Rows may repeat; other columns are ignored; an empty table gives an empty table.
    """
    schema = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(tidy(_encode(_model(model_path)), 1000), schema)


def _decode(model: bytes, at: int, names: list[str]):
    def run(batches):
        raw = _encoder(model).v.raw
        for b in batches:
            texts = [None if i is None else decode(i, raw).decode("utf-8", "replace") for i in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], names)

    return run


def decode_documents(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """encoded (ids array<int>, any more columns) with the column text, in place of one that it has.

    Ids of null give a null text; ids that make no UTF-8 are decoded with replacement characters.
    """
    encoded = encoded.drop("text")
    schema = T.StructType([*encoded.schema, T.StructField("text", T.StringType())])
    return encoded.mapInArrow(tidy(_decode(_model(model_path), encoded.columns.index("ids"), schema.names), 1000), schema)


def op10_sentencepiece(spark, sf_dir):
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLES: dict[str, str] = {}
