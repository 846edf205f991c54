"""LM scoring with a Katz backoff model over words and text ends: bigrams, or n-grams of any other order.

P(w | h) = d(c(h, w)) c(h, w) / c(h) for a pair seen in training, else alpha(h) P(w). d are Good-Turing
discounts (1 above K), and alpha(h) is what makes the words' probabilities sum to 1 after h, computed over
all continuations of h. P(w) is the same for single words, with the left-over mass for the unknown word; an
unknown history backs off to P(w). A text's first word follows the end sign.

How it is laid out. Texts are tokenised once into chunks of a few million tokens with a dictionary of
their own. Words get global numbers in descending order of count, so that a number tells its count by a
table of as many rows as there are different counts (at most sqrt(2 N)). Pairs are counted in a table
partitioned by the hash of the history; the histories that make up more than 1/HEAVY of the tokens, fewer
than HEAVY, are partitioned by the pair instead, and their sums are put together. Each chunk sends each
partition its different pairs with their counts, and gets back the probabilities of those pairs.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import WORD, drop_table, parts, release, table, tidy

#: Counts up to which Good-Turing discounts apply; tokens of a chunk; pairs of a partition; heavy histories.
K, CHUNK, PAIRS, HEAVY = 5, 700_000, 500_000, 1000
END = b"\n"


def pack(a: np.ndarray) -> bytes:
    """An array as compressed bytes, byte planes one after the other."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _batch(schema, *cols):
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_CHUNKS = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("held", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
CHUNKS = "chunk long, docs array<long>, sizes binary, held binary, tokens binary, words binary, counts binary"


def _chunks(batches):
    part, seq = TaskContext.get().partitionId(), 0
    d: dict = defaultdict()
    docs, held, toks, n = [], [], [], 0

    def fresh():
        d.clear()
        d.default_factory = d.__len__
        d[END]

    def out():
        sizes = np.fromiter(map(len, toks), np.int32, len(toks))
        tokens, keep = np.concatenate(toks), np.array(held, np.uint8)
        words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in d), np.uint64, len(d))
        counts = np.bincount(tokens[np.repeat(keep == 0, sizes)], minlength=len(d))
        return _batch(_CHUNKS, [part << 24 | seq], [docs], [pack(sizes)], [pack(keep)], [pack(tokens)], [words.tobytes()], [pack(counts.astype(np.int64))])

    fresh()
    for b in batches:
        for doc, text, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            w = (text or b"").lower().split()
            w.append(END)
            docs.append(doc)
            held.append(h)
            toks.append(np.fromiter(map(d.__getitem__, w), np.int32, len(w)))
            n += len(w)
            if n >= CHUNK:
                yield out()
                docs, held, toks, n, seq = [], [], [], 0, seq + 1
                fresh()
    if docs:
        yield out()


def _unigrams(batches):
    for b in batches:
        for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w, c = np.frombuffer(w, np.int64), unpack(c, np.int64)
            yield pa.record_batch([pa.array(w[c > 0]), pa.array(c[c > 0])], ["h", "c"])


def _requests(batches):
    for b in batches:
        for chunk, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = np.frombuffer(w, np.int64)
            yield pa.record_batch([pa.array(w), pa.array(np.full(len(w), chunk)), pa.array(np.arange(len(w), dtype=np.int32))], ["h", "chunk", "at"])


def _groups(batches, key: int, width: int):
    """Rows sorted by the integer column `key`, as lists of numpy columns, one group at a time."""
    held: list = [[] for _ in range(width)]
    last = None
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        cuts = [0, *(np.flatnonzero(np.diff(cols[key])) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if last is not None and cols[key][lo] != last:
                yield [np.concatenate(c) for c in held]
                held = [[] for _ in range(width)]
            last = cols[key][lo]
            for h, c in zip(held, cols, strict=True):
                h.append(c[lo:hi])
    if last is not None:
        yield [np.concatenate(c) for c in held]


def _packed_ids(batches):
    for chunk, at, ids in _groups(batches, 0, 3):
        order = np.argsort(at)
        yield pa.record_batch([pa.array(chunk[:1]), pa.array([pack(np.diff(at[order], prepend=0))], pa.binary()), pa.array([pack(ids[order])], pa.binary())], ["c", "at", "ids"])


_TEXTS = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("held", pa.binary()), ("tokens", pa.binary())])
TEXTS = "chunk long, docs array<long>, sizes binary, held binary, tokens binary"


def _resolved(unknown: int):
    """Tokens by global number, `unknown` for words that training has not."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                chunk, docs, sizes, held, tokens, n_words, at, ids = (b.column(c)[k].as_py() for c in range(8))
                to = np.full(n_words, unknown, np.int64)
                if at is not None:
                    to[np.cumsum(unpack(at, np.int64))] = unpack(ids, np.int64)
                yield _batch(_TEXTS, [chunk], [docs], [sizes], [held], [pack(to[unpack(tokens, np.int32)])])

    return run


def _pairs_of(sizes, held, tokens, base: int):
    """(history, key, trained) of each token: key = history * base + word."""
    ends = np.cumsum(sizes.astype(np.int64))
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate(([0], ends[:-1]))] = tokens[ends - 1]
    return before, before * base + tokens, np.repeat(held == 0, sizes)


def _place(keys: np.ndarray, base: int, heavy: int, spread: int) -> np.ndarray:
    """Partition of each pair."""
    h = keys // base
    x = np.where(h < heavy, keys, h).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)).astype(np.int64) % spread


def _distinct(sizes, held, tokens, base, heavy, spread):
    """Different known-history keys by partition, then key: keys, their trained counts, places, and each token's index (-1: none)."""
    before, key, trained = _pairs_of(sizes, held, tokens, base)
    known = before < base - 1
    keys, back = np.unique(key[known], return_inverse=True)
    counts = np.bincount(back[trained[known]], minlength=len(keys))
    place = _place(keys, base, heavy, spread)
    order = np.argsort(place, kind="stable")
    index = np.full(len(tokens), -1, np.int64)
    to = np.empty(len(keys), np.int64)
    to[order] = np.arange(len(keys))
    index[known] = to[back]
    return keys[order], counts[order], place[order], index


def _bigrams(base: int, heavy: int, spread: int):
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                chunk, sizes, held, tokens = (b.column(c)[k].as_py() for c in range(4))
                keys, counts, place, _ = _distinct(unpack(sizes, np.int32), unpack(held, np.uint8), unpack(tokens, np.int64), base, heavy, spread)
                cuts = np.flatnonzero(np.diff(place, prepend=-1))
                ends = np.append(cuts[1:], len(keys)) if len(cuts) else cuts
                rows = [(int(place[a]), chunk, pack(np.diff(keys[a:z], prepend=0)), pack(counts[a:z])) for a, z in zip(cuts, ends, strict=True)]
                p, c, x, y = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.record_batch([pa.array(p, pa.int32()), pa.array(c, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["p", "chunk", "keys", "counts"])

    return run


_MODEL = pa.schema([("p", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("histogram", pa.list_(pa.int64())), ("chunks", pa.list_(pa.int64())), ("asked", pa.list_(pa.binary()))])
MODEL = "p int, keys binary, counts binary, histogram array<long>, chunks array<long>, asked array<binary>"


def _merged(base: int, heavy: int):
    """A partition of the pair table, and where in it each chunk's pairs are: number of the pair; -1 for an
    unseen one of a heavy history; -2 - (number of the history in the partition) for another unseen one."""

    def run(batches):
        for p, chunk, keys, counts in _groups(batches, 0, 4):
            parts_ = [np.cumsum(unpack(k, np.int64)) for k in keys]
            every, back = np.unique(np.concatenate(parts_), return_inverse=True)
            total = np.bincount(back, np.concatenate([unpack(c, np.int64) for c in counts])).astype(np.int64)
            seen = total > 0
            code = np.cumsum(seen) - 1
            h = every // base
            histories = np.unique(h[seen])
            code[~seen] = np.where(h[~seen] < heavy, -1, -2 - np.searchsorted(histories, h[~seen]))
            asked = np.split(code[back], np.cumsum([len(x) for x in parts_])[:-1])
            histogram = np.bincount(np.minimum(total[seen], K + 2), minlength=K + 3)[1 : K + 2]
            yield _batch(_MODEL, p[:1], [pack(np.diff(every[seen], prepend=0))], [pack(total[seen])], [histogram], [chunk], [[pack(np.diff(a, prepend=0)) for a in asked]])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Katz's Good-Turing discounts of counts 0..K+1 (the first unused, the last 1) from n[r-1] items with count r.

    Where the counts of counts do not give all of them in (0, 1), each is r / (r + 1).
    """
    d = np.ones(K + 2)
    n1, top = n[0], (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        if not n[r - 1] or top >= 1:
            break
        d[r] = ((r + 1) * n[r] / n[r - 1] / r - top) / (1 - top)
    if n1 == 0 or top >= 1 or not ((d[1 : K + 1] > 0) & (d[1 : K + 1] < 1)).all():
        d[1 : K + 1] = np.arange(1, K + 1) / np.arange(2, K + 2)
    return d


class Counts:
    """What the numbers of words tell: counts by class of equal counts, the unknown word the last class."""

    def __init__(self, count: np.ndarray, types: np.ndarray):
        """count: different counts of words, descending; types: words with that count."""
        self.n, self.v = int((count * types).sum()), int(types.sum())
        by = dict(zip(count.tolist(), types.tolist(), strict=True))
        d = discounts([by.get(r, 0) for r in range(1, K + 2)])
        p = d[np.minimum(count, K + 1)] * count / max(1, self.n)
        rest = 1 - float((p * types).sum())
        # Where discounts leave nothing for the unknown word, one count is set aside.
        self.aside = rest <= 1e-12 and self.n > 0
        if self.aside:
            p, rest = count / (self.n + 1), 1 / (self.n + 1)
        self.starts = np.concatenate(([0], np.cumsum(types))).astype(np.int64)
        self.count = np.append(count, 0).astype(np.int64)
        self.p = np.append(p, rest if self.n else 1.0)
        # Histories of 1/HEAVY of the tokens or more: at most HEAVY of them.
        self.heavy = int(self.starts[np.count_nonzero(count * HEAVY >= self.n)]) if self.n else 0

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, ids, "right") - 1


def _sums(counts: Counts, d, base, keys, c):
    """Of each history among the sorted keys: (histories, first key's place, sum of seen p, sum of lower p, seen p)."""
    h, w = keys // base, keys % base
    p = d[np.minimum(c, K + 1)] * c / counts.count[counts.classes(h)]
    first = np.flatnonzero(np.diff(h, prepend=-1))
    if not len(first):
        return h, first, np.zeros(0), np.zeros(0), p
    return h[first], first, np.add.reduceat(p, first), np.add.reduceat(counts.p[counts.classes(w)], first), p


def _alphas(total, seen, lower):
    """(alpha, factor of the seen) by history: where discounting leaves nothing, one count is set aside."""
    nothing = seen >= 1 - 1e-12
    scale = np.where(nothing, total / (total + 1.0), 1.0)
    return np.maximum(1 - seen * scale, 0) / np.maximum(1 - lower, 1e-300), scale


def _heavy_sums(counts: Counts, d, base):
    def run(batches):
        for b in batches:
            for keys, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, c = np.cumsum(unpack(keys, np.int64)), unpack(c, np.int64)
                z = int(np.searchsorted(keys, counts.heavy * base))
                h, _, s, low, _ = _sums(counts, d, base, keys[:z], c[:z])
                yield pa.record_batch([pa.array(h), pa.array(s), pa.array(low)], ["h", "seen", "lower"])

    return run


def _answers(counts: Counts, d, base, heavy_scale):
    """By chunk and partition, of its pairs in order: f is 0 for a seen pair, 3 for one after a history that sets a
    count aside, 1 and 2 for an unseen one of a light and a heavy history; v has the seen pairs' counts (the
    rest the chunk knows), a log10 of alpha for those with f 1."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                p, keys, c, _, chunks, asked = (b.column(k)[row].as_py() for k in range(6))
                keys, c = np.cumsum(unpack(keys, np.int64)), unpack(c, np.int64)
                h, first, seen, lower, _ = _sums(counts, d, base, keys, c)
                alpha, scale = _alphas(counts.count[counts.classes(h)], seen, lower)
                light = h >= counts.heavy
                scale[~light] = heavy_scale[h[~light]]
                with np.errstate(divide="ignore"):
                    la = np.log10(alpha)
                kind = np.repeat(np.where(scale < 1, 3, 0), np.diff(np.append(first, len(keys)))).astype(np.uint8)
                out = []
                for a in asked:
                    a = np.cumsum(unpack(a, np.int64))
                    seen_at, back_at = a[a >= 0], -2 - a[a <= -2]
                    f = np.where(a <= -2, 1, 2).astype(np.uint8)
                    f[a >= 0] = kind[seen_at]
                    out.append((pack(c[seen_at]), pack(f), pack(la[back_at])))
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(chunks, pa.int64()), pa.array([p] * len(chunks), pa.int32()), *[pa.array(x, pa.binary()) for x in cols]], ["chunk", "p", "v", "f", "a"])

    return run


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(counts: Counts, d, base, spread, heavy_alpha):
    """Chunks' texts (p -1) followed by the answers of the partitions, in order."""

    def finish(held, answers):
        docs, sizes, flags, tokens = held
        sizes, flags, tokens = unpack(sizes, np.int32), unpack(flags, np.uint8), unpack(tokens, np.int64)
        keys, _, _, index = _distinct(sizes, flags, tokens, base, counts.heavy, spread)
        f = np.concatenate([unpack(x[1], np.uint8) for x in answers]) if answers else np.zeros(0, np.uint8)
        if len(f) != len(keys):
            raise RuntimeError("a partition's answers are missing")
        # log10 of a seen pair's probability, or of alpha, by different pair.
        total = counts.count[counts.classes(keys // base)]
        v = np.zeros(len(keys))
        seen = (f == 0) | (f == 3)
        if answers:
            c = np.concatenate([unpack(x[0], np.int64) for x in answers])
            v[seen] = np.log10(d[np.minimum(c, K + 1)] * c / total[seen])
            v[f == 1] = np.concatenate([unpack(x[2], np.float64) for x in answers])
            v[f == 3] += np.log10(total[f == 3] / (total[f == 3] + 1.0))
        cls = counts.classes(tokens)
        with np.errstate(divide="ignore"):
            low = np.log10(counts.p)[cls]
            la = np.log10(heavy_alpha)
        score = low.copy()
        got = index >= 0
        at = index[got]
        history = (keys // base)[at]
        back = np.where(f[at] == 2, la[np.minimum(history, len(la) - 1)], v[at])
        score[got] = np.where(seen[at], v[at], back + low[got])
        c = counts.count[cls]
        plain = np.log10((c + 1) / (counts.n + counts.v + 1))
        starts = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))[:-1]))
        add = np.add.reduceat
        return pa.record_batch(
            [pa.array(docs, pa.int64()), pa.array(flags == 1), pa.array(sizes.astype(np.int64)), pa.array(add((c > 0).astype(np.int64), starts)), pa.array(np.full(len(docs), counts.n)), pa.array(add(plain, starts)), pa.array(add(score, starts))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches):
        held, answers = None, []
        for b in batches:
            for k in range(b.num_rows):
                if b.column(1)[k].as_py() == -1:
                    if held is not None:
                        yield finish(held, answers)
                    held, answers = [b.column(c)[k].as_py() for c in range(2, 6)], []
                else:
                    answers.append(tuple(b.column(c)[k].as_py() for c in (6, 7, 8)))
        if held is not None:
            yield finish(held, answers)

    return run


def _by_tables(docs: DataFrame, order: int) -> DataFrame:
    """score_documents for any order, by joins of one table for each length of n-grams.

    A text follows order - 1 end signs, so that each token has one n-gram of each length, and an n-gram's end is the
    n-gram of the next shorter length. The table of a length has all n-grams, those not seen in training with count
    0, each with its probability, found from that of its end: recursion goes up from single words. Frequent
    histories and n-grams are aggregated before they are shuffled; joins on them are plain ones that AQE splits.
    """
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    end = F.array(F.xxhash64(F.lit("\n")))
    tokens = F.concat(F.transform(words, lambda w: F.xxhash64(w)), end)
    held = F.coalesce(F.col("held_out"), F.lit(False))
    rows = table(docs.select("doc_id", held.alias("held_out"), tokens.alias("t")).withColumn("r", F.monotonically_increasing_id()), "rows")
    padded = F.concat(*[end] * (order - 1), F.col("t"))
    grams = rows.select("r", "held_out", F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.slice(padded, i, F.lit(order)))).alias("g"))
    each = table(grams.groupBy("g", "r", "held_out").agg(F.count("*").alias("n")), "each")
    counted = [table(each.groupBy("g").agg(F.sum(F.when(~F.col("held_out"), F.col("n")).otherwise(0)).alias("c")), f"grams{order}")]
    for k in range(order - 1, 0, -1):
        shorter = counted[0].groupBy(F.slice("g", 2, k).alias("g")).agg(F.sum("c").alias("c"))
        counted.insert(0, table(shorter, f"grams{k}"))
    # One row for each different count, at most sqrt(2 N).
    classes = counted[0].where("c > 0").groupBy("c").agg(F.count("*").alias("types")).orderBy(F.desc("c")).toArrow()
    counts = Counts(np.asarray(classes["c"], np.int64), np.asarray(classes["types"], np.int64))

    def discounted(level):
        """The discounted count of c, by what the level's counts of counts are."""
        by = {r["c"]: r["n"] for r in level.where(F.col("c").between(1, K + 1)).groupBy("c").agg(F.count("*").alias("n")).collect()}
        d = discounts([by.get(r, 0) for r in range(1, K + 2)])
        return F.element_at(F.array(*[F.lit(float(x)) for x in d]), (F.least(F.col("c"), F.lit(K + 1)) + 1).cast("int")) * F.col("c")

    c, unknown = F.col("c"), F.lit(float(counts.p[-1]))
    single = c / F.lit(counts.n + 1) if counts.aside else discounted(counted[0]) / F.lit(max(1, counts.n))
    level = counted[0].select("g", F.when(c > 0, single).otherwise(unknown).alias("p"), c.alias("c1"))
    for k in range(2, order + 1):
        d = discounted(counted[k - 1])
        lower = level.select(F.col("g").alias("e"), F.col("p").alias("low"), "c1")
        own = counted[k - 1].withColumns({"e": F.slice("g", 2, k - 1), "h": F.slice("g", 1, k - 1)}).join(lower, "e").select("g", "h", "c", "low", "c1", d.alias("d"))
        own = table(own, f"joined{k}")
        seen = own.where("c > 0").groupBy("h").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"), F.sum("low").alias("under"))
        full = F.col("mass") / F.col("total") >= 1 - 1e-12
        scale = F.when(full, F.col("total") / (F.col("total") + 1.0)).otherwise(1.0)
        seen = seen.select("h", (scale / F.col("total")).alias("weight"), (F.greatest(F.lit(0.0), 1 - F.col("mass") * scale / F.col("total")) / F.greatest(F.lit(1e-300), 1 - F.col("under"))).alias("alpha"))
        p = F.when(c > 0, F.col("d") * F.col("weight")).otherwise(F.coalesce("alpha", F.lit(1.0)) * F.col("low"))
        level = table(own.join(seen, "h", "left").select("g", p.alias("p"), "c1"), f"level{k}")
    c1, n = F.col("c1"), F.col("n")
    sums = each.join(level, "g").groupBy("r").agg(
        F.sum(n).alias("n_tokens"), F.sum(F.when(c1 > 0, n).otherwise(0)).alias("n_known"),
        F.sum(n * F.log10((c1 + 1) / F.lit(float(counts.n + counts.v + 1)))).alias("base_score"), F.sum(n * F.log10("p")).alias("score"),
    )
    return rows.join(sums, "r").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.n).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of docs (doc_id, text, held_out boolean) under the model of those that aren't held out.

    order: length of the longest n-grams. For 2 pairs are counted from packed chunks, as told above; for others the
    n-grams are rows of tables, which takes several times the disk.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score and score (double, log10) of
    every row. Tokens are the words, lower-cased (A-Z), and one end; a null or empty text has the end only.
    A null held_out is false. Rows that repeat count and are scored each. Without training documents every
    token is unknown, with probability 1. Other columns are ignored; an empty table gives an empty table.
    """
    if order < 1:
        raise ValueError("order is 1 or more")
    if order != 2:
        return _by_tables(docs, order)
    spark = docs.sparkSession
    n = parts(spark)
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    chunks = table(source.mapInArrow(tidy(_chunks), CHUNKS), "chunks")
    words = table(chunks.select("words", "counts").mapInArrow(tidy(_unigrams), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    release(spark)
    # One row for each different count, at most sqrt(2 N).
    classes = words.groupBy("c").agg(F.count("*").alias("types")).orderBy(F.desc("c")).toArrow()
    counts = Counts(np.asarray(classes["c"], np.int64), np.asarray(classes["types"], np.int64))
    base = counts.v + 1
    if base * base >= 1 << 63:
        raise ValueError("pair keys need more than 64 bits")
    spread = max(4 * n, counts.n // PAIRS)
    buckets = max(64, counts.v // 50_000)
    split = words.withColumn("b", F.pmod("h", F.lit(buckets)))
    first = spark.createDataFrame(pa.table({"c": counts.count[:-1], "start": counts.starts[:-1]})) if counts.v else spark.createDataFrame([], "c long, start long")
    offsets = split.groupBy("c", "b").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.partitionBy("c").orderBy("b")) - F.col("k"))
    offsets = offsets.join(first, "c").select("c", "b", (F.col("start") + F.col("before")).alias("offset"))
    number = F.col("offset") + F.row_number().over(Window.partitionBy("c", "b").orderBy("h")) - 1
    ids = table(split.join(offsets, ["c", "b"]).select("h", number.alias("id")), "ids")
    release(spark)
    asked = chunks.select("chunk", "words").mapInArrow(tidy(_requests), "h long, chunk long, at int")
    found = asked.join(ids, "h").select("chunk", "at", "id").repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(tidy(_packed_ids), "c long, at binary, ids binary")
    found = table(found, "found")
    release(spark)
    whole = chunks.join(found, F.col("chunk") == F.col("c"), "left").select("chunk", "docs", "sizes", "held", "tokens", F.floor(F.octet_length("words") / 8).cast("int").alias("n_words"), "at", "ids")
    texts = table(whole.mapInArrow(tidy(_resolved(counts.v)), TEXTS), "texts")
    for old in (chunks, words, ids, found):
        drop_table(old)
    release(spark)
    pairs = texts.select("chunk", "sizes", "held", "tokens").mapInArrow(tidy(_bigrams(base, counts.heavy, spread)), "p int, chunk long, keys binary, counts binary")
    model = table(pairs.repartition(n, "p").sortWithinPartitions("p", "chunk").mapInArrow(tidy(_merged(base, counts.heavy)), MODEL), "pairs")
    release(spark)
    row = model.select(*[F.sum(F.col("histogram")[r]).alias(f"n{r}") for r in range(K + 1)]).first()
    d = discounts([x or 0 for x in row])
    # At most HEAVY rows.
    sums = model.select("keys", "counts").mapInArrow(tidy(_heavy_sums(counts, d, base)), "h long, seen double, lower double").groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower")).toArrow()
    alpha, scale = np.ones(counts.heavy + 1), np.ones(counts.heavy + 1)
    h = np.asarray(sums["h"], np.int64)
    alpha[h], scale[h] = _alphas(counts.count[counts.classes(h)], np.asarray(sums["seen"], float), np.asarray(sums["lower"], float))
    answers = model.mapInArrow(tidy(_answers(counts, d, base, scale)), "chunk long, p int, v binary, f binary, a binary")
    none = F.lit(None)
    left = texts.select("chunk", F.lit(-1).alias("p"), "docs", "sizes", "held", "tokens", *[none.cast("binary").alias(c) for c in "vfa"])
    right = answers.select("chunk", "p", none.cast("array<long>").alias("docs"), *[none.cast("binary").alias(c) for c in ("sizes", "held", "tokens")], "v", "f", "a")
    both = left.unionAll(right).repartition(n, "chunk").sortWithinPartitions("chunk", "p")
    return both.mapInArrow(tidy(_scores(counts, d, base, spread, alpha)), OUT)


def op7_katz_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_documents(docs.select("doc_id", "text", left_out.alias("held_out")))


QUERIES = {"op7_katz_lm_scoring": op7_katz_lm_scoring}
ORACLES: dict[str, str] = {}
