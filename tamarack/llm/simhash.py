"""SimHash near-dedup by anchor points of a covering code.

Fingerprints have 64 bits. 46 of them are two blocks of 23, and the binary Golay code [23, 12, 7],
which is perfect with covering radius 3, gives each block 4096 anchors; a pair of codewords is an
anchor of the fingerprint. Each fingerprint has one home: the nearest codeword in either block. Two
fingerprints at distance 2 or less differ in at most 2 bits of both blocks together, so the second lies
within radius 3 + i and 3 + j of the first one's home for some i + j <= 2. Copied to all these anchors
(about 61 of 16,777,216), every pair meets at a home of its own, and no pair is missed.

similar_duplicates() is the same for texts whose word shingles are alike at 0.8 or more, which differ in
about 0.15 of all bits: fingerprints of 512 bits over 44 blocks of 23, each with the Golay code as anchors.
Fingerprints at distance 21 or less agree in a whole block, and so share the anchor within radius 3 + 0;
of pairs further apart, 1 - (1 - P)^44 share one, P being 0.12 at a similarity of 0.8, 0.16 at 0.85 and
0.23 at 0.9. Pairs that meet are compared by bits and then, exactly, by their shingles.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import components, drop_table, parts, release, table, tidy

#: Generator polynomial of the binary Golay code (x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1).
GOLAY = 0b110001110101
BLOCK = 23
RADIUS = 3
BITS = 2
#: Shingles whose bits are unpacked at a time, pairs compared at a time, and entries of an anchor above
#: which its pairs are found by flipping bits instead.
SHINGLES, PAIRS, LARGE = 1 << 16, 1 << 22, 1 << 14


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of lower-cased (A-Z) word shingles, repeats included; 0 for no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        n, digests = 1, iter((xxhash.xxh64_digest(joined, 42),))
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
        digest, n = xxhash.xxh64_digest, len(starts)
        digests = (digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    while block := b"".join(itertools.islice(digests, SHINGLES)):
        ones += np.unpackbits(np.frombuffer(block, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def _fingerprints(batches):
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.record_batch([b.column(0), pa.array([fingerprint(t) for t in texts], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row of docs, whole texts."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(_fingerprints, 1000), "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GOLAY << (bit - 11)), x)
    return x


def _patterns():
    """By syndrome: error patterns of weight up to 5 in order of weight over 3, with that excess."""
    found = [(sum(1 << i for i in c), max(0, w - RADIUS)) for w in range(RADIUS + BITS + 1) for c in itertools.combinations(range(BLOCK), w)]
    e, excess = np.array([x[0] for x in found]), np.array([x[1] for x in found])
    syn = _syndrome(e)
    order = np.lexsort((e, excess, syn))
    starts = np.searchsorted(syn[order], np.arange(2049))
    return e[order], excess[order], starts


def _anchors(fp: np.ndarray, tables):
    """(index into fp, anchor, home) of every anchor that fp is copied to."""
    e, excess, starts = tables
    u = fp.view(np.uint64)
    sides = []
    for shift in (0, BLOCK):
        x = (u >> np.uint64(shift)).astype(np.int64) & ((1 << BLOCK) - 1)
        s = _syndrome(x)
        n = starts[s + 1] - starts[s]
        row = np.repeat(np.arange(len(fp)), n)
        at = np.repeat(starts[s] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        sides.append((row, x[row] ^ e[at], excess[at]))
    rows, anchors, homes = [], [], []
    for i in range(BITS + 1):
        for j in range(BITS + 1 - i):
            (ra, ca, ea), (rb, cb, eb) = sides
            ra, ca, rb, cb = ra[ea == i], ca[ea == i], rb[eb == j], cb[eb == j]
            na, nb = np.bincount(ra, minlength=len(fp)), np.bincount(rb, minlength=len(fp))
            first_b = np.concatenate(([0], np.cumsum(nb)[:-1]))
            times = nb[ra]
            left = np.repeat(np.arange(len(ra)), times)
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + first_b[ra[left]]
            rows.append(ra[left])
            anchors.append(ca[left] << BLOCK | cb[at])
            homes.append(np.full(len(left), i == 0 and j == 0))
            assert len(left) == int((na * nb).sum())
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)


def _copied(batches):
    tables = _patterns()
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            row, anchor, home = _anchors(part, tables)
            yield pa.record_batch([pa.array(anchor), pa.array(part[row]), pa.array(home)], ["anchor", "fp", "home"])


def forest(u: np.ndarray, v: np.ndarray):
    """Links (node, least node) that connect what the links (u, v) connect, one for each node at most."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new[new]
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _near(fp: np.ndarray, bits: int):
    """All links of a large anchor's fingerprints by flipping up to `bits` bits and looking them up: linear."""
    fp = np.unique(fp)
    flips = [np.uint64(sum(1 << i for i in c)) for w in range(1, bits + 1) for c in itertools.combinations(range(64), w)]
    u = fp.view(np.uint64)
    for f in flips:
        other = (u ^ f).view(np.int64)
        at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
        hit = (fp[at] == other) & (other > fp)
        if hit.any():
            yield fp[hit], other[hit]


def _links(anchor, fp, home):
    """Links among the entries, sorted by anchor, of whole anchors."""
    cut = np.flatnonzero(np.diff(anchor)) + 1
    starts = np.concatenate(([0], cut))
    ends = np.concatenate((cut, [len(anchor)]))
    group = np.repeat(np.arange(len(starts)), ends - starts)
    size = ends - starts
    us, vs = [], []
    for g in np.flatnonzero(size > LARGE):
        for u, v in _near(fp[starts[g] : ends[g]], BITS):
            us.append(u)
            vs.append(v)
    h = np.flatnonzero(home & (size[group] > 1) & (size[group] <= LARGE))
    n = size[group[h]]
    total = np.cumsum(n)
    at = 0
    while at < len(h):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS)))
        k = n[at:to]
        i = np.repeat(h[at:to], k)
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[group[h[at:to]]], k)
        d = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64))
        hit = (d <= BITS) & (d > 0)
        us.append(fp[i[hit]])
        vs.append(fp[j[hit]])
        at = to
    if us and sum(map(len, us)):
        return forest(np.concatenate(us), np.concatenate(vs))
    return None


def _compared(batches):
    """Entries sorted by anchor, a million and more at a time, cut between anchors."""
    held: list = []

    def out(part):
        if len(part[0]) and (found := _links(*part)) is not None:
            yield pa.record_batch([pa.array(found[0]), pa.array(found[1])], ["u", "v"])

    n = 0
    for b in batches:
        held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        n += b.num_rows
        if n >= 1 << 20:
            x = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(x[0], x[0][-1]))
            yield from out([c[:cut] for c in x])
            held, n = [[c[cut:] for c in x]], len(x[0]) - cut
    if held:
        yield from out([np.concatenate(c) for c in zip(*held, strict=True)])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id) of every row of docs (doc_id, text; more columns are ignored).

    Fingerprints at BITS or fewer differing bits link; component_id is the least doc_id reachable.
    Null and wordless texts have fingerprint 0, which links like any other. Rows that repeat are rows of
    their own. Rows with a null doc_id link too; a component with null ids only has a null component_id.
    Equal fingerprints are one node: copies are never paired. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    prints = table(fingerprints(docs), "fp")
    classes = table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fpc")
    copied = classes.select("fp").mapInArrow(tidy(_copied), "anchor long, fp long, home boolean")
    links = copied.repartition(parts(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(tidy(_compared), "u long, v long")
    found = components(links)
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("label"))
    named = table(named, "fpn")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select(F.col("fp").alias("node"), "component_id")
    drop_table(classes)
    return prints.join(named, F.col("fp") == F.col("node")).select("doc_id", "fp", "component_id")


#: Width in words and least similarity of near-duplicate stages.
WIDTH, LEAST = 5, 0.8
#: 64-bit words of a fingerprint of theirs. Of pairs at the least similarity, whose differing bits are
#: distributed about binomially, those over DEVIATIONS above the mean aren't compared.
WORDS, DEVIATIONS = 8, 3.5
_TIMES = np.random.default_rng(42).integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Two orders of the bits; either is cut into blocks.
_BLOCKS = 64 * WORDS // BLOCK
_ORDERS = np.concatenate([np.arange(64 * WORDS) * step % (64 * WORDS) for step in (1, 199)]).reshape(2, -1)[:, : _BLOCKS * BLOCK]


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of lower-cased (A-Z) word shingles, sorted; a shorter text is one shingle, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= width:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sets is at least `least`; that of two empty ones is 1."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """SimHash of WORDS * 64 bits of a set of shingle hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(s), 255):  # so many fit a byte
        x = s[at : at + 255, None] * _TIMES
        x = (x ^ x >> np.uint64(32)) * _TIMES[::-1]
        x ^= x >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8)).reshape(-1, 64 * WORDS), 0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(s)).view(np.int64)


def homes(fp: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The anchor (block and codeword) within the covering radius of each block of fingerprints (rows of WORDS)."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1)
    x = bits[:, _ORDERS.ravel()].reshape(len(fp), -1, BLOCK) @ (1 << np.arange(BLOCK))
    return x ^ lead[_syndrome(x)] | np.arange(x.shape[1]) << BLOCK


def most_bits(bits: int, least: float) -> int:
    """Differing bits up to which fingerprints are compared: the angle of sets at similarity `least` is acos(2s / (1 + s)) at most."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    return math.floor(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def _node(s: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(s.tobytes()), np.int64)[0])


def _printed(width: int):
    def run(batches):
        for b in batches:
            sets = (shingles(t, width) for t in b.column(1).to_pylist())
            rows = [(_node(s), len(s), wide_fingerprint(s)) for s in sets]
            nodes, sizes, fp = zip(*rows, strict=True) if rows else ((), (), np.zeros((0, WORDS), np.int64))
            yield pa.record_batch([b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), *map(pa.array, np.array(fp).T)], ["doc_id", "node", "size", *_FP])

    return run


_FP = [f"f{k}" for k in range(WORDS)]
_ENTRY = ["key", "node", "label", "size", *_FP]


def _homed(batches):
    """An entry for each anchor of each node (node, label, size, fingerprint); none for an empty set."""
    e, _, starts = _patterns()
    lead = e[starts[:-1]]
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            node, label, size, *fp = (c.to_numpy(zero_copy_only=False) for c in b.slice(at, 2048).columns)
            has = size > 0
            keys = homes(np.stack(fp, 1)[has], lead)
            again = [np.repeat(x[has], keys.shape[1]) for x in (node, label, size, *fp)]
            yield pa.record_batch([pa.array(keys.ravel().astype(np.int32)), *map(pa.array, again)], _ENTRY)


def _whole_keys(run):
    """run(columns) over entries sorted by key, a million and more at a time, cut between keys."""

    def wrapped(batches):
        held: list = []
        n = 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n >= 1 << 20:
                x = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(x[0], x[0][-1]))
                if cut:
                    yield from run(*(c[:cut] for c in x))
                held, n = [[c[cut:] for c in x]], len(x[0]) - cut
        if held:
            yield from run(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return wrapped


def _near_pairs(i, j, key, node, label, size, fp, least: float, lead):
    """Of the pairs of entries (i, j): those of other labels whose sizes and bits allow a similarity of `least`.

    A pair that shares several anchors is given at the first of them only.
    """
    ok = label[i] != label[j]
    ok &= np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9
    i, j, d = i[ok], j[ok], 0
    for lo, hi in ((0, 2), (2, WORDS)):
        d = d + sum(np.bitwise_count((f[i] ^ f[j]).view(np.uint64)).astype(np.int64) for f in fp[lo:hi])
        ok = d <= most_bits(64 * hi, least)
        i, j, d = i[ok], j[ok], d[ok]
    used, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    if len(used):
        own = homes(np.stack([f[used] for f in fp], 1), lead)
        ok = (own[at[: len(i)]] == own[at[len(i) :]]).argmax(1) == key[i] >> BLOCK
        i, j, d = i[ok], j[ok], d[ok]
    a, b = node[i], node[j]
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], ["u", "v", "d"])


def _nearest(parts):
    """Of near pairs, that with the least distance for each u and each v."""
    u, v, d = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(3))
    tie = (u ^ v).view(np.uint64) * _TIMES[0]
    kept = []
    for end in (u, v):
        order = np.lexsort((tie, d, end))
        kept.append(order[np.append(True, np.diff(end[order]) != 0)] if len(order) else order)
    at = np.unique(np.concatenate(kept))
    return pa.record_batch([pa.array(c[at]) for c in (u, v, d)], ["u", "v", "d"])


def _ranges(i, lo, hi):
    """Pairs (i, j) for lo <= j < hi, PAIRS and more at a time."""
    n = np.maximum(hi - lo, 0)
    total = np.cumsum(n)
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS)))
        k = n[at:to]
        yield np.repeat(i[at:to], k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at:to], k)
        at = to


def _apart(least: float):
    """All near pairs of each anchor's entries whose labels differ; members of one label are never paired.

    Labels with one entry at the anchor are sorted by size, so that any entry meets those of a fitting size
    only. The others are sorted by label; each entry meets those behind its label's block.
    """

    e, _, starts = _patterns()
    lead = e[starts[:-1]]

    def run(key, node, label, size, *fp):
        order = np.lexsort((label, key))
        key, node, label, size, *fp = (c[order] for c in (key, node, label, size, *fp))
        new = np.append(True, (key[1:] != key[:-1]) | (label[1:] != label[:-1]))
        block = np.cumsum(new) - 1
        many = np.bincount(block)[block] > 1
        order = np.lexsort((np.where(many, label, size), ~many, key))
        key, node, label, size, many, *fp = (c[order] for c in (key, node, label, size, many, *fp))
        # Places of single entries' (anchor, size), as one ascending number.
        rank = np.cumsum(np.append(False, key[1:] != key[:-1]))
        single, wide = np.flatnonzero(~many), int(size.max()) + 2
        placed = rank[single] * wide + size[single]
        i = np.arange(len(key))
        low = np.searchsorted(placed, rank * wide + np.ceil(least * size - 1e-9).astype(np.int64))
        high = np.searchsorted(placed, rank * wide + np.minimum(np.floor(size / least + 1e-9).astype(np.int64), wide - 1), "right")
        at = np.cumsum(~many)
        low = np.where(many, low, at)
        for x, y in _ranges(i, low, high):
            yield _near_pairs(x, single[y], key, node, label, size, fp, least, lead)
        block_end = np.flatnonzero(np.append((key[1:] != key[:-1]) | (label[1:] != label[:-1]) | ~many[1:], True)) + 1
        many_end = np.flatnonzero(np.append((key[1:] != key[:-1]) | (many[1:] != many[:-1]), True)) + 1
        start = block_end[np.searchsorted(block_end, i, "right")]
        end = many_end[np.searchsorted(many_end, i, "right")]
        for x, y in _ranges(i[many], start[many], end[many]):
            yield _near_pairs(x, y, key, node, label, size, fp, least, lead)

    return run


def _closest(least: float):
    """Of the pairs that _apart makes, the nearest of each entry."""

    def run(*entries):
        kept = None
        for found in _apart(least)(*entries):
            kept = _nearest([found] if kept is None else [kept, found])
        if kept is not None:
            yield kept

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            sets = [shingles(t, width) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "s"])

    return run


def _verified(least: float):
    def run(batches):
        for b in batches:
            a, c = (b.column(k).to_pylist() for k in (2, 3))
            hit = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(a, c, strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    return run


def similar_duplicates(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(doc_id, node long, component_id) of every row of docs (doc_id, text; more columns are ignored).

    Texts link if the Jaccard similarity of their sets of `width`-word shingles is at least `least` and
    their fingerprints share an anchor; component_id is the least doc_id reachable. Texts with equal sets
    are one node: copies are never paired. First the nearest neighbours of each node are compared;
    of the other pairs that meet, only those not connected by then, but all of them. So a large
    group of near copies costs a multiple of its size; what grows with a square are texts that are nearly
    as alike as that without being so.
    Null and wordless texts have an empty set and link with each other only. Rows that repeat are rows of
    their own. Rows with a null doc_id link too; a component with null ids only has a null component_id.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    fields = ", ".join(f"{f} long" for f in _FP)
    prints = table(texts.mapInArrow(tidy(_printed(width), 1000), f"doc_id long, node long, size int, {fields}"), "sim")
    classes = table(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in ("size", *_FP))), "simc")
    entry = f"key int, node long, label long, size int, {fields}"

    def met(labelled, run):
        e = labelled.select("node", "label", "size", *_FP).mapInArrow(tidy(_homed), entry)
        return e.repartition(parts(spark), "key").sortWithinPartitions("key").mapInArrow(tidy(_whole_keys(run)), "u long, v long, d long")

    def verified(p):
        p = table(p, "simp")
        wanted = table(p.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes.select("node", "rep"), "node"), "simw")
        ids = wanted.select(F.col("rep").alias("__id")).distinct()
        sets = texts.join(ids, texts["doc_id"].eqNullSafe(F.col("__id")), "left_semi").select("text").mapInArrow(tidy(_sets(width), 500), "node long, s binary")
        sets = table(sets.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.min("s").alias("s")), "sims")
        a, b = (sets.select(F.col("node").alias(k), F.col("s").alias(k + "s")) for k in "uv")
        found = table(p.join(a, "u").join(b, "v").select("u", "v", "us", "vs").mapInArrow(tidy(_verified(least), 500), "u long, v long"), "siml")
        for spent in (p, wanted, sets):
            drop_table(spent)
        return found

    # Of the nearest at each anchor: the nearest of all, and two by hashes, so that a group of near copies hangs together.
    pairs = met(classes.withColumn("label", F.col("node")), _closest(least))
    ends = pairs.select("d", F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("o")), F.struct(F.col("v").alias("n"), F.col("u").alias("o")))).alias("x")).select("d", "x.*")
    few = ends.groupBy("n").agg(F.array(*(F.min(F.struct(by.cast("long").alias("by"), "o")) for by in (F.col("d"), F.xxhash64("n", "o"), F.xxhash64("o", "n", F.lit(1))))).alias("few"))
    links = verified(few.select("n", F.explode("few.o").alias("o")).select(F.least("n", "o").alias("u"), F.greatest("n", "o").alias("v")).distinct())
    release(spark)
    labelled = classes.join(components(links), "node", "left").withColumn("label", F.coalesce("component", "node"))
    links = links.unionAll(verified(met(labelled, _apart(least)).select("u", "v")))
    found = components(links)
    named = table(classes.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("label")), "simn")
    least_id = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "label").select(F.col("node").alias("at"), "component_id")
    drop_table(classes)
    return prints.join(named, F.col("node") == F.col("at")).select("doc_id", "node", "component_id")


def one_of_each(docs: DataFrame, near=near_duplicates) -> DataFrame:
    """docs without near duplicates: of each component of near(docs) the rows of its least doc_id, all columns kept.

    Rows that repeat that doc_id all stay; rows without a doc_id stay where their component has no other.
    """
    kept = near(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__kept_id")), "left_semi")


def op9_simhash_near_dedup(spark, sf_dir):
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
ORACLES: dict[str, str] = {}
