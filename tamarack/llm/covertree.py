"""Embedding near-dedup by dual traversal of cover trees.

Vectors are scaled to unit length, where a cosine is a chord. Centres from a farthest-first net over a
bounded sample are the top level; vectors go to their nearest centre, and a centre's vectors into blocks of
bounded size, at random if there are many. Each block is a cover tree: nested nets with halving radii, each
node holding its centre and its true covering radius. Pairs of blocks are traversed level by level: a pair
of nodes is dropped if their centres are farther apart than the threshold and both radii, taken whole if
threshold and radii leave no doubt, and opened otherwise, down to pairs of vectors, which are compared in
double precision. Equal vectors are one row. Only links' counts and a spanning forest leave a task.

Vectors whose distances all are alike (many dimensions, no structure) leave nothing to prune: every pair of
blocks is then compared at the level where nodes are groups of near copies.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import components, parts, table, tidy
from tamarack.llm.simhash import forest

#: Vectors of a block, rows of the sample that centres come from, centres at most, radii of the levels.
BLOCK, SAMPLE, CENTRES = 2048, 4096, 256
RADII = (2.0, 1.0, 0.5, 0.25, 0.125, 0.0625)
#: Doubt left to rounding when nodes are dropped or taken whole.
SLACK = 1e-9
#: Error of a chord from a product in single precision, at most: that of a cosine, 1e-6, counts most at chord 0.
ROUGH = 2e-3


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow or underflow on the way."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def net(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x that are n centres, farthest first; fewer if the rest are equal to some."""
    picked, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(n, len(x)):
        k = int(far.argmax())
        if far[k] <= 0:
            break
        picked.append(k)
        far = np.minimum(far, np.linalg.norm(x - x[k], axis=1))
    return np.array(picked)


def build(x: np.ndarray):
    """(order, levels): rows of x in the tree's order; of each level first row, centre row, covering radius
    and first child of its nodes, all by place in that order. The last level is the rows themselves."""
    n = len(x)
    gram = x @ x.T
    label = np.zeros((len(RADII), n), np.int64)
    centre = np.zeros((len(RADII), n), np.int64)
    groups = [(0, np.arange(n))]
    for level, radius in enumerate(RADII):
        least = 1 - radius * radius / 2
        new, nxt = 0, []
        for head, rows in groups:
            while len(rows):
                # The parent's centre is a centre of this level too; then the first row that is left.
                c = head if head in (rows[:1] if len(rows) == 1 else rows) else int(rows[0])
                near = np.ones(len(rows), bool) if level == 0 else gram[c, rows] >= least
                near |= rows == c
                got = rows[near]
                label[level, got], centre[level, got] = new, c
                nxt.append((c, got))
                new += 1
                rows = rows[~near]
                head = -1
        groups = nxt
    order = np.lexsort((np.arange(n), *label[::-1]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    y = x[order]
    levels = []
    for level in range(len(RADII)):
        lab = label[level, order]
        first = np.flatnonzero(np.diff(lab, prepend=-1))
        c = place[centre[level, order][first]]
        dist = np.linalg.norm(y - y[np.repeat(c, np.diff(np.append(first, n)))], axis=1)
        levels.append((first, c, np.maximum.reduceat(dist, first) if n else dist))
    levels.append((np.arange(n), np.arange(n), np.zeros(n)))
    return order, [(f, c, r, np.searchsorted(levels[k + 1][0], f) if k + 1 < len(levels) else None) for k, (f, c, r) in enumerate(levels)]


def _open(first, last):
    """Children first..last of each pair, flattened: (pair, child)."""
    n = last - first
    pair = np.repeat(np.arange(len(n)), n)
    return pair, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[pair]


def _chords(x, y, a, b):
    """Distances of rows a of x to rows b of y, a bounded number at a time."""
    out = np.empty(len(a))
    step = 1 << 17
    for k in range(0, len(a), step):
        d = x[a[k : k + step]] - y[b[k : k + step]]
        out[k : k + step] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def traverse(x, tx, y, ty, cosine: float, same: bool):
    """Links between the blocks x and y: (pairs of rows, pairs of row ranges that are linked whole)."""
    delta = math.sqrt(max(0.0, 2 - 2 * cosine))
    nx, ny = len(x), len(y)
    pa_, pb = np.zeros(1, np.int64), np.zeros(1, np.int64)
    singles, whole = [], []
    d, slack = None, SLACK
    for level in range(len(tx)):
        (fa, ca, ra, ka), (fb, cb, rb, kb) = tx[level], ty[level]
        if d is None:
            d, slack = _chords(x, y, ca[pa_], cb[pb]), SLACK
        reach = ra[pa_] + rb[pb]
        alive = d - reach <= delta + slack
        if ka is None:
            pa_, pb = pa_[alive], pb[alive]
            for k in range(0, len(pa_), 1 << 17):
                i, j = pa_[k : k + (1 << 17)], pb[k : k + (1 << 17)]
                ok = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
                if same:
                    ok &= i != j
                singles.append((i[ok], j[ok]))
            break
        ends_a, ends_b = np.append(fa[1:], nx), np.append(fb[1:], ny)
        sure = alive & (d + reach <= delta - max(slack, 1e-7)) & (reach > 0)
        if sure.any():
            whole.append((fa[pa_[sure]], ends_a[pa_[sure]], fb[pb[sure]], ends_b[pb[sure]]))
        go = alive & ~sure
        pa_, pb = pa_[go], pb[go]
        la, lb = len(tx[level + 1][0]), len(ty[level + 1][0])
        na, nb = np.append(ka[1:], la)[pa_] - ka[pa_], np.append(kb[1:], lb)[pb] - kb[pb]
        if int((na * nb).sum()) * 25 > la * lb and la * lb > 1 << 16:
            # As a matrix of children whose parents are open, bounded by the blocks' sizes.
            open_ = np.zeros((len(fa), len(fb)), bool)
            open_[pa_, pb] = True
            pra, prb = np.repeat(np.arange(len(fa)), np.diff(np.append(ka, la))), np.repeat(np.arange(len(fb)), np.diff(np.append(kb, lb)))
            ca2, ra2, cb2, rb2 = tx[level + 1][1], tx[level + 1][2], ty[level + 1][1], ty[level + 1][2]
            # In single precision with some slack first: what is left is few, and looked at closely.
            gram = x[ca2].astype(np.float32) @ y[cb2].astype(np.float32).T
            reach2 = np.add.outer((delta + ROUGH + ra2).astype(np.float32), rb2.astype(np.float32))
            np.multiply(reach2, reach2, out=reach2)
            reach2 *= np.float32(-0.5)
            reach2 += np.float32(1 - 1e-5)
            pa_, pb = np.nonzero(gram >= reach2)
            keep = open_[pra[pa_], prb[pb]]
            pa_, pb = pa_[keep], pb[keep]
            # Distances good to ROUGH: enough to drop and to take whole with as much slack.
            d, slack = np.sqrt(np.maximum(0, 2 - 2 * gram[pa_, pb])).astype(np.float64), ROUGH
        else:
            pair, child = _open(ka[pa_], ka[pa_] + na)
            pair2, child2 = _open(kb[pb[pair]], (kb[pb] + nb)[pair])
            pa_, pb, d = child[pair2], child2, None
        if not len(pa_):
            break
    return singles, whole


def linked(x, tx, wx, idx, y, ty, wy, idy, cosine: float, same: bool):
    """(id, links) of the rows of both blocks and (u, v) of a spanning forest; w: rows that a row stands for."""
    singles, whole = traverse(x, tx, y, ty, cosine, same)
    na, nb = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    us, vs = [], []
    for i, j in singles:
        np.add.at(na, i, wy[j])
        np.add.at(nb, j, wx[i])
        us.append(idx[i])
        vs.append(idy[j])
    cx, cy = np.concatenate(([0], np.cumsum(wx))), np.concatenate(([0], np.cumsum(wy)))
    for a0, a1, b0, b1 in whole:
        # Ranges add the weight of the other side to each of their rows: by differences.
        da, db = np.zeros(len(x) + 1, np.int64), np.zeros(len(y) + 1, np.int64)
        np.add.at(da, a0, cy[b1] - cy[b0])
        np.add.at(da, a1, -(cy[b1] - cy[b0]))
        np.add.at(db, b0, cx[a1] - cx[a0])
        np.add.at(db, b1, -(cx[a1] - cx[a0]))
        na += np.cumsum(da)[:-1]
        nb += np.cumsum(db)[:-1]
        pair, row = _open(a0, a1)
        us.append(idx[row])
        vs.append(idy[b0[pair]])
        pair, row = _open(b0, b1)
        us.append(idx[a0[pair]])
        vs.append(idy[row])
        if same:
            # A range linked to itself counts each row once too often.
            own = (a0 == b0) & (a1 == b1)
            _, row = _open(a0[own], a1[own])
            np.subtract.at(na, row, wx[row])
    u, v = np.concatenate(us or [np.zeros(0, np.int64)]), np.concatenate(vs or [np.zeros(0, np.int64)])
    keep = u != v
    u, v = forest(u[keep], v[keep]) if keep.any() else (u[:0], v[:0])
    ids, n = (idx, na) if same else (np.concatenate((idx, idy)), np.concatenate((na, nb)))
    return ids[n > 0], n[n > 0], u, v


def _matrix(column) -> np.ndarray:
    """Vectors of one length, of a list column, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _assign(centres: dict):
    def run(batches):
        for b in batches:
            dims = b.column(3).to_numpy()
            out = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = unit(_matrix(b.column(2).take(pa.array(rows))))
                out[rows] = (x @ centres[int(dim)].T).argmax(1) if int(dim) in centres else 0
            yield pa.record_batch([*b.columns, pa.array(out)], ["rep", "cnt", "emb", "dim", "centre"])

    return run


def _built(batches):
    """Rows of a block, sorted by block, as one row: block, dim and the packed tree."""
    held: list = []
    key = None

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        raw = _matrix(t.column("emb").combine_chunks())
        order, levels = build(unit(raw))
        # Single precision where that loses nothing, as with vectors that came in it.
        single = raw.astype(np.float32)
        raw = single if (single == raw).all() else raw
        packed = pickle.dumps((raw[order], t.column("cnt").to_numpy()[order], t.column("rep").to_numpy()[order], levels))
        return pa.record_batch([pa.array([key], pa.string()), pa.array([packed], pa.binary())], ["block", "packed"])

    for b in batches:
        names = b.column(3).to_pylist()
        cuts = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if held and names[lo] != key:
                yield out()
                held = []
            key = names[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield out()


def _load(packed: bytes):
    raw, counts, ids, levels = pickle.loads(packed)
    return unit(raw.astype(np.float64)), counts, ids, levels


def _compared(cosine: float):
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                same = b.column(0)[k].as_py() == b.column(1)[k].as_py()
                x, wx, idx, tx = _load(b.column(2)[k].as_py())
                y, wy, idy, ty = (x, wx, idx, tx) if same else _load(b.column(3)[k].as_py())
                ids, n, u, v = linked(x, tx, wx, idx, y, ty, wy, idy, cosine, same)
                yield pa.record_batch([pa.array(np.concatenate((ids, u))), pa.array(np.concatenate((n * 0, v))), pa.array(np.concatenate((n, u * 0)))], ["u", "v", "n"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links long, component_id long, kept boolean) of every row of vectors (vec_id, embedding).

    Rows link if their vectors' cosine, in double precision, is at least `cosine`. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do rows without a vec_id (whose
    component_id is null and which aren't kept) and vectors of different lengths. Rows that repeat are rows
    of their own: equal ones link; rows that share a vec_id are in one component. Other columns are ignored;
    an empty table gives an empty table.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine is above 0 and at most 1")
    spark = vectors.sparkSession
    n_parts = parts(spark)
    emb = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & emb.isNotNull() & F.forall(emb, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(emb, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, emb).alias("emb"))
    classes = table(rows.where("emb is not null").groupBy("emb").agg(F.min("vec_id").alias("rep"), F.count("*").alias("cnt")).select("rep", "cnt", "emb", F.size("emb").alias("dim")), "classes")
    total = classes.count()
    # A bounded sample, by a hash of the vector, only fixes the centres; every vector is assigned and compared.
    sample = classes.orderBy(F.xxhash64("emb"), "rep").select("emb", "dim").limit(SAMPLE).toArrow()
    dims = np.asarray(sample["dim"])
    centres = {}
    for dim in np.unique(dims):
        x = unit(_matrix(sample["emb"].combine_chunks().take(pa.array(np.flatnonzero(dims == dim)))))
        centres[int(dim)] = x[net(x, max(1, min(CENTRES, total // BLOCK)))]
    placed = table(classes.mapInArrow(_assign(centres), "rep long, cnt long, emb array<double>, dim int, centre int"), "placed")
    # At most CENTRES rows for each length of vectors.
    sizes = placed.groupBy("dim", "centre").agg(F.count("*").alias("k"))
    part = F.pmod(F.xxhash64("emb"), F.ceil(F.col("k") / BLOCK))
    named = placed.join(F.broadcast(sizes), ["dim", "centre"]).select("rep", "cnt", "emb", F.concat_ws(":", "dim", "centre", part).alias("block"))
    blocks = table(named.repartition(n_parts, "block").sortWithinPartitions("block").mapInArrow(tidy(_built), "block string, packed binary"), "blocks")
    key = blocks.select("block", F.substring_index("block", ":", 1).alias("dim"), F.substring_index("block", ":", 2).alias("at"))
    found = _block_pairs(key, centres, placed, cosine)
    both = found.join(blocks.select(F.col("block").alias("a"), F.col("packed").alias("x")), "a").join(blocks.select(F.col("block").alias("b"), F.col("packed").alias("y")), "b")
    links = table(both.select("a", "b", "x", "y").mapInArrow(tidy(_compared(cosine)), "u long, v long, n long"), "links")
    counts = links.where("n > 0").groupBy("u").agg(F.sum("n").alias("n"))
    joined = components(links.where("n = 0").select("u", "v"))
    named = classes.join(counts, classes["rep"] == counts["u"], "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = table(named.select(F.col("emb").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("cnt") - 1).alias("links"), F.coalesce("component", "rep").alias("comp")), "named")
    out = rows.join(named, F.col("emb") == F.col("of"), "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("comp", "vec_id"), F.lit(False)).alias("kept"))


def _block_pairs(key: DataFrame, centres: dict, placed: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose centres' covering radii don't rule out a link."""
    spark = key.sparkSession
    delta = math.sqrt(max(0.0, 2 - 2 * cosine))
    # At most CENTRES rows for each length: the farthest vector of each centre.
    held = spark.sparkContext.broadcast(centres)

    def radii(batches):
        for b in batches:
            dims, at = b.column(1).to_numpy(), b.column(2).to_numpy()
            dist = np.zeros(len(dims))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if int(dim) in held.value:
                    x = unit(_matrix(b.column(0).take(pa.array(rows))))
                    dist[rows] = np.linalg.norm(x - held.value[int(dim)][at[rows]], axis=1)
            yield pa.record_batch([b.column(1), b.column(2), pa.array(dist)], ["dim", "centre", "dist"])

    far = placed.select("emb", "dim", "centre").mapInArrow(radii, "dim int, centre int, dist double").groupBy("dim", "centre").agg(F.max("dist").alias("r")).collect()
    radius = {(r["dim"], r["centre"]): r["r"] for r in far}
    near = []
    for (dim, a), ra in radius.items():
        for (dim2, b), rb in radius.items():
            if dim == dim2 and a <= b:
                c = centres.get(dim)
                if c is None or np.linalg.norm(c[a] - c[b]) <= delta + ra + rb + 1e-6:
                    near.append((f"{dim}:{a}", f"{dim}:{b}"))
    near = spark.createDataFrame(near, "pa string, pb string") if near else spark.createDataFrame([], "pa string, pb string")
    left, right = key.select(F.col("block").alias("a"), F.col("at").alias("pa")), key.select(F.col("block").alias("b"), F.col("at").alias("pb"))
    j = near.join(left, "pa").join(right, "pb")
    return j.where("pa <> pb or a <= b").select("a", "b")


def op3_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair of vectors, and the links' closure.
_ORACLE = """
WITH RECURSIVE n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
c AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT p.w, c.root FROM c JOIN p ON p.u = c.node),
k AS (SELECT u, count(*) AS n FROM p GROUP BY u), m AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.root AS component_id, vec_id = m.root AS kept FROM embeddings e JOIN m ON m.node = e.vec_id LEFT JOIN k ON k.u = e.vec_id"""

QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup}
ORACLES = {"op3_embedding_near_dedup": _ORACLE}
