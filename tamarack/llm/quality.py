"""Quality classifier: ordinal cumulative-link regression on hashed text.

Graded ratings 0..K-1 follow P(grade <= k) = sigmoid(threshold[k] - score), with one weight vector for all
grades and ordered thresholds. Features are hashed into 2^BITS weights: the presence of each distinct word
and of its first four letters (a word of abuse counts however long the text is), and the shares of tokens
by shape (case, symbols, equal to the token before: how junk shows, whatever its words).
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm.common import tidy, trim_memory

BITS = 18
#: Rows that the model is fitted on at most, taken in order of a hash of doc_id.
MAX_TRAIN_ROWS = 12_000
#: Weight of a share against a presence; times that a feature must occur in the sample; words kept by a task.
SHARE, LEAST, KEPT = 8.0, 3, 300_000
#: G statistic from which a word marks a grade; words that mark none have weight 0.
MARK = 9.0
#: Times that a marking word is likelier in texts of its grade than in all.
LIFT = 2.0

_SHAPES = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1"))


def _slot(kind: bytes, what: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + what) & ((1 << BITS) - 1)


def word_features(word: bytes) -> tuple[int, int, int]:
    """Slots of a word's presence, its prefix's presence and its shape."""
    text = word.decode("utf-8", "replace")
    low = text.lower().strip(".,;:!?*#$%&|\"'()")
    shape = text
    for pattern, to in _SHAPES:
        shape = pattern.sub(to, shape)
    return _slot(b"w", low.encode()), _slot(b"p", low[:4].encode()), _slot(b"s", shape[:16].encode())


AGAIN = _slot(b"s", b"=")


def document_features(text: bytes, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text, sorted by slot."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    present, shares = set(), Counter()
    for w, n in Counter(words).items():
        f = memo.get(w)
        if f is None:
            f = memo[w] = word_features(w)
        present.add(f[0])
        present.add(f[1])
        shares[f[2]] += n
    shares[AGAIN] += sum(map(operator.eq, words, words[1:]))
    value = dict.fromkeys(present, 1.0)
    for s, n in shares.items():
        value[s] = value.get(s, 0.0) + SHARE * n / len(words)
    slots = np.array(sorted(value), np.int32)
    return slots, np.array([value[s] for s in slots.tolist()], np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    means: np.ndarray


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, steps: int = 300, l2: float = 1e-5, rate: float = 0.1) -> Model:
    """Maximum likelihood with an L2 penalty by Adam over all rows; the same input gives the same model."""
    n = len(rows)
    # Rows go a few at a time, and only the entries of used features are kept: all of them are many times the texts' size.
    seen, shape = np.zeros((levels, 1 << BITS), np.int64), np.zeros(1 << BITS, bool)
    for (slot, value), g in zip(rows, grades.tolist()):
        seen[g, slot] += 1
        shape[slot[value != 1.0]] = True
    count = seen.sum(0)
    often = np.zeros(1 << BITS, bool)
    for g in range(levels):
        # Signed G statistic of the rows of this grade among the feature's rows.
        expected = count * max((grades == g).mean() if n else 0.0, 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            often |= (seen[g] >= LEAST) & (seen[g] >= LIFT * expected) & (2 * seen[g] * np.log(seen[g] / expected) >= MARK)
    often[shape] = count[shape] >= LEAST
    used = np.flatnonzero(often)
    at = np.full(1 << BITS, -1)
    at[used] = np.arange(len(used))
    kept = [(at[slot[k]], value[k].astype(np.float64)) for slot, value in rows for k in (often[slot],)]
    row = np.repeat(np.arange(n), np.fromiter((len(s) for s, _ in kept), np.int64, n))
    slot = np.concatenate([s for s, _ in kept]) if n else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in kept]) if n else np.zeros(0)
    del kept, seen
    share = (np.cumsum(np.bincount(grades, minlength=levels))[:-1] + 0.5) / (n + 1.0)
    theta = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(len(used)), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = len(used)
    ids = np.arange(n)
    for step in range(1, steps + 1 if n and len(np.unique(grades)) > 1 else 1):
        score = np.bincount(row, value * p[slot], minlength=n)
        gaps = np.exp(p[k + 1 :])
        theta = p[k] + np.concatenate(([0.0], np.cumsum(gaps)))
        bounds = np.concatenate(([-np.inf], theta, [np.inf]))
        with np.errstate(over="ignore"):
            cdf = 1 / (1 + np.exp(-(bounds[None, :] - score[:, None])))
        hi, lo = cdf[ids, grades + 1], cdf[ids, grades]
        prob = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        g_score = (dhi - dlo) / prob / n
        g_theta = np.zeros(levels - 1)
        inner = grades < levels - 1
        np.add.at(g_theta, grades[inner], -(dhi / prob)[inner] / n)
        inner = grades > 0
        np.add.at(g_theta, grades[inner] - 1, (dlo / prob)[inner] / n)
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate((np.bincount(slot, value * g_score[row], minlength=k) + l2 * p[:k], tail[:1], tail[1:] * gaps))
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = p[:k]
    theta = p[k] + np.concatenate(([0.0], np.cumsum(np.exp(p[k + 1 :]))))
    return Model(weights, theta, np.bincount(grades, minlength=levels) / max(1, n))


def _sample_features(batches):
    memo: dict = {}
    for b in batches:
        found = [document_features(t or b"", memo) for t in b.column(1).to_pylist()]
        off = pa.array(np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32))
        cat = lambda k, d: pa.array(np.concatenate([f[k] for f in found] or [np.zeros(0, d)]).astype(d))
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(off, cat(0, np.int32)), pa.ListArray.from_arrays(off, cat(1, np.float32)), b.column(2)], ["id", "slots", "vals", "grade"])


def train(docs: DataFrame, grades: DataFrame, levels: int, max_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """Fit on the documents of at most max_rows of grades (doc_id, grade int), in order of a hash of doc_id.

    Repeated doc_ids in grades count with their least grade, and null grades and ids not at all. None if no
    graded row has a document.
    """
    graded = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    graded = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("id"), F.col("grade").cast("int").alias("grade"))
    docs = docs.select("doc_id", "text")
    # Bounded by max_rows pairs of numbers.
    j = docs.join(F.broadcast(graded), docs["doc_id"] == F.col("id")).select("id", docs["text"].cast("binary").alias("text"), "grade")
    got = j.mapInArrow(tidy(_sample_features, 500), "id long, slots array<int>, vals array<float>, grade int").toArrow()
    if not got.num_rows:
        return None
    ids, grade = got["id"].to_numpy(), got["grade"].to_numpy()
    rows = []
    # Views of the chunks: no copy of the features is made.
    for b in got.to_batches():
        flat, vals, off = b["slots"].flatten().to_numpy(), b["vals"].flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(b["slots"].offsets.to_numpy()))))
        rows += [(flat[x:y], vals[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    size = np.fromiter((len(r[0]) for r in rows), np.int64, len(rows))
    # Copies of a document with the same doc_id are training rows of their own, the sample's bound holds.
    order = np.lexsort((grade, size, ids))[:max_rows]
    model = fit([rows[k] for k in order], grade[order].astype(np.int64), levels)
    del got, rows, flat, vals
    trim_memory()
    return model


class Scorer:
    def __init__(self, model: Model):
        self.m, self.memo = model, {}

    def score(self, text: bytes | None) -> float | None:
        """Score of a text; None if it has no word."""
        words = (text or b"").split()
        if not words:
            return None
        memo, w = self.memo, self.m.weights
        if len(memo) > KEPT:
            memo.clear()
        seen, shares = {}, 0.0
        for word, n in Counter(words).items():
            f = memo.get(word)
            if f is None:
                a, b, c = word_features(word)
                f = memo[word] = (a, float(w[a]), b, float(w[b]), float(w[c]))
            seen[f[0]] = f[1]
            seen[f[2]] = f[3]
            shares += n * f[4]
        shares += float(w[AGAIN]) * sum(map(operator.eq, words, words[1:]))
        return sum(seen.values()) + SHARE * shares / len(words)

    def tails(self, text: bytes | None) -> list[float]:
        """P(grade >= k) for k = 1 and up; zeros for a text without words."""
        s = self.score(text)
        if s is None:
            return [0.0] * len(self.m.thresholds)
        return [float(1 / (1 + np.exp(np.clip(t - s, -700, 700)))) for t in self.m.thresholds]


def score_documents(docs: DataFrame, model: Model | None, levels: int, least: float = 0.5, rejected: bool = True) -> DataFrame:
    """docs with expected_grade (double), tails (array<double>: P(grade >= 1), ...) and kept (boolean).

    kept: the top grade's probability is at least `least`. A text without words, or null, has expected grade
    0 and goes. Without a model (nothing graded) the first two are null and all is kept. Columns that docs
    has by these names are replaced. rejected: whether documents that go are returned at all.
    """
    added = ["expected_grade", "tails", "kept"]
    docs = docs.drop(*added)
    if model is None:
        return docs.select("*", F.lit(None).cast("double").alias(added[0]), F.lit(None).cast("array<double>").alias(added[1]), F.lit(True).alias(added[2]))
    at, packed, thresholds = docs.columns.index("text"), model.weights.tobytes(), tuple(model.thresholds.tolist())
    names = docs.columns + added
    # The model is 2^BITS floats whatever the input: a broadcast of fixed size.
    held = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        scorer = Scorer(Model(np.frombuffer(held.value, np.float32), np.array(thresholds), np.zeros(0)))
        for b in batches:
            tails = [scorer.tails(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
            kept = pa.array([t[-1] >= least for t in tails], pa.bool_())
            out = pa.record_batch([*b.columns, pa.array([sum(t) for t in tails], pa.float64()), pa.array(tails, pa.list_(pa.float64())), kept], names)
            yield out if rejected else out.filter(kept)

    schema = T.StructType([*docs.schema, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.ArrayType(T.DoubleType())), T.StructField(added[2], T.BooleanType())])
    return docs.mapInArrow(tidy(run, 500), schema)


#: Grades from the labels at hand: 0 of low quality, 1 of good quality but toxic, 2 good.
LEVELS = 3


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, quality, toxic); a null quality has no grade, a null toxic is not toxic."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def rated(spark, docs: DataFrame, sf_dir: str, rejected: bool = True) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, train(docs, grades(labels), LEVELS), LEVELS, rejected=rejected)


def op4_quality_classifier(spark, sf_dir):
    """Per document: doc_id, expected_grade, p_good (P(grade 2)), p_not_low (P(grade 1 or 2)), kept."""
    out = rated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), sf_dir)
    return out.select("doc_id", "expected_grade", F.col("tails")[1].alias("p_good"), F.col("tails")[0].alias("p_not_low"), "kept")


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
