"""Language identification, words first.

A model holds, by language, log frequencies of known words and of character n-grams (1 to MAX_GRAM, the
word within boundary marks). A known word scores by its own log frequencies; an unseen word is covered from
left to right by the longest known n-grams, each backing off to one character less where it is unknown.
"""

from __future__ import annotations

import functools
import heapq
import math
import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm.common import tidy

#: Documents of each language that the model is fitted on at most, in order of a hash of their doc_id; words
#: taken of each of them at most; times that a word must occur in all; longest n-gram; words kept by a task.
MAX_TRAIN_DOCS, MAX_TRAIN_WORDS, LEAST, MAX_GRAM, KEPT = 400, 2000, 2, 4, 500_000
#: Tasks a language, from step to step, among which the choice of these documents is spread.
SPREADS = (512, 8, 1)
#: Logarithm by which each step of backing off to a shorter n-gram lowers a score.
BACKOFF = math.log(0.4)


@dataclass
class Model:
    langs: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    prior: np.ndarray


def _clean(word: str) -> str:
    """Lower-cased letters of a token, marks and digits off its ends."""
    return word.lower().strip("0123456789.,;:!?*#$%&|<>\"'()[]{}=_-+/\\@«»¿¡…“”„")


def _logs(counts: dict[str, Counter], langs: list[str], least: int) -> dict[str, np.ndarray]:
    every = Counter()
    for c in counts.values():
        every.update(c)
    kept = sorted(k for k, n in every.items() if n >= least)
    table = np.array([[counts[lang][k] for lang in langs] for k in kept], float).reshape(-1, len(langs))
    table = np.log(table + 0.5) - np.log(table.sum(0) + 0.5 * (len(kept) + 1))
    return dict(zip(kept, table, strict=True))


def grams(word: str, n: int):
    s = f"^{word}$"
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def fit(texts: list[tuple[str, str]]) -> Model | None:
    """Model of (lang, text) pairs; None of none. The same pairs in any order give the same model."""
    langs = sorted({lang for lang, _ in texts})
    if not langs:
        return None
    words = {lang: Counter() for lang in langs}
    for lang, text in texts:
        words[lang].update(w for t in text.split() if any(map(str.isalpha, w := _clean(t))))
    pieces = {n: {lang: Counter() for lang in langs} for n in range(1, MAX_GRAM + 1)}
    for lang in langs:
        for w, c in words[lang].items():
            for n in pieces:
                for g in grams(w, n):
                    pieces[n][lang][g] += c
    known = {g: v for n in pieces for g, v in _logs(pieces[n], langs, LEAST).items()}
    # Equal priors: the share of a language in a sample says nothing about a text.
    return Model(langs, _logs(words, langs, LEAST), known, np.zeros(len(langs)))


class Predictor:
    def __init__(self, model: Model):
        self.m, self.memo = model, {}
        self.none = np.zeros(len(model.langs))

    def word(self, token: str) -> np.ndarray | None:
        """Log frequencies of a token, None if it has no letter."""
        w = _clean(token)
        if not any(map(str.isalpha, w)):
            return None
        v = self.m.words.get(w)
        if v is not None:
            return v
        s, i, total, known = f"^{w}$", 0, self.none, self.m.grams
        while i < len(s):
            for n in range(min(MAX_GRAM, len(s) - i), 0, -1):
                v = known.get(s[i : i + n])
                if v is not None:
                    total = total + v + BACKOFF * (MAX_GRAM - n)
                    break
            i += n
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its share among the languages' likelihoods a word, 0 to 1); ("und", 0.0) without a letter."""
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        memo = self.memo
        if len(memo) > KEPT:
            memo.clear()
        total, n = self.none.copy(), 0
        for token, c in Counter(text.split()).items():
            v = memo.get(token, memo)
            if v is memo:
                v = memo[token] = self.word(token)
            if v is not None:
                total += c * v
                n += c
        if not n:
            return "und", 0.0
        mean = total / n
        share = np.exp(mean - mean.max())
        best = int(total.argmax())
        return self.m.langs[best], float(share[best] / share.sum())


def held_out(doc_id, parts: int = 4, left: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == left, F.lit(False))


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model | None:
    """Fit on docs (doc_id, text, lang): of each language at most max_docs with a text and lang that aren't null.

    A bounded sample, in order of a hash of doc_id, rows that repeat counting once: of each document MAX_TRAIN_WORDS words at most, spread
    over the whole text. Languages come from the data; the sample has max_docs rows of each of them.
    """
    usable = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    # Each task passes on the least max_docs keys of a language.
    ids = usable.select("lang", "doc_id").mapInArrow(_least(max_docs), "lang string, h long, doc_id long")
    # Ever fewer tasks a language take the least of the tasks before: none reads more than its share of what those pass on.
    for spread in SPREADS:
        least = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(spread))).orderBy("h", "doc_id")
        ids = ids.distinct().withColumn("r", F.row_number().over(least)).where(F.col("r") <= max_docs).drop("r")
    ids = ids.select("lang", "doc_id")
    ids = ids.withColumnsRenamed({"lang": "picked_lang", "doc_id": "picked"})
    j = usable.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("picked")) & (F.col("lang") == F.col("picked_lang"))).select("lang", "text", "doc_id")
    got = j.mapInArrow(_spread, "lang string, text string, doc_id long").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).toArrow()
    return fit(sorted(zip(got["lang"].to_pylist(), got["text"].to_pylist(), strict=True)))


def _least(n: int):
    def run(batches):
        held: dict[str, list] = {}
        inside = set()
        for b in batches:
            for lang, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = xxhash.xxh3_64_intdigest(str(d).encode()) >> 1
                heap, x = held.setdefault(lang, []), (-h, -1 if d is None else d, d)
                if (lang, x) in inside or len(heap) == n and -h <= heap[0][0]:
                    continue
                inside.add((lang, x))
                if len(heap) < n:
                    heapq.heappush(heap, x)
                else:
                    inside.discard((lang, heapq.heapreplace(heap, x)))
        rows = [(lang, -h, d) for lang, heap in held.items() for h, _, d in heap]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "h", "doc_id"])

    return run


def _spread(batches):
    for b in batches:
        texts = []
        for t in b.column(1).to_pylist():
            w = t.split()
            texts.append(" ".join(w[:: -(-len(w) // MAX_TRAIN_WORDS)] if w else w))
        yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), b.column(2)], ["lang", "text", "doc_id"])


@functools.lru_cache(maxsize=2)
def _predictor(packed: bytes) -> Predictor:
    return Predictor(pickle.loads(packed))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred (string) and score (double), in place of columns that docs has by these names.

    Only text is read. A null text, or one without a letter, is `und` with score 0; so is every one without
    a model. Rows that repeat are predicted alike; an empty table gives an empty table.
    """
    added = ["lang_pred", "score"]
    docs = docs.drop(*added)
    at, names = docs.columns.index("text"), docs.columns + added
    # Bounded by the training sample's words, whatever the input.
    held = docs.sparkSession.sparkContext.broadcast(None if model is None else pickle.dumps(model))

    def run(batches):
        p = None if held.value is None else _predictor(held.value)
        for b in batches:
            out = [("und", 0.0) if p is None else p.predict(t) for t in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names)

    return docs.mapInArrow(tidy(run, 500), T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op8_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(marked.where("not held_out").select("doc_id", "text", "lang"))
    return identify(marked.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
