"""Quality rules: counts of whole texts, and a hashed n-gram log-likelihood ratio.

Words and pairs of adjacent words, lower-cased (A-Z), are hashed into 2^bits buckets. Two multinomials over
the buckets are estimated, with add-one smoothing: of the trusted target documents and of the raw corpus,
all of it. A document's ratio is the mean over its n-grams of log p_target - log p_raw; it is kept if that
is at least a fixed threshold, without any random draw.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm.common import tidy

BITS = 16
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.2
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words whose hashes are kept from text to text; bits of a slot in the bitmap of trusted ids.
KEPT, SLOTS = 400_000, 22

_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Hashes of lower-cased words, kept in a bounded memory."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of adjacent words."""
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        return np.concatenate((h * _MULT >> shift, (h[:-1] * np.uint64(3) + (h[1:] ^ h[1:] >> np.uint64(29))) * _MULT >> shift)).astype(np.int64)


def repeated_words(h: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more, the first time included."""
    if len(h) < 4:
        return 0
    with np.errstate(over="ignore"):
        key = h[:-2] * _MULT + (h[1:-1] ^ h[1:-1] >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(5)
        key = (key ^ key >> np.uint64(32)) * _MULT
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    # Equal keys are windows of equal word hashes: checked, so that only a word's own hash counts.
    a, b = order[1:][same], order[:-1][same]
    if not all((h[a + k] == h[b + k]).all() for k in range(3)):
        _, ids = np.unique(np.stack((h[:-2], h[1:-1], h[2:]), 1), axis=0, return_inverse=True)
        twice = np.bincount(ids)[ids] > 1
    else:
        twice = np.zeros(len(key), bool)
        twice[a] = twice[b] = True
    cover = np.zeros(len(h), bool)
    for k in range(3):
        cover[k : len(h) - 2 + k] |= twice
    return int(cover.sum())


def counts(text: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, its words and their hashes."""
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(text.translate(None, _NOT_SYMBOL))
    seen: set[bytes] = set()
    lines = 0
    for line in text.split(b"\n"):
        if line in seen:
            lines += 1
        elif line.split(None, 1):
            seen.add(line)
    return len(words), chars, symbols, lines, repeated_words(h)


def _counted(batches):
    """Rows (bucket, n): the n-grams of a task's texts by bucket."""
    words = Words()
    total = np.zeros(1 << BITS, np.int64)
    for b in batches:
        for text in b.column(0).to_pylist():
            if w := (text or b"").lower().split():
                np.add.at(total, buckets(words.hashes(w)), 1)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def multinomial(texts: DataFrame) -> np.ndarray:
    """n-grams of all texts (text binary) by bucket: 2^BITS numbers, whatever the input."""
    summed = texts.select("text").mapInArrow(tidy(_counted, 1000), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << BITS)
    np.add.at(total, summed["bucket"].to_numpy(), summed["n"].to_numpy())
    return total


def _maybe_trusted(held):
    """Rows whose doc_id (column 0) may be trusted by the bitmap."""

    def run(batches):
        bits = np.frombuffer(held.value, np.uint8)
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy().view(np.uint64)
            slot = _slot(ids)
            ok = (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)
            yield b.filter(pa.array(ok))

    return run


def _slot(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (ids * _MULT >> np.uint64(64 - SLOTS)).astype(np.int64)


def _slots(batches):
    """Bitmap words that a task's ids set: (word, bits)."""
    bits = np.zeros(1 << SLOTS - 3, np.uint8)
    for b in batches:
        s = _slot(b.column(0).to_numpy().view(np.uint64))
        np.bitwise_or.at(bits, s >> 3, np.left_shift(np.uint8(1), (s & 7).astype(np.uint8)))
    words = bits.view(np.int64)
    at = np.flatnonzero(words)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(words[at])], ["word", "bits"])


def ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray | None:
    """Log ratio of each bucket: learned from all of docs (doc_id, text), trusted those whose doc_id is in trusted.

    A bitmap of the trusted ids, of fixed size, keeps most other texts out of the join with these ids; where
    there are so many that it fills up, more texts are shuffled, and the result is the same. None if no
    trusted document has a word.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id"))
    found = ids.mapInArrow(_slots, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << SLOTS - 6, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    held = spark.sparkContext.broadcast(bits.tobytes())
    likely = source.where("doc_id is not null").mapInArrow(_maybe_trusted(held), "doc_id long, text binary")
    # Shuffled at every size: the ids have no bound.
    target = multinomial(likely.join(ids.distinct().hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi"))
    if not target.any():
        return None
    total = np.stack((multinomial(source), target))
    log = np.log(total + 1) - np.log((total + 1).sum(1, keepdims=True))
    return log[1] - log[0]


ADDED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("log_ratio", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed (boolean),
    log_ratio (double) and kept (boolean), in place of columns that docs has by these names.

    A null or wordless text has 0 words, fails and has a null ratio. Without trusted documents the ratio is
    null and does not reject. trusted: doc_ids of the target; repeats and nulls in it do not count. Rows
    that repeat are judged alike; an empty table gives an empty table.
    """
    docs = docs.drop(*ADDED.names)
    ratio = ratios(docs, trusted)
    # 2^BITS doubles, whatever the input.
    held = docs.sparkSession.sparkContext.broadcast(None if ratio is None else ratio.tobytes())
    at, names = docs.columns.index("text"), docs.columns + ADDED.names

    def run(batches):
        llr = None if held.value is None else np.frombuffer(held.value)
        known = Words()
        for b in batches:
            rows = []
            for text in b.column(at).cast(pa.binary()).to_pylist():
                text = text or b""
                raw = text.split()
                low = text.lower().split()
                h = known.hashes(low)
                exact = h if low == raw else known.hashes(raw)
                n = counts(text, raw, exact)
                score = float(llr[buckets(h)].mean()) if llr is not None and low else None
                failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
                rows.append((*n, failed, score, not failed and (score is None or score >= threshold)))
            cols = list(zip(*rows, strict=True)) or [()] * len(ADDED)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.record_batch([*b.columns, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return docs.mapInArrow(tidy(run, 500), T.StructType([*docs.schema, *ADDED]))


def op5_quality_rules(spark, sf_dir):
    """The target is the documents labelled of good quality and not toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and coalesce(toxic, 0) = 0")
    return apply_rules(docs, good).drop("text")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
