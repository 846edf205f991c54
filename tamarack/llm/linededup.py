"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of lower-cased (A-Z) words; two lines are near when one word inserted,
deleted or replaced turns one into the other. A deletion variant is the line without one word, keyed with
the gap that this leaves. Lines of equal length are near exactly if they share a variant and its gap; a
line is near a longer one exactly if it equals one of its variants. So joining equal keys finds all near
pairs and, but for hash collisions, no others; the pairs kept are still verified on the words themselves.

Variants are emitted only for lines that can have a partner: near lines agree on the first or on the last
half of the shorter one, so a line that shares none of its four half-line keys is near no other line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm.common import drop_table, release, table, tidy

#: Words below which a line has no near lines, only exact copies.
MIN_WORDS = 5
#: Variants that a task makes at a time.
FLUSH = 100_000
_I64 = 1 << 63


def _signed(x: int) -> int:
    return x - (x & _I64) * 2


def _halves(words: list[bytes]) -> list[int]:
    """Keys of the halves: as the line itself, and as the longer line of a pair whose shorter has a word less."""
    n = len(words)
    out = []
    for m in (n, n - 1):
        c = (m + 1) // 2
        out.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(words[:c]), m * 2)))
        out.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(words[n - (m - c) :]), m * 2 + 1)))
    return out


LINES = "doc_id long, th long, line int, n int, hi long, lo long, half array<long>"


def _lines(near: bool):
    def run(batches):
        for b in batches:
            doc, th, line, n, hi, lo, half = [], [], [], [], [], [], []
            for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for k, raw in enumerate((text or b"").split(b"\n")):
                    if not (words := raw.lower().split()):
                        continue
                    h = xxhash.xxh3_128_intdigest(b" ".join(words))
                    doc.append(d)
                    th.append(t)
                    line.append(k)
                    n.append(len(words))
                    hi.append(_signed(h >> 64))
                    lo.append(_signed(h & (2 * _I64 - 1)))
                    half.append(_halves(words) if near and len(words) >= MIN_WORDS else None)
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(line, pa.int32()), pa.array(n, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(half, pa.list_(pa.int64()))],
                ["doc_id", "th", "line", "n", "hi", "lo", "half"],
            )

    return run


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def variants(h: np.ndarray) -> np.ndarray:
    """64-bit keys of the line without its k-th word, for each k, from prefix sums of position-weighted hashes."""
    n = len(h)
    mult = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(n, mult, np.uint64))
    with np.errstate(over="ignore"):
        whole = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)))
        shifted = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h[1:] * power[:-1], dtype=np.uint64)))
        return whole[:-1] + (shifted[-1] - shifted)


def whole_key(h: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(np.sum(h * np.cumprod(np.full(len(h), 0x9E3779B97F4A7C15, np.uint64)), dtype=np.uint64))


def _flagged_lines(batches):
    """Of documents with the numbers of lines to look at: those lines' word hashes."""
    for b in batches:
        doc, th, line, words = [], [], [], []
        for d, t, text, at in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            raw = text.split(b"\n")
            for k in at:
                doc.append(d)
                th.append(t)
                line.append(k)
                words.append(_word_hashes(raw[k].lower().split()).tobytes())
        yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(line, pa.int32()), pa.array(words, pa.binary())], ["doc_id", "th", "line", "words"])


def _variant_rows(batches):
    """Rows (key, gap, doc_id, th, line): each line without its word number gap, and itself with gap -1.

    Lines are taken together only up to FLUSH variants, however long they are.
    """
    for b in batches:
        keys, gaps, rows, n = [], [], [], 0
        lines = b.column(3).to_pylist()
        for r, w in enumerate(lines):
            h = np.frombuffer(w, np.uint64)
            keys += [variants(h), np.array([whole_key(h)], np.uint64)]
            gaps.append(np.arange(len(h) + 1, dtype=np.int32))
            gaps[-1][-1] = -1
            rows.append(np.full(len(h) + 1, r, np.int32))
            n += len(h) + 1
            if n >= FLUSH or r == len(lines) - 1:
                at = pa.array(np.concatenate(rows))
                yield pa.record_batch(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(gaps)), *[b.column(k).take(at) for k in range(3)]],
                    ["key", "gap", "doc_id", "th", "line"],
                )
                keys, gaps, rows, n = [], [], [], 0


def near_words(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one word inserted, deleted or replaced at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    p = int(differ[0]) if len(differ) else m
    x, y = a[p + (len(a) >= len(b)) :], b[p + (len(b) >= len(a)) :]
    return len(x) == len(y) and bool((x == y).all())


def _verified(batches):
    for b in batches:
        ok = [near_words(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
        yield pa.record_batch([b.column(k).filter(pa.array(ok, pa.bool_())) for k in range(3)], ["doc_id", "th", "line"])


def _pos(prefix: str = ""):
    """Order of lines: by doc_id, null last, then by the text's hash and the line's number."""
    return F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"), F.col("line").alias("line"))


def kept_lines(docs: DataFrame, max_edits: int = 1) -> DataFrame:
    """(doc_id, th, keep array<int>, near array<int>): by document, its lines that no earlier line repeats.

    keep: numbers of the lines that are the first of their words; near: those of them that go because an
    earlier line is near. A document (doc_id and th, its text's hash) none of whose lines has a word or is
    a first one has no row. max_edits is 1, or 0 for exact copies only.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    spark = docs.sparkSession
    text = F.col("text").cast("binary").alias("text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), text).where(F.col("text").isNotNull())
    lines = keyed.mapInArrow(tidy(_lines(bool(max_edits)), 500), LINES)
    first = table(lines.groupBy("hi", "lo").agg(F.min(_pos()).alias("p"), F.first("half").alias("half")).select("p.doc_id", "p.th", "p.line", "half"), "line")
    release(spark)
    rows = first.select("doc_id", "th", "line", F.lit(False).alias("near"))
    if max_edits:
        half = first.where("half is not null").select(F.explode("half").alias("key"), "doc_id", "th", "line")
        shared = half.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        shared = table(shared, "shared")
        flagged = half.join(shared, "key").groupBy("doc_id", "th").agg(F.collect_set("line").alias("at"))
        flagged = flagged.withColumnsRenamed({"doc_id": "fd", "th": "ft"})
        j = keyed.join(flagged, F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("th") == F.col("ft")))
        words = table(j.select("doc_id", "th", "text", "at").mapInArrow(tidy(_flagged_lines, 500), "doc_id long, th long, line int, words binary"), "words")
        release(spark)
        v = words.select("doc_id", "th", "line", "words").mapInArrow(tidy(_variant_rows, 2000), "key long, gap int, doc_id long, th long, line int")
        v = table(v, "variant")
        short, same = v.where("gap < 0"), v.where("gap >= 0")
        # Written tables, so that AQE can split a key that many lines share.
        by_gap = table(same.groupBy("key", "gap").agg(F.min(_pos()).alias("e"), F.count("*").alias("c")).where("c > 1").select("key", "gap", "e"), "least")
        by_short = table(short.groupBy("key").agg(F.min(_pos()).alias("e")), "least")
        by_long = table(same.join(short.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(_pos()).alias("e")), "least")
        release(spark)
        pairs = same.join(by_gap, ["key", "gap"]).where(_pos() > F.col("e")).select("doc_id", "th", "line", "e")
        pairs = pairs.unionAll(same.join(by_short, "key").where(_pos() > F.col("e")).select("doc_id", "th", "line", "e"))
        pairs = pairs.unionAll(short.join(by_long, "key").where(_pos() > F.col("e")).select("doc_id", "th", "line", "e"))
        pairs = table(pairs.distinct(), "pair")
        release(spark)
        pairs = pairs.select("doc_id", "th", "line", F.col("e.doc_id").alias("ed"), F.col("e.th").alias("et"), F.col("e.line").alias("el"))
        mine = words.select(*[F.col(c).alias("m_" + c) for c in ("doc_id", "th", "line", "words")])
        other = words.select(*[F.col(c).alias("o_" + c) for c in ("doc_id", "th", "line", "words")])
        pairs = pairs.join(mine, F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("th") == F.col("m_th")) & (F.col("line") == F.col("m_line")))
        pairs = pairs.join(other, F.col("ed").eqNullSafe(F.col("o_doc_id")) & (F.col("et") == F.col("o_th")) & (F.col("el") == F.col("o_line")))
        near = pairs.select("doc_id", "th", "line", "m_words", "o_words").mapInArrow(tidy(_verified), "doc_id long, th long, line int")
        near = table(near, "near")
        drop_table(v)
        drop_table(words)
        release(spark)
        rows = rows.unionAll(near.select("doc_id", "th", "line", F.lit(True)))
    return rows.groupBy("doc_id", "th").agg(F.collect_set(F.when(~F.col("near"), F.col("line"))).alias("keep"), F.collect_set(F.when(F.col("near"), F.col("line"))).alias("near"))


def _cut(text_at: int, width: int, names: list[str]):
    def run(batches):
        for b in batches:
            texts, counts = [], [[], [], []]
            for text, keep, near in zip(*(b.column(k).to_pylist() for k in (text_at, width, width + 1)), strict=True):
                if text is None:
                    lines = kept = []
                else:
                    stay = set(keep or ()) - set(near or ())
                    lines = text.split("\n")
                    kept = [x for k, x in enumerate(lines) if k in stay or not x.encode().split()]
                    text = "\n".join(kept)
                texts.append(text)
                for c, n in zip(counts, (len(lines), len(lines) - len(kept) - len(near or ()), len(near or ())), strict=True):
                    c.append(n)
            cols = [pa.array(texts, pa.string()) if k == text_at else b.column(k) for k in range(width)]
            yield pa.record_batch(cols + [pa.array(c, pa.int64()) for c in counts], names)

    return run


def dedup_lines(docs: DataFrame, max_edits: int = 1) -> DataFrame:
    """docs with, in text, only lines that no earlier line repeats or is near to, and the counts of others.

    Lines are split at \\n and ordered by doc_id (null last), text hash and line number; of equal ones (after
    lower-casing A-Z and taking the words) the first stays, and a first one goes if an earlier line, kept or
    not, is near (max_edits words; lines of under MIN_WORDS words have exact copies only). Lines without a
    word stay. Added: n_lines, n_copies, n_near (long), in place of columns that docs has by these names. A
    null text stays null with 0 lines. Rows that repeat doc_id and text get the same lines. All other columns
    of docs are kept; an empty table gives an empty table.
    """
    added = ["n_lines", "n_copies", "n_near"]
    docs = docs.drop(*added)
    plan = kept_lines(docs, max_edits).select(*[F.col(c).alias(f"__plan_{c}") for c in ("doc_id", "th", "keep", "near")])
    j = docs.join(plan, docs["doc_id"].eqNullSafe(F.col("__plan_doc_id")) & (F.xxhash64(docs["text"]) == F.col("__plan_th")), "left")
    j = j.select(*[docs[c] for c in docs.columns], "__plan_keep", "__plan_near")
    schema = T.StructType(list(docs.schema) + [T.StructField(c, T.LongType()) for c in added])
    return j.mapInArrow(tidy(_cut(docs.columns.index("text"), len(docs.columns), docs.columns + added), 500), schema)


def op6_line_dedup(spark, sf_dir):
    """Per document: doc_id, text (the lines kept), n_lines, n_copies, n_near."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_copies", "n_near")


#: Copies by the text of their words; near lines by the texts of all their deletion variants.
_ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM l),
p AS (SELECT *, array_to_string(ws, ' ') AS key, row_number() OVER (ORDER BY doc_id, k) AS pos FROM w),
f AS (SELECT key, ws, pos FROM p WHERE len(ws) > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1),
v AS (SELECT pos, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS cut FROM f, unnest(range(1, len(ws) + 1)) t(i) WHERE len(ws) >= 5),
s AS (SELECT key, pos FROM f WHERE len(ws) >= 5),
a AS (SELECT pos FROM v QUALIFY min(pos) OVER (PARTITION BY cut, i) < pos),
m AS (SELECT v.pos AS long_pos, s.pos AS short_pos FROM v JOIN s ON s.key = v.cut),
n AS (SELECT pos FROM a UNION SELECT long_pos FROM m WHERE short_pos < long_pos UNION SELECT short_pos FROM m WHERE long_pos < short_pos),
r AS (SELECT p.*, len(p.ws) = 0 OR f.pos IS NOT NULL AND n.pos IS NULL AS stays, n.pos IS NOT NULL AS near FROM p LEFT JOIN f ON f.pos = p.pos LEFT JOIN n ON n.pos = p.pos),
g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE stays) AS text, count(*) AS n_lines, count(*) FILTER (WHERE near) AS n_near, count(*) FILTER (WHERE NOT stays AND NOT near) AS n_copies FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(g.text, '') END AS text, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_copies, 0)::BIGINT AS n_copies, coalesce(g.n_near, 0)::BIGINT AS n_near FROM documents d LEFT JOIN g USING (doc_id)"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": _ORACLE}
