"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key. Keys are cut into ranges (buckets) that are sorted on their own;
prefix sums of sizes over a source are bucket totals plus sums within the bucket, so that no source,
however large, meets in one task. A source's budget is cut exactly: it gets whole epochs of all its
rows, then the rows in key order, of the last one only as many words as the budget still holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import WORD, table

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (3.0, 1.0, 2.0)
#: Rows that a bucket holds on average.
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """Hex digest, the same in any SQL engine; null ids share one key."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of each source from its (source, source_size), one row per source.

    Sources in code-point order, null last, get the weights in turn. All share `share` of the total;
    none gets over `most` times its size, and what is above is reshared by weight until none is: with
    sources in order of size/weight, those that fill up come first, and the first that doesn't fixes
    the level of the rest. Sources of size 0 get 0.
    """
    if share > most:
        raise ValueError("share may not exceed most")
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.select("source", "source_size", w.alias("weight"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(every)
    s = s.withColumn("level", (total * F.lit(share) - before * F.lit(most)) / rest)
    s = s.withColumn("open", F.col("level") <= F.col("source_size") * F.lit(most) / F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(every)["level"]
    target = F.least(F.col("source_size") * F.lit(most), F.coalesce(level * F.col("weight"), F.col("source_size") * F.lit(most)))
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, epochs.

    docs: doc_id, source, text; further columns are ignored. size: words of the text, 0 for a null or
    empty one. taken: words that the mix takes of the document, at most `most` times its size; over a
    source they sum to its target, rounded down. epochs: whole times that the document is taken, the
    part of a cut document not among them. Null sources are one source. Rows with equal keys (null or
    repeated ids) are ordered by size; equal ones among them are interchangeable. An empty table gives
    an empty table; a source whose texts have no words takes nothing.
    """
    sized = table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("k")), "mix")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    n = per_source.agg(F.sum("rows").alias("rows")).first()["rows"] or 0
    buckets = 1 << max(8, (n // BUCKET_ROWS).bit_length())
    digits = (buckets.bit_length() + 2) // 4
    b = F.substring("k", 1, digits)
    rows = sized.withColumn("b", b)
    # Prefix of each bucket within its source: a table of (sources x buckets) rows.
    totals = rows.groupBy("source", "b").agg(F.sum("size").alias("s"))
    offsets = totals.select("source", "b", (F.sum("s").over(Window.partitionBy("source").orderBy("b")) - F.col("s")).alias("offset"))
    goal = targets(per_source.select("source", "source_size"), weights, share, most)
    goal = offsets.join(goal.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src"))).select("source", "b", "offset", "source_size", "target")
    goal = goal.withColumnsRenamed({"source": "src", "b": "bb"})
    j = rows.join(goal, F.col("source").eqNullSafe(F.col("src")) & (F.col("b") == F.col("bb")))
    inside = F.sum("size").over(Window.partitionBy("source", "b").orderBy("k", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    j = j.withColumn("before", F.col("offset") + inside).withColumn("full", full).withColumn("rest", budget - F.col("full") * F.col("source_size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    j = j.withColumn("part", part)
    return j.select("doc_id", "source", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).alias("taken"), (F.col("full") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).cast("int").alias("epochs"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs with all their columns, each as often as the mix takes it.

    Documents stay whole: the one that the budget cuts is taken once more if at least half of its
    words are within, so that a source misses its target by half a document at most. Documents
    without words are left out unless their source is taken whole, then they come along once.
    """
    plan = mix(docs, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")).otherwise(F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0))
    plan = plan.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), times.alias("__mix_times")).groupBy("__mix_id", "__mix_source", "__mix_size").agg(F.min("__mix_times").alias("__mix_times"))
    j = docs.join(plan, docs["doc_id"].eqNullSafe(F.col("__mix_id")) & docs["source"].eqNullSafe(F.col("__mix_source")) & (word_count(docs["text"]) == F.col("__mix_size")))
    return j.where("__mix_times > 0").select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__mix_times"))).alias("__mix_epoch")).drop("__mix_epoch")


def _oracle() -> str:
    """DuckDB SQL for op1_mixing: prefix sums over each whole source instead of buckets."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, 'null') || ':17') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE)
        / sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
lv AS (SELECT min(level) AS lev FROM (SELECT level, row_number() OVER (ORDER BY source_size / weight, source IS NULL, source) AS n FROM f
        WHERE level <= source_size * 2.0::DOUBLE / weight) WHERE n = 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE
        ELSE least(source_size * 2.0::DOUBLE, coalesce(lev * weight, source_size * 2.0::DOUBLE)) END AS target FROM f, lv),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS before,
        CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM p"""


def op1_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": _oracle()}
