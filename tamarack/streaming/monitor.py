"""Continuous inspection: the same scans over files as they arrive. An extension: the batch operators, on streams.

Each scan is a transformation of a streaming DataFrame; state is bounded by watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators import stomping


def suspicious_literals(stream: DataFrame, literal: str) -> DataFrame:
    """Rows of the stream whose literal is suspicious; stateless."""
    return stream.where(stomping.is_suspicious(F.col(literal)))


def windowed_scores(stream: DataFrame, time: str, key: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, score, severity, is_stomped, n_findings) of findings (time, key, severity, weight) by window.

    Findings later than `late` behind the newest are dropped: state is what the windows within it hold.
    """
    w = stream.withWatermark(time, late)
    g = w.groupBy(F.window(time, window).alias("w"), *key).agg(F.least(F.lit(100), F.sum("weight")).cast("long").alias("score"), F.max(stomping.severity_rank(F.col("severity"))).alias("top"), F.count("*").alias("n_findings"))
    band = F.when(F.col("score") >= 80, 4).when(F.col("score") >= 50, 3).when(F.col("score") >= 25, 2).when(F.col("score") > 0, 1).otherwise(0)
    return g.select(F.col("w.start").alias("window_start"), *key, "score", stomping.severity_name(F.greatest(band, F.col("top"))).alias("severity"), (F.col("score") >= 50).alias("is_stomped"), "n_findings")
