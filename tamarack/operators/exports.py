"""Exports of findings and disassembly: JSON, SARIF 2.1.0, Markdown, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import fixed
from tamarack.operators import rules


def redact(rows: DataFrame, scope: list[str], name: str, label: str, blank: list[str]) -> DataFrame:
    """rows with label_1, label_2, ... in place of names, in their order within the scope, and null in place of `blank`."""
    rank = F.dense_rank().over(Window.partitionBy(*scope).orderBy(name))
    out = rows.withColumn(name, F.concat(F.lit(label + "_"), rank.cast("string")))
    return out.withColumns({c: F.lit(None).cast("string") for c in blank})


def cell(c: Column) -> Column:
    """Text of a Markdown table cell."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown(findings: DataFrame, key: list[str]) -> DataFrame:
    """(key, markdown): the findings (coordinate, kind, severity, description) as a table in order of coordinate."""
    line = F.concat(F.lit("| "), F.array_join(F.array(*[cell(F.col(c)) for c in ("coordinate", "kind", "severity", "description")]), " | "), F.lit(" |"))
    g = findings.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("coordinate", "kind", line.alias("line")))).alias("x"))
    head = "| Coordinate | Threat Kind | Severity | Description |\n|---|---|---|---|\n"
    return g.select(*key, F.concat(F.lit(head), F.array_join(F.col("x.line"), "\n"), F.lit("\n")).alias("markdown"))


def report_json(reports: DataFrame, findings: DataFrame, key: list[str]) -> DataFrame:
    """(key, json): each report with its findings (kind, severity, detail) in order."""
    g = findings.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("kind", "severity", "detail"))).alias("findings"))
    j = reports.join(g, key, "left")
    cols = [c for c in reports.columns if c not in key]
    return j.select(*key, F.to_json(F.struct(*key, *cols, "findings")).alias("json"))


def sarif(findings: DataFrame, key: list[str], stomping: bool = False) -> DataFrame:
    """(key, sarif): one SARIF 2.1.0 log of the findings (kind, severity, description, coordinate) of each key."""
    ruled = (rules.with_stomp_rules if stomping else rules.with_rules)(findings)
    result = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("description").alias("text")).alias("message"),
        F.array(F.struct(F.array(F.struct(F.col("coordinate").alias("fullyQualifiedName"))).alias("logicalLocations"))).alias("locations"),
    )
    g = ruled.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rule_id", "coordinate", result.alias("r")))).alias("x"))
    names = [k for k, _ in fixed.STOMP_KINDS] if stomping else fixed.CELL_KINDS
    prefix = "VBA-STOMP-" if stomping else "VBA-CELL-"
    catalogue = F.array(*[F.struct(F.lit(f"{prefix}{n:03d}").alias("id"), F.lit(k).alias("name")) for n, k in enumerate(names, 1)])
    driver = F.struct(F.lit("tamarack").alias("name"), catalogue.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("x", lambda v: v["r"]).alias("results"))
    log = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return g.select(*key, F.to_json(log).alias("sarif"))


def disassembly_markdown(instructions: DataFrame, key: list[str]) -> DataFrame:
    """(key, markdown): listing of instructions (line_no, instr_no, mnemonic, operands array<string>)."""
    line = F.concat(F.lpad(F.col("line_no").cast("string"), 5, " "), F.lit("  "), F.col("mnemonic"), F.lit(" "), F.array_join("operands", ", "))
    g = instructions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line_no", "instr_no", line.alias("line")))).alias("x"))
    return g.select(*key, F.concat(F.lit("```\n"), F.array_join(F.col("x.line"), "\n"), F.lit("\n```\n")).alias("markdown"))
