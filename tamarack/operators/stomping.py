"""Source against compiled code: findings, scores and reports by module, rolled up by project.

Tables: modules (module, source string or null, source_error string or null, pcode_lines long or null,
pcode_instructions long or null; null where there is no compiled code), names (module, kind one of
procedure, literal, call; name), each of a module once. More key columns may stand before module.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions import fixed
from tamarack.operators import text


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def severity_rank(c: Column) -> Column:
    """0 Clean to 4 Critical."""
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), c).cast("int") - 1


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), rank + 1)


def is_suspicious(literal: Column) -> Column:
    """Whether a literal contains a suspicious pattern, without regard to ASCII case."""
    # One pass over the text, and little code: a test for each pattern is more than the JVM takes in one method.
    return ascii_lower(literal).rlike("|".join(map(re.escape, fixed.SUSPICIOUS_PATTERNS)))


def is_sensitive(call: Column) -> Column:
    return ascii_lower(call).isin([c.lower() for c in fixed.SENSITIVE_CALLS])


def is_auto_exec(name: Column) -> Column:
    return ascii_lower(name).isin(list(fixed.AUTO_EXEC_HOOKS))


def source_facts(modules: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, source_lines, effective, source_procs) by module, and (key, name) of its procedures."""
    procs = text.procedures(modules, key, "source").select(*key, "name")
    code = text.effective_lines(modules, key, "source").groupBy(*key).agg(F.count("*").alias("effective"))
    lines = modules.select(*key, F.coalesce(F.size(text.source_lines(F.coalesce("source", F.lit("")))), F.lit(0)).cast("long").alias("source_lines"))
    count = procs.groupBy(*key).agg(F.count("*").alias("source_procs"))
    facts = lines.join(code, key, "left").join(count, key, "left")
    return facts.fillna(0, ["effective", "source_procs"]), procs


def findings(modules: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, severity, weight, detail) of every module's findings."""
    facts, procs = source_facts(modules, key)
    m = modules.join(facts, key)
    compiled = F.col("pcode_lines").isNotNull()
    runs = F.coalesce("pcode_instructions", F.lit(0)) > 0
    live = (F.col("source_procs") > 0) & (F.col("effective") > 0)

    def flat(cond, kind, severity, weight, detail=F.lit(None).cast("string")):
        return m.where(cond).select(*key, F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(weight).alias("weight"), detail.alias("detail"))

    out = flat(live & (~compiled | ~runs), "PerformanceCachePurged", "Medium", 35)
    out = out.unionAll(flat(compiled & runs & F.col("source_error").isNotNull(), "SourceCorruptedWithValidPCode", "Critical", 95, F.col("source_error")))
    out = out.unionAll(flat(compiled & runs & F.col("source_error").isNull() & ((F.col("source_lines") == 0) | (F.col("effective") == 0)), "SourcePurged", "Critical", 95))
    wide = (F.col("source_lines") > 0) & (F.col("pcode_lines") > F.col("source_lines") * 4) & (F.col("pcode_lines") > 20)
    out = out.unionAll(flat(compiled & wide, "LineCountDiscrepancy", "Medium", 25))

    n = names.join(m.where(compiled).select(*key, ascii_lower(F.coalesce("source", F.lit(""))).alias("low")), key)
    folded = procs.select(*key, ascii_lower(F.col("name")).alias("folded")).distinct()
    hidden = n.where("kind = 'procedure'").withColumn("folded", ascii_lower(F.col("name"))).join(folded, [*key, "folded"], "left_anti")
    hook = is_auto_exec(F.col("name"))
    out = out.unionAll(hidden.select(*key, F.lit("ProcedureHiddenInPCode"), F.when(hook, "Critical").otherwise("High"), F.when(hook, 60).otherwise(40), "name"))
    known = n.where("kind = 'procedure'").select(*key, ascii_lower(F.col("name")).alias("folded")).distinct()
    has = known.select(*key).distinct()
    missing = procs.join(has, key, "left_semi").withColumn("folded", ascii_lower(F.col("name"))).join(known, [*key, "folded"], "left_anti")
    out = out.unionAll(missing.select(*key, F.lit("ProcedureMissingInPCode"), F.lit("Medium"), F.lit(20), "name"))
    unseen = n.where(~F.contains(F.col("low"), ascii_lower(F.col("name"))))
    bad = is_suspicious(F.col("name"))
    literal = unseen.where((F.col("kind") == "literal") & (bad | (F.octet_length("name") > 10)))
    out = out.unionAll(literal.select(*key, F.lit("SuspiciousLiteralInPCode"), F.when(bad, "Critical").otherwise("Low"), F.when(bad, 50).otherwise(5), "name"))
    call = unseen.where((F.col("kind") == "call") & is_sensitive(F.col("name")))
    return out.unionAll(call.select(*key, F.lit("SensitiveCallInPCode"), F.lit("High"), F.lit(45), "name"))


def score_reports(found: DataFrame, key: list[str]) -> DataFrame:
    """(key, score, severity, is_stomped, n_findings) of rows (key, severity, weight): weights sum up to 100 at most."""
    total = F.least(F.lit(100), F.coalesce(F.sum("weight"), F.lit(0))).cast("long")
    band = F.when(F.col("score") >= 80, 4).when(F.col("score") >= 50, 3).when(F.col("score") >= 25, 2).when(F.col("score") > 0, 1).otherwise(0)
    g = found.groupBy(*key).agg(total.alias("score"), F.max(severity_rank(F.col("severity"))).alias("top"), F.count("severity").alias("n_findings"))
    return g.select(*key, "score", severity_name(F.greatest(band, F.coalesce("top", F.lit(0)))).alias("severity"), (F.col("score") >= 50).alias("is_stomped"), "n_findings")


def reports(modules: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """One row per module, clean ones included; a module without compiled code is never stomped."""
    found = modules.select(*key).join(findings(modules, names, key).select(*key, "severity", "weight"), key, "left")
    out = score_reports(found, key).join(modules.select(*key, F.col("pcode_lines").isNotNull().alias("compiled")), key)
    return out.select(*key, "score", "severity", (F.col("is_stomped") & F.col("compiled")).alias("is_stomped"), "n_findings")


def project_report(module_reports: DataFrame, project: list[str], extra: DataFrame | None = None) -> DataFrame:
    """(project, severity, has_stomping, n_modules): the worst of the modules and of project findings `extra` (project, severity)."""
    rows = module_reports.select(*project, severity_rank(F.col("severity")).alias("rank"), "is_stomped", F.lit(1).alias("one"))
    if extra is not None:
        rows = rows.unionByName(extra.select(*project, severity_rank(F.col("severity")).alias("rank"), F.lit(False).alias("is_stomped"), F.lit(0).alias("one")))
    g = rows.groupBy(*project).agg(F.max("rank").alias("rank"), F.bool_or("is_stomped").alias("has_stomping"), F.sum("one").alias("n_modules"))
    return g.select(*project, severity_name(F.col("rank")).alias("severity"), "has_stomping", "n_modules")


def project_findings(dir_modules: DataFrame, manifest: DataFrame, attributes: DataFrame, project: list[str]) -> DataFrame:
    """(project, kind, severity, detail): modules that the manifest doesn't name, and locked projects.

    dir_modules (project, module), manifest (project, module), attributes (project, name) of the manifest.
    """
    fold = lambda d: d.withColumn("folded", ascii_lower(F.col("module")))
    known = fold(manifest).select(*project, "folded").distinct()
    hidden = fold(dir_modules).join(known, [*project, "folded"], "left_anti").select(*project, F.lit("HiddenGuiModule").alias("kind"), F.lit("High").alias("severity"), F.col("module").alias("detail"))
    locked = attributes.where(F.upper("name").isin("CMG", "DPB", "GC")).groupBy(*project).agg(F.count("*").alias("n"))
    return hidden.unionAll(locked.select(*project, F.lit("ProjectLockedOrUnviewable"), F.lit("Low"), F.lit(None).cast("string")))
