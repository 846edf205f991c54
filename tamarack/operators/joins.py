"""Joins of fact tables: containment, as-of and inequality joins, resolution states, consensus, 2-D ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containment(facts: DataFrame, nodes: DataFrame, scope: list[str], bucket: int | None = None) -> DataFrame:
    """Each fact (scope, fact_id, f_start, f_end) with the one narrowest node (scope, node_id, n_start, n_end) around it.

    A fact whose narrowest nodes are several attaches to none; empty spans never attach. With a bucket, of
    at least the longest fact, the range condition becomes an equality on buckets that a node spans.
    """
    f = facts.where("f_start < f_end")
    on = [*scope]
    if bucket:
        f = f.withColumn("bucket", F.floor(F.col("f_start") / bucket))
        nodes = nodes.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("n_start") / bucket), F.floor(F.col("n_end") / bucket))))
        on.append("bucket")
    j = f.join(nodes, on).where("n_start <= f_start and f_end <= n_end")
    w = Window.partitionBy(*scope, "fact_id")
    j = j.withColumn("least", F.min(F.col("n_end") - F.col("n_start")).over(w)).where("n_end - n_start = least")
    return j.withColumn("ties", F.count("*").over(w)).where("ties = 1").select(*scope, "fact_id", "node_id")


def reaching_definitions(facts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, read_id, def_id, state) of the reads among facts (scope, fact_id, pos, is_write).

    A write is seen from the next position on; all writers at the last writing position reach. Reads with
    none have a null def_id and state no_prior_local_definition_on_path.
    """
    before = Window.partitionBy(*scope).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    g = facts.withColumn("def_pos", F.max(F.when(F.col("is_write"), F.col("pos"))).over(before))
    reads = g.where(~F.col("is_write")).select(*scope, F.col("fact_id").alias("read_id"), "def_pos")
    defs = facts.where("is_write").select(*scope, F.col("fact_id").alias("def_id"), F.col("pos").alias("def_pos"))
    j = reads.join(defs, [*scope, "def_pos"], "left")
    state = F.when(F.col("def_id").isNull(), "no_prior_local_definition_on_path").otherwise("path_local_definition_candidate")
    return j.select(*scope, "read_id", "def_id", state.alias("state"))


def snapshot_before(events: DataFrame, scope: list[str], order: str, value: Column, asked: Column) -> DataFrame:
    """Events where asked, with snapshot: the last value that isn't null strictly before them in the scope."""
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("snapshot", F.last(value, ignorenulls=True).over(w)).where(asked)


def earlier_aliases(calls: DataFrame, aliases: DataFrame, scope: list[str]) -> DataFrame:
    """Each call (scope, call_id, pos) with every earlier alias (scope, alias_id, alias_pos): none ends another.

    state: one alias is a candidate, several are ambiguous. Calls without one are left out.
    """
    j = calls.join(aliases, scope).where("alias_pos < pos")
    n = F.count("*").over(Window.partitionBy(*scope, "call_id"))
    state = F.when(n == 1, "path_alias_typed_member_dispatch_candidate").otherwise("ambiguous_path_alias_typed_member_dispatch")
    return j.select(*scope, "call_id", "alias_id", state.alias("state"))


def consensus(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n_values, state): the value of a group on which all its rows agree."""
    g = values.groupBy(*group).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("least"), F.bool_and(F.col(value).isNotNull()).alias("all_known"))
    agreed = (F.col("n_values") == 1) & F.col("all_known")
    return g.select(*group, F.when(agreed, F.col("least")).alias("value"), "n_values", F.when(agreed, "consensus").when(F.col("n_values") == 0, "unresolved").otherwise("conflicting").alias("state"))


def resolve_unique(asked: DataFrame, names: DataFrame, name: str, target: str) -> DataFrame:
    """asked (name) with target, n_candidates and state: unique, ambiguous or unresolved."""
    known = names.groupBy(name).agg(F.count("*").alias("n"), F.min(target).alias("only"))
    j = asked.join(known, name, "left")
    n = F.coalesce("n", F.lit(0))
    return j.select(name, F.when(n == 1, F.col("only")).alias(target), n.alias("n_candidates"), F.when(n == 0, "unresolved").when(n == 1, "unique").otherwise("ambiguous").alias("state"))


def scoped_name(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (ref_id, scope, name) resolved in names (scope or null, name, target): the own scope beats the common one."""
    local = names.where("scope is not null").groupBy("scope", "name").agg(F.count("*").alias("ln"), F.min("target").alias("lt"))
    common = names.where("scope is null").groupBy("name").agg(F.count("*").alias("gn"), F.min("target").alias("gt"))
    j = asked.join(local, ["scope", "name"], "left").join(common, "name", "left")
    state = F.when(F.col("ln") == 1, "local").when(F.col("ln") > 1, "ambiguous_local").when(F.col("gn") == 1, "common").when(F.col("gn") > 1, "ambiguous_common").otherwise("unresolved")
    target = F.when(F.col("ln") == 1, F.col("lt")).when(F.col("ln").isNull() & (F.col("gn") == 1), F.col("gt"))
    return j.select("ref_id", target.alias("target"), state.alias("state"))


def range_cells(cells: DataFrame, ranges: DataFrame, limit: int | None = None, tile: int | None = None) -> DataFrame:
    """(range_id, sheet, row, col, truncated) of the cells inside each range (range_id, sheet, row1, row2, col1, col2).

    With a limit only the first cells of each range in row order are returned, and truncated says so. With a
    tile, ranges are cut into bands of so many rows, which cells equal: no comparison of every pair.
    """
    on = ["sheet"]
    if tile:
        cells = cells.withColumn("band", F.floor(F.col("row") / tile))
        ranges = ranges.withColumn("band", F.explode(F.sequence(F.floor(F.col("row1") / tile), F.floor(F.col("row2") / tile))))
        on.append("band")
    j = cells.join(ranges, on).where("row between row1 and row2 and col between col1 and col2")
    if limit is None:
        return j.select("range_id", "sheet", "row", "col", F.lit(False).alias("truncated"))
    w = Window.partitionBy("range_id")
    j = j.withColumn("r", F.row_number().over(w.orderBy("row", "col"))).withColumn("n", F.count("*").over(w))
    return j.where(F.col("r") <= limit).select("range_id", "sheet", "row", "col", (F.col("n") > limit).alias("truncated"))


def first_of_each(rows: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows of each group, with truncated: whether the group has more."""
    w = Window.partitionBy(*group)
    j = rows.withColumn("rank_in_group", F.row_number().over(w.orderBy(*order))).withColumn("group_size", F.count("*").over(w))
    return j.where(F.col("rank_in_group") <= limit).withColumn("truncated", F.col("group_size") > limit).drop("group_size")


def argument_uses(arguments: DataFrame, parameters: DataFrame, reads: DataFrame, caller_paths: DataFrame, callee_paths: DataFrame) -> DataFrame:
    """Argument facts to uses of the parameter on paths of caller and callee, each combination once.

    arguments (arg_id, caller, callee, ordinal), parameters (param_id, callee, ordinal), reads (read_id,
    param_id), caller_paths (arg_id, caller_path), callee_paths (read_id, callee_path). Only parameters that
    are the single candidate of their callee and ordinal count.
    """
    one = parameters.withColumn("n", F.count("*").over(Window.partitionBy("callee", "ordinal"))).where("n = 1").drop("n")
    j = arguments.join(one, ["callee", "ordinal"]).join(reads, "param_id").join(caller_paths, "arg_id").join(callee_paths, "read_id")
    return j.select("arg_id", "read_id", "caller_path", "callee_path").distinct()


def byref_writes(arguments: DataFrame, parameters: DataFrame, writes: DataFrame) -> DataFrame:
    """Arguments by reference (arg_id, callee, ordinal) with writes (write_id, param_id) of their parameter (param_id, callee, ordinal, by_ref)."""
    return arguments.join(parameters.where("by_ref"), ["callee", "ordinal"]).join(writes, "param_id").select("arg_id", "param_id", "write_id").distinct()


def return_uses(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """Uses of a call's result (use_id, callee) with definitions (def_id, procedure, target): targets that are the procedure's own name."""
    own = definitions.where(F.lower("target") == F.lower("procedure")).select("def_id", F.lower("procedure").alias("callee_folded"))
    return uses.withColumn("callee_folded", F.lower("callee")).join(own, "callee_folded").select("use_id", "def_id")


def error_propagation(sites: DataFrame, callee_exits: DataFrame) -> DataFrame:
    """Call sites (site_id, callee, policy or null, may_raise) with unhandled exits (exit_id, procedure) of the callee, and the caller's response."""
    j = sites.join(callee_exits, sites["callee"] == callee_exits["procedure"]).where(F.col("policy").isNotNull() | F.col("may_raise"))
    response = F.when(F.col("policy") == "resume_next", "caller_resumes_next").when(F.col("policy") == "handler", "caller_enters_handler").when(F.col("policy").isNull(), "default_error_policy_may_propagate_to_caller").otherwise("caller_policy_unresolved")
    return j.select("site_id", "exit_id", response.alias("response"))
