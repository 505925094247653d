"""Canonical orders. Strings compare by UTF-16 code unit, as their UTF-16BE bytes do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeingraph.session import ranked


def ordinal(c: str | Column) -> Column:
    return F.encode(F.col(c) if isinstance(c, str) else c, "UTF-16BE")


def _last(c: Column) -> Column:
    """Null and empty last."""
    return F.when(c == "", None).otherwise(ordinal(c)).asc_nulls_last()


def symbol_order(prefix: str = "") -> list[Column]:
    """Namespace, type, executable path, document path, source start, stable key; a missing path or start stands last."""
    c = lambda name: F.col(prefix + name)
    return [
        ordinal(c("namespace_name")).asc(), ordinal(c("type_identity_path")).asc(), ordinal(c("executable_identity_path")).asc(),
        _last(c("normalized_path")), c("source_start").asc_nulls_last(), ordinal(c("stable_key")).asc(),
    ]


def repository_order() -> list[Column]:
    """As symbol_order, nulls first, and ended by id."""
    return [F.asc_nulls_first(c) for c in ("namespace_name", "type_identity_path", "executable_identity_path", "normalized_path", "source_start", "id")]


def role_rank(role: Column) -> Column:
    """Definition 1, implementation 2, ordinary 3."""
    return F.when(role == 2, 1).when(role == 3, 2).otherwise(3)


def preferred_rank(role: Column) -> Column:
    """Implementation 0, definition 1, ordinary 2."""
    return F.when(role == 3, 0).when(role == 2, 1).otherwise(2)


def declaration_order() -> list[Column]:
    return [role_rank(F.col("declaration_role")).asc(), ordinal("normalized_path").asc(), F.asc("source_start"), F.asc("id")]


def source_match_order() -> list[Column]:
    return [*symbol_order("symbol_"), ordinal("normalized_path").asc(), F.asc("source_start"), role_rank(F.col("declaration_role")).asc(), F.asc("id")]


def symbol_ranks(symbols: DataFrame) -> DataFrame:
    """id and sym_rank, the place in canonical order, so that orders of calls and edges compare one number."""
    return ranked(symbols, symbol_order(), "sym_rank").select("id", "sym_rank")


def _with_call_ranks(calls: DataFrame, ranks: DataFrame) -> tuple[DataFrame, list[Column]]:
    caller = ranks.select(F.col("id").alias("caller_symbol_id"), F.col("sym_rank").alias("caller_rank"))
    target = ranks.select(F.col("id").alias("target_id"), F.col("sym_rank").alias("target_rank"))
    rows = calls.withColumn("target_id", F.coalesce("callee_definition_id", "callee_symbol_id")).join(caller, "caller_symbol_id", "left").join(target, "target_id", "left").drop("target_id")
    codes = [F.asc(c) for c in ("reference_kind", "dispatch_kind", "resolution_status", "resolution_reason", "async_usage_kind")]
    order = [F.asc("caller_rank"), F.asc_nulls_last("target_rank"), ordinal("normalized_path").asc(), F.asc("source_start"), F.asc("source_length"), *codes, ordinal("unresolved_name").asc_nulls_last(), F.asc("id")]
    return rows, order


def call_order(calls: DataFrame, ranks: DataFrame) -> DataFrame:
    """Calls sorted by caller, target (definition before symbol, unresolved last), path, start, length, codes, name, id."""
    rows, order = _with_call_ranks(calls, ranks)
    return rows.orderBy(*order)


def call_places(calls: DataFrame, ranks: DataFrame, name: str = "place") -> DataFrame:
    """Calls with their place, from 1, in call_order."""
    rows, order = _with_call_ranks(calls, ranks)
    return ranked(rows, order, name).drop("caller_rank", "target_rank")


def _with_relation_ranks(relations: DataFrame, ranks: DataFrame) -> DataFrame:
    a = ranks.select(F.col("id").alias("source_symbol_id"), F.col("sym_rank").alias("source_rank"))
    b = ranks.select(F.col("id").alias("target_symbol_id"), F.col("sym_rank").alias("target_rank"))
    return relations.join(a, "source_symbol_id").join(b, "target_symbol_id")


def relation_order(relations: DataFrame, ranks: DataFrame) -> DataFrame:
    return _with_relation_ranks(relations, ranks).orderBy("source_rank", "target_rank", "relation_kind")


def relation_places(relations: DataFrame, ranks: DataFrame, name: str = "place") -> DataFrame:
    """Relations with their place, from 1, in relation_order."""
    return ranked(_with_relation_ranks(relations, ranks), [F.asc("source_rank"), F.asc("target_rank"), F.asc("relation_kind")], name).drop("source_rank", "target_rank")


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows that repeat a key, the first in the order given."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_first = 1").drop("_first")


def tree_node_order() -> list[Column]:
    return [F.asc("depth"), F.asc("sym_rank")]


def tree_edge_order() -> list[Column]:
    """Parent depth and place, child depth and place, ids."""
    return [F.asc(c) for c in ("parent_depth", "parent_rank", "child_depth", "child_rank", "parent", "child")]


def call_site_order() -> list[Column]:
    return [F.asc("edge_index"), ordinal("normalized_path").asc(), F.asc("source_start"), F.asc("source_length"), F.asc("call_id")]
