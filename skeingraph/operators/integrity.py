"""Checks before an index is stored; each fault is a count, and all faults are reported together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeingraph.functions.text import utf16_length
from skeingraph.schema import DeclarationRole, RelationKind, SymbolKind


class IntegrityError(ValueError):
    """What is wrong with a snapshot."""


def _repeated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def _dangling(df: DataFrame, column: str, owner: DataFrame) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(owner.select(F.col("id").alias(column)), column, "left_anti")


def faults(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows that are at fault, by the rule that they break."""
    docs, symbols, decls, calls = t["documents"], t["symbols"], t["symbol_declarations"], t["calls"]
    relations, sources = t["symbol_relations"], t["normalized_sources"]
    roles = decls.groupBy("symbol_id").agg(F.array_sort(F.collect_list("declaration_role")).alias("roles"))
    allowed = [[DeclarationRole.ORDINARY], [DeclarationRole.PARTIAL_DEFINITION], [DeclarationRole.PARTIAL_DEFINITION, DeclarationRole.PARTIAL_IMPLEMENTATION]]
    is_allowed: Column = F.lit(False)
    for a in allowed:
        # Several ordinary declarations of one symbol are allowed, so distinct roles are compared.
        is_allowed |= F.array_distinct("roles") == F.array(*[F.lit(int(r)) for r in a])
    owned = decls.select(F.col("id").alias("preferred_declaration_id"), F.col("symbol_id").alias("owner"))
    lengths = docs.join(sources.select(F.col("id").alias("normalized_source_id"), utf16_length(F.col("normalized_source")).alias("units")), "normalized_source_id").select(F.col("id").alias("document_id"), "units")
    partial = F.col("relation_kind").isin(int(RelationKind.PARTIAL_DEFINITION), int(RelationKind.PARTIAL_IMPLEMENTATION))
    return {
        "symbol keys repeat": _repeated(symbols, "analysis_profile_id", "stable_key"),
        "declaration keys repeat": _repeated(decls, "declaration_key"),
        "document paths repeat": _repeated(docs, "project_id", "normalized_path"),
        "text hashes differ from texts": sources.where(F.col("normalized_source_hash") != F.unhex(F.sha2("normalized_source", 256))),
        "one hash has several texts": sources.groupBy("normalized_source_hash").agg(F.countDistinct("normalized_source").alias("n")).where("n > 1"),
        "declaration ranges leave their text": decls.join(lengths, "document_id").where((F.col("normalized_start") < 0) | (F.col("normalized_length") <= 0) | (F.col("normalized_start").cast("long") + F.col("normalized_length") > F.col("units"))),
        "declaration roles don't fit": roles.where(~is_allowed),
        "preferred declarations belong to others": symbols.join(owned, "preferred_declaration_id").where("owner != id"),
        "types have declarations": decls.join(symbols.where(F.col("kind") == SymbolKind.TYPE).select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi"),
        "partial relations to themselves": relations.where(partial & (F.col("source_symbol_id") == F.col("target_symbol_id"))),
        "names beside resolved callees": calls.where(F.col("unresolved_name").isNotNull() & (F.col("callee_symbol_id").isNotNull() | F.col("callee_definition_id").isNotNull())),
        "documents without project": _dangling(docs, "project_id", t["projects"]),
        "documents without text": _dangling(docs, "normalized_source_id", sources),
        "declarations without symbol": _dangling(decls, "symbol_id", symbols),
        "declarations without document": _dangling(decls, "document_id", docs),
        "calls without caller": _dangling(calls, "caller_symbol_id", symbols),
        "calls without callee": _dangling(calls, "callee_symbol_id", symbols),
        "calls without definition": _dangling(calls, "callee_definition_id", symbols),
        "calls without document": _dangling(calls, "document_id", docs),
        "candidates without call": _dangling(t["call_candidates"], "call_id", calls),
        "candidates without symbol": _dangling(t["call_candidates"], "candidate_symbol_id", symbols),
        "relations without source": _dangling(relations, "source_symbol_id", symbols),
        "relations without target": _dangling(relations, "target_symbol_id", symbols),
        "bindings without implementation": _dangling(t["interface_method_bindings"], "implementation_method_id", symbols),
        "preferred declarations missing": _dangling(symbols, "preferred_declaration_id", decls),
        "containing symbols missing": _dangling(symbols, "containing_symbol_id", symbols),
    }


def check(tables: dict[str, DataFrame]) -> None:
    """IntegrityError with the number of rows that break each rule. All rules are counted by one job."""
    found = None
    for rule, rows in faults(tables).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        found = one if found is None else found.unionByName(one)
    bad = {r["rule"]: r["n"] for r in found.where("n > 0").collect()}
    if bad:
        raise IntegrityError("; ".join(f"{n} x {rule}" for rule, n in sorted(bad.items())))


def resolved_names(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Calls whose unknown callees are null; unresolved_name stays only where both are."""
    out = calls
    for c in ("callee_symbol_id", "callee_definition_id"):
        ids = known.select(F.col("id").alias(c), F.lit(True).alias("_known"))
        out = out.join(ids, c, "left").withColumn(c, F.when(F.col("_known"), F.col(c))).drop("_known")
    both = F.col("callee_symbol_id").isNull() & F.col("callee_definition_id").isNull()
    return out.withColumn("unresolved_name", F.when(both, F.col("unresolved_name"))).select(*calls.columns)
