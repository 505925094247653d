"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeingraph.operators.ordering import ordinal, preferred_rank
from skeingraph.schema import ResolutionStatus

#: Usage codes from the strongest to the weakest.
USAGE_PRIORITY = (1, 2, 3, 4, 5, 6, 0)


def conditions(used: DataFrame, defined: list[str] | None = None) -> DataFrame:
    """symbol_name, documents, occurrences, is_defined of conditional symbols."""
    out = used.groupBy("symbol_name").agg(F.countDistinct("document_id").alias("documents"), F.sum("occurrence_count").cast("long").alias("occurrences"))
    return out.withColumn("is_defined", F.col("symbol_name").isin(defined or []) if defined else F.lit(False))


def conditional_symbols(sources: DataFrame) -> DataFrame:
    """document_id, symbol_name, occurrence_count of the identifiers in #if and #elif lines of sources (document_id, text); literals are not symbols."""
    lines = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*#[ \t]*(?:el)?if\b([^\r\n]*)"), F.lit(1))
    code = F.explode(F.transform(lines, lambda x: F.regexp_replace(x, "//.*", "")))
    names = sources.select("document_id", code.alias("line")).select("document_id", F.explode(F.regexp_extract_all("line", F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0))).alias("symbol_name"))
    return names.where(~F.col("symbol_name").isin("true", "false")).groupBy("document_id", "symbol_name").agg(F.count("*").cast("int").alias("occurrence_count"))


def merged_roles(rows: DataFrame, key: str = "symbol_id") -> DataFrame:
    """Bitwise OR of async roles."""
    return rows.groupBy(key).agg(F.bit_or("async_role").alias("async_role"))


def preferred_declaration(declarations: DataFrame) -> DataFrame:
    """symbol_id, preferred_declaration_id: implementation before definition before ordinary, then document key, start, declaration key."""
    order = F.struct(preferred_rank(F.col("declaration_role")).alias("r"), ordinal("document_key").alias("d"), F.col("source_start").alias("s"), ordinal("declaration_key").alias("k"), F.col("id").alias("id"))
    return declarations.groupBy("symbol_id").agg(F.min(order).alias("m")).select("symbol_id", F.col("m.id").alias("preferred_declaration_id"))


def strongest_usage(usages: DataFrame, key: str = "call_id") -> DataFrame:
    """Of each call's usage kinds the one of the highest priority."""
    place = F.array_position(F.array(*[F.lit(u) for u in USAGE_PRIORITY]), F.col("async_usage_kind"))
    return usages.groupBy(key).agg(F.min_by("async_usage_kind", place).alias("async_usage_kind"))


def summary(projects: DataFrame, documents: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of counts of an index."""
    parts = [
        projects.agg(F.count("*").alias("projects")),
        documents.agg(F.count("*").alias("documents"), F.count_if("is_generated").alias("generated_documents")),
        symbols.agg(F.count("*").alias("symbols")),
        calls.agg(F.count("*").alias("calls"), F.count_if(F.col("resolution_status") != ResolutionStatus.RESOLVED).alias("unresolved_calls")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def call_sites(calls: DataFrame) -> DataFrame:
    """caller, callee, sites: the call ids of each edge in order of document, start and id."""
    sites = F.array_sort(F.collect_list(F.struct("document_id", "source_start", "id")))
    return calls.groupBy(F.col("caller_symbol_id").alias("caller"), F.col("callee_definition_id").alias("callee")).agg(F.transform(sites, lambda s: s["id"]).alias("sites"))


def lambda_ordinals(lambdas: DataFrame) -> DataFrame:
    """Lambdas and anonymous methods numbered from 1 within their owner by source start."""
    return lambdas.withColumn("ordinal", F.row_number().over(Window.partitionBy("owner_id").orderBy("source_start", "id")))
