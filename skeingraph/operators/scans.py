"""Scans over the stored tables; every predicate is a column expression, so Catalyst pushes it to the files."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.schema import EXECUTABLE, AsyncStatus, SymbolKind


def latest_profile(profiles: DataFrame, runs: DataFrame, name: str | None = None) -> DataFrame:
    """The profile whose run is the newest, of all or of those of a name; ties go to the larger run id."""
    rows = profiles.join(runs.withColumnRenamed("id", "run_id"), profiles["id"] == F.col("analysis_profile_id"))
    rows = rows.where(F.col("name") == name) if name is not None else rows
    return rows.orderBy(F.desc("indexed_at_utc"), F.desc("run_id")).limit(1)


def in_profile(df: DataFrame, profile: int) -> DataFrame:
    return df.where(F.col("analysis_profile_id") == profile)


def symbol_scan(
    symbols: DataFrame, name: str | None = None, type_path: str | None = None, kinds: Iterable[int] | None = None, source_only: bool = False, declarations: DataFrame | None = None, documents: DataFrame | None = None
) -> DataFrame:
    """Symbols by exact name, exact type path and kinds; source_only: as `source_backed`."""
    out = symbols
    for column, value in (("name", name), ("type_identity_path", type_path)):
        out = out.where(F.col(column) == value) if value is not None else out
    out = out.where(F.col("kind").isin([int(k) for k in kinds])) if kinds else out
    return source_backed(out, declarations, documents) if source_only else out


def source_backed(symbols: DataFrame, declarations: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Symbols with a preferred declaration that has a document, and with a declaration of their own; without the tables, of the first alone."""
    out = symbols.where(F.col("preferred_declaration_id").isNotNull())
    if declarations is None:
        return out
    preferred = declarations if documents is None else declarations.join(documents.where("normalized_path is not null").select(F.col("id").alias("document_id")), "document_id", "left_semi")
    out = out.join(preferred.select(F.col("id").alias("preferred_declaration_id")), "preferred_declaration_id", "left_semi")
    return out.join(declarations.select(F.col("symbol_id").alias("id")), "id", "left_semi").select(*symbols.columns)


def executables(symbols: DataFrame, name: str | None = None, kind: int | None = None) -> DataFrame:
    """Executable symbols, perhaps of one leaf name and one kind."""
    if kind is not None and kind not in EXECUTABLE:
        return symbols.limit(0)
    return symbol_scan(symbols, name, kinds=[kind] if kind is not None else EXECUTABLE)


def async_filter(role: Column, status: int) -> Column:
    if status == AsyncStatus.ASYNC:
        return role != 0
    return role == 0 if status == AsyncStatus.SYNC else F.lit(True)


def functions(symbols: DataFrame, kind: int | None = None, status: int = AsyncStatus.ALL, involved: bool = False) -> DataFrame:
    """Executable symbols by kind and async status; involved: those with an involvement depth."""
    out = executables(symbols, kind=kind).where(async_filter(F.col("async_role"), status))
    return out.where(F.col("async_involvement_depth").isNotNull()) if involved else out


def by_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose `column` is among the one column of ids."""
    return df.join(ids.toDF(column).distinct(), column, "left_semi")


def document_by_path(documents: DataFrame, path: str, ignore_case: bool = False) -> DataFrame:
    if ignore_case:
        return documents.where(F.collate("normalized_path", "UTF8_LCASE") == F.collate(F.lit(path), "UTF8_LCASE"))
    return documents.where(F.col("normalized_path") == path)


def id_list(spark: SparkSession, ids: Iterable[int], name: str = "id") -> DataFrame:
    """Ids as a table, from one JSON parameter."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([int(i) for i in ids])), "array<bigint>")).alias(name))


def pair_list(spark: SparkSession, pairs: Iterable[tuple[int, int]], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    x = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([[int(a), int(b)] for a, b in pairs])), "array<array<bigint>>")).alias("x"))
    return x.select(F.col("x")[0].alias(names[0]), F.col("x")[1].alias(names[1]))


def normalized_text(declarations: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Declarations with their document's path and normalized text; the text is joined last, by the payload that documents share."""
    paths = documents.select(F.col("id").alias("document_id"), "normalized_path", "normalized_source_id")
    texts = sources.select(F.col("id").alias("normalized_source_id"), "normalized_source")
    return declarations.join(paths, "document_id").join(texts, "normalized_source_id")


class PayloadError(ValueError):
    """A document's text is missing, or stored more than once."""


def payload_faults(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """normalized_source_id, fault of the texts that documents name: `missing`, or `duplicate` where several rows have one id."""
    used = documents.select("normalized_source_id").distinct()
    held = sources.groupBy(F.col("id").alias("normalized_source_id")).count()
    fault = F.when(F.col("count").isNull(), "missing").when(F.col("count") > 1, "duplicate")
    return used.join(held, "normalized_source_id", "left").select("normalized_source_id", fault.alias("fault")).where("fault is not null")


def checked_payloads(documents: DataFrame, sources: DataFrame) -> None:
    """PayloadError before texts are read, naming a few of the faults."""
    bad = payload_faults(documents, sources).orderBy("normalized_source_id").limit(5).collect()
    if bad:
        raise PayloadError(", ".join(f"text {r['normalized_source_id']} is {r['fault']}" for r in bad))


def types(symbols: DataFrame) -> DataFrame:
    return symbol_scan(symbols, kinds=[SymbolKind.TYPE])
