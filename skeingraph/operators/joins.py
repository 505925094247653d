"""Joins between symbols, declarations, calls, relations and bindings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeingraph.operators.ordering import declaration_order
from skeingraph.schema import Accessibility, GeneratedFilter


def symbol_projection(symbols: DataFrame, declarations: DataFrame, documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Symbols with what their preferred declaration, its document and the project add, where there are any."""
    d = declarations.select(F.col("id").alias("preferred_declaration_id"), "document_id", "source_start", "source_length", "declaration_role")
    doc = documents.select(F.col("id").alias("document_id"), "normalized_path", F.col("is_generated").alias("document_generated"))
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "assembly_name")
    return symbols.join(d, "preferred_declaration_id", "left").join(doc, "document_id", "left").join(p, "project_id", "left")


def with_parameters(symbols: DataFrame, parameters: DataFrame) -> DataFrame:
    """Symbols with their parameters by ordinal; none: an empty array."""
    columns = [c for c in ("ordinal", "name", "type_key", "type_display", "ref_kind", "is_optional") if c in parameters.columns]
    lists = parameters.groupBy(F.col("method_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("parameters"))
    return symbols.join(lists, "id", "left").withColumn("parameters", F.coalesce("parameters", F.array().cast(lists.schema["parameters"].dataType)))


def declaration_rows(declarations: DataFrame, symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """Every declaration with its symbol's names and its document's path."""
    s = symbols.select(F.col("id").alias("symbol_id"), "namespace_name", "type_identity_path", "executable_identity_path", "stable_key")
    return declarations.join(s, "symbol_id").join(documents.select(F.col("id").alias("document_id"), "normalized_path"), "document_id")


def preferred_declarations(symbols: DataFrame, declarations: DataFrame) -> DataFrame:
    ids = symbols.select("preferred_declaration_id").withColumnRenamed("preferred_declaration_id", "id")
    return declarations.join(ids, "id")


def call_projection(calls: DataFrame, symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """Calls with the keys of caller, callee and definition; callee and definition may be missing."""
    keys = lambda prefix: symbols.select(F.col("id").alias(f"{prefix}_id"), F.col("stable_key").alias(f"{prefix.removesuffix('_symbol')}_key"))
    doc = documents.select(F.col("id").alias("document_id"), "normalized_path", "is_generated")
    return calls.join(keys("caller_symbol"), "caller_symbol_id").join(keys("callee_symbol"), "callee_symbol_id", "left").join(keys("callee_definition"), "callee_definition_id", "left").join(doc, "document_id")


def of_kinds(df: DataFrame, column: str, kinds: Iterable[int] | None) -> DataFrame:
    """No kinds: no filter."""
    kinds = [int(k) for k in kinds or ()]
    return df.where(F.col(column).isin(kinds)) if kinds else df


def generated_edges(df: DataFrame, mode: int, documents: DataFrame | None = None) -> DataFrame:
    """By the generated flag of the call's document; without documents, by a flag that the calls carry."""
    if mode == GeneratedFilter.INCLUDE:
        return df
    if documents is None:
        return df.where(F.col("is_generated") == (mode == GeneratedFilter.ONLY))
    return df.join(documents.where(F.col("is_generated") == (mode == GeneratedFilter.ONLY)).select(F.col("id").alias("document_id")), "document_id", "left_semi").select(*df.columns)


def generated_roots(symbols: DataFrame, declarations: DataFrame, mode: int) -> DataFrame:
    """By the preferred declaration's flag; symbols without one pass only when all do."""
    if mode == GeneratedFilter.INCLUDE:
        return symbols
    flag = declarations.where(F.col("is_generated") == (mode == GeneratedFilter.ONLY)).select(F.col("id").alias("preferred_declaration_id"))
    return symbols.join(flag, "preferred_declaration_id", "left_semi")


def calls_by_callee(calls: DataFrame, seeds: DataFrame, candidates: DataFrame | None = None, kinds: Iterable[int] | None = None) -> DataFrame:
    """Calls whose definition, or one of whose candidates, is a seed (one column of ids).

    The two conditions are two semi joins by key, united, instead of one join with OR, which could only be a nested loop."""
    calls = of_kinds(calls, "reference_kind", kinds)
    seeds = seeds.toDF("seed").distinct()
    direct = calls.join(seeds, F.col("callee_definition_id") == F.col("seed"), "left_semi")
    if candidates is None:
        return direct
    hit = candidates.join(seeds, F.col("candidate_symbol_id") == F.col("seed"), "left_semi").select(F.col("call_id").alias("id")).distinct()
    others = calls.join(hit, "id", "left_semi").join(direct.select("id"), "id", "left_anti")
    return direct.unionByName(others)


def calls_by_caller(calls: DataFrame, seeds: DataFrame, kinds: Iterable[int] | None = None) -> DataFrame:
    return of_kinds(calls, "reference_kind", kinds).join(seeds.toDF("caller_symbol_id").distinct(), "caller_symbol_id", "left_semi")


def relations_of(relations: DataFrame, symbols: DataFrame, seeds: DataFrame, by: str = "target", kinds: Iterable[int] | None = None) -> DataFrame:
    """Relations whose `by` end (source or target) is a seed; both ends must be known symbols."""
    rows = of_kinds(relations, "relation_kind", kinds).join(seeds.toDF(f"{by}_symbol_id").distinct(), f"{by}_symbol_id", "left_semi")
    for end in ("source", "target"):
        rows = rows.join(symbols.select(F.col("id").alias(f"{end}_symbol_id")), f"{end}_symbol_id", "left_semi")
    return rows


def overrides_of(relations: DataFrame, symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    return relations_of(relations, symbols, seeds, "target", [3])


def bindings_of(bindings: DataFrame, methods: DataFrame) -> DataFrame:
    return bindings.join(methods.toDF("interface_method_id").distinct(), "interface_method_id", "left_semi")


class MissingEndpoint(ValueError):
    """A call or relation names a symbol that is not stored."""


def endpoints(frames: Iterable[tuple[DataFrame, Iterable[str]]], symbols: DataFrame) -> DataFrame:
    """The symbols that the id columns of the frames name, once each; MissingEndpoint if one is not stored."""
    ids = None
    for df, columns in frames:
        for c in columns:
            one = df.select(F.col(c).alias("id")).where("id is not null")
            ids = one if ids is None else ids.union(one)
    ids = ids.distinct()
    missing = ids.join(symbols.select("id"), "id", "left_anti").orderBy("id").limit(5).collect()
    if missing:
        raise MissingEndpoint(f"symbols not stored: {[r['id'] for r in missing]}")
    return symbols.join(ids, "id", "left_semi")


def innermost(intervals: DataFrame, positions: DataFrame) -> DataFrame:
    """For each position (document_id, position) the shortest interval (document_id, id, source_start, source_length) that covers it, ends included; ties go to the smaller id.

    Intervals fall into classes by length: of class k, cells of 2**k offsets are longer than the interval, which so lies in two of them at most.
    A position asks one cell of each class that its document has, so the join is by key and what an interval costs does not depend on its length."""
    end = F.col("source_start") + F.col("source_length")
    k = F.length(F.bin(F.greatest(F.col("source_length"), F.lit(1)).cast("long"))).alias("k")
    i = intervals.select("document_id", "id", "source_start", "source_length", k)
    width = F.expr("shiftleft(CAST(1 AS BIGINT), k)")
    cells = F.array_distinct(F.array(F.floor(F.col("source_start") / width), F.floor(end / width)))
    i = i.select("document_id", "id", "source_start", "source_length", "k", F.explode(cells).alias("cell"))
    classes = i.select("document_id", "k").distinct()
    p = positions.select("document_id", "position").distinct().join(classes, "document_id").withColumn("cell", F.floor(F.col("position") / width))
    hits = p.join(i, ["document_id", "k", "cell"]).where((F.col("source_start") <= F.col("position")) & (end >= F.col("position")))
    return hits.groupBy("document_id", "position").agg(F.min(F.struct("source_length", "id", "source_start")).alias("m")).select("document_id", "position", "m.id", "m.source_start", "m.source_length")


def orphans(rows: DataFrame, key: str, users: DataFrame, user_key: str) -> DataFrame:
    """Rows that no user refers to."""
    return rows.join(users.select(F.col(user_key).alias(key)), key, "left_anti")


#: Access that derived types have everywhere, and within one assembly only.
ACCESS_ANY = (Accessibility.PUBLIC, Accessibility.PROTECTED, Accessibility.PROTECTED_OR_INTERNAL)
ACCESS_SAME_ASSEMBLY = (Accessibility.INTERNAL, Accessibility.PROTECTED_AND_INTERNAL)


def accessible(members: DataFrame, receivers: DataFrame) -> DataFrame:
    """Members (type_id, accessibility, assembly_name) that each receiver (type_id, receiver_assembly) may see."""
    ok = F.col("accessibility").isin([int(a) for a in ACCESS_ANY]) | (F.col("accessibility").isin([int(a) for a in ACCESS_SAME_ASSEMBLY]) & (F.col("assembly_name") == F.col("receiver_assembly")))
    return members.join(receivers, "type_id").where(ok)


def with_declarations(roots: DataFrame, rows: DataFrame) -> DataFrame:
    """Roots (symbol_id, root_order) with their declarations, in root order and then declaration order."""
    place = F.row_number().over(Window.partitionBy("symbol_id").orderBy(*declaration_order()))
    return roots.join(rows.withColumn("declaration_place", place), "symbol_id").orderBy("root_order", "declaration_place")
