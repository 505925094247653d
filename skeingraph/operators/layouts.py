"""Output layouts of the commands: one table line or one nested JSON object for each row, as column expressions.

Rows carry symbol columns as the service gives them; `line` and `column` are those of the start, made by `located` where the
source is at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeingraph.functions import text as T
from skeingraph.schema import Accessibility, AsyncUsage, DispatchKind, ReferenceKind, RelationKind, ResolutionReason, ResolutionStatus, SymbolKind

#: How accessibility and declaration roles are written.
ACCESS = {
    Accessibility.PUBLIC: "public", Accessibility.PRIVATE: "private", Accessibility.PROTECTED: "protected", Accessibility.INTERNAL: "internal",
    Accessibility.PROTECTED_OR_INTERNAL: "protected internal", Accessibility.PROTECTED_AND_INTERNAL: "private protected",
}
ROLES = {1: "ordinary", 2: "definition", 3: "implementation"}


def _named(code: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, name in names.items():
        out = F.when(code == int(k), name).otherwise(out)
    return out


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def located(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows (normalized_path, source_start) with line and column, from the documents' source_text; sources are joined last, by path."""
    texts = documents.select("normalized_path", "source_text").dropDuplicates(["normalized_path"])
    at = rows.join(texts, "normalized_path", "left")
    found = F.col("source_text").isNotNull() & F.col("source_start").isNotNull()
    return at.withColumn("line", F.when(found, T.line_of(F.col("source_text"), F.col("source_start")))).withColumn("column", F.when(found, T.column_of(F.col("source_text"), F.col("source_start")))).drop("source_text")


def display_name(df: DataFrame, style: str = "csharp", short: bool = False) -> Column:
    return T.display_path(F.col("namespace_name"), F.col("type_display_path"), F.col("executable_display_path"), style, short)


def signature(df: DataFrame, style: str = "csharp", short: bool = False) -> Column:
    """Accessibility, static, async, return type and name, as far as they are known."""
    is_async = (F.col("async_role").bitwiseAND(1) != 0) if "async_role" in df.columns else F.lit(False)
    return T.signature(_named(_optional(df, "accessibility", "int"), ACCESS), F.coalesce(_optional(df, "is_static", "boolean"), F.lit(False)), is_async, _optional(df, "return_type_display"), display_name(df, style, short))


def location(df: DataFrame) -> Column:
    """`path:line:column`, or nothing for a symbol without a source."""
    return F.when(F.col("normalized_path").isNotNull(), F.concat_ws(":", "normalized_path", F.col("line").cast("string"), F.col("column").cast("string"))).otherwise("")


def _async_analysis(df: DataFrame) -> Column:
    depth = _optional(df, "async_involvement_depth", "int")
    names = F.array_join(F.filter(F.array(*[F.when(F.col("async_role").bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(T.ROLE_NAMES)]), lambda x: x.isNotNull()), ", ")
    text = F.concat(F.lit(" [async: "), F.when(F.col("async_role") == 0, "None").otherwise(names), F.lit("; depth: "), F.coalesce(depth.cast("string"), F.lit("null")), F.lit("]"))
    return F.when((F.col("async_role") == 0) & depth.isNull(), "").otherwise(text)


def _lines(df: DataFrame, *parts: Column) -> DataFrame:
    return df.select(*[c for c in ("place",) if c in df.columns], F.concat_ws("\t", *parts).alias("line"))


def symbol_lines(df: DataFrame, show_source: bool = False, list_only: bool = False, **style) -> DataFrame:
    """`symbol find`: signature, location and perhaps the source; `symbol list`: the signature alone."""
    parts = [T.one_line(F.concat(signature(df, **style), _async_analysis(df)))]
    parts += [] if list_only else [location(df)]
    return _lines(df, *parts, *([T.one_line(F.col("source"))] if show_source else []))


def source_match_lines(df: DataFrame, **style) -> DataFrame:
    """`source search`: signature, role, location, source."""
    return _lines(df, T.one_line(F.concat(signature(df, **style), _async_analysis(df))), _named(F.col("declaration_role"), ROLES), location(df), T.one_line(F.col("source")))


def definition_lines(df: DataFrame, **style) -> DataFrame:
    return _lines(df, F.concat(F.lit("  "), signature(df, **style)), _named(F.col("declaration_role"), ROLES), location(df))


def with_names(df: DataFrame, symbols: DataFrame, columns: dict[str, str], **style) -> DataFrame:
    """df with the display names of the symbols that id columns name: {id column: name column}."""
    for key, name in columns.items():
        names = symbols.select(F.col("id").alias(key), display_name(symbols, **style).alias(name))
        df = df.join(names, key, "left")
    return df


def call_lines(calls: DataFrame, show_source: bool = False) -> DataFrame:
    """`references`, `callers`, `callees`: place, caller and target, kinds. calls: caller_name and target_name besides; an unresolved target is written by its name."""
    target = F.coalesce("target_name", "unresolved_name", F.lit("<unresolved>"))
    kinds = F.format_string(" [%s, %s] [%s]", T.enum_name(F.col("reference_kind"), ReferenceKind), T.enum_name(F.col("resolution_status"), ResolutionStatus), T.enum_name(F.col("async_usage_kind"), AsyncUsage))
    line = F.concat(F.lit("  "), location(calls), F.lit("  "), F.col("caller_name"), F.lit(" -> "), target, kinds)
    return _lines(calls, line, *([T.one_line(F.col("source"))] if show_source else []))


def relation_lines(relations: DataFrame) -> DataFrame:
    """`overrides`; relations: source_name, target_name."""
    return _lines(relations, F.concat(F.lit("  "), F.col("source_name"), F.lit(" -> "), F.col("target_name")))


def condition_lines(rows: DataFrame) -> DataFrame:
    return _lines(rows, F.concat(F.format_string("  %-30s %6d file(s)  ", F.col("symbol_name"), F.col("documents")), F.when(F.col("is_defined"), "defined").otherwise("undefined")))


# JSON ----------------------------------------------------------------------------------------------------------------


def location_object(df: DataFrame) -> Column:
    point = F.struct(F.col("normalized_path").alias("path"), F.col("line").alias("line"), F.col("column").alias("column"), F.col("source_start").alias("offset"))
    return F.when(F.col("normalized_path").isNotNull() & F.col("source_start").isNotNull(), point)


def symbol_object(df: DataFrame, show_source: bool = False, **style) -> Column:
    depth = _optional(df, "async_involvement_depth", "int")
    roles = F.array_join(F.filter(F.array(*[F.when(F.col("async_role").bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(T.ROLE_NAMES)]), lambda x: x.isNotNull()), ", ")
    parameters = F.transform("parameters", lambda p: p["type_display"]) if "parameters" in df.columns else F.array().cast("array<string>")
    fields = {
        "id": F.col("id"), "stableKey": F.col("stable_key"), "kind": F.lower(T.enum_name(F.col("kind"), SymbolKind)), "displayName": display_name(df, **style), "signature": signature(df, **style),
        "fullyQualifiedName": display_name(df, "explicit", style.get("short", False)), "namespaceName": F.col("namespace_name"), "typeSimpleName": _optional(df, "type_simple_name"), "parameters": parameters,
        "location": location_object(df), "isGenerated": _optional(df, "is_generated", "boolean"), "assemblyName": _optional(df, "assembly_name"), "accessibility": _named(_optional(df, "accessibility", "int"), ACCESS),
        "isStatic": _optional(df, "is_static", "boolean"), "isAsync": F.col("async_role") != 0, "asyncRole": F.when(F.col("async_role") == 0, "None").otherwise(roles), "isAsyncInvolved": depth.isNotNull(),
        "asyncInvolvementDepth": depth, "returnType": _optional(df, "return_type_display"), "methodKind": _optional(df, "method_kind", "int"), "sourceAvailable": F.col("preferred_declaration_id").isNotNull(),
    }
    if show_source:
        fields["normalizedSource"] = F.col("source")
    if "declaration_role" in df.columns:
        fields["declarationRole"] = _named(F.col("declaration_role"), ROLES)
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def call_object(calls: DataFrame, show_source: bool = False) -> Column:
    fields = {
        "id": F.col("id"), "caller": F.col("caller_name"), "callee": F.coalesce("target_name", "unresolved_name"), "referenceKind": T.enum_name(F.col("reference_kind"), ReferenceKind),
        "dispatchKind": T.enum_name(F.col("dispatch_kind"), DispatchKind), "resolutionStatus": T.enum_name(F.col("resolution_status"), ResolutionStatus), "resolutionReason": T.enum_name(F.col("resolution_reason"), ResolutionReason),
        "asyncUsageKind": T.enum_name(F.col("async_usage_kind"), AsyncUsage), "location": location_object(calls), "isGenerated": _optional(calls, "is_generated", "boolean"),
        "unresolvedName": F.when(F.col("callee_symbol_id").isNull() & F.col("callee_definition_id").isNull(), F.col("unresolved_name")), "receiverTypeKey": _optional(calls, "receiver_type_key"),
    }
    if show_source:
        fields["normalizedSource"] = F.col("source")
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def relation_object(relations: DataFrame) -> Column:
    return F.struct(F.col("source_name").alias("source"), F.col("target_name").alias("target"), T.enum_name(F.col("relation_kind"), RelationKind).alias("kind"))


def condition_object() -> Column:
    return F.struct(F.col("symbol_name").alias("symbolName"), F.col("documents").alias("fileCount"), F.col("occurrences").alias("occurrenceCount"), F.col("is_defined").alias("isDefined"))


def json_lines(df: DataFrame, value: Column) -> DataFrame:
    """One JSON object a row, nulls written, with the row's place."""
    return df.select(*[c for c in ("place",) if c in df.columns], F.to_json(value, {"ignoreNullFields": "false"}).alias("json"))
