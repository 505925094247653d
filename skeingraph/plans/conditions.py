"""Typed conditions: five categories, three syntaxes, include and exclude, composed into column expressions.

Globs and literals of types and methods are structured: a type's component without type arguments is not generic
(unless its name has a star), a method without a parameter list is any overload. They read the columns that selector.encoded
adds; regular expressions read the display paths as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.plans import globs, selector

#: Category: the column it looks at, and whether it belongs to a declaration.
CATEGORIES = {
    "namespace": ("namespace_name", False),
    "type": ("type_display_path", False),
    "method": ("executable_display_path", False),
    "file": ("normalized_path", True),
    "include": ("source_text", True),
    "exclude": ("source_text", True),
}
SYNTAXES = ("glob", "literal", "regex")


class ConditionError(ValueError):
    """A condition can't be compiled; nothing has been run."""


@dataclass(frozen=True)
class Condition:
    category: str
    pattern: str
    syntax: str = "glob"
    ignore_case: bool = False


def checked_regex(spark: SparkSession, pattern: str) -> str:
    """The pattern, if Java compiles it; ConditionError otherwise, before any job."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ConditionError(f"invalid regular expression {pattern!r}") from e
    return pattern


def predicate(spark: SparkSession, c: Condition) -> Column:
    """One condition. Patterns match whole values, in sources any part; literals are equality, in sources a part."""
    if c.category not in CATEGORIES or c.syntax not in SYNTAXES:
        raise ConditionError(f"unknown condition {c}")
    if not c.pattern:
        raise ConditionError("empty pattern")
    column = F.col(CATEGORIES[c.category][0])
    text = c.category in ("include", "exclude")
    pattern = c.pattern.replace("\\", "/") if c.category == "file" and c.syntax != "regex" else c.pattern
    if c.category == "method" and c.syntax != "regex":
        return selector.members_condition(selector.members(c.pattern), c.syntax == "literal", c.ignore_case)
    if c.category == "type" and c.syntax != "regex":
        return F.col("owner_type").rlike(globs.hierarchy(selector.hierarchy(c.pattern), literal=c.syntax == "literal", ignore_case=c.ignore_case))
    if c.syntax == "literal":
        if c.ignore_case:
            column, value = F.collate(column, "UTF8_LCASE"), F.collate(F.lit(pattern), "UTF8_LCASE")
            return F.contains(column, value) if text else column == value
        return column.contains(pattern) if text else column == pattern
    if c.syntax == "regex":
        checked_regex(spark, pattern)
        flags = "(?iu)" if c.ignore_case else ""
        return column.rlike(flags + (pattern if text else rf"\A(?:{pattern})\z"))
    if text:
        return column.rlike(globs.source(pattern, c.ignore_case))
    if c.category == "file":
        return column.rlike(globs.file(pattern, c.ignore_case))
    # Dotted names as paths: `*` one level, `**` several.
    as_path = F.replace(column, F.lit("."), F.lit("/"))
    return as_path.rlike(globs.file(pattern.replace(".", "/"), c.ignore_case))


@dataclass(frozen=True)
class Compiled:
    """Conditions on the symbol, and on one and the same declaration; needs_text: sources have to be read; needs_paths: symbols have to be encoded."""

    symbol: Column
    declaration: Column
    has_declaration: bool
    needs_text: bool
    needs_paths: bool = False


def compile(spark: SparkSession, conditions: list[Condition]) -> Compiled:
    """Alternatives within namespace, type, method and file; all includes; no exclude; all categories together."""
    true = F.lit(True)
    by = {k: [predicate(spark, c) for c in conditions if c.category == k] for k in CATEGORIES}
    unknown = [c for c in conditions if c.category not in CATEGORIES]
    if unknown:
        raise ConditionError(f"unknown category {unknown[0].category}")
    any_of = lambda k: reduce(lambda a, b: a | b, by[k]) if by[k] else true
    symbol = reduce(lambda a, b: a & b, [any_of(k) for k in ("namespace", "type", "method")])
    declaration = reduce(lambda a, b: a & b, [~x for x in by["exclude"]] + by["include"] + [any_of("file")])
    text = bool(by["include"] or by["exclude"])
    paths = any(c.category in ("type", "method") and c.syntax != "regex" for c in conditions)
    return Compiled(symbol, declaration, text or bool(by["file"]), text, paths)


def select(symbols: DataFrame, declarations: DataFrame, compiled: Compiled) -> tuple[DataFrame, DataFrame]:
    """The symbols, and their declarations that pass. A symbol passes if one declaration meets all conditions on declarations by itself.

    declarations: symbol_id, normalized_path, and source_text where needed."""
    s = selector.encoded(symbols) if compiled.needs_paths and "members" not in symbols.columns else symbols
    s = s.where(compiled.symbol).select(*symbols.columns)
    rows = declarations.where(compiled.declaration) if compiled.has_declaration else declarations
    rows = rows.join(s.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
    if compiled.has_declaration:
        s = s.join(rows.select(F.col("symbol_id").alias("id")), "id", "left_semi")
    return s, rows
