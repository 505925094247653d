"""Inputs: what kind a path is, which files it has, and their texts."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.functions.text import generation_kind
from skeingraph.plans.globs import exclude as exclude_pattern
from skeingraph.schema import InputMode


class InputError(ValueError):
    """The input path can't be used."""


@dataclass(frozen=True)
class ResolvedInput:
    mode: InputMode
    root: str
    paths: tuple[str, ...]


SOLUTION, PROJECT = (".sln", ".slnx"), (".csproj",)


def resolve_input(path: str) -> ResolvedInput:
    """A solution or project file; a folder's only solution, else its projects, else the folder itself. Several solutions are an error."""
    p = Path(path)
    if p.is_file():
        for mode, endings in ((InputMode.SOLUTION, SOLUTION), (InputMode.PROJECT, PROJECT)):
            if p.suffix.lower() in endings:
                return ResolvedInput(mode, str(p.parent), (str(p),))
        raise InputError(f"not a solution or project: {path}")
    if not p.is_dir():
        raise InputError(f"no such input: {path}")
    here = sorted(str(x) for x in p.iterdir() if x.is_file())
    solutions = [x for x in here if x.lower().endswith(SOLUTION)]
    if len(solutions) > 1:
        raise InputError(f"several solutions in {path}; name one")
    if solutions:
        return ResolvedInput(InputMode.SOLUTION, str(p), tuple(solutions))
    projects = sorted(str(x) for x in p.rglob("*") if x.suffix.lower() in PROJECT)
    return ResolvedInput(InputMode.PROJECT, str(p), tuple(projects)) if projects else ResolvedInput(InputMode.DIRECTORY, str(p), (str(p),))


def enumerate_sources(spark: SparkSession, root: str, excludes: list[str] = ()) -> DataFrame:
    """path (relative), full_path, length, included of all *.cs files below root; files below an `obj` folder are left out."""
    top = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS]").load(top).select("path", "length")
    base = top if "://" in top else "file:" + os.path.abspath(top)
    relative = F.regexp_replace(F.substr("path", F.length(F.lit(base)) + 1), "^/+", "")
    rows = files.select(relative.alias("path"), F.col("path").alias("full_path"), "length").where(~F.concat(F.lit("/"), "path").rlike("(?i)/obj/"))
    return rows.withColumn("included", included(F.col("path"), list(excludes)))


def included(path: Column, excludes: list[str]) -> Column:
    out = F.lit(True)
    for e in excludes:
        out &= ~path.rlike(exclude_pattern(e))
    return out


def in_order(files: DataFrame) -> DataFrame:
    return files.orderBy(F.upper("path"), "path")


def load_directory(spark: SparkSession, root: str, excludes: list[str] = ()) -> DataFrame:
    """path, text, generation_kind and content_hash of the included files, read whole as UTF-8; the files make one virtual project."""
    rows = enumerate_sources(spark, root, excludes).where("included").select("path", "full_path")
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS]").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("full_path"), F.col("value").alias("text"))
    # Both listings spell a path as the file system does, one with file:// and one with file:.
    key = F.regexp_replace("full_path", "^file:/+", "file:/")
    rows = rows.withColumn("full_path", key).join(texts.withColumn("full_path", key), "full_path")
    return rows.select("path", "text", generation_kind(F.col("path"), F.col("text")).alias("generation_kind"), F.unhex(F.sha2("text", 256)).alias("content_hash"))


def read_defines(spark: SparkSession, paths: list[str]) -> list[str]:
    """Symbols of define files: trimmed lines that are neither empty nor start with #, once each."""
    lines = spark.read.text(paths).select(F.trim("value").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return sorted(r["line"] for r in lines.distinct().collect())


def disposition(same_volume: Column, generated: Column) -> Column:
    """`index`, `compile` (generated, elsewhere) or `error`."""
    return F.when(same_volume, "index").when(generated, "compile").otherwise("error")
