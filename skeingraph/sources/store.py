"""A stored index: one folder a run, and a pointer file that is replaced last, so readers see whole runs only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.operators.integrity import check
from skeingraph.schema import SCHEMA_VERSION, SCHEMAS

POINTER = "CURRENT"


class StoreError(ValueError):
    """No index, or one of another version."""


#: Rows that are their key alone: repeated ones are one.
UNIQUE = {
    "call_candidates": ["call_id", "candidate_symbol_id"],
    "symbol_relations": ["analysis_profile_id", "source_symbol_id", "target_symbol_id", "relation_kind"],
    "interface_method_bindings": ["analysis_profile_id", "implementing_type_id", "interface_method_id", "implementation_method_id"],
}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the table's columns and types; a missing column is an error."""
    missing = [f.name for f in SCHEMAS[name] if f.name not in df.columns]
    if missing:
        raise StoreError(f"{name} lacks {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]])


def save(spark: SparkSession, root: str, profile: str, tables: dict[str, DataFrame]) -> str:
    """Checks and writes a profile's tables, then moves its pointer to them; texts that no document uses are dropped. Returns the run's folder."""
    full = {n: conform(tables[n], n) if n in tables else spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n != "schema_info"}
    for name, columns in UNIQUE.items():
        full[name] = full[name].dropDuplicates(columns)
    check(full)
    used = full["documents"].select(F.col("normalized_source_id").alias("id"))
    full["normalized_sources"] = full["normalized_sources"].dropDuplicates(["normalized_source_hash"]).join(used, "id", "left_semi").select(*SCHEMAS["normalized_sources"].names)
    full["schema_info"] = spark.createDataFrame([(SCHEMA_VERSION,)], SCHEMAS["schema_info"])
    home = f"{root.rstrip('/')}/profile={profile}"
    run = f"run-{uuid.uuid4().hex}"
    for name, df in full.items():
        df.write.parquet(f"{home}/{run}/{name}.parquet")
    fresh, fs = _fs(spark, f"{home}/.{run}")
    out = fs.create(fresh, True)
    out.write(bytearray(run.encode()))
    out.close()
    pointer, _ = _fs(spark, f"{home}/{POINTER}")
    options = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    array = spark.sparkContext._gateway.new_array(rename, 1)
    array[0] = rename.OVERWRITE
    options.rename(fresh, pointer, array)
    return f"{home}/{run}"


def load(spark: SparkSession, root: str, profile: str) -> dict[str, DataFrame]:
    """The profile's tables by name, with their fixed schemas."""
    home = f"{root.rstrip('/')}/profile={profile}"
    pointer, fs = _fs(spark, f"{home}/{POINTER}")
    if not fs.exists(pointer):
        raise StoreError(f"no index for profile {profile} in {root}")
    run = spark.read.text(f"{home}/{POINTER}").head()["value"]
    version = spark.read.schema(SCHEMAS["schema_info"]).parquet(f"{home}/{run}/schema_info.parquet").head()
    if version is None or version["version"] != SCHEMA_VERSION:
        raise StoreError(f"version {version and version['version']} is not {SCHEMA_VERSION}")
    return {n: spark.read.schema(s).parquet(f"{home}/{run}/{n}.parquet") for n, s in SCHEMAS.items()}


def is_current(runs: DataFrame, input_root: str, fingerprint: bytes, request: bytes) -> bool:
    """A stored run has this root (case aside), input fingerprint and request hash."""
    same = (F.upper("input_root") == input_root.upper()) & (F.col("input_fingerprint") == F.lit(bytearray(fingerprint))) & (F.col("request_hash") == F.lit(bytearray(request)))
    return not runs.where(same).isEmpty()


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same key; null keys are equal. Of new's rows of one key the first by its other columns stays."""
    rest = [c for c in old.columns if c not in key]
    first = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, *[F.col("_row")[c].alias(c) for c in rest]) if rest else new.select(*key).distinct()
    named = new.select(*[F.col(c).alias(f"_new_{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    return old.join(named, same, "left_anti").unionByName(first.select(*old.columns))
