"""Exports: tables as JSON lines or Parquet with a manifest, and idempotent imports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .files import Files
from .store import Snapshot

ROW_GROUP = 8 << 20  # bytes of a row group


def canonical_row(df: DataFrame) -> Column:
    """A row as compact JSON with its columns in the order of their names, unknown values stated as null."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def export(
    snapshot: Snapshot, out: str, fmt: str = "parquet", capture_id=None, tables: Sequence[str] | None = None, order: Mapping[str, Sequence[str]] | None = None
) -> dict:
    """Writes tables of one pinned version (of one capture, if named, where they have captures) and then a manifest, which it returns.

    fmt: parquet, or jsonl for canonical JSON lines. order: columns that a table's files follow, from the first file to the last.
    All tables are of the same version however long the writing takes. The manifest comes last, by one rename: a
    folder without one is no export. It holds the version, the rows that were written of each table, their schemas and the
    versions of the reducers that made them.
    """
    spark = snapshot.store.spark
    if fmt not in ("parquet", "jsonl"):
        raise ValueError(f"no format {fmt}")
    files = Files(spark, out)
    if "manifest.json" in files.names(out):
        raise ValueError(f"{out} holds an export")
    names, reducers, told = sorted(tables or snapshot.names()), snapshot.reducers(), {}
    for name in names:
        rows = snapshot.table(name)
        rows = rows.where(F.col("capture_id") == capture_id) if capture_id is not None and "capture_id" in rows.columns else rows
        by = (order or {}).get(name)
        if by:
            rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
        at = f"{out}/{name}"
        if fmt == "parquet":
            rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(at)
        else:
            rows.select(canonical_row(rows).alias("value")).write.mode("overwrite").text(at)
        written = spark.read.parquet(at) if fmt == "parquet" else spark.read.text(at)
        told[name] = {"rows": written.count(), "schema": rows.schema.jsonValue(), "reducer": reducers.get(name)}
    manifest = {"format": fmt, "version": snapshot.version, "capture_id": capture_id, "tables": told}
    if not files.write_new(f"{out}/manifest.json", json.dumps(manifest, sort_keys=True)):
        raise ValueError(f"{out} holds an export")
    return manifest


def read_export(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of an export by its manifest; raises if there is none or a count isn't the manifest's."""
    from pyspark.sql.types import StructType

    files = Files(spark, out)
    if "manifest.json" not in files.names(out):
        raise ValueError(f"{out} holds no export")
    manifest, tables = json.loads(files.read(f"{out}/manifest.json")), {}
    for name, told in manifest["tables"].items():
        schema = StructType.fromJson(told["schema"])
        if manifest["format"] == "parquet":
            tables[name] = spark.read.schema(schema).parquet(f"{out}/{name}")
        else:
            tables[name] = spark.read.text(f"{out}/{name}").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        found = tables[name].count()
        if found != told["rows"]:
            raise ValueError(f"{name}: {found} rows, the manifest says {told['rows']}")
    return tables


def fresh_only(incoming: DataFrame, stored: DataFrame, ident: str) -> DataFrame:
    """Incoming rows whose id isn't stored, each id once."""
    one = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(ident).orderBy(*[c for c in incoming.columns if c != ident]))).where("__n = 1").drop("__n")
    return one.join(stored.select(ident), ident, "left_anti")


def conflicts(incoming: DataFrame, stored: DataFrame, ident: str) -> DataFrame:
    """Ids that are stored with other values, and the columns that differ; unknown equals unknown."""
    names = [c for c in incoming.columns if c != ident]
    s = stored.select(ident, *[F.col(c).alias(f"__{c}") for c in names])
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in names]))
    return incoming.join(s, ident).select(ident, differ.alias("columns")).where("size(columns) > 0")


def upsert(stored: DataFrame, incoming: DataFrame, ident: str) -> DataFrame:
    """stored with incoming rows replacing those of the same id."""
    return stored.join(incoming.select(ident).distinct(), ident, "left_anti").unionByName(incoming)


def replace_sessions(stored: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """stored with all rows of the rebuilt sessions replaced."""
    return upsert(stored, rebuilt, key)


def purge(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")
