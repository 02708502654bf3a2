"""Inventory (lpar) table operations as batch DataFrame plans: D7-D10,
E4-E6, B9, plus the criteria reads of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sinks import append_table

MIGRATE_COLUMNS = ["lpar", "hostname", "dataset", "username", "enable"]


def criteria_eq(frame: DataFrame, condition: dict) -> DataFrame:
    """AND of column equalities."""
    if not condition:
        return frame
    return frame.filter(reduce(lambda a, b: a & b,
                               [F.col(k) == F.lit(v) for k, v in condition.items()]))


def criteria_in(frame: DataFrame, in_values: dict) -> DataFrame:
    """Every listed column IN its list (all fields honoured)."""
    if not in_values:
        return frame
    return frame.filter(reduce(lambda a, b: a & b,
                               [F.col(k).isin(list(v)) for k, v in in_values.items()]))


def criteria_read(frame: DataFrame, distinct=None, criteria=None, in_values=None) -> DataFrame:
    """Equality criteria, IN lists and a distinct projection composed."""
    out = criteria_in(criteria_eq(frame, criteria or {}), in_values or {})
    if distinct:
        cols = [c.strip() for c in distinct.split(",")] if isinstance(distinct, str) else list(distinct)
        out = out.select(*cols).distinct()
    return out


def enabled_systems(lpar: DataFrame) -> DataFrame:
    """D10."""
    return lpar.filter(F.col("enable") == 1)


def insert_if_absent(lpar: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows whose hostname is not present yet (one per hostname, the
    smallest id), enabled."""
    return lpar.unionByName(absent_rows(lpar, new).select(*lpar.columns))


def absent_rows(lpar: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that E4 adds."""
    fresh = new.join(lpar.select("hostname").distinct(), "hostname", "left_anti")
    first = fresh.groupBy("hostname").agg(F.min("id").alias("id"))
    return fresh.join(first, ["hostname", "id"]).withColumn("enable", F.lit(1))


def update_rows(lpar: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """E5: batch merge by key: non-null update values replace old ones.  A key
    that stands in ``updates`` twice fails the job (it would multiply rows)."""
    cols = [c for c in updates.columns if c != key]
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(
        F.lit(f"repeated {key} in updates: "), F.first(key).cast("string"))))
    u = updates.groupBy(key).agg(F.first(F.struct(*cols)).alias("_v"), once.alias("_once"))
    u = u.select(key, *[F.when(F.col("_once").isNull(), F.col("_v")[c]).alias(f"_u_{c}") for c in cols])
    joined = lpar.join(u, key, "left")
    return joined.select(*[
        F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
        for c in lpar.columns])


def delete_by_key(frame: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Remove rows whose key is in ``keys``."""
    return frame.join(keys.select(key).distinct(), key, "left_anti")


# ------------------------------------------------------------- stored table
#: A stored inventory has a folder for each hash bucket of the id; a change replaces the folders it touches.
INVENTORY_BUCKET = "id_bucket"
INVENTORY_BUCKETS = 64


def _bucketed(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.withColumn(INVENTORY_BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(INVENTORY_BUCKETS)).cast("int"))


def write_inventory(rows: DataFrame, path: str) -> None:
    """Store ``rows`` as a new inventory table."""
    _bucketed(rows).repartition(INVENTORY_BUCKET).write.partitionBy(INVENTORY_BUCKET).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored_inventory(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).drop(INVENTORY_BUCKET)


def insert_stored(spark: SparkSession, path: str, new: DataFrame) -> int:
    """E4 on the stored table: the added rows are appended, no file is rewritten; returns their number."""
    held = stored_inventory(spark, path)
    added = written(_bucketed(absent_rows(held, new).select(*held.columns)), "inventory-added")
    n = added.count()
    if n:
        added.repartition(INVENTORY_BUCKET).write.mode("append").partitionBy(INVENTORY_BUCKET).parquet(path)
    return n


def _replace(spark: SparkSession, path: str, touched: list[int], change) -> None:
    """Replace the touched buckets by ``change`` of their rows.  The new rows are staged first, so
    the table is not read while its folders are replaced; other folders keep their files."""
    rows = _read(spark, path).where(F.col(INVENTORY_BUCKET).isin(touched))
    staged = written(_bucketed(change(rows.drop(INVENTORY_BUCKET))), "inventory-staged")
    kept = {r[0] for r in staged.select(INVENTORY_BUCKET).distinct().collect()}
    (staged.repartition(INVENTORY_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(INVENTORY_BUCKET).parquet(path))
    jvm = spark.sparkContext._jvm
    for bucket in set(touched) - kept:   # a bucket that has lost its last row: at most INVENTORY_BUCKETS
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{INVENTORY_BUCKET}={bucket}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _touched(keys: DataFrame, key: str) -> list[int]:
    return [r[0] for r in _bucketed(keys.select(key), key).select(INVENTORY_BUCKET).distinct().collect()]


def update_stored(spark: SparkSession, path: str, updates: DataFrame) -> None:
    """E5 on the stored table, by id."""
    updates = written(updates, "inventory-updates")
    touched = _touched(updates, "id")
    if touched:
        _replace(spark, path, touched, lambda rows: update_rows(rows, updates))


def delete_stored(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """E6 on the stored table, by id."""
    keys = written(keys.select("id"), "inventory-keys")
    touched = _touched(keys, "id")
    if touched:
        _replace(spark, path, touched, lambda rows: delete_by_key(rows, keys))


def migrate_inventory(legacy: DataFrame, table: str) -> DataFrame:
    """Append the five columns of the legacy table to the new ``table``
    (name or path); returns the rows inserted."""
    rows = legacy.select(*MIGRATE_COLUMNS)
    append_table(rows, table)
    return rows
