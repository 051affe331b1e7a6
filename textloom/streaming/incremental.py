"""Incremental recomputation from change logs, in batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def last_changes(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's last change."""
    cols = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__c")).select(key, "__c.*")


def applied(state: DataFrame, changes: DataFrame, key: str, order: str, kind: str, columns: list[str]) -> DataFrame:
    """State after changes: the last change of a key wins; "delete" removes it."""
    last = last_changes(changes, key, order)
    stay = state.join(last.select(key), key, "left_anti").select(key, *columns)
    return stay.unionByName(last.where(F.col(kind) != "delete").select(key, *columns))


def tombstones(changes: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Keys whose last change deletes them."""
    return last_changes(changes, key, order).where(F.col(kind) == "delete").select(key)


def partial(pages: DataFrame, virtual: DataFrame, changes: DataFrame, key: str, kind: str) -> DataFrame:
    """What to emit again: changed or added pages, and all generated ones."""
    hot = changes.where(F.col(kind) != "delete").select(key).distinct()
    return pages.join(hot, key, "left_semi").unionByName(virtual, allowMissingColumns=True)


def recomputed(old: DataFrame, rows: DataFrame, changed: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An aggregate by key, rebuilt for the changed keys only."""
    keys = changed.select(key).distinct()
    fresh = build(rows.join(keys, key, "left_semi"))
    return old.join(keys, key, "left_anti").unionByName(fresh)


#: Parts that a followed state is dealt into by the hash of its key.
BUCKETS = 64


def follow(stream: DataFrame, state_path: str, key: str, order: str, kind: str, columns: list[str], checkpoint: str, emit: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS):
    """Apply a change stream to a state table, one version of it per micro-batch.

    The state lies in ``buckets`` parts by the key's hash, and a batch rewrites only the
    parts that its keys fall into (data/v=N/bucket=B).  A manifest (manifest/v=N) names the
    version of each part; it is written last, so readers never see half a batch, and a batch
    that is run again writes the same version.  Parts that only manifests before the last two
    name are deleted.  The number of buckets must stay as it was when the state began; a null
    key has a bucket like any other, but equals no key, so its rows are added and never replaced.
    """

    def batch(changes: DataFrame, n: int) -> None:
        spark = changes.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
        last = last_changes(changes, key, order).persist()
        try:
            touched = {r[0] for r in last.select(bucket).distinct().collect()}  # buckets at most
            known = _manifest(spark, state_path, n)
            schema, at = known or (last.select(key, *columns).schema, {})
            if touched:
                base = _parts(spark, state_path, schema, {b: v for b, v in at.items() if b in touched})
                new = applied(base, last, key, order, kind, columns).withColumn("bucket", bucket)
                new.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/data/v={n}")
                written = _numbers(spark, f"{state_path}/data/v={n}", "bucket=")  # a bucket left empty has no folder
                at = {b: v for b, v in at.items() if b not in touched} | dict.fromkeys(written, n)
            row = spark.createDataFrame([(schema.json(), at)], "schema string, at map<long, long>")
            row.coalesce(1).write.mode("overwrite").parquet(f"{state_path}/manifest/v={n}")
            _drop_old(spark, state_path, n)
            if emit is not None:
                emit(last, n)
        finally:
            last.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, name: str):
    """Hadoop's path and file system of a name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, name: str, prefix: str, complete: bool = False) -> list[int]:
    """N of the subfolders ``prefix``N, in order; of the finished ones if ``complete``."""
    path, fs = _folder(spark, name)
    if not fs.exists(path):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    done = lambda x: not complete or fs.exists(_folder(spark, f"{name}/{x}/_SUCCESS")[0])
    return sorted(int(x[len(prefix) :]) for x in found if x.startswith(prefix) and done(x))


def _read_manifest(spark: SparkSession, state_path: str, n: int) -> tuple[StructType, dict[int, int]]:
    row = spark.read.parquet(f"{state_path}/manifest/v={n}").first()
    return StructType.fromJson(json.loads(row["schema"])), row["at"]


def _manifest(spark: SparkSession, state_path: str, before: int | None = None) -> tuple[StructType, dict[int, int]] | None:
    """Schema and the version of each bucket in the newest manifest (below ``before``), or None."""
    found = [v for v in _numbers(spark, f"{state_path}/manifest", "v=", complete=True) if before is None or v < before]
    return _read_manifest(spark, state_path, found[-1]) if found else None


def _parts(spark: SparkSession, state_path: str, schema: StructType, at: dict[int, int]) -> DataFrame:
    """The named versions of the named buckets."""
    paths = [f"{state_path}/data/v={v}/bucket={b}" for b, v in sorted(at.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _drop_old(spark: SparkSession, state_path: str, n: int) -> None:
    """Delete the manifests before the one that precedes ``n``, and the parts that only they name."""
    found = [v for v in _numbers(spark, f"{state_path}/manifest", "v=", complete=True) if v < n]
    if len(found) < 2:
        return
    kept = set(_read_manifest(spark, state_path, found[-1])[1].items())
    for v in found[:-1]:
        for b, of in set(_read_manifest(spark, state_path, v)[1].items()) - kept:
            path, fs = _folder(spark, f"{state_path}/data/v={of}/bucket={b}")
            fs.delete(path, True)
        path, fs = _folder(spark, f"{state_path}/manifest/v={v}")
        fs.delete(path, True)


def latest(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a state table (below ``before``), or None."""
    known = _manifest(spark, state_path, before)
    return _parts(spark, state_path, *known) if known else None
