"""Incremental refresh: a stream of file snapshots applied to a fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.changes import snapshot_diff


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last state of each key in a batch of changes."""
    rest = [c for c in changes.columns if c not in (key, order)]
    return changes.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in (order, *rest)])


def upserted(facts: DataFrame, changes: DataFrame, key: str, order: str, removed: str = "removed") -> DataFrame:
    """Facts with a batch applied: changed keys replaced, removed ones gone."""
    new = latest(changes, key, order)
    return facts.join(new.select(key), key, "left_anti").unionByName(new.where(~F.col(removed)).select(*facts.columns))


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "path", order: str = "mtime_ms") -> StreamingQuery:
    """Follows a folder of change files; each micro-batch writes the next version of the table
    under ``target``, so a repeated batch writes the same version again."""

    def apply(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        columns = [c for c in batch.columns if c != "removed"]
        before = s.read.parquet(f"{target}/v{epoch - 1}") if epoch else s.createDataFrame([], batch.select(*columns).schema)
        upserted(before, batch, key, order).write.mode("overwrite").parquet(f"{target}/v{epoch}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


BUCKETS, KEPT = 64, 2


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _names(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the complete versions of a bucketed table, in order."""
    found = [int(x[1:]) for x in _names(spark, f"{target}/manifest") if x[:1] == "v" and x[1:].isdigit()]
    return sorted(v for v in found if _exists(spark, f"{target}/manifest/v{v}/_SUCCESS"))


def _manifest(spark: SparkSession, target: str, version: int | None) -> dict[int, int]:
    """By bucket the version that wrote it last."""
    return {} if version is None else {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{target}/manifest/v{version}").collect()}


def _buckets_of(spark: SparkSession, target: str, manifest: dict[int, int], schema) -> DataFrame:
    paths = [f"{target}/data/v{v}/bucket={b}" for b, v in sorted(manifest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucketed(spark: SparkSession, target: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a bucketed table, of its last version or of an earlier one that is still kept."""
    known = versions(spark, target)
    at = (known[-1] if known else None) if version is None else version
    return _buckets_of(spark, target, _manifest(spark, target, at), schema)


def apply_batch(spark: SparkSession, batch: DataFrame, epoch: int, target: str, key: str = "path", order: str = "mtime_ms", buckets: int = BUCKETS, kept: int = KEPT) -> list[int]:
    """Writes version ``epoch`` of a bucketed table: the buckets that the batch's keys fall into are read,
    brought up to date and written anew, all others stay where they are. Gives those buckets.

    A version's manifest says which version wrote each bucket and is complete only once all its
    files are; a batch that is run again makes the same version from the same one before it. Versions that no
    manifest of the last ``kept`` names are deleted.
    """
    columns = [c for c in batch.columns if c != "removed"]
    schema = batch.select(*columns).schema
    batch = batch.withColumn("bucket", _bucket(key, buckets))
    touched = sorted(r[0] for r in batch.select("bucket").distinct().collect())
    earlier = [v for v in versions(spark, target) if v < epoch]
    manifest = _manifest(spark, target, earlier[-1] if earlier else None)
    before = _buckets_of(spark, target, {b: v for b, v in manifest.items() if b in touched}, schema)
    after = upserted(before, batch.drop("bucket"), key, order).withColumn("bucket", _bucket(key, buckets))
    folder = f"{target}/data/v{epoch}"
    if touched:
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    written = {int(x.removeprefix("bucket=")) for x in _names(spark, folder) if x.startswith("bucket=")} if touched else set()
    manifest = {b: v for b, v in manifest.items() if b not in touched} | dict.fromkeys(written, epoch)
    rows = spark.createDataFrame(sorted(manifest.items()), "bucket int, version long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/v{epoch}")
    _expire(spark, target, kept)
    return touched


def _expire(spark: SparkSession, target: str, kept: int) -> None:
    known = versions(spark, target)
    live = {v for m in known[-kept:] for v in _manifest(spark, target, m).values()} | set(known[-kept:])
    for folder, names in ((f"{target}/manifest", known), (f"{target}/data", [int(x[1:]) for x in _names(spark, f"{target}/data") if x[1:].isdigit()])):
        for v in names:
            if v < known[-1] and (v not in live if folder.endswith("data") else v not in known[-kept:]):
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{v}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def follow_buckets(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "path", order: str = "mtime_ms", buckets: int = BUCKETS, kept: int = KEPT) -> StreamingQuery:
    """``follow`` for large tables: a micro-batch rewrites the buckets of its keys alone (see ``apply_batch``)."""

    def apply(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        apply_batch(batch.sparkSession, batch, epoch, target, key, order, buckets, kept)
        batch.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["apply_batch", "bucketed", "follow", "follow_buckets", "latest", "snapshot_diff", "upserted", "versions"]
