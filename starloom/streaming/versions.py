"""Tables in versions: data in buckets by key, and a log whose newest entry says which folder holds each bucket.

    data/<write>/_b=<n>/*.parquet     one folder a write, never changed
    log/<version>.json                {"batch", "schema", "key", "buckets", "folders": {bucket: folder, or list of folders that add up}}

A version appears when its log entry does, by a rename that fails if the entry is there. A reader holds on to the
folders of one version. What a stopped write leaves behind belongs to no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "_b"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _log(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/log")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table, oldest first."""
    return _log(spark, path)


def entry(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The log entry of a version, the newest by default."""
    version = _log(spark, path)[-1] if version is None else version
    fs, file = _fs(spark, f"{path}/log/{version:020d}.json")
    stream = fs.open(file)
    try:
        return {"version": version, **json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))}
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Make a version visible; an error if another writer has taken its number."""
    fs, target = _fs(spark, f"{path}/log/{version:020d}.json")
    _, draft = _fs(spark, f"{path}/log/.{version:020d}-{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} of {path} is there already")


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: str, buckets: int) -> str:
    folder = f"{path}/data/{uuid.uuid4().hex}"
    df.withColumn(_BUCKET, _bucket(key, buckets)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(folder)
    return folder


def _folders(spark: SparkSession, folder: str) -> dict[str, str]:
    fs, p = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {n.removeprefix(f"{_BUCKET}="): f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}


def create(df: DataFrame, path: str, key: str, buckets: int = 16) -> None:
    """Version 0 of a table whose rows are found by ``key``."""
    spark = df.sparkSession
    folders = _folders(spark, _write(df, path, key, buckets))
    _publish(spark, path, 0, {"batch": -1, "schema": df.schema.jsonValue(), "key": key, "buckets": buckets, "folders": folders})


def _of(held: str | list[str]) -> list[str]:
    return [held] if isinstance(held, str) else held


def _read(spark: SparkSession, at: dict, only: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(at["schema"])
    folders = [f for b, held in at["folders"].items() if only is None or b in only for f in _of(held)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, the newest by default. Later versions don't change what was read."""
    return _read(spark, entry(spark, path, version))


def apply_batch(path: str, batch: DataFrame, batch_id: int, keys: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], adds: bool = False) -> bool:
    """Publish the version after a batch; False if that batch is in the table already.

    ``merge(rows, batch)`` gives the new rows of the buckets that the batch's ``keys`` (one column, named like the table's
    key) fall into, from their old rows; only these buckets are read and written. It must keep keys in their buckets.
    With ``adds`` it gives only the rows to add, and these alone are written, beside what the buckets hold.
    """
    spark = batch.sparkSession
    at = entry(spark, path)
    if at["batch"] >= batch_id:
        return False
    touched = [str(r[0]) for r in keys.select(_bucket(at["key"], at["buckets"])).distinct().collect()]  # buckets are few
    after = merge(_read(spark, at, touched), batch).select(*StructType.fromJson(at["schema"]).names)
    new = _folders(spark, _write(after, path, at["key"], at["buckets"]))
    if adds:
        folders = at["folders"] | {b: [*_of(at["folders"].get(b, [])), f] for b, f in new.items()}
    else:
        folders = {b: f for b, f in at["folders"].items() if b not in touched} | new
    _publish(spark, path, at["version"] + 1, {**{k: at[k] for k in ("schema", "key", "buckets")}, "batch": batch_id, "folders": folders})
    return True


def expire(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Forget all but the newest ``keep`` versions and delete the bucket folders that none of these holds; how many went."""
    known = _log(spark, path)
    old, kept = known[:-keep], {f for v in known[-keep:] for held in entry(spark, path, v)["folders"].values() for f in _of(held)}
    gone = {f for v in old for held in entry(spark, path, v)["folders"].values() for f in _of(held)} - kept
    for v in old:
        fs, p = _fs(spark, f"{path}/log/{v:020d}.json")
        fs.delete(p, False)
    for f in gone:
        fs, p = _fs(spark, f)
        fs.delete(p, True)
    return len(gone)
