"""A fact snapshot in hash buckets, kept current by a stream.

Layout of a folder: ``data/v00000003/bucket=17`` holds the files that version 3 wrote for bucket 17,
``manifest/v00000003.json`` names the directory of every bucket that has rows and the last batch
of every stream. A batch writes only the buckets of its keys; all others keep their files. Nothing
that a manifest names is ever written again, so readers of an older version are not disturbed, and
a failed batch leaves nothing but files that no manifest names. One writer to a folder.
"""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators.merge import merge_facts
from caseweave.operators.split import first_rows

KEYS = ["case_id", "fact_key"]


def _files(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions, ascending."""
    return [int(n[1:-5]) for n in _names(spark, f"{folder}/manifest") if n.startswith("v") and n.endswith(".json")]


def read_manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """The manifest of a version (None: the newest); an empty one where there is none."""
    known = versions(spark, folder)
    if not known:
        return {"version": 0, "n_buckets": None, "applied": {}, "buckets": {}}
    fs, path = _files(spark, f"{folder}/manifest/v{known[-1] if version is None else version:08d}.json")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _write_manifest(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Written aside and renamed, so that a manifest is there whole or not at all."""
    name = f"v{manifest['version']:08d}.json"
    fs, aside = _files(spark, f"{folder}/manifest/_{name}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(aside, _files(spark, f"{folder}/manifest/{name}")[1]):
        raise RuntimeError(f"version {name} of {folder} was written by another writer")


def bucket_of(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(n_buckets)).cast("int")


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The facts of a version, or of some of its buckets; None if there are no files."""
    held = read_manifest(spark, folder, version)["buckets"]
    paths = [f"{folder}/{p}" for b, p in held.items() if buckets is None or int(b) in buckets]
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def merge_batch(batch: DataFrame, n: int, folder: str, n_buckets: int, name: str = "facts") -> bool:
    """Merge batch ``n`` of the stream ``name`` into the snapshot; False if it is in there already.

    The newest payload of a key (``ord``) counts; facts that are not in the batch stay as they are.
    A stream ends batch n before it begins the next, so a number up to the last applied one is a
    repetition and changes nothing. A stream with a new checkpoint counts from 0 again and needs a
    new name. The number of buckets is fixed by the first batch; the driver sees bucket numbers, no rows.
    """
    spark = batch.sparkSession
    now = read_manifest(spark, folder)
    if n <= now["applied"].get(name, -1):
        return False
    if now["n_buckets"] not in (None, n_buckets):
        raise ValueError(f"{folder} has {now['n_buckets']} buckets, not {n_buckets}")
    newest = first_rows(batch, KEYS, [F.col("ord").desc()], 1, "_rn").drop("_rn", "ord").persist()
    try:
        touched = sorted(r[0] for r in newest.select(bucket_of(n_buckets)).distinct().collect())
        buckets, version = dict(now["buckets"]), now["version"] + 1
        if touched:
            old = read_snapshot(spark, folder, now["version"], touched) if buckets else None
            if old is None:
                none = newest.withColumns({"fact_id": F.lit(0).cast("bigint"), "review_note": F.lit(None).cast("string")}).limit(0)
                out = merge_facts(none, newest)
            else:
                keys = newest.select(*KEYS)
                out = old.join(keys, KEYS, "left_anti").unionByName(merge_facts(old.join(keys, KEYS, "left_semi"), newest), allowMissingColumns=True)
            data = f"data/v{version:08d}"
            out.withColumn("bucket", bucket_of(n_buckets)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/{data}")
            written = {p[len("bucket="):] for p in _names(spark, f"{folder}/{data}") if p.startswith("bucket=")}
            for b in map(str, touched):  # a bucket whose last fact went has no files
                buckets.pop(b, None)
                if b in written:
                    buckets[b] = f"{data}/bucket={b}"
        _write_manifest(spark, folder, {"version": version, "n_buckets": n_buckets, "applied": {**now["applied"], name: n}, "buckets": buckets})
    finally:
        newest.unpersist()
    return True


def stream_merge(folder: str, n_buckets: int = 64, name: str = "facts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over ``merge_batch``. Choose buckets of some 100 MB: one task writes a bucket."""
    return lambda batch, n: merge_batch(batch, n, folder, n_buckets, name) and None


def expire(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete manifests before the newest ``keep`` and bucket directories that no kept one names; how many directories went."""
    known = versions(spark, folder)
    kept = known[-keep:]
    named = {p for v in kept for p in read_manifest(spark, folder, v)["buckets"].values()}
    for v in known[:-keep]:
        fs, path = _files(spark, f"{folder}/manifest/v{v:08d}.json")
        fs.delete(path, False)
    gone = 0
    for v in _names(spark, f"{folder}/data"):
        if not kept or int(v[1:]) > kept[-1]:  # of a batch that is not finished
            continue
        for b in _names(spark, f"{folder}/data/{v}"):
            if b.startswith("bucket=") and f"data/{v}/{b}" not in named:
                fs, path = _files(spark, f"{folder}/data/{v}/{b}")
                gone += bool(fs.delete(path, True))
    return gone
