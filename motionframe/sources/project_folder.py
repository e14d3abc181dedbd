"""Project folders: tracks stored by camera and landmark, saved by content, committed by a manifest, rolled back at will.

Layout: ``data/version=<v>/camera=<c>/name=<n>`` holds the partitions that version ``v`` wrote, ``manifest/version=<v>``
says for every partition of the project which version's files are its own, and their digest. A save writes only the
partitions whose digest differs from the last manifest's, then the manifest; a manifest counts once its folder has
the file that Spark writes last (``_SUCCESS``), so a torn save leaves the version before it as the current one.
Nothing is overwritten: readers of an old version aren't disturbed, and going back to it is another manifest.

A digest is the number of rows and the sums of two hashes of each row: the same whatever the order of the rows and
of the tasks, combined before the shuffle, so that a partition that holds most rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.sources.scratch import written

KEYS = ("camera", "name")
#: So many partitions are told to every task at most.
BROADCAST = 100_000
MANIFEST = "camera string, name string, version int, digest string, rows long"


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, path: str, kind: str) -> list[tuple[int, bool]]:
    """(version, complete) of the folders below ``path/kind``, in order."""
    fs, target = _files(spark, f"{path}/{kind}")
    if not fs.exists(target):
        return []
    found = []
    for s in fs.listStatus(target):
        if (name := s.getPath().getName()).startswith("version="):
            done = _files(spark, f"{path}/{kind}/{name}/_SUCCESS")[1]
            found.append((int(name.removeprefix("version=")), bool(fs.exists(done))))
    return sorted(found)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions in order."""
    return [v for v, complete in _versions(spark, path, "manifest") if complete]


def _digest(cells: DataFrame) -> list[Column]:
    """digest and rows of a group; NULL is a mark of its own, for hash functions skip it."""
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sorted(cells.columns)]
    row = F.concat_ws("\x1f", *values)
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    sums = F.concat_ws(" ", F.count("*").cast("string"), total(F.xxhash64(row)), total(F.xxhash64(F.reverse(row), F.lit(1))))
    return [F.sha2(sums, 256).alias("digest"), F.count("*").alias("rows")]


def digests(cells: DataFrame) -> DataFrame:
    """(camera, name, digest, rows) of each partition of ``cells``."""
    return cells.groupBy(*KEYS).agg(*_digest(cells))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(camera, name, version, digest, rows) of the project as of a version, by default the last one; empty where there is none."""
    done = versions(spark, path)
    if version is None and not done:
        return spark.createDataFrame([], MANIFEST)
    if version is not None and version not in done:
        raise ValueError(f"no committed version {version}")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={done[-1] if version is None else version}")


def save(cells: DataFrame, path: str) -> int:
    """Stores ``cells`` (camera, name, frame, ...) as a new version and returns its number; the last one's, where nothing changed."""
    spark = cells.sparkSession
    done = versions(spark, path)
    # What torn saves began is passed over, never written into.
    version = 1 + max([v for kind in ("data", "manifest") for v, _ in _versions(spark, path, kind)], default=0)
    cells = written(cells, "project")
    new, old = written(digests(cells), "digests"), manifest(spark, path)
    same = old.withColumnRenamed("version", "was").select(*KEYS, "was", "digest")
    listed = written(new.join(same, [*KEYS, "digest"], "left").select(*KEYS, F.coalesce("was", F.lit(version)).cast("int").alias("version"), "digest", "rows"), "manifest")
    changed = listed.where(F.col("version") == version).select(*KEYS)
    if done and changed.isEmpty() and listed.count() == old.count():
        return done[-1]
    # Large partitions are spread over tasks, small ones share them.
    cells.join(changed, list(KEYS), "left_semi").hint("rebalance", *map(F.col, KEYS)).write.partitionBy(*KEYS).parquet(f"{path}/data/version={version}")
    listed.coalesce(1).write.parquet(f"{path}/manifest/version={version}")  # a row for each partition
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The cells of a version, by default the last one; partitions that the manifest doesn't list are pruned before they are read."""
    listed = manifest(spark, path, version)
    used = sorted(r["version"] for r in listed.select("version").distinct().collect())
    if not used:
        raise ValueError("no committed version")
    data = spark.read.option("basePath", f"{path}/data").option("mergeSchema", True).parquet(*(f"{path}/data/version={v}" for v in used))
    data = data.withColumns({c: F.col(c).cast("string") for c in KEYS} | {"version": F.col("version").cast("int")})
    listed = listed.select(*KEYS, "version")
    return data.join(F.broadcast(listed) if listed.count() <= BROADCAST else listed, [*KEYS, "version"]).drop("version")


def damaged(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(camera, name) of partitions whose files don't give the digest that the manifest has."""
    listed = manifest(spark, path, version)
    return listed.join(digests(load(spark, path, version)), [*KEYS, "digest"], "left_anti").select(*KEYS)


def roll_back(spark: SparkSession, path: str, version: int) -> int:
    """Makes an earlier version the current one again, as a new version that shares its files."""
    listed = manifest(spark, path, version)
    new = 1 + max(v for kind in ("data", "manifest") for v, _ in _versions(spark, path, kind))
    listed.coalesce(1).write.parquet(f"{path}/manifest/version={new}")
    return new


def stale_exports(spark: SparkSession, path: str, exports: DataFrame) -> DataFrame:
    """(camera, name) that exports must be made again for: ``exports`` (camera, name, digest) has what each was made from."""
    return manifest(spark, path).join(exports.select(*KEYS, "digest"), [*KEYS, "digest"], "left_anti").select(*KEYS)
