"""Session-level helpers: shared scratch space, materialised tables, checked broadcasts."""

from __future__ import annotations

import atexit
import hashlib
import io
import logging
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("keyweave")

#: Rows a side may have to be broadcast by :func:`broadcast_if_small` (8 to 16 bytes each here).
BROADCAST_ROWS = 200_000

_scratch: list[tuple[SparkSession, str]] = []
_kept: set[str] = set()
_shipped: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster an unset
    folder is an error, because a driver-local path is not readable by the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keyweave-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
        _scratch.append((spark, base))
    return base.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of ``path`` under the session's Hadoop configuration."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, label: str, kept: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    The copy lives on shared storage, so a lost executor costs no recomputation. It goes with the
    :func:`scratch_scope` it was made in, unless ``kept``, else with the session.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/keyweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    if kept:
        _kept.add(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_path(spark: SparkSession, label: str, what: str) -> str:
    """A folder in the shared space for a stored table made from ``what``, the same throughout the
    application and deleted with its scratch."""
    app = spark.sparkContext.applicationId
    path = f"{scratch_dir(spark)}/keyweave/{app}-{label}-{hashlib.md5(what.encode()).hexdigest()}"
    if (spark, path) not in _scratch:
        _scratch.append((spark, path))
        _kept.add(path)
    return path


def release(frame: DataFrame) -> None:
    """Delete what one :func:`materialize` wrote; nothing may read it any more."""
    for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
        mine = [x for x in _scratch if re.sub("^file:/+", "/", x[1]) == re.sub("^file:/+", "/", path)]
        for entry in mine:
            _scratch.remove(entry)
            delete_path(*entry)


def release_scratch() -> None:
    """Delete what :func:`materialize` wrote; results that still read it must be consumed first."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone already
            log.debug("scratch %s not deleted", path)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """What is materialised inside is deleted at the end: for results that are consumed there."""
    kept = list(_scratch)
    try:
        yield
    finally:
        for spark, path in [x for x in _scratch if x not in kept and "/keyweave/" in x[1] and x[1] not in _kept]:
            _scratch.remove((spark, path))
            delete_path(spark, path)


atexit.register(release_scratch)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted ``rows`` stay below ``limit``; else leave it to AQE."""
    return F.broadcast(df) if rows <= limit else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of all executors, once per application.

    Without a shared folder it must be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    try:
        base = scratch_dir(spark)
    except RuntimeError:
        log.info("no shared folder: the package is not shipped")
        return
    root, packed = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    folder = f"{base}/keyweave/{sc.applicationId}"
    fs, path = hadoop_path(spark, f"{folder}/{root.name}.zip")
    out = fs.create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    _scratch.append((spark, folder))
    sc.addPyFile(path.toString())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores, for expensive work per row: a scan of fewer splits than the session has
    cores (one small file, say) is dealt out evenly; a larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
