"""Hash sharding: assignment, layout, pruning, and the sizing helpers of hash tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions.hashes import _folded, bucket_of, fnv, shard_of
from keyweave.operators.point import KEY


def hashed_bytes(df: DataFrame, key: str) -> Column:
    """What of a key is hashed: the bytes of strings and binaries, else those of its decimal text."""
    kind = df.schema[key].dataType.typeName()
    return F.col(key) if kind in ("string", "binary") else F.col(key).cast("string")


def with_shard(df: DataFrame, n: int, key: str = KEY) -> DataFrame:
    return df.withColumn("shard", shard_of(hashed_bytes(df, key), n).cast("int"))


def with_bucket(df: DataFrame, n: int, key: str = KEY) -> DataFrame:
    return df.withColumn("bucket", bucket_of(hashed_bytes(df, key), n))


def write_shards(df: DataFrame, path: str, n: int, key: str = KEY) -> None:
    """A folder per shard; rows of a shard are written by few tasks, a hot shard by several (AQE)."""
    with_shard(df, n, key).hint("rebalance", "shard").write.partitionBy("shard").mode("overwrite").parquet(path)


def shard_number(key, n: int) -> int:
    """Shard of one key, computed on the driver for partition pruning."""
    return int(_folded(fnv([bytes(key) if isinstance(key, (bytes, bytearray)) else str(key).encode()]), n)[0])


def read_key(spark: SparkSession, path: str, key_value, n: int, key: str = KEY) -> DataFrame:
    """The record of a key from a sharded layout: one folder is listed, the key reaches the scan."""
    return spark.read.parquet(path).filter((F.col("shard") == shard_number(key_value, n)) & (F.col(key) == key_value)).drop("shard")


def count_shards(spark: SparkSession, path: str) -> int:
    """Shards present in a layout."""
    return spark.read.parquet(path).select("shard").distinct().count()


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def bucket_count(least: int) -> int:
    """At least ``least`` buckets: the next prime above 100, itself (or 1) below."""
    n = max(1, least)
    while n > 100 and not is_prime(n):
        n += 1
    return n


def should_rebuild(stats: dict[str, int]) -> bool:
    """Compaction is due: the files take more than twice their live bytes, or there are more records
    than buckets."""
    live = stats.get("live_bytes", 0)
    return (live > 0 and stats.get("file_bytes", 0) > 2 * live) or stats.get("num_records", 0) > stats.get("num_buckets", 2**62)
