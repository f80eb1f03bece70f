"""What several operators share: lineage cuts, bounded key filters, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session
    gets a new folder, and any other raises."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="gavelflow-"))
    return configured or sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


_released = 0.0


def release(spark: SparkSession, pause: float = 5.0) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them once the driver has collected
    the handles, which may otherwise take as long as the application lives. Not more often than every pause
    seconds, as each is a full collection."""
    global _released
    if time.monotonic() - _released < pause:
        return
    _released = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_KEPT: set[str] = set()


def forget(spark: SparkSession) -> None:
    """Delete the tables that results returned so far still read. For callers that have stored or read them."""
    while _KEPT:
        remove(spark, _KEPT.pop())


class Stage:
    """Intermediate results as tables in the shared folder, so that no later job computes them again
    and a lost executor costs no recomputation. They go when the block ends, but for those kept, which
    the results read: these stay until forget()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)
        release(self.spark)

    def cut(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = scratch(self.spark, "stage")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        (_KEPT if keep else self.paths).add(path)
        out._stage_path = path
        release(self.spark)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that are not needed any more."""
        for df in frames:
            remove(self.spark, df._stage_path)
            self.paths.discard(df._stage_path)
            _KEPT.discard(df._stage_path)


class KeyFilter:
    """A set of 64-bit keys as a bitmap of bounded size; it also lets some other keys through.

    It only saves shuffling: whoever uses it joins exactly afterwards. Beyond max_bits / 16 keys the bitmap
    stays as large as it is and lets ever more other keys through, so that the answer is the same at any
    size and the shuffle grows towards that of all rows.
    """

    #: 16 MB
    MAX_BITS = 1 << 27

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def build(cls, keys: DataFrame, column: str, max_bits: int | None = None, spread: int = 16) -> KeyFilter:
        """spread: bits a key at least, as long as max_bits allow it; more of them let fewer other keys through."""
        n = keys.count()
        bits = min(1 << max(16, (spread * n - 1).bit_length() if n else 16), max_bits or cls.MAX_BITS)
        part = keys.select(
            F.expr(f"shiftrightunsigned({column}, 6) & {bits // 64 - 1}L").alias("w"),
            F.expr(f"shiftleft(1L, cast({column} & 63L as int))").alias("b"),
        )
        rows = part.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(bits // 64, dtype=np.uint64)
        words[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
        return cls(words)

    def mask(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (uint64) may be in the set."""
        w = self.words[((keys >> np.uint64(6)) & np.uint64(len(self.words) - 1)).astype(np.int64)]
        return (w >> (keys & np.uint64(63))) & np.uint64(1) != 0


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and in count how many rows of left have it. Keys with
    more rows than half a partition's share are hot; there are at most twice as many as partitions, so these
    rows of right are broadcast and their rows of left stay where they are; the others are shuffled."""
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = right.agg(F.sum(count)).first()[0] or 0
    limit = max(1000, total // (2 * parts))
    hot = F.broadcast(right.where(F.col(count) > limit))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(count) <= limit), keys, how)
    return left.join(hot, keys, how).unionByName(cold)


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, comp): each node of the edges (a, b) with the least node that it is connected to.

    Alternating large-star and small-star rounds, which need a logarithmic number of rounds; the
    lineage is cut after each. Both stars aggregate by node; no group is collected.
    """
    e = stage.cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    state = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        small = large.join(low, "a").select(linked.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = stage.cut(small)
        stage.drop(e)
        e, old = new, state
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == old:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
