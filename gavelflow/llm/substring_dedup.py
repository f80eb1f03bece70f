"""Substring dedup by a log-structured fingerprint index.

The index holds, in sorted immutable runs (bucketed and sorted tables), the fingerprints of all
earlier documents' 13-word windows: each window is represented by its anchor (see anchors.py),
which equal windows share. A new batch's fingerprints are merge-joined with every run, without
shuffling the runs; what meets is verified window by window on a second 64-bit hash that is made from the
words again and has nothing in common with the fingerprint, and the batch becomes a run. When there are more than max_runs runs, all are merged into one (compaction).

Rows: a word goes if a window that covers it also starts in a document with a smaller doc_id.
Null or short texts have no windows. Rows with a null doc_id keep all their words and are the
source of no removal. Rows that share a doc_id are judged against smaller ids only, so equal rows
stay equal. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import textbytes as tb
from gavelflow.llm import worker
from gavelflow.llm.anchors import Windows, anchor_rows, apply_ranges, gone, segment_rows
from gavelflow.llm.common import KeyFilter, Stage, hot_join, release, remove, scratch

WINDOW = 13
ANCHOR = 4
MAX_RUNS = 2
BATCHES = 3


class FingerprintIndex:
    """Runs of (fp, id): one row for each anchor and document, and the least id of hot anchors."""

    def __init__(self, spark: SparkSession, stage: Stage, buckets: int | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.stage, self.max_runs = spark, stage, max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, str]] = []

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"fp_run_{uuid.uuid4().hex}", scratch(self.spark, "fp-run")
        out = rows.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).option("compression", "zstd")
        out.format("parquet").saveAsTable(name)
        release(self.spark)
        return name, path

    def add(self, fingerprints: DataFrame) -> DataFrame:
        """Take in a batch of (fp, lo, hi): the least and greatest id that have fp in the batch. Returns
        the fingerprints that the batch shares with the runs or that two of its documents share."""
        if len(self.runs) >= self.max_runs:
            self.compact()
        run = self._write(fingerprints)
        batch = self.spark.table(run[0])
        shared = batch.where("lo < hi").select("fp")
        for name, _ in self.runs:
            shared = shared.unionByName(batch.join(self.spark.table(name).select("fp"), "fp", "left_semi").select("fp"))
        self.runs.append(run)
        return self.stage.cut(shared)

    def compact(self) -> None:
        """Merge the sorted runs into one. No row moves to another bucket."""
        rows = None
        for name, _ in self.runs:
            part = self.spark.table(name)
            rows = part if rows is None else rows.unionByName(part)
        merged = self._write(rows.groupBy("fp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        self.drop()
        self.runs = [merged]

    def drop(self) -> None:
        for name, path in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)
        self.runs = []


def batch_edges(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into so many batches of about as many rows, in the order of ids."""
    at = [(i + 1) / batches for i in range(batches - 1)]
    found = docs.agg(F.percentile_approx("doc_id", at, 1000).alias("q")).first()["q"] if at else None
    return sorted(set(found or []))


def duplicate_ranges(docs: DataFrame, windows: Windows, stage: Stage, batches: int = BATCHES) -> DataFrame:
    """(id, t, start, n): runs of n windows, from item start on, that start in a smaller id too; t is the
    hash of the text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    edges = batch_edges(docs, batches)
    index = FingerprintIndex(spark, stage)
    shared = None
    try:
        for lo, hi in zip([None, *edges], [*edges, None], strict=True):
            batch = docs
            if lo is not None:
                batch = batch.where(F.col("doc_id") > lo)
            if hi is not None:
                batch = batch.where(F.col("doc_id") <= hi)
            found = index.add(
                anchor_rows(batch, windows).groupBy("fp").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
            )
            shared = found if shared is None else shared.unionByName(found)
    finally:
        index.drop()
    wanted = spark.sparkContext.broadcast(KeyFilter.build(shared, "fp"))
    key = ["fp", "seg"]

    seg = stage.cut(segment_rows(docs, windows, wanted, payload="none").drop("payload", "places"))
    # level 1: equal segments; all but those in the least document are removed whole
    least = seg.groupBy(*key).agg(F.min(F.struct("id", "t")).alias("m"), F.count("*").alias("c"))
    least = stage.cut(least.select(*key, F.col("m.id").alias("least"), F.col("m.t").alias("text_of"), "c"))
    whole = stage.cut(hot_join(seg, least.where("c > 1"), key, "c").where("id > least").select("id", "t", "start", "n"))
    # level 2: windows of different segments with one anchor, each segment once, in its least document
    many = least.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1")
    each = stage.cut(hot_join(least.drop("c"), stage.cut(many), ["fp"], "k", "left_semi"))
    only = spark.sparkContext.broadcast(KeyFilter.build(each, "seg"))
    texts = spark.sparkContext.broadcast(KeyFilter.build(stage.cut(each.select("text_of").distinct()), "text_of"))
    found = segment_rows(docs, windows, wanted, only=only, texts=texts).join(each, key).where("id = least and t = text_of")
    first_of = found.groupBy(*key, "id").agg(F.first("payload").alias("payload"))
    opened = stage.cut(_open(first_of))
    first = opened.groupBy("fp", "w").agg(F.min("id").alias("first"), F.count("*").alias("c"))
    first = stage.cut(first.where("c > 1"))
    parts = hot_join(opened, first, ["fp", "w"], "c").where("id > first").select(*key, F.col("id").alias("least"), "at")
    # the least document's own occurrences of the segment
    parts = stage.cut(parts)
    own = (
        parts.withColumnRenamed("least", "id").join(seg, [*key, "id"])
        .select("id", "t", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"))
    )
    return whole.unionByName(own)


def _open(each: DataFrame) -> DataFrame:
    """(fp, seg, id, at, w): one row for each window of a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("payload").to_pylist()
            if not parts:
                continue
            n = np.array([len(x) // 8 for x in parts])
            w = np.frombuffer(b"".join(parts), dtype=np.int64)
            pick = pa.array(np.repeat(np.arange(len(n)), n))
            at = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pick) for c in ("fp", "seg", "id")] + [pa.array(at.astype(np.int64)), pa.array(w)],
                ["fp", "seg", "id", "at", "w"],
            )

    return each.mapInArrow(worker.batches("anchors", run), "fp long, seg long, id long, at long, w long")


def kept_words(texts: pa.Array, starts: list, lengths: list, window: int) -> Iterator[tuple[int, int, bytes]]:
    """(words, words removed, what stays) of each text, given the windows to remove."""
    for a, b, data, offs in tb.text_slices(texts):
        words = tb.Words(data, offs)
        raw = data.tobytes()
        for i in range(a, b):
            lo, hi = int(words.offs[i - a]), int(words.offs[i - a + 1])
            s, e = words.starts[lo:hi], words.ends[lo:hi]
            removed = 0
            if starts[i]:
                out = gone(starts[i], lengths[i], window, hi - lo)
                removed = int(out.sum())
                s, e = s[~out], e[~out]
            yield hi - lo, removed, b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])


def dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each row."""
    return _run(docs, window, batches, with_text=True)


def _run(docs: DataFrame, window: int, batches: int, with_text: bool) -> DataFrame:
    last = "kept string" if with_text else "kept_sha256 string"

    def rows(batch: pa.RecordBatch, starts: list, lengths: list) -> pa.RecordBatch:
        out = list(kept_words(batch.column("text"), starts, lengths, window))
        text = [x[2].decode() if with_text else hashlib.sha256(x[2]).hexdigest() for x in out]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(text, pa.string())],
            ["doc_id", "n_words", "n_removed", last.split()[0]],
        )

    with Stage(docs.sparkSession) as stage:
        ranges = duplicate_ranges(docs, Windows("word", window, min(ANCHOR, window)), stage, batches)
        return apply_ranges(docs, ranges, rows, "doc_id long, n_words long, n_removed long, " + last)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _run(docs, WINDOW, BATCHES, with_text=False)
