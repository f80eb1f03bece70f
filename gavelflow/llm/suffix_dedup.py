"""Suffix-array dedup: remove the bytes of 200-byte strings that also start anywhere else.

Windows that share no anchor with another place (see anchors.py) are repeated nowhere and are never
shuffled. The others meet in shards by anchor; equal segments collapse, and each shard's different
segments are laid end to end, with a separator, under a suffix array built by induced sorting
(suffix_array.py). Where the permuted common prefix reaches 200 bytes, the window is repeated.
Segments are equal if two unrelated 64-bit hashes are, the anchor's and the content's. An anchor with more than MAX_GROUP different segments is taken apart by window instead, so that no
task has to hold it: its windows are counted by two 64-bit hashes.

Rows: texts are UTF-8 bytes; null counts as empty. Bytes are judged on the input; a removal may cut
a multi-byte character. Repeated rows, with one doc_id or several or none, repeat each other's
strings. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import textbytes as tb
from gavelflow.llm import worker
from gavelflow.llm.anchors import Windows, anchor_rows, apply_ranges, gone, id_key, segment_rows
from gavelflow.llm.common import KeyFilter, Stage, hot_join
from gavelflow.llm.suffix_array import repeated

WINDOW = 200
ANCHOR = 48
SHARD_BYTES = 1 << 20
MAX_GROUP = 4096


def repeated_ranges(docs: DataFrame, stage: Stage, window: int = WINDOW, max_group: int = MAX_GROUP) -> DataFrame:
    """(id, t, start, n): runs of n windows, from byte start on, whose strings start elsewhere too."""
    spark = docs.sparkSession
    windows = Windows("byte", window, min(ANCHOR, window))
    docs = docs.select(id_key().alias("doc_id"), "text")
    key = ["fp", "seg"]
    counted = anchor_rows(docs, windows).groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
    wanted = spark.sparkContext.broadcast(KeyFilter.build(stage.cut(counted), "fp"))
    seg = stage.cut(segment_rows(docs, windows, wanted, payload="none").drop("payload"))
    distinct = stage.cut(seg.groupBy(*key).agg(F.count("*").alias("c"), F.max("places").alias("places"), F.max("n").alias("n"), F.min("t").alias("text_of")))
    seg_rows = seg.select(*key, "id", "t", "start", "n")
    whole = hot_join(seg_rows, distinct.where("c > 1").select(*key, "c"), key, "c", "left_semi").select("id", "t", "start", "n")
    whole = stage.cut(whole)
    # segments that share an anchor with another one, or that may hold a string twice
    by_fp = distinct.groupBy("fp").agg(F.count("*").alias("k"), F.max("places").alias("most")).where("k > 1 or most > 1")
    open_ = stage.cut(hot_join(distinct, stage.cut(by_fp), ["fp"], "k").select(*key, "n", "k", "c", "text_of"))
    only = spark.sparkContext.broadcast(KeyFilter.build(open_, "seg"))
    # one text holds each of them; only such texts are scanned again
    texts = spark.sparkContext.broadcast(KeyFilter.build(stage.cut(open_.select("text_of").distinct()), "text_of"))
    bytes_ = segment_rows(docs, windows, wanted, payload="bytes", only=only, texts=texts).select(*key, "t", "payload")
    each = bytes_.join(open_, key).where("t = text_of").groupBy(*key).agg(
        F.first("payload").alias("payload"), F.first("n").alias("n"), F.first("k").alias("k")
    )
    each = stage.cut(each)

    size = each.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    shards = max(1, size // SHARD_BYTES)
    found = (
        each.where(F.col("k") <= max_group)
        .withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(worker.groups("anchors", _shard(window)), "fp long, seg long, at long, len int")
    )
    opened = stage.cut(_open(each.where(F.col("k") > max_group), window))
    many = stage.cut(opened.groupBy("fp", "w1", "w2").agg(F.count("*").alias("times")).where("times > 1"))
    again = hot_join(opened, many, ["fp", "w1", "w2"], "times", "left_semi")
    found = found.unionByName(again.select("fp", "seg", "at", F.lit(1).alias("len")))
    single = stage.cut(found.join(open_.where("c = 1").select(*key), key, "left_semi"))
    part = seg_rows.drop("n").join(single, key).select("id", "t", (F.col("start") + F.col("at")).alias("start"), F.col("len").alias("n"))
    return whole.unionByName(part)


def _shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        parts = table.column("payload").to_pylist()
        n = table.column("n").to_numpy()
        text = np.frombuffer(b"".join(x + b"\0" for x in parts), dtype=np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
        ends = np.cumsum(n + window) - 1  # each segment has n + window - 1 bytes
        text[ends] = 0
        mask = repeated(text, window)
        begin = ends - (n + window - 1)
        diff = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(diff, begin, 1)
        np.add.at(diff, begin + n, -1)
        inside = np.cumsum(diff[:-1]) > 0
        mask &= inside
        edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(begin, start, side="right") - 1
        pick = pa.array(owner)
        return pa.table(
            {
                "fp": table.column("fp").take(pick),
                "seg": table.column("seg").take(pick),
                "at": pa.array((start - begin[owner]).astype(np.int64)),
                "len": pa.array((end - start).astype(np.int32)),
            }
        )

    return run


def _open(each: DataFrame, window: int) -> DataFrame:
    """(fp, seg, at, w1, w2): one row for each window of a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n = batch.column("n").to_numpy()
            data = np.frombuffer(b"".join(batch.column("payload").to_pylist()), dtype=np.uint8)
            begin = np.cumsum(n + window - 1) - (n + window - 1)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = at + np.repeat(begin, n)
            w = [tb.byte_windows(data, window, seed)[start].view(np.int64) for seed in (31, 32)]
            pick = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pick) for c in ("fp", "seg")] + [pa.array(at.astype(np.int64)), *map(pa.array, w)],
                ["fp", "seg", "at", "w1", "w2"],
            )

    return each.select("fp", "seg", "n", "payload").mapInArrow(worker.batches("anchors", run), "fp long, seg long, at long, w1 long, w2 long")


def dedup(docs: DataFrame, window: int = WINDOW, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of each row."""
    return _run(docs, window, max_group, digest=False)


def _run(docs: DataFrame, window: int, max_group: int, digest: bool) -> DataFrame:
    def rows(batch: pa.RecordBatch, starts: list, lengths: list) -> pa.RecordBatch:
        out = []
        for a, b, data, offs in tb.text_slices(batch.column("text")):
            for i in range(a, b):
                text = data[offs[i - a] : offs[i - a + 1]]
                removed = spans = 0
                kept = text
                if starts[i]:
                    mask = gone(starts[i], lengths[i], window, len(text))
                    removed, kept = int(mask.sum()), text[~mask]
                    spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                raw = kept.tobytes()
                out.append((len(text), removed, spans, hashlib.sha256(raw).hexdigest() if digest else raw))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    last = "kept_sha256 string" if digest else "kept binary"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]]
    with Stage(docs.sparkSession) as stage:
        ranges = repeated_ranges(docs, stage, window, max_group)
        return apply_ranges(docs, ranges, rows, "doc_id long, n_bytes long, n_removed long, n_spans long, " + last)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _run(docs, WINDOW, MAX_GROUP, digest=True)
