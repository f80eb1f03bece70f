"""Anchored segments: an exact way to the repeated windows of a corpus that shuffles few of them.

Every window of W items has an anchor: the least hash among its runs of K items. Equal windows
have equal anchors, so a window can only be repeated if its anchor is. A first pass counts anchors
(about two in W - K + 2 positions change them); a second pass emits only the windows whose anchor
is repeated, as segments: maximal runs of consecutive windows with one anchor in one document.
Equal segments collapse before any window is looked at by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm import textbytes as tb
from gavelflow.llm import worker
from gavelflow.llm.common import KeyFilter, Stage


class Windows:
    """Which windows: unit 'word' or 'byte', items in a window, items in an anchor."""

    def __init__(self, unit: str, window: int, anchor: int):
        self.unit, self.window, self.anchor = unit, window, anchor

    def scan(self, texts: pa.Array) -> Iterator[tuple]:
        """(first row, end row, item offsets by row, window hashes on demand, the anchor, row and start
        item of each window, bytes, segments) of each slice of the texts. Segments: the first window,
        length and number of places of the anchor of each maximal run of windows with one anchor."""
        for a, b, data, offs in tb.text_slices(texts):
            if self.unit == "word":
                words = tb.Words(data, offs)
                values, item_offs, over = words.hashes(11), words.offs, tb.windows
                again = lambda w=words: w.hashes(15)
            else:
                values, item_offs, over = data, offs, tb.byte_windows
                again = lambda d=data: d
            if len(values) < self.window:
                continue
            gram, w = over(values, self.anchor, 12), self.window - self.anchor + 1
            all_anchors = tb.sliding_min(gram, w)
            counts = np.maximum(np.diff(item_offs) - self.window + 1, 0)
            if not counts.any():
                continue
            row = np.repeat(np.arange(b - a), counts)
            start = np.arange(len(row)) + np.repeat(item_offs[:-1] - (np.cumsum(counts) - counts), counts)
            anchor = all_anchors[start]
            first, length = _segments(anchor, row)
            places = np.ones(len(first), dtype=np.int32)
            if self.unit == "byte":
                places = _places(gram, all_anchors, w, anchor[first], start[first], length)
            # of other word hashes and other steps than the anchors', so that one verifies the other
            hashes = lambda v=again, f=over: f(v(), self.window, 13)
            yield a, b, item_offs, hashes, anchor, row, start, data, (first, length, places)


def anchor_rows(docs: DataFrame, windows: Windows, id_col: str = "doc_id") -> DataFrame:
    """(fp, id, n): the anchor of each segment and the number of its places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, _, _, _, anchor, row, _, _, (first, _, places) in windows.scan(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[first].view(np.int64)), ids.take(pa.array(a + row[first])), pa.array(places)], ["fp", "id", "n"]
                )

    return docs.select(id_col, "text").mapInArrow(worker.batches("anchors", run), "fp long, id long, n int")


def _places(gram: np.ndarray, anchors: np.ndarray, w: int, fp: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """At how many places of each segment its anchor is: over 1 where it may repeat a window itself."""
    n = len(gram)
    most = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate([np.zeros(w - 1, dtype=np.uint64), anchors, np.zeros(w - 1, dtype=np.uint64)])
    most = ~tb.sliding_min(~padded, w)  # the greatest anchor among the windows that cover each place
    place = np.flatnonzero(most[:n] == gram)
    lo = np.searchsorted(place, start)
    hi = np.searchsorted(place, start + length + w - 1)
    size = hi - lo
    seg = np.repeat(np.arange(len(fp)), size)
    at = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    return np.bincount(seg[gram[place[at]] == fp[seg]], minlength=len(fp)).astype(np.int32)


def _segments(anchor: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.ones(len(anchor), dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(change)
    return first, np.diff(np.append(first, len(anchor)))


def segment_rows(
    docs: DataFrame, windows: Windows, wanted: Broadcast, id_col: str = "doc_id", payload: str = "hashes",
    only: Broadcast | None = None, texts: Broadcast | None = None,
) -> DataFrame:
    """(fp, id, t, start, n, places, seg, payload): the segments whose anchor passes the filter wanted.
    t is the text's hash, which tells rows of one id apart; start is the first item in the document, n the
    number of windows, seg a 64-bit hash of the content, payload the windows' 64-bit hashes, for
    payload='bytes' the segment's bytes, and for payload='none' empty. Where only or texts is given,
    segments whose seg, or texts whose t, doesn't pass it are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = wanted.value
        content = tb.Ranges(14)
        for batch in batches:
            if texts is not None:
                batch = batch.filter(pa.array(texts.value.mask(batch.column(1).to_numpy().view(np.uint64))))
            ids, t = batch.column(0), batch.column(1)
            for a, _, item_offs, hashes, anchor, row, start, data, (first, length, places) in windows.scan(batch.column(2)):
                keep = keys.mask(anchor[first])
                first, length, places = first[keep], length[keep], places[keep]
                if not len(first):
                    continue
                wide = hashes()[start]
                seg = content.ranges(wide, first, first + length)
                if only is not None:
                    keep = only.value.mask(seg)
                    first, length, places, seg = first[keep], length[keep], places[keep], seg[keep]
                if payload == "bytes":
                    raw, at = data, np.stack([start[first], start[first] + length + windows.window - 1])
                elif payload == "none":
                    raw, at = data, np.zeros((2, len(first)), dtype=np.int64)
                else:
                    raw, at = wide.view(np.uint8), np.stack([first * 8, (first + length) * 8])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[first].view(np.int64)),
                        ids.take(pa.array(a + row[first])),
                        t.take(pa.array(a + row[first])),
                        pa.array((start[first] - item_offs[row[first]]).astype(np.int64)),
                        pa.array(length.astype(np.int32)),
                        pa.array(places.astype(np.int32)),
                        pa.array(seg.view(np.int64)),
                        _binaries(raw, at),
                    ],
                    ["fp", "id", "t", "start", "n", "places", "seg", "payload"],
                )

    return docs.select(id_col, F.xxhash64("text").alias("t"), "text").mapInArrow(
        worker.batches("anchors", run), "fp long, id long, t long, start long, n int, places int, seg long, payload binary"
    )


def _binaries(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """Slices of raw, from at[0] to at[1], as a binary array."""
    size = at[1] - at[0]
    offs = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=offs[1:])
    pick = np.arange(offs[-1], dtype=np.int64) + np.repeat(at[0] - offs[:-1], size)
    return pa.Array.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(raw[pick]))]
    ).cast(pa.binary())


def apply_ranges(docs: DataFrame, ranges: DataFrame, rows: Callable, schema: str) -> DataFrame:
    """rows(batch, starts, lengths) of all documents (doc_id, text), given ranges (id, t, start, n). Only
    texts that may have a range are shuffled; the others are worked on where they are read."""
    spark = docs.sparkSession
    with Stage(spark) as stage:
        ranges = stage.cut(ranges, keep=True)
        hit = spark.sparkContext.broadcast(KeyFilter.build(stage.cut(ranges.select("t").distinct()), "t"))

    def touched(batch: pa.RecordBatch) -> np.ndarray:
        return hit.value.mask(batch.column("t").to_numpy().view(np.uint64))

    def untouched_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~touched(batch)))
            yield rows(part, [None] * len(part), [None] * len(part))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(touched(batch)))

    def with_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch, batch.column("starts").to_pylist(), batch.column("lengths").to_pylist())

    three = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))
    by_doc = ranges.groupBy("id", "t").agg(F.collect_list(F.struct("start", "n")).alias("r"))
    by_doc = by_doc.select("id", F.col("t").alias("rt"), F.col("r.start").alias("starts"), F.col("r.n").alias("lengths"))
    part = three.mapInArrow(worker.batches("anchors", maybe), "doc_id long, text string, t long").withColumn("id", id_key())
    part = part.join(by_doc, (part.id == by_doc.id) & (part.t == by_doc.rt), "left")
    part = part.select("doc_id", "text", "starts", "lengths")
    return three.mapInArrow(worker.batches("anchors", untouched_rows), schema).unionByName(part.mapInArrow(worker.batches("anchors", with_ranges), schema))


def id_key():
    """doc_id, or the least long for a null one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def gone(starts, lengths, window: int, items: int) -> np.ndarray:
    """Which of the items the windows given cover."""
    diff = np.zeros(items + 1, dtype=np.int64)
    at, n = np.asarray(starts, dtype=np.int64), np.asarray(lengths, dtype=np.int64)
    np.add.at(diff, at, 1)
    np.add.at(diff, at + n + window - 1, -1)
    return np.cumsum(diff[:-1]) > 0
