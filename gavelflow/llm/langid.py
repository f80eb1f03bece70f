"""Language identification by rank-order profiles.

A text's profile is the list of its TOP most frequent n-grams of 1 to 3 letters, words marked off by
a boundary, in the order of frequency. A language's is that of its training texts. The out-of-place
distance of the two sums, over the text's n-grams, how far each is from its place in the language's
list, TOP where it isn't there; the least distance wins, ties by the language's name. N-grams are kept
as 32-bit hashes of all their letters. All languages are learned; the model has TOP n-grams for each.

Training takes at most SAMPLE documents of a language (of all documents with a language whose
crc32(doc_id) mod 4 is not 2, those with the least hashes of doc_id), whole texts; that bounds the
model, and prediction sees nothing but text. Prediction covers all documents.

Rows: 'und' with score 0 for a null text, a text without a letter, and when there is nothing to learn
from. score is the margin 1 - best / second distance (0 to 1). A null doc_id is neither held out nor
learned from. Repeated rows get equal values. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelflow.llm import worker

TOP = 300
SAMPLE = 2000
#: Up to so many languages their counts are broadcast (a few MB); more are joined by shuffling.
BROADCAST_LANGS = 50_000
HELD_OUT = 2
#: Rows that are made into strings and handed on at once.
PART = 500
UND = "und"

def _letters() -> np.ndarray:
    return worker.held("langid", "letters", lambda: np.array([chr(i).isalpha() for i in range(0x110000)]))


def grams(text: str) -> np.ndarray:
    """The 32-bit hashes of all n-grams of a text; none if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, dtype=np.uint32)
    c = np.where(letter, c + np.uint32(1), np.uint32(0))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one boundary after each word
    c = np.concatenate([np.zeros(1, np.uint32), c[keep], np.zeros(1, np.uint32)])
    one = c * np.uint32(0x9E3779B1)
    one ^= one >> np.uint32(15)
    two = (one[:-1] * np.uint32(0x85EBCA77)) ^ one[1:]
    three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ one[2:]
    x = np.concatenate([one[c > 0], two, three]) * np.uint32(0x27D4EB2F)
    return x ^ (x >> np.uint32(15))


def profile(text: str, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by hash."""
    g = np.sort(grams(text))
    if not len(g):
        return g
    first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(g[1:] != g[:-1]) + 1, np.array([len(g)])])
    count, first = np.diff(first), first[:-1]
    # a text has under 2**31 n-grams
    key = (-count.astype(np.int64) << 32) | g[first]
    if len(key) > top:
        key = np.partition(key, top)[:top]
    return (np.sort(key) & 0xFFFFFFFF).astype(np.uint32)


class Model:
    """The n-grams of all profiles, sorted, with the language and the place of each."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        rows = [np.asarray(profiles[lang][:top], dtype=np.uint32) for lang in self.langs]
        gram = np.concatenate([*rows, np.empty(0, dtype=np.uint32)])
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.lang = np.repeat(np.arange(len(rows)), [len(p) for p in rows])[order].astype(np.int32)
        self.place = np.concatenate([*(np.arange(len(p)) for p in rows), np.empty(0, dtype=np.int64)])[order].astype(np.int32)

    def distances(self, text: str) -> np.ndarray | None:
        """By language, from 0 to 1; None for a text without letters."""
        p = profile(text, self.top)
        if not len(p):
            return None
        lo, hi = np.searchsorted(self.gram, p), np.searchsorted(self.gram, p, side="right")
        size = hi - lo
        mine = np.repeat(np.arange(len(p)), size)
        at = np.arange(len(mine)) + np.repeat(lo - (np.cumsum(size) - size), size)
        near = self.top - np.abs(self.place[at] - mine)  # by how much less than top
        return 1 - np.bincount(self.lang[at], weights=near, minlength=len(self.langs)) / (len(p) * self.top)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and distance."""
        if not text or not self.langs or (d := self.distances(text)) is None:
            return UND, 0.0, 1.0
        best = int(d.argmin())
        second = float(np.delete(d, best).min()) if len(d) > 1 else 1.0
        score = 1 - float(d[best]) / second if second > 0 else 0.0
        return self.langs[best], min(1.0, max(0.0, score)), float(d[best])


def is_held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, top: int = TOP) -> Model:
    """The model of a documents table. Only top n-grams a language come to the driver; the model grows with
    the number of languages and with nothing else."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    usable = usable.select("lang", "text", F.xxhash64("doc_id").alias("h"))
    langs = usable.groupBy("lang").agg(F.count("*").alias("of"))
    n_langs = langs.count()
    if not n_langs:
        return Model({}, top)
    # rows with a hash under sample / n of the range, about sample of them, without sorting
    if n_langs <= BROADCAST_LANGS:
        chosen = usable.join(F.broadcast(langs), "lang")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt")
        chosen = usable.withColumn("salt", F.pmod(F.col("h"), F.lit(64)).cast("int")).join(langs.select("*", salt), ["lang", "salt"])
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / (1 << 30)
    chosen = chosen.where(place <= F.lit(sample) / F.col("of")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(np.stack(np.unique(grams(text), return_counts=True)))  # counts of whole texts
            for lang, parts in by.items():
                g, n = np.concatenate(parts, axis=1)
                key, at = np.unique(g, return_inverse=True)
                total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(total)], ["lang", "gram", "n"])

    rows = chosen.mapInArrow(worker.batches("langid", count), "lang string, gram long, n long")
    counts = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    profiles: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "r").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return Model(profiles, top)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of all columns of docs, so that no name can clash), lang_pred, lang_score and
    lang_distance of each row."""
    at = [c.lower() for c in docs.columns].index("text")
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in (b.slice(i, PART) for b in batches for i in range(0, b.num_rows, PART)):
            found = [held.predict(t) for t in batch.column(0).flatten()[at].to_pylist()]
            cols = list(zip(*found, strict=True)) or [[], [], []]
            made = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["row", "lang_pred", "lang_score", "lang_distance"])

    schema = T.StructType([docs.schema["row"], *T.StructType.fromDDL("lang_pred string, lang_score double, lang_distance double")])
    return docs.mapInArrow(worker.batches("langid", run), schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs)).select("row.doc_id", "lang_pred", "lang_score")
    return found.select(F.col("doc_id").cast("long"), is_held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
