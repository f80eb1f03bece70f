"""Token counts as rollups that are maintained by deltas.

A change is a signed row: sign 1 adds a document's tokens to the totals of its source, language and
tokenizer version, -1 takes them out again; a revision is one of each. A batch's changes are summed by
group before they are stored, and the totals are the sums of all committed batches, so the work of a
batch follows the batch, not the corpus. Each attempt at a batch writes to a folder of its own; the batch
commits when its marker, written elsewhere first, is renamed to the batch's name, which fails if it is
there. So markers are whole, of several writers of a batch one counts, an attempt that didn't get so far
counts for nothing, and a batch that is committed is not applied again. compact() sums committed batches
into a base and leaves the totals as they are; vacuum() deletes what no marker needs any more.

Rows: a null text has 0 tokens and still counts as a document. Null sources and languages are groups
of their own. Repeated rows count as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelflow.llm import bpe, worker
from gavelflow.llm.common import WORD, Stage, exists, hadoop_path, remove, scratch

GROUP = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def signed(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed rows that turn the counts before (GROUP and n_tokens, a row a document) into those after."""
    parts = [
        df.select(*GROUP, "n_tokens", F.lit(sign).alias("sign")) for df, sign in ((before, -1), (after, 1)) if df is not None
    ]
    return reduce(DataFrame.unionByName, parts)


class Rollup:
    """Totals under a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _mark(self, name: str) -> str:
        return f"{self.path}/commits/{name}"

    def committed(self) -> list[str]:
        """Names of the batches that count, in the order of names."""
        return sorted(json.loads(x)["batch"] for x in self._marks().values())

    def _marks(self) -> dict[str, str]:
        fs, folder = hadoop_path(self.spark, f"{self.path}/commits")
        if not fs.exists(folder):
            return {}
        out = {}
        for status in fs.listStatus(folder):
            stream = fs.open(status.getPath())
            try:
                out[status.getPath().getName()] = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        return out

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of signed rows (GROUP, n_tokens, sign); False if it was committed before."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch needs a plain name: {batch!r}")
        if exists(self.spark, self._mark(batch)):
            return False
        delta = changes.groupBy(*GROUP).agg(
            F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("sign")).cast("long").alias("n_tokens")
        )
        return self._store(batch, delta, [])

    def _store(self, batch: str, delta: DataFrame, replaces: list[str]) -> bool:
        data = f"{self.path}/deltas/{batch}-{uuid.uuid4().hex}"
        delta.write.parquet(data)
        done = self._commit(batch, {"batch": batch, "data": data, "replaces": replaces})
        if not done:
            remove(self.spark, data)
        return done

    def _commit(self, name: str, what: dict) -> bool:
        fs, path = hadoop_path(self.spark, self._mark(name))
        _, draft = hadoop_path(self.spark, f"{self.path}/drafts/{name}-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(what).encode()))
        stream.close()
        fs.mkdirs(path.getParent())
        gateway = self.spark.sparkContext._gateway
        fc = gateway.jvm.org.apache.hadoop.fs
        none = gateway.new_array(getattr(fc, "Options$Rename"), 0)  # not over a file that is there
        try:
            fc.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, path, none)
        except Exception:
            if not fs.exists(path):
                raise
            fs.delete(draft, False)
            return False
        return True

    def _live(self) -> list[dict]:
        marks = [json.loads(x) for x in self._marks().values()]
        replaced = {b for m in marks for b in m["replaces"]}
        return [m for m in marks if m["batch"] not in replaced]

    def totals(self) -> DataFrame:
        """GROUP, n_docs and n_tokens; groups that came to nothing are left out."""
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], DELTA)
        return self._sums(live)

    def _sums(self, live: list[dict]) -> DataFrame:
        rows = self.spark.read.schema(DELTA).parquet(*[m["data"] for m in live])
        out = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, name: str) -> None:
        """Make one base of all batches that count now. They stay committed."""
        live = self._live()
        if live and name not in self.committed():
            self._store(name, self._sums(live), [m["batch"] for m in live])

    def vacuum(self) -> None:
        """Delete the data of batches that a base replaces, and of attempts that never committed. Not for
        times at which a batch is being applied or totals are being read."""
        needed = {m["data"].rsplit("/", 1)[1] for m in self._live()}
        fs, folder = hadoop_path(self.spark, f"{self.path}/deltas")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName() not in needed:
                fs.delete(status.getPath(), True)
        remove(self.spark, f"{self.path}/drafts")


def counted(docs: DataFrame, versions: list[str], keep: list[str] | None = None) -> DataFrame:
    """A row for each document and tokenizer version: doc_id, GROUP, n_tokens, t (the text's hash) and about (a
    provisional count, a fourth of the bytes).
    Versions: words_v1 (runs of other than white space), bytes_v1 (UTF-8 bytes), or a rank file's name,
    for byte-level BPE."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.md5(text).alias("t"), "text")
    own = {"words_v1": F.regexp_count(text, F.lit(WORD)).cast("long"), "bytes_v1": F.octet_length(text).cast("long")}
    ranked = [v for v in versions if v not in own]
    if ranked:
        ranks = {v: bpe.read_ranks(bpe.rank_path(f"{v}.tiktoken")) for v in ranked}
        import public_tokenizers

        shared = docs.sparkSession.sparkContext.broadcast({v: (r, public_tokenizers.PATTERN) for v, r in ranks.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in bpe._batches(batch, "text"):
                    part = batch.slice(lo, hi - lo)
                    texts = part.column("text").to_pylist()
                    found = [pa.array([len(x) // 4 for x in bpe.worker_encoder(f"count {v}", shared, v).encode_texts(texts)], pa.int64()) for v in ranked]
                    yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, *(f"c{i}" for i in range(len(ranked)))])

        base = base.mapInArrow(worker.batches("bpe", run), "doc_id long, source string, lang string, t string, text string, " + ", ".join(f"c{i} long" for i in range(len(ranked))))
    each = [F.struct(F.lit(v).alias("v"), (own[v] if v in own else F.col(f"c{ranked.index(v)}")).alias("n")) for v in versions]
    out = base.select("doc_id", "source", "lang", "t", (F.octet_length("text") / 4).cast("long").alias("about"), F.explode(F.array(*each)).alias("c"))
    return out.select("doc_id", "source", "lang", F.col("c.v").alias("tokenizer_version"), F.col("c.n").alias("n_tokens"), "t", "about")


def repeats(rows: DataFrame) -> DataFrame:
    """Of counted rows, those whose text a smaller doc_id has too, summed up by group and text: GROUP, n_tokens
    (of one) and n. Rows are summed before they meet by text, so a text that a third of all rows have is no
    hot key; null doc_ids are no copies."""
    have = rows.where("doc_id is not null").groupBy("t", *GROUP, "doc_id").agg(F.count("*").alias("c"), F.first("n_tokens").alias("n_tokens"))
    by_group = have.groupBy("t", *GROUP).agg(F.sum("c").alias("all"), F.min(F.struct("doc_id", "c")).alias("least"), F.first("n_tokens").alias("n_tokens"))
    first = F.min("least.doc_id").over(Window.partitionBy("t"))  # a row for each source, language and version
    own = F.when(F.col("least.doc_id") == first, F.col("least.c")).otherwise(0)
    return by_group.select(*GROUP, "n_tokens", (F.col("all") - own).alias("n")).where("n > 0")


def maintained(docs: DataFrame, versions: list[str]) -> DataFrame:
    """The totals of all documents after six commits: all are loaded with provisional counts, which the next
    batch revises; rows that repeat the text of a smaller doc_id are deleted; the batches so far become one
    base; the revision is delivered again, which changes nothing; and the repeats are inserted again."""
    spark = docs.sparkSession
    path = scratch(spark, "token-counts")
    rollup = Rollup(spark, path)
    try:
        with Stage(spark) as stage:
            rows = stage.cut(counted(docs, versions))
            provisional = rows.withColumn("n_tokens", F.col("about"))
            copies = stage.cut(repeats(rows))
            rollup.apply("load", signed(None, provisional))
            rollup.apply("counts", signed(provisional, rows))
            rollup.apply("repeats", copies.select(*GROUP, "n_tokens", (-F.col("n")).alias("sign")))
            rollup.compact("base")
            rollup.vacuum()
            rollup.apply("counts", signed(provisional, rows))
            rollup.apply("restored", copies.select(*GROUP, "n_tokens", F.col("n").alias("sign")))
            return stage.cut(rollup.totals(), keep=True)
    finally:
        remove(spark, path)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version, of all documents."""
    return maintained(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["words_v1", "byte_bpe_50k"])


def token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by tokenizers that SQL can express."""
    return maintained(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["words_v1", "bytes_v1"])


ORACLE_SQL = r"""
with d as (select source, lang, coalesce(text, '') as text from documents),
v as (
  select source, lang, 'words_v1' as tokenizer_version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as n from d
  union all
  select source, lang, 'bytes_v1', strlen(text)::bigint from d)
select source, lang, tokenizer_version, count(*)::bigint as n_docs, sum(n)::bigint as n_tokens from v group by all
"""
