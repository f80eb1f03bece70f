"""Secret scans: exact rules, and a conditional random field that adds spans (crf.py).

Base spans, leftmost and non-overlapping within a kind: assign (a keyword, : or =, and a value of 8 or
more characters), access (AKIA and capitals or digits, 16 or more characters), hex (32 or more
characters). The field's spans have the kind crf and may overlap base ones, which stay as they are; only
those that base spans cover in full are left out, as they add nothing. Spans are in code points, ends exclusive.

Rows: null counts as empty and has no spans. Whole texts are scanned. Repeated rows get equal spans.
Other columns are ignored by op4, and kept by redact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import textbytes as tb
from gavelflow.llm import worker
from gavelflow.llm.crf import Crf, Lines, trained

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
#: Texts that can have a base span; the rules then decide.
MAYBE = r"""(?i:(password|passwd|secret|token|api_?key)["']? *[:=])|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
MARK = "[SECRET]"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """By start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _crf_spans(model: Crf, texts: pa.Array) -> dict[int, list[tuple[int, int]]]:
    """The field's spans in code points, by row."""
    out: dict[int, list[tuple[int, int]]] = {}
    for a, _, data, offs in tb.text_slices(texts):
        lines = Lines(data, offs)
        if not lines.n:
            continue
        tags = model.decode(lines.features, lines.words.offs)
        at = np.flatnonzero(tags)
        if not len(at):
            continue
        row = np.searchsorted(lines.words.offs, at, side="right") - 1
        joined = np.zeros(len(at), dtype=bool)
        joined[1:] = (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]) & (tags[at[1:]] == 2)
        first = np.flatnonzero(~joined)
        end = np.append(first[1:], len(at)) - 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # words begin and end between code points
        before = points[offs[row[first]]]
        start, stop = points[lines.core_start[at[first]]] - before, points[lines.core_end[at[end]]] - before
        for i, s, e in zip(row[first].tolist(), start.tolist(), stop.tolist(), strict=True):
            out.setdefault(a + i, []).append((s, e))
    return out


def _covered(start: int, end: int, spans: list[Span]) -> bool:
    """Whether spans, which are sorted by start, cover all from start to end."""
    for _, s, e in spans:
        if s <= start < e:
            start = e
    return start >= end


def scan(texts: pa.Array, model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False).to_numpy(zero_copy_only=False)
    tagged = _crf_spans(model, texts)
    out = []
    for i in range(len(texts)):
        if not maybe[i] and i not in tagged:
            out.append(([], []))
            continue
        text = texts[i].as_py()
        base = base_spans(text) if maybe[i] else []
        more = []
        for s, e in tagged.get(i, ()):
            if not _covered(s, e, base):
                more.append(("crf", s, e))
        order = (*KINDS, "crf")
        out.append((base, sorted(base + more, key=lambda s: (s[1], order.index(s[0])))))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row, and n_crf."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan(batch.column(1), shared.value)
            count = lambda kind: pa.array([sum(s[0] == kind for s in x) for _, x in found], pa.int64())
            digest = [hashlib.sha256(_joined(x).encode()).hexdigest() for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(count(k) for k in KINDS), pa.array(digest, pa.string()), pa.array([_joined(x) for _, x in found], pa.string()), count("crf")],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(worker.batches("secrets", run), schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every stretch that spans cover replaced by MARK."""
    out, done, end = [], 0, -1
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if s >= end:
            out += [text[done:s], MARK]
        done = end = max(end, e)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced, and n_chars, where there is one, counted again. Its other
    columns and all rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            found = scan(texts, shared.value)
            new = texts.to_pylist()
            for i, (_, spans) in enumerate(found):
                if spans:
                    new[i] = redacted(new[i], spans)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(worker.batches("secrets", run), schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.length("text").cast(kind)
        out = out.withColumn("n_chars", F.when(F.col("text").contains(MARK), changed).otherwise(F.col("n_chars")))
    return out


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
