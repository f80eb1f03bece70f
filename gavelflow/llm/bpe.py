"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

Each leaf holds the rank of the pair that starts at a byte position and the position itself; inner
nodes hold minima, so the root is the leftmost pair of least rank. A merge updates three leaves (the
merged pair, the one that vanished and the live neighbour before) and their paths, in logarithmic
time. Pieces of about one length go through their trees together, as numpy rows; very long pieces go
through one tree each.

Texts are cut at single spaces between visible characters, where the pre-tokenizer always cuts, and
what was encoded before is kept in a cache of bounded size; the result doesn't depend on it.

Rows: null counts as the empty text, which has no tokens. Whole texts are encoded, whatever their
length. Special tokens' strings are ordinary text. Other columns are ignored; rows may repeat.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import worker

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Pieces over so many bytes get a tree of their own.
LONG = 512
#: Units and pieces kept in each of the two generations of the caches.
CACHE = 200_000
NONE = np.int64(1) << 60


def rank_path(name: str = RANK_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Ranks (bytes of a token to its id) and a pattern, ready to encode and decode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: b for b, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.units: list[dict] = [{}, {}]
        self.pieces: list[dict] = [{}, {}]

    # -- merges -------------------------------------------------------------------------------

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        ids = np.zeros((n, width), dtype=np.int64)
        inside = np.arange(width) < size[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        after[np.arange(n), size - 1] = width
        alive = inside.copy()
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        paired = np.arange(width - 1) < (size - 1)[:, None]
        rank = self._lookup(ids[:, :-1][paired], ids[:, 1:][paired])
        place = np.broadcast_to(np.arange(width - 1), paired.shape)[paired]
        tree[:, width : 2 * width - 1][paired] = np.where(rank == NONE, NONE, rank * width + place)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        def put(row: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
            node = pos + width
            tree[row, node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        def pair(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            rank = self._lookup(ids[row, i], ids[row, j])
            return np.where(rank == NONE, NONE, rank * width + i)

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            least = tree[row, 1]
            i = least % width
            j = after[row, i]
            k = after[row, j]
            ids[row, i] = least // width
            after[row, i] = k
            alive[row, j] = False
            put(row, j, np.full(len(row), NONE))
            live = k < width
            before[row[live], k[live]] = i[live]
            value = np.full(len(row), NONE)
            value[live] = pair(row[live], i[live], k[live])
            put(row, i, value)
            p = before[row, i]
            live = p >= 0
            if live.any():
                put(row[live], p[live], pair(row[live], p[live], i[live]))
            row = row[tree[row, 1] < NONE]
        flat = ids[alive].astype("<u4")
        cuts = np.cumsum(alive.sum(axis=1))
        raw = flat.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def _merge_long(self, piece: bytes) -> bytes:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = int(NONE)
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)]
        rank = self._lookup(ids[:-1], ids[1:])
        tree = np.full(2 * width, NONE, dtype=np.int64)
        tree[width : width + n - 1] = np.where(rank == NONE, NONE, rank * width + np.arange(n - 1))
        half = width
        while half > 1:
            tree[half // 2 : half] = np.minimum(tree[half : 2 * half : 2], tree[half + 1 : 2 * half : 2])
            half //= 2
        tree, ids = tree.tolist(), ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(pos: int, value: int) -> None:
            node = pos + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a <= b else b

        get = self.pairs.get
        while tree[1] < none:
            new, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            ids[i], after[i] = new, k
            ids[j] = -1
            put(j, none)
            found = None
            if k < n:
                before[k] = i
                found = get((new << 32) | ids[k])
            put(i, none if found is None else found * width + i)
            if (p := before[i]) >= 0:
                found = get((ids[p] << 32) | new)
                put(p, none if found is None else found * width + p)
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as little-endian 32-bit integers, of pieces that are encoded separately."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = self._merge_long(p)
            elif p:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
            else:
                out[i] = b""
        for width, at in by_width.items():
            step = max(1, (1 << 19) // width)
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                for i, ids in zip(part, self._merge_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    # -- texts --------------------------------------------------------------------------------

    @staticmethod
    def _store(cache: list[dict], key: str, value: bytes) -> None:
        if len(cache[0]) >= CACHE:
            cache[1], cache[0] = cache[0], {}
        cache[0][key] = value

    def _encode_units(self, units: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(u) for u in units]
        new, old = self.pieces
        known: dict[str, bytes] = {}
        names = []
        for p in {p for pieces in cut for p in pieces}:
            ids = new.get(p)
            if ids is None and (ids := old.get(p)) is None:
                names.append(p)
            else:
                known[p] = ids
        for p, ids in zip(names, self.encode_pieces([p.encode() for p in names]), strict=True):
            known[p] = ids
            if len(p) < 64:
                self._store(self.pieces, p, ids)
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        plans: list[list] = []
        missing: dict[str, str | None] = {}  # unit to the key to cache it by

        def add(plan: list, unit: str, key: str | None) -> None:
            missing[unit] = key
            plan.append(unit)

        for text in texts:
            plan: list = []
            plans.append(plan)
            if not text:
                continue
            new, old = self.units
            head, *parts = text.split(" ")
            got = list(map(new.get, parts))
            ends = bool(head) and not head[-1].isspace()
            if ends:
                # the usual case: what the cache lacks are words with no space at either end
                gaps = [i for i, ids in enumerate(got) if ids is None]
                for i in gaps:
                    p = parts[i]
                    if (ids := old.get(p)) is not None:
                        self._store(self.units, p, ids)
                    elif not p or p[0].isspace() or p[-1].isspace():
                        break
                    else:
                        ids = " " + p
                        missing[ids] = p
                    got[i] = ids
                else:
                    add(plan, head, None)
                    plan += got
                    continue
                got = [None if type(ids) is str else ids for ids in got]
            unit, value, key = head, None, None
            for p, ids in zip(parts, got, strict=True):
                if ids is None and (ids := old.get(p)) is not None:
                    self._store(self.units, p, ids)
                if ends and p and (ids is not None or not p[0].isspace()):
                    if value is None:
                        add(plan, unit, key)
                    else:
                        plan.append(value)
                    unit, value, key = " " + p, ids, p
                else:
                    unit, value, key = f"{unit} {p}", None, None
                ends = ids is not None or bool(p) and not p[-1].isspace()
                if not ends:
                    key = None
            if value is None:
                add(plan, unit, key)
            else:
                plan.append(value)
        units = list(missing)
        done = dict(zip(units, self._encode_units(units), strict=True))
        for unit, key in missing.items():
            if key is not None and len(key) < 64:
                self._store(self.units, key, done[unit])
        return [b"".join([x if type(x) is bytes else done[x] for x in plan]) for plan in plans]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def worker_encoder(key: str, shared, name: str | None = None) -> Encoder:
    """One encoder for each Python worker and key, while tasks of BPE run there; shared broadcasts (ranks,
    pattern), or such by name."""
    return worker.held("bpe", key, lambda: Encoder(*(shared.value if name is None else shared.value[name])))


def _batches(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about so many bytes together."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    lo = total = 0
    for i, x in enumerate(lengths):
        total += x
        if total >= size:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(lengths):
        yield lo, len(lengths)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (binary: little-endian 32-bit integers) of each row."""
    return _run(docs, path, pattern, "ids binary", lambda enc, texts, ids: [pa.array(ids, pa.binary())])


def _run(docs: DataFrame, path: str | None, pattern: str | None, last: str, columns) -> DataFrame:
    import public_tokenizers

    path = path or rank_path()
    ranks = read_ranks(path)
    if len(ranks) > 1 << 20:
        raise ValueError("a vocabulary of over 2**20 tokens is not broadcast")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern or public_tokenizers.PATTERN))
    key = f"{path}\0{pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(key, shared)
        for batch in batches:
            for lo, hi in _batches(batch, "text"):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text").to_pylist()
                made = columns(enc, texts, enc.encode_texts(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", *[x.split()[0] for x in last.split(", ")]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(worker.batches("bpe", run), f"doc_id long, {last}")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""
    path = path or rank_path()
    shared = encoded.sparkSession.sparkContext.broadcast((read_ranks(path), r"(?s:.)+"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(f"{path}\0decode", shared)
        for batch in batches:
            text = [enc.decode(x or b"").decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(worker.batches("bpe", run), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""

    def columns(enc: Encoder, texts: list, ids: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids]),
        ]

    return _run(docs, path, None, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of all documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
