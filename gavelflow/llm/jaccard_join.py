"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection of sorted arrays.

A document's set holds the hashes of its distinct word shingles, sorted; equal sets are one class,
and from then on a class counts once, however many copies it has. Two sets that link share a key
among the first |A| - ceil(t|A|) + 1 keys of both in any fixed order of keys, so classes meet in
tiles of a key. The order puts keys of many documents last (a bitmap of bounded size says which;
it only moves work, never results), so passages that many documents share open no tiles for
documents that have rarer keys. Frequent ones among each set's first keys are counted, then all keys that
stand near these in the texts: a passage has its other keys there, which would open tiles as soon as the first
ones are last in the order.

* A light tile (up to LIGHT classes) yields its pairs within the size bound.
* Heavy tiles that share classes are one group, which is cut into size-banded blocks; blocks compare all
  their pairs within the size bound. A pair of one group is left to the group alone, so each link is
  counted once. A group's links may be quadratic in number: they are added up for each class where they
  are found, and only as many are handed on as connect what they connect.
* Pairs pass the bitmap bound (the bit count of the difference bounds the overlap from above), then the
  exact intersection. No pair that may link is left out.

Rows: null and empty texts have no shingles and link with nothing. Fewer words than the shingle
length are one shingle. Rows with equal text link whatever their ids; a null doc_id counts last for
component_id, which is null only if all reachable ids are. Repeated doc_ids are separate rows.
Other columns are ignored. Hashes have 64 bits: sets are told apart by their shingles' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import textbytes as tb
from gavelflow.llm import worker
from gavelflow.llm.common import KeyFilter, Stage, components, hot_join

SHINGLE = 5
NUM, DEN = 80, 100  # link when DEN * intersection >= NUM * union
LIGHT = 32
BLOCK = 512
BLOCK_KEYS = 1 << 20
#: Shingles so far from a frequent one in a text may be of the same passage. A fifth of a passage's keys are
#: found first, so that one in a hundred gaps between them is longer than twice this.
REACH = 10


def _shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each text in their order."""
    short = tb.Ranges(42)
    for a, b, data, offs in tb.text_slices(texts):
        words = tb.Words(data, offs)
        values = words.hashes(41, lower=True)
        grams = tb.windows(values, k, 43)
        for lo, hi in zip(words.offs[:-1].tolist(), words.offs[1:].tolist(), strict=True):
            if hi - lo >= k:
                yield grams[lo : hi - k + 1]
            elif hi > lo:
                yield short.ranges(values, np.array([lo]), np.array([hi]))
            else:
                yield grams[:0]


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return map(np.unique, _shingles(texts, k))


def _near(grams: np.ndarray, common: KeyFilter) -> np.ndarray:
    """The distinct shingles that stand near common ones and aren't common themselves."""
    found = common.mask(grams)
    if not found.any():
        return grams[:0]
    edge = np.zeros(len(grams) + 1, dtype=np.int64)
    at = np.flatnonzero(found)
    np.add.at(edge, np.maximum(at - REACH, 0), 1)
    np.add.at(edge, np.minimum(at + REACH + 1, len(grams)), -1)
    return np.unique(grams[(np.cumsum(edge[:-1]) > 0) & ~found])


def _signature(s: np.ndarray) -> int:
    total = int(np.add.reduce(tb.mix(s), dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return int(np.int64(np.uint64(total)))


def _least_overlap(n: int) -> int:
    return -(-NUM * n // DEN)


def _bitmap(s: np.ndarray, spread: int = 2) -> bytes:
    """A bit for each key, in spread to 2 * spread bits a key; narrower bitmaps are wider ones folded."""
    width = max(64, 1 << (spread * len(s) - 1).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class _Classes:
    """One text for each set. Texts whose hash isn't in the filter copied are alone with their set and are
    read where they are; a text for each of the other sets is in a table, with its hash null."""

    def __init__(self, docs: DataFrame, copied: Broadcast, table: DataFrame, k: int):
        self.texts = docs.select(F.xxhash64("text").alias("t"), "text")
        self.copied, self.table, self.k = copied, table.select(F.lit(None).cast("long").alias("t"), "text"), k

    def scan(self, emit, schema: str, only: Broadcast | None = None, sets=_sets) -> DataFrame:
        """emit(list of sets) -> RecordBatch, over all classes; of the single ones only those whose text's
        hash passes the filter only, where it is given. sets: what makes them of texts."""
        k, copied = self.k, self.copied

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = batch.column(0)
                if not t.null_count:
                    t = t.to_numpy().view(np.uint64)
                    keep = ~copied.value.mask(t)
                    if only is not None:
                        keep &= only.value.mask(t)
                    batch = batch.filter(pa.array(keep))
                part = []
                for s in sets(batch.column(1), k):
                    if len(s):
                        part.append(s)
                        if len(part) == 2000:
                            yield emit(part)
                            part = []
                if part:
                    yield emit(part)

        return self.texts.mapInArrow(worker.batches("jaccard", run), schema).unionByName(self.table.mapInArrow(worker.batches("jaccard", run), schema))


def _ordered_prefix(s: np.ndarray, common: KeyFilter) -> np.ndarray:
    p = len(s) - _least_overlap(len(s)) + 1
    late = common.mask(s)
    head = s[~late][:p]
    return head if len(head) == p else np.concatenate([head, s[late][: p - len(head)]])


def _flat(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64))


def classes_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, t, sig, n): each row's set, by its signature and size; sig is null for an empty set, t is
    the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_signature(s) if len(s) else None, len(s)) for s in _sets(batch.column(2), k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                ["doc_id", "t", "sig", "n"],
            )

    three = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")
    return three.mapInArrow(worker.batches("jaccard", run), "doc_id long, t long, sig long, n long")


def links(docs: DataFrame, rows: DataFrame, copies_of: DataFrame, stage: Stage, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(a, b): links between classes, enough of them to connect all that is connected; and (sig, w): in how
    many rows of other classes, by the copies of copies_of, each class has links, of all of them."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    again = rows.where("sig is not null").groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
    copied_texts = stage.cut(rows.join(again, "sig", "left_semi").select("t").distinct())
    copied = send(KeyFilter.build(copied_texts, "t"))

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(copied.value.mask(batch.column(0).to_numpy().view(np.uint64))))
            sets = list(_sets(batch.column(1), k))
            pick = pa.array(np.flatnonzero([len(s) > 0 for s in sets]))
            sig = pa.array([_signature(s) for s in sets if len(s)], pa.int64())
            yield pa.RecordBatch.from_arrays([sig, batch.column(1).take(pick)], ["sig", "text"])

    texts = docs.select(F.xxhash64("text").alias("t"), "text")
    table = texts.mapInArrow(worker.batches("jaccard", copies), "sig long, text string").groupBy("sig").agg(F.first("text").alias("text"))
    classes = _Classes(docs, copied, stage.cut(table), k)

    # keys that many classes have among their first ones, or near those in their texts, go last in the order; a
    # key that passes the filter by chance would be taken for one, so there are more bits
    def frequent(keys: DataFrame) -> DataFrame:
        return stage.cut(keys.groupBy("key").count().where(F.col("count") > LIGHT).select("key"))

    everywhere = KeyFilter(np.zeros(1 << 10, dtype=np.uint64))
    leading = frequent(classes.scan(_keys(send(everywhere)), "key long"))
    seen = send(KeyFilter.build(leading, "key", spread=256))

    def beside(part: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_flat([_near(s, seen.value) for s in part])], ["key"])

    others = frequent(classes.scan(beside, "key long", sets=_shingles))
    common = send(KeyFilter.build(leading.union(others), "key", spread=256))
    multi = classes.scan(_keys(common), "key long").groupBy("key").count().where("count > 1")
    multi = stage.cut(multi)
    shared = send(KeyFilter.build(multi.select("key"), "key"))

    def postings(part: list) -> pa.RecordBatch:
        heads = [_ordered_prefix(s, common.value) for s in part]
        heads = [h[shared.value.mask(h)] for h in heads]
        size = [len(h) for h in heads]
        sig = np.repeat(np.array([_signature(s) for s in part], dtype=np.int64), size)
        n = np.repeat(np.array([len(s) for s in part], dtype=np.int32), size)
        return pa.RecordBatch.from_arrays([_flat(heads), pa.array(sig), pa.array(n)], ["key", "sig", "n"])

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int")
    posts = stage.cut(classes.scan(postings, "key long, sig long, n int"))
    posts = stage.cut(hot_join(posts, multi.withColumnRenamed("count", "m"), ["key"], "m").withColumn("band", band))
    light, heavy = posts.where(F.col("m") <= LIGHT), stage.cut(posts.where(F.col("m") > LIGHT))

    # heavy tiles that share classes are one group
    group = components(heavy.select(F.col("sig").alias("a"), F.xxhash64("key").alias("b")), stage)
    group = group.select(F.col("node").alias("sig"), F.col("comp").alias("g"))
    grouped = heavy.select("sig", "n", "band").distinct().join(group, "sig", "left").withColumn("g", F.coalesce("g", "sig"))
    grouped = stage.cut(grouped)

    # all pairs of light tiles, but for those of one group
    member = F.sort_array(F.collect_list(F.struct("n", "sig")))
    inner = f"transform(filter(slice(s, i + 1, size(s)), x -> x.n * {NUM} <= s[i - 1].n * {DEN} and x.sig <> s[i - 1].sig), x -> struct(s[i - 1].sig as a, x.sig as b))"
    pairs = (
        light.groupBy("key").agg(member.alias("s")).where("size(s) > 1")
        .selectExpr(f"explode(flatten(transform(sequence(1, size(s) - 1), i -> {inner}))) as p").select("p.a", "p.b")
    )
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: grouped.select(F.col("sig").alias(c), F.col("g").alias(f"g_{c}"))
    pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    pairs = stage.cut(pairs.where("g_a is null or g_b is null or g_a <> g_b").select("a", "b"))
    stage.drop(posts, multi, heavy)

    def fetch(sigs: DataFrame, content, name: str) -> DataFrame:
        """(sig, n, name): the content of the classes' sets, from the texts that hold them."""
        sigs = stage.cut(sigs.distinct())
        wanted = send(KeyFilter.build(sigs, "sig"))
        texts_of = send(KeyFilter.build(stage.cut(rows.join(sigs, "sig", "left_semi").select("t").distinct()), "t"))

        def contents(part: list) -> pa.RecordBatch:
            sig = np.array([_signature(s) for s in part], dtype=np.int64)
            keep = np.flatnonzero(wanted.value.mask(sig.view(np.uint64))).tolist()
            made = [pa.array(sig[keep]), pa.array([len(part[i]) for i in keep], pa.int32()), pa.array([content(part[i]) for i in keep], pa.binary())]
            return pa.RecordBatch.from_arrays(made, ["sig", "n", name])

        return stage.cut(classes.scan(contents, f"sig long, n int, {name} binary", texts_of))

    def exact(may: DataFrame) -> DataFrame:
        """The pairs that link, by the intersection of their sets."""
        may = stage.cut(may)
        keys = fetch(_both(may), lambda s: s.tobytes(), "keys")
        both = may.join(keys.select(F.col("sig").alias("a"), F.col("keys").alias("keys_a")), "a")
        both = both.join(keys.select(F.col("sig").alias("b"), F.col("keys").alias("keys_b")), "b")
        out = stage.cut(both.select("a", "b", "keys_a", "keys_b").mapInArrow(worker.batches("jaccard", _exact), "a long, b long"))
        stage.drop(keys, may)
        return out

    bits = fetch(_both(pairs), _bitmap, "bits")
    first = exact(_may_pairs(pairs, bits))
    stage.drop(pairs, bits)
    keys = fetch(grouped.select("sig"), lambda s: s.tobytes(), "keys").drop("n")
    second = stage.cut(_tiles(grouped.join(copies_of, "sig").join(keys, "sig"), stage))
    stage.drop(grouped)

    ends = first.union(first.select("b", "a")).toDF("sig", "other")
    counted = ends.join(copies_of.withColumnRenamed("sig", "other"), "other").select("sig", F.col("copies").alias("w"))
    counted = counted.unionByName(second.where("b is null").select(F.col("a").alias("sig"), "w"))
    edges = first.unionByName(second.where("b is not null").select("a", "b"))
    return edges, counted.groupBy("sig").agg(F.sum("w").alias("w"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))


def _keys(common: Broadcast):
    def emit(part: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_flat([_ordered_prefix(s, common.value) for s in part])], ["key"])

    return emit


def _may_pairs(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bitmaps' bound lets through."""
    side = lambda c: bits.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(worker.batches("jaccard", _bounded), "a long, b long")


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of words) folded to so many words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _may_link(differ: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets of total keys together can link if so many keys differ at least."""
    overlap = (total - differ) // 2
    return (DEN + NUM) * overlap >= NUM * total


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()
        differ = np.empty(len(xs), dtype=np.int64)
        for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
            u, v = np.frombuffer(x, dtype=np.uint64)[None], np.frombuffer(y, dtype=np.uint64)[None]
            words = min(u.shape[1], v.shape[1])
            differ[i] = np.bitwise_count(_fold(u, words) ^ _fold(v, words)).sum()
        total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
        yield batch.select(["a", "b"]).filter(pa.array(_may_link(differ, total)))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("keys_a").to_pylist(), batch.column("keys_b").to_pylist(), strict=True):
            u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            at = np.searchsorted(u, v)
            both = int((u[np.minimum(at, len(u) - 1)] == v).sum())
            ok.append(DEN * both >= NUM * (len(u) + len(v) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _tiles(rows: DataFrame, stage: Stage) -> DataFrame:
    """Of classes in groups (sig, n, band, g, copies, keys): what _compare makes of each tile. A class is sent
    once for each block that its own one meets and not once a key, as near copies share most of their keys."""
    rows = stage.cut(rows)
    # blocks of one band, of about BLOCK classes and BLOCK_KEYS keys at most
    need = lambda: F.ceil(F.greatest(F.col("m") / BLOCK, F.col("keys") / BLOCK_KEYS)).cast("int")
    blocks = rows.groupBy("g", "band").agg(F.count("*").alias("m"), F.sum(F.col("n").cast("long")).alias("keys")).withColumn("k", need())
    around = blocks.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("ks"), F.sum("m").alias("m"), F.sum("keys").alias("keys"))
    around = around.select("g", "ks", (need() == 1).alias("small"))
    # a group's classes meet in one place and its blocks are made and compared there: dealing the blocks out
    # would send each class once for every block that its own one meets
    rows = rows.join(around, "g").withColumn("sub", F.pmod(F.xxhash64("sig"), F.element_at("ks", F.col("band"))).cast("int"))
    # a block meets itself, the other blocks of its band and all of the next band; a small group is one tile
    same = "transform(sequence(0, ks[band] - 1), s -> struct(band as b1, least(s, sub) as s1, band as b2, greatest(s, sub) as s2))"
    up = "if(ks[band + 1] is null, array(), transform(sequence(0, ks[band + 1] - 1), s -> struct(band as b1, sub as s1, band + 1 as b2, s as s2)))"
    down = "if(ks[band - 1] is null, array(), transform(sequence(0, ks[band - 1] - 1), s -> struct(band - 1 as b1, s as s1, band as b2, sub as s2)))"
    tile = f"explode(if(small, array(struct(-1 as b1, 0 as s1, -1 as b2, 0 as s2)), concat({same}, {up}, {down}))) as tile"
    dealt = rows.select("g", "sig", "n", "copies", "band", "sub", "keys", F.expr(tile))
    left = F.expr("band = tile.b1 and sub = tile.s1")
    dealt = dealt.select("g", "tile", left.alias("left"), "sig", "n", "copies", "keys")
    return dealt.groupBy("g", "tile").applyInArrow(worker.groups("jaccard", _compare), "a long, b long, w long")


def _compare(table: pa.Table) -> pa.Table:
    """(a, null, w): in how many rows of other classes class a has links here; (a, b, 0): links that connect
    what all links here connect."""
    tile = table.column("tile")[0].as_py()
    order = np.argsort(table.column("n").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    n = table.column("n").to_numpy().astype(np.int64)
    sig, copies = table.column("sig").to_numpy(), table.column("copies").to_numpy()
    left = table.column("left").to_numpy()
    alone = (tile["b1"], tile["s1"]) == (tile["b2"], tile["s2"])
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()]
    raw = [np.frombuffer(_bitmap(x, 8), dtype=np.uint64)[None] for x in sets]
    offs = np.concatenate([[0], np.cumsum(n)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(len(ids), dtype=bool)
    words = np.array([x.shape[1] for x in raw])
    w, comp, edges = np.zeros(len(sig), dtype=np.int64), np.arange(len(sig)), []
    width, bits, begin = 0, None, 0
    for i in range(len(sig)):
        if words[i] != width:  # rows as wide, and the next wider ones folded; wider ones still are too large
            width, begin = int(words[i]), i
            end = int(np.searchsorted(words, 2 * width, side="right"))
            bits = np.concatenate([_fold(x, width) for x in raw[i:end]])
        at = np.arange(i + 1, np.searchsorted(n, n[i] * DEN // NUM, side="right"))
        if not alone:
            at = at[left[at] != left[i]]
        if len(at):
            differ = np.bitwise_count(bits[i - begin] ^ bits[at - begin]).sum(axis=1, dtype=np.int64)
            at = at[_may_link(differ, n[i] + n[at])]
        if len(at):
            mine = ids[offs[i] : offs[i + 1]]
            marked[mine] = True
            start = np.cumsum(n[at]) - n[at]
            theirs = ids[np.repeat(offs[at] - start, n[at]) + np.arange(n[at].sum())]
            both = np.add.reduceat(marked[theirs], start, dtype=np.int64)
            marked[mine] = False
            at = at[DEN * both >= NUM * (n[i] + n[at] - both)]
            w[i] += copies[at].sum()
            w[at] += copies[i]
            new, first = np.unique(comp[at], return_index=True)
            for c, j in zip(new.tolist(), at[first].tolist(), strict=True):
                if c != comp[i]:
                    comp[comp == c] = comp[i]
                    edges.append((i, j))
    some = np.flatnonzero(w)
    pair = np.array(edges, dtype=np.int64).reshape(-1, 2)
    a, b = sig[pair[:, 0]], sig[pair[:, 1]]
    return pa.table({
        "a": pa.array(np.concatenate([sig[some], np.minimum(a, b)])),
        "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(np.maximum(a, b))]),
        "w": pa.array(np.concatenate([w[some], np.zeros(len(pair), dtype=np.int64)])),
    })


def _linked(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's class, the components of classes and the links of each class."""
    with Stage(docs.sparkSession) as stage:
        rows = stage.cut(classes_of(docs, k), keep=True)
        copies = stage.cut(rows.where("sig is not null").groupBy("sig").agg(F.count("*").alias("copies")))
        edges, counted = links(docs, rows, copies, stage, k)
        counted = stage.cut(counted, keep=True)
        return rows, stage.cut(components(edges, stage), keep=True), counted


def join(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; class_id, the signature of its set; same_set, the
    number of other rows with the same set; and n_links, the number of other rows that it links with, those
    of the same set among them."""
    return _with_components(*_linked(docs, k))


def clusters(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, t (the text's xxhash64) and cluster of each row: rows are in one cluster if links connect them,
    whatever their ids; it is null for a text without words."""
    rows, comp, _ = _linked(docs, k)
    rows = rows.join(comp.select(F.col("node").alias("sig"), "comp"), "sig", "left")
    return rows.select("doc_id", "t", F.coalesce("comp", "sig").alias("cluster"))


def _with_components(rows: DataFrame, comp: DataFrame, counted: DataFrame) -> DataFrame:
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = classes.join(comp.select(F.col("node").alias("sig"), "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    least = classes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    same = F.col("copies") - 1
    classes = classes.join(least, "comp").join(counted, "sig", "left")
    classes = classes.select("sig", "component_id", same.alias("same_set"), (same + F.coalesce("w", F.lit(0))).alias("n_links"))
    return rows.join(classes, "sig", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("sig").alias("class_id"),
        F.coalesce("same_set", F.lit(0)).alias("same_set"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, same_set and n_links of all documents."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
