"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets: the sources, in the order of their names by code point with null last, weigh WEIGHTS,
repeating, and share SHARE of all words; no target passes CAP times its source's size, and what is
above goes to the others by weight (solved in closed form over the sources sorted by size / weight).

Blocks: a source's documents are dealt by a seeded hash to about as many shards as each shard then
has documents, the square root of their number, so neither a shard nor a source's list of shards
becomes large: a source with a third of all rows is split like any other. Blocks of BLOCK words go to
the sources by highest quotients target / (2 s + 1), then each source's to its shards by theirs. What
a small shard can't take of its quota, as it may be gone round CAP times only, and what a source's blocks
are short of its target or beyond it, is dealt to its shards in their order, so each source takes its
target to the word. A shard lays its documents end to end in a seeded order, as a ring, and takes its
words from a seeded block on.

Rows: a null text has 0 words and is never taken. A null source is a source of its own. Repeated rows
are separate documents. Sources without words have target 0. Other columns are ignored by op2, and
kept by mixed_documents. Equal input gives equal output, however it is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelflow.llm.common import WORD, Stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 32
SEED = 20240607


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(*cols) -> Column:
    """A seeded hash of the columns, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]))


def _number(digits: Column) -> Column:
    return F.conv(F.substring(digits, 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds nr (the source's place), target and all_target to rows (source, source_size), one a source."""
    placed = sources.withColumn("nr", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nr") - 1) % len(weights) + 1).cast("int"))
    size = F.col("source_size").cast("double")
    whole = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy("fills", "nr")
    x = placed.withColumn("weight", weight).withColumn("top", size * cap).withColumn("fills", F.col("top") / F.col("weight"))
    x = x.withColumn("budget", F.sum(size).over(whole) * share)
    spent = F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("level", (F.col("budget") - spent) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # the first source that its share doesn't fill sets the level for all others
    level = F.min(F.when(F.col("fills") > F.col("level"), F.struct("fills", "nr", "level"))).over(whole)["level"]
    x = x.withColumn("target", F.least("top", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return x.withColumn("all_target", F.sum("target").over(whole)).drop("weight", "top", "fills", "budget", "level")


def apportion(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """Adds quota: the seats (a number a group) that each party of the group gets by highest quotients
    votes / (2 s + 1), ties by order. Only the quotients that can be near the last seat are ranked,
    a few for each party."""
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    v = F.col(votes).cast("double")
    x = parties.withColumn("_all", F.sum(v).over(by)).withColumn("_n", F.count("*").over(by) / 2)
    at = lambda shift: v * (F.col(seats) + shift) / F.col("_all")
    none = (F.col("_all") <= 0) | (v <= 0) | (F.col(seats) <= 0)
    # with the divisors all / (seats -+ parties / 2), rounding gives too few or too many seats
    x = x.withColumn("_lo", F.when(none, 0).otherwise(F.greatest(F.floor(at(-F.col("_n")) - 0.5), F.lit(0))).cast("long"))
    x = x.withColumn("_hi", F.when(none, 0).otherwise(F.floor(at(F.col("_n")) + 0.5) + 2).cast("long"))
    x = x.withColumn("_left", F.col(seats) - F.sum("_lo").over(by))
    more = x.where("_hi > _lo").select(*group, *order, "_left", v.alias("_v"), F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_s"))
    ranked = by.orderBy((F.col("_v") / (F.col("_s") * 2 + 1)).desc(), *order)
    won = more.withColumn("_r", F.row_number().over(ranked)).where("_r <= _left")
    keys = [*group, *order]
    won = won.groupBy(*keys).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(k).alias(f"_{k}") for k in keys], "_won")
    on = [x[k].eqNullSafe(won[f"_{k}"]) for k in keys]
    out = x.join(won, on, "left").withColumn("quota", F.col("_lo") + F.coalesce("_won", F.lit(0)))
    return out.select(*parties.columns, "quota")


def _rows(docs: DataFrame) -> DataFrame:
    return (
        docs.withColumn("_size", n_words(F.col("text")))
        .withColumn("_source", F.col("source").cast("string"))
        .withColumn("_t", F.md5(F.coalesce(F.col("text"), F.lit(""))))
        .withColumn("_h", _seeded("doc_id", "_size", "_t"))
    )


def _tables(rows: DataFrame, stage: Stage, weights, share, cap, block) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target, shards) and (source, shard, shard_size, quota)."""
    sources = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("docs"))
    sources = sources.withColumn("shards", F.ceil(F.sqrt("docs")).cast("long"))
    sources = targets(sources, weights, share, cap).withColumn("blocks", F.round(F.col("all_target") / block).cast("long"))
    sources = apportion(sources, [], ["nr"], "target", "blocks").withColumnRenamed("quota", "source_blocks")
    sources = stage.cut(sources.select("source", "nr", "source_size", "target", "shards", "source_blocks"), keep=True)
    # within half a word of the target; not a half itself, at which engines could differ by their rounding errors
    goal = F.floor(F.col("target") + 0.499).cast("long").alias("goal")
    shards = _sharded(rows, sources).groupBy("nr", "source_blocks", goal, "shard").agg(F.sum("_size").alias("shard_size"))
    shards = apportion(shards, ["nr"], ["shard"], "shard_size", "source_blocks")
    shards = _settled(shards.withColumn("_quota", F.col("quota") * block), int(cap))
    shards = shards.withColumn("_first", F.pmod(_number(_seeded("nr", "shard")), F.greatest(F.col("shard_size"), F.lit(1))))
    shards = shards.select(
        "nr",
        "shard",
        "shard_size",
        "take",
        (F.floor(F.col("_first") / block) * block).cast("long").alias("first"),
    )
    return sources, stage.cut(shards, keep=True)


def _settled(shards: DataFrame, cap: int) -> DataFrame:
    """Adds take: _quota, up to the shard's size cap times, and the difference to the source's goal dealt to its
    shards in their order, each as far as it has room or words."""
    own = Window.partitionBy("nr")
    before = own.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    x = shards.withColumn("_take", F.least(F.col("_quota"), F.col("shard_size") * cap))
    x = x.withColumn("_room", F.col("shard_size") * cap - F.col("_take"))
    x = x.withColumn("_more", F.col("goal") - F.sum("_take").over(own))
    add = F.greatest(F.lit(0), F.least(F.col("_more") - sum_before("_room"), F.col("_room")))
    less = F.greatest(F.lit(0), F.least(-F.col("_more") - sum_before("_take"), F.col("_take")))
    return x.withColumn("take", F.col("_take") + add - less).drop("_take", "_room", "_more")


def _sharded(rows: DataFrame, sources: DataFrame) -> DataFrame:
    joined = rows.join(sources, rows["_source"].eqNullSafe(sources["source"])).drop(sources["source"])
    return joined.withColumn("shard", F.pmod(_number(F.col("_h")), F.col("shards")))


def _taken(rows: DataFrame, sources: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds taken and where it lies: whole (times that all words go) and two ranges of words, from_1 to
    to_1 and from_2 to to_2, that go once more."""
    x = _sharded(rows, sources)
    ring = Window.partitionBy("nr", "shard").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_end", F.sum("_size").over(ring)).withColumn("_begin", F.col("_end") - F.col("_size"))
    x = x.join(shards, ["nr", "shard"])
    size = F.greatest(F.col("shard_size"), F.lit(1))
    x = x.withColumn("whole", F.floor(F.col("take") / size).cast("long"))
    x = x.withColumn("_more", F.col("take") - F.col("whole") * F.col("shard_size"))
    x = x.withColumn("_to", F.col("first") + F.col("_more"))
    cut = lambda at: F.greatest(F.lit(0), F.least(F.col("_size"), at - F.col("_begin"))).cast("long")
    x = x.withColumns({
        "from_1": cut(F.col("first")),
        "to_1": cut(F.least(F.col("_to"), F.col("shard_size"))),
        "from_2": F.lit(0).cast("long"),
        "to_2": cut(F.greatest(F.col("_to") - F.col("shard_size"), F.lit(0))),
    })
    some = F.greatest(F.col("to_1") - F.col("from_1"), F.lit(0)) + F.col("to_2")
    return x.withColumn("taken", (F.col("whole") * F.col("_size") + some).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row."""
    with Stage(docs.sparkSession) as stage:
        rows = stage.cut(_rows(docs.select("doc_id", "text", "source")).select("doc_id", "_source", "_size", "_h"), keep=True)
        x = _taken(rows, *_tables(rows, stage, weights, share, cap, block))
        return x.select(F.col("doc_id").cast("long"), F.col("_size").alias("size"), "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document goes whole, and a row
    with the words taken, joined by one space, for each part of one. n_chars is that of the new text."""
    names = docs.columns
    with Stage(docs.sparkSession) as stage:
        # what else the row has travels in one struct, so that no name can clash
        rows = _rows(docs.select(F.struct(*names).alias("_row"), "doc_id", "text", "source"))
        small = stage.cut(rows.select("doc_id", "_source", "_size", "_h"))
        x = _taken(rows.drop("source"), *_tables(small, stage, weights, share, cap, block))
    words = F.expr(r"split(btrim(text, ' \t\n\u000b\u000c\r'), '[\\x20\\x09-\\x0D]+')")
    part = lambda a, b: F.array_join(F.slice(words, F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int")), " ")
    full = (F.col("to_1") - F.col("from_1") == F.col("_size")) & (F.col("_size") > 0)
    copies = F.array_repeat(F.col("text"), (F.col("whole") * F.when(F.col("_size") > 0, 1).otherwise(0) + full.cast("int")).cast("int"))
    one = F.when(~full & (F.col("to_1") > F.col("from_1")), F.array(part("from_1", "to_1"))).otherwise(F.array().cast("array<string>"))
    two = F.when(F.col("to_2") > 0, F.array(part("from_2", "to_2"))).otherwise(F.array().cast("array<string>"))
    x = x.withColumn("_texts", F.concat(copies, one, two)).withColumn("_text", F.explode("_texts"))
    out = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return x.select(*[out[c].alias(c) if c in out else F.col(f"_row.`{c}`").alias(c) for c in names])


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
with docs as (
  select doc_id, source, md5(coalesce(text, '')) as t,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size
  from documents),
hashed as (
  select *, md5('{SEED}|' || coalesce(doc_id::varchar, '-') || '|' || size::varchar || '|' || t) as h from docs),
src as (
  select source, sum(size)::bigint as source_size, ceil(sqrt(count(*)))::bigint as shards,
         row_number() over (order by source asc nulls last) as nr
  from hashed group by source),
fill as (
  select *, (case (nr - 1) % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end)::double as w, 2.0::double * source_size as top from src),
lev as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(top) over (order by top / w, nr rows between unbounded preceding and 1 preceding), 0))
         / sum(w) over (order by top / w, nr rows between current row and unbounded following) as level from fill),
tgt as (
  select *, least(top, w * coalesce((select arg_min(level, (top / w, nr)) from lev where top / w > level), 'infinity'::double)) as target from lev),
blk as (select *, round(sum(target) over () / {BLOCK})::bigint as blocks from tgt),
sq as (
  select nr, row_number() over (order by target / (2 * s + 1) desc, nr) as r, blocks
  from blk, unnest(range(0, ceil(target / {BLOCK})::bigint + 40)) as u(s) where target > 0),
sb as (select nr, count(*) as source_blocks from sq where r <= blocks group by nr),
dealt as (
  select d.*, b.nr, b.source_size, b.target, ('0x' || substr(h, 1, 12))::bigint % b.shards as shard
  from hashed d join blk b on d.source is not distinct from b.source),
sh as (select nr, shard, sum(size)::bigint as shard_size from dealt group by nr, shard),
shq as (
  select nr, shard, source_blocks, row_number() over (partition by nr order by shard_size / (2 * s + 1) desc, shard) as r
  from sh join sb using (nr), unnest(range(0, 2 * shard_size // {BLOCK} + 10)) as u(s) where shard_size > 0),
won as (select nr, shard, count(*) as q from shq where r <= source_blocks group by nr, shard),
own as (
  select nr, shard, shard_size, least(coalesce(q, 0) * {BLOCK}, 2 * shard_size)::bigint as t0, floor(target + 0.499)::bigint as goal
  from sh join tgt using (nr) left join won using (nr, shard)),
gap as (
  select *, 2 * shard_size - t0 as room, goal - sum(t0) over (partition by nr) as d,
    coalesce(sum(2 * shard_size - t0) over w, 0) as room_before, coalesce(sum(t0) over w, 0) as t0_before
  from own window w as (partition by nr order by shard rows between unbounded preceding and 1 preceding)),
ring as (
  select nr, shard, shard_size,
    (t0 + greatest(0, least(d - room_before, room)) - greatest(0, least(-d - t0_before, t0)))::bigint as take,
    (('0x' || substr(md5('{SEED}|' || nr || '|' || shard), 1, 12))::bigint % greatest(shard_size, 1)) // {BLOCK} * {BLOCK} as first
  from gap),
placed as (
  select d.*, sum(size) over (partition by nr, shard order by h, doc_id rows unbounded preceding) - size as a from dealt d),
cutup as (
  select p.doc_id, p.size, p.source_size, p.target, p.a, r.first, r.shard_size,
    r.take // greatest(r.shard_size, 1) as whole, r.first + r.take % greatest(r.shard_size, 1) as upto
  from placed p join ring r using (nr, shard))
select doc_id, size, source_size, target,
  (whole * size + greatest(0, least(a + size, upto, shard_size) - greatest(a, first))
   + greatest(0, least(a + size, upto - shard_size) - a))::bigint as taken
from cutup
"""
