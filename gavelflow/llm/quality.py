"""Quality rules with adaptive thresholds, in DataFrame operations only.

Besides the base rules, four ratios of a document are held against thresholds that come from the
corpus itself: a quantile sketch for each language and source and ratio. The sketch counts values in
buckets whose bounds grow by a constant factor, so a quantile is within REL of the true one, sketches
merge by adding counts, in any order and with equal results, and the size of one is bounded. Groups of
fewer than MIN_GROUP documents use their language's sketch, and the whole corpus's if that is small
too; both are merged from the groups'. A value fails when it is above q + s * (q - median), where q is its
group's quantile and s the spread that FENCE names for the ratio. So what is usual in a group, the share of
its documents up to the quantile, never fails there. There are no fixed cutoffs. Documents that fail the
base rules are in no sketch, as they would set the tails; a group of theirs alone has no limits.

Rows: a null text counts as one without words; it fails the base rules. Null languages and sources are
groups of their own. Repeated rows are separate documents. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelflow.llm.common import Stage

REL = 0.02
LEAST = 1e-4
MIN_GROUP = 50
#: Quantile and spread. Symbols are the mark of junk, which may be a fifth of a group; the other ratios have
#: a long tail in good documents too, and the base rules have taken the worst repeats.
FENCE = {"symbol_ratio": (0.8, 1.0), "dup_line_ratio": (0.99, 1.0), "repeat_ratio": (0.99, 1.0), "mean_word": (0.95, 1.0)}
WINDOW = 5
MIN_WORDS = 10

_SPACES = r"' \t\n\u000b\u000c\r'"
_SYMBOLS = "'#*$%&|<>'"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more in the text."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(_let(grams, covered))

    def covered(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            _let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), among)
        )

    def among(s: Column) -> Column:
        x = lambda at: F.get(s, at)["x"]
        again = F.transform(s, lambda e, j: F.when((x(j - 1) == e["x"]) | (x(j + 1) == e["x"]), e["i"]))
        at = F.sort_array(F.filter(again, lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct(
            (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")
        )
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    return _let(words, of)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and base_failed of each row."""
    text = docs.select(F.col("doc_id").cast("long"), "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    trimmed = f"btrim(text, {_SPACES})"
    words = F.expr(rf"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '[\\x20\\x09-\\x0D]+'))")
    lines = F.expr(f"filter(split(text, '\\n'), x -> btrim(x, {_SPACES}) <> '')")
    counted = text.select(
        "doc_id",
        "lang",
        "source",
        _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        F.expr(f"length(translate(text, {_SPACES}, ''))").cast("long").alias("word_chars"),
        F.expr(f"length(text) - length(translate(text, {_SYMBOLS}, ''))").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
    )
    out = counted.select(
        "doc_id", "lang", "source",
        F.col("w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.d").cast("long").alias("n_dup_lines"),
        F.col("w.r").cast("long").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.withColumn("base_failed", failed)


def ratios(rows: DataFrame) -> dict[str, Column]:
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_ratio": over("n_symbols", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
        "mean_word": over("word_chars", "n_words"),
    }


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable sketches."""
    each = F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("v")) for k, v in ratios(rows).items()])
    x = rows.where(~F.col("base_failed")).select("lang", "source", F.explode(each).alias("r")).select("lang", "source", "r.ratio", "r.v")
    bucket = F.when(F.col("v") <= LEAST, 0).otherwise(F.ceil(F.log(F.col("v") / LEAST) / F.log(F.lit((1 + REL) / (1 - REL)))))
    return x.groupBy("lang", "source", "ratio", bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches for coarser groups."""
    return sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, *by: str) -> DataFrame:
    """(by..., ratio, size, most): what a value must not be above, by the sketch of its group."""
    group = Window.partitionBy(*by, "ratio")
    x = sketch.withColumn("size", F.sum("n").over(group))
    x = x.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    factor = (1 + REL) / (1 - REL)
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(LEAST * F.pow(F.lit(factor), F.col("bucket")))
    of = lambda i: F.coalesce(*[F.when(F.col("ratio") == k, F.lit(x[i])) for k, x in FENCE.items()])
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("size") * q, value))
    found = x.groupBy(*by, "ratio").agg(F.max("size").alias("size"), at(0.5).alias("q50"), at(of(0)).alias("q"))
    return found.select(*by, "ratio", "size", (F.col("q") + of(1) * (F.col("q") - F.col("q50"))).alias("most"))


def _wide(found: DataFrame, by: list[str], level: str) -> DataFrame:
    most = [F.max(F.when(F.col("ratio") == k, F.col("most"))).alias(f"{level}_{k}") for k in FENCE]
    return found.groupBy(*by).agg(F.max("size").alias(f"{level}_size"), *most)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the names of the ratios that fail."""
    with Stage(docs.sparkSession) as stage:
        rows = stage.cut(measures(docs), keep=True)
        sketch = stage.cut(sketches(rows))
        one = _wide(limits(sketch, "lang", "source"), ["lang", "source"], "one")
        lang = _wide(limits(merged(sketch, "lang"), "lang"), ["lang"], "lang")
        both = one.withColumnRenamed("lang", "g_lang").withColumnRenamed("source", "g_source")
        both = both.join(lang.withColumnRenamed("lang", "l_lang"), F.col("g_lang").eqNullSafe(F.col("l_lang")))
        every = _wide(limits(merged(sketch)), [], "all")
        both = both.crossJoin(F.broadcast(every))  # one row
        most = lambda k: F.when(F.col("one_size") >= MIN_GROUP, F.col(f"one_{k}")).when(F.col("lang_size") >= MIN_GROUP, F.col(f"lang_{k}")).otherwise(F.col(f"all_{k}"))
        both = stage.cut(both.select("g_lang", "g_source", *[most(k).alias(f"most_{k}") for k in FENCE]), keep=True)
    joined = rows.join(both, rows["lang"].eqNullSafe(both["g_lang"]) & rows["source"].eqNullSafe(both["g_source"]), "left")
    bad = F.array_compact(F.array(*[F.when(v > F.col(f"most_{k}"), F.lit(k)) for k, v in ratios(rows).items()]))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(bad) == 0)).alias("kept"),
        F.array_join(bad, ",").alias("failed_ratios"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict on all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_OVER = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
}
_EACH = " union all ".join(f"select row, lang, source, '{k}' as ratio, ({v})::double as v from m" for k, v in _OVER.items())
_OF = ["case ratio " + " ".join(f"when '{k}' then {x[i]}::double" for k, x in FENCE.items()) + " end" for i in range(2)]
_LIMIT = """select {by} ratio, size, q + ({spread}) * (q - q50) as most from (select {by} ratio, max(size) as size,
  min(value) filter (upto >= size * 0.5) as q50, min(value) filter (upto >= size * ({tail})) as q
  from (select *, sum(n) over (partition by {by} ratio) as size,
    sum(n) over (partition by {by} ratio order by bucket) as upto,
    case when bucket = 0 then 0.0::double else {least}::double * pow({factor}::double, bucket) end as value
    from (select {by} ratio, bucket, sum(n) as n from sketch group by {by} ratio, bucket)) group by {by} ratio)"""
_FACTOR = repr((1 + REL) / (1 - REL))

ORACLE_SQL = f"""
with d as (
  select row_number() over () as row, doc_id, lang, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
g as (select row, i, w[i : i + 4] as gram from d, unnest(range(1, len(w) - 3)) as u(i)),
h as (select row, i, count(*) over (partition by row, gram) as c from g),
cov as (select row, sum(least(5, nxt - i)) as r
  from (select row, i, coalesce(lead(i) over (partition by row order by i), i + 5) as nxt from h where c > 1) group by row),
ln as (select row, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines
  from (select row, unnest(string_split(text, chr(10))) as x from d)
  where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by row),
m as (select d.row, doc_id, lang, source, len(w)::bigint as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(r, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
  from d left join cov using (row) left join ln using (row)),
v as ({_EACH}),
sketch as (select v.lang, v.source, ratio,
    (case when v <= {LEAST}::double then 0 else ceil(ln(v / {LEAST}::double) / ln({_FACTOR}::double)) end)::int as bucket, count(*) as n
  from v join m using (row) where not (n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * 20) group by all),
one as ({_LIMIT.format(by="lang, source,", least=LEAST, factor=_FACTOR, tail=_OF[0], spread=_OF[1])}),
lng as ({_LIMIT.format(by="lang,", least=LEAST, factor=_FACTOR, tail=_OF[0], spread=_OF[1])}),
every as ({_LIMIT.format(by="", least=LEAST, factor=_FACTOR, tail=_OF[0], spread=_OF[1])}),
f as (select v.row, v.ratio, one.size is not null and v.v > case when one.size >= {MIN_GROUP} then one.most when lng.size >= {MIN_GROUP} then lng.most else every.most end as fails
  from v
  left join one on v.lang is not distinct from one.lang and v.source is not distinct from one.source and v.ratio = one.ratio
  left join lng on v.lang is not distinct from lng.lang and v.ratio = lng.ratio
  left join every on v.ratio = every.ratio),
names as (select row, coalesce(string_agg(ratio, ',' order by list_position({list(FENCE)}, ratio)) filter (fails), '') as failed_ratios
  from f group by row)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * 20) as base_failed,
  not (n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * 20) and failed_ratios = '' as kept,
  failed_ratios
from m join names using (row)
"""
