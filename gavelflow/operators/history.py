"""Rates and repeats over each user's earlier messages, as window frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: str) -> Column:
    """Microseconds since the epoch, of time stamps with or without a zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _back(by, ts: str, seconds: int):
    """A frame of so many seconds back, ends included, on microseconds."""
    return Window.partitionBy(*by).orderBy(_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)


def rates(df: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Adds messages_10s, messages_60s and messages_10m: the user's other messages up to so long before,
    those of the same instant included."""
    spans = (("messages_10s", 10), ("messages_60s", 60), ("messages_10m", 600))
    return df.withColumns({k: F.count("*").over(_back([user], ts, s)) - 1 for k, s in spans})


def recent_rates(df: DataFrame, text: str, user: str = "user_id", ts: str = "ts", tie: str = "event_id", history: int = 20) -> DataFrame:
    """Rates as a caller sees them who hands in at most history earlier messages, repeated_10m, those of equal text
    in ten minutes, and duplicate_score, that over all that were handed in: the frame is counted in rows, and
    ages are checked inside it."""
    w = Window.partitionBy(user).orderBy(ts, tie).rowsBetween(-history, -1)
    x = df.withColumn("_recent", F.collect_list(F.struct(_micros(ts).alias("at"), F.col(text).alias("text"))).over(w))
    now = _micros(ts)
    within = lambda s: F.size(F.filter("_recent", lambda r: now - r["at"] <= s * 1_000_000)).cast("long")
    same = F.filter("_recent", lambda r: (now - r["at"] <= 600_000_000) & (r["text"] == F.col(text)))
    n = F.size("_recent")
    return x.withColumns({
        "messages_10s": within(10),
        "messages_60s": within(60),
        "messages_10m": within(600),
        "repeated_10m": F.size(same).cast("long"),
        "duplicate_score": F.when(n > 0, F.round(F.size(same) / n, 3)).otherwise(0.0),
    }).drop("_recent")


def interval(df: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds interval_seconds since the user's previous message; null for the first."""
    w = Window.partitionBy(user).orderBy(ts, tie)
    gap = (_micros(ts) - F.lag(_micros(ts)).over(w)) / 1_000_000
    return df.withColumn("interval_seconds", F.round(gap, 3))


def last_messages(df: DataFrame, key: str, order: list[str], value: str, n: int = 5) -> DataFrame:
    """Adds history: the n values before each row, oldest first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn("history", F.collect_list(value).over(w))


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def capped(df: DataFrame, key: list[str], order: list, most: int) -> DataFrame:
    """Up to so many rows of each key, in the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def duplicate_ordinals(df: DataFrame, key: list[str], order: list, column: str) -> DataFrame:
    """column with -2, -3 and so on after it in the later rows of one key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .withColumn(column, F.when(F.col("_rn") > 1, F.concat_ws("-", F.col(column), F.col("_rn"))).otherwise(F.col(column)))
        .drop("_rn")
    )


def running_size(df: DataFrame, key: str, order: list, size: str, most: int) -> DataFrame:
    """Adds total_size up to the row, and rejected once that has gone over most."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total_size", F.sum(size).over(w)).withColumn("rejected", F.col("total_size") > most)


def first_occurrence(df: DataFrame, key: list[str], order: list[str], inherit: list[str]) -> DataFrame:
    """Adds is_duplicate, and gives later rows of a key the first one's values of the columns to inherit. The first
    rows are aggregated and joined back, so a key that many rows have is no one task's."""
    first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(F.struct(*order, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(inherit)])).alias("_f"))
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & df[k].eqNullSafe(F.col(f"_k{i}"))
    out = df.join(first, on)
    same = F.struct(*order).eqNullSafe(F.struct(*[F.col(f"_f.{c}") for c in order]))
    out = out.withColumn("is_duplicate", ~same).withColumns({c: F.col(f"_f._v{i}") for i, c in enumerate(inherit)})
    return out.drop("_f", *[f"_k{i}" for i in range(len(key))])
