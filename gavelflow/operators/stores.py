"""Table maintenance without MERGE: upserts, idempotent inserts, purges, versioned saves, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: str, keep_first: list[str]) -> DataFrame:
    """The table after the changes: the newest row of each key by order; the columns keep_first are those of
    the oldest."""
    rows = current.unionByName(changes, allowMissingColumns=True)
    whole = Window.partitionBy(*key)
    rows = rows.withColumns({c: F.first(c, ignorenulls=True).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in keep_first})
    return rows.withColumn("_rn", F.row_number().over(whole.orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def insert_absent(current: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose key is neither in the table nor earlier among them; null keys all count as new."""
    w = Window.partitionBy(key).orderBy(order)
    first = new.withColumn("_rn", F.row_number().over(w)).where(F.col(key).isNull() | (F.col("_rn") == 1)).drop("_rn")
    return first.join(current.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(new.columns)


def purge(df: DataFrame, until: str, now: Column) -> DataFrame:
    """Without rows whose retention has ended; null never ends."""
    return df.where(F.col(until).isNull() | (F.col(until) > now))


def save_versions(current: DataFrame, saves: DataFrame, key: str) -> DataFrame:
    """What becomes of saves (key, expected, payload) against (key, revision, active): outcome saved or
    conflict, and the revision afterwards. A save passes where the revision is the one expected, or
    where there is no active row and 0 is."""
    x = saves.join(current, key, "left")
    ok = (F.col("active") & (F.col("revision") == F.col("expected"))) | (~F.coalesce("active", F.lit(False)) & (F.col("expected") == 0))
    now = F.coalesce("revision", F.lit(0))
    return x.withColumn("outcome", F.when(F.coalesce(ok, F.lit(False)), "saved").otherwise("conflict")).withColumn("new_revision", F.when(F.col("outcome") == "saved", now + 1).otherwise(now))


def reset_versions(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table with the rows of the keys inactive and one revision on, and an audit flag on them."""
    x = current.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("active")
    return x.withColumn("revision", F.col("revision") + hit.cast("int")).withColumn("reset", hit).withColumn("active", F.col("active") & ~hit).drop("_hit")


def reference_errors(rows: DataFrame, known: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """Adds error: missing_reference for no key, not_found for an unknown one, conflict where what the row
    expects isn't what is known; null where all is well."""
    x = rows.join(known, key, "left")
    error = F.when(F.col(key).isNull(), "missing_reference").when(F.col(actual).isNull(), "not_found").when(F.col(expected) != F.col(actual), "conflict")
    return x.withColumn("error", error)


def missing_results(tasks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Tasks without a result."""
    return tasks.join(results.select(key).distinct(), key, "left_anti")
