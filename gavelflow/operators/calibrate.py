"""Thresholds, metrics, class weights, acceptance gates and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    below = 2 * tp + fp + fn
    return F.when(below > 0, 2 * tp / below).otherwise(0.0)


def best_thresholds(rows: DataFrame) -> DataFrame:
    """(label, threshold, precision, recall, f1) from (label, score, target): the score at which to cut for
    the best F1, the highest of equal ones. Rows are first counted by score, so the running sums go
    over distinct scores, not rows."""
    by = rows.groupBy("label", "score").agg(F.sum("target").alias("pos"), F.count("*").alias("n"))
    down = Window.partitionBy("label").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("label")
    x = by.withColumn("tp", F.sum("pos").over(down)).withColumn("seen", F.sum("n").over(down)).withColumn("all_pos", F.sum("pos").over(all_))
    x = x.withColumn("f1", _f1(F.col("tp"), F.col("seen") - F.col("tp"), F.col("all_pos") - F.col("tp")))
    best = x.groupBy("label").agg(F.max(F.struct("f1", "score", "tp", "seen", "all_pos")).alias("b"))
    return best.select(
        "label", F.col("b.score").alias("threshold"), F.round(F.col("b.tp") / F.col("b.seen"), 6).alias("precision"),
        F.round(F.when(F.col("b.all_pos") > 0, F.col("b.tp") / F.col("b.all_pos")).otherwise(0.0), 6).alias("recall"), F.round("b.f1", 6).alias("f1"),
    )


def grid_thresholds(rows: DataFrame, grid: list[float], default: float = 0.5) -> DataFrame:
    """(label, threshold, f1): the lowest of the best thresholds of a grid; labels without positives keep the
    default. One pass: each grid point is a pair of sums."""
    sums = []
    for i, t in enumerate(grid):
        hit = F.col("score") >= t
        sums += [F.sum(F.when(hit, F.col("target")).otherwise(0)).alias(f"tp{i}"), F.sum(hit.cast("int")).alias(f"n{i}")]
    x = rows.groupBy("label").agg(F.sum("target").alias("pos"), *sums)
    each = F.array(*[F.struct(_f1(F.col(f"tp{i}"), F.col(f"n{i}") - F.col(f"tp{i}"), F.col("pos") - F.col(f"tp{i}")).alias("f1"), F.lit(-t).alias("t")) for i, t in enumerate(grid)])
    x = x.withColumn("b", F.array_max(each))
    none = F.col("pos") == 0
    return x.select("label", F.when(none, default).otherwise(-F.col("b.t")).alias("threshold"), F.round(F.when(none, 0.0).otherwise(F.col("b.f1")), 6).alias("f1"))


def metrics(rows: DataFrame) -> DataFrame:
    """micro and macro F1, micro precision and recall and exact match, of (id, label, predicted, target)."""
    p, t = F.col("predicted"), F.col("target")
    each = rows.groupBy("label").agg(F.sum(p * t).alias("tp"), F.sum(p * (1 - t)).alias("fp"), F.sum((1 - p) * t).alias("fn"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    micro = each.agg(
        F.round(_f1(tp, fp, fn), 6).alias("micro_f1"), F.round(F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn"))), 6).alias("macro_f1"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
    )
    exact = rows.groupBy("id").agg(F.bool_and(p == t).alias("same")).agg(F.round(F.avg(F.col("same").cast("double")), 6).alias("exact_match"))
    return micro.crossJoin(exact)  # one row each


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, weight): negatives over positives, from 1 to 12."""
    pos, n = F.sum("target"), F.count("*")
    return rows.groupBy("label").agg(F.round(F.least(F.greatest((n - pos) / F.greatest(pos, F.lit(1)), F.lit(1.0)), F.lit(12.0)), 6).alias("weight"))


def acceptance(report: DataFrame) -> DataFrame:
    """Adds failures and accepted to (samples, precision, recall, action_disagreement_rate,
    severe_false_negatives)."""
    # What a shadow run has to reach.
    gates = {
        "samples": F.col("samples") < 1000,
        "precision": F.col("precision") < 0.90,
        "recall": F.col("recall") < 0.85,
        "action_disagreement_rate": F.col("action_disagreement_rate") > 0.05,
        "severe_false_negatives": F.col("severe_false_negatives") > 0,
    }
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in gates.items()]))
    return report.withColumn("failures", failed).withColumn("accepted", F.size("failures") == 0)


def chosen_labels(scores: DataFrame, key: str, thresholds: dict[str, float], top: int = 5) -> DataFrame:
    """(key, labels, top_labels): labels at or over their thresholds (0.5 by default), SAFE only alone or for
    none; and the best scores, to six places."""
    from gavelflow.operators import policy as P
    from gavelflow.operators.curate import exclusive

    over = F.col("score") >= P.lookup(thresholds or {"": 0.5}, F.col("label"), 0.5)
    x = scores.groupBy(key).agg(
        F.collect_list(F.when(over, F.col("label"))).alias("picked"),
        F.array_sort(F.collect_list(F.struct((-F.round("score", 6)).alias("s"), "label"))).alias("all"),
    )
    best = F.transform(F.slice("all", 1, top), lambda s: F.concat_ws(":", s["label"], (-s["s"]).cast("string")))
    return x.select(key, F.array_sort(exclusive(F.col("picked"))).alias("labels"), best.alias("top_labels"))


def latency_report(df: DataFrame, latency: str, by: list[str] | None = None) -> DataFrame:
    """n, mean and the 50th, 80th, 95th and 99th percentiles, by linear interpolation."""
    p = F.percentile(F.col(latency).cast("double"), F.array(*map(F.lit, (0.5, 0.8, 0.95, 0.99))))
    x = df.groupBy(*(by or [])).agg(F.count(latency).alias("n"), F.round(F.avg(F.col(latency).cast("double")), 6).alias("mean"), p.alias("p"))
    return x.select(*(by or []), "n", "mean", *[F.round(F.get("p", F.lit(i)), 6).alias(k) for i, k in enumerate(("p50", "p80", "p95", "p99"))])


def load_report(df: DataFrame, success: float = 0.99, p80: float = 3000, p95: float = 5000) -> DataFrame:
    """One row about requests (status_code, error_kind, latency_ms): counts, percentiles and whether the
    targets are met."""
    ok = F.col("status_code").between(200, 299) & F.col("error_kind").isNull()
    x = df.agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"),
        F.percentile(F.col("latency_ms").cast("double"), F.array(F.lit(0.8), F.lit(0.95))).alias("p"),
    )
    rate = F.round(F.when(F.col("n") > 0, F.col("n_ok") / F.col("n")).otherwise(0.0), 6)
    q80, q95 = F.round(F.get("p", F.lit(0)), 6), F.round(F.get("p", F.lit(1)), 6)
    return x.select("n", "n_ok", rate.alias("success_rate"), q80.alias("p80"), q95.alias("p95"), ((rate >= success) & (q80 <= p80) & (q95 <= p95)).alias("targets_met"))


def load_plan(spark, users: int, messages: int, channels: int, scenarios: int, seconds: float) -> DataFrame:
    """users * messages rows (sequence, user, channel, scenario, offset_s), dealt in turn."""
    n = users * messages
    s = F.col("id")
    return spark.range(n).select(s.alias("sequence"), (s % users).alias("user"), (s % channels).alias("channel"), (s % scenarios).alias("scenario"), F.round(s * seconds / n, 6).alias("offset_s"))


def median_runs(runs: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """The median of each metric over the repeats of a benchmark, a row a run."""
    return runs.groupBy(*group).agg(*[F.median(m).alias(m) for m in metrics])
