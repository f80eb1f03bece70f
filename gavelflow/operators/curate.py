"""Dataset curation: label masks, splits, merges, audits, exports and score mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.operators import policy as P

SEED = "moderation-split"


def encode_mask(labels: Column, order=P.LABELS) -> Column:
    """A bit for each label of the schema; unknown ones have none."""
    return F.aggregate(
        F.array_distinct(labels), F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(F.coalesce(P.lookup({v: 1 << i for i, v in enumerate(order)}, x), F.lit(0)).cast("long")),
    )


def decode_mask(mask: Column, order=P.LABELS) -> Column:
    """Labels in the schema's order; SAFE only alone, and where nothing else is."""
    harmful = F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(v)) for i, v in enumerate(order) if v != "SAFE"]))
    return F.when(F.size(harmful) > 0, harmful).otherwise(F.array(F.lit("SAFE")))


def one_hot(labels: Column, order=P.LABELS) -> Column:
    return F.array(*[F.array_contains(labels, v).cast("double") for v in order])


def primary_label(labels: Column, order=P.PRIORITY) -> Column:
    """The label that comes first in the order; SAFE for none."""
    known = F.filter(F.array(*map(F.lit, order)), lambda p: F.array_contains(labels, p))
    return F.coalesce(F.get(known, F.lit(0)), F.lit("SAFE"))


def exclusive(labels: Column) -> Column:
    """SAFE goes where another label is; an empty list becomes SAFE."""
    harmful = F.array_except(labels, F.array(F.lit("SAFE")))
    return F.when(F.size(harmful) > 0, harmful).otherwise(F.array(F.lit("SAFE")))


def normalized_row(df: DataFrame, labels: str, added: str, severity: str, minimum: str) -> DataFrame:
    """label_names in schema order, severity and primary_label after a union with added labels."""
    mask = encode_mask(F.array_union(F.col(labels), F.col(added)))
    x = df.withColumn("mask", mask).withColumn("label_names", decode_mask(F.col("mask")))
    safe = F.col("label_names") == F.array(F.lit("SAFE"))
    return x.withColumn("severity", F.when(safe, 0).otherwise(F.greatest(F.col(severity), F.col(minimum)))).withColumn("primary_label", primary_label(F.col("label_names")))


def split_bucket(key: Column, seed: str = SEED, buckets: int = 10_000) -> Column:
    """The first 64 bits of a seeded SHA-256 of the key, modulo buckets; equal keys never straddle splits."""
    head = F.substring(F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), key), 256), 1, 16)
    return F.pmod(F.conv(head, 16, 10).cast("decimal(20,0)"), F.lit(buckets)).cast("long")


def split_of(key: Column, fraction: float = 0.1, seed: str = SEED) -> Column:
    return F.when(split_bucket(key, seed) < int(fraction * 10_000), "validation").otherwise("train")


def merge(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(norm, text, mask, severity, splits): rows (norm, text, mask, severity, split, pos) of several sources,
    the first of the highest rank, merged by norm: masks are united, the greatest severity and the text
    of the best source stay, and splits is 1 for train, 2 for validation, 3 for both. One shuffle, with
    partial aggregation."""
    bit = F.when(F.col("split") == "validation", 2).otherwise(1)
    parts = [df.select("norm", "text", "mask", "severity", bit.alias("split"), F.lit(i).alias("rank"), "pos") for i, (_, df) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("norm").agg(
        F.min(F.struct("rank", "split", "pos", "text")).getField("text").alias("text"),
        F.bit_or("mask").cast("long").alias("mask"),
        F.max("severity").cast("long").alias("severity"),
        F.bit_or("split").cast("long").alias("splits"),
        F.min("rank").cast("long").alias("best_rank"),
    )


def merged_split(merged: DataFrame) -> DataFrame:
    """Adds split, validation where a text was seen there, and id, from 1 on in the order of norm within a
    split. Numbers come from the counts of ranges of norm, so no task sees a whole split."""
    rows = merged.withColumn("split", F.when(F.col("splits").bitwiseAND(F.lit(2)) != 0, "validation").otherwise("train"))
    return numbered(rows, "split", "norm", "id")


def numbered(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """row_number over (partition by group order by order) without a task for each group: rows are grouped
    by the first bytes of order as well, and each such block is offset by the sizes of those before."""
    block = F.hex(F.substring(F.encode(F.col(order), "utf-8"), 1, 2))
    x = df.withColumn("_block", block)
    sizes = x.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(group, "_block").orderBy(order)
    out = x.withColumn("_in", F.row_number().over(inside)).join(sizes, [group, "_block"])
    return out.withColumn(column, (F.col("_before") + F.col("_in")).cast("long")).drop("_block", "_in", "_before")


def audit_counts(rows: DataFrame, labels: str = "label_names", primary: str = "primary_label") -> DataFrame:
    """(kind, label, n): labels, primary labels and rows."""
    each = rows.select(F.explode(F.concat(
        F.array(F.struct(F.lit("rows").alias("kind"), F.lit("").alias("label"))),
        F.array(F.struct(F.lit("primary").alias("kind"), F.col(primary).alias("label"))),
        F.transform(F.col(labels), lambda x: F.struct(F.lit("label").alias("kind"), x.alias("label"))),
    )).alias("x"))
    return each.groupBy("x.kind", "x.label").agg(F.count("*").alias("n"))


def structural_errors(rows: DataFrame, vector: str, names: str, primary: str, severity: str) -> DataFrame:
    """Counts of rows whose vector, primary label or severity doesn't follow from the names."""
    wrong = lambda c: F.count_if(~c)
    return rows.agg(
        F.count("*").alias("n_rows"),
        wrong(F.col(vector).eqNullSafe(one_hot(F.col(names)))).alias("vector_mismatch"),
        wrong(F.col(primary).eqNullSafe(primary_label(F.col(names)))).alias("primary_mismatch"),
        wrong((F.col(names) != F.array(F.lit("SAFE"))) | (F.col(severity) == 0)).alias("severity_mismatch"),
    )


def gaps(counts: DataFrame, dimension: DataFrame, train_min: int, validation_min: int) -> DataFrame:
    """(topic, label, train, validation) of the dimension's pairs that have too few rows, none included."""
    x = dimension.join(counts, ["topic", "label"], "left").fillna(0, ["train", "validation"])
    return x.where((F.col("train") < train_min) | (F.col("validation") < validation_min))


def cross_split(train: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """Keys of both splits, each once."""
    return train.select(key).intersect(validation.select(key))


def civil_labels(df: DataFrame) -> DataFrame:
    """labels and severity from scores (toxicity, severe_toxicity, obscene, threat, insult, identity_attack,
    sexual_explicit, family, grouped): rows that are neither clearly harmful nor clearly safe have none."""
    c = F.col
    parts = [
        (c("threat") >= 0.5, ["THREAT", "TOXIC"], 5),
        (c("sexual_explicit") >= 0.5, ["NSFW"], 4),
        ((c("sexual_explicit") >= 0.5) & c("family"), ["TOXIC"], 4),
        ((c("identity_attack") >= 0.5) & c("grouped"), ["HATE", "TOXIC"], 4),
        ((c("toxicity") >= 0.7) | (c("insult") >= 0.7) | (c("severe_toxicity") >= 0.5), ["TOXIC"], 3),
        (c("obscene") >= 0.7, ["PROFANITY"], 1),
    ]
    labels = F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(w, F.array(*map(F.lit, x))) for w, x, _ in parts]))))
    severity = F.greatest(F.lit(0), *[F.when(w, s).otherwise(0) for w, _, s in parts])
    scores = ["toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack", "sexual_explicit"]
    safe = F.greatest(*scores) <= 0.1
    x = df.withColumn("labels", labels).withColumn("severity", severity)
    return x.withColumn("labels", F.when(F.size("labels") > 0, F.col("labels")).when(safe, F.array(F.lit("SAFE"))))


def annotator_labels(df: DataFrame) -> DataFrame:
    """A row a comment from a row an annotator (comment_id, pos, text, hate_speech_score, insult, violence,
    genocide, target_race, target_gender): means, with null as 0, the topics that half of them see, and
    labels, null where the mean is neither hateful nor supportive."""
    mean = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
    x = df.groupBy("comment_id").agg(
        F.min_by("text", "pos").alias("text"), mean("hate_speech_score"), mean("insult"), mean("violence"), mean("genocide"),
        F.avg(F.col("target_race").cast("int")).alias("race"), F.avg(F.col("target_gender").cast("int")).alias("gender"),
    )
    hate = F.col("hate_speech_score") > 0.5
    threat = (F.col("violence") >= 2) | (F.col("genocide") >= 1)
    labels = F.when(hate & threat, F.array(F.lit("HATE"), F.lit("TOXIC"), F.lit("THREAT"))).when(hate, F.array(F.lit("HATE"), F.lit("TOXIC"))).when(F.col("hate_speech_score") < -1, F.array(F.lit("SAFE")))
    topics = F.array_compact(F.array(F.when(F.col("race") >= 0.5, F.lit("race")), F.when(F.col("gender") >= 0.5, F.lit("gender"))))
    severity = F.when(hate & threat, 5).when(hate, 4).otherwise(0)
    return x.withColumn("topics", topics).withColumn("labels", labels).withColumn("severity", severity)


def export(df: DataFrame, now: Column, sources: list[str], feedback: list[str], since: Column | None = None, until: Column | None = None, cap: int | None = None) -> DataFrame:
    """Rows fit for training: text, no injection marks, an allowed source, in the time span, not past their
    retention, confirmed or corrected; up to cap of each primary label, in the order of pos."""
    x = df.where(F.length(F.trim("text")) > 0).where(F.size("injection_markers") == 0).where(F.col("source").isin(*sources))
    if since is not None:
        x = x.where(F.col("created_at") >= since)
    if until is not None:
        x = x.where(F.col("created_at") <= until)
    x = x.where(F.col("retention_until").isNull() | (F.col("retention_until") > now)).where(F.col("feedback_type").isin(*feedback))
    if cap is None:
        return x
    w = Window.partitionBy("primary_label").orderBy("pos")
    return x.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def resolved_source(declared: Column, label: Column, action: Column, known: list[str]) -> Column:
    return F.when(declared.isin(*known), declared).when((label == "SAFE") & (action.isNull() | (action == "IGNORE")), "real_safe").otherwise("real_moderated")


def retention(created: Column, requested: Column) -> Column:
    """What is asked for, a year at most; ninety days where nothing is."""
    capped = F.least(requested, created + F.expr("interval 365 days"))
    return F.when(requested.isNotNull(), capped).otherwise(created + F.expr("interval 90 days"))


def quota_sample(df: DataFrame, quotas: dict[str, int], class_col: str, key: str, seed: str = SEED) -> DataFrame:
    """Up to its quota of each class, those with the least seeded hashes of their key."""
    w = Window.partitionBy(class_col).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key)
    most = P.lookup(quotas, F.col(class_col), 0)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def invites_labelled(df: DataFrame, text: str, upstream: str, placeholder: str, link: str) -> DataFrame:
    """Rows with the placeholder, which becomes a link: INVITE and URL, and SCAM for upstream 1."""
    x = df.where(F.col(text).contains(placeholder)).withColumn(text, F.replace(F.col(text), F.lit(placeholder), F.lit(link)))
    scam = F.col(upstream) == 1
    both = F.array(F.lit("INVITE"), F.lit("URL"))
    return x.withColumn("labels", F.when(scam, F.array_append(both, F.lit("SCAM"))).otherwise(both)).withColumn("severity", F.when(scam, 4).otherwise(1))


def augmented(parts: list[DataFrame], columns: list[str], n: int, key) -> DataFrame:
    """The first n distinct combinations, in the order of their text, of small template tables; an error if
    there are fewer. The tables are templates of the caller's, so their product is small by design."""
    rows = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
    text = rows.select(F.concat_ws(" ", *columns).alias("text"))
    found = text.groupBy(key(F.col("text")).alias("norm")).agg(F.min("text").alias("text")).orderBy("norm").limit(n)
    if found.count() < n:
        raise ValueError(f"the templates make fewer than {n} texts")
    return found


def relabel(df: DataFrame, annotated: DataFrame, key: str) -> DataFrame:
    """Rows with the labels that annotation (key, added, minimum, requires_review) adds, and whether they
    changed or need review. Writing the three outputs is three filters of this."""
    x = df.join(annotated, key, "left")
    old = F.col("labels")
    added = F.coalesce("added", F.array().cast("array<string>"))
    new = exclusive(F.array_union(old, added))
    harmful = F.size(F.array_except(old, F.array(F.lit("SAFE")))) > 0
    return x.withColumns({
        "new_labels": new,
        "changed": F.array_sort(new) != F.array_sort(old),
        "review": F.coalesce("requires_review", F.lit(False)) & harmful,
        "severity": F.greatest(F.col("severity"), F.coalesce("minimum", F.lit(0))),
    })


def rule_misses(rows: DataFrame, annotated: DataFrame, key: str, labels: str = "label_names") -> DataFrame:
    """How many rows lack a label that annotation (key, added) finds."""
    missing = F.array_except(F.coalesce("added", F.array().cast("array<string>")), F.col(labels))
    return rows.join(annotated.select(key, "added"), key, "left").agg(F.count("*").alias("n_rows"), F.count_if(F.size(missing) > 0).alias("n_misses"))


def family_rows(rows: DataFrame, annotated: DataFrame, key: str, upstream: str, required: str, text_key: str, prefix: str, fraction: float = 0.1, seed: str = SEED) -> DataFrame:
    """Of the rows with upstream 1, what becomes of each: outcome skipped_without_family or review_not_targeted, or
    written, with a record id, the labels of the annotation (key, topics, added, minimum) and a split."""
    x = rows.where(F.col(upstream) == 1).join(annotated, key)
    outcome = F.when(~F.array_contains("topics", "family"), "skipped_without_family").when(~F.array_contains("added", required), "review_not_targeted").otherwise("written")
    names = decode_mask(encode_mask(F.col("added")))
    x = x.withColumn("outcome", outcome)
    kept = F.col("outcome") == "written"
    return x.withColumns({
        "record_id": F.when(kept, F.concat(F.lit(prefix), F.col(key).cast("string"))),
        "label_names": F.when(kept, names),
        "split": F.when(kept, split_of(F.col(text_key), fraction, seed)),
    })


def profanity_rows(lines: DataFrame, key, fraction: float = 0.1, seed: str = SEED) -> DataFrame:
    """(id, text, label_names, primary_label, severity, split) of JSON lines (line, value) of curated rows: labels in
    schema order, ids from the numbers of the lines, which don't depend on how the file is split. Blank lines are
    skipped and counted; bad JSON is an error."""
    schema = "text string, label_names array<string>, severity int, _bad string"
    x = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.length(F.trim("value")) > 0)
    x = x.select("line", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.raise_error(F.concat(F.lit("bad JSON in line "), F.col("line").cast("string")))
    text = F.when(F.col("r._bad").isNotNull(), bad.cast("string")).otherwise(F.col("r.text"))
    x = x.select(F.concat(F.lit("profanity_"), F.col("line").cast("string")).alias("id"), text.alias("text"), F.col("r.label_names").alias("labels"), F.col("r.severity").alias("severity"))
    x = x.withColumn("added", F.array().cast("array<string>")).withColumn("minimum", F.lit(0))
    out = normalized_row(x, "labels", "added", "severity", "minimum").withColumn("split", split_of(key(F.col("text")), fraction, seed))
    return out.select("id", "text", "label_names", "primary_label", "severity", "split")


def check_audit(errors: DataFrame, counts: DataFrame, minimum: dict[tuple[str, str], int]) -> None:
    """Raise unless structural_errors found none and counts (label, split, n) reach the minimum of each
    (label, split). Both are a few rows."""
    row = errors.first()
    wrong = {k: v for k, v in row.asDict().items() if k != "n_rows" and v}
    if wrong:
        raise ValueError(f"the dataset is not clean: {wrong}")
    have = {(r["label"], r["split"]): r["n"] for r in counts.collect()}
    short = {k: (have.get(k, 0), v) for k, v in minimum.items() if have.get(k, 0) < v}
    if short:
        raise ValueError(f"too few rows (have, need): {short}")


def completed(sources: list[tuple[str, DataFrame]], minimum: dict[tuple[str, str], int], publish) -> DataFrame:
    """Gap completion: sources, the relabelled dataset first, are merged by key and split; publish(rows) writes them
    and returns what it wrote, which is audited and must reach the minimum rows by (label, split). Returns it."""
    rows = merged_split(merge(sources)).withColumn("label_names", decode_mask(F.col("mask")))
    rows = rows.withColumns({"vector": one_hot(F.col("label_names")), "primary_label": primary_label(F.col("label_names"))})
    rows = rows.withColumn("severity", F.when(F.col("label_names") == F.array(F.lit("SAFE")), 0).otherwise(F.col("severity")))
    written = publish(rows)
    counts = written.select("split", F.explode("label_names").alias("label")).groupBy("label", "split").agg(F.count("*").alias("n"))
    check_audit(structural_errors(written, "vector", "label_names", "primary_label", "severity"), counts, minimum)
    return written


#: What a moderator says about a message.
FEEDBACK = (
    "message_id string, labels array<string>, primary_label string, scam_subtype string, severity int, recommended_action string, moderator_id string, feedback_type string,"
    " is_false_positive boolean, is_false_negative boolean, needs_context boolean, annotator_confidence double, source string, notes string"
)


def enriched(decisions: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """Decisions (key, labels, primary_label, severity, action) with what feedback says instead, field by field; an
    empty list of labels says nothing."""
    f = feedback.select(key, *[F.col(c).alias(f"_{c}") for c in ("labels", "primary_label", "severity", "recommended_action", "feedback_type")])
    x = decisions.join(f, key, "left")
    said = F.when(F.size("_labels") > 0, F.col("_labels"))
    return x.withColumns({
        "labels": F.coalesce(said, F.col("labels")),
        "primary_label": F.coalesce("_primary_label", "primary_label"),
        "severity": F.coalesce("_severity", "severity"),
        "action": F.coalesce("_recommended_action", "action"),
        "feedback_type": F.col("_feedback_type"),
    }).drop(*[f"_{c}" for c in ("labels", "primary_label", "severity", "recommended_action", "feedback_type")])


def training_rows(examples: DataFrame) -> DataFrame:
    """The fifteen columns that training reads, of enriched examples."""
    x = examples.withColumn("_names", F.coalesce("labels", F.array().cast("array<string>")))
    x = x.withColumn("_primary", primary_label(F.when(F.size("_names") > 0, F.col("_names")).otherwise(F.array("primary_label"))))
    return x.select(
        "event_id", "message_id", F.col("model_text").alias("text"), one_hot(F.col("_names")).alias("labels"), F.col("_names").alias("label_names"), F.col("_primary").alias("primary_label"), "severity", "source", "risk_score",
        F.col("action").alias("decision_action"), "feedback_type", "policy_version", "features", "rule_matches", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def dry_run(rows: DataFrame, order: list[str], n: int = 64) -> DataFrame:
    """The first rows in an order, to try a training run with."""
    return rows.orderBy(*order).limit(n)
