"""Queries of media requests, feedback, training rows, benchmarks and streams. Imported by queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from gavelflow.functions import redact as R
from gavelflow.operators import calibrate as C
from gavelflow.operators import curate as D
from gavelflow.operators import history as H
from gavelflow.operators import media as M
from gavelflow.operators import policy as P
from gavelflow.operators import rules as E
from gavelflow.plans import queries as Q
from gavelflow.plans.queries import joined, query, table
from gavelflow.streaming import stream as ST


def _scratch(spark) -> str:
    """A folder for a stream's sink and checkpoint, in the shared one where there is one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='gavelflow-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


# -- media requests --------------------------------------------------------------------------------


@query("""with i as (select l_orderkey as k, count(*) as n, count(distinct l_partkey % 50) as ids from lineitem group by 1)
select o_orderkey as k, concat_ws(',', case when ids < n then 'duplicate_attachment_id' end, case when o_orderstatus = 'P' then 'flag_not_set' end, case when o_orderkey % 7 + 1 <> coalesce(n, 0) then 'count_mismatch' end) as errors
from orders left join i on k = o_orderkey""")
def attachment_checks(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + 1).alias("declared"), (F.col("o_orderstatus") != "P").alias("flag"))
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("id"))
    return M.attachment_errors(r, a, "k", "id", "declared", "flag").select("k", joined("errors").alias("errors"))


@query("select o_orderkey as k, o_orderstatus as status, l_linenumber as nr, l_partkey as part from orders join lineitem on l_orderkey = o_orderkey where l_linenumber <= 2")
def event_attachments(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("nr"), F.col("l_partkey").alias("part"))
    return M.attachments_of(e, a, "k", F.col("nr") <= 2)


@query("""with f as (select l_orderkey as k, l_returnflag as label, min(l_linenumber) as o from lineitem group by all) select k, string_agg(label, ',' order by o, label) as labels from f group by k""")
def attachment_labels(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("o"))
    return M.labels_by_attachment(s, "k", "o").select("k", joined("labels").alias("labels"))


@query("""with w as (select conv_id, role || '_' || coalesce(length(text), 0) % 12 as w, min(turn) as o from conversations group by all), r as (select *, row_number() over (partition by conv_id order by o) as rn from w)
select conv_id, string_agg(w, ',' order by o) as warnings from r where rn <= 8 group by conv_id""")
def response_warnings(spark, sf):
    c = table(spark, sf, "conversations").withColumn("w", F.concat("role", F.lit("_"), (F.coalesce(F.length("text"), F.lit(0)) % 12).cast("string")))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "w"))).alias("l"))
    return g.select("conv_id", joined(M.warnings(F.transform("l", lambda x: x["w"]))).alias("warnings"))


@query("""with s as (select vec_id, [abs(embedding[1]), abs(embedding[2]), abs(embedding[3])]::double[] as s, abs(embedding[4])::double as o from embeddings)
select vec_id, ['a', 'b', 'c'][list_position(s, list_max(s))] as cls, round(list_max(s) * o, 9) as confidence from s""")
def best_class(spark, sf):
    at = lambda i: F.abs(F.get("embedding", F.lit(i))).cast("double")
    x = table(spark, sf, "embeddings").select("vec_id", M.best_class(F.array(at(0), at(1), at(2)), ["a", "b", "c"], at(3)).alias("b"))
    return x.select("vec_id", "b.cls", F.round("b.confidence", 9).alias("confidence"))


@query("""with k as (select distinct sha256(text) as h from documents join labels using (doc_id) where toxic = 1) select doc_id, 'SCAM' as label, 'image.known_sha256' as rule_id from documents where sha256(text) in (select h from k)""")
def known_hash_signals(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("digest"))
    known = d.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id").select(F.col("digest").alias("sha256"))
    return M.known_signals(M.known_matches(d, "doc_id", "digest", known), "doc_id").select("doc_id", "label", "rule_id")


@query(f"""with {Q._SIGNALS}, o as (select doc_id, round({Q._hex(13, 2)} / 255.0::double, 4) as c from documents)
select doc_id, 'OCR' as source, label, confidence, rule_id from rule_signals
union all select doc_id, 'OCR', label, least(confidence, c), 'ocr.' || lower(label) from models join o using (doc_id) where source = 'RUBERT' and label <> 'SAFE'""")
def ocr_signals(spark, sf):
    rules = E.to_signals(E.emit(Q.features(spark, sf), Q.LOW), "doc_id", Q.LOW).select("doc_id", "source", "label", "confidence", "rule_id")
    scores = Q.model_signals(spark, sf).where("source = 'RUBERT'").select("doc_id", "source", "label", "confidence", "rule_id")
    ocr = table(spark, sf, "documents", "doc_id").withColumn("ocr_confidence", F.round(Q._digits(13, 2) / 255, 4))
    return M.ocr_signals(rules, scores, ocr, "doc_id").select("doc_id", "source", "label", "confidence", "rule_id")


# -- feedback and training rows --------------------------------------------------------------------

_EXAMPLES = """e as (select d.doc_id, case when toxic = 1 then ['TOXIC'] when quality = 0 then ['SPAM', 'URL'] else ['SAFE'] end as names, case when toxic = 1 then 'TOXIC' when quality = 0 then 'URL' else 'SAFE' end as prim,
  coalesce(case when toxic = 1 then 3 end, doc_id % 3)::int as severity, case when toxic = 1 then 'REVIEW' else 'IGNORE' end as action, case when toxic = 1 then 'CONFIRMED' end as feedback from documents d left join labels using (doc_id))"""


def _examples(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    lab = table(spark, sf, "labels")
    safe = F.array(F.lit("SAFE"))
    decisions = d.join(lab, "doc_id", "left").select(
        "doc_id", "text", "source", F.when(F.col("quality") == 0, F.array(F.lit("SPAM"), F.lit("URL"))).otherwise(safe).alias("labels"),
        F.when(F.col("quality") == 0, "URL").otherwise("SAFE").alias("primary_label"), (F.col("doc_id") % 3).cast("int").alias("severity"), F.lit("IGNORE").alias("action"))
    toxic = F.col("toxic") == 1
    feedback = lab.select("doc_id", F.when(toxic, F.array(F.lit("TOXIC"))).otherwise(F.array().cast("array<string>")).alias("labels"), F.when(toxic, "TOXIC").alias("primary_label"), F.when(toxic, 3).alias("severity"), F.when(toxic, "REVIEW").alias("recommended_action"), F.when(toxic, "CONFIRMED").alias("feedback_type"))
    return D.enriched(decisions, feedback, "doc_id")


@query(f"with {_EXAMPLES} select doc_id, array_to_string(names, ',') as labels, prim as primary_label, severity, action, feedback as feedback_type from e")
def enriched_feedback(spark, sf):
    return _examples(spark, sf).select("doc_id", joined("labels").alias("labels"), "primary_label", "severity", "action", "feedback_type")


_ONE_HOT = "array_to_string(list_transform(" + str(list(P.LABELS)) + ", lambda x: case when contains(names, x) then '1' else '0' end), '')"


@query(f"""with {_EXAMPLES} select doc_id as event_id, 'm' || doc_id as message_id, sha256(coalesce(text, '')) as text_sha256, {_ONE_HOT} as labels, array_to_string(names, ',') as label_names,
  list_filter({list(P.PRIORITY)}, lambda x: contains(names, x))[1] as primary_label, severity, source, (doc_id % 100)::double as risk_score, action as decision_action, feedback as feedback_type, '1' as policy_version,
  '{{"n":' || doc_id % 5 || '}}' as features, '' as rule_matches, strftime(timestamp '2024-01-01 00:00:00' + interval (doc_id) second, '%Y-%m-%dT%H:%M:%S') as created_at from e join documents using (doc_id)""")
def training_rows(spark, sf):
    x = _examples(spark, sf).withColumns({
        "event_id": F.col("doc_id"), "message_id": F.concat(F.lit("m"), F.col("doc_id").cast("string")), "model_text": F.coalesce("text", F.lit("")), "risk_score": (F.col("doc_id") % 100).cast("double"), "policy_version": F.lit("1"),
        "features": F.to_json(F.struct((F.col("doc_id") % 5).alias("n"))), "rule_matches": F.array().cast("array<string>"), "created_at": F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")),
    })
    bits = F.array_join(F.transform("labels", lambda v: v.cast("int").cast("string")), "")
    x = D.training_rows(x).withColumn("text_sha256", F.sha2("text", 256)).drop("text")
    return x.withColumns({"labels": bits, "label_names": joined("label_names"), "rule_matches": joined("rule_matches")})


@query("""with a as (select doc_id, toxic, doc_id % 4 as k from labels) select count(*)::bigint as n_rows, count(*) filter (k = 0 or (k = 1 and toxic = 0))::bigint as n_misses from a""")
def rule_misses(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.array(F.lit("TOXIC"))).otherwise(F.array(F.lit("SAFE"))).alias("label_names"))
    k = F.col("doc_id") % 4
    ann = rows.where("doc_id % 4 < 2").select("doc_id", F.when(k == 0, F.array(F.lit("THREAT"), F.lit("TOXIC"))).otherwise(F.array(F.lit("TOXIC"))).alias("added"))
    return D.rule_misses(rows, ann, "doc_id")


@query(f"""with d as (select doc_id, {Q._KEY} as k, {Q._hex(3)} as a, {Q._hex(4)} as b from documents join labels using (doc_id) where toxic = 1),
o as (select *, case when a < 6 then 'skipped_without_family' when b < 8 then 'review_not_targeted' else 'written' end as outcome from d)
select doc_id, outcome, case when outcome = 'written' then 'family_' || doc_id end as record_id, case when outcome = 'written' then 'TOXIC,THREAT' end as labels,
  case when outcome = 'written' then case when {Q._BUCKET} < 1000 then 'validation' else 'train' end end as split from o""")
def family_rows(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").join(table(spark, sf, "labels"), "doc_id").withColumn("k", Q.text_key())
    topics = F.when(Q._digits(3) < 6, F.array(F.lit("race"))).otherwise(F.array(F.lit("family")))
    added = F.when(Q._digits(4) < 8, F.array(F.lit("THREAT"))).otherwise(F.array(F.lit("THREAT"), F.lit("TOXIC")))
    ann = d.select("doc_id", topics.alias("topics"), added.alias("added"))
    x = D.family_rows(d, ann, "doc_id", "toxic", "TOXIC", "k", "family_")
    return x.select("doc_id", "outcome", "record_id", F.when(F.col("label_names").isNotNull(), joined("label_names")).alias("labels"), "split")


@query(f"""with {Q._MERGED}, named as (select *, {Q._DECODE} as names from merged) select case when splits & 2 <> 0 then 'validation' else 'train' end as split, list_filter({list(P.PRIORITY)}, lambda x: contains(names, x))[1] as primary_label, count(*)::bigint as n, sum(case when names = ['SAFE'] then 0 else severity end)::bigint as severity from named group by all""")
def completed_dataset(spark, sf):
    """Merge, split, write, audit and minimums, as one run."""

    def publish(rows):
        path = f"{_scratch(spark)}/rows"
        rows.write.parquet(path)
        return spark.read.parquet(path)

    x = D.completed(Q._curated(spark, sf), {("SAFE", "train"): 1}, publish)
    return x.groupBy("split", "primary_label").agg(F.count("*").alias("n"), F.sum("severity").alias("severity"))


@query("select doc_id, lang from documents order by lang nulls first, doc_id limit 64")
def dry_run_head(spark, sf):
    return D.dry_run(table(spark, sf, "documents", "doc_id", "lang"), ["lang", "doc_id"])


@query("select source, doc_id, row_number() over (partition by source order by lpad(doc_id::varchar, 12, '0')) as nr from documents")
def sequential_ids(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source").withColumn("o", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return D.numbered(d, "source", "o", "nr").select("source", "doc_id", "nr")


@query("""select event_id, '{"event_type":"' || event_type || '"}' as kept from events""")
def metadata_allowed(spark, sf):
    m = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", R.metadata_allowed(m).alias("kept"))


# -- benchmarks, rates and responses ---------------------------------------------------------------


@query("""with r as (select event_type, user_id % 7 as run, avg(value) as mean, max(value) as top from events group by all) select event_type, round(median(mean), 6) as mean, round(median(top), 6) as top from r group by event_type""")
def median_of_runs(spark, sf):
    r = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 7).alias("run")).agg(F.avg("value").alias("mean"), F.max("value").alias("top"))
    return C.median_runs(r, ["event_type"], ["mean", "top"]).select("event_type", F.round("mean", 6).alias("mean"), F.round("top", 6).alias("top"))


_LAST = """with w as (select event_id, user_id, ts, event_type, list({'at': ts, 'x': event_type}) over (partition by user_id order by ts, event_id rows between 20 preceding and 1 preceding) as past from events),
n as (select event_id, user_id, """ + ", ".join(f"len(list_filter(coalesce(past, []), lambda p: ts - p.at <= interval {s} seconds))::bigint as {k}" for k, s in (("messages_10s", 10), ("messages_60s", 60), ("messages_10m", 600))) + """,
  len(list_filter(coalesce(past, []), lambda p: ts - p.at <= interval 600 seconds and p.x = event_type))::bigint as repeated_10m from w)"""


@query(f"""{_LAST}, f as (select event_id, 'preprocessing.flood.messages_10s' as rule_id, 18.0::double as w, 0.82::double as c from n where messages_10s >= 1
  union all select event_id, 'preprocessing.flood.messages_60s', 24.0, 0.86 from n where messages_60s >= 1 union all select event_id, 'preprocessing.flood.repeated_messages_10m', 22.0, 0.78 from n where repeated_10m >= 1)
select rule_id, 'FLOOD' as label, count(*)::bigint as n, round(sum(c), 4) as confidence from f group by all""")
def flood_rules(spark, sf):
    """Rates joined to messages, and the rules that they set off."""
    policy = P.Policy().with_rules(flood__messages_10s={"threshold": 1}, flood__messages_60s={"threshold": 1}, flood__repeated_messages_10m={"threshold": 1})
    m = H.recent_rates(table(spark, sf, "events", "event_id", "user_id", "ts", "event_type"), "event_type")
    s = E.confident(E.to_signals(E.emit(m, policy), "event_id", policy), policy)
    return s.groupBy("rule_id", "label").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def _streamed(spark, sf, make):
    """A stream over the events, run to its end, and what its sink holds then."""
    schema = table(spark, sf, "events").schema
    events = ST.read_events(spark, f"{sf}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    at = _scratch(spark)
    run = make(events).writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/rows")


@query(f"""{_LAST} select user_id, count(*)::bigint as n, sum(messages_10s)::bigint as messages_10s, sum(messages_60s)::bigint as messages_60s, sum(messages_10m)::bigint as messages_10m, sum(repeated_10m)::bigint as repeated_10m from n group by user_id""")
def stream_flood(spark, sf):
    x = _streamed(spark, sf, lambda e: ST.flood_rates(e, "user_id", "ts", "event_type"))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("messages_10s", "messages_60s", "messages_10m", "repeated_10m")])


@query()
def stream_rate_limit(spark, sf):
    x = _streamed(spark, sf, lambda e: ST.limit_rate(e, "user_id", "ts", limit=2, window=36_000))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


@query(f"""with {Q._decision_sql("ACTIVE")} select doc_id::varchar as correlation_id, doc_id::varchar as message_id, labels, primary_label, rule_ids as rule_matches, round(risk_score, 4) as risk_score, round(confidence, 6) as confidence, action as decision_action, severity,
  reason, 'default' as policy_id, '1' as policy_version, 'DRY_RUN' as execution_status, array_to_string(plan, ',') as execution_plan, 0 as dataset_event_id, 0 as latency_ms, '' as warnings,
  coalesce(t.labels_t, '') as rubert_labels, coalesce(t.top_t, '') as rubert_top_labels, coalesce(t.scores_t, '{{}}') as rubert_scores, coalesce(t.least_t, '{{}}') as rubert_thresholds, coalesce(b.b, '') as risk_breakdown
from decided left join (select doc_id, string_agg(label, ',') as labels_t, string_agg(label, ',') as top_t, '{{"' || any_value(label) || '":' || any_value(confidence) || '}}' as scores_t, '{{"' || any_value(label) || '":0.5}}' as least_t from signals where source = 'RUBERT' group by doc_id) t using (doc_id)
left join (select doc_id, string_agg(source || ':' || label, ',' order by pos, rule_id, label) as b from signals group by doc_id) b using (doc_id)""")
def response_full(spark, sf):
    """The response's 22 columns, lists cut to what it may hold."""
    s = Q.all_signals(spark, sf)
    x = Q.decided(spark, sf)
    one = s.where("source = 'RUBERT'").groupBy("doc_id").agg(F.collect_list("label").alias("l"), F.first("label").alias("k"), F.first("confidence").alias("c"))
    every = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "rule_id", "label", "source"))).alias("e"))
    x = x.join(one, "doc_id", "left").join(every, "doc_id", "left")
    some = lambda c, n: joined(F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, n))
    scores = lambda v: F.coalesce(F.concat(F.lit('{"'), "k", F.lit('":'), v.cast("string"), F.lit("}")), F.lit("{}"))
    return x.select(
        F.col("doc_id").cast("string").alias("correlation_id"), F.col("doc_id").cast("string").alias("message_id"), some("labels", 14).alias("labels"), "primary_label", some("rule_ids", 32).alias("rule_matches"),
        some("l", 14).alias("rubert_labels"), scores(F.col("c")).alias("rubert_scores"), scores(F.lit("0.5")).alias("rubert_thresholds"), some("l", 5).alias("rubert_top_labels"),
        F.round("risk_score", 4).alias("risk_score"), F.round("confidence", 6).alias("confidence"),
        joined(F.slice(F.transform(F.coalesce(F.col("e"), F.array().cast("array<struct<pos:int,rule_id:string,label:string,source:string>>")), lambda z: F.concat(z["source"], F.lit(":"), z["label"])), 1, 32)).alias("risk_breakdown"),
        F.col("action").alias("decision_action"), F.col("severity").cast("int").alias("severity"), F.substring("reason", 1, 256).alias("reason"), F.lit("default").alias("policy_id"), F.lit("1").alias("policy_version"),
        F.lit("DRY_RUN").alias("execution_status"), some("plan", 8).alias("execution_plan"), F.lit(0).alias("dataset_event_id"), F.lit(0).alias("latency_ms"), F.lit("").alias("warnings"),
    )


