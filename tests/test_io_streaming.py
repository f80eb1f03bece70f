"""Readers, writers and streams."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gavelflow.sources import io as IO
from gavelflow.streaming import stream as ST


def test_jsonl(spark, tmp_path):
    rows = [{"text": "a b", "label_names": ["SAFE"], "id": 7}, {"text": "x", "id": "s1", "severity": 2}]
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + b"\n".join(json.dumps(r, ensure_ascii=False).encode() for r in rows) + b"\r\n\n  \n")
    got = IO.read_jsonl(spark, f"{tmp_path}/a.jsonl").collect()
    assert [(r.text, r.id, r.severity) for r in got] == [("a b", "7", None), ("x", "s1", 2)]
    (tmp_path / "b.jsonl").write_text('{"text": "ok"}\n{broken\n')
    with pytest.raises(Exception):  # noqa: B017
        IO.read_jsonl(spark, f"{tmp_path}/b.jsonl").collect()
    assert [r._bad is not None for r in IO.read_jsonl(spark, f"{tmp_path}/b.jsonl", strict=False).collect()] == [False, True]


def test_publish_and_formats(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(5).withColumn("s", F.lit("é"))
    assert IO.publish(df, path) == 5

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        IO.publish(df.limit(1), path, refuse)
    assert spark.read.parquet(path).count() == 5
    assert IO.publish(df.limit(2), path) == 2 and spark.read.parquet(path).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    for kind in ("csv", "json", "parquet", "orc"):
        w = df.write.option("header", True)
        getattr(w, kind)(f"{tmp_path}/{kind}")
        assert IO.read_corpus(spark, f"{tmp_path}/{kind}", kind, ["s"]).distinct().collect() == [("é",)]
    IO.write_jsonl(df, f"{tmp_path}/l")
    IO.write_jsonl(df, f"{tmp_path}/l", "append")
    assert spark.read.json(f"{tmp_path}/l").count() == 10
    IO.write_report(df.agg(F.count("*").alias("n")), f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 5}
    a, b = (x.agg(IO.digest(x).alias("d")).first().d for x in (df, df.orderBy(F.desc("id"))))
    assert a == b
    (tmp_path / "reg.json").write_text(json.dumps({"hashes": [{"sha256": "ab", "phash": None}]}))
    assert IO.read_registry(spark, f"{tmp_path}/reg.json").first().sha256 == "ab"
    assert IO.read_files(spark, f"{tmp_path}/reg.json").first().length > 5


def test_message_checks(spark):
    rows = [("c", "u", "m", "hi", 0), ("", "u", "m", "x" * 9000, 0), ("c", "u!", "m", None, -1)]
    df = spark.createDataFrame(rows, "channel_id string, user_id string, message_id string, raw_text string, mention_count int")
    assert [r.errors for r in IO.checked(df).collect()] == [[], ["text_too_long", "channel_id_missing", "channel_id_malformed"], ["text_missing", "user_id_malformed", "mention_count_negative"]]


def events(n=200):
    r, t = random.Random(2), datetime(2024, 1, 1)
    out = []
    for i in range(n):
        t += timedelta(seconds=r.randint(0, 30))
        out.append((i, r.randint(1, 3), t, r.choice("ab")))
    return out


def brute_limit(rows, limit, window):
    logs, out = {}, []
    for _, u, t, _ in rows:
        log = [x for x in logs.get(u, []) if x > t.timestamp() - window]
        ok = len(log) < limit
        logs[u] = [*log, t.timestamp()] if ok else log
        out.append((u, t, ok))
    return sorted(out)


SCHEMA = "event_id long, user_id long, ts timestamp, body string"


def test_limiter_in_batch_and_stream(spark, tmp_path):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_limit(rows, 3, 60)
    assert sorted(map(tuple, ST.limit_rate(df, "user_id", "ts", 3, 60).collect())) == want
    for i in range(2):
        df.where(F.floor(F.col("event_id") / 100) == i).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ST.limit_rate(stream, "user_id", "ts", 3, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("limited").count() == len(rows)


def test_flood_stream(spark, tmp_path):
    rows = events(60)
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ST.read_events(spark, f"{tmp_path}/in", df.schema)
    q = ST.flood_rates(stream, "user_id", "ts", "body").writeStream.format("memory").queryName("flood").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    want = []
    for i, (_, u, t, b) in enumerate(rows):
        past = [(x, y) for _, v, x, y in rows[:i] if v == u][-20:]
        ages = [((t - x).total_seconds(), y) for x, y in past]
        want.append((u, t, *(sum(a <= s for a, _ in ages) for s in (10, 60, 600)), sum(a <= 600 and y == b for a, y in ages)))
    assert sorted(map(tuple, spark.table("flood").collect())) == sorted(want)


def test_batches_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([*events(20), (99, 1, datetime(2024, 1, 1), "x" * 70_000)], SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ST.read_events(spark, f"{tmp_path}/in", df.schema)
    for _ in range(2):  # a restart from the checkpoint adds nothing
        q = ST.run_batches(stream, lambda d: d.select("event_id"), f"{tmp_path}/out", f"{tmp_path}/c", f"{tmp_path}/dead")
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 1
    assert [r.route for r in ST.routed(spark.createDataFrame([("p", 0), ("p", 3)], "payload string, attempts int")).collect()] == ["work", "dead"]


def test_windowed_stream(spark, tmp_path):
    df = spark.createDataFrame(events(50), SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    counts = ST.windowed_counts(ST.read_events(spark, f"{tmp_path}/in", df.schema), "user_id", "ts", late="1 second")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in ST.windowed_counts(df, "user_id", "ts").collect()}
    assert set(map(tuple, spark.table("counts").collect())) <= batch


def test_yaml(spark, tmp_path):
    assert IO.parse_yaml("a: 1\nb: {c: [x, y]}") == {"a": 1, "b": {"c": ["x", "y"]}}
    for bad in ("a: 1\na: 2", "a: {b: 1, b: 2}", "- 1"):
        with pytest.raises(ValueError):
            IO.parse_yaml(bad)
    (tmp_path / "p.yaml").write_text("min_confidence: 0.5")
    from gavelflow.operators import policy as P

    assert P.parse(IO.read_yaml(spark, str(tmp_path / "p.yaml"))).min_confidence == 0.5


def test_tables_are_published_together(spark, tmp_path):
    root = str(tmp_path / "store")
    IO.publish_tables({"a": spark.range(3), "b": spark.range(2)}, root)
    IO.publish_tables({"a": spark.range(5), "b": spark.range(1)}, root)
    got = IO.read_tables(spark, root)
    assert (got["a"].count(), got["b"].count()) == (5, 1)


def test_log_takes_each_key_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "log_id string, x long")
    IO.append_log(rows, path)
    IO.append_log(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_line_numbers_and_curated_lines(spark, tmp_path):
    lines = [f'{{"text": "t{i}", "label_names": ["TOXIC"], "severity": {i % 4}}}' if i % 7 else "" for i in range(400)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        numbered = IO.numbered_lines(spark, str(tmp_path / "x.jsonl"))
        assert numbered.rdd.getNumPartitions() > 1
        assert sorted((r.line, r.value) for r in numbered.collect()) == [(i + 1, x) for i, x in enumerate(lines)]
        from gavelflow.functions import text as T
        from gavelflow.operators import curate as D

        rows = {r.id: r for r in D.profanity_rows(numbered, T.curation_key).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(rows) == {f"profanity_{i + 1}" for i in range(400) if i % 7}
    assert rows["profanity_3"].text == "t2" and rows["profanity_3"].primary_label == "TOXIC"


def test_bad_json_names_its_file(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"text": "x"}\n{oops\n')
    with pytest.raises(Exception, match="bad.jsonl"):
        IO.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_streamed_limits_are_the_batch_ones(spark):
    from gavelflow.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert sorted(map(tuple, QUERIES["stream_rate_limit"](spark, sf).collect())) == sorted(map(tuple, QUERIES["rate_limit"](spark, sf).collect()))
