"""Readers and writers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CURATED = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("labels", T.ArrayType(T.DoubleType())), T.StructField("label_names", T.ArrayType(T.StringType())),
    T.StructField("primary_label", T.StringType()), T.StructField("severity", T.IntegerType()), T.StructField("id", T.StringType()),
])
MESSAGE = T.StructType([
    T.StructField("platform", T.StringType()), T.StructField("guild_id", T.StringType()), T.StructField("channel_id", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("message_id", T.StringType()), T.StructField("raw_text", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("author_created_at", T.TimestampType()), T.StructField("member_joined_at", T.TimestampType()), T.StructField("mention_count", T.IntegerType()),
    T.StructField("role_mention_count", T.IntegerType()), T.StructField("channel_mention_count", T.IntegerType()), T.StructField("recent_messages", T.ArrayType(T.StringType())),
    T.StructField("recent_message_timestamps", T.ArrayType(T.TimestampType())), T.StructField("metadata", T.StringType()),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CURATED, strict: bool = True) -> DataFrame:
    """JSON lines with a fixed schema. Lines end at line feeds only, a byte order mark and blank lines are
    skipped, and a bad line fails the read, or, if not strict, goes to the column _bad."""
    lines = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r$", "")
    lines = lines.select(value.alias("value"), F.col("_metadata.file_path").alias("file")).where(F.length(F.trim("value")) > 0)
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "file")
    if not strict:
        return lines.select("r.*")
    said = F.raise_error(F.concat(F.lit("bad JSON in "), "file", F.lit(": "), F.substring("r._bad", 1, 200)))
    # the check is part of a column, as a filter could be left out of the plan
    names = [f.name for f in schema.fields]
    return lines.select(F.when(F.col("r._bad").isNotNull(), said.cast(full)).otherwise(F.col("r")).alias("r")).select(*[f"r.{n}" for n in names])


def read_corpus(spark: SparkSession, path: str, kind: str, columns: list[str], schema: str | None = None) -> DataFrame:
    """An external corpus (parquet, csv, jsonl, orc; compressed or not), only the columns asked for."""
    r = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return r.option("header", True).option("multiLine", False).csv(path).select(*columns)
    return getattr(r, {"jsonl": "json"}.get(kind, kind))(path).select(*columns)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Known hashes (sha256, phash) from one JSON document."""
    return spark.read.schema("hashes array<struct<sha256:string,phash:string>>").option("multiLine", True).json(path).select(F.explode("hashes").alias("h")).select("h.*")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows: path, length, content and its SHA-256."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).withColumn("sha256", F.sha2("content", 256))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def publish(df: DataFrame, path: str, check=None, backup: bool = False) -> int:
    """Write, check and only then put in place. check gets what was written and raises to stop it. Returns the
    number of rows. The old rows stay until the new ones are in place, or, with backup, for good, at a path that
    ends in their checksum. Between two renames the path is missing for an instant; publish_tables has no such gap."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{x}-{uuid.uuid4().hex}") for x in ("new", "old"))
    df.write.parquet(new.toString())
    written = spark.read.schema(df.schema).parquet(new.toString())
    n = written.count()
    try:
        if check is not None:
            check(written)
    except BaseException:
        fs.delete(new, True)
        raise
    had = fs.exists(target)
    if had and backup:
        held = spark.read.parquet(path)
        old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.backup-{held.agg(digest(held)).first()[0]}")
        fs.delete(old, True)
    if had and not fs.rename(target, old):
        raise OSError(f"can't set {path} aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"can't put {path} in place")
    if had and not backup:
        fs.delete(old, True)
    return n


def publish_tables(tables: dict[str, DataFrame], root: str) -> str:
    """Several tables at once: each is written to a folder of its own, and one manifest that names them all is
    renamed into place, so readers see all of the new rows or none. Returns the version."""
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm
    fs_path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{p}")
    fs = fs_path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    version = f"{len(_versions(fs, fs_path('manifests'))):012d}-{uuid.uuid4().hex}"
    paths = {}
    for name, df in tables.items():
        paths[name] = fs_path(f"data/{name}/{version}").toString()
        df.write.parquet(paths[name])
    draft = fs_path(f"drafts/{version}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(paths).encode()))
    out.close()
    fs.mkdirs(fs_path("manifests"))
    if not fs.rename(draft, fs_path(f"manifests/{version}")):
        raise OSError(f"can't publish {root}")
    return version


def _versions(fs, folder) -> list[str]:
    return sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last version that was published."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/manifests")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = _versions(fs, folder)[-1]
    paths = json.loads(spark.read.text(f"{folder.toString()}/{last}", wholetext=True).first()[0])
    return {name: spark.read.parquet(p) for name, p in paths.items()}


def append_log(rows: DataFrame, path: str, key: str = "log_id") -> None:
    """Append rows to a log, each key once, so that a batch that is delivered again adds nothing."""
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = rows.dropDuplicates([key])
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        new = new.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti").select(rows.columns)
    new.write.mode("append").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, by: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, properties: dict[str, str] | None = None) -> DataFrame:
    """A table, or a query in brackets with a name, of a database whose driver is on the class path; filters and
    columns are pushed down. by: a numeric column by whose ranges executors read in parallel."""
    if by is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    lo, hi = bounds or (0, 1 << 31)
    return spark.read.jdbc(url, table, column=by, lowerBound=lo, upperBound=hi, numPartitions=parts, properties=properties or {})


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers, from 1 on, however files are split: each
    split's lines are counted, and its numbers start where the one before ends."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    splits = lines.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(splits.drop("n"), ["file", "at"]).select("file", (F.col("m") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def parse_yaml(text: str) -> dict:
    """A YAML document of plain types; a key that occurs twice in a mapping is an error, as is any other kind
    of document than a mapping."""
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader: Strict, node: yaml.MappingNode) -> dict:
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            if key in out:
                raise ValueError(f"duplicate key {key!r} in line {k.start_mark.line + 1}")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    found = yaml.load(text, Loader=Strict)  # noqa: S506
    if not isinstance(found, dict):
        raise ValueError("the document is no mapping")
    return found


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A small YAML file from any store that Spark reads."""
    return parse_yaml(spark.read.text(path, wholetext=True).first()[0])


def write_report(report: DataFrame, path: str) -> None:
    """A small report (one row) as one JSON line."""
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    spark = report.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray((json.dumps(rows[0].asDict(True), default=str, ensure_ascii=False) + "\n").encode()))
    out.close()


def digest(df: DataFrame) -> Column:
    """A checksum of rows that doesn't depend on their order: to be aggregated over them. Sums and parities of two
    64-bit hashes, so no task holds more than a few numbers."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    one, two = F.xxhash64(row), F.xxhash64(row, F.lit(1))
    parts = [F.count("*"), F.sum(one.cast("decimal(38,0)")), F.sum(two.cast("decimal(38,0)")), F.bit_xor(one), F.bit_xor(two)]
    return F.sha2(F.concat_ws(",", *[p.cast("string") for p in parts]), 256)


# What a message may hold.
MOST_TEXT, MOST_RECENT, MOST_METADATA = 8000, 20, 16384


def checked(messages: DataFrame) -> DataFrame:
    """Adds errors, the names of what is wrong with a message; good rows have none. A filter on it splits
    rows to work on from those to set aside."""
    counts = [c for c in ("mention_count", "role_mention_count", "channel_mention_count") if c in messages.columns]
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    has = messages.columns
    tests = [(F.length("raw_text") > MOST_TEXT, "text_too_long"), (F.col("raw_text").isNull(), "text_missing")]
    tests += [(blank(c), f"{c}_missing") for c in ("channel_id", "user_id", "message_id") if c in has]
    tests += [(~F.col(c).rlike(r"^[A-Za-z0-9_.:-]{1,128}$"), f"{c}_malformed") for c in ("channel_id", "user_id", "message_id") if c in has]
    tests += [(F.col(c) < 0, f"{c}_negative") for c in counts]
    if "recent_messages" in has:
        tests += [(F.size("recent_messages") > MOST_RECENT, "too_many_recent"), (F.exists("recent_messages", lambda x: F.length(x) > 1000), "recent_too_long")]
    if "metadata" in has:
        tests.append((F.octet_length("metadata") > MOST_METADATA, "metadata_too_large"))
    return messages.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in tests])))
