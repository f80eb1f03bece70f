import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gavelflow.llm import token_counts
from gavelflow.llm.bpe import rank_path, read_ranks
from gavelflow.llm.common import hadoop_path, remove, scratch
from gavelflow.llm.token_counts import Rollup, counted, op1_token_counts, repeats, signed, token_counts_words

ROWS = [
    (1, "a b c", "en", "x"), (2, "a b c", "en", "y"), (3, None, "de", "x"), (4, "", "de", None), (5, "été  là\n", None, "x"),
    (None, "a b c", "en", "x"), (6, "long " * 9000, "en", "x"), (6, "long " * 9000, "en", "x"), (7, "été  là\n", "fr", "x"),
]


def test_query(spark, make_docs):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(rank_path()), special_tokens={})
    want = {}
    for _, t, lang, source in ROWS:
        for v, n in (("words_v1", len((t or "").split())), ("byte_bpe_50k", len(enc.encode_ordinary(t or "")))):
            old = want.get((source, lang, v), (0, 0))
            want[source, lang, v] = (old[0] + 1, old[1] + n)
    folder = make_docs(ROWS)
    got = {(x.source, x.lang, x.tokenizer_version): (x.n_docs, x.n_tokens) for x in op1_token_counts(spark, folder).collect()}
    assert got == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    rows = sorted(con.execute(token_counts.ORACLE_SQL).fetchall(), key=str)
    assert sorted([tuple(x) for x in token_counts_words(spark, folder).collect()], key=str) == rows


def test_deltas_commits_and_compaction(spark):
    frame = lambda rows: spark.createDataFrame(rows, "source string, lang string, tokenizer_version string, n_tokens long")
    path = scratch(spark, "test-rollup")
    rollup = Rollup(spark, path)
    read = lambda: sorted([tuple(x) for x in rollup.totals().collect()], key=str)
    assert read() == []
    one = frame([("a", "en", "v1", 10), ("a", "en", "v1", 5), ("b", None, "v1", 7)])
    assert rollup.apply("b1", signed(None, one))
    assert not rollup.apply("b1", signed(None, one))  # delivered again
    assert read() == [("a", "en", "v1", 2, 15), ("b", None, "v1", 1, 7)]
    # a revised count, a document that changes its tokenizer, and a delete, out of order
    assert rollup.apply("b2", signed(frame([("a", "en", "v1", 10), ("b", None, "v1", 7)]), frame([("a", "en", "v1", 12), ("b", None, "v2", 9)])))
    assert read() == [("a", "en", "v1", 2, 17), ("b", None, "v2", 1, 9)]
    rollup.compact("base")
    assert read() == [("a", "en", "v1", 2, 17), ("b", None, "v2", 1, 9)]
    assert not rollup.apply("b2", signed(None, one))
    # a batch that was written but not committed doesn't count, and its rerun does
    frame([("z", "en", "v1", 1)]).select("source", "lang", "tokenizer_version", F.lit(1).cast("long").alias("n_docs"), "n_tokens").write.parquet(f"{path}/deltas/b3")
    assert len(read()) == 2
    assert rollup.apply("b3", signed(frame([("a", "en", "v1", 17)]), None))
    assert rollup.apply("b4", signed(frame([("a", "en", "v1", 0)]), None))
    assert read() == [("b", None, "v2", 1, 9)]
    assert rollup.committed() == ["b1", "b2", "b3", "b4", "base"]
    rollup.compact("base")  # again: committed, so nothing
    rollup.compact("base2")
    rollup.vacuum()
    fs, folder = hadoop_path(spark, f"{path}/deltas")
    assert len(fs.listStatus(folder)) == 1
    assert read() == [("b", None, "v2", 1, 9)]
    # two writers of one batch, the other first: one counts
    plain, other = rollup._commit, Rollup(spark, path)
    rollup._commit = lambda *x: other.apply("b5", signed(None, frame([("q", "en", "v1", 3)]))) and plain(*x)
    assert not rollup.apply("b5", signed(None, frame([("q", "en", "v1", 4)])))
    assert read() == [("b", None, "v2", 1, 9), ("q", "en", "v1", 1, 3)]
    with pytest.raises(ValueError):
        rollup.apply("../x", signed(None, one))
    remove(spark, path)


def test_empty_table(spark, make_docs):
    assert op1_token_counts(spark, make_docs([])).collect() == []


def test_repeats(spark, make_docs):
    docs = spark.read.parquet(make_docs(ROWS) + "/documents.parquet")
    first, want = {}, {}
    for d, t, *_ in ROWS:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, t, lang, source in ROWS:
        if d is not None and d > first[t or ""]:
            key = (source, lang, len((t or "").split()))
            want[key] = want.get(key, 0) + 1
    got = {(x.source, x.lang, x.n_tokens): x.n for x in repeats(counted(docs, ["words_v1"])).collect()}
    assert got == want
