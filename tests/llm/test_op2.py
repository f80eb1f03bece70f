import random
import re

import duckdb
import pytest

from gavelflow.llm import mixing
from gavelflow.llm.mixing import apportion, mix, mixed_documents, op2_source_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """sizes: {source: words}; water filling by steps."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * sizes[s] <= unit * weight[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def corpus(n=400):
    r = random.Random(9)
    rows = []
    for d in range(n):
        s = "hot" if r.random() < 0.4 else r.choice(["a", "b", "é", "Z", "tiny", None])
        k = r.randint(0, 3) if s == "tiny" else r.randint(0, 200)
        rows.append((d, " ".join(f"w{r.randrange(99)}" for _ in range(k)), "en", s))
    return rows + [(5, None, "en", "a"), (None, "x y z", "en", "b"), (7, "same row", "en", "a"), (7, "same row", "en", "a"), (9, "", "en", "void"), (10, "long " * 5000, "en", "Z")]


def test_targets_quotas_and_rerun(spark, make_docs):
    rows = corpus()
    folder = make_docs(rows)
    got = op2_source_mixing(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, op2_source_mixing(spark, folder).collect()))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    by_size = {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        by_size.setdefault((x.source_size, round(x.target, 6)), 0)
        by_size[(x.source_size, round(x.target, 6))] += x.taken
    assert {k for k in by_size} == {(sizes[s], round(t, 6)) for s, t in want.items()}
    for (_, t), taken in by_size.items():
        assert abs(taken - t) <= 1


def test_oracle_sql_gives_the_same_rows(spark, make_docs):
    folder = make_docs(corpus())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    key = lambda x: (str(x[0]), x[1], x[2], round(x[3], 6), x[4])
    want = sorted(map(key, con.execute(mixing.ORACLE_SQL).fetchall()))
    assert sorted(key(tuple(x)) for x in op2_source_mixing(spark, folder).collect()) == want


def test_apportion_is_highest_quotients(spark):
    r = random.Random(1)
    rows = []
    for g in range(12):
        seats = r.choice([0, 1, 7, 100, 1000])
        rows += [(g, p, r.choice([0, 1, 5, 40, 1000, 7777]), seats) for p in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "g long, p long, v long, seats long")
    got = {(x.g, x.p): x.quota for x in apportion(df, ["g"], ["p"], "v", "seats").collect()}
    for g in range(12):
        mine = [x for x in rows if x[0] == g]
        q = sorted((-v / (2 * s + 1), p) for _, p, v, n in mine for s in range(n) if v)[: mine[0][3]]
        assert [got[g, p] for _, p, _, _ in mine] == [sum(x[1] == p for x in q) for _, p, _, _ in mine]


def test_mixed_documents_have_the_words_taken(spark, make_docs):
    folder = make_docs(corpus())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    taken, words = {}, {}
    for x in mix(docs).collect():
        taken[x.doc_id] = taken.get(x.doc_id, 0) + x.taken
    for x in out.collect():
        assert x.n_chars == len(x.text)
        words[x.doc_id] = words.get(x.doc_id, 0) + len(WORD.findall(x.text))
    assert words == {d: n for d, n in taken.items() if n}


@pytest.mark.parametrize("n, words, other", [(200, 1, 100000), (200, 1, 700), (100, 3, 100000), (7, 1, 5), (3, 40, 1)])
def test_small_sources_reach_their_targets(spark, make_docs, n, words, other):
    rows = [(d, "w " * words, "en", "a") for d in range(n)] + [(1000 + d, "v " * (other // 10 + 1), "en", "b") for d in range(10)]
    folder = make_docs(rows)
    want = brute_targets({"a": n * words, "b": 10 * (other // 10 + 1)})
    got = op2_source_mixing(spark, folder).collect()
    for low, source in ((True, "a"), (False, "b")):
        mine = [x for x in got if (x.doc_id < 1000) == low]
        assert all(0 <= x.taken <= 2 * x.size for x in mine)
        assert abs(sum(x.taken for x in mine) - want[source]) <= 1
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    taken = {x[0]: x[4] for x in con.execute(mixing.ORACLE_SQL).fetchall()}
    assert taken == {x.doc_id: x.taken for x in got}


@pytest.mark.parametrize("rows", [[], [(1, None, "en", None)]])
def test_empty(spark, make_docs, rows):
    folder = make_docs(rows)
    assert [tuple(x) for x in op2_source_mixing(spark, folder).collect()] == [(1, 0, 0, 0.0, 0)][: len(rows)]
    assert mixed_documents(spark.read.parquet(f"{folder}/documents.parquet")).collect() == []
