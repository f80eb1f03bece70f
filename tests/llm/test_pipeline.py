import hashlib
import random
import re

import pytest

from gavelflow.llm import mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEY = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"


def corpus():
    r = random.Random(7)
    vocab = {"en": "the and of that with this have from they which there".split(), "fr": "le la les des une dans pour avec est que sur".split()}
    rows = []
    for d in range(120):
        lang = r.choice(["en", "fr"])
        w = [r.choice(vocab[lang]) + r.choice(["", "s", "x"]) for _ in range(r.randint(20, 60))]
        if d % 10 == 0:
            w.insert(5, f'token = "{KEY}"')
        rows.append((d, " ".join(w), lang, r.choice(["a", "b", "c"])))
    rows += [(200 + i, rows[i][1] + " tail", rows[i][2], "a") for i in range(0, 20, 2)]  # near copies
    rows += [(300, None, "en", "a"), (301, "12 !", "en", "a"), (302, rows[3][1], "en", "b"), (None, rows[4][1], "en", "b"), (7, rows[7][1], "en", "b")]
    return rows


def test_stages(spark, make_docs):
    rows = corpus()
    folder = make_docs(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "source_mix", "token_ids"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "token_ids":
            assert docs.columns == names
    ids = lambda n: sorted((x.doc_id for x in seen[n].select("doc_id").collect()), key=str)
    assert set(ids("language_id")) == {d for d, *_ in rows} - {300, 301}
    assert set(ids("near_duplicates")) == set(range(120)) and len(ids("near_duplicates")) == 120
    texts = {x.doc_id: x.text for x in seen["secret_scan"].collect()}
    assert set(texts) == set(range(120))
    for d, t, *_ in rows[:120]:
        assert texts[d] == re.sub(rf'token = "{KEY}', "[SECRET]", t)
    want, got = {}, {}
    for x in mixing.mix(seen["secret_scan"]).collect():
        if x.taken:
            want[x.doc_id] = x.taken
    for x in seen["source_mix"].collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + len(WORD.findall(x.text))
    assert got == want
    decoded = sorted(x.decoded_sha256 for x in seen["token_ids"].collect())
    assert decoded == sorted(hashlib.sha256(x.text.encode()).hexdigest() for x in seen["source_mix"].collect())
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_near_duplicates_go_by_row(spark, make_docs):
    r = random.Random(11)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = lambda t: t + " tail"
    rows = [(3, a), (7, near(a)), (7, b), (None, near(b)), (None, c), (None, d), (None, near(d)), (9, e), (9, near(e)), (9, f), (9, f), (None, "!"), (None, "")]
    docs = spark.read.parquet(make_docs([(i, t, "en", "s") for i, t in rows]) + "/documents.parquet")
    got = sorted(((x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    groups = [[(3, a)], [(7, b)], [(None, c)], [(None, d), (None, near(d))], [(9, e), (9, near(e))], [(9, f)], [(None, "!")], [(None, "")]]
    assert [sum(x in g for x in got) for g in groups] == [1] * 8 and len(got) == 8


def test_empty_table(spark, make_docs):
    assert corpus_pipeline.run(spark, make_docs([])).collect() == []
