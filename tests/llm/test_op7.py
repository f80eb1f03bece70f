import hashlib
import random
from collections import Counter

import pytest

from gavelflow.llm import suffix_dedup
from gavelflow.llm.common import KeyFilter
from gavelflow.llm.suffix_dedup import WINDOW, dedup, op7_suffix_dedup


def brute(rows, size=WINDOW):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + size] for _, b in raw for i in range(len(b) - size + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    text = lambda k: "".join(r.choice("abcdé fgh\n") for _ in range(k))
    shared = [text(k) for k in (180, 205, 260, 700)]
    rows = []
    for d in range(40):
        parts = [text(r.randint(0, 300)) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(1, r.choice(shared))
        rows.append((d, "".join(parts)))
    cycle = text(37)
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, " " * 3000), (104, "ab" * 99), (104, "ab" * 101), (105, cycle * 6), (106, text(90) + cycle * 8 + text(50)), (None, rows[2][1]), (107, rows[5][1] + "é" * 150), (108, rows[9][1]), (108, rows[9][1])]
    return rows


def test_matches_brute_force(spark, make_docs):
    rows = corpus()
    got = op7_suffix_dedup(spark, make_docs([(d, t, "en", "s") for d, t in rows])).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(rows)


@pytest.mark.parametrize("max_group", [1, 4096])
def test_anchors_of_many_segments(spark, make_docs, max_group):
    r = random.Random(2)
    shared = "".join(r.choice("xyz ") for _ in range(60))
    rows = [(d, "".join(r.choice("pqr") for _ in range(20)) + shared + r.choice("ab") * 5 + shared[:30]) for d in range(30)]
    docs = spark.read.parquet(make_docs([(d, t, "en", "s") for d, t in rows]) + "/documents.parquet")
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in dedup(docs, 50, max_group).collect()]
    assert sorted(got, key=str) == brute(rows, 50)


def test_empty_table(spark, make_docs):
    assert op7_suffix_dedup(spark, make_docs([])).collect() == []
    assert suffix_dedup.WINDOW == 200


def test_full_filters_change_nothing(spark, make_docs, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(KeyFilter, "MAX_BITS", 64)
    got = op7_suffix_dedup(spark, make_docs([(d, t, "en", "s") for d, t in rows])).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(rows)
