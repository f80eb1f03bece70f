import hashlib
import random
import re

import pytest

from gavelflow.llm.common import KeyFilter, Stage
from gavelflow.llm.substring_dedup import FingerprintIndex, op8_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=5, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(50)] + ["the", "a"]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [text(k) for k in (13, 14, 20, 40)]
    rows = []
    for d in range(n):
        parts = [text(r.randint(0, 40)) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(1, r.choice(shared))
        rows.append((d * 3 + 1, r.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(500, rows[0][1]), (501, rows[0][1]), (2, None), (4, ""), (5, "a " * 5000), (6, "a " * 30), (7, "  x y"), (8, rows[3][1] + "é"), (None, rows[1][1]), (10, rows[1][1]), (10, rows[1][1])]
    return rows


def test_matches_brute_force(spark, make_docs):
    rows = corpus()
    got = op8_substring_dedup(spark, make_docs([(d, t, "en", "s") for d, t in rows])).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(rows)


def test_empty_table(spark, make_docs):
    assert op8_substring_dedup(spark, make_docs([])).collect() == []


def test_index_runs_and_compaction(spark):
    frame = lambda rows: spark.createDataFrame(rows, "fp long, lo long, hi long")
    with Stage(spark) as stage:
        index = FingerprintIndex(spark, stage, buckets=2, max_runs=2)
        assert index.add(frame([(1, 1, 1), (2, 1, 2)])).collect() == [(2,)]
        assert sorted(index.add(frame([(1, 5, 5), (3, 6, 6)])).collect()) == [(1,)]
        assert len(index.runs) == 2
        assert sorted(index.add(frame([(3, 7, 7), (2, 8, 8), (9, 7, 7)])).collect()) == [(2,), (3,)]
        assert len(index.runs) == 2  # the first two are one run now
        index.drop()


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a[:n], b[:n]


@pytest.mark.parametrize("n", [512, 2048, 8192])
def test_long_words_of_patterns_that_polynomials_confuse(spark, make_docs, n):
    a, b = thue_morse(n)
    tail = [f"t{i}" for i in range(9)]
    rows = [(1, " ".join([a, b] * 3 + tail)), (2, " ".join([b, a] * 3 + tail[:8] + ["x"])), (3, " ".join([a, b] * 3 + tail))]
    got = op8_substring_dedup(spark, make_docs([(d, t, "en", "s") for d, t in rows])).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(rows)


def test_hot_windows_and_full_filters(spark, make_docs, monkeypatch):
    """One passage in a third of all documents, each with other words around it; then with filters of 64 bits."""
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(16))
    rows = [(d, " ".join([f"x{r.randrange(40)}" for _ in range(8)] + ([passage] if d % 3 == 0 else []) + [f"y{r.randrange(40)}" for _ in range(8)])) for d in range(3000)]
    rows += [(5000 + d, rows[0][1]) for d in range(1500)]
    folder, want = make_docs([(d, t, "en", "s") for d, t in rows]), brute(rows)
    assert sorted([tuple(x) for x in op8_substring_dedup(spark, folder).collect()], key=str) == want
    monkeypatch.setattr(KeyFilter, "MAX_BITS", 64)
    assert sorted([tuple(x) for x in op8_substring_dedup(spark, folder).collect()], key=str) == want
