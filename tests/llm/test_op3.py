import random
import re

import pytest

from gavelflow.llm import jaccard_join
from gavelflow.llm.common import KeyFilter
from gavelflow.llm.jaccard_join import op3_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"W{i}é" for i in range(300)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    common = text(60)
    bases = [text(r.choice([7, 30, 80])) for _ in range(6)] + [common + text(10)]
    rows = []
    for d in range(n):
        w = list(r.choice(bases)) if r.random() < 0.8 else text(r.randint(1, 60))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w = w[: len(w) - r.randint(0, len(w) // 3)]
        t = " ".join(w)
        rows.append((d + 5, t.upper() if r.random() < 0.1 else t))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "b a"), (None, rows[0][1]), (None, "solo words"), (3, rows[7][1]), (3, "x y z"), (3, "x y z"), (1006, "w " * 4000)]
    return rows


@pytest.mark.parametrize(("seed", "light", "block"), [(1, 32, 512), (2, 2, 4), (3, 3, 2)])
def test_matches_brute_force(spark, make_docs, monkeypatch, seed, light, block):
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(seed)
    got = op3_jaccard_join(spark, make_docs([(d, t, "en", "s") for d, t in rows])).collect()
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in got], key=str) == brute(rows)


@pytest.mark.parametrize(("light", "block"), [(32, 512), (2, 4)])
def test_every_link_is_counted(spark, make_docs, monkeypatch, light, block):
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(4)
    base = [f"k{i}" for i in range(60)]
    rows += [(2000 + i, " ".join([*base, f"v{i}"])) for i in range(50)]  # near variants, no identical copy
    got = op3_jaccard_join(spark, make_docs([(d, t, "en", "s") for d, t in rows])).collect()
    sets = [shingles(t) for _, t in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    want = [(d, sum(linked(sets[i], s) for j, s in enumerate(sets) if j != i)) for i, (d, _) in enumerate(rows)]
    assert sorted([(x.doc_id, x.n_links) for x in got], key=str) == sorted(want, key=str)
    assert {(x.same_set, x.n_links) for x in got if (x.doc_id or 0) >= 2000} == {(0, 49)}


def test_empty_table(spark, make_docs):
    assert op3_jaccard_join(spark, make_docs([])).collect() == []


@pytest.mark.parametrize("n", [512, 2048])
def test_long_words_of_patterns_that_polynomials_confuse(spark, make_docs, n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, f"{a} {b} {a} {b} {a} {b}"), (4, f"{b} {a} {b} {a} {b} {a}"), (5, f"{a} {b} {a} {b} {a} {b}")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in op3_jaccard_join(spark, make_docs([(d, t, "en", "s") for d, t in rows])).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3)}


def test_full_filters_change_nothing(spark, make_docs, monkeypatch):
    r = random.Random(3)
    rows = [(d, " ".join(f"w{r.randrange(30)}" for _ in range(12)), "en", "s") for d in range(40)]
    rows += [(100 + d, rows[d][1] + " tail", "en", "s") for d in range(20)]
    folder = make_docs(rows)
    want = sorted(map(tuple, op3_jaccard_join(spark, folder).collect()))
    monkeypatch.setattr(KeyFilter, "MAX_BITS", 64)
    assert sorted(map(tuple, op3_jaccard_join(spark, folder).collect())) == want


def test_passages_of_many_documents_make_no_group(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIGHT", 4)
    grouped, tiles = [], jaccard_join._tiles
    monkeypatch.setattr(jaccard_join, "_tiles", lambda rows, stage: grouped.append(rows.count()) or tiles(rows, stage))
    passages = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(3)]
    own = lambda d, a, b: " ".join(f"d{d}x{i}" for i in range(a, b))
    rows = [(d, f"{own(d, 0, 40)} {passages[d % 3]} {own(d, 40, 90)} {passages[(d + d // 3) % 3]}") for d in range(60)]
    rows += [(100 + d, rows[d][1] + " tail") for d in range(5)]
    got = op3_jaccard_join(spark, make_docs([(d, t, "en", "s") for d, t in rows])).collect()
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in got], key=str) == brute(rows)
    assert grouped == [0]
