import random
import re

import duckdb

from gavelflow.llm import quality
from gavelflow.llm.quality import op5_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed)


def corpus():
    r = random.Random(6)
    rows = []
    for d in range(260):
        w = [r.choice(["den", "été", "of", "a", "ж", "x" * r.randint(1, 9)]) + r.choice(["", "", str(r.randrange(999))]) for _ in range(r.randint(0, 60))]
        if r.random() < 0.1:
            w = [x + "%%%***" for x in w]
        if r.random() < 0.1:
            w += w[:8]
        seps = [r.choice([" ", " ", "\n", " \n ", "\t"]) for _ in w]
        rows.append((d, "".join(a + b for a, b in zip(w, seps)), r.choice(["en", "de", None]), r.choice(["s", "s", "t", None])))
    line = "the same line here\n"
    return rows + [(900, None, "en", "s"), (901, "", "en", "s"), (902, line * 5, "en", "s"), (903, "a " * 4000, "xx", "only"), (None, " \u000b\f\r x", "en", "s"), (904, "one two\n\n one two\n#\n#", "en", "s"), (904, "one two\n\n one two\n#\n#", "en", "s")]


def test_counts_and_verdicts(spark, make_docs):
    rows = corpus()
    folder = make_docs(rows)
    got = op5_quality_rules(spark, folder).collect()
    base = sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got), key=str)
    assert base == sorted(((d, *brute(t)) for d, t, _, _ in rows), key=str)
    assert not any(x.kept and x.base_failed for x in got)
    heavy = {x.doc_id for x in got if x.n_symbols > x.word_chars / 2 and not x.base_failed}
    assert heavy and not any(x.kept for x in got if x.doc_id in heavy)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.execute(quality.ORACLE_SQL).fetchall(), key=str) == sorted([tuple(x) for x in got], key=str)


def test_empty_table(spark, make_docs):
    assert op5_quality_rules(spark, make_docs([])).collect() == []


def test_a_groups_own_distribution_decides(spark, make_docs):
    """The same text, with a tenth of its characters symbols, fails among prose and stays among listings of code."""
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(r.randrange(999)) for _ in range(n))
    code = lambda n: " ".join("if<a>|b&" + str(r.randrange(9999)) for _ in range(n))
    mixed = prose(36) + "".join(f" {x}{x}{i}" for i, x in enumerate("&|#$*<>&|#$*<>"))
    rows = [(d, prose(30), "en", "news") for d in range(100)] + [(200 + d, code(30), "en", "code") for d in range(100)]
    rows += [(500, mixed, "en", "news"), (501, mixed, "en", "code"), (502, mixed, "en", "rare")]
    kept = {x.doc_id: (x.kept, x.failed_ratios) for x in op5_quality_rules(spark, make_docs(rows)).collect()}
    assert kept[500] == (False, "symbol_ratio") and kept[501] == (True, "")
    # a small group goes by its language's sketch, in which half the documents are code
    assert kept[502] == (True, "")
    for part in (range(100), range(200, 300)):
        assert sum(kept[d][0] for d in part) >= 94
