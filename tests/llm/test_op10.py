import random
import zlib

import numpy as np

from gavelflow.llm import langid
from gavelflow.llm.langid import Model, grams, op10_language_id, profile

WORDS = {
    "en": "the and of that with this have from they which would there their about were other into".split(),
    "fr": "le la les des une dans pour avec est que sur être été aux très où après entre".split(),
    "ru": "и в не на что он как это она по но они мы из которые быть для".split(),
}


def corpus():
    r = random.Random(3)
    rows = []
    for d in range(240):
        lang = r.choice(list(WORDS))
        rows.append((d, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(15, 80))), lang if d % 9 else None, "s"))
    return rows + [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 34 !?", "en", "s"), (None, "the and that", "en", "s"), (5, rows[5][1], "en", "s"), (903, "word " * 20000, "en", "s"), (904, "été", None, "s")]


def test_held_out_accuracy_and_edges(spark, make_docs):
    rows = corpus()
    got = op10_language_id(spark, make_docs(rows)).collect()
    assert len(got) == len(rows)
    truth = {d: lang for d, _, lang, _ in rows[:240] if d != 5}
    by = {x.doc_id: x for x in got}
    for d in range(240):
        assert by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
    out = [d for d in truth if by[d].held_out and truth[d]]
    assert len(out) > 20 and sum(by[d].lang_pred == truth[d] for d in out) >= 0.95 * len(out)
    assert [(by[d].lang_pred, by[d].score) for d in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "en" and not by[None].held_out
    assert all(0 <= x.score <= 1 and x.lang_pred in (*WORDS, "und") for x in got)


def test_distance_is_out_of_place():
    text = "abc abd"
    p = profile(text)
    assert len(p) == len(set(grams(text).tolist()))
    langs = {"x": p.tolist(), "y": p.tolist()[::-1]}
    d = Model(langs, 300).distances(text)
    n = len(p)
    assert d[0] == 0 and np.isclose(d[1], sum(abs(i - (n - 1 - i)) for i in range(n)) / (n * 300))


def test_nothing_to_learn(spark, make_docs):
    assert op10_language_id(spark, make_docs([])).collect() == []
    got = op10_language_id(spark, make_docs([(1, "some text", None, "s")])).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)


def test_many_languages(spark, make_docs, monkeypatch):
    """More languages than are broadcast: all are learned, by the other join."""
    r = random.Random(8)
    words = {f"l{i}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 6))) for _ in range(25)] for i in range(60)}
    rows = [(d, " ".join(r.choice(words[f"l{d % 60}"]) for _ in range(40)), f"l{d % 60}", "s") for d in range(480)]
    folder = make_docs(rows)
    want = sorted(map(tuple, op10_language_id(spark, folder).collect()))
    monkeypatch.setattr(langid, "BROADCAST_LANGS", 10)
    got = op10_language_id(spark, folder).collect()
    assert sorted(map(tuple, got)) == want
    held = [x for x in got if x.held_out]
    assert sum(x.lang_pred == f"l{x.doc_id % 60}" for x in held) >= 0.95 * len(held) and len({x.lang_pred for x in got}) == 60
