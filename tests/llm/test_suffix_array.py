import random

import numpy as np
import pytest

from gavelflow.llm import suffix_array as module
from gavelflow.llm.suffix_array import permuted_lcp, repeated, suffix_array


def cases():
    r = random.Random(3)
    yield b"mississippi"
    yield b"a" * 50
    yield b"ab" * 30 + b"a"
    yield b"z"
    yield bytes(range(40))[::-1]
    for _ in range(60):
        yield bytes(r.randrange(r.choice([1, 2, 3, 200])) for _ in range(r.randint(2, 300)))


@pytest.mark.parametrize("text", list(cases()))
def test_suffix_array_is_sorted(text):
    t = np.frombuffer(text, dtype=np.uint8)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array(t).tolist() == want
    for size in (3, 8):
        starts = [text[i : i + size] for i in range(len(text) - size + 1)]
        assert np.flatnonzero(repeated(t + np.uint8(1), size)).tolist() == [i for i, x in enumerate(starts) if starts.count(x) > 1]


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("text", [*cases(), b"x" * 900 + b"y", b"the cat sat on the mat " * 40])
def test_permuted_common_prefixes(text):
    t = np.frombuffer(text, dtype=np.uint8)
    sa = suffix_array(t)
    phi, lcp = permuted_lcp(t, sa)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        assert phi[b] == a and lcp[b] == common(text[a:], text[b:])
    assert phi[sa[0]] == -1 and lcp[sa[0]] == 0


def test_entries_and_buckets_agree(monkeypatch):
    """Both scans, and a text whose names repeat over several levels."""
    a, b = b"a", b"ab"
    for _ in range(18):
        a, b = b, b + a
    r = random.Random(5)
    for text in (b[:4000], b"x" * 3000 + b"y", bytes(r.choice(b"ab") for _ in range(3000)), b"the cat sat on the mat " * 60):
        t = np.frombuffer(text, dtype=np.uint8)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        for symbols in (0, 10**9):
            monkeypatch.setattr(module, "SYMBOLS", symbols)
            monkeypatch.setattr(module, "RUN", 10**9)
            assert suffix_array(t).tolist() == want


def test_names_are_induced_by_distance(monkeypatch):
    """Many names, runs of them, and stretches that rise and fall and repeat; entries are scanned only beyond WORK."""
    r = random.Random(6)
    words = [bytes(r.choice(b"abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = b" ".join(r.choice(words) for _ in range(2500)) + b"".join(w * 5 for w in words[:20])
    rising = [*range(600), 7, 7, 7, *range(600, 0, -1), *range(600), *([9] * 50)]
    scanned = []
    real = module._induce_entries
    monkeypatch.setattr(module, "_induce_entries", lambda *a: scanned.append(1) or real(*a))
    for t in (np.frombuffer(text, dtype=np.uint8), np.array(rising), np.array([r.randrange(600) for _ in range(3000)])):
        want = sorted(range(len(t)), key=lambda i: t.tolist()[i:])
        monkeypatch.setattr(module, "WORK", 10**9, raising=False)
        assert suffix_array(t).tolist() == want and not scanned
        monkeypatch.setattr(module, "WORK", 0)
        assert suffix_array(t).tolist() == want and scanned
        scanned.clear()
