"""A linear-chain conditional random field over words: shape, neighbour and file features.

Tags: O outside, B begin and I inside a secret. Each word has one value of each feature template; a
word's score for a tag is the sum of its values' weights, and neighbouring tags add a transition
weight. Weights come from maximum likelihood (forward-backward sums, Adam) on a bounded, seeded corpus
of made-up lines, so training needs no data and gives equal weights each time.

Decoding is exact Viterbi, but skips what can't matter: a word whose score for O leads by more than
all that transitions can give back is O in the best sequence, and cuts it.
"""

from __future__ import annotations

import base64
import random
import string
from functools import lru_cache

import numpy as np

from gavelflow.llm import textbytes as tb

O, B, I = 0, 1, 2  # noqa: E741
TRAIN_LINES = 1500
SEED = 17

KEYWORDS = (
    "password passwd pwd pass secret token key apikey api_key api-key access_key secret_key private_key"
    " credential credentials auth authorization bearer client_secret passphrase pin"
).split()
LINKS = "= : := => == is ist est es ->".split()

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other bytes, 1 lower, 2 upper, 3 digit, 4 punctuation
for _b in range(33, 127):
    _c = chr(_b)
    _CLASS[_b] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_WORD = (_CLASS > 0) & (_CLASS < 4)
_WORD[128:] = True
_SEED = 51


def _hash_words(words: list[str]) -> np.ndarray:
    """The hashes of words; equal to those of equal bytes in a text."""
    out = []
    for w in words:
        data = np.frombuffer(w.encode(), dtype=np.uint8)
        out.append(tb.byte_ranges(data, np.array([0]), np.array([len(data)]), _SEED)[0])
    return np.sort(np.array(out, dtype=np.uint64))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


#: Feature templates and the number of values of each.
TEMPLATES = {"shape": 64, "size": 12, "changes": 10, "hex": 4, "inner": 8, "before": 16, "after": 4, "two": 64, "file": 48}


class Lines:
    """Features of the words of a slice of texts; core_start and core_end leave out what surrounds the
    letters and digits of a word, such as quotes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        w = tb.Words(data, offs)
        self.words, n = w, len(w.starts)
        s, e = w.starts, w.ends
        self.n = n
        if not n:
            return
        data = w.data
        kind = _CLASS[data]
        total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        counts = []
        for k in range(5):
            t = total(kind == k)
            counts.append(t[e] - t[s])
        other, lower, upper, digit, punct = counts
        size = e - s
        wordy = _WORD[data]
        after_word = np.flatnonzero(wordy)
        lo = np.searchsorted(after_word, s)
        hi = np.searchsorted(after_word, e)
        has = hi > lo
        self.core_start, self.core_end = s.copy(), e.copy()
        self.core_start[has] = after_word[lo[has]]
        self.core_end[has] = after_word[hi[has] - 1] + 1
        change = np.zeros(len(data), dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        tc = total(change)
        changes = tc[self.core_end] - tc[np.minimum(self.core_start + 1, self.core_end)]
        th = total(_HEX[data])
        inner = self.core_end - self.core_start
        hexes = (th[self.core_end] - th[self.core_start]) == inner
        links = total((data == 61) | (data == 58))
        link_in = links[self.core_end] > links[self.core_start]
        link_end = links[e] > links[np.maximum(self.core_end, s)]
        slash = total((data == 47) | (data == 64) | (data == 46) | (data == 45))
        marks = slash[self.core_end] - slash[self.core_start]
        low = tb._LOWER[data]
        core = tb.byte_ranges(low, self.core_start, self.core_end, _SEED)
        whole = tb.byte_ranges(low, s, e, _SEED)
        key = _among(core, _hash_words(KEYWORDS))
        link = _among(whole, _hash_words(LINKS))

        first = np.zeros(n, dtype=bool)
        first[w.offs[:-1][np.diff(w.offs) > 0]] = True
        last = np.concatenate([first[1:], [True]])

        def shift(x: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros_like(x)
            if by > 0:
                out[by:] = x[:-by]
                for k in range(by):
                    at = np.flatnonzero(first) + k
                    out[at[at < n]] = 0
            else:
                out[:-1] = x[1:]
                out[last] = 0
            return out

        dense = np.minimum((4 * digit) // np.maximum(size, 1), 3)
        shape = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (other > 0) + 16 * dense
        sizes = np.minimum(np.searchsorted([4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64], inner, side="right"), 11)
        before_key, before_link = shift(key, 1), shift(link, 1)
        two_key = shift(key, 2)
        ends_link = shift(key & link_end, 1)
        before = before_key + 2 * before_link + 4 * two_key + 8 * ends_link
        strong = (digit > 0) & (inner >= 8)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(w.offs))
        length = np.maximum(np.diff(w.offs), 1)
        rate = lambda x: np.minimum((20 * np.bincount(doc, x, len(offs) - 1) / length).astype(np.int64), 3)[doc]
        files = rate(strong) + 4 * rate(link | link_in)
        self.features = np.stack([
            shape,
            sizes,
            np.minimum(changes, 9),
            hexes + 2 * (inner >= 16),
            link_in + 2 * np.minimum(marks, 3),
            before,
            key + 2 * link,
            np.minimum(before, 7) * 8 + np.minimum(changes, 3) + 4 * (inner >= 8),
            np.minimum(files, 15) * 3 + strong + (strong & (changes > 3)),
        ]).astype(np.int64)
        sizes_of = np.array([*TEMPLATES.values()])
        self.features += (np.cumsum(sizes_of) - sizes_of)[:, None]


N_WEIGHTS = sum(TEMPLATES.values())


class Crf:
    """Weights of the feature values by tag, and of tag after tag."""

    def __init__(self, emit: np.ndarray, trans: np.ndarray):
        self.emit, self.trans = emit, trans
        #: all that the transitions at both sides of a word can differ by
        self.swing = 2 * float(trans.max() - trans.min())

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = self.emit[features[0]].copy()
        for f in features[1:]:
            out += self.emit[f]
        return out

    def viterbi(self, score: np.ndarray, left: bool, right: bool) -> list[int]:
        """The best tags of a stretch; left and right say whether an O stands there."""
        t = self.trans
        best = score[0] + (t[O] if left else 0)
        back = []
        for row in score[1:]:
            step = best[:, None] + t
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        if right:
            best = best + t[:, O]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def decode(self, features: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The tags of all words; offs has the first word of each text."""
        n = features.shape[1]
        tags = np.zeros(n, dtype=np.int8)
        score = self.scores(features)
        open_ = score[:, O] - score[:, 1:].max(axis=1) <= self.swing
        at = np.flatnonzero(open_)
        if not len(at):
            return tags
        starts = np.zeros(n + 1, dtype=bool)
        starts[offs] = True
        cut = np.concatenate([[True], (at[1:] != at[:-1] + 1) | starts[at[1:]]])
        first = np.flatnonzero(cut)
        end = np.append(first[1:], len(at))
        lo, hi = at[first], at[end - 1] + 1
        left, right = ~starts[lo], ~starts[hi]
        single = hi - lo == 1
        one = score[lo[single]] + np.where(left[single][:, None], self.trans[O], 0) + np.where(right[single][:, None], self.trans[:, O], 0)
        tags[lo[single]] = one.argmax(axis=1)
        for a, b, x, y in zip(lo[~single].tolist(), hi[~single].tolist(), left[~single].tolist(), right[~single].tolist(), strict=True):
            tags[a:b] = self.viterbi(score[a:b], x, y)
        return tags


def _made_up(r: random.Random) -> list[tuple[str, int]]:
    """A line of (word, tag)."""
    letters = string.ascii_lowercase + "éèöüñß"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 12)))
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    alnum = string.ascii_letters + string.digits

    def plain() -> str:
        w = word()
        w = r.choice([w, w, w, w.capitalize(), w.upper() if r.random() < 0.2 else w, w + r.choice(",.;:!?"), w + "-" + word()])
        rare = r.random()
        if rare < 0.03:
            return r.choice([str(r.randint(0, 99999)), f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"+{r.randint(1, 99)}", f"({r.randint(100, 999)})", f"555-{r.randint(1000, 9999)}", ".".join(str(r.randint(0, 255)) for _ in range(4))])
        if rare < 0.05:
            return r.choice([f"{word()}.{r.randint(1, 99)}@{word()}.example.com", f"https://{word()}.org/{word()}/{r.randint(1, 999)}?q={word()}", f"{word()}_{word()}", f"{word().capitalize()}{word().capitalize()}", f"v{r.randint(1, 9)}.{r.randint(0, 99)}", "%%%", "***", "|", f"{word()}/{word()}", f"({word()})", f"{word()}%%%", f"{word()}###"])
        return w

    def secret() -> str:
        return r.choice([
            some("0123456789abcdef", 32, 64), some(alnum, 16, 44), some(alnum + "-_", 20, 40), "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16),
            base64.b64encode(bytes(r.randrange(256) for _ in range(r.randint(15, 40)))).decode(), some(alnum + "!@#$%^&", 9, 18), r.choice(["sk-", "ghp_", "xoxb-", "pk_live_"]) + some(alnum, 20, 40),
            f"{word().capitalize()}{r.randint(10, 9999)}{r.choice('!@#$%')}{some(alnum, 2, 6)}",
        ])

    line = [(plain(), O) for _ in range(r.randint(2, 14))]
    kind = r.random()
    if kind < 0.6:
        quote = r.choice(["", '"', "'", "`"])
        key = r.choice(KEYWORDS)
        key = r.choice([key, key.upper(), key.capitalize(), f'"{key}"'])
        value = f"{quote}{secret()}{quote}{r.choice(['', '', ',', ';', '.'])}"
        line += r.choice([
            [(key, O), (r.choice(LINKS), O), (value, B)],
            [(key + r.choice([":", "="]), O), (value, B)],
            [(r.choice(["Bearer", "bearer", "Basic"]), O), (value, B)],
            [(key, O), (value, B)],
            [(value, B)],
        ])
        if r.random() < 0.1:  # keys that are written in groups
            line[-1:] = [(some(string.ascii_uppercase + string.digits, 5, 8), B if i == 0 else I) for i in range(r.randint(2, 5))]
    elif kind < 0.75:  # keywords without a secret
        line += [(r.choice(KEYWORDS), O), (r.choice([*LINKS, plain()]), O), (plain(), O)]
    line += [(plain(), O) for _ in range(r.randint(0, 12))]
    return line


def features_of(texts: list[str]) -> Lines:
    raw = "".join(texts).encode()
    sizes = [len(t.encode()) for t in texts]
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return Lines(np.frombuffer(raw, dtype=np.uint8), offs)


@lru_cache(1)
def trained(lines: int = TRAIN_LINES, steps: int = 150, seed: int = SEED) -> Crf:
    """Maximum likelihood with a small quadratic penalty."""
    r = random.Random(seed)
    data = [_made_up(r) for _ in range(lines)]
    found = features_of([" ".join(w for w, _ in line) for line in data])
    offs = found.words.offs
    n, most = len(data), int(np.diff(offs).max())
    feats = np.zeros((len(TEMPLATES), n, most), dtype=np.int64)
    gold = np.zeros((n, most), dtype=np.int64)
    mask = np.arange(most) < np.diff(offs)[:, None]
    feats[:, mask] = found.features
    gold[mask] = [t for line in data for _, t in line]
    emit, trans = np.zeros((N_WEIGHTS, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(trans), np.zeros_like(trans)]
    hot = np.eye(3)[gold] * mask[..., None]
    pair = mask[:, 1:]
    gold_trans = np.zeros((3, 3))
    np.add.at(gold_trans, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        score = emit[feats].sum(axis=0) * mask[..., None]
        alpha = np.zeros((n, most, 3))
        beta = np.zeros((n, most, 3))
        alpha[:, 0] = score[:, 0]
        for t in range(1, most):
            new = lse(alpha[:, t - 1, :, None] + trans, 1) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            new = lse(trans + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        both = alpha[:, :-1, :, None] + trans + (score + beta)[:, 1:, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(both, 0)) * pair[..., None, None]).sum(axis=(0, 1))
        g_emit = np.zeros_like(emit)
        diff = (p - hot)[mask]
        for f in feats:
            for k in range(3):
                g_emit[:, k] += np.bincount(f[mask], diff[:, k], N_WEIGHTS)
        grads = [g_emit / n + 1e-4 * emit, (expected - gold_trans) / n + 1e-2 * trans]
        for i, (w, g) in enumerate(zip((emit, trans), grads, strict=True)):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(np.round(emit, 4), np.round(trans, 4))
