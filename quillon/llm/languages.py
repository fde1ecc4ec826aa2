"""Languages of prose by character n-grams, fitted on labelled texts."""

from __future__ import annotations

import re

import numpy as np

TABLE = 1 << 16  # hashed n-grams
LONGEST = 4
SMOOTHING = 0.5
LEAST_LETTERS = 12  # of a text whose language is told
#: How much better, in nats for each n-gram and in all, one language must describe a text than another.
MARGIN, TOTAL = 0.22, 14.0

NOT_LETTERS = re.compile(r"[\W\d_]+")
# First and last characters of scripts, by blocks of the Unicode standard.
SCRIPTS = {
    "latin": "AZazÀɏḀỿ", "greek": "ͰϿ", "cyrillic": "Ѐԯ", "hebrew": "֐׿", "arabic": "؀ۿ", "devanagari": "ऀॿ", "thai": "฀๿", "kana": "぀ヿ", "han": "㐀䶿一鿿", "hangul": "가힣",
}
# Scripts that stand for one language.
SCRIPT_LANGUAGES = {"kana": "ja", "hangul": "ko", "greek": "el", "han": "zh", "arabic": "ar", "devanagari": "hi"}
_SCRIPTS = {k: re.compile("[" + "".join(f"{v[j]}-{v[j + 1]}" for j in range(0, len(v), 2)) + "]") for k, v in SCRIPTS.items()}


def script(text: str) -> str | None:
    """The script of most letters; kana beside ideographs count as kana. None without enough letters."""
    if text.isascii():
        return "latin" if len(_SCRIPTS["latin"].findall(text)) >= LEAST_LETTERS else None
    n = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
    if n["kana"] * 5 >= n["han"]:
        n["kana"] += n.pop("han")
    best = max(n, key=n.get)
    return best if n[best] >= (6 if best in ("han", "kana", "hangul") else LEAST_LETTERS) and 2 * n[best] > sum(n.values()) else None


def grams(text: str) -> np.ndarray:
    """Hashes below TABLE of the n-grams of 1 to LONGEST characters; whatever isn't a letter is a blank."""
    c = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, LONGEST + 1):
        h = (h[: len(c) - n + 1] * np.uint64(1_000_003) + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        out.append(h >> np.uint64(48))
        if len(c) <= n:
            break
    return np.concatenate(out).astype(np.int64)


class Languages:
    """Log-probabilities of n-grams for each label."""

    def __init__(self, labels: list[str], table: np.ndarray):
        self.labels, self.table = labels, table

    @classmethod
    def fit(cls, labelled: list[tuple[str, list[str]]], least: int = 500) -> Languages:
        """From (label, passages). Labels of fewer than `least` n-grams are left out. Texts that the first fit gives to
        another label than theirs are left out of the second: some labels are wrong."""
        texts = [(k, grams(" ".join(p))) for k, p in labelled if k]

        def once(rows) -> Languages:
            n: dict[str, np.ndarray] = {}
            for k, g in rows:
                n[k] = n.get(k, 0) + np.bincount(g, minlength=TABLE)
            labels = sorted(k for k, c in n.items() if c.sum() >= least)
            table = [np.log((n[k] + SMOOTHING) / (n[k].sum() + SMOOTHING * TABLE)) for k in labels]
            return cls(labels, np.array(table, np.float32).T.copy() if labels else np.zeros((TABLE, 0), np.float32))

        first = once(texts)
        if len(first.labels) < 2:
            return first
        return once([(k, g) for k, g in texts if k not in first.labels or first.labels[int(first.table[g].mean(axis=0).argmax())] == k])

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        """Mean log-probability of the text's n-grams under each label, and their number."""
        g = grams(text)
        return self.table[g].mean(axis=0), len(g)


def label(model: Languages, text: str, of: str) -> str:
    """The language of a text in the script `of`: the script's own, or the model's, or the script's name."""
    return SCRIPT_LANGUAGES.get(of) or (model.labels[int(model.scores(text)[0].argmax())] if model.labels else of)


def differ(model: Languages, text: str, asked: str) -> tuple[str, str] | None:
    """(label of text, label of asked) if the two are in different languages, else None. A language that the model
    doesn't have is told from others by being much nearer to some other label, or by its script."""
    a, b = script(text), script(asked)
    if a is None or b is None:
        return None
    if a != b:
        return label(model, text, a), label(model, asked, b)
    if len(model.labels) < 2:
        return None
    x, n = model.scores(text)
    y, m = model.scores(asked)
    i, j = int(x.argmax()), int(y.argmax())
    near, far = x[i] - x[j], y[j] - y[i]
    if i == j or min(near, far) < MARGIN or near * n < TOTAL or far * m < TOTAL:
        return None
    return model.labels[i], model.labels[j]
