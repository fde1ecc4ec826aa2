"""Text decoded with the wrong encoding: found, and restored where no bytes were lost, by minimum description length.

A chain is a pair of encodings: the text was written in `right` and decoded as `wrong`, so encoding it as `wrong` and
decoding it as `right` restores it; chains apply repeatedly. For every text the passages (sentences or lines) that look
odd are compressed under each candidate chain with a zstandard dictionary per language. A chain is taken if the shortest
result over all languages, plus the chain's own cost, is shorter than that of the text as it stands; otherwise the text
stays unchanged. A chain costs chain_cost bytes, and one where there are few and what they undo is told by its form: UTF-8
in an encoding of Latin letters. What looks odd is what a table of usual character pairs doesn't hold, and what is valid UTF-8 once
encoded as `wrong`; the table only spares the compressor candidates that leave as many odd pairs as there were.

Dictionaries and table are fitted on a bounded sample: `per_text` passages of each of about `per_language` distinct texts
for each of the `languages` most frequent labels; all rarer labels share one more dictionary and sample. Every text is
then judged, whole, with as many chains as are found.

Where bytes are lost (U+FFFD next to a letter or to another of its kind, C1 controls), a chain of its own stands for what
was there: the passage is compressed with each of the usual letters, or each reading of the control, in the place. If
that is shorter, the text is affected; it is restored only as far as other chains go, for the letter itself is a guess.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.samples import SEGMENT, labelled_sample, passages

# The single-byte encodings that texts are read in by mistake, and the multi-byte ones.
SINGLE = ["latin-1", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman"]
MULTI = ["gb18030", "cp950", "cp932", "cp949", "euc-jp"]
# Encodings of further languages, which texts are written in but not read in by mistake.
WRITTEN = ["cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "iso8859-5", "iso8859-7", "iso8859-9", "cp852", "cp855", "koi8-u", "mac-cyrillic"]
LEVEL = 6
DICT_BYTES = 96 << 10
TRAIN_BYTES = 32 << 20  # of passages that one dictionary is trained on, chosen by their hashes
LETTERS = 32  # that may stand for a lost one
ESCAPE = 4  # bytes that a control or lost character costs besides its own: clean text holds none
LOST = re.compile("[^\\W\\d_]�|�[^\\W\\d_]|��|[^\\x00-\\x7f\\s]�|�[^\\x00-\\x7f\\s]")
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")  # no text means these; what shows them was decoded wrongly
CJK = re.compile("[\u2e80-\u9fff\uac00-\ud7ff\uf900-\ufaff]")
CJK_IN_WORD = re.compile("(?<=[A-Za-zÀ-ӿ])[\u2e80-\u9fff\uac00-\ud7ff\uf900-\ufaff]{1,2}|[\u2e80-\u9fff\uac00-\ud7ff\uf900-\ufaff]{1,2}(?=[A-Za-zÀ-ӿ])")


@lru_cache(maxsize=None)
def decoded(codec: str) -> str:
    """The characters of bytes 0..255; bytes without one stand for the control character of that number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=None)
def _upper(codec: str) -> frozenset[str]:
    return frozenset(decoded(codec)[128:])


def _class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


@lru_cache(maxsize=None)
def _utf8(codec: str):
    """Pattern of what valid multi-byte UTF-8 looks like when decoded as codec, and the way back."""
    table = decoded(codec)
    back = {c: b for b, c in reversed(list(enumerate(table)))}
    tail = _class([table[b] for b in range(0x80, 0xC0)])
    two, three, four = (_class([table[b] for b in r]) for r in (range(0xC2, 0xE0), range(0xE0, 0xF0), range(0xF0, 0xF5)))
    pattern = re.compile(f"(?:{two}{tail}|{three}{tail}{{2}}|{four}{tail}{{3}})+")

    def restore(m: re.Match) -> str:
        try:
            return bytes(back[c] for c in m.group()).decode("utf-8")
        except (UnicodeDecodeError, KeyError, ValueError):
            return m.group()

    return pattern, restore


@lru_cache(maxsize=None)
def _table(wrong: str, right: str) -> dict[int, str]:
    """Each character as wrong shows it -> as right shows the same byte."""
    a, b = decoded(wrong), decoded(right)
    return {ord(a[k]): b[k] for k in range(255, 127, -1) if a[k] != b[k]}


@lru_cache(maxsize=None)
def _back(codec: str) -> dict[str, int]:
    """Each character -> the byte that shows it."""
    return {c: b for b, c in enumerate(decoded(codec))}


def _through_bytes(text: str, wrong: str, right: str) -> str | None:
    try:
        raw = text.encode(wrong, "strict")
    except UnicodeEncodeError:
        return None
    out = raw.decode(right, "replace")
    return out if out != text else None


def apply(chain: tuple[str, str], text: str) -> str:
    """The text with the chain undone wherever it can be."""
    wrong, right = chain
    if right == "utf-8" and wrong in SINGLE:
        pattern, restore = _utf8(wrong)
        return pattern.sub(restore, text)
    if wrong in SINGLE and right not in MULTI:
        return text.translate(_table(wrong, right))
    # multi-byte: sentence by sentence, for an encoding that can't hold one sentence may hold the others
    if wrong in SINGLE:
        back, out = _back(wrong), []
        for s in SEGMENT.findall(text):
            try:
                out.append(s if s.isascii() else bytes([back[c] for c in s]).decode(right, "replace"))
            except KeyError:
                out.append(s)
        return "".join(out)
    return "".join(s if s.isascii() else _through_bytes(s, wrong, right) or s for s in SEGMENT.findall(text))


UTF8_CHAINS = [(w, "utf-8") for w in SINGLE]
TABLE_CHAINS = [(w, r) for w in SINGLE for r in SINGLE + WRITTEN if w != r]
BYTE_CHAINS = [(w, "utf-8") for w in MULTI] + [(w, r) for w in ("latin-1", "cp1252", "cp1251", "koi8-r", "mac-roman") for r in MULTI] + [("gb18030", r) for r in ("cp1251", "koi8-r", "cp1252")]


def implausible(f: str) -> bool:
    """Pairs that are never taken for usual, however often the sample has them: a small letter before a capital, a
    letter next to a sign that doesn't go with letters, controls and lost characters."""
    if any(c == "\ufffd" or c == "\xad" or "\x80" <= c <= "\x9f" for c in f):
        return True
    if len(f) < 2:
        return False
    a, b = f
    if a.islower() and b.isupper():
        return True
    signs = [unicodedata.category(c) in ("Sm", "So", "Sk", "Sc", "No", "Cf", "Co", "Cn") or c in "¿¡¶§‡†‰‹›·" if c >= "\x80" else False for c in f]
    return (a.isalpha() and signs[1]) or (b.isalpha() and signs[0] and a not in "√°£€¥§©™®№¿¡")


# Dashes and the ellipsis, and lines from side to side.
SPACED, LINES = "–—…", "─━═"


def drawn(a: str, b: str) -> bool:
    """Pairs that are as plain as ASCII, however rare: a dash, an ellipsis or the end of a drawn line beside a blank, and
    a line that goes on into the next sign of a drawing."""
    box = lambda c: "\u2500" <= c <= "\u257f"
    if a == " " or b == " ":
        return (b if a == " " else a) in SPACED or box(b if a == " " else a)
    if not (box(a) and box(b)) or a not in LINES and b not in LINES:
        return False
    names = unicodedata.name(a), unicodedata.name(b)
    return ("RIGHT" in names[0] or "HORIZONTAL" in names[0]) and ("LEFT" in names[1] or "HORIZONTAL" in names[1])


@lru_cache(maxsize=200_000)
def _of_pair(a: str, b: str) -> tuple[str, ...]:
    if a < "\x80" and b < "\x80" or drawn(a, b):
        return ()
    if CJK.match(a) or CJK.match(b):
        return tuple(c for c in (a, b) if c >= "\x80")
    return (("0" if a.isdigit() else a) + ("0" if b.isdigit() else b),)


ASCII_RUN = re.compile(r"([\x00-\x7f])[\x00-\x7f]+([\x00-\x7f])")


def _flat(text: str) -> str:
    """The text with runs of ASCII cut down to their ends, which is all that neighbours other characters."""
    return ASCII_RUN.sub("\\1\0\\2", f" {text} ".replace("\n", " "))


def _neighbours(text: str) -> set[tuple[str, str]]:
    flat = _flat(text)
    return set(zip(flat, flat[1:]))


def features(text: str) -> set[str]:
    """Pairs of neighbouring characters of which one isn't ASCII; CJK characters count alone, digits are all alike."""
    return {f for a, b in _neighbours(text) for f in _of_pair(a, b)}


@lru_cache(maxsize=None)
def _pairs(codecs: tuple[str, ...]) -> re.Pattern:
    """First two characters of a multi-byte UTF-8 sequence decoded as one of the codecs."""
    parts = []
    for w in codecs:
        t = decoded(w)
        parts.append(_class([t[b] for b in range(0xC2, 0xF5)]) + _class([t[b] for b in range(0x80, 0xC0)]))
    return re.compile("|".join(parts))


def may_be_encoded(text: str) -> bool:
    return bool(_pairs(tuple(SINGLE)).search(text))


LATIN = [w for w in SINGLE if w not in ("cp1251", "koi8-r", "cp866")]


def looks_encoded(text: str) -> bool:
    """Whether some passage is valid UTF-8 once encoded again; not for Cyrillic encodings, whose own words may be."""
    return bool(_pairs(tuple(LATIN)).search(text)) and any(apply((w, "utf-8"), text) != text for w in LATIN)


class Model:
    """What is usual: character pairs and a compression dictionary for each language."""

    def __init__(self, usual: frozenset[str], dictionaries: dict[str, bytes]):
        self.usual, self.dictionaries, self._ready = usual, dictionaries, None
        self._helped: dict[str, np.ndarray] = {}
        self._letters: list[str] | None = None
        self._plain: set[tuple[str, str]] = set()  # neighbours known to be usual; emptied when it grows too large

    def __getstate__(self):
        return self.usual, self.dictionaries

    def __setstate__(self, state):
        self.__init__(*state)

    def odd(self, text: str) -> set[str]:
        """The features of the text that aren't usual."""
        out: set[str] = set()
        if len(self._plain) > 300_000:
            self._plain.clear()
        for pair in _neighbours(text) - self._plain:
            if strange := [f for f in _of_pair(*pair) if f not in self.usual]:
                out.update(strange)
            else:
                self._plain.add(pair)
        return out

    def letters(self) -> list[str]:
        """Letters beyond ASCII by how many usual pairs they stand in."""
        if self._letters is None:
            n = Counter(c for f in self.usual for c in f if c >= "\x80" and c.isalpha())
            self._letters = [c for c, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
        return self._letters

    def helped(self, f: str) -> np.ndarray:
        """For each of TABLE_CHAINS, whether it turns an odd pair into a usual one."""
        if f not in self._helped:
            if len(self._helped) > 20_000:
                self._helped.clear()
            there = {w for w in SINGLE if not _upper(w).isdisjoint(f)}
            to = [f.translate(_table(*chain)) if chain[0] in there else "" for chain in TABLE_CHAINS]
            self._helped[f] = np.array([t in self.usual or t != "" and t.isascii() for t in to], np.int32)
        return self._helped[f]

    def size(self, text: str) -> int:
        """Bytes of the shortest description over all languages."""
        import zstandard

        if self._ready is None:
            self._ready = []
            for raw in self.dictionaries.values():
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        raw = text.encode("utf-16-le", "surrogatepass")  # two bytes for most characters: no script is shorter than others
        least = min(len(z.compress(raw)) for z in self._ready) if self._ready else len(raw)
        return least + ESCAPE * (len(CONTROL.findall(text)) + text.count("\ufffd"))

    @classmethod
    def fit(cls, labelled: list[tuple[str, str | list[str]]], share: float = 0.006, least: int = 3) -> Model:
        """From (language, text or passages of it). A pair is usual if it stands in the given share of a language's texts.

        The sample holds garbled passages too. A passage is left out if some chain turns its pairs into much more
        frequent ones, or if it looks encoded.
        """
        import zstandard

        by: dict[str, list[list[str]]] = {}
        for lang, text in labelled:
            by.setdefault(lang, []).append(text if isinstance(text, list) else passages(text))
        rate: dict[str, float] = {}
        of = lru_cache(maxsize=None)(features)  # of the passages of the sample
        for texts in by.values():
            df = Counter(f for segments in texts for f in set().union(*(of(s) for s in segments if not s.isascii())))
            for f, n in df.items():
                rate[f] = max(rate.get(f, 0.0), n / len(texts))
        score = {f: math.log(r) for f, r in rate.items()}

        def mean(fs) -> float:
            return sum(0.0 if f.isascii() else score.get(f, -9.0) for f in fs) / max(1, len(fs))

        def clean(s: str) -> bool:
            if s.isascii():
                return True
            fs = list(of(s))
            now = mean(fs)
            if looks_encoded(s) or any("\x80" <= c <= "\x9f" or c == "\ufffd" for c in s):
                return False
            if now > -1.5 or len(fs) < 6:  # too few pairs to tell; so few of them don't become usual either
                return True
            joined = "\n".join(fs)
            signs = {c for c in joined if c >= "\x80"}
            wrong = {w for w in SINGLE if 2 * len(signs & _upper(w)) >= len(signs)}
            for chain in TABLE_CHAINS:
                if chain[0] in wrong and (t := joined.translate(_table(*chain))) != joined and mean(t.split("\n")) > now + 1.5:
                    return False
            return all((t := apply(chain, s)) == s or mean(features(t)) <= now + 1.5 for chain in UTF8_CHAINS)

        usual: set[str] = set()
        dictionaries = {}
        for lang, texts in by.items():
            kept = [[s for s in segments if clean(s)] for segments in texts]
            df = Counter(f for segments in kept for f in set().union(*(of(s) for s in segments if not s.isascii())))
            usual |= {f for f, n in df.items() if n >= max(least, share * len(texts)) and not implausible(f)}
            parts = [s.encode("utf-16-le", "surrogatepass") for segments in kept for s in segments if len(s) > 8]
            most = TRAIN_BYTES / max(1, sum(map(len, parts))) * 2**32
            parts = [x for x in parts if xxhash.xxh3_64_intdigest(x) >> 32 < most]
            if len(parts) >= 50:
                try:
                    dictionaries[lang] = zstandard.train_dictionary(DICT_BYTES, parts, k=200, d=8).as_bytes()
                except zstandard.ZstdError:
                    continue  # too little text of this language
        return cls(frozenset(usual), dictionaries)


def _candidates(model: Model, s: str, odd: set[str]) -> Iterator[tuple[tuple[tuple[str, str], ...], str]]:
    """(chains, passage restored) wherever at most half of the odd pairs remain."""
    most = len(odd) // 2
    signs = {c for f in odd for c in f if c >= "\x80"}
    from_codec = {w for w in SINGLE if 2 * len(signs & _upper(w)) >= len(signs)}
    for chain in UTF8_CHAINS if may_be_encoded(s) else ():
        if (t := apply(chain, s)) == s:
            continue
        if len(model.odd(t)) <= most:
            yield (chain,), t
            continue
        for second in UTF8_CHAINS:  # encoded twice
            if (u := apply(second, t)) != t and len(model.odd(u)) <= most:
                yield (chain, second), u
    for k in np.flatnonzero(2 * sum(model.helped(f) for f in odd) >= len(odd)):
        chain = TABLE_CHAINS[k]
        if chain[0] in from_codec and len(model.odd(t := apply(chain, s))) <= most:
            yield (chain,), t
    foreign = 2 * sum(c > "\u0250" for c in signs) >= len(signs)
    wide = any(min(f) >= "\x80" for f in odd)  # multi-byte characters leave several signs in a row
    for chain in BYTE_CHAINS if wide else ():
        if chain[0] not in from_codec if chain[0] in SINGLE else not foreign:
            continue
        t = apply(chain, s)
        if chain[1] in MULTI and 2 * len("".join(CJK_IN_WORD.findall(t))) > len(CJK.findall(t)):
            continue  # lone ideographs inside words of another script
        if t != s and t.count("\ufffd") <= s.count("\ufffd") + len(t) // 25 and len(model.odd(t)) <= most:
            yield (chain,), t


def bytes_lost(model: Model, text: str) -> bool:
    """Whether a passage with signs of lost bytes is described shorter with some letter in their place."""
    if "\ufffd" not in text and not CONTROL.search(text):
        return False
    for s in SEGMENT.findall(text):
        lost, control = "\ufffd" in s and LOST.search(s), CONTROL.search(s)
        if not (lost or control):
            continue
        now = model.size(s)
        if control and any(model.size(t) < now for w in SINGLE + WRITTEN if (t := CONTROL.sub(lambda m: decoded(w)[ord(m.group())], s)) != s):
            return True
        if lost and any(model.size(re.sub("\ufffd+", c, s)) < now for c in model.letters()):
            return True
        if lost and any(model.size(apply(chain, s)) < now for chain in UTF8_CHAINS + BYTE_CHAINS):
            return True  # bytes were lost on the way of another chain
    return False


def judge(model: Model, text: str, chain_cost: int = 3) -> tuple[str, list[str], bool]:
    """(restored text, chains undone, whether bytes are lost). Chains are undone until none gains any more."""
    lost = bytes_lost(model, text)
    done: list[str] = []
    seen = {xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))}
    while True:
        if text.isascii() or not model.odd(text):
            break
        segments = SEGMENT.findall(text)
        found: dict[tuple[tuple[str, str], ...], dict[int, str]] = {}
        for k, s in enumerate(segments):
            if not s.isascii() and (odd := model.odd(s)):
                for chains, t in _candidates(model, s, odd):
                    found.setdefault(chains, {})[k] = t
        best, most = None, 0
        for chains, new in found.items():
            old = "".join(segments[k] for k in new)
            cost = sum(1 if c[1] == "utf-8" and c[0] in LATIN else chain_cost for c in chains)
            gain = model.size(old) - model.size("".join(new.values())) - cost
            if gain > most:
                best, most = chains, gain
        if best is None:
            break
        for k, t in found[best].items():
            segments[k] = t
        after = "".join(segments)
        if (h := xxhash.xxh3_128_intdigest(after.encode("utf-8", "surrogatepass"))) in seen:
            break  # chains that undo each other
        seen.add(h)
        done += [">".join(c) for c in best]
        text = after
    return text, done, lost


def fit_model(df: DataFrame, text_col: str, lang_col: str, per_language: int = 1500, per_text: int = 400, languages: int = 200) -> Model:
    """Model from a bounded sample of the texts of each language label (see labelled_sample)."""
    return Model.fit(labelled_sample(df, text_col, lang_col, per_language, per_text, languages))


def restored_texts(df: DataFrame, id_col: str, text_col: str, lang_col: str, *, per_language: int = 1500, per_text: int = 400, languages: int = 200, chain_cost: int = 3) -> DataFrame:
    """(id, text, chains, lost): the affected rows, their restored text, the chains undone and whether bytes are lost.

    per_language, per_text and languages bound the sample that the model is fitted on (see fit_model), nothing else.

    Null, empty and ASCII texts are never affected. Ids keep their type and may be null; repeated rows give repeated
    rows; other columns are ignored; an empty table gives an empty result. Texts of any length are taken whole.
    """
    model = df.sparkSession.sparkContext.broadcast(fit_model(df, text_col, lang_col, per_language, per_text, languages))
    kind = df.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"]):
                if text.isascii():
                    continue
                new, chains, lost = judge(model.value, text, chain_cost)
                if chains or lost:
                    out.append((i, new, chains, lost))
            yield pd.DataFrame(out, columns=["id", "text", "chains", "lost"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInPandas(run, f"id {kind}, text string, chains array<string>, lost boolean")
