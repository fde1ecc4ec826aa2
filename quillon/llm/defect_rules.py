"""Rules by which an answer is empty, truncated, a refusal, a copy or in another language. Pure Python, per pair."""

from __future__ import annotations

import ast
import builtins
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from typing import NamedTuple

import xxhash

from quillon.llm.languages import Languages, differ
from quillon.llm.refusals import COURTESY, DECLINES, Speech

CJK = "぀-ヿ㐀-䶿一-鿿가-힣"
TOKEN = re.compile(f"[{CJK}]|[^\\W_{CJK}]+")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
FENCED = re.compile(r"```[^\n`]*\n?(.*?)(?:```|\Z)", re.S)
TAG = re.compile(r"</?[a-zA-Z_|][^<>\n]{0,40}>|<\|[^<>\n]{0,40}\|>")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
#: What ends a sentence, with closing quotes and brackets.
STOPPED = re.compile(r"[.!?。！？…][\"'”’»)\]*_]*$")

# What stands for an answer that isn't there.
PLACEHOLDERS = {
    "null", "none", "nil", "nan", "undefined", "n/a", "na", "todo", "tbd", "tba", "fixme", "wip", "empty", "blank", "no response", "no answer", "no output", "no content", "response",
    "answer", "your answer here", "insert answer here", "placeholder", "not available", "not provided", "missing", "error", "input output", "lorem ipsum", "sin respuesta", "sans réponse",
    "keine antwort", "sem resposta", "нет ответа", "brak odpowiedzi", "无", "无回答", "空", "暂无",
}

# How one declines, by language.
REFUSAL = re.compile(
    r"""\b(?:i|we)\s+(?:really\s+|simply\s+)?(?:can(?:no|')?t|cannot|can\s+not|won't|will\s+not|must\s+not|may\s+not|shouldn't|am\s+not\s+able\s+to|am\s+unable\s+to|are\s+unable\s+to|have\s+to\s+decline|must\s+decline|decline|refuse|
      am\s+not\s+(?:allowed|permitted|going\s+to)|'d\s+rather\s+not|would\s+rather\s+not|prefer\s+not\s+to|must\s+leave)\b
    |\bi'd\s+rather\s+not\b|\bi'm\s+(?:not\s+able|unable|not\s+allowed|not\s+permitted|stepping\s+back)|\bas\s+i\s+am\s+not\s+(?:allowed|permitted)
    |\bno\s+(?:answer|solution|help)\s+can\s+be\s+(?:given|provided|offered)|\bnot\s+something\s+(?:that\s+)?i\s+(?:can\s+)?(?:assist|help|do)|\bagainst\s+(?:the|my)\s+(?:rules|policy|policies|guidelines)
    |\bbeyond\s+what\s+i\s+(?:may|can|am)|\bout\s+of\s+the\s+question|\bnot\s+be\s+appropriate\s+for\s+me|\bkeep\s+me\s+from|\bnothing\s+further\s+on\b|\brestricted\s+content|\byou\s+will\s+have\s+to\s+work\s+out
    |\bmy\s+(?:guidelines|rules|policies)\s+(?:do\s+not|don't|keep|prevent|forbid)
    |\bno\s+(?:puedo|debo|me\s+es\s+posible|me\s+está\s+permitido)\b|\bprefiero\s+no\b|\bnormas\s+no\s+lo\s+permiten|\bfuera\s+de\s+lo\s+que\s+puedo|\bcontra\s+las\s+(?:reglas|normas)|\bmis\s+(?:reglas|normas)\s+(?:no|me|impiden)|\bme\s+niego|\bno\s+estoy\s+(?:en\s+condiciones|autorizad[oa])
    |\bne\s+(?:peux|puis|dois|suis)\s+pas\b|\bpréfère\s+ne\s+pas\b|\bm['’]interdi|\bdépasse\s+ce\s+que|\bje\s+m['’]arrête\s+ici|\bmes\s+(?:règles|consignes)|\bje\s+refuse|\bvaut\s+mieux\s+demander
    |\b(?:kann|darf|möchte|werde|will)\s+ich\b[^.]*\b(?:nicht|keine?n?)\b|\bich\s+(?:kann|darf|möchte|werde|will)\b[^.]*\b(?:nicht|keine?n?)\b|\berlauben\s+mir\s+keine?|\bübernehme\s+ich\s+nicht|\bgegen\s+(?:die|meine)\s+(?:regeln|vorgaben|richtlinien)|\bich\s+lehne
    |\bnão\s+(?:posso|devo|me\s+é\s+permitido|consigo\s+ajudar)|\bprefiro\s+não\b|\bregras\s+(?:impedem|não)|\balém\s+do\s+que\s+posso|\bcontra\s+as\s+regras|\bnão\s+me\s+é\s+permitido|\brecuso|\bmelhor\s+perguntar\s+a|\bfica\s+de\s+fora|\bnão\s+estou\s+autorizad[oa]
    |\bя\s+не\s+(?:могу|буду|вправе|стану)|\bне\s+могу\s+(?:помочь|ответить|решить)|\bвыходит\s+за\s+рамки|\bправила\s+(?:не|запрещают)|\bмне\s+(?:нельзя|запрещено|не\s+разреш)|\bвынужден[ао]?\s+отказ|\bпротив\s+(?:моих\s+)?правил|\bотказываюсь
    |\b(?:решать|отвечать|помогать|делать)\s+не\s+(?:стану|буду|могу)|\bне\s+хотелось\s+бы|\bлучше\s+спросите
    |\bnie\s+(?:mogę|wolno\s+mi|będę)|\bwolę\s+nie|\bmuszę\s+odmówić|\bodmawiam|\bzasady\s+(?:nie|zabraniają)|\bwykracza\s+poza
    |无法(?:帮助|提供|回答|处理|解答|协助)|不能(?:帮助|提供|回答|处理|解答|协助)|不便(?:回答|提供)|超出了?我|拒绝(?:回答|提供)|恕(?:我)?(?:不能|无法|难)|规(?:定|则)不允许|不(?:被)?允许我|不予(?:回答|提供)""",
    re.I | re.X,
)
# How a limitation that is worked round goes on.
WORKED_ROUND = re.compile(r"\bso\s+(?:i|we)\b|\binstead\s+(?:i|we)\b|\bhence\s+(?:this|i|we)\b|\bwhich\s+helps\b|\bbut\s+(?:here(?:'s|\s+is)|(?:i|we)\s+can\b(?!'t|\s*not))|\bhere\s+is\b|\bhere's\b", re.I)
# Words by which one speaks to the reader rather than on the matter, by language.
ADDRESS = re.compile(
    r"""\b(?:i|i'm|i'd|i've|me|my|you|your|please|sorry|apologi[sz]e|apologies|unfortunately|thanks|thank|hm+|assistant|afraid|regret|instead|question|understand|thought|consider)\b
    |\b(?:lo\s+siento|lamento|disculpa|perdón|me\s+temo|gracias|por\s+favor|usted|espero|consulta|pregunta|profesor)\b|\b(?:désolée?|je|vous|merci|pardon|regrette|malheureusement|hélas)\b
    |\b(?:ich|mir|leider|tut|danke|bitte|sie|frag|frage|entschuldigung|vorgaben)\b|\b(?:sinto|lamento|desculpe|obrigad[oa]|você|infelizmente|por\s+favor|professor)\b
    |\b(?:извините|простите|сожалению|спасибо|пожалуйста|вам|вы|я|мне|увы|учител\w+|преподавател\w+)\b|\b(?:przepraszam|przykro|niestety|dziękuję|proszę|pan|pani|nauczyciel\w*)\b|抱歉|对不起|谢谢|请您|您|我|老师|遗憾""",
    re.I | re.X,
)

# Names of the languages in these languages, as stems.
LANGUAGE_NAMES = {
    "en": r"english|inglés|ingles|anglais|englisch|inglês|английск|angielsk|英语|英文",
    "es": r"spanish|español|castellano|espagnol|spanisch|espanhol|испанск|hiszpańsk|西班牙",
    "fr": r"french|francés|français|französisch|francês|французск|francusk|法语|法文",
    "de": r"german\b|alemán|allemand|deutsch|alemão|немецк|niemieck|德语|德文",
    "pt": r"portuguese|portugués|portugais|portugiesisch|português|португальск|portugalsk|葡萄牙",
    "pl": r"polish\b|polaco|polonais|polnisch|polonês|польск|polsk|波兰",
    "ru": r"russian|ruso\b|russe\b|russisch|russo\b|русск|rosyjsk|俄语|俄文",
    "zh": r"chinese|chino\b|chinois|chinesisch|chinês|китайск|chińsk|中文|汉语",
    "it": r"italian|italien|итальянск|włosk|意大利",
    "nl": r"dutch\b|neerland|holand|néerlandais|niederländisch|голландск|нидерландск|niderlandzk|荷兰",
    "ja": r"japan|japon|japonés|japonês|японск|japońsk|日语|日文|日本",
    "ko": r"korean|corean|coréen|koreanisch|корейск|koreańsk|韩语|韩文|한국어",
    "ar": r"arabic|árabe|arabe\b|arabisch|арабск|arabsk|阿拉伯",
    "tr": r"turkish|turco|turc\b|türkisch|турецк|tureck|土耳其",
    "uk": r"ukrainian|ucranian|ukrainien|ukrainisch|украинск|ukraińsk|乌克兰",
    "el": r"\bgreek\b|griego|\bgrec\b|griechisch|греческ|greck|希腊",
    "hi": r"\bhindi\b|хинди|印地",
}
LANGUAGE_NAMES = {k: re.compile(rf"(?:\b|(?<=[一-鿿]))(?:{v})", re.I) for k, v in LANGUAGE_NAMES.items()}

FORMULA = re.compile(r"[\d=<>{}\[\]`^]|\w_\w|\w\(")

CODE_LINE = re.compile(
    r"^\s*(?:def |class |return\b|for .+|while .+|if .+|elif |else:|try:|except|with .+:|import |from \w+ import|print\(|#|@\w+|\}|\{|#include|using |int |public |let |const |var |continue$|break$|pass$)"
    r"|^\s*[\w.\[\], ]+\s*(?:[-+*/|&^%]|//|<<|>>)?=\s*\S|^\s{4,}\S|^\s*[\w.]+\(.*\)?\s*;?$"
)
CODE_START = re.compile(r"^\s*(?:def |class |return\b|for \w+(?:, \w+)* in |while |if .+:$|from \w+ import|import \w|print\(|[a-z_]\w*(?:\[[^\]]*\])?(?:, \w+)* = \S)")


def visible(text: str | None) -> str:
    return INVISIBLE.sub("", text or "").strip()


def is_empty(text: str) -> bool:
    """Nothing is left once markup is taken away, or a placeholder."""
    bare = TAG.sub(" ", text)
    bare = re.sub(r"^\s*```[^\n`]*$|```[a-z]*", " ", bare, flags=re.M)
    bare = re.sub(r"^\s*(?:input|output|question|answer|response)\s*:\s*$", " ", bare, flags=re.M | re.I)
    if not re.search(r"[^\W_]", bare):
        return True
    plain = re.sub(r"\s+", " ", re.sub(r"^[\s\W_]+|[\s\W_]+$", "", bare.lower()))
    return plain in PLACEHOLDERS


def without_code(text: str) -> str:
    """The prose: fenced blocks, code lines, tags and inline code are taken away."""
    out = re.sub(r"`[^`\n]*`", " ", TAG.sub(" ", FENCED.sub("\n", text)))
    lines = out.split("\n")
    code = sum(bool(CODE_START.match(x)) for x in lines)
    if code >= 2:
        lines = [x for x in lines if not CODE_LINE.match(x)]
    return "\n".join(x for x in lines if not re.match(r"\s*(?:input|output)\s*:|^[\d\s.,;-]*$", x, re.I))


def _restates(sentence: str, asked: frozenset[str], share: float = 0.7) -> bool:
    """Whether a sentence is made of the user's words, to that share."""
    w = TOKEN.findall(re.sub(r"^(?:[^\s:]+\s+){0,6}[^\s:]+:\s", "", sentence).lower())
    return len(w) >= 4 and sum(x in asked for x in w) >= share * len(w)


SURE, LIKELY = 0.63, 0.5  # probabilities from which a sentence declines, or only speaks to the reader


def is_refusal(text: str, asked: str, speech: Speech) -> bool:
    """All that is said either declines, or is said to the reader about declining, or restates what was asked.

    A sentence declines by its wording or by the model of labelled sentences; one with figures or formulas doesn't by
    the model alone.
    """
    stripped = TAG.sub(" ", re.sub(r"```[^\n`]*", " ", text)).strip()
    if any(CODE_START.match(x) for x in stripped.split("\n")):
        return False
    declines, known = False, None
    for s in SENTENCE.split(stripped):
        if not re.search(r"[^\W_]", s):
            continue
        s = s.replace("’", "'")
        if WORKED_ROUND.search(s):
            kinds = (0.0, 0.0, 1.0)
        else:
            kinds = speech.kinds(s) if not FORMULA.search(s) else (0.0, 0.0, 1.0)
            if REFUSAL.search(s) or kinds[DECLINES] >= SURE and not _restates(s, known := known or frozenset(TOKEN.findall(asked.lower())), 0.4):
                declines = True
                continue
        if not ADDRESS.search(s) and kinds[DECLINES] + kinds[COURTESY] < LIKELY:
            known = known or frozenset(TOKEN.findall(asked.lower()))
            if not _restates(s, known):
                return False
    return declines


def is_copy(text: str, asked: str) -> bool:
    """Nearly all that is said is the user's, in the user's order."""
    a = TOKEN.findall(re.sub(r"^\s*\W*(?:question|task|prompt|problem|pregunta|frage|pergunta|вопрос|pytanie|问题)\s*[:：]", " ", TAG.sub(" ", text).lower()))
    u = TOKEN.findall(asked.lower())
    if len(a) < 3 or len(u) < 3:
        return len(a) > 0 and a == u
    if len(set(a) - set(u)) > 0.4 * len(set(a)):
        return False
    have = Counter(u)
    own = sum(max(0, n - max(have[w], 1) * (2 if have[w] else 0)) for w, n in Counter(a).items())  # a text may come back twice
    if own > 0.2 * len(a):
        return False
    pairs = set(zip(u, u[1:]))
    kept = sum(p in pairs for p in zip(a, a[1:]))
    return kept >= 0.6 * (len(a) - 1) and len(a) >= 0.3 * len(u)


def is_other_language(text: str, asked: str, model: Languages) -> bool:
    """Whether the prose is in another language than the user's, which the user didn't name."""
    found = differ(model, without_code(text), without_code(asked))
    if not found:
        return False
    answer, question = found
    named = {k for k, p in LANGUAGE_NAMES.items() if p.search(asked)} - {question}
    # a language that the model doesn't have may have been asked for
    return answer not in named and not any(k not in model.labels for k in named)


def _word(w: str, first: bool) -> str:
    if w.isdigit():
        return "0"
    if len(w) == 1 and w.isascii():
        return "@"
    return w.lower()


#: Kinds of counts of how often a sentence ends after something: the word, the word before it, the last two words.
LAST, BEFORE, BOTH = 0, 1, 2


def _key(kind: int, gram: str) -> int:
    x = xxhash.xxh3_64_intdigest(f"{kind}:{gram}")
    return x - 2**64 if x >= 2**63 else x


def ending_counts(texts: Iterable[str]) -> dict[tuple[int, int], list[int]]:
    """(kind, key) -> [how often a sentence ends there, how often it stands at all], over sentences with a marked end."""
    out: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for text in texts:
        for s in SENTENCE.split(without_code(text)):
            if not STOPPED.search(s.strip()):
                continue
            w = [_word(x, k == 0) for k, x in enumerate(TOKEN.findall(s))]
            if len(w) < 4:
                continue
            for k, x in enumerate(w):
                c = out[LAST, _key(LAST, x)]
                c[0] += k == len(w) - 1
                c[1] += 1
                if k:
                    for kind, gram in ((BEFORE, w[k - 1]), (BOTH, f"{w[k - 1]} {x}")):
                        c = out[kind, _key(kind, gram)]
                        c[0] += k == len(w) - 1
                        c[1] += 1
    return out


class Open(NamedTuple):
    """A text that ends without a mark: it is truncated if the log odds of a sentence's end there are below `below`."""

    below: float
    keys: list[int]  # of LAST, BEFORE and BOTH, or of LAST alone
    name: bool  # the last word has a capital


def _ending(text: str, below: float) -> Open | bool:
    tokens = TOKEN.findall(text)
    w = [_word(x, k == 0) for k, x in enumerate(tokens)]
    if not w:
        return 0.0 < below
    keys = [_key(LAST, w[-1])] + ([_key(BEFORE, w[-2]), _key(BOTH, f"{w[-2]} {w[-1]}")] if len(w) > 1 else [])
    return Open(below, keys, tokens[-1][:1].isupper())


def _open_code(code: str) -> bool:
    """Whether Python code breaks off: it doesn't parse, or its last line names what nothing defines."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return True
    known = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | set(dir(builtins))
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.ClassDef)):
            known.add(n.name)
        elif isinstance(n, ast.arg):
            known.add(n.arg)
        elif isinstance(n, ast.alias):
            known.add((n.asname or n.name).split(".")[0])
        elif isinstance(n, ast.ExceptHandler) and n.name:
            known.add(n.name)
    last = max((n.lineno for n in ast.walk(tree) if isinstance(n, ast.stmt)), default=0)
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and n.lineno >= last and n.id not in known:
            return True
        if isinstance(n, ast.Expr) and n.lineno >= last and isinstance(n.value, (ast.Name, ast.Attribute)):
            return True
    return False


def is_truncated(text: str) -> bool | Open:
    """Whether the text breaks off, or what it depends on."""
    if text.count("```") % 2:
        return True
    for tag in re.findall(r"<(think|reasoning|answer|solution|scratchpad)>", text, re.I):
        if len(re.findall(f"<{tag}>", text, re.I)) > len(re.findall(f"</{tag}>", text, re.I)):
            return True
    tail = text.rstrip()
    if tail.endswith("```") or re.search(r"</\w+>$", tail):
        return False
    lines = tail.split("\n")
    code = [bool(CODE_START.match(x)) for x in lines]
    if sum(code) >= 1 and (CODE_LINE.match(lines[-1]) or code[-1]) and "```" not in text:
        at = code.index(True)
        while at and lines[at - 1].lstrip().startswith("#"):
            at -= 1
        prose = [x for x in lines[at:] if x.strip() and not CODE_LINE.match(x)]
        if not prose or not STOPPED.search(lines[-1]):
            last = lines[-1].lstrip()
            if last.startswith("#"):
                return True
            return _open_code("\n".join(lines[at:]))
    last = re.sub(r"^[\s>#*|•\-]+|^\s*\d+[.)]\s+", "", lines[-1]).strip()
    if re.search(r"\b(?:i\.e|e\.g|z\.B|p\. ex|т\.е|т\.к)\.$", last):
        return True
    if STOPPED.search(last):
        return False
    if re.search(r"(?:→|=>|:|<=|>=|≤|≥|=|\$|\\boxed\{[^{}]*\}|\)|:\)|:-\)|;\))\s*-?[\w.]*\$?$", last) and re.search(
        r"(?:→|=>)\s*-?\w+$|(?:^|[\s(])[\w()]{1,8}\s*(?:<=|>=|≤|≥|=|<|>)\s*-?\w+$|\$[^$]+\$$|\\boxed\{[^{}]*\}$|[:;]-?[)D]$|\bO\([^()]*\)$|\)$", last
    ):
        return False
    if re.search(r"[,;:(\[{–—\-/=+*&“«]$", last):
        return True
    words = TOKEN.findall(last)
    if len(words) <= 3 and len(lines) == 1:  # a terse answer
        return False
    if last.endswith("…"):
        return False
    # inside a paragraph whose other sentences are stopped, a missing stop tells more than in a list or a single line
    listed = re.match(r"\s*(?:[-*•]|\d+[.)])\s", lines[-1])
    inside = not listed and re.search(r"[.!?]\s|[。！？]", last)
    return _ending(last, 5.0 if inside else -5.0 if listed else -1.5)


def defect(text: str | None, asked: str | None, languages: Languages, speech: Speech) -> str | Open | None:
    """The kind of defect of an answer, None, or what a truncation depends on."""
    seen = visible(text)
    if not seen or is_empty(seen):
        return "empty"
    asked = asked or ""
    if is_refusal(seen, asked, speech):
        return "refusal"
    if is_copy(seen, asked):
        return "copy"
    if is_other_language(seen, asked, languages):
        return "other_language"
    cut = is_truncated(seen)
    return cut if isinstance(cut, Open) else "truncated" if cut else None
