"""Mathematical answers: plain forms and scores. Chains of replacements are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.functions.columns import stripped

# Replacements and removals of the quantitative normal form, in their order.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters",
    "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ",
    "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# What the plain form drops and rewrites, in order.
PLAIN = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
BOX, ANSWER_TAIL, BOX_TAIL = "\\boxed{", 300, 100


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def plain_form(answer: Column) -> Column:
    r"""An answer without line ends, spaces, \left, \right, degrees, dollars, percent signs and what follows a text unit;
    with \frac and \sqrt in braces, simple quotients as \frac, and 0 before a leading point. NULL where it can't be made:
    several text units, or \frac or \sqrt with nothing after them."""
    s = _replaced(answer, PLAIN)
    units = F.split(s, r"\\text\{ ")
    s = F.when(F.size(units) <= 2, F.get(units, F.lit(0)))
    s = _replaced(s, [("\\%", ""), (" .", " 0."), ("{.", "{0.")])
    s = F.when(s.startswith("."), F.concat(F.lit("0"), s)).otherwise(s)
    sides = F.split(s, "=")
    s = F.when((F.size(sides) == 2) & (F.length(F.get(sides, F.lit(0))) <= 2), F.get(sides, F.lit(1))).otherwise(s)
    s = F.when(s.rlike(r"\\sqrt($|\\sqrt)"), None).otherwise(F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}"))
    s = F.replace(s, F.lit(" "), F.lit(""))
    braced = F.regexp_replace(F.regexp_replace(s, r"\\frac([^{])\{", r"\\frac{$1}{"), r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    s = F.when(s.rlike(r"\\frac($|\\frac)"), None).when(s.rlike(r"\\frac[^{]($|\\frac)"), s).otherwise(braced)
    s = F.when(s == "0.5", F.lit(r"\frac{1}{2}")).otherwise(s)
    return F.regexp_replace(s, r"^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$", r"\\frac{$1}{$2}")


def same_plain(a: Column, b: Column) -> Column:
    """Whether two answers have one plain form; as they stand, where one has none; two missing answers are the same."""
    x, y = plain_form(a), plain_form(b)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).when(x.isNull() | y.isNull(), a == b).otherwise(x == y)


def unboxed(boxed: Column, strict: bool = False) -> Column:
    r"""What is in \boxed{…}, which must be all there is; else NULL, or an error if strict."""
    inside = F.when(boxed.startswith(BOX) & boxed.endswith("}"), F.substr(boxed, F.lit(len(BOX) + 1), F.length(boxed) - len(BOX) - 1))
    return F.when(boxed.isNotNull() & inside.isNull(), F.raise_error(F.concat(F.lit("no box: "), boxed))).otherwise(inside) if strict else inside


def quantity_form(answer: Column) -> Column:
    """What is right of the last equals sign, without articles, units and marks; fractions and roots in braces; digits
    without commas."""
    s = _replaced(_replaced(F.element_at(F.split(answer, "="), -1), SUBSTITUTIONS), [(x, "") for x in REMOVED])
    s = F.regexp_replace(s, r"(.*?)\$(.*?)\$(.*)", r"\$$2\$")
    for mark in ("text", "textbf", "overline"):
        s = F.regexp_replace(s, rf"\\{mark}\{{(.*?)\}}", "$1")
    s = F.regexp_replace(s, r"\\boxed\{(.*)\}", "$1")
    s = F.regexp_replace(s, r"frac([^{])(.)", "frac{$1}{$2}")
    s = F.replace(F.regexp_replace(s, r"sqrt([^{])", "sqrt{$1}"), F.lit("$"), F.lit(""))
    bare = F.replace(s, F.lit(","), F.lit(""))
    return stripped(F.when(bare.rlike(r"^\d+$"), bare).otherwise(s))


def quantity_score(response: Column, truth: Column, tail: int = ANSWER_TAIL) -> Column:
    """struct(score, acc, pred): 1 or -1, by the last labelled answer of the response's last characters."""
    pred = quantity_form(text.labelled_answer(response, tail))
    acc = F.coalesce(pred == quantity_form(truth), F.lit(False))
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def boxed_score(response: Column, truth: Column, last_boxed, tail: int = BOX_TAIL) -> Column:
    """struct(score, acc, pred) by the box in the response's last characters, which must be the truth as it is written.

    last_boxed is the function column that finds a box by its braces (answers.strict_box_udf).
    """
    pred = unboxed(last_boxed(F.right(response, F.lit(tail))))
    acc = F.coalesce(pred == truth, F.lit(False))
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def mixed_score(accuracy: Column, formatted: Column) -> Column:
    """Nine tenths for the answer, one for the form."""
    return 0.9 * accuracy + 0.1 * formatted
