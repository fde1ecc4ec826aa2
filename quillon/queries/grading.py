"""Answers, scores and languages of programs on made texts.

The tables hold no formulas, so texts are made from the rows' numbers by templates, and the SQL states for each template
what must come out, without the rules by which it does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import answers as X
from quillon.functions import detect, grading, text
from quillon.functions.columns import rounded
from quillon.plans.tables import table
from quillon.registry import query

NUMBERS = {"a": ("event_id % 97 + 2", 97, 2), "b": ("user_id % 89 + 3", 89, 3)}


def made(spark, folder, templates: list[str]):
    """(event_id, t): each event's template, with its numbers in the places of {a} and {b}."""
    e = table(spark, folder, "events")
    a, b = (F.col("event_id") % 97 + 2).cast("string"), (F.col("user_id") % 89 + 3).cast("string")
    t: Column = F.lit(None).cast("string")
    for k, x in enumerate(templates):
        t = F.when(F.col("event_id") % len(templates) == k, F.replace(F.replace(F.lit(x), F.lit("{a}"), a), F.lit("{b}"), b)).otherwise(t)
    return e.select("event_id", t.alias("t"), a.alias("a"), b.alias("b"))


def expected(wanted: list[str | None], name: str, numbers: bool = False) -> str:
    """The SQL of what must come out: as many values as templates, with {a} and {b} in them."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {k} THEN {'NULL' if x is None else x if numbers else quoted(x)}" for k, x in enumerate(wanted))
    value = f"CASE event_id % {len(wanted)} {cases} END"
    return value if numbers else f"replace(replace({value}, '{{a}}', (event_id % 97 + 2)::VARCHAR), '{{b}}', (user_id % 89 + 3)::VARCHAR) AS {name}"


_PLAIN = {
    r"\dfrac{a}{b}": r"\frac{a}{b}", r"{a}/{b}": r"\frac{{a}}{{b}}", r"x = {a}": "{a}", r"\sqrt{a}": None, r".5": r"\frac{1}{2}", r"\left( {a} , {b} \right)": "({a},{b})",
    r"{a}\text{ meters}": "{a}", r"{a}\%": "{a}", r"{a}^\circ": "{a}", r"\frac12 + {a}": r"\frac{1}{2}+{a}", r"0.5": r"\frac{1}{2}", r"\tfrac1{{b}} \! x": r"\frac{1}{{b}}x",
    r"{a}\text{ m} and \text{ s}": None, r"\$ {a}.{b}": "{a}.{b}",
}
# the braces of a command are its own where a number stands in them: one template each way
_PLAIN_IN, _PLAIN_OUT = list(_PLAIN), list(_PLAIN.values())
_PLAIN_IN[0], _PLAIN_OUT[0] = r"\dfrac{{a}}{{b}}", r"\frac{{a}}{{b}}"
_PLAIN_IN[3], _PLAIN_OUT[3] = r"\sqrt2 \cdot {a}", r"\sqrt{2}\cdot{a}"


@query(f"SELECT event_id, {expected(_PLAIN_OUT, 'plain')} FROM events")
def answer_plain_form(spark, folder):
    return made(spark, folder, _PLAIN_IN).select("event_id", grading.plain_form(F.col("t")).alias("plain"))


_QUANTITY = {
    r"x = {a}": "{a}", r"{a} dollars": "{a}", r"1,{a}": "1{a}", r"\frac12": r"\frac{1}{2}", r"\text{yes}": "yes", r"the answer is a ${a}$ here": "{a}", r"{a} \text{m}": "{a}", r"\boxed{{a}}": "{a}",
    r"{a}^{\circ}": "{a}", r"\sqrt{a}{b}": None, r"\textbf{x}, \overline{y}": "x,y", r"{a} \mbox{ square units}": "{a}",
}
_QUANTITY_IN, _QUANTITY_OUT = list(_QUANTITY), list(_QUANTITY.values())
_QUANTITY_IN[9], _QUANTITY_OUT[9] = r"\sqrt7x + {b}", r"\sqrt{7}x+{b}"


@query(f"SELECT event_id, {expected(_QUANTITY_OUT, 'quantity')} FROM events")
def answer_quantity_form(spark, folder):
    return made(spark, folder, _QUANTITY_IN).select("event_id", grading.quantity_form(F.col("t")).alias("quantity"))


_RESPONSES = ["So it is.\nAnswer: {a} dollars", "Answer: 1\nAnswer: x = {a}", "no label {a}", "answer : {b}{a}0"]


@query(
    f"SELECT event_id, {expected(['1.0', '1.0', '-1.0', '-1.0'], '', True)}::DOUBLE AS score, event_id % 4 < 2 AS acc, {expected(['{a}', '{a}', '[INVALID]', '{b}{a}0'], 'pred')} FROM events"
)
def quantity_scores(spark, folder):
    m = made(spark, folder, _RESPONSES)
    return m.select("event_id", grading.quantity_score(F.col("t"), F.col("a")).alias("s")).select("event_id", "s.*")


_BOXES = [r"\boxed{1} then \boxed{\frac{{a}}{{b}}} done", r"so \fbox{{a}}", r"no box {a}", r"\boxed{{a}", r"$\boxed {a}$ is it", r"\boxed{x_{1{a}}} and {b}"]


@query(
    "SELECT event_id, "
    + expected([r"\boxed{\frac{{a}}{{b}}}", r"\fbox{{a}}", None, None, r"\boxed {a}", r"\boxed{x_{1{a}}}"], "box") + ", "
    + expected([r"\boxed{\frac{{a}}{{b}}}", None, None, None, None, r"\boxed{x_{1{a}}}"], "strict") + ", "
    + expected([r"\frac{{a}}{{b}}", "{a}", None, None, None, "x_{1{a}}"], "inner_text") + ", "
    + expected([r"\frac{{a}}{{b}}", None, None, None, "{a}", "x_{1{a}}"], "content") + ", "
    + expected([r"\frac{{a}}{{b}}", None, None, None, None, "x_{1{a}}"], "unboxed") + " FROM events"
)
def boxed_extract(spark, folder):
    m = made(spark, folder, _BOXES).select("event_id", X.box_udf("t").alias("box"), X.strict_box_udf("t").alias("strict"), X.inner_box_udf("t").alias("inner_text"), X.boxed_udf("t").alias("content"))
    return m.withColumn("unboxed", grading.unboxed(F.col("box")))


@query(f"SELECT event_id, {expected(['1.0', '-1.0', '-1.0', '-1.0'], '', True)}::DOUBLE AS score, {expected(['{a}', '{b}+{a}', None, None], 'pred')} FROM events")
def boxed_scores(spark, folder):
    far = r"\boxed{{a}} " + "x" * 120
    m = made(spark, folder, [r"it is \boxed{{a}}", r"it is \boxed{{b}+{a}}", far, "none {a}"])
    return m.select("event_id", grading.boxed_score(F.col("t"), F.col("a"), X.strict_box_udf).alias("s")).select("event_id", "s.score", "s.pred")


_MARKED = {
    "The answer is {a}.": ("{a}.", True), "I think {a} is the answer": ("I think {a}", True), r"We get \boxed{{a}} here": ("{a}", True), "It is {a}. More follows": ("{a}", True), "nothing to see": ("nothing to see", False),
    "Answer: x = {b}": ("{b}", True), "answers are many": ("many", False), "x: {a}": ("{a}", True),
}


@query(f"SELECT event_id, {expected([str(v[1]).lower() for v in _MARKED.values()], '', True)} AS found, {expected([v[0] for v in _MARKED.values()], 'answer')} FROM events")
def answer_by_marks(spark, folder):
    return made(spark, folder, list(_MARKED)).select("event_id", X.marked_udf("t").alias("m")).select("event_id", "m.*")


_VALUE = {"{a} meters": "{a} ", "{a} million": "{a} *10^6", r"\text{Yes}": "yes", "{a} 1/2": "{a}+1/2", "1,{a},000": None, "${a}$": "{a}", "{a}.0": "{a}", r"\frac{1}{2}": "1/2", "{a} or {b}": "{a} , {b}", "- {a}x": "-{a}x"}
_VALUE_IN, _VALUE_OUT = list(_VALUE), list(_VALUE.values())
_VALUE_IN[4], _VALUE_OUT[4] = "1,000,000", "1000000"


@query(f"SELECT event_id, {expected([x.replace('{a} ', '{a} ') if x else x for x in _VALUE_OUT], 'form').replace(chr(39) + '{a} ' + chr(39), chr(39) + '{a}' + chr(39))} FROM events")
def answer_value_form(spark, folder):
    return made(spark, folder, _VALUE_IN).select("event_id", X.value_udf("t").alias("form"))


#: (given, gold, same by form or value, close as numbers)
_GRADES = [
    ("{a}", "{a}.0", True, True), ("{a}/2", r"\frac{{a}}{2}", True, True), ("2/4", "1/2", False, True), ("{a}", "{a}00", False, True), ("({a}, {b})", "({a},{b})", True, True), ("[{a}, {b})", "({a},{b})", False, False),
    ("x^2 + {a}", "{a} + x*x", True, True), ("{a}.5", "{a}", False, False), ("2*(x + {a})", "2*x + 2*{a}", True, True), (r"3\pi", "9.42477796", False, True), ("Interval.open({a}, {b})", "({a}, {b})", False, True), ("none", "{a}", False, False),
]


@query(f"SELECT event_id, {expected([str(g[2]).lower() for g in _GRADES], '', True)} AS same, {expected([str(g[3]).lower() for g in _GRADES], '', True)} AS near FROM events")
def answer_equality(spark, folder):
    given = made(spark, folder, [g[0] for g in _GRADES]).select("event_id", F.col("t").alias("x"))
    both = given.join(made(spark, folder, [g[1] for g in _GRADES]).select("event_id", F.col("t").alias("y")), "event_id")
    return both.select("event_id", X.same_udf("x", "y").alias("same"), X.close_udf("x", "y").alias("near"))


@query(f"SELECT event_id, {expected(['true', 'true', 'false'], '', True)} AS acc, round({expected(['1.0', '0.9', '0.1'], '', True)}::DOUBLE, 6) AS score FROM events")
def think_boxed_mix(spark, folder):
    m = made(spark, folder, [r"<think>so</think> \boxed{{a}}", r"\boxed{{a}.0}", r"<think>so</think> \boxed{{b}{a}1}"])
    m = m.select("event_id", "t", X.same_udf(X.boxed_udf("t"), F.col("a")).alias("acc"))
    return m.select("event_id", "acc", rounded(grading.mixed_score(F.col("acc").cast("double"), text.think_boxed_score(F.col("t")).cast("double"))).alias("score"))


_PROGRAMS = [
    ("print 'x'\nfor i in xrange({a}): pass", "python2", "python"), ("n = int(input())\nfor i in range(n):\n    print(i, {a})", "python3", "python3"), ("x = {a}", "python", "python"),
    ("public class Main {\n  public static void main(String[] a) { System.out.println({a}); }\n}", None, "java"), ("#include <iostream>\nusing namespace std;\nint main() { cout << {a} << endl; }", None, "cpp"),
    ("#include <stdio.h>\nint main() { printf(\"{a}\"); return 0; }", None, "c"), ("d = {}\nfor k, v in d.items():\n    pass\nfor k in range({a}):\n    d[k] = int(input())", "python3", "python3"), ("no program {a}", "python", "python"),
    ("def f(x: int = {a}):\n    return x", "python3", "python3"), ("raise ValueError, 'x{a}'", "python2", "python"), ("def f(x):\n    print x + {a}", "python2", "python2"),
]


@query(f"SELECT event_id, {expected([p[2] for p in _PROGRAMS], 'language')} FROM events")
def lang_detect(spark, folder):
    return made(spark, folder, [p[0] for p in _PROGRAMS]).select("event_id", detect.code_language(F.col("t")).alias("language"))


@query(f"SELECT event_id, {expected([p[1] for p in _PROGRAMS], 'version')} FROM events WHERE event_id % {len(_PROGRAMS)} NOT IN (3, 4, 5)")
def python_versions(spark, folder):
    m = made(spark, folder, [p[0] for p in _PROGRAMS]).where(~(F.col("event_id") % len(_PROGRAMS)).isin(3, 4, 5))
    return m.select("event_id", detect.python_version(F.col("t")).alias("version"))


_LABELLED = [
    ("**Test Input:**\n```plaintext\n{a}\\n1\n```\n**Test Output:**\n```{b}```", "{a}\n1", "{b}"), ("**Test Input:** {a}\n**Test Output:** {b}\n**Explanation:** x", "{a}", "{b}"), ("**Test Input:**\n```\n{a}\n```\n**Test Output:** {b}", "{a}", "{b}"),
    ('**Test Input:** "{a}"\n**Test Output:**\n```\n"{b}"\n```\n', "{a}", "{b}"), ("**Test Input:**\n```{a}```", "", ""), ("nothing {a}", "", ""), ("**Test Input:** 0\n**Test Output:** 0\n**Test Input:** {a}\n**Test Output:** {b}", "{a}", "{b}"),
]


@query(f"SELECT event_id, {expected([x[1] for x in _LABELLED], 'input')}, {expected([x[2] for x in _LABELLED], 'output')} FROM events")
def labelled_case_extract(spark, folder):
    return made(spark, folder, [x[0] for x in _LABELLED]).select("event_id", text.labelled_case(F.col("t")).alias("c")).select("event_id", "c.*")


_FENCED = ["```plaintext\nTest {a}\nInput:\n{a} {b}\nOutput:\n{b}\n```", "```\nInput:\n{a}\nOutput:\n{b}\n``` and ```\nInput:\n{b}\nOutput:\n{a}```", "Input:\n{a}\nOutput:\n{b}"]


@query(
    """WITH e AS (SELECT event_id, (event_id % 97 + 2)::VARCHAR AS a, (user_id % 89 + 3)::VARCHAR AS b FROM events)
    SELECT event_id, 0 AS k, CASE WHEN event_id % 3 = 0 THEN a || ' ' || b ELSE a END AS input, b AS output FROM e WHERE event_id % 3 < 2 UNION ALL SELECT event_id, 1, b, a FROM e WHERE event_id % 3 = 1"""
)
def fenced_case_extract(spark, folder):
    c = made(spark, folder, _FENCED).select("event_id", F.posexplode(text.test_cases(F.col("t"))).alias("k", "x"))
    return c.select("event_id", "k", "x.input", "x.output")


_SYNTAX = ["x = {a}", "def f(:\n    pass", "for i in range({a}):\n    print(i)", "print {a}", "return {b}\n  x", ""]


@query(f"SELECT event_id, {expected(['true', 'false', 'true', 'false', 'false', 'false'], '', True)} AS parses FROM events")
def syntax_check(spark, folder):
    return made(spark, folder, _SYNTAX).select("event_id", X.parses_udf("t").alias("parses"))
