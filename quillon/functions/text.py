"""Structure from text: code blocks, test cases, final answers, formatting scores. Native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.columns import stripped

# The fences and tags of model responses.
FENCE, PYTHON_FENCE = "```", "```python"
CASE = r"(?s)```.*?Input:\n(.*?)\nOutput:\n(.*?)```"
# The labels of a single test and what follows its output.
INPUT_LABEL, OUTPUT_LABEL, EXPLANATION_LABEL = "**Test Input:**", "**Test Output:**", "**Explanation:"


def python_code(text: Column) -> Column:
    """What follows the last Python fence, up to the next fence; without one, what precedes the first fence."""
    tail = F.element_at(F.split(text, PYTHON_FENCE), -1)
    return stripped(F.element_at(F.split(tail, FENCE), 1))


def fenced_code(text: Column) -> Column:
    """The first Python block, else the first block of any language, else NULL."""
    py = F.regexp_extract(text, r"(?s)```python\n(.*?)```", 1)
    other = F.regexp_extract(text, r"(?s)```[A-Za-z]*\n(.*?)```", 1)
    return F.when(text.rlike(r"(?s)```python\n.*?```"), py).when(text.rlike(r"(?s)```[A-Za-z]*\n.*?```"), other)


def test_cases(text: Column) -> Column:
    """Array of struct(input, output) of all fenced Input:/Output: blocks, stripped."""
    i = F.regexp_extract_all(text, F.lit(CASE), F.lit(1))
    o = F.regexp_extract_all(text, F.lit(CASE), F.lit(2))
    return F.zip_with(i, o, lambda a, b: F.struct(stripped(a).alias("input"), stripped(b).alias("output")))


def distinct_cases(cases: Column) -> Column:
    """Each case once, in the order of its first occurrence."""
    return F.array_distinct(cases)


def count_of(text: Column, part: str) -> Column:
    return F.size(F.split(text, rf"\Q{part}\E")) - 1


def code_format_score(text: Column) -> Column:
    """1 if a non-empty reasoning block is followed by a non-empty Python block, else 0."""
    ok = text.rlike(r"(?s)<reasoning>\s*\S.*?</reasoning>.*?```python\n\s*[^\s`].*?```")
    return F.coalesce(ok, F.lit(False)).cast("int")


def tests_format_score(text: Column) -> Column:
    """1 if there are as many reasoning tags as test cases and the text ends with a fence, else 0."""
    n = F.size(test_cases(text))
    return F.coalesce((count_of(text, "<reasoning>") == n) & stripped(text).endswith(FENCE), F.lit(False)).cast("int")


def hash_answer(text: Column, strict: bool = True) -> Column:
    """The number after ####, without commas and dollars; not strict: the last number of the text. NULL without one."""
    if strict:
        found = F.regexp_replace(F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1), "[,$]", "")
    else:
        found = F.element_at(F.filter(F.regexp_extract_all(text, F.lit(r"(-?[0-9.,]+)"), F.lit(1)), lambda x: ~x.isin("", ".")), -1)
    return F.when(found != "", found)


def choice_answer(text: Column) -> Column:
    """The letter after the first "Answer:", as written; NULL without one."""
    found = F.regexp_extract(text, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)
    return F.when(found != "", found)


def labelled_answer(text: Column, tail: int = 300) -> Column:
    """The last "Answer: …" in the last `tail` characters; [INVALID] without one."""
    found = F.regexp_extract_all(F.right(text, F.lit(tail)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))


def think_boxed_score(text: Column) -> Column:
    """1 if the whole text is a think block and later a boxed answer."""
    return F.coalesce(text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), F.lit(False)).cast("int")


def cleaned_option(text: Column) -> Column:
    """Stripped; " [title]" becomes a sentence end, other brackets go, double spaces shrink once."""
    return F.replace(F.regexp_replace(F.replace(stripped(text), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def capitalized(text: Column) -> Column:
    """First letter upper, the rest lower (initcap would raise every word)."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def shortened(text: Column, most: int = 300) -> Column:
    """Head and tail round an ellipsis where the text is longer."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("...(truncated) ..."), F.right(text, F.lit(half))))


def has_key(document: Column, key: str) -> Column:
    """Whether a JSON object has the key, also with a null value; NULL where there is no object."""
    return F.array_contains(F.json_object_keys(document), key)


def token_estimate(text: Column) -> Column:
    """Words as a stand-in for tokens, for length filters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def _quoted(text: str) -> str:
    return rf"\Q{text}\E"


def labelled_case(text: Column) -> Column:
    """struct(input, output) of a response in the labelled form; both are empty where a part is missing.

    Each part is its label's last fenced block, or else the last plain text after the label, up to the output's label
    for the input, and up to the explanation, the next input or the end for the output. The word plaintext before a line
    end goes, written line ends become line ends, and outer white space and quotes go.
    """

    def last(pattern: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(text, F.lit("(?s)" + pattern), F.lit(1)), F.lit(-1))

    def part(label: str, until: str) -> Column:
        fenced, plain = last(rf"{_quoted(label)}\s*```(.*?)```"), last(rf"{_quoted(label)}\s*(.*?)(?={until})")
        found = F.replace(F.replace(F.coalesce(F.regexp_replace(fenced, r"^\n+", ""), stripped(plain)), F.lit("plaintext\n"), F.lit("")), F.lit("\\n"), F.lit("\n"))
        return F.regexp_replace(stripped(found), r'^"+|"+$', "")

    given = part(INPUT_LABEL, _quoted(OUTPUT_LABEL))
    wanted = part(OUTPUT_LABEL, rf"{_quoted(EXPLANATION_LABEL)}|{_quoted(INPUT_LABEL.removesuffix('**'))}|$")
    whole = given.isNotNull() & wanted.isNotNull()
    empty = F.when(text.isNotNull(), F.lit(""))
    return F.struct(F.when(whole, given).otherwise(empty).alias("input"), F.when(whole, wanted).otherwise(empty).alias("output"))
