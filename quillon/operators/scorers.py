"""Scores by data source: a registry from names or prefixes of names to column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.functions.tokens import scattered

Scorer = Callable[[Column, Column], Column]


class Scorers:
    """Rules (response, truth) -> score by the value or, with a trailing *, the prefix of the data source."""

    def __init__(self):
        self._rules: dict[str, Scorer] = {}

    def add(self, source: str, scorer: Scorer) -> Scorers:
        self._rules[source] = scorer
        return self

    def score(self, rows: DataFrame, source: str = "data_source", response: str = "response", truth: str = "truth", out: str = "score", strict: bool = True) -> DataFrame:
        """rows with their score: exact names before prefixes, longer prefixes before shorter ones.

        A failing or missing response scores 0. A source without a rule is an error if strict, else NULL.
        """
        order = sorted(self._rules, key=lambda k: (k.endswith("*"), -len(k)))
        last = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double") if strict else F.lit(None).cast("double")
        c = None
        for k in order:
            hit = F.col(source).startswith(k[:-1]) if k.endswith("*") else F.col(source) == k
            value = F.coalesce(self._rules[k](F.col(response), F.col(truth)).cast("double"), F.lit(0.0))
            c = F.when(hit, value) if c is None else c.when(hit, value)
        return rows.withColumn(out, last if c is None else c.otherwise(last))


def number_match(strict: bool = True, format_score: float = 0.0) -> Scorer:
    """1 if the extracted number is the truth, format_score for another number, 0 without one."""

    def rule(response: Column, truth: Column) -> Column:
        found = text.hash_answer(response, strict)
        return F.when(found.isNull(), 0.0).when(found == truth, 1.0).otherwise(format_score)

    return rule


def choice_match(response: Column, truth: Column) -> Column:
    """1 if the chosen letter is the truth as written."""
    return F.when(text.choice_answer(response) == truth, 1.0).otherwise(0.0)


def labelled_match(response: Column, truth: Column) -> Column:
    """1 if the labelled answer, stripped, is the truth, else -1."""
    return F.when(F.trim(text.labelled_answer(response)) == truth, 1.0).otherwise(-1.0)


def reward_tokens(rows: DataFrame, scored: DataFrame | None, mask: str = "mask", given: str | None = None, key: str = "row_id", penalty: Column | None = None) -> DataFrame:
    """rows with reward, an array that holds the score at the last valid token and 0 elsewhere, and the columns of scored.

    scored (key, score, …) comes from Scorers or any other judge; rows that it doesn't have score 0. A column `given` of
    rewards by token that rows has already is taken as it is, and nothing is scored. penalty is added to the score.
    """
    if given and given in rows.columns:
        return rows.withColumn("reward", F.col(given))
    if scored is None:
        raise ValueError("neither scores nor given rewards")
    r = rows.join(scored, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    total = F.col("score") if penalty is None else F.col("score") + penalty
    return r.withColumn("reward", scattered(total, F.col(mask)))


def model_rewards(rows: DataFrame, judge, mask: str = "mask", key: str = "row_id", render: Column | None = None) -> DataFrame:
    """rows with reward, as reward_tokens; judge(table of key and text) gives (key, score) by a reward model outside, and
    render is the text it reads: the conversation in that model's own template."""
    text = rows.select(key, (render if render is not None else F.col("response")).alias("text"))
    return reward_tokens(rows, judge(text), mask, key=key)
