"""Defective answers in conversations, with the kind of their defect.

Questions and answers are paired by one range sort on (conversation, turn): inside a range partition the last question
is carried along, and the few answers before a partition's first question of their conversation look it up among the
partitions' last questions, of which there is one each. So a conversation of any length is spread over partitions.

The distinct answers are then sorted by text. In sorted order a shortened version stands right before a longer one, so
comparing each text with the next one finds all of them; the last text of each partition is compared with the first of
the next. Ranges are drawn from HEADS times HEAD characters of a text, and texts that begin alike for longer, in greater
numbers, are sorted as a group of their own by what follows their common beginning. Lengths, in characters and in words,
at which significantly more distinct answers end than around them are length limits. Both are evidence for a truncation
on top of how the text itself ends, for which the sentence ends of all distinct answers are counted; copy, refusal and
language rules follow (see defect_rules, refusals, languages).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.defect_rules import BOTH, LAST, Open, defect, ending_counts
from quillon.llm.languages import Languages
from quillon.llm.refusals import speech
from quillon.llm.samples import labelled_sample
from quillon.plans.staging import stage

SHORTENED, AT_LIMIT = 3.0, 1.5  # log odds
HEAD, HEADS = 64, 3  # characters of a text by which ranges are drawn, and how many such


def _text_hash(text: str) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64).item()


def _carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers with the question before them; the partition's last question; answers still without one."""
    part = TaskContext.get().partitionId()
    conv = asked = None
    for batch in batches:
        out = []
        for c, turn, i, kind, text in zip(batch["conv"], batch["turn"], batch["id"], batch["kind"], batch["text"]):
            if c != conv:
                conv, asked = c, None
            if kind == "question":
                asked = text or ""
            elif kind == "answer":
                out.append((part, c, i, "open" if asked is None else "pair", asked, text))
        yield pd.DataFrame(out, columns=["part", "conv", "id", "kind", "asked", "text"])
    if asked is not None:
        yield pd.DataFrame([(part, conv, None, "carried", asked, None)], columns=["part", "conv", "id", "kind", "asked", "text"])


def answer_pairs(df: DataFrame, id_col: str, conv_col: str, turn_col: str, role_col: str, text_col: str, calls_col: str | None = None) -> DataFrame:
    """(id, asked, text): answers without tool calls and the last question before each; answers without one are left out.

    Roles are compared trimmed and in lower case. Rows with a null id, conversation or turn are left out. A row repeated
    as a whole counts once. At the same turn questions come before answers.
    """
    role = F.lower(F.regexp_replace(role_col, r"(?U)^\s+|\s+$", ""))
    answers = (role == "assistant") & ((F.coalesce(F.size(calls_col), F.lit(0)) <= 0) if calls_col else F.lit(True))
    kind = F.when(role == "user", "question").when(answers, "answer")
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(id_col).cast("long").alias("id"), kind.alias("kind"), F.col(text_col).alias("text"))
    rows = rows.where("kind is not null and conv is not null and turn is not null and id is not null")
    order = ["conv", "turn", F.desc("kind"), "id"]
    n = max(4, rows.rdd.getNumPartitions())
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = stage(ranged.mapInPandas(_carry, f"part int, conv {df.select(conv_col).dtypes[0][1]}, id long, kind string, asked string, text string"), "carried")
    carried = found.where("kind = 'carried'").select("conv", F.col("part").alias("from"), F.col("asked").alias("before"))
    opened = found.where("kind = 'open'").join(carried, "conv").where("from < part")
    opened = opened.groupBy("id", "text").agg(F.max_by("before", "from").alias("asked")).select("id", "asked", "text")
    return found.where("kind = 'pair'").select("id", "asked", "text").union(opened)


def _common(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The length of what the least and the greatest text of a group, and so all of its texts, begin with."""
    for b in rows:
        n = [next((k for k, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi))) for lo, hi in zip(b["lo"], b["hi"])]
        yield pd.DataFrame({"h": b["h"], "to": np.array(n, np.int32), "lo": b["lo"]})


def _grouped(texts: DataFrame, crowd: int) -> DataFrame:
    """(g, at, text): text is sorted inside group g by what follows its first `at` characters, which are g's own.

    Where more than `crowd` texts of a group go on alike for HEADS * HEAD characters, they become a group; one of them
    stays behind, so that whatever begins all of them still has a neighbour that shows it.
    """
    rows = texts.select(F.lit(0).cast("long").alias("g"), F.lit(0).alias("at"), "text")
    width = HEADS * HEAD
    while True:
        rows = rows.withColumn("h", F.when(F.length("text") > F.col("at") + width, F.xxhash64("g", F.substr("text", F.col("at") + 1, F.lit(width)))))
        hot = rows.where("h is not null").groupBy("h").agg(F.count("*").alias("n"), F.min("text").alias("lo"), F.max("text").alias("hi")).where(F.col("n") > crowd)
        hot = stage(hot.mapInPandas(_common, "h long, to int, lo string"), "long-beginnings")
        if hot.isEmpty():
            return rows.drop("h")
        kept = rows.join(hot.select("h", F.col("lo").alias("text")), ["h", "text"], "left_semi").select("g", "at", "text")
        moved = rows.join(hot.select("h", "to"), "h", "left")
        moved = moved.select(F.when(F.col("to").isNotNull(), F.col("h")).otherwise(F.col("g")).alias("g"), F.coalesce("to", "at").alias("at"), "text")
        rows = stage(moved.union(kept), "grouped-texts")


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of texts that the next text begins with; the first and the last text."""
    part = TaskContext.get().partitionId()
    shape = lambda rows: pd.DataFrame(rows, columns=["part", "kind", "hash", "text"])
    last = None
    for batch in batches:
        out = []
        for text in batch["text"]:
            if last is None:
                out.append((part, "first", 0, text))
            elif text != last and text.startswith(last):
                out.append((part, "shortened", _text_hash(last), None))
            last = text
        yield shape(out)
    if last is not None:
        yield shape([(part, "last", 0, last)])


def shortened_texts(texts: DataFrame, crowd: int = 100_000) -> DataFrame:
    """(hash): hashes of the texts (column text, all different) that begin another, longer one."""
    rows = _grouped(texts.where("text <> ''"), crowd)
    n = max(4, rows.rdd.getNumPartitions())
    heads = [F.substr("text", F.col("at") + 1 + k * HEAD, F.lit(HEAD)).alias(f"h{k}") for k in range(HEADS)]
    ranged = rows.select("g", "text", *heads).repartitionByRange(n, "g", *(f"h{k}" for k in range(HEADS))).sortWithinPartitions("g", "text").select("text")
    found = stage(ranged.mapInPandas(_neighbours, "part int, kind string, hash long, text string"), "neighbours")
    # the partitions that hold texts, numbered: one row each
    place = found.where("kind = 'first'").select("part", F.row_number().over(Window.orderBy("part")).alias("k"))
    ends = found.where("kind in ('first', 'last')").join(place, "part")
    last = ends.where("kind = 'last'").select((F.col("k") + 1).alias("k"), F.col("text").alias("short"))
    across = ends.where("kind = 'first'").join(last, "k").where(F.col("text").startswith(F.col("short")) & (F.col("text") != F.col("short"))).select("short")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"hash": np.array([_text_hash(t) for t in b["short"]], np.int64)})

    return found.where("kind = 'shortened'").select("hash").union(across.mapInPandas(hashed, "hash long")).distinct()


def length_limits(texts: DataFrame, times: float = 8.0, reach: int = 10, deviations: float = 6.0) -> DataFrame:
    """(unit, length): lengths at which `times` as many texts end as on average at the lengths around, and by so many
    deviations of a Poisson count more. unit is chars or words; texts (column text) are all different."""
    size = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("length")), F.struct(F.lit("words").alias("unit"), n_words().alias("length"))))
    n = stage(texts.select(size.alias("s")).groupBy("s.unit", "s.length").agg(F.count("*").alias("n")).where(F.col("length") >= F.when(F.col("unit") == "chars", 40).otherwise(8)), "text-lengths")
    # lengths are spread over windows of neighbouring ones by an explode, so no window holds the whole histogram
    around = n.select("unit", F.explode(F.sequence(F.col("length") - reach, F.col("length") + reach)).alias("length"), F.col("n").alias("m")).groupBy("unit", "length").agg(F.sum("m").alias("m"))
    mean = (F.col("m") - F.col("n")) / (2 * reach)
    return n.join(around, ["unit", "length"]).where((F.col("n") > times * mean) & (F.col("n") - mean > deviations * F.sqrt(mean + 1))).select("unit", "length")


def n_words():
    return F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(kind, key, *c) for (kind, key), c in ending_counts(b["text"]).items()]
        yield pd.DataFrame(out, columns=["kind", "key", "e", "n"])


def ending_scores(open_ends: DataFrame, texts: DataFrame) -> DataFrame:
    """open_ends (id, hash, keys, name) with score: the log odds that a sentence ends with the text's last words, by how
    often one does in all texts (column text, all different); an unknown last word that is no name counts against it."""
    counts = stage(texts.mapInPandas(_counted, "kind byte, key long, e long, n long").groupBy("kind", "key").agg(F.sum("e").alias("e"), F.sum("n").alias("n")), "sentence-ends")
    whole = counts.where(F.col("kind") == LAST).agg(F.sum("e").alias("e"), F.sum("n").alias("n")).first()
    prior = min(max((whole.e or 0) / max(1, whole.n or 0), 1e-6), 0.5)
    base = math.log(prior / (1 - prior))
    at = open_ends.select("id", "hash", "name", F.posexplode("keys").alias("kind", "key")).withColumn("kind", F.col("kind").cast("byte"))
    known = counts.where((F.col("kind") == LAST) | (F.col("n") >= 3))
    k = F.when(F.col("kind") == BOTH, 4.0).otherwise(2.0)
    e, n = F.coalesce("e", F.lit(0)), F.coalesce("n", F.lit(0))
    odds = F.log((e + k * prior) / (n - e + k * (1 - prior))) - base
    novel = F.when((F.col("kind") == LAST) & F.col("n").isNull() & ~F.col("name"), -1.5).otherwise(0.0)
    return at.join(known, ["kind", "key"], "left").groupBy("id", "hash").agg((base + F.sum(odds + novel)).alias("score"))


def defective_answers(
    df: DataFrame, id_col: str, conv_col: str, turn_col: str, role_col: str, text_col: str, calls_col: str | None = None,
    *, labelled: DataFrame | None = None, label_col: str = "lang", per_language: int = 400, per_text: int = 60, languages: int = 200, sentences: int = 1000, crowd: int = 100_000
) -> DataFrame:
    """(id, defect): defective answers and their defect: empty, refusal, copy, other_language or truncated.

    Ids must be integers. What counts as a pair is said at answer_pairs; an answer repeated under its id is judged once.
    Other columns are ignored; an empty table gives an empty result. labelled has texts (column text) and their language
    (label_col), in any languages; per_language, per_text and languages bound the sample of it that the model of
    languages is fitted on (see labelled_sample), and `sentences` those of it that the model of refusals takes for sentences
    on the matter. Without it languages are told by their script only. Everything else
    covers all texts, whole. More than `crowd` texts with a long common beginning are sorted as a group of their own.
    """
    spark = df.sparkSession
    pairs = stage(answer_pairs(df, id_col, conv_col, turn_col, role_col, text_col, calls_col), "answer-pairs")
    texts = stage(pairs.select("text").where("text is not null").dropDuplicates(["text"]), "answers")
    sample = labelled_sample(labelled, "text", label_col, per_language, per_text, languages) if labelled is not None else []
    models = spark.sparkContext.broadcast((Languages.fit(sample), speech((s for _, p in sample for s in p), sentences)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, asked in zip(b["id"], b["text"], b["asked"]):
                found = defect(text, asked, *models.value)
                if isinstance(found, Open):
                    out.append((i, _text_hash(text), None, found.below, found.keys, found.name, len(text), len(text.split())))
                elif found:
                    out.append((i, 0, found, None, None, None, None, None))
            yield pd.DataFrame(out, columns=["id", "hash", "defect", "below", "keys", "name", "chars", "words"]).astype({"chars": "Int32", "words": "Int32"})

    shape = "id long, hash long, defect string, below double, keys array<long>, name boolean, chars int, words int"
    judged = stage(pairs.mapInPandas(judge, shape), "judged")
    sure = judged.where("defect is not null").select("id", "defect")
    open_ends = judged.where("defect is null")
    limits = stage(length_limits(texts), "length-limits")
    at = lambda unit: limits.where(F.col("unit") == unit).select(F.col("length").alias(unit), F.lit(1).alias(f"at_{unit}"))
    shortened = shortened_texts(texts, crowd).withColumn("shortened", F.lit(1))
    found = open_ends.join(ending_scores(open_ends, texts), ["id", "hash"]).join(at("chars"), "chars", "left").join(at("words"), "words", "left").join(shortened, "hash", "left")
    evidence = F.when(F.coalesce("at_chars", "at_words").isNotNull(), AT_LIMIT).otherwise(0.0) + F.when(F.col("shortened").isNotNull(), SHORTENED).otherwise(0.0)
    truncated = found.where(F.col("score") - evidence < F.col("below")).select("id", F.lit("truncated").alias("defect"))
    return sure.union(truncated).distinct()
