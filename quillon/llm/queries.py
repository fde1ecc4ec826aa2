"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.answer_defects import defective_answers
from quillon.llm.leaks import leaked_passages
from quillon.llm.mojibake import restored_texts
from quillon.llm.near_duplicates import group_pairs, near_duplicate_groups
from quillon.llm.packing import pack, packed_room
from quillon.llm.split_overlap import SplitOverlap
from quillon.plans.tables import table


def role():
    """The role as TESTDATA.md compares it: trimmed, in lower case."""
    return F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", ""))


def _prompt_groups(spark: SparkSession, folder: str) -> DataFrame:
    prompts = table(spark, folder, "messages").where(role() == "user")
    return near_duplicate_groups(prompts, "message_id", "content", width=3, threshold=0.7, least_words=30)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of prompts of one group of near-duplicates."""
    return group_pairs(_prompt_groups(spark, folder)).toDF("message_id_a", "message_id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each prompt with its class of equal shingles, its group and the links of its class."""
    return _prompt_groups(spark, folder).withColumnRenamed("id", "message_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective answers with their defect."""
    labelled = table(spark, folder, "documents").select("text", "lang")
    found = defective_answers(table(spark, folder, "messages"), "message_id", "request_id", "turn", "role", "content", "tool_calls", labelled=labelled)
    return found.withColumnRenamed("id", "message_id")


def _overlap(spark: SparkSession, folder: str) -> tuple[DataFrame, SplitOverlap]:
    split = F.lower(F.trim("split"))
    user = F.filter("messages", lambda m: F.lower(F.regexp_replace(m["role"], r"(?U)^\s+|\s+$", "")) == "user")
    rows = table(spark, folder, "sft_train_codegen").select(
        "sample_id", "source", split.alias("split"), F.array_join(F.transform(user, lambda m: m["content"]), "\n").alias("user"), "gt_tests"
    )
    trained = F.when(split == "train", True).when(split.isin("validation", "test"), False)
    return rows, SplitOverlap(rows.withColumn("trained", trained), "sample_id", "user", "gt_tests", "trained", width=3, text_threshold=0.7, tests_threshold=0.8)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training row and a validation or test row that overlap."""
    return _overlap(spark, folder)[1].pairs().toDF("sample_id_a", "sample_id_b")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """For each held-out split and source: its rows, and how many overlap with the training split and by what."""
    rows, overlap = _overlap(spark, folder)
    held = rows.where("split in ('validation', 'test')").select("sample_id", "split", "source")
    found = overlap.overlapping().withColumnRenamed("id", "sample_id")
    return held.join(found, "sample_id", "left").groupBy("split", "source").agg(
        F.count("*").alias("n_rows"),
        F.count("by_text").alias("n_overlapping"),
        F.count_if("by_text").alias("n_by_text"),
        F.count_if("by_tests").alias("n_by_tests"),
        F.max("coverage").alias("most_coverage"),
    )


def p4_pack(spark: SparkSession, folder: str) -> DataFrame:
    """For each container, the sequence and the place in it of every document or piece of one."""
    docs, containers = table(spark, folder, "documents"), table(spark, folder, "containers")
    return pack(docs, "doc_id", "text", containers, "container", "capacity_tokens").withColumnRenamed("id", "doc_id")


def p4_room(spark: SparkSession, folder: str) -> DataFrame:
    """For each container, its sequences and the room that they leave unused."""
    return packed_room(p4_pack(spark, folder), table(spark, folder, "containers"), "container", "capacity_tokens")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "held_out_items"), "item_id", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the held-out items of which they contain a passage."""
    return _leaks(spark, folder).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    """For each held-out item, in how many documents passages of it occur."""
    items = table(spark, folder, "held_out_items").select("item_id", "benchmark", "split")
    n = _leaks(spark, folder).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_docs"), F.sum("n_passages").alias("n_passages"))
    return items.join(n, "item_id", "left").na.fill(0, ["n_docs", "n_passages"])


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with text from a wrong decoding, as restored, with the chains undone."""
    docs = table(spark, folder, "documents")
    return restored_texts(docs, "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with text from a wrong decoding, whether or not it can be restored."""
    return p6_restored(spark, folder).select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p3_found": p3_found, "p3_report": p3_report, "p4_pack": p4_pack, "p4_room": p4_room, "p5_found": p5_found, "p5_items": p5_items, "p6_found": p6_found, "p6_restored": p6_restored}
ORACLES: dict[str, str] = {}
