"""Extraction from messages, tasks and training samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import chat, text
from quillon.functions.columns import stripped
from quillon.plans.tables import table
from quillon.registry import query

ANSWERS = "WITH a AS (SELECT message_id, content FROM messages WHERE lower(trim(role)) = 'assistant' AND content IS NOT NULL)"
S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def answers(spark, folder):
    return table(spark, folder, "messages").where((F.lower(stripped("role")) == "assistant") & F.col("content").isNotNull()).select("message_id", "content")


@query(ANSWERS + " SELECT message_id, " + S.format("split_part(string_split(content, '```python')[-1], '```', 1)") + " AS code FROM a")
def code_extract(spark, folder):
    return answers(spark, folder).select("message_id", text.python_code(F.col("content")).alias("code"))


@query(
    ANSWERS + r""" SELECT message_id, CASE WHEN regexp_matches(content, '(?s)```python\n.*?```') THEN regexp_extract(content, '(?s)```python\n(.*?)```', 1)
    WHEN regexp_matches(content, '(?s)```[A-Za-z]*\n.*?```') THEN regexp_extract(content, '(?s)```[A-Za-z]*\n(.*?)```', 1) END AS code FROM a"""
)
def fenced_code_extract(spark, folder):
    return answers(spark, folder).select("message_id", text.fenced_code(F.col("content")).alias("code"))


_CASES = ANSWERS + r""", c AS (SELECT message_id, content, list_zip(regexp_extract_all(content, '(?s)```[\s\S]*?Input:\n([\s\S]*?)\nOutput:\n([\s\S]*?)```', 1), regexp_extract_all(content, '(?s)```[\s\S]*?Input:\n([\s\S]*?)\nOutput:\n([\s\S]*?)```', 2)) AS z FROM a)
"""


@query(_CASES + ", u AS (SELECT message_id, generate_subscripts(z, 1)::INT - 1 AS k, unnest(z) AS x FROM c) SELECT message_id, k, " + S.format("x[1]") + " AS input, " + S.format("x[2]") + " AS output FROM u")
def testcase_extract(spark, folder):
    c = answers(spark, folder).select("message_id", F.posexplode(text.test_cases(F.col("content"))).alias("k", "x"))
    return c.select("message_id", "k", "x.input", "x.output")


@query(_CASES + "SELECT message_id, (len(string_split(content, '<reasoning>')) - 1 = len(z) AND ends_with(" + S.format("content") + ", '```'))::INT AS score FROM c")
def tests_format(spark, folder):
    return answers(spark, folder).select("message_id", text.tests_format_score(F.col("content")).alias("score"))


@query(ANSWERS + r" SELECT message_id, regexp_matches(content, '(?s)<reasoning>\s*\S.*?</reasoning>.*?```python\n\s*[^\s`].*?```')::INT AS score FROM a")
def code_format(spark, folder):
    return answers(spark, folder).select("message_id", text.code_format_score(F.col("content")).alias("score"))


@query("SELECT task_id, coalesce(list_contains(json_keys(input_output), 'fn_name'), false) AS has_fn_name FROM tasks WHERE json_valid(input_output)")
def json_filter_fn_name(spark, folder):
    t = table(spark, folder, "tasks").where(F.json_object_keys("input_output").isNotNull())
    return t.select("task_id", text.has_key(F.col("input_output"), "fn_name").alias("has_fn_name"))


@query(
    """WITH t AS (SELECT task_id, input_output, unnest(range(least(json_array_length(input_output, '$.inputs'), json_array_length(input_output, '$.outputs'))::BIGINT)) AS k FROM tasks WHERE json_valid(input_output))
    SELECT task_id, k::INT AS test_idx, json_extract_string(input_output, '$.inputs[' || k || ']') AS input, json_extract_string(input_output, '$.outputs[' || k || ']') AS expected FROM t"""
)
def json_zip_tests(spark, folder):
    from quillon.operators.evaluation import tests_from_json

    return tests_from_json(table(spark, folder, "tasks"))


@query("SELECT task_id, CASE WHEN json_valid(solutions) THEN json_array_length(solutions)::INT END AS n_solutions FROM tasks")
def json_solutions(spark, folder):
    parsed = F.from_json("solutions", "array<string>")
    return table(spark, folder, "tasks").select("task_id", F.when(F.json_array_length("solutions").isNotNull(), F.size(parsed)).alias("n_solutions"))


@query(_CASES + "SELECT message_id, len(list_distinct(z))::INT AS n_unique, len(z)::INT AS n FROM c WHERE len(z) > 0")
def dedup_tests(spark, folder):
    c = answers(spark, folder).select("message_id", text.test_cases(F.col("content")).alias("z")).where("size(z) > 0")
    return c.select("message_id", F.size(text.distinct_cases(F.col("z"))).alias("n_unique"), F.size("z").alias("n"))


_SYN = "SELECT event_id, 'The total is ' || user_id || '.' || chr(10) || 'Answer: ' || substr('ABCD', (event_id % 4)::INT + 1, 1) || chr(10) || '#### ' || (event_id * 1234) || ',000' AS t FROM events"


def _synthetic(spark, folder):
    e = table(spark, folder, "events")
    letter = F.substr(F.lit("ABCD"), (F.col("event_id") % 4).cast("int") + 1, F.lit(1))
    t = F.concat(F.lit("The total is "), F.col("user_id").cast("string"), F.lit(".\nAnswer: "), letter, F.lit("\n#### "), (F.col("event_id") * 1234).cast("string"), F.lit(",000"))
    return e.select("event_id", t.alias("t"))


@query(
    f"WITH s AS ({_SYN}) " + r"""SELECT event_id, nullif(regexp_replace(regexp_extract(t, '#### (-?[0-9.,]+)', 1), '[,$]', '', 'g'), '') AS strict,
    list_filter(regexp_extract_all(t, '(-?[0-9.,]+)', 1), lambda x: x NOT IN ('', '.'))[-1] AS flexible FROM s"""
)
def gsm8k_extract(spark, folder):
    t = F.col("t")
    return _synthetic(spark, folder).select("event_id", text.hash_answer(t).alias("strict"), text.hash_answer(t, strict=False).alias("flexible"))


@query(f"WITH s AS ({_SYN}) " + r"SELECT event_id, nullif(regexp_extract(t, '(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?', 1), '') AS choice, coalesce(regexp_extract_all(right(t, 300), '(?i)Answer\s*:\s*([^\n]+)', 1)[-1], '[INVALID]') AS labelled FROM s")
def choice_extract(spark, folder):
    return _synthetic(spark, folder).select("event_id", text.choice_answer(F.col("t")).alias("choice"), text.labelled_answer(F.col("t")).alias("labelled"))


SFT = "WITH s AS (SELECT sample_id, messages FROM sft_train_codegen WHERE messages IS NOT NULL)"


def sft(spark, folder):
    return table(spark, folder, "sft_train_codegen").where("messages is not null").select("sample_id", "messages")


@query(
    SFT + """ SELECT sample_id, len(list_filter(messages, lambda m: m.role <> 'assistant'))::INT AS n_prompt, list_filter(messages, lambda m: m.role = 'assistant')[1].content AS completion FROM s
    WHERE list_filter(messages, lambda m: m.role = 'assistant')[1].content IS NOT NULL"""
)
def completion_format(spark, folder):
    p, c = chat.completion_pair("messages")
    return sft(spark, folder).select("sample_id", F.size(p).alias("n_prompt"), c.alias("completion")).where("completion is not null")


@query(SFT + " SELECT sample_id, concat_ws(chr(10) || chr(10), list_filter(messages, lambda m: m.role = 'system')[1].content, list_filter(messages, lambda m: m.role = 'user')[1].content) AS rendered FROM s")
def chat_messages(spark, folder):
    return sft(spark, folder).select("sample_id", chat.rendered("messages").alias("rendered"))


@query(
    SFT + """, x AS (SELECT sample_id, list_filter(messages, lambda m: m.role = 'system')[-1].content AS sys, list_filter(messages, lambda m: m.role <> 'system') AS rest FROM s),
    y AS (SELECT *, list_position(list_transform(rest, lambda m: m.role), 'user') AS p FROM x)
    SELECT sample_id, list_transform(rest, lambda m, i: CASE WHEN i = p AND sys IS NOT NULL THEN sys || chr(10) || chr(10) || m.content ELSE m.content END) AS contents FROM y"""
)
def system_into_user(spark, folder):
    return sft(spark, folder).select("sample_id", F.transform(chat.without_system("messages"), lambda m: m["content"]).alias("contents"))


@query(SFT + " SELECT sample_id, coalesce(list_sum(list_transform(messages, lambda m: CASE WHEN m.role = 'assistant' THEN coalesce(length(m.content), 0) ELSE 0 END)), 0)::BIGINT AS ones, coalesce(list_sum(list_transform(messages, lambda m: coalesce(length(m.content), 0))), 0)::BIGINT AS n FROM s")
def assistant_loss_mask(spark, folder):
    m = sft(spark, folder).select("sample_id", chat.assistant_mask("messages", F.length).alias("m"))
    return m.select("sample_id", F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ones"), F.size("m").cast("bigint").alias("n"))


@query("WITH t AS (SELECT task_id, 'Write a program.' || chr(10) || question || ' /no_think' AS user, len(regexp_extract_all(question, '\\S+'))::INT AS n FROM tasks WHERE question IS NOT NULL) SELECT task_id, user, n FROM t WHERE n <= 90")
def prompt_template_filter(spark, folder):
    """Templated prompts of tasks that aren't too long (words stand in for tokens)."""
    p = chat.prompt("Write a program.\n{problem_query}", F.col("question"), "You are a programmer.", " /no_think")
    t = table(spark, folder, "tasks").where("question is not null").select("task_id", F.element_at(p, 2)["content"].alias("user"), text.token_estimate(F.col("question")).alias("n"))
    return t.where("n <= 90")


@query(
    """WITH d AS (SELECT doc_id, '<image>' || coalesce(source, '') || '<video>' || doc_id AS c FROM documents), s AS (SELECT doc_id, string_split(regexp_replace(c, '(<image>|<video>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM d)
    SELECT doc_id, p AS parts, len(p)::INT AS n FROM s"""
)
def media_segments(spark, folder):
    c = F.concat(F.lit("<image>"), F.coalesce("source", F.lit("")), F.lit("<video>"), F.col("doc_id").cast("string"))
    s = table(spark, folder, "documents").select("doc_id", chat.media_segments(c).alias("s"))
    return s.select("doc_id", F.transform("s", lambda x: x["text"]).alias("parts"), F.size("s").alias("n"))


@query(
    r"""SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS title, replace(regexp_replace(replace(trim('  ' || p_name || ' [title] [x] ' || p_type || ' '), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS cleaned FROM part"""
)
def option_cleaning(spark, folder):
    t = F.concat(F.lit("  "), F.col("p_name"), F.lit(" [title] [x] "), F.col("p_type"), F.lit(" "))
    return table(spark, folder, "part").select("p_partkey", text.capitalized(F.col("p_type")).alias("title"), text.cleaned_option(t).alias("cleaned"))


@query("SELECT message_id, CASE WHEN length(content) <= 300 THEN content ELSE left(content, 150) || '...(truncated) ...' || right(content, 150) END AS shown, md5(content) AS digest FROM messages WHERE content IS NOT NULL")
def shortened_text(spark, folder):
    m = table(spark, folder, "messages").where("content is not null")
    return m.select("message_id", text.shortened(F.col("content")).alias("shown"), F.md5("content").alias("digest"))


@query(
    f"WITH s AS ({_SYN}), r AS (SELECT event_id, t, CASE event_id % 3 WHEN 0 THEN 'hash' WHEN 1 THEN 'choice' ELSE 'label_' || (event_id % 5) END AS data_source FROM s) "
    + r"""SELECT event_id, data_source, (CASE WHEN data_source = 'hash' THEN CASE WHEN regexp_replace(regexp_extract(t, '#### (-?[0-9.,]+)', 1), '[,$]', '', 'g') = '1234000' THEN 1.0 ELSE 0.1 END
    WHEN data_source = 'choice' THEN CASE WHEN regexp_extract(t, '(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?', 1) = '1234000' THEN 1.0 ELSE 0.0 END
    ELSE CASE WHEN trim(coalesce(regexp_extract_all(right(t, 300), '(?i)Answer\s*:\s*([^\n]+)', 1)[-1], '')) = '1234000' THEN 1.0 ELSE -1.0 END END)::DOUBLE AS score FROM r"""
)
def score_by_source(spark, folder):
    from quillon.operators.scorers import Scorers, choice_match, labelled_match, number_match

    source = F.when(F.col("event_id") % 3 == 0, "hash").when(F.col("event_id") % 3 == 1, "choice").otherwise(F.concat(F.lit("label_"), (F.col("event_id") % 5).cast("string")))
    rows = _synthetic(spark, folder).select("event_id", source.alias("data_source"), F.col("t").alias("response"), F.lit("1234000").alias("truth"))
    s = Scorers().add("hash", number_match(format_score=0.1)).add("choice", choice_match).add("label_*", labelled_match)
    return s.score(rows).select("event_id", "data_source", "score")
