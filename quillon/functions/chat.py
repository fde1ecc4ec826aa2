"""Chat messages (array of struct role, content) as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_error(messages: str, tests: str) -> Column:
    """What is wrong with a training sample as "kind: detail", NULL if nothing; the first rule that applies."""
    m = F.col(messages)
    count = lambda ok: F.size(F.filter(m, ok))
    return (
        F.when(m.isNull(), "missing: messages").when(F.size(m) == 0, "empty: messages").when(count(lambda x: x["role"] == "user") == 0, "structure: no user")
        .when(count(lambda x: x["role"] == "assistant") == 0, "structure: no assistant").when(count(lambda x: x["content"].isNull()) > 0, "content: null")
        .when(F.col(tests).isNull(), "missing: tests").when(F.col(tests) == "", "empty: tests")
    )


def prompt(template: Column | str, text: Column, system: str | None = None, suffix: str = "") -> Column:
    """[system,] user: the template with {problem_query} replaced by the text, and the suffix."""
    body = F.concat(F.replace(F.lit(template) if isinstance(template, str) else template, F.lit("{problem_query}"), text), F.lit(suffix))
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(*([one("system", F.lit(system))] if system is not None else []), one("user", body))


class Templates:
    """Prompts by name: each a system text, if any, a template with {problem_query}, and a suffix."""

    def __init__(self):
        self._known: dict[str, tuple[str | None, str, str]] = {}

    def add(self, name: str, template: str, system: str | None = None, suffix: str = "") -> Templates:
        if "{problem_query}" not in template:
            raise ValueError(f"{name} has no place for the problem")
        self._known[name] = system, template, suffix
        return self

    def prompt(self, name: str, text: Column, thinking: bool = True) -> Column:
        """The messages of a prompt; without thinking its user text ends with /no_think."""
        if name not in self._known:
            raise KeyError(f"no template {name}: one of {sorted(self._known)}")
        system, template, suffix = self._known[name]
        return prompt(template, text, system, suffix + ("" if thinking else " /no_think"))


def completion_pair(messages: str) -> tuple[Column, Column]:
    """(prompt, completion): the messages that aren't the assistant's, and the first assistant content (NULL without)."""
    m = F.col(messages)
    return F.filter(m, lambda x: x["role"] != "assistant"), F.get(F.filter(m, lambda x: x["role"] == "assistant"), F.lit(0))["content"]


def rendered(messages: str) -> Column:
    """First system and first user content, parted by a blank line; the user's alone without a system."""
    first = lambda role: F.get(F.filter(F.col(messages), lambda x: x["role"] == role), F.lit(0))["content"]
    return F.concat_ws("\n\n", first("system"), first("user"))


def without_system(messages: str) -> Column:
    """The last system content is put before the first user's and the system messages are dropped."""
    m = F.col(messages)
    system = F.element_at(F.filter(m, lambda x: x["role"] == "system"), -1)["content"]
    rest = F.filter(m, lambda x: x["role"] != "system")
    at = F.array_position(F.transform(rest, lambda x: x["role"]), "user") - 1
    joined = F.transform(
        rest, lambda x, i: F.struct(x["role"].alias("role"), F.when((i == at) & system.isNotNull(), F.concat(system, F.lit("\n\n"), x["content"])).otherwise(x["content"]).alias("content"))
    )
    return F.when(F.size(F.filter(m, lambda x: x["role"] == "system")) > 0, joined).otherwise(rest)


def media_segments(content: Column) -> Column:
    """Array of struct(type, text): content cut at <image> and <video>, which stay as segments of their own."""
    parts = F.split(F.regexp_replace(content, "(<image>|<video>)", "\u0001$1\u0001"), "\u0001")
    return F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), p.alias("text")))


def assistant_mask(messages: str, length) -> Column:
    """Array of 0/1 over units of text (length(content) of them for each message): 1 inside assistant messages."""
    return F.flatten(F.transform(F.col(messages), lambda x: F.array_repeat(F.when(x["role"] == "assistant", 1).otherwise(0), F.coalesce(length(x["content"]), F.lit(0)).cast("int"))))


# Roles that a chat template renders.
ROLES = ("system", "user", "assistant", "tool")


def structure_error(messages: str, words: int, length: Callable[[Column], Column]) -> Column:
    """The first structural error of a conversation, NULL if there is none: no messages, none in the list, and of the
    first message at fault that it is missing, without role or content, or of a role that no template renders; then that
    the prompt has more than `words` units by `length`."""
    m = F.col(messages)
    first = lambda bad: F.array_position(F.transform(m, lambda x: F.coalesce(bad(x), F.lit(False))), True) - 1
    fault = lambda x: F.when(x.isNull(), "is not dict").when(x["role"].isNull(), "missing role/content").when(x["content"].isNull(), "content is not string")
    at = first(lambda x: fault(x).isNotNull())
    role = first(lambda x: ~x["role"].isin(*ROLES))
    n = F.aggregate(F.filter(m, lambda x: x["role"] != "assistant"), F.lit(0), lambda a, x: a + length(x["content"]).cast("int"))
    return (
        F.when(m.isNull(), F.lit("Missing messages field")).when(F.size(m) == 0, F.lit("Empty messages list"))
        .when(at >= 0, F.concat(F.lit("Message "), at.cast("string"), F.lit(" "), fault(F.get(m, at.cast("int")))))
        .when(role >= 0, F.concat(F.lit("Chat template/tokenization error: role "), F.get(m, role.cast("int"))["role"]))
        .when(n > words, F.concat(F.lit("Sequence too long: "), n.cast("string"), F.lit(" tokens")))
    )


def parse_messages(document: Column) -> Column:
    """Messages from JSON text; NULL where it is no list of messages."""
    return F.when(F.json_array_length(document).isNotNull(), F.from_json(document, "array<struct<role:string,content:string>>"))


def shuffled_choice(question: Column, gold: Column, others: list[Column], key: Column, seed: int = 42) -> Column:
    """struct(prompt, letter): the question with its gold choice at a drawn place among the shuffled others."""
    order = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(str(i))))
    rest = F.transform(F.array_sort(F.array(*(F.struct(order(i).alias("h"), c.alias("x")) for i, c in enumerate(others)))), lambda s: s["x"])
    at = F.conv(F.substr(order(len(others)), F.lit(1), F.lit(4)), 16, 10).cast("int") % (len(others) + 1)
    choices = F.concat(F.slice(rest, F.lit(1), at), F.array(gold), F.slice(rest, at + 1, F.lit(len(others))))
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(") "), c)), "\n")
    return F.struct(F.concat(question, F.lit("\n\n"), lines).alias("prompt"), F.char(at + 65).alias("letter"))


def with_tool_arguments(extra: Column, truth: Column, tool: str = "code_interpreter") -> Column:
    """extra with need_tools_kwargs and, for the tool, the truth among the arguments it is made with."""
    made = F.struct(F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")).alias(tool))
    return extra.withField("need_tools_kwargs", F.lit(True)).withField("tools_kwargs", made)
