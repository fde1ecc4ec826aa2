import os
import random

import pandas as pd
import pytest

from quillon.llm.answer_defects import _text_hash, defective_answers, length_limits, shortened_texts
from quillon.llm.defect_rules import is_refusal
from quillon.llm.languages import Languages, differ
from quillon.llm.refusals import speech
from quillon.llm.samples import passages

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"

PROSE = [
    "The tower of Rome is taller than the old bridge near the river.", "We sort the numbers first and then compare them with the rest.", "Every graph has a node that no other node can reach.", "If the list is empty the answer must be zero.",
    "It helps to draw the tree before the search begins.", "A greedy choice would fail here because the weights are odd.",
]
SPANISH = "La suma de los números pares de la lista se calcula con una función que recorre todos los elementos."
ASK = "Write a function that returns the sum of all even numbers in the list, and explain how it works."
CODE = "```python\ndef f(x):\n    return sum(y for y in x if y % 2 == 0)\n```"


#: Texts of the languages that the model is to know, of the kind a labelled table has.
TEXTS = {
    "en": PROSE,
    "es": ["La torre es más alta que el puente viejo junto al río.", "Primero ordenamos los números y luego los comparamos con el resto.", "Cada grafo tiene un nodo al que ningún otro puede llegar.", "Si la lista está vacía, la respuesta debe ser cero y se imprime una línea."],
    "de": ["Der Turm ist höher als die alte Brücke am Fluss.", "Zuerst sortieren wir die Zahlen und vergleichen sie dann mit dem Rest.", "Jeder Graph hat einen Knoten, den kein anderer erreicht.", "Wenn die Liste leer ist, muss die Antwort null sein."],
    "ru": ["Башня выше старого моста у реки.", "Сначала сортируем числа и сравниваем их с остальными.", "В каждом графе есть вершина, до которой никто не дойдёт.", "Если список пуст, ответ должен быть нулём."],
    "zh": ["塔比河边的旧桥更高。", "首先对数字排序，然后与其余的比较。", "每个图都有一个别的节点到不了的节点。", "如果列表为空，答案必须为零。"],
}
CASES = (
    [
        (None, "empty"), ("  \n", "empty"), ("```python\n```", "empty"), ("<think>\n</think>", "empty"), ("N/A", "empty"), ("…", "empty"), ("[no response]", "empty"), ("​", "empty"),
        ("-1", None), ("YES", None), ("O(n log n)", None), ("$x + 1$", None), ("\\boxed{7}", None),
        (PROSE[0] + " " + CODE, None), (" ".join(PROSE[:3]), None), (" ".join(PROSE[:2]) + "\n\n- the weights are odd\n- compare them with the rest", None), (PROSE[0] + " → 42", None),
        ("```python\ndef f(x):\n    return su", "truncated"), (PROSE[0] + " We sort the numbers first and", "truncated"), ("<reasoning>\n" + PROSE[0], "truncated"), ("def f(x):\n    y = x + 1\n    return yy", "truncated"), ("def f(x):\n    y = x + 1\n    return y", None),
        ("I'm sorry, but I can't help with that.", "refusal"), ("Unfortunately, solving this is against the rules I follow. I hope you understand.", "refusal"), ("Lo siento, no puedo ayudarte con eso.", "refusal"), ("Извините, я не могу помочь с этой задачей.", "refusal"), ("很抱歉，我无法帮助处理关于石子的问题。", "refusal"),
        ("I'm sorry, my last version was wrong; here is the new one.\n" + CODE, None), ("I cannot use a loop here, so I use a sum instead. " + PROSE[1] + " " + PROSE[2], None),
        ("The task is about this: " + ASK + " After some thought, I have to decline.", "refusal"), ("Лучше спросите преподавателя, этот шаг я решать не стану.", "refusal"),
        (ASK, "copy"), ("Question: " + ASK.upper(), "copy"), ("```\n" + ASK + "\n```", "copy"), (ASK + "\n\n" + PROSE[1] + " " + PROSE[2] + " " + PROSE[5] + "\n" + CODE, None),
        (SPANISH, "other_language"), ("Сначала обходим список и складываем все чётные числа, затем печатаем ответ.", "other_language"),
        # languages that the model doesn't have
        ("La somma dei numeri pari della lista si calcola con una funzione che scorre tutti gli elementi e li aggiunge al totale.", "other_language"), ("De som van de even getallen in de lijst wordt berekend met een functie die alle elementen bekijkt en optelt.", "other_language"), ("リストの偶数の和は、すべての要素を調べる関数で求められます。", "other_language"),
        ("This will have to stay unanswered, I am afraid.", "refusal"), ("Your request falls outside the topics I am trained to discuss.", "refusal"),
    ]
)
MESSAGES = "message_id long, request_id string, turn int, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>"
COLUMNS = ("message_id", "request_id", "turn", "role", "content", "tool_calls")


def labelled(spark):
    return spark.createDataFrame([(f"{' '.join(v)} {k}", lang) for lang, v in TEXTS.items() for k in range(40)], "text string, lang string")


def conversations(spark, pairs):
    """A conversation for each (asked, answer), and others by which the ends of sentences are known."""
    rng = random.Random(2)
    pairs = [*pairs, *((ASK, " ".join(rng.sample(PROSE, 3))) for _ in range(200))]
    rows = [(2 * k + j, f"r{k}", j, role, text, None) for k, p in enumerate(pairs) for j, (role, text) in enumerate(zip(("user", "assistant"), p))]
    return spark.createDataFrame(rows, MESSAGES)


def test_rules(spark):
    asked = [ASK] * len(CASES)
    more = [(ASK + " Answer in Spanish.", SPANISH, None), (ASK + " Answer in Italian.", "La somma dei numeri pari della lista si calcola con una funzione che scorre tutti gli elementi e li aggiunge al totale.", None), (SPANISH + " ¿Por qué?", SPANISH[::-1].title() + ".", None)]
    cases = [(q, t, d) for q, (t, d) in zip(asked, CASES)] + more[:2]
    got = {r.id: r.defect for r in defective_answers(conversations(spark, [c[:2] for c in cases]), *COLUMNS, labelled=labelled(spark)).collect()}
    assert [(t, got.get(2 * k + 1)) for k, (_, t, _) in enumerate(cases)] == [(t, d) for _, t, d in cases]
    assert not [i for i in got if i > 2 * len(cases)]


def test_evidence_for_a_truncation(spark):
    """The same end of a text counts as cut where a longer version exists."""
    cut = [f"It was said long ago that {a} {b}" for a in ("the", "old", "must") for b in sorted({w.strip(".") for p in PROSE for w in p.split()})]
    with_longer = [(ASK, c) for c in cut] + [(ASK, c + " beside it, and so on.") for c in cut]
    found = [{r.id for r in defective_answers(conversations(spark, p), *COLUMNS).collect() if r.defect == "truncated" and r.id < 2 * len(cut)} for p in (with_longer, with_longer[: len(cut)])]
    assert found[0] > found[1]


# Wordings and statements written apart from the rows of the model and from the rules.
HELD_OUT = """
en I'm afraid this one will have to stay unanswered.
en Your task falls outside the topics I am trained to discuss.
en Sorry, this is a request I am going to turn down.
en That's not something my instructions let me work on.
en I do not provide solutions of this kind.
en It would not be right for me to hand you a program here.
en My apologies, but no program will come from me.
en I have to say no to this.
en We do not answer questions about this topic.
en I'd prefer that you solve it without me.
en Because of my restrictions, I can give no answer.
en This is where I have to stop, as I may not continue with this task.
es Lamento decirte que no responderé a esta pregunta.
es Esta tarea no la puedo resolver por ti.
es No tengo autorización para hablar de ello.
es Mis instrucciones me prohíben ayudarte con este problema.
fr Je regrette, mais je ne répondrai pas à cette question.
fr Il ne m'est pas permis de résoudre cet exercice.
fr Votre demande dépasse ce que j'ai le droit de faire.
fr Aucune réponse ne vous sera donnée ici.
de Leider bin ich nicht in der Lage, Ihnen dabei zu helfen.
de Eine Lösung darf ich Ihnen nicht geben.
de Auf diese Frage gebe ich keine Antwort.
de Das gehört nicht zu den Themen, die ich behandeln darf.
pt Lamento, mas não responderei a esta pergunta.
pt Não estou em condições de resolver este exercício.
pt As minhas instruções proíbem-me de ajudar com isto.
ru Извините, но отвечать на этот вопрос я не стану.
ru Мне запрещено решать такие задачи.
ru Помочь вам с этим у меня не получится.
pl Niestety nie udzielę odpowiedzi na to pytanie.
pl Nie wolno mi rozwiązywać takich zadań.
pl Nie jestem w stanie pomóc w tej sprawie.
zh 对不起，我没有办法回答您的问题。
zh 我不可以为您解答这道题。
zh 这个请求我不能满足。
it Mi spiace, ma non risponderò a questa domanda.
it Non mi è permesso di risolvere questo problema.
nl Helaas kan ik deze vraag niet beantwoorden.
nl Ik mag deze opgave niet voor je oplossen.
"""
FINE = """
en The list must not be empty, otherwise there is no first element.
en Sorry for the delay; sort the pairs and take the middle one.
en You cannot reach the end without a bridge, so the result is minus one.
en No.
en There is no such path.
en It cannot be done in fewer than three moves.
en Unfortunately the greedy approach fails, dynamic programming works.
es No hay ningún camino posible.
es La respuesta no existe cuando la suma es impar.
fr Il n'y a aucun chemin possible.
fr On ne peut pas dépasser la limite, donc on s'arrête.
de Es gibt keinen solchen Weg.
de Man darf den Knoten nicht zweimal besuchen.
pt Não existe caminho possível.
ru Такого пути не существует.
ru Нельзя посетить вершину дважды.
pl Nie ma takiej drogi.
pl Nie można odwiedzić wierzchołka dwa razy.
zh 不存在这样的路径。
it Non esiste alcun percorso.
nl Zo'n pad bestaat niet.
"""
RECALL = 0.9


def test_recall_of_refusals_in_other_wordings():
    texts = [t for v in TEXTS.values() for t in v]
    if os.path.exists(DOCUMENTS):  # the rows that the query fits it on
        texts = pd.read_parquet(DOCUMENTS, columns=["text"]).text.dropna()
    model = speech(s for t in texts for s in passages(t, 60))
    of = lambda rows: [is_refusal(x[3:], ASK, model) for x in rows.strip().splitlines()]
    assert sum(of(HELD_OUT)) >= RECALL * len(of(HELD_OUT)) and sum(of(FINE)) <= 0.1 * len(of(FINE))


def test_languages():
    model = Languages.fit([(k, v) for k, v in TEXTS.items() for _ in range(30)] + [("es", TEXTS["en"])])
    assert model.labels == sorted(TEXTS)
    for a, x in TEXTS.items():
        for b, y in TEXTS.items():
            assert bool(differ(model, " ".join(x), " ".join(y))) == (a != b)
    none = Languages.fit([])
    assert differ(none, PROSE[0], PROSE[1]) is None and differ(none, " ".join(TEXTS["ru"]), PROSE[1]) == ("cyrillic", "latin") and differ(none, "", "") is None


def test_operator(spark):
    c = [("r1", 1, " User ", ASK, None), ("r1", 2, "assistant", ASK, None), ("r1", 3, "Assistant", "", [("1", "f", "{}")]), ("r1", 5, "user", "Why?", None), ("r1", 9, "assistant", None, None), ("r2", 0, "assistant", "", None), ("r3", 1, "user", None, None), ("r3", 2, "assistant", PROSE[0], None), (None, 1, "user", ASK, None), ("r4", None, "assistant", "", None), ("r5", 1, None, "", None)]
    rows = [(k, *x, "z") for k, x in enumerate(c)]
    shape = "message_id long, request_id string, turn int, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, defect string"
    df = spark.createDataFrame(rows + rows[:2], shape)
    got = defective_answers(df, "message_id", "request_id", "turn", "role", "content", "tool_calls")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "copy"), (4, "empty")]
    assert defective_answers(df.limit(0), "message_id", "request_id", "turn", "role", "content", "tool_calls").count() == 0


def test_long_conversation_is_cut_by_partitions(spark):
    """One conversation holds nearly all rows; questions are carried across partition ends."""
    rows = [(0, "hot", 0, "user", ASK, None)] + [(k, "hot", k, "assistant", ASK if k % 7 == 0 else " ".join(PROSE[:2]), None) for k in range(1, 400)] + [(1000, "x", 0, "assistant", "", None)]
    df = spark.createDataFrame(rows, "message_id long, request_id string, turn int, role string, content string, tool_calls array<struct<id:string>>").repartition(6)
    got = {tuple(r) for r in defective_answers(df, "message_id", "request_id", "turn", "role", "content", "tool_calls").collect()}
    assert got == {(k, "copy") for k in range(7, 400, 7)}


@pytest.mark.parametrize("crowd", [3, 100_000])
def test_shortened_versions(spark, crowd):
    """Also of texts with long common beginnings, which are sorted as groups of their own."""
    rng = random.Random(9)
    full = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(10, 60))) for _ in range(200)]
    frame = "the same beginning of all of them, " * 8
    full += [frame + t for t in full[:60]] + [frame * 3 + t for t in full[60:90]]
    texts = full + [t[: len(t) // 2] for t in full[:50]] + [t[: len(frame) + 5] for t in full[200:260]] + [frame, frame[:100], frame[:250], frame * 3, ""]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "text string").repartition(8)
    there = {t for t in texts if t}
    want = {_text_hash(a) for a in there if any(b != a and b.startswith(a) for b in there)}
    assert {r.hash for r in shortened_texts(df, crowd).collect()} == want


def test_length_limits(spark):
    rows = [("x" * n + str(k),) for n in range(50, 300) for k in range(2)] + [("y" * 197 + f" {k:03}",) for k in range(60)]
    assert {tuple(r) for r in length_limits(spark.createDataFrame(rows, "text string")).collect()} == {("chars", 201)}
    words = [("w " * n + str(k) * (n % 7),) for n in range(10, 60) for k in range(3)] + [("w " * 30 + "x" * k,) for k in range(1, 60)]
    assert ("words", 31) in {tuple(r) for r in length_limits(spark.createDataFrame(words, "text string")).collect()}
    assert length_limits(spark.createDataFrame(rows, "text string").limit(0)).count() == 0
