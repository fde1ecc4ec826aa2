import pytest

from quillon.llm.mojibake import SINGLE, Model, apply, decoded, fit_model, judge, restored_texts
from quillon.llm.samples import passages

# Invented sentences; enough of them to learn the languages' letters from.
SENTENCES = {
    "fr": ["Le château près de la forêt a été réparé.", "Où est la clé du théâtre ?", "L’été dernier, la rivière gelée était cassée.", "À côté, le garçon préfère le gâteau."],
    "de": ["Die Brücke über den Fluss ist länger als die Straße.", "Der König hört schöne Märchen.", "Ärzte prüfen das Gefäß täglich.", "Übung macht größer."],
    "ru": ["Каждый день мост теряет девять частей.", "Первая строка содержит число и описание графа.", "Найдите кратчайший путь до колодца.", "Если список пуст, выведите ноль."],
    "pl": ["Każdego dnia żółw traci siedem części.", "Źródło jest głębokie, więc łódź płynie.", "Książę mógł zgubić ścieżkę.", "Wąż śpi pod drzewem."],
    "en": ["The café’s naïve “model” can’t fail – it’s fine.", "A façade costs £45 at 20 °C.", "We’d call it “done”."],
}


@pytest.fixture(scope="module")
def model():
    return Model.fit([(k, " ".join(v[(a + b) % len(v)] for b in range(3))) for k, v in SENTENCES.items() for a in range(60)])


def garbled(text: str, right: str, wrong: str) -> str:
    return "".join(decoded(wrong)[b] for b in text.encode(right))


@pytest.mark.parametrize("wrong", SINGLE)
@pytest.mark.parametrize("lang", ["fr", "de", "ru", "pl"])
def test_utf8_read_as_something_else(model, lang, wrong):
    text = " ".join(SENTENCES[lang])
    assert judge(model, garbled(text, "utf-8", wrong))[0] == text


@pytest.mark.parametrize(("lang", "right", "wrong"), [("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("ru", "cp866", "cp1251"), ("pl", "cp1250", "cp1252"), ("de", "cp1252", "cp437"), ("fr", "mac-roman", "cp1252"), ("de", "cp850", "cp1252")])
def test_single_byte_encodings(model, lang, right, wrong):
    text = next(s for s in SENTENCES[lang] if not s.isascii() and s == s.encode(right, "ignore").decode(right))
    new, chains, _ = judge(model, garbled(text, right, wrong))
    assert chains and new == text


def test_twice(model):
    text = " ".join(SENTENCES["fr"])
    assert judge(model, garbled(garbled(text, "utf-8", "cp1252"), "utf-8", "cp1252"))[0] == text


@pytest.mark.parametrize("text", ["", "plain", *(s for v in SENTENCES.values() for s in v), "NÃO É A SITUAÇÃO.", "├── src\n└── lib", "Ã, Â and â are labels.", "‰ of ‡ †", "x � y"])
def test_what_is_meant_stays(model, text):
    assert judge(model, text) == (text, [], False)


def test_lost_bytes(model):
    assert judge(model, "Le ch�teau est cass�.")[2] and judge(model, "caf\x8e")[2]


def test_chains_leave_the_rest_alone():
    assert apply(("cp1252", "utf-8"), "Ã© and 中文") == "é and 中文"


def test_dirty_rows(spark):
    good = [(k, f"{s} {k}", lang, 1) for lang, v in SENTENCES.items() for k, s in enumerate(v * 20)]
    bad = garbled(" ".join(SENTENCES["fr"]), "utf-8", "cp1252")
    rows = [*good, (900, bad, "FR", 1), (900, bad, None, 1), (None, bad, "und", 1), (901, None, "fr", 1), (902, "", None, None), (903, (SENTENCES["fr"][0] + " ") * 3000 + bad, "fr", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lost int")
    got = restored_texts(df, "doc_id", "text", "lang").collect()
    assert sorted((r.id is None, r.id or 0) for r in got) == [(False, 900), (False, 900), (False, 903), (True, 0)]
    assert all(r.text.endswith(" ".join(SENTENCES["fr"])) for r in got)
    assert restored_texts(df.limit(0), "doc_id", "text", "lang").count() == 0


EAST = {
    "ja": ["毎朝、庭師は新しい花を数えます。", "最初の行には二つの整数が与えられる。", "橋の長さを求めるプログラムを書いてください。", "答えが存在しない場合は零を出力する。"],
    "ko": ["첫 번째 줄에는 두 정수가 주어진다.", "다리의 길이를 구하는 프로그램을 작성하시오.", "정원사는 매일 아침 새 꽃을 센다.", "답이 없으면 영을 출력한다."],
    "el": ["Κάθε μέρα ο κηπουρός μετρά τα λουλούδια.", "Η πρώτη γραμμή περιέχει δύο ακέραιους αριθμούς.", "Βρείτε το μήκος της γέφυρας.", "Αν δεν υπάρχει απάντηση, τυπώστε μηδέν."],
    "tr": ["Bahçıvan her sabah çiçekleri sayar.", "İlk satırda iki tam sayı verilir; köprünün uzunluğunu bulun.", "Yanıt yoksa sıfır yazın, ğ ve ş harfleri önemlidir.", "Şu ağaç köşkün gölgesinde büyüdü."],
}


@pytest.fixture(scope="module")
def east():
    return Model.fit([(k, " ".join(v[(a + b) % len(v)] for b in range(3))) for k, v in (SENTENCES | EAST).items() for a in range(60)])


@pytest.mark.parametrize(("lang", "right"), [("ja", "cp932"), ("ja", "euc-jp"), ("ko", "cp949"), ("el", "cp1253"), ("tr", "cp1254")])
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
def test_encodings_of_further_languages(east, lang, right, wrong):
    text = " ".join(EAST[lang])
    new, chains, _ = judge(east, garbled(text, right, wrong))
    assert chains and new == text


def test_more_chains_than_four(model):
    """Each sentence was garbled by another chain."""
    parts = [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("utf-8", "cp850"), ("utf-8", "koi8-r"), ("utf-8", "cp1251")]
    clean = [f"{SENTENCES['fr'][0]}\n{SENTENCES['fr'][2]}\n" for _ in parts]
    new, chains, _ = judge(model, "".join(garbled(t, *p) for t, p in zip(clean, parts)))
    assert new == "".join(clean) and len(chains) > 4


def test_no_language_is_left_out(spark):
    """More labels than are modelled one by one: the rarest share a model and are still usual."""
    letters = [chr(0x10A0 + k) for k in range(33)] + [chr(0x1E00 + 2 * k) for k in range(20)]
    rows = [(f"{chr(97 + k // 7)}{chr(97 + k % 7)}", f"{c}{c.lower()}na {c}b{n % 5} {n}.") for k, c in enumerate(letters[:45]) for n in range(12)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for n in (3, 41, 200):
        m = fit_model(df, "text", "lang", languages=n)
        assert not [t for _, t in rows if m.odd(t)], n
    assert fit_model(df.limit(0), "text", "lang").usual == frozenset()


def test_copies_and_null_ids_do_not_swell_the_sample(spark):
    rows = [(None, SENTENCES["fr"][0], "fr")] * 3000 + [(None, f"{SENTENCES['fr'][1]} {k}", "fr") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    drawn = []
    fit = Model.fit
    try:
        Model.fit = classmethod(lambda cls, labelled: drawn.extend(labelled) or fit(labelled))
        fit_model(df, "text", "lang", per_language=50)
    finally:
        Model.fit = fit
    assert 20 <= len(drawn) <= 100 and len({tuple(p) for _, p in drawn}) == len(drawn)


def test_passages_are_chosen_from_the_whole_text():
    text = "".join(f"Sentence {k}. " for k in range(500))
    some = passages(text, 40)
    assert len(some) == 40 and any(int(p.split()[1][:-1]) > 400 for p in some) and "".join(passages(text)) == text
    assert "".join(passages("x" * 5000)) == "x" * 5000


def test_samples_of_any_number_of_texts(spark, monkeypatch):
    """A share that is less than one in a billion is still drawn from."""
    from quillon.llm import samples

    df = spark.range(400).selectExpr("concat('text ', id) as text", "'en' as lang")
    assert 20 <= len(samples.labelled_sample(df, "text", "lang", 50, 10, 5)) <= 90
    assert len(samples.labelled_sample(df, "text", "lang", 1000, 10, 5)) == 400
    assert samples.HASHES * 1500 // 10**11 > 10**8
