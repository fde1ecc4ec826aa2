import pytest
from pyspark.sql import functions as F

from quillon.functions import answers as X
from quillon.functions import chat, detect, text
from quillon.sources import io


def one(spark, s, column):
    return spark.createDataFrame([(s,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_code(spark):
    assert one(spark, "a ```python\nx=1\n``` b ```python\ny=2\n``` c", text.python_code) == "y=2"
    assert one(spark, "x=1\n```", text.python_code) == "x=1"
    assert one(spark, None, text.python_code) is None
    assert one(spark, "```\nz\n```", text.fenced_code) == "z\n" and one(spark, "none", text.fenced_code) is None
    assert one(spark, "#include <iostream>\nint main(){ std::cout << 1; }", detect.code_language) == "cpp"
    assert one(spark, "hello", detect.code_language) == "python"


def test_cases(spark):
    assert [tuple(r) for r in one(spark, "```plaintext\nTest 1\nInput:\n1\nOutput:\n2\n```", text.test_cases)] == [("1", "2")]
    s = "```\nInput:\n1 2\nOutput:\n3\n```\n```\nInput:\n1 2\nOutput:\n3\n```"
    assert [tuple(r) for r in one(spark, s, text.test_cases)] == [("1 2", "3")] * 2
    assert len(one(spark, s, lambda c: text.distinct_cases(text.test_cases(c)))) == 1


def test_answers(spark):
    assert one(spark, "so #### 1,234", text.hash_answer) == "1234" and one(spark, "no", text.hash_answer) is None
    assert one(spark, "3 or 4.", lambda c: text.hash_answer(c, strict=False)) == "4."
    assert one(spark, "Answer: b", text.choice_answer) == "b"
    assert one(spark, "nothing", text.labelled_answer) == "[INVALID]"


def test_boxed_and_equality():
    assert X.boxed_content(r"\boxed{1} then \boxed{\frac{1}{2}}") == r"\frac{1}{2}" and X.boxed_content("none") is None and X.boxed_content(r"\boxed{1") is None
    for a, b in ((r"\dfrac{1}{2}", "1/2"), ("1,000", "1000"), ("(1, 2)", "(1,2)"), ("50\\%", "50"), ("3 meters", "3 "), ("5 cm", "5 "), ("x+x", "2*x"), ("7 3/4", "31/4"), ("2 million", "2*10^6")):
        assert X.same_answer(a, b), (a, b)
    for a, b in (("1", "2"), (None, "1"), ("2/4", "1/2"), ("x", "y"), ("[1,2]", "(1,2)"), ("1.5", "1"), ("2 million", "2000000"), ("9**9**9", "1"), ("__import__('os')", "1")):
        assert not X.same_answer(a, b), (a, b)
    assert X.close_answer("0.5", "50") and not X.close_answer("1", "x") and X.close_answer("[[1,2],[3,4]]", r"\begin{pmatrix}1&2\\3&4\end{pmatrix}") and X.close_answer("Point(1, 2)", "(1,2)") and X.close_answer("101_2", "101")
    assert X.graded("Step 2: so \\boxed{12}", "12") == (True, True, "12") and X.graded(None, "1") == (False, False, None) and X.graded("The answer is 3", "4")[0] is False
    assert X.parses("x = 1") and not X.parses("x =") and not X.parses(None)


def test_plain_forms(spark):
    from quillon.functions import grading

    cases = [("\\frac1", "\\frac1"), ("\\frac", None), ("\\sqrt", None), ("", ""), (None, None), ("01/2", "01/2"), ("a=b=c", "a=b=c"), ("-3/4", "\\frac{-3}{4}"), ("\\fracab c", "\\frac{a}{b}c")]
    df = spark.createDataFrame([(a, b) for a, b in cases], "a string, b string")
    assert [(r.a, r.x) for r in df.select("a", grading.plain_form(F.col("a")).alias("x")).collect()] == cases
    same = df.select(grading.same_plain(F.col("a"), F.lit("\\frac")).alias("x")).collect()
    assert [r.x for r in same] == [False, True, False, False, False, False, False, False, False]
    with pytest.raises(Exception, match="no box"):
        df.where("a = ''").select(grading.unboxed(F.col("a"), strict=True)).collect()


def test_chat(spark):
    df = spark.createDataFrame([([("system", "S"), ("user", "U"), ("assistant", "A")],), ([("user", "U")],), ([],)], "m array<struct<role:string,content:string>>")
    p, c = chat.completion_pair("m")
    rows = df.select(F.size(p).alias("n"), c.alias("c"), chat.rendered("m").alias("r"), F.transform(chat.without_system("m"), lambda x: x["content"]).alias("w")).collect()
    assert [(r.n, r.c, r.r, r.w) for r in rows] == [(2, "A", "S\n\nU", ["S\n\nU", "A"]), (1, None, "U", ["U"]), (0, None, "", [])]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "task_id int, x string")
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    (tmp_path / "s").mkdir()
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "s" / "train-0.parquet")
    assert io.read_split(spark, str(tmp_path / "s"), "test").count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_split(spark, str(tmp_path / "w"), "test", "none")
    (tmp_path / "r.json").write_text('["p", "q\\n"]')
    r = io.read_json_list(spark, str(tmp_path / "r.json"))
    assert [(x.position, x.response) for x in r.collect()] == [(0, "p"), (1, "q\n")]
    assert io.attach(df, r.withColumnRenamed("position", "task_id"), "task_id").count() == 2
    with pytest.raises(Exception, match="differ"):
        io.attach(df, r.limit(1).withColumnRenamed("position", "task_id"), "task_id").collect()
    assert io.missing(df, df.where("task_id = 0"), "task_id").count() == 1
    io.write_generations(df, str(tmp_path / "g"), 3)
    assert spark.read.json(str(tmp_path / "g" / "step=3")).count() == 2
    nested = spark.createDataFrame([((1, ("z",)),)], "a struct<b:int,c:struct<d:string>>")
    assert io.flattened(nested).columns == ["a/b", "a/c/d"]


def test_stream_accumulates(spark, tmp_path):
    from quillon.streaming.windows import accumulate_until_full

    src = str(tmp_path / "src")
    spark.range(10).selectExpr("id", "id % 5 as uid").write.parquet(src)
    s = spark.readStream.schema("id long, uid long").parquet(src)
    accumulate_until_full(s, str(tmp_path / "o"), "uid", 3, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o" / "full")).select("uid").distinct().count() == 3


def test_stream_delivers_each_group_once(spark, tmp_path):
    from quillon.streaming.windows import accumulate_until_full

    def arrive(first, last):
        spark.range(first, last).selectExpr("id", "id div 2 as uid").coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("id long, uid long").parquet(src)
        accumulate_until_full(s, str(tmp_path / "o"), "uid", 3, str(tmp_path / "c")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "o" / "full")).collect()
        batches = {}
        for r in rows:
            batches.setdefault((r.step, r.part), set()).add(r.uid)
        assert all(len(b) == 3 for b in batches.values())
        return sorted(r.id for r in rows)

    src = str(tmp_path / "src")
    assert arrive(0, 16) == list(range(12))  # 8 groups: two batches at once, two groups wait
    assert arrive(16, 18) == list(range(18))
    assert arrive(18, 22) == list(range(18))
    assert arrive(22, 26) == list(range(24))


def test_scorers(spark):
    from quillon.operators.scorers import Scorers, choice_match, number_match

    df = spark.createDataFrame([("a", "#### 5", "5"), ("a", "none", "5"), ("bx", "Answer: C", "C"), ("bx", None, "C")], "data_source string, response string, truth string")
    s = Scorers().add("b*", choice_match).add("a", number_match())
    assert [r.score for r in s.score(df).collect()] == [1.0, 0.0, 1.0, 0.0]
    other = df.withColumn("data_source", F.lit("c"))
    assert s.score(other, strict=False).where("score is null").count() == 4
    with pytest.raises(Exception, match="no scorer"):
        s.score(other).collect()


def test_labelled_cases(spark):
    pick = lambda s: tuple(one(spark, s, text.labelled_case))
    assert pick('**Test Input:**\n```plaintext\n1\\n2\n```\n**Test Output:**\n```"x"```') == ("1\n2", "x")
    assert pick("**Test Input:** 3\n**Test Output:** 4\n**Explanation:** y") == ("3", "4")
    assert pick("**Test Input:**\n```\n3\n```\n**Test Output:** 4") == ("3", "4")
    assert pick("nothing") == ("", "") and pick(None) == (None, None)


def test_votes_of_languages(spark):
    """As the number of signs says: a call of input and range and items speak for Python 3."""
    code = "n = int(input())\nfor i in range(n):\n    for k, v in d.items():\n        pass"
    assert one(spark, code, detect.python_version) == "python3" and one(spark, "x", detect.python_version) == "python" and one(spark, None, detect.code_language) is None
