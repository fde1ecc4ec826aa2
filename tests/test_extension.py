import time

import pytest

from quillon.functions import extension as X


def test_loading(tmp_path):
    (tmp_path / "r.py").write_text("def score(source, response, truth, scale=1):\n    return scale * (response == truth)\n")
    assert X.load_function(str(tmp_path / "r.py"), "score", scale=3)("s", "a", "a") == 3
    with pytest.raises(AttributeError):
        X.load_function(str(tmp_path / "r.py"), "none")


def test_scorers(spark):
    df = spark.createDataFrame([("s", "1", "1"), ("s", "x", "1")], "a string, b string, c string")
    row, batch = X.row_scorer(lambda s, r, t: float(r) == float(t)), X.batch_scorer(lambda s, r, t: [1.0 * (x == y) for x, y in zip(r, t)])
    assert [tuple(r) for r in df.select(row("a", "b", "c"), batch("a", "b", "c")).collect()] == [(1.0, 1.0), (0.0, 0.0)]
    X.register(spark, "twice", lambda x: 2.0 * x)
    assert spark.sql("select twice(cast(4 as double)) as x").first().x == 8.0


def test_timeout():
    assert X.with_timeout(lambda x: x + 1, 5)(1) == 2
    with pytest.raises(TimeoutError):
        X.with_timeout(time.sleep, 0.3)(5)
    with pytest.raises(RuntimeError):
        X.with_timeout(lambda: 1 / 0, 5)()
