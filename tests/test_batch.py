import pytest

from quillon.operators.batch import Batch, from_columns, inverse


@pytest.fixture()
def abc(spark):
    return from_columns(spark, {"obs": [[1, 2], [3, 4], [5, 6]], "labels": ["a", "b", "c"]}, "obs array<bigint>, labels string", info="test_info")


def labels(b: Batch) -> list:
    return [r.labels for r in b.df.orderBy(b.id).collect()]


def test_repeat(abc):
    assert labels(abc.repeat(2)) == list("aabbcc")
    assert labels(abc.repeat(2, interleave=False)) == list("abcabc")


def test_padding(abc):
    assert abc.pad_to_multiple(2)[1] == 1
    assert abc.pad_to_multiple(3)[1] == 0
    b, pad = abc.pad_to_multiple(7)
    assert pad == 4 and labels(b) == list("abcabca")
    assert labels(b.unpad(pad)) == list("abc")
    assert labels(abc.pad_with(2)) == list("abccc") and labels(abc.pad_with(1, "first")) == list("abca")


def test_chunk(spark):
    b = from_columns(spark, {"labels": list("abcdef")}, "labels string")
    with pytest.raises(ValueError):
        b.chunk(5)
    one, two = b.chunk(2)
    assert labels(one) == list("abc") and labels(one.concat(two)) == list("abcdef")


def test_reorder(spark):
    b = from_columns(spark, {"labels": list("123456")}, "labels string")
    order = spark.createDataFrame(list(enumerate([3, 4, 2, 0, 1, 5])), "position bigint, row_id bigint")
    assert labels(b.reorder(order)) == list("453126")
    assert labels(b.reorder(order).reorder(inverse(order))) == list("123456")


def test_pop_and_rename(abc):
    one, rest = abc.pop(["obs"])
    assert one.df.columns == ["row_id", "obs"] and rest.df.columns == ["row_id", "labels"]
    with pytest.raises(KeyError):
        abc.pop(["act"])
    assert abc.rename(["obs"], ["x"]).df.columns == ["row_id", "x", "labels"]
    with pytest.raises(ValueError):
        abc.rename(["obs"], [])


def test_fold(abc, spark):
    f = abc.repeat(2).fold(2)
    assert labels(f) == [["a", "a"], ["b", "b"], ["c", "c"]]
    order = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "position bigint, row_id bigint")
    assert labels(f.reorder(order).unfold(2)) == list("bbccaa")


def test_repeat_each(abc, spark):
    from pyspark.sql import functions as F

    b = Batch(abc.df.withColumn("n", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), F.col("row_id").cast("int") + 1)))
    assert labels(b.repeat_each("n")) == list("aaabcc")


def test_unfold_column(spark):
    b = from_columns(spark, {"x": [[1, 2, 3, 4]] * 3, "labels": list("abc")}, "x array<bigint>, labels string").unfold_column(["x"], 2)
    assert labels(b) == list("aabbcc") and [r.x for r in b.df.orderBy("row_id").limit(2).collect()] == [[1, 2], [3, 4]]


def test_union_checks_common_columns(abc, spark):
    from pyspark.sql import functions as F

    assert set(abc.union(Batch(abc.df.select("row_id", "labels", F.lit(1).alias("n")))).df.columns) == {"row_id", "obs", "labels", "n"}
    with pytest.raises(Exception, match="differ"):
        abc.union(Batch(abc.df.select("row_id", F.lit("z").alias("labels")))).df.collect()


def test_slices(abc):
    assert labels(abc.slice(None, None, -1)) == list("cba")
    assert labels(abc.slice(-2)) == list("bc")
    assert labels(abc.slice(5, 9)) == []
    assert labels(abc.where("labels <> 'b'")) == list("ac")
