import itertools
import random

import pytest

from quillon.operators.components import connected_components
from quillon.plans.staging import release, stage


def test_stage_and_release(spark):
    df = stage(spark.range(5), "numbers")
    assert df.count() == 5 and df.dtypes == spark.range(1).dtypes
    path = df.inputFiles()[0]
    release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(20)] + [(7, 7), (7, 7), (3, None)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(j for j in parent if root(j) == root(i)) for i in parent}
    assert all(got[a] == got[b] for a, b in itertools.pairwise(range(100, 121)))


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
