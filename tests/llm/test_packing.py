import os
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.packing import TOKENIZER, encoder, pack, packed_room, shortest_pack_first


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_placings_cover_every_item_once_and_fit(lengths):
    placed, n = shortest_pack_first(Counter(lengths), 32)
    used = defaultdict(list)
    for length in set(lengths):
        ranges = sorted((lo, hi) for le, lo, hi, _, _ in placed if le == length)
        assert [lo for lo, _ in ranges] == [0, *(hi for _, hi in ranges[:-1])] and ranges[-1][1] == lengths.count(length)
    for length, lo, hi, first, start in placed:
        for k in range(hi - lo):
            used[first + k].append((start, length))
    assert sorted(used) == list(range(n))
    for items in used.values():
        items.sort()
        assert items[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(items, items[1:])) and sum(items[-1]) <= 32


def test_pattern_table_does_not_grow_with_the_texts():
    small = {k: (k * 7919) % 13 + 1 for k in range(1, 200)}
    a, _ = shortest_pack_first(small, 512)
    b, _ = shortest_pack_first({k: n * 10**9 for k, n in small.items()}, 512)
    assert len(b) <= 2 * len(a)


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")
def test_pack(spark):
    texts = [(k, "word " * (k % 40)) for k in range(200)] + [(7, "word " * 7), (None, "word " * 3), (300, None), (301, " \n"), (302, "long " * 500)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "id long, text string, length int")
    bins = spark.createDataFrame([("s", 32), ("m", 64), ("none", None), ("zero", 0), (None, 5)], "container string, capacity int")
    rows = pack(df, "id", "text", bins, "container", "capacity").collect()
    count = encoder(TOKENIZER).encode_ordinary
    for c, capacity in (("s", 32), ("m", 64)):
        mine = [r for r in rows if r.container == c]
        total = sum(len(count(t)) for _, t in texts if t and not t.isspace())
        assert sum(r.n_tokens for r in mine) == total
        by = defaultdict(list)
        for r in mine:
            by[r.sequence].append((r.start, r.n_tokens))
        for s in by.values():
            s.sort()
            assert s[0][0] == 0 and all(a + b == d for (a, b), (d, _) in zip(s, s[1:])) and sum(s[-1]) <= capacity
        assert {r.n_pieces for r in mine if r.id != 302} <= {1, 2} and sum(r.id == 302 for r in mine) == -(-len(count("long " * 500)) // capacity)
        assert len(by) <= 1.1 * total / capacity + 1
    assert {r.container for r in rows} == {"s", "m"}
    everywhere = ["container", "id", "piece", "n_pieces", "n_tokens", "sequence", "start"]
    joined = pack(df, "id", "text", bins, "container", "capacity", broadcast_rows=0).select(*everywhere).collect()
    assert Counter(map(tuple, joined)) == Counter(tuple(r[c] for c in everywhere) for r in rows)
    room = {r.container: r for r in packed_room(pack(df, "id", "text", bins, "container", "capacity"), bins, "container", "capacity").collect()}
    assert room["s"].unused == room["s"].n_sequences * 32 - room["s"].n_tokens
    assert pack(df.limit(0), "id", "text", bins, "container", "capacity").count() == 0
    assert pack(df, "id", "text", bins.limit(0), "container", "capacity").count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")
def test_null_and_repeated_ids(spark):
    """Each row is a text of its own, with a place of its own."""
    df = spark.createDataFrame([(None, "a b c")] * 40 + [(5, "d e f")] * 40, "id long, text string")
    bins = spark.createDataFrame([("s", 16)], "container string, capacity int")
    rows = pack(df, "id", "text", bins, "container", "capacity").collect()
    assert len(rows) == 80 == len({(r.sequence, r.start) for r in rows}) and sum(r.id is None for r in rows) == 40
