"""Corpus operators do the whole job, not a part of it."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import ann, minhash, quality, sharding


def test_scorer_keeps_its_features_and_sample():
    assert quality.FEATURES == 4096
    assert all(inspect.signature(f).parameters["sample"].default == 2000 for f in (quality.train, quality.score, quality.keep_good))
    x = quality._dense(b"some words of a text", quality.measures(b"some words of a text"))
    cells = np.frombuffer(quality._sparse(x), quality._CELL)
    back = np.zeros_like(x)
    back[cells["at"]] = cells["value"]
    assert (back == x).all() and len(x) == 4096 + 2 * len(quality.LABELLERS) + 1


def test_split_looks_at_whole_words():
    at = [name for name, _, _ in quality.LABELLERS].index("split")
    assert quality.measures(b"2024-01-15T10:00Z 1234567890abc 12345678\xc3\xa9 word")[at] == 0
    assert quality.measures(b"2024-01-15 1234567890\n--- word")[at] == 0.75


def test_queries_in_sparse_regions_finish_their_search(spark):
    rng = np.random.default_rng(5)
    centres = 6 * rng.standard_normal((3, 24))
    x = np.concatenate([centres[rng.integers(0, 3, 2900)] + 0.3 * rng.standard_normal((2900, 24)), rng.standard_normal((60, 24))])
    ids = [20 * i + 1 for i in range(2900)] + [20 * i for i in range(60)]
    ids[:200] = [20 * (60 + i) for i in range(200)]
    data = [(i, v.tolist()) for i, v in zip(ids, x.astype(np.float32), strict=True)]
    got: dict[int, set] = {}
    for r in ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), sample=3).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    vectors = np.array([v for _, v in data])
    lone = range(2900, 2960)
    found = []
    for n in lone:
        s = vectors @ vectors[n]
        s[n] = -np.inf
        found.append(len({ids[j] for j in np.argsort(-s)[:20]} & got[ids[n]]) / 20)
    assert np.mean(found) >= 0.75  # 0.70 where a search may end at the partitions' prefix


def test_large_cells_hold_up_no_smaller_ones(spark):
    # Shard 0 has room for 100: the hot group's cell of 500 wants it too, and pulls harder.
    rows = [(1, 1, 0, 9, 900), (1, 1, 1, 5, 500)]
    rows += [(g, g, s, 1, b) for g in range(2, 7) for s, b in ((0, 12), (1, 10))]
    cells = spark.createDataFrame(rows, "g1 long, g2 long, start int, n long, bytes long")
    got = sharding.propagate(cells, 2, 1060.0, 6).collect()
    for g in range(2, 7):
        assert len({r["shard"] for r in got if r["g1"] == g}) == 1


def test_distance_filter_is_wide(spark):
    sigs = np.zeros((2, minhash.SYMBOLS), np.uint16)
    sigs[1, :28] = 1
    rows = [(7, bytes([i]), bytearray(s.tobytes()), bytes([i]), 0, 0) for i, s in enumerate(sigs)]
    members = spark.createDataFrame(rows, "key long, node binary, sig binary, label binary, size long, pos long")
    assert minhash._Linker(None, 5, 75).across(members, members, "node > v_node").count() == 1


def test_scattered_vectors_leave_the_partitions_of_the_rest_alone(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = 5 * rng.standard_normal((40, 32))
    tight = centres[rng.integers(0, 40, 3000)] + 0.05 * rng.standard_normal((3000, 32))
    passes = []
    plain = ann.ascend

    def watched(classes, queries, forest, k, want, depth, crowd, asks):
        passes.append((depth, queries.count()))
        return plain(classes, queries, forest, k, want, depth, crowd, asks)

    monkeypatch.setattr(ann, "ascend", watched)
    depths = []
    for scattered in (0, 30):
        passes.clear()
        x = np.concatenate([tight, 3 * rng.standard_normal((scattered, 32))])
        ids = [*range(3000), *range(20_000, 20_000 + 5 * scattered, 5)]  # one in four of the scattered is a query: 8 of 158
        df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x.astype(np.float32), strict=True)], "vec_id long, embedding array<float>")
        got: dict[int, list] = {}
        for r in ann.nearest(df).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        depths.append(passes[0][0])
        asked = [n for n, i in enumerate(ids) if i % 20 == 0]
        assert passes[0][1] == len(asked) == len(got) and all(len(v) == 20 for v in got.values())
        at = {i: n for n, i in enumerate(ids)}
        x = x.astype(np.float32).astype(float)
        shares = []
        for n in asked:
            s = x @ x[n]
            s[n] = -np.inf
            shares.append(len({at[i] for i in got[ids[n]]} & set(np.argsort(-s)[:20].tolist())) / 20)
        assert np.mean(shares) >= 0.9
        if scattered:
            assert len(passes) == 2 and passes[1][0] == passes[0][0] // 2 and passes[1][1] <= 60
    assert depths[0] >= 4 and abs(depths[0] - depths[1]) <= 2


def test_a_third_of_equal_vectors(spark):
    x = np.random.default_rng(9).standard_normal((300, 8)).astype(np.float32)
    x[:100] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[0].tolist())] * 50 + [(None, x[0].tolist())]
    got: dict[int, list] = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), aim=1.1, crowd=40, asks=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    x = x.astype(float)
    for q in range(0, 300, 20):
        s = np.round(x @ x[q], 9)
        s[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(300), -s))[:20].tolist()


@pytest.mark.parametrize("queue", [20_000, 50])
def test_room_is_not_divided(spark, queue):
    # A group of two cells, each half of a shard's room, beside 400 small groups of two cells: it joins however many cells are put in order together.
    small = [(g, g, s, 1, 10) for g in range(10, 410) for s in (g % 8, (g + 1 + g // 8) % 8)]
    rows = small + [(1, 1, 0, 1, 500), (1, 1, 1, 1, 500)]
    cells = spark.createDataFrame(sorted(set(rows)), "g1 long, g2 long, start int, n long, bytes long")
    got = sharding.propagate(cells, 8, 2600.0, 6, queue).collect()
    shards: dict[int, set] = {}
    load = [0] * 8
    for r in got:
        shards.setdefault(r["g1"], set()).add(r["shard"])
        if r["shard"] is not None:
            load[r["shard"]] += r["bytes"]
    assert len(got) == len(set(rows)) and max(load) <= 2600
    assert len(shards[1]) == 1 and None not in shards[1]
    assert sum(len(s) == 1 for s in shards.values()) >= 390


def test_queues_add_up_over_bands_and_salts(spark):
    rng = np.random.default_rng(3)
    data = [(int(rng.integers(1 << 40)), i, int(rng.integers(4)), int(rng.integers(1, 5000)), int(rng.integers(5))) for i in range(400)]
    df = spark.createDataFrame(data, "g1 long, g2 long, start int, bytes long, to int")
    got = sharding._queued(df, F.when(F.col("to") < 4, F.col("to")), 7).collect()
    for goal in range(4):
        mine = sorted((r["asked"], r["bytes"]) for r in got if r["to"] == goal)
        assert [a for a, _ in mine] == np.cumsum([b for _, b in mine]).tolist()
        assert [b.bit_length() for _, b in mine] == sorted(b.bit_length() for _, b in mine)
    assert len(got) == 400 and all(r["asked"] is None for r in got if r["to"] == 4)
