"""A third of all rows is one text, one source, one line or one vector: every operator against brute force, also at small task bounds."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lintel.llm import ann, embedding_dedup, licenses, line_dedup, minhash, mixing, packing, quality, substrings

from .fixtures import SCHEMA, brute_near, brute_repeats, same
from .test_operators import VECTORS, brute_lines, exact_nearest, rows


def hot_rows():
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    hot, line, passage = prose(45), "a line that very many of these documents have in common, word for word", prose(70)
    texts = [hot] * 60 + [f"{prose(12)}\n{line}\n{prose(5)}" for _ in range(40)] + [f"{prose(8)} {passage} {prose(8)}" for _ in range(40)]
    near = hot.split()
    texts += [" ".join(near[:i] + ["other"] + near[i + 1 :]) for i in range(20)] + [prose(rnd.randint(1, 60)) for _ in range(20)]
    return [(i + 1, t, "en", "hot" if i < 120 else f"s{i % 3}", len(t), 1, "c", 2, "s", 3, 4) for i, t in enumerate(texts)]


ROWS = hot_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_lines(docs):
    assert same(rows(line_dedup.line_report(docs, hot_share=3)), brute_lines(ROWS))


def test_near_duplicates(docs):
    want = brute_near(ROWS)
    assert len({r[2] for r in want}) < 130
    assert same(rows(minhash.near_duplicates(docs, hub_rounds=1, tile=8)), want)


def test_substrings(docs):
    want = brute_repeats(ROWS)
    assert same(rows(substrings.substring_report(docs, hot=5, shard_stretches=10)), want)


def test_mixing(docs):
    got = rows(mixing.mixing_report(docs, cell_rows=2))
    taken = defaultdict(int)
    for r in got:
        taken[r[2], r[3]] += r[4]
    assert all(abs(words - target) <= 75 for (_, target), words in taken.items())
    assert Counter(r[0] for r in got) == Counter(r[0] for r in ROWS)


def test_packing(docs):
    pieces = packing.pack(docs, group_bytes=3000).collect()
    sizes = defaultdict(int)
    for r in pieces:
        sizes[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert len(sizes) == len(ROWS) and all(n == k[1] for k, n in sizes.items())


def test_licenses_and_quality(docs):
    found = rows(licenses.license_report(docs))
    assert Counter(r[0] for r in found) == Counter(r[0] for r in ROWS) and not any(r[6] for r in found)
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert {r[0] for r in ROWS[:60]} <= kept and len({r[0] in kept for r in ROWS[:60]}) == 1


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((240, 12)).astype(np.float32)
    x[:80] = x[0]
    x[80:120] = x[0] + 0.02 * rng.standard_normal((40, 12)).astype(np.float32)
    data = [(i, v.tolist(), 1, 0, "") for i, v in enumerate(x)]
    df = spark.createDataFrame(data, VECTORS)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & ~np.eye(240, dtype=bool)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, tile=10).collect()}
    assert [got[i]["n_links"] for i in range(240)] == near.sum(axis=1).tolist()
    assert all(got[i]["component_id"] == 0 for i in range(120))
    found = defaultdict(list)
    for r in ann.nearest(df, crowd=30, asks=3, aim=1.1).collect():
        found[r["query_id"]].append(r["score"])
    want = exact_nearest(data)
    assert set(found) == set(want) and all(np.allclose(sorted(found[q], reverse=True), [s for _, s in v]) for q, v in want.items())
