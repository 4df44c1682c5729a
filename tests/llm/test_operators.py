"""Each operator on the edge-case fixture and on an empty table, against brute force where there is one."""

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from lintel.llm import ann, embedding_dedup, licenses, line_dedup, minhash, mixing, packing, quality, sharding, substrings
from lintel.llm.textkernels import shingle_set

from .fixtures import SCHEMA, brute_near, brute_repeats, components, edge_rows, lower, same, shingles

ROWS = edge_rows()
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def n_words(t):
    return len(re.findall(WORD, t or ""))


def test_mixing_reaches_targets(docs, empty):
    got = mixing.mixing_report(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], n_words(r[1])) for r in ROWS)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got)
    sources = {r["source_size"]: r["target"] for r in got}
    assert abs(sum(sources.values()) - 1.5 * sum(sources)) < 1e-6
    assert all(t <= 2 * s + 1e-9 for s, t in sources.items())
    for size, target in sources.items():
        mine = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in mine) - target) <= max(r["size"] for r in mine) + 1
    assert same(rows(mixing.mixing_report(docs)), [tuple(r) for r in got])
    assert rows(mixing.mixing_report(empty)) == []


def test_mixing_does_not_depend_on_storage(spark, docs):
    """Any order of the input, ids that share all low digits, and null ids: the same copies, evenly spread."""
    data = [(i * 128 if i % 5 else None, f"word{i} " * (1 + i % 3), "s") for i in range(600)] + [(0, "a b", "t"), (None, "c d", "t"), (0, "e f", "t")]
    made = [spark.createDataFrame(d, "doc_id long, text string, source string").repartition(n) for d, n in ((data, 1), (data[::-1], 7))]
    a, b = (Counter((r["doc_id"], r["text"]) for r in mixing.mix(m).collect()) for m in made)
    assert a == b
    assert same(*(rows(mixing.mixing_report(m)) for m in made))
    assert same(rows(mixing.mixing_report(made[0], cell_rows=1)), rows(mixing.mixing_report(made[0])))
    heads = Counter(r[0][:1] for r in rows(made[0].select(mixing.order_digest())))
    assert len(heads) == 16 and max(heads.values()) < 3 * 600 / 16


def test_mix_emits_whole_rows(docs, empty):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = Counter({(r["doc_id"], r["size"]): 0 for r in mixing.mixing_report(docs).collect()})
    for r in mixing.mixing_report(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    assert Counter((r["doc_id"], n_words(r["text"])) for r in out.collect()) == +want
    assert rows(mixing.mix(empty)) == []


def brute_lines(data):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: lower(x.strip(strip))
    seen = defaultdict(set)
    for r in data:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 40:
                seen[key(x)].add(r[0])
    drop = {k: max(i for i in v if i is not None) for k, v in seen.items() if len(v - {None}) >= 5}
    out = []
    for r in data:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if key(x) not in drop or drop[key(x)] == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("share", [1000, 1])
def test_lines(docs, share):
    want = brute_lines(ROWS)
    assert sum(r[2] for r in want) > 5
    assert same(rows(line_dedup.line_report(docs, hot_share=share)), want)


def test_lines_hot_path_and_columns(docs, empty):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    want = Counter((r[0], r[3]) for r in brute_lines(ROWS))
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()) == want
    assert rows(line_dedup.line_report(empty)) == [] and rows(line_dedup.dedup_lines(empty)) == []


def test_near_duplicates(docs, empty):
    want = brute_near(ROWS)
    assert len({r[2] for r in want}) < len(want) - 5
    assert same(rows(minhash.near_duplicates(docs)), want)
    assert same(rows(minhash.near_duplicates(docs, hub_rounds=0)), want)
    assert same(rows(minhash.near_duplicates(docs, hub_rounds=0, tile=3)), want)
    assert rows(minhash.near_duplicates(empty)) == []


def test_keep_one(docs, empty):
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    sets = [shingles(r[1]) for r in ROWS]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    wordy = sum(1 for g in {tuple(g) for g in components(len(ROWS), links)} if sets[g[0]])
    got = out.collect()
    assert sum(1 for r in got if shingles(r["text"])) == wordy
    assert sum(1 for r in got if not shingles(r["text"])) == sum(1 for s in sets if not s)
    assert rows(minhash.keep_one(empty)) == []


def test_shingle_sets_are_exact():
    for r in ROWS:
        assert len(shingle_set(r[1])) == len(shingles(r[1]))


@pytest.mark.parametrize("distance", [19, minhash.DISTANCE])
def test_signature_index_guarantees_the_distance(distance):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype(np.uint16)
    for _ in range(300):
        b = a.copy()
        at = rng.choice(minhash.SYMBOLS, distance, replace=False)
        b[at] ^= np.uint16(1)
        assert (minhash.chunk_keys(a[None]) == minhash.chunk_keys(b[None])).any()


def test_signature_guarantee_is_tight():
    """One difference more, spread evenly over the chunks, can escape the index."""
    a = np.arange(minhash.SYMBOLS, dtype=np.uint16)
    b = a.copy()
    b.reshape(-1, minhash.CHUNK)[:, : minhash.ERRORS + 1] ^= np.uint16(1 << 15)
    assert (a != b).sum() == minhash.DISTANCE + 1
    assert not (minhash.chunk_keys(a[None]) == minhash.chunk_keys(b[None])).any()


def test_substrings(docs, empty):
    want = brute_repeats(ROWS)
    assert sum(r[2] for r in want) > 2000
    assert same(rows(substrings.substring_report(docs)), want)
    assert same(rows(substrings.substring_report(docs, hot=1)), want)
    assert same(rows(substrings.substring_report(docs, shard_stretches=40)), want)
    assert rows(substrings.substring_report(empty)) == []


def test_stretches_of_long_texts_are_cut_in_parts():
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 101, 5000).astype(np.uint8))
    m, w, first, last, where = substrings.stretches(text, 200, 48, part=700)
    whole = substrings.stretches(text, 200, 48)
    starts = lambda f, z, m_: {s: x for a, b, x in zip(f.tolist(), z.tolist(), m_.tolist()) for s in range(a, b + 1)}
    assert starts(first, last, m) == starts(whole[2], whole[3], whole[0]) and len(starts(first, last, m)) == 4801
    at = dict(zip(where.tolist(), m.tolist()))
    assert all(at[p] == x for p, x in zip(whole[4].tolist(), whole[0].tolist()))


def test_boundaries_are_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = rng.integers(1, 4, 200)
        text[-1] = 0
        order = substrings.suffix_array(text, 6)
        mark = substrings.boundaries(text, order, 6)
        for i in range(1, len(text)):
            a, b = list(text[order[i - 1] :][:6]), list(text[order[i] :][:6])
            if len(a) == 6 and 0 not in a:
                assert mark[i] == (a != b)


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs, group_bytes=20_000).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    want = defaultdict(list)
    for r in ROWS:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want[r[0], len(ids)].append(ids)
    assert set(by_doc) == set(want)
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        n = len(want[k])
        assert sum(r["length"] for r in pieces) == n * k[1]
        if n == 1:
            at = 0
            for r in pieces:
                assert r["start"] == at
                assert r["ids_crc32"] == crc32(np.array(want[k][0][at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    one = packing.pack(docs).collect()
    total = sum(r["length"] for r in one)
    assert len({r["sequence_id"] for r in one}) - total // 2048 <= 2
    assert rows(packing.pack(empty)) == []


def test_chunk_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    enc = packing.ChunkEncoder(packing.default_tokenizer(), chunks=50, runs=20)
    assert enc.fast
    hard = ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x400, 64)] + [f"a{chr(c)}b {chr(c)}'S {chr(c)}1" for c in range(1, 0x250)]
    texts = ["It's  a test\x1cof <|endoftext|>x <|start of", "é Å   ̀x", "  ", "\r\n\tdon't 12ab   x", "ΑΣ ΑΣ. İ", *[r[1] or "" for r in ROWS]]
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_sharding(docs, empty, spark):
    for data, shards in ((docs, 5), (docs.unionByName(docs).unionByName(docs), 7)):
        got = sharding.shard(data, shards=shards).collect()
        base = data.collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 16) for r in base)
        assert Counter(r["text_crc32"] for r in got) == Counter(crc32((r["text"] or "").encode()) for r in base)
        for s in range(shards):
            mine = sorted(r["slot"] for r in got if r["shard"] == s)
            assert mine == list(range(len(mine)))
        loads = Counter()
        for r in got:
            loads[r["shard"]] += r["size"]
        assert max(loads.values()) <= sum(loads.values()) / shards + max(r["size"] for r in got)
    assert rows(sharding.shard(empty)) == []


def test_sharding_depends_on_rows_alone(spark, docs):
    """Other files and partitions, dealing one by one or along the gaps: equal rows, sizes near equal."""
    data = [(i, f"text {i % 400} " * (1 + i % 9)) for i in range(3000)] + [(9000 + i, "one hot text " * 3) for i in range(1500)] + [(20000, "long " * 900)]
    made = [spark.createDataFrame(d, "doc_id long, text string").repartition(n) for d, n in ((data, 1), (data[::-1], 6))]
    one, two = (rows(sharding.shard(m, shards=8)) for m in made)
    assert same(one, two)
    for few in (0, 10_000):
        got = sharding.shard(made[0], shards=8, few=few, salt_rows=20).collect()
        loads = Counter()
        for r in got:
            loads[r["shard"]] += r["size"]
        assert len(got) == len(data) and max(loads.values()) <= 1.02 * sum(loads.values()) / 8 + 4600
        for s in range(8):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert same(rows(sharding.shard(docs, shards=3)), rows(sharding.shard(docs.repartition(5), shards=3)))


def test_sharding_keeps_groups_together(spark):
    data = spark.createDataFrame([(i, f"text {i // 3} " * 20) for i in range(900)] + [(i, f"single {i} " * 20) for i in range(900, 1500)], "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(data, shards=10).collect()}
    whole = sum(1 for g in range(300) if len({got[3 * g + k] for k in range(3)}) == 1)
    assert whole >= 290


def test_licenses(spark, docs, empty):
    t = licenses.TEMPLATES
    texts = [
        (1, "Under the MIT License, MIT license."), (2, "filler " * 300 + t["gpl-notice"].upper() + " filler" * 200), (3, None), (4, ""),
        (5, " ".join(t["isc-notice"].split()[:12])), (6, "The Apache-License; GENERAL PUBLIC\nLICENSE"), (6, "The Apache-License; GENERAL PUBLIC\nLICENSE"), (7, "mité license"), (8, t["bsd-notice"]), (None, "mit license mit license"),
    ]
    got = rows(licenses.license_report(spark.createDataFrame(texts, "doc_id long, text string")))
    by = {r[0]: r for r in got}
    assert len(got) == len(texts) and got.count(by[6]) == 2
    assert by[1][1:6] == (6, 2, 2, 4, "mit")
    assert by[2][6] == "gpl,gpl-notice" or set(by[2][6].split(",")) >= {"gpl", "gpl-notice"}
    assert by[3][1:] == (0, 0, None, None, "", "", 0.0) and by[4][1:] == by[3][1:]
    assert by[5][6] == "" and by[6][2] == 2 and by[6][5] == "apache,gpl"
    assert by[7][2] == 0 and "bsd-notice" in by[8][6].split(",") and by[8][7] == 1.0
    assert by[None][2] == 2
    assert len(rows(licenses.license_report(docs))) == len(ROWS)
    assert rows(licenses.license_report(empty)) == []


def brute_passages(texts, threshold):
    """Every document and template with the most that L consecutive words hold, by sliding over all words."""
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    span = max(len(cut(x)) for x in licenses.TEMPLATES.values())
    out = {}
    for i, text in texts:
        ws = cut(text)
        for label, template in licenses.TEMPLATES.items():
            tokens = set(cut(template))
            best = max((len(tokens & set(ws[s : s + span])) for s in range(len(ws))), default=0)
            if best >= np.ceil(threshold * len(tokens) - 1e-9):
                out[i, label] = best / len(tokens)
    return out


def test_license_join_is_exact(spark):
    rnd = np.random.default_rng(2)
    sets = licenses._template_sets(licenses.TEMPLATES)
    texts = []
    for i in range(60):
        tokens = list(sets.values())[i % len(sets)]
        keep = [w for w in tokens if rnd.random() < 0.6 + 0.4 * rnd.random()]
        rnd.shuffle(keep)
        texts.append((i, " ".join(["zzz"] * int(rnd.integers(0, 200)) + keep + ["qqq"] * int(rnd.integers(0, 200)))))
    texts += [(100 + i, " ".join(rnd.choice([w for t in sets.values() for w in t], 400))) for i in range(10)]
    found = licenses.matching_passages(spark.createDataFrame(texts, "doc_id long, text string"), threshold=0.7).collect()
    got, want = {(r["doc_id"], r["label"]): r["containment"] for r in found}, brute_passages(texts, 0.7)
    assert got == want and len(want) > 10


def test_license_passages_at_every_offset(spark):
    """A passage exactly at the threshold, first and last word of the longest template included, wherever it starts."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", licenses.TEMPLATES["apache-2.0-notice"])
    distinct, drop = list(dict.fromkeys(words)), set()
    assert len(words) == licenses.longest(licenses.TEMPLATES)
    for w in distinct:
        if len(distinct) - len(drop) > np.ceil(0.8 * len(distinct) - 1e-9) and w not in (words[0], words[-1]) and words.count(w) == 1:
            drop.add(w)
    passage = " ".join("zzz" if w in drop else w for w in words)
    texts = [(i, " ".join(["qqq"] * i + [passage] + ["qqq"] * 150)) for i in range(130)]
    got = {r["doc_id"]: r["first_word"] for r in licenses.matching_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect() if r["label"] == "apache-2.0-notice"}
    assert got == {i: i for i in range(130)}


VECTORS = "vec_id long, embedding array<float>, label int, node int, codes string"


def vector_rows(n=400, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x[50:80] = x[20:50] + 0.05 * rng.standard_normal((30, dims)).astype(np.float32)
    x[80:110] = x[20]
    x[110:120] *= 7
    out = [(i, x[i].tolist(), int(i % 3), 1, "c") for i in range(n)]
    for i, v in ((401, None), (420, [0.0] * dims), (440, [float("nan")] + [1.0] * (dims - 1)), (460, [float("inf")] + [1.0] * (dims - 1)), (480, [None] + [1.0] * (dims - 1)), (500, [1.0, 2.0])):
        out.append((i, v, 1, 1, "c"))
    out += [(520, x[20].tolist(), None, 1, "c"), out[85], (None, x[20].tolist(), 2, 1, "c")]
    return out


def good(v, dims=16):
    return v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_embedding_dedup(spark):
    data = vector_rows()
    df = spark.createDataFrame(data, VECTORS)
    x = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if good(r[1]) and r[2] is not None else None for r in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if x[i] is not None and x[j] is not None and data[i][2] == data[j][2] and x[i] @ x[j] >= 0.93]
    n = Counter(i for pair in links for i in pair)
    want = []
    for i, g in enumerate(components(len(data), links)):
        ids = [data[j][0] for j in g if data[j][0] is not None]
        c = min(ids) if ids else None
        want.append((data[i][0], n[i], c, data[i][0] == c))
    assert len(links) > 100
    assert same(rows(embedding_dedup.near_vectors(df)), want)
    assert same(rows(embedding_dedup.near_vectors(df, tile=7)), want)
    assert rows(embedding_dedup.near_vectors(df.where("false"))) == []


def exact_nearest(data, k=20):
    rows_ = {r[0]: np.array(r[1], float) for r in data if r[0] is not None and good(r[1], len(data[0][1]))}
    ids = np.array(sorted(rows_))
    m = np.stack([rows_[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = m @ rows_[q]
        order = [i for i in np.lexsort((ids, -np.round(s, 9))) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), s[i]) for i in order]
    return out


def test_nearest_small_is_exact(spark):
    data = vector_rows()
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(data, VECTORS), aim=1.1).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = exact_nearest(data)
    assert set(got) == set(want)
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found]
        assert np.allclose([s for _, s in got[q]], [s for _, s in found])
    few = spark.createDataFrame(data[:5], VECTORS)
    assert len(rows(ann.nearest(few))) == 4
    assert rows(ann.nearest(few.where("false"))) == []


@pytest.mark.parametrize("crowd, asks", [(65536, 4096), (300, 20)])
def test_nearest_recall(spark, crowd, asks):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([centres[rng.integers(0, 60, 2000)] + 0.4 * rng.standard_normal((2000, 32)), rng.standard_normal((1000, 32))]).astype(np.float32)
    data = [(i, v.tolist(), 0, 0, "") for i, v in enumerate(x)]
    got = defaultdict(set)
    for r in ann.nearest(spark.createDataFrame(data, VECTORS), crowd=crowd, asks=asks).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = exact_nearest(data)
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    recall = np.mean([len(got[q] & {i for i, _ in found}) / 20 for q, found in want.items()])
    assert recall >= 0.9


def test_nearest_recall_on_the_given_vectors(spark):
    """Vectors with almost no structure, all queries against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = exact_nearest([tuple(r) for r in df.select("vec_id", "embedding").collect()])
    got = defaultdict(set)
    for r in ann.nearest(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in found}) / 20 for q, found in want.items()]) >= 0.9


def brute_quality(texts):
    """The model document by document: votes, EM without patterns, plain gradient steps in double precision."""
    ms = [quality.measures(t.encode()) for t in texts]
    vs = [[2 if m >= junk else 0 if m <= clean else 1 for m, (_, junk, clean) in zip(row, quality.LABELLERS)] for row in ms]
    post = [1 / (1 + np.exp(-(3.0 * v.count(2) - 0.5 * v.count(0) + 0.5))) for v in vs]
    for _ in range(200):
        share = (1 + sum(post)) / (10 + len(post))
        table = [[[6.0, 3.0, 1.0] for _ in quality.LABELLERS], [[1.0, 3.0, 2.0] for _ in quality.LABELLERS]]
        for p, v in zip(post, vs):
            for k, x in enumerate(v):
                table[0][k][x] += 1 - p
                table[1][k][x] += p
        odds = [np.log(share / (1 - share)) + sum(np.log(table[1][k][x] / sum(table[1][k])) - np.log(table[0][k][x] / sum(table[0][k])) for k, x in enumerate(v)) for v in vs]
        new = [1 / (1 + np.exp(-min(50, max(-50, o)))) for o in odds]
        done, post = max(abs(a - b) for a, b in zip(new, post)) < 1e-6, new
        if done:
            break
    x = []
    for t, m, v in zip(texts, ms, vs):
        b, grams = t.encode(), Counter()
        pair = lambda i: ((b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA77) % 2**32) >> 7  # noqa: B023, E731
        for i in range(len(b) - 1):
            grams[pair(i) % quality.FEATURES] += 1
        for i in range(len(b) - 2):
            grams[(((pair(i) * 0xC2B2AE3D + b[i + 2] * 0x27D4EB2F) % 2**32) >> 9) % quality.FEATURES] += 1
        row = np.zeros(quality.FEATURES + 2 * len(v) + 1)
        for g, n in grams.items():
            row[g] = np.sqrt(n / max(1, 2 * len(b) - 3))
        row[quality.FEATURES :] = [float(a == 2) for a in v] + [float(a == 0) for a in v] + [1.0]
        x.append(row)
    x, y = np.array(x), 1 - np.array(post)
    weight = np.where(y > 0.5, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    step, w, old = 4.0 / ((x * x).sum(axis=1).max() * weight.sum() + 1e-4), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    ahead = w
    for i in range(300):
        p = 1 / (1 + np.exp(-(x @ ahead)))
        old, w = w, ahead - step * (x.T @ (weight * (p - y)) + 1e-4 * ahead)
        ahead = w + i / (i + 3) * (w - old)
    return 1 / (1 + np.exp(-(x @ w)))


def test_quality_is_the_brute_force_model(spark):
    rnd = np.random.default_rng(11)
    prose = lambda n: " ".join("".join(rnd.choice(list("abcdefgh"), rnd.integers(2, 8))) for _ in range(n))
    texts = [prose(int(rnd.integers(20, 60))) for _ in range(60)] + ["$$ ## !! " * 9 + prose(3) for _ in range(12)] + ["WIN 99 NOW!! " * int(rnd.integers(5, 20)) for _ in range(12)]
    texts = list(dict.fromkeys(texts))
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert np.abs(np.array([got[i] for i in range(len(texts))]) - brute_quality(texts)).max() < 1e-3


def test_quality_draws_copies_once(spark):
    """A text that is most of the table neither fills the sample nor decides the others."""
    rnd = np.random.default_rng(12)
    prose = lambda n: " ".join("".join(rnd.choice(list("abcdefgh"), rnd.integers(2, 8))) for _ in range(n))
    texts = [prose(40) for _ in range(80)] + ["@@ ** ^^ %% " * 8 + prose(2) for _ in range(20)] + [prose(40)] * 300
    got = {r["doc_id"]: r["keep"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sample=40).collect()}
    assert sum(got[i] for i in range(80)) >= 78 and not any(got[i] for i in range(80, 100)) and got[399]


def test_quality_on_edges(docs, empty, spark):
    got = rows(quality.score(docs))
    assert len(got) == len(ROWS) and all(0 <= r[1] <= 1 and r[2] == (r[1] >= 0.5) for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in got if r[2])
    assert rows(quality.score(empty)) == [] and rows(quality.keep_good(empty)) == []
    assert not any(r[2] for r in quality.score(spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")).collect())


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.score(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good_ = [r["keep"] for r in got if r["quality"] == 1]
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert sum(good_) / len(good_) >= 0.97 and sum(bad) / len(bad) <= 0.2


def test_em_recovers_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(20000) < 0.15
    v = np.stack([np.where(rng.random(20000) < p, np.where(y, 2, 0), np.where(y, 0, 2)) for p in (0.95, 0.9, 0.85, 0.8)] + [np.ones(20000, int)] * 4, axis=1)
    patterns, inverse, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post, accuracy, share = quality.em(patterns, counts.astype(float))
    assert abs(share - 0.15) < 0.03 and abs(accuracy[1, 0, 2] - 0.95) < 0.04
    assert ((post[inverse.ravel()] > 0.5) == y).mean() > 0.95
