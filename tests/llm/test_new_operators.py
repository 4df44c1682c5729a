"""Conversation repair, filter audit and token counts against brute force, on edge cases, hot keys and empty tables."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest

from lintel.llm import conversations, filter_audit, queries, token_counts
from lintel.plans.storage import table

from .fixtures import SCHEMA, edge_rows
from .test_hot_groups import ROWS as HOT

ROWS = edge_rows()
SPACES = r"[^\x20\x09-\x0D]"
CONVERSATIONS = "conv_id long, turn long, role string, text string, times string, kind int, audit string"


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- conversations


def damaged(data):
    out = defaultdict(list)
    for conv, turn, role, text in data:
        word = lambda x: " " if x is None else str(x)
        kind = crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        out[conv] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def faults_of(convs):
    seen, out = set(), []
    for _, role, text in convs:
        body = re.findall(SPACES, text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(turns, faults):
    """Every assignment of edits and of up to two inserts per gap, by exhaustion."""
    best = None
    gap = ["", "u", "a", "ua", "au"]
    choices = []
    for (_, role, text), fault in zip(turns, faults):
        more = 3 if fault == "truncated" else 0
        some = [("D", 4, "", None)]
        if fault not in ("blank", "duplicate"):
            some += [("K", more, role[:1] or "-", (role, text)), ("R", 3 + more, "u", ("user", text)), ("R", 3 + more, "a", ("assistant", text))]
        choices.append(some)
    names = {"u": "user", "a": "assistant"}
    for edits in itertools.product(*choices):
        cost = sum(e[1] for e in edits)
        if best and cost > best[0]:
            continue
        for fill in itertools.product(gap, repeat=len(turns) + 1):
            price = cost + 3 * sum(map(len, fill))
            if best and price > best[0]:
                continue
            initials = fill[0] + "".join(e[2] + f for e, f in zip(edits, fill[1:]))
            if not re.fullmatch("(s?(ua)+)?", initials):
                continue
            audit = "I" * len(fill[0]) + "".join(e[0] + "I" * len(f) for e, f in zip(edits, fill[1:]))
            if best is None or (price, audit) < best[:2]:
                said = [(names[c], "") for c in fill[0]]
                for e, f in zip(edits, fill[1:]):
                    said += ([e[3]] if e[3] else []) + [(names[c], "") for c in f]
                best = (price, audit, said)
    return best


def dynamic_repair(turns, faults):
    """The same by a plain table of (cost, audit, turns) over all states, without pruning or settling."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}

    def close(paths):
        for _ in range(4):
            for s, (c, t, said) in list(paths.items()):
                for x in "ua":
                    if (s, x) in after:
                        new = (c + 3, t + "I", [*said, (names[x], "")])
                        to = after[s, x]
                        if to not in paths or new[:2] < paths[to][:2]:
                            paths[to] = new
        return paths

    paths = close({"": (0, "", [])})
    for (_, role, text), fault in zip(turns, faults):
        new = {}
        more = 3 if fault == "truncated" else 0
        for s, (c, t, said) in paths.items():
            some = [(s, (c + 4, t + "D", said))]
            if fault not in ("blank", "duplicate"):
                some += [(after[s, x], (c + 3 + more, t + "R", [*said, (names[x], text)])) for x in "ua" if (s, x) in after]
                if (s, role[:1]) in after:
                    some.append((after[s, role[:1]], (c + more, t + "K", [*said, (role, text)])))
            for to, p in some:
                if to not in new or p[:2] < new[to][:2]:
                    new[to] = p
        paths = close(new)
    return min((paths[s] for s in ("", "a")), key=lambda p: p[:2])


def brute_report(data, solve):
    out = []
    for conv, turns in damaged(data).items():
        faults = faults_of(turns)
        cost, audit, said = solve(turns, faults)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        n = Counter(faults)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest))
    return out


def talk(rnd, conv, n, roles=("user", "assistant", "system", "user", "assistant", "tool", "", None, "Ünser")):
    texts = ["Yes.", "No!", "so\n", "", " \t", None, "Straße?", "日本語", "a. b", "Yes."]
    return [(conv, rnd.choice([None, *range(12)]) if rnd.random() < 0.2 else i, rnd.choice(roles), rnd.choice(texts)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in data], CONVERSATIONS)


def report(df):
    return rows(conversations.repair_report(conversations.damage(df)))


def test_repair_by_exhaustion(spark):
    rnd = random.Random(3)
    data = [r for conv in range(40) for r in talk(rnd, conv, rnd.randint(1, 4), ("user", "assistant", "system", "tool"))]
    want = brute_report(data, lambda t, f: brute_repair(t[:5], f[:5]) if len(t) <= 5 else dynamic_repair(t, f))
    got = report(frame(spark, data))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(len(t) <= 5 for t in damaged(data).values()) >= 35


def test_repair_of_edge_cases(spark):
    rnd = random.Random(4)
    data = [r for conv in [None, *range(300)] for r in talk(rnd, conv, rnd.randint(1, 30))]
    data += data[:40] + [(900, None, None, None), (901, 5, "user", "x" * 300_000 + "."), (902, -4, "assistant", "Fine.")]
    want = brute_report(data, dynamic_repair)
    assert sorted(map(repr, report(frame(spark, data)))) == sorted(map(repr, want))
    assert report(frame(spark, [])) == []
    lost = next(c for c in range(2000, 4000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(frame(spark, [(lost, 0, "user", "Hello.")])) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_conversation_holds_most_rows(spark):
    """Long conversations settle as they go, also where they start with many deletions or no row can be kept."""
    rnd = random.Random(6)
    data = talk(rnd, 1, 3000) + talk(rnd, None, 700, ("tool", None)) + [(2, i, "assistant", "") for i in range(300)] + [(2, 300 + i, "system", f"S{i}.") for i in range(300)]
    data += [(3, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(2000)] + talk(rnd, 4, 1)
    df = frame(spark, data)
    want = brute_report(data, dynamic_repair)
    assert sorted(map(repr, report(df))) == sorted(map(repr, want))
    held = []
    repair = conversations.Repair(lambda *turn: None)
    for i in range(5000):
        repair.add(i, ("user", "assistant")[i % 2], f"{i}.")
        held.append(len(repair.pending))
    assert max(held) <= 128


def test_repaired_turns_are_what_the_report_digests(spark):
    rnd = random.Random(9)
    data = [r for conv in range(60) for r in talk(rnd, conv, rnd.randint(1, 12))]
    made = conversations.damage(frame(spark, data))
    turns = defaultdict(list)
    for r in sorted(conversations.repaired_turns(made).collect(), key=lambda r: (r["conv_id"], r["position"])):
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in conversations.repair_report(made).collect():
        assert hashlib.sha256("\n".join(turns[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]
        assert r["audit"].count("D") + len(turns[r["conv_id"]]) == len(r["audit"])


def test_repair_query(spark, sf_dir):
    got = queries.op11_conversations(spark, sf_dir)
    data = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(repr, rows(got))) == sorted(map(repr, brute_report(data, dynamic_repair)))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"] * 2


# ---- filters


def brute_audit(data, labels):
    first = {}
    for r in data:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    says = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            says[i][0] |= quality == 1
            says[i][1] |= toxic == 1
    parts = defaultdict(list)
    for r in data:
        t = r[1] or ""
        words = re.findall(SPACES + "+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": r[0] is not None and t in first and first[t] < r[0],
        }
        parts[r[3] or ""].append(({f for f, x in fails.items() if x}, says[r[0]] if r[0] is not None else [0, 0]))
    out = []
    for part, docs in parts.items():
        steps, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for s, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                fail = sum(f in d[0] for d in docs)
                steps.append((part, order, s + 1, len(left), len(gone), fail - len(gone), sum(d[0] == {f} for d in docs), sum(d[1][0] for d in gone), sum(d[1][1] for d in gone)))
                shapley[f] += len(gone)
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in steps]
    return out


LABELS = [(r[0], i % 2, int(i % 3 == 0)) for i, r in enumerate(ROWS) if i % 4] + [(4, 1, None), (None, 1, 1), (10**9, 1, 1)]


@pytest.mark.parametrize("data", [ROWS, HOT, [(None if i % 3 else 7, t, None, None, *[None] * 7) for i, t in enumerate(["x"] * 50 + ["A b " * 40, "", None])]])
def test_filter_audit(spark, data):
    docs = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(*x, "part", 1) for x in LABELS], "doc_id long, quality int, toxic int, part string, mask int")
    want = brute_audit(data, LABELS)
    assert sorted(rows(filter_audit.filter_audit(docs, labels))) == sorted(want)
    assert sorted(rows(filter_audit.filter_audit(docs, labels, parts_held=1))) == sorted(want)


def test_filter_audit_hot_and_empty(spark, monkeypatch):
    """Hot digests and ids go by broadcast, the rest by shuffle: the same rows."""
    from lintel.operators import skew

    docs, labels = spark.createDataFrame(HOT, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = brute_audit(HOT, LABELS)
    monkeypatch.setattr(skew, "max", lambda a, b: 3, raising=False)
    assert sorted(rows(filter_audit.filter_audit(docs, labels))) == sorted(want)
    monkeypatch.undo()
    none = spark.createDataFrame([], SCHEMA)
    assert rows(filter_audit.filter_audit(none, labels)) == []
    unlabelled = rows(filter_audit.filter_audit(docs, labels.limit(0)))
    assert sorted(r[:7] for r in unlabelled) == sorted(r[:7] for r in want) and not any(r[7] or r[8] for r in unlabelled)


def test_first_failures_and_windows():
    first = filter_audit.first_failures()
    assert first.shape == (32, 120) and (first[0] == 5).all() and (first[31] == 0).all()
    assert first[0b10010, filter_audit.ORDERS.index("ACEBD")] == 2
    text = ("word " * 400_000 + "wörter " * 50_000).encode()
    assert len(list(filter_audit._windows(text))) > 1 and b"".join(filter_audit._windows(text)) == text
    assert sum(len(w.split()) for w in filter_audit._windows(text)) == 450_000
    assert filter_audit.text_mask(text) == 0b00010


def test_filter_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cur = con.execute(filter_audit.ORACLE)
    columns = [d[0] for d in cur.description]
    got = queries.op12_filters(spark, sf_dir)
    assert got.columns == columns
    want = cur.fetchall()
    assert sorted(rows(got)) == sorted(want)
    docs = [(r["doc_id"], r["text"], None, r["source"]) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted(want) == sorted(brute_audit(docs, [tuple(r) for r in table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").collect()]))


# ---- tokens


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute_tokens(data, tokenizer):
    return [(r[0], len((r[1] or "").encode()), n := len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in data]


SPECIAL = [(50_001, "a<|endoftext|>b <|endoftext|>", None, None, *[None] * 7), (50_002, " \n\n  x  \t y\r\n", None, None, *[None] * 7), (50_003, "it's 12345 ½ ５ é …", None, None, *[None] * 7)]


@pytest.mark.parametrize("data", [ROWS + SPECIAL, HOT])
def test_token_counts(spark, data, whole, monkeypatch):
    docs = spark.createDataFrame(data, SCHEMA)
    want = brute_tokens(data, whole)
    got = token_counts.count_tokens(docs)
    assert sorted(map(repr, rows(got))) == sorted(map(repr, want))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "bigint", "boolean"]
    from lintel.operators import skew

    monkeypatch.setattr(skew, "max", lambda a, b: 2, raising=False)
    assert sorted(map(repr, rows(token_counts.count_tokens(docs, small_misses=0)))) == sorted(map(repr, want))


def test_cache_encodes_misses_only(spark, tmp_path, whole):
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame(ROWS, SCHEMA)
    half = spark.createDataFrame(ROWS[: len(ROWS) // 2], SCHEMA)
    distinct = lambda data: len({r[1] or "" for r in data})
    stored = lambda: spark.read.schema(token_counts.CACHE).parquet(cache)
    assert rows(token_counts.count_tokens(spark.createDataFrame([], SCHEMA), cache=cache)) == [] and not os.path.exists(f"{tmp_path}/cache")
    token_counts.count_tokens(half, cache=cache, small_misses=0).collect()
    assert stored().count() == distinct(ROWS[: len(ROWS) // 2])
    want = brute_tokens(ROWS, whole)
    once = f"file://{tmp_path}/once"
    token_counts.count_tokens(half, cache=once).collect()
    assert sorted(map(repr, rows(token_counts.count_tokens(docs, cache=once, small_misses=0)))) == sorted(map(repr, want))
    assert sorted(map(repr, rows(token_counts.count_tokens(docs, cache=cache)))) == sorted(map(repr, want))
    assert stored().count() == distinct(ROWS)
    # A count in the cache is believed, and not made anew; twice the same digest does not repeat a document.
    marked = stored().selectExpr("content", "n_tokens + 7 AS n_tokens", "tokenizer").collect()
    other = f"file://{tmp_path}/other"
    for _ in range(2):
        spark.createDataFrame(marked, token_counts.CACHE).write.mode("append").partitionBy("tokenizer").parquet(other)
    files = lambda: sum(len(names) for _, _, names in os.walk(f"{tmp_path}/other"))
    before = files()
    got = rows(token_counts.count_tokens(docs, cache=other))
    assert sorted(map(repr, got)) == sorted(repr((i, b, n + 7, n + 7 > 1024)) for i, b, n, _ in want)
    assert files() == before
    # Another tokenizer has counts of its own.
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(token_counts.count_tokens(docs, tokenizer=path, cache=cache))
    assert sorted(map(repr, got)) == sorted(repr((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 1024)) for r in ROWS)
    assert stored().select("tokenizer").distinct().count() == 2


def test_long_texts_are_counted_in_windows(whole):
    rnd = random.Random(2)
    bits = ["word", "It's", "  ", "\n", "\n\n ", "x1", "½", "é", "<|endoftext|>", "...", " ", "日本", "\t", "they'll", "12 34", "a", " ", "!"]
    count = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert count.cuts and not token_counts.counter(public_tokenizers.path("word_bpe_49k.json")).cuts
    for _ in range(300):
        text = "".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 120)))
        assert "".join(token_counts.windows(text, 7)) == text
        assert count.count([text], window=7) == [len(whole.encode(text, add_special_tokens=False).ids)]
    assert len(list(token_counts.windows("ab " * 1000, 30))) > 50
    assert count.count(["x" * 50_000, "", " "], window=10) == [len(whole.encode(t).ids) for t in ("x" * 50_000, "", " ")]


def test_token_query(spark, sf_dir, whole):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(rows(queries.op13_tokens(spark, sf_dir))) == sorted(brute_tokens(docs, whole))
    assert np.mean([r[3] for r in brute_tokens(docs, whole)]) > 0
