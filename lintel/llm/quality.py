"""Quality classifier: a weak-label model over heuristics, then a hashed linear scorer.

Heuristic labellers each vote junk, clean or nothing on every document. Expectation-maximisation
over the counts of vote patterns (all documents; at most 3^labellers patterns) estimates each
labeller's accuracies and the share of junk; a pattern's posterior is the label of its documents. A
logistic scorer on hashed byte n-grams and the vote features is then fitted to the posteriors,
on at most 2 x ``sample`` distinct texts (a documented bound), and scores every whole text. A document is
kept if its score, the probability of being clean, is at least 0.5.

Scale: two scans, no shuffle of texts; what moves is one row per vote pattern and task. The
model is fitted on the driver from the bounded sample (66 MB by default, sent as sparse rows) and is 4096 weights.

Edge cases: a null or empty text and one without words score 0 and are rejected; repeated rows get equal
scores, count as often as they stand in the votes and once in the sample, however many they are; a null id
is kept; a very long text is measured whole; ties in score do not arise in a decision at a fixed limit; other
columns are not read, or pass through ``keep_good`` by position and cannot clash; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.plans.storage import small_batches

FEATURES = 4096
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
_BARE = re.compile(rb"(?<![^ \t\n\x0b\x0c\r])[^ \t\n\x0b\x0c\rA-Za-z\x80-\xff]++(?![^ \t\n\x0b\x0c\r])")  # a whole word without a letter
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CALM = np.zeros(256, bool)  # punctuation of plain prose
_CALM[[ord(c) for c in ".,;:'\"()-?"]] = True

#: (name, junk when the measure is at least, clean when it is at most)
LABELLERS = (
    ("symbols", 0.06, 0.015),  # share of signs that prose does not use
    ("shouting", 0.5, 0.15),  # share of capitals among ASCII letters
    ("ragged", 0.35, 0.05),  # share of words with a sign repeated at their end
    ("split", 0.2, 0.02),  # share of words without a letter
    ("echo", 0.5, 0.25),  # share of lines that occurred before
    ("loops", 0.75, 0.5),  # share of words that are repeats, beyond what length explains
    ("digits", 0.3, 0.05),  # share of digits
    ("stretched", 14.0, 9.5),  # mean length of words
)


def measures(text: bytes) -> np.ndarray | None:
    """The labellers' measures of a whole text; None without words."""
    words = _WORD.findall(text)
    if not words:
        return None
    a = np.frombuffer(text, np.uint8)
    count = np.bincount(a, minlength=256)
    letters, solid = count[_LETTER].sum(), len(a) - count[_BLANK].sum()
    ascii_letters = max(1, count[65:91].sum() + count[97:123].sum())
    signs = solid - letters - count[_DIGIT].sum() - count[_CALM].sum()
    ragged = sum(1 for w in words if len(w) > 2 and w[-1] == w[-2] and not _LETTER[w[-1]])
    bare = len(_BARE.findall(text))
    lines = [x for x in text.split(b"\n") if len(x) > 20]
    distinct = len(set(words))
    expected = min(len(words), 3.0 * len(words) ** 0.7)
    return np.array(
        [
            signs / solid,
            count[_UPPER].sum() / ascii_letters,
            ragged / len(words),
            bare / len(words),
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            max(0.0, 1 - distinct / expected),
            count[_DIGIT].sum() / solid,
            solid / len(words),
        ]
    )


def votes(m: np.ndarray) -> np.ndarray:
    """2 for junk, 0 for clean, 1 for no opinion."""
    junk, clean = np.array([x[1] for x in LABELLERS]), np.array([x[2] for x in LABELLERS])
    return np.where(m >= junk, 2, np.where(m <= clean, 0, 1))


def features(text: bytes, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams and trigrams (indices, equal weights) and the vote features."""
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    pairs = (a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)) >> np.uint32(7)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F)
    grams = np.concatenate((pairs, triples >> np.uint32(9))) % np.uint32(FEATURES)
    v = votes(m)
    return grams, np.concatenate((v == 2, v == 0)).astype(float)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of junk per pattern, accuracies[class, labeller, vote], share of junk).

    Labellers are taken as independent given the class. Starts from the balance of votes, and each
    labeller is expected to be right more often than wrong (a prior of a few pseudo-counts).
    """
    k = patterns.shape[1]
    onehot = (patterns[:, :, None] == np.arange(3)).astype(float)
    prior = np.array([[6.0, 3.0, 1.0], [1.0, 3.0, 2.0]])
    post = 1 / (1 + np.exp(-(3.0 * (patterns == 2).sum(axis=1) - 0.5 * (patterns == 0).sum(axis=1) + 0.5)))
    share, accuracy = 0.1, np.zeros((2, k, 3))
    for _ in range(rounds):
        share = (1 + (counts * post).sum()) / (10 + counts.sum())
        for c, weight in enumerate((counts * (1 - post), counts * post)):
            table = np.einsum("p,pkv->kv", weight, onehot) + prior[c]
            accuracy[c] = table / table.sum(axis=1, keepdims=True)
        logs = np.einsum("pkv,ckv->cp", onehot, np.log(accuracy))
        odds = np.log(share / (1 - share)) + logs[1] - logs[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - post).max() < 1e-6 if len(new) else True
        post = new
        if done:
            break
    return post, accuracy, share


def _vote_counts(batches):
    seen: dict[bytes, int] = {}
    for batch in batches:
        for text in batch.column("text").to_pylist():
            m = measures((text or "").encode("utf-8", "surrogatepass"))
            if m is not None:
                key = votes(m).astype(np.uint8).tobytes()
                seen[key] = seen.get(key, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])


def _dense(text: bytes, m: np.ndarray) -> np.ndarray:
    grams, extra = features(text, m)
    x = np.bincount(grams, minlength=FEATURES) / max(1, len(grams))
    return np.concatenate((np.sqrt(x), extra, [1.0])).astype(np.float32)


_CELL = np.dtype([("at", "<u2"), ("value", "<f4")])


def _sparse(x: np.ndarray) -> bytes:
    """The cells of a row that are not zero."""
    cells = np.zeros(np.count_nonzero(x), _CELL)
    cells["at"] = np.flatnonzero(x)
    cells["value"] = x[cells["at"]]
    return cells.tobytes()


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, classes weighted to balance, by accelerated gradient steps."""
    up = y.sum()
    if not 0 < up < len(y):
        return np.concatenate((np.zeros(x.shape[1] - 1), [10.0 if up else -10.0]))
    weight = np.where(y > 0.5, 0.5 / up, 0.5 / (len(y) - up))
    step = 4.0 / (np.einsum("ij,ij->i", x, x).max() * weight.sum() + l2)
    w = v = np.zeros(x.shape[1])
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v.astype(x.dtype), -30, 30)))
        new = v - step * (x.T @ (weight * (p - y)).astype(x.dtype) + l2 * v)
        v = new + i / (i + 3) * (new - w)
        w = new
    return w


def train(docs: DataFrame, sample: int = 2000) -> np.ndarray:
    """The scorer's weights; 2 x ``sample`` bounds the documents it is fitted on, the votes cover all."""
    small_batches(docs.sparkSession)
    texts = docs.select("text")
    rows = texts.mapInArrow(_vote_counts, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3^8 rows
    if not rows:
        return np.zeros(FEATURES + 2 * len(LABELLERS) + 1)
    patterns = np.array([list(r["pattern"]) for r in rows])
    counts = np.array([r["n"] for r in rows], float)
    post, _, _ = em(patterns, counts)
    label = {bytes(r["pattern"]): 1 - p for r, p in zip(rows, post, strict=True)}
    # A sample by hash, spread over both classes: rarer labels are drawn as often as commoner ones.
    junk = float((counts * (post > 0.5)).sum())
    rates = [min(1.0, sample / 2 / max(1.0, n)) for n in (counts.sum() - junk, junk)]

    def draw(batches):
        seen: set[int] = set()  # of this task; at most the drawn share of its texts
        for batch in batches:
            for text, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True):
                body = (text or "").encode("utf-8", "surrogatepass")
                low = (h & 0xFFFFFFFF) / 2**32
                if low >= max(rates) or h in seen:
                    continue
                seen.add(h)
                m = measures(body)
                if m is None:
                    continue
                clean = label.get(votes(m).astype(np.uint8).tobytes(), 0.5)
                if low < rates[int(clean < 0.5)]:
                    yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([clean]), pa.array([_sparse(_dense(body, m))], pa.binary())], ["h", "y", "x"])

    drawn = texts.select("text", F.xxhash64(F.lit(31), "text").alias("h")).mapInArrow(draw, "h long, y double, x binary")
    drawn = drawn.groupBy("h").agg(F.first("y").alias("y"), F.first("x").alias("x")).orderBy("h").limit(2 * sample).collect()  # copies are drawn once
    x = np.zeros((len(drawn), FEATURES + 2 * len(LABELLERS) + 1), np.float32)
    for row, r in zip(x, drawn, strict=True):
        cells = np.frombuffer(r["x"], _CELL)
        row[cells["at"]] = cells["value"]
    return fit(x, np.array([r["y"] for r in drawn])) if len(x) else np.zeros(x.shape[1])


def score(docs: DataFrame, weights: np.ndarray | None = None, sample: int = 2000) -> DataFrame:
    """doc_id, score and keep for every row of ``docs``."""
    weights = train(docs, sample) if weights is None else weights
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            s = [_probability(t, weights) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array([x >= 0.5 for x in s])], ["doc_id", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, keep boolean")


def _probability(text: str | None, weights: np.ndarray) -> float:
    body = (text or "").encode("utf-8", "surrogatepass")
    m = measures(body)
    return 0.0 if m is None else float(1 / (1 + np.exp(-np.clip(_dense(body, m) @ weights, -30, 30))))


def keep_good(docs: DataFrame, sample: int = 2000) -> DataFrame:
    """The documents that the classifier keeps, columns unchanged."""
    weights = train(docs, sample)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([_probability(t, weights) >= 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
