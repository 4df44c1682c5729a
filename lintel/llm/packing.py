"""Cost-balanced packing of token sequences.

Texts are tokenised once. A document's ids (with an end id) are cut in full sequences and a rest.
Documents are dealt by hash to groups of bounded bytes; a group holds the rests and packs
them: the number of sequences is the least that can hold them, every piece has an estimated
cost of ``linear * n + quadratic * n^2`` (attention), and pieces, longest first, go to the sequence
of lowest cost that has room. A piece that fits nowhere is cut at the largest room left, and its
tail queues again. So a group wastes less than one sequence.

Tokenising: the tokenizer drops white space between words, so a text's ids are those of
its chunks between spaces, in order. Chunks and the runs they are cut in are merged once and
kept in bounded memories; a probe and tests hold the ids to the whole tokenizer's.

Scale: one shuffle of 2 (or 4) bytes a token. The number of groups follows from the bytes of all
texts, so a group fits in memory at any size.

Edge cases: a null or empty text is the end id alone; repeated rows are separate documents; a null id is
kept; texts longer than a sequence, however long, are cut; pieces of equal length go by row key, checksum and
start, so reruns agree; columns besides doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import row_key
from lintel.plans.storage import small_batches

#: Chunks that the fast path may normalise itself: visible Latin-1 without control characters,
#: where composition changes nothing and lower-casing is one to one.
_PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u00ff]+")
#: Fixed value: how the tokenizer's file cuts a chunk before merging.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_loaded: dict = {}


def _byte_letters() -> dict[int, str]:
    """Latin-1 code points to the letters that byte-level models write them with."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class _Memory:
    """A bounded dictionary of two generations: what was not asked for lately is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit // 2, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class ChunkEncoder:
    """Encodes texts by chunks between spaces, and chunks by the runs they are cut in.

    Both levels are remembered up to a bound. Chunks outside plain Latin-1, and those that may hold
    a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str, chunks: int = 200_000, runs: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks, self.runs, self.letters = _Memory(chunks), _Memory(runs), _byte_letters()
        self.fast = self._fits()

    def _fits(self) -> bool:
        """The fast path knows this tokenizer's cutting and agrees with it on a probe."""
        self.fast = True
        probe = ["It's", "Stra\u00dfe\u00c9t\u00e9,", "ab12\u00b2'll!!", "###a_b"]
        return all(self._chunk(c) == self._whole(c) for c in probe)

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        runs = self.runs
        found = runs.young.get(run)
        if found is None:
            found = runs.old.get(run)
            if found is None:
                shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
                found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            runs.put(run, found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        low = chunk.lower()
        if self.fast and chunk.isascii() and low.isalpha():
            return self._run(low)
        if not self.fast or "<|" in chunk or not _PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        if low.isalpha():
            return self._run(low)
        return b"".join([self._run(r) for r in _PIECES.findall(low)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out, chunks = [], self.chunks
        for text in texts:
            parts = text.replace("\n", " ").split(" ")
            row = list(map(chunks.young.get, parts))
            if None in row:
                for i, found in enumerate(row):
                    if found is None:
                        c = parts[i]
                        found = chunks.young.get(c)  # it may have come with this text
                        if found is None:
                            found = chunks.old.get(c)
                            chunks.put(c, self._chunk(c) if found is None else found)
                            found = chunks.young[c]
                        row[i] = found
            out.append(b"".join(row))
        return out


def encoder(path: str) -> ChunkEncoder:
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows: list[list] = [[] for _ in range(7)]
                for row, ids in enumerate(enc.encode([t or "" for t in some.column("text").to_pylist()])):
                    whole = ids + np.array([end_id], "<u4").tobytes()
                    n = len(whole) // 4
                    for start in range(0, n, capacity):
                        piece = whole[4 * start : 4 * (start + capacity)]
                        full = len(piece) == 4 * capacity
                        for column, value in zip(rows, (row, start, len(piece) // 4, crc32(piece), n, None if full else piece, full), strict=True):
                            column.append(value)
                take = pa.array(rows[0], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [some.column(c).take(take) for c in ("doc_id", "grp", "tie")]
                    + [pa.array(v, t) for v, t in zip(rows[1:6], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["doc_id", "grp", "tie", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return run


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """Per piece, its parts as (skip, length, sequence, offset). Pieces come longest first.

    Costs are kept in one array over the sequences; full ones are never looked at again.
    """
    import heapq

    k = -(-sum(lengths) // capacity)
    cost, used = np.zeros(k), np.zeros(k, np.int64)
    queue = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(queue)
    parts: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    while queue:
        n, i, skip = heapq.heappop(queue)
        n = -n
        fits = used + n <= capacity
        if fits.any():
            s = int(np.where(fits, cost, np.inf).argmin())
            put = n
        else:
            s = int(used.argmin())
            put = int(capacity - used[s])
            heapq.heappush(queue, (put - n, i, skip + put))
        parts[i].append((skip, put, s, int(used[s])))
        used[s] += put
        cost[s] += linear * put + quadratic * put * put
    return parts


_OUT = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _pack(capacity: int, linear: float, quadratic: float):
    def run(group: pa.Table) -> pa.Table:
        start, length, crc, tokens, tie = (group.column(c).to_numpy() for c in ("start", "length", "ids_crc32", "doc_tokens", "tie"))
        ids, base = group.column("ids").to_pylist(), group.column("grp")[0].as_py() << 32
        order = np.lexsort((start, crc, tie, -length))
        full = [i for i in order if ids[i] is None]
        rest = [i for i in order if ids[i] is not None]
        take, rows = list(full), [[start[i], length[i], crc[i], tokens[i], base + s, 0] for s, i in enumerate(full)]
        base += len(full)
        for i, parts in zip(rest, balance([int(length[i]) for i in rest], capacity, linear, quadratic), strict=True):
            for skip, n, s, offset in parts:
                take.append(i)
                rows.append([start[i] + skip, n, crc32(ids[i][4 * skip : 4 * (skip + n)]), tokens[i], base + s, offset])
        columns = list(zip(*rows, strict=True))
        doc = group.column("doc_id").combine_chunks().take(pa.array(take, pa.int64()))
        return pa.table([doc, *[pa.array([int(x) for x in c], t) for c, (_, t) in zip(columns, _OUT, strict=True)]], ["doc_id", *[n for n, _ in _OUT]])

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, group_bytes: int = 4 << 20) -> DataFrame:
    """The contract's rows, one per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``group_bytes`` of text make one packing group; a group's tokens are no more than its bytes and rows.
    """
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 4).alias("b")).first()["b"] or 0
    groups = max(1, -(-total // group_bytes))
    key = row_key(F.col("doc_id"), F.col("text"))
    rows = rows.select("doc_id", "text", key.alias("tie"), F.pmod(key, F.lit(groups)).cast("long").alias("grp"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(_tokenise(path, capacity, end_id), f"doc_id {kind}, grp long, tie long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.groupBy("grp").applyInArrow(_pack(capacity, linear, quadratic), out)
