"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A conversation is legal when its roles' initials read ``(s?(ua)+)?``. Four grammar states say how far that is: nothing
yet, after s, after u, after a. A forward Viterbi pass over a conversation's rows carries, per state, the
least (cost, audit string); each row keeps, changes or deletes, and bounded insert transitions close its layer.
Equal costs never leave one audit a proper prefix of another (it would hold fewer inserts), so the smaller of two audits stays the smaller whatever follows.

Scale: rows are dealt by conversation and sorted in Spark, once; a task streams through them and never holds a
conversation. States that cost more than any other could cost from the same place are given up; what the audits that remain agree on is
settled, and its turns leave the task. So a conversation of any length takes memory for its unsettled rows, for 16 bytes a
row (duplicates) and for its audit, which is the result. One conversation is one task's work: its order and the digest of its text are sequential.
Where no row of it can be kept, two audits never agree, and time grows with the square of its length.

Edge cases: a null id is a conversation; null turns come first; a null role or text is one space (so the text is blank);
rows of equal turn go by role and text; repeated rows are duplicates; an empty or unknown initial can only be changed or deleted; texts
may be of any length; an empty table gives an empty result; columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import os.path
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.plans.storage import small_batches

_SPACES = " \t\n\x0b\x0c\r"
#: Fixed values of the contract.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: (state, initial) to the state after a turn with that initial.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that may be put next, by insertion or change, and the state it leads to.
NEXT = {s: ("a", ASSISTANT, "assistant") if s == USER else ("u", USER, "user") for s in range(4)}
#: From any state, two inserts (6) reach the state after a; from there every continuation of another state costs at most one delete (4) more.
#: A state dearer than another by more than that is on no cheapest path.
SLACK = 2 * INSERT + DELETE
_SETTLE_AT = 64


class Repair:
    """One conversation's rows in order, in; its repaired turns, to ``out(edit, role, text)`` as soon as they are certain."""

    def __init__(self, out: Callable[[str, str, str], None]):
        self.out = out
        self.paths: dict[int, tuple[int, str]] = {START: (0, "")}
        self._close()
        self.pending: deque[tuple[str, str]] = deque()
        self.settled: list[str] = []
        self.at = START
        self.seen: set[bytes] = set()
        self.before: str | None = None
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def fault(self, role: str, text: str) -> str:
        body = text.rstrip(_SPACES)
        who, what = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        key = hashlib.blake2b(len(who).to_bytes(8, "little") + who + what, digest_size=16).digest()
        again = key in self.seen
        self.seen.add(key)
        if not body:
            return "blank"
        return "duplicate" if again else "" if body[-1] in ".!?" else "truncated"

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.last, self.high = turn, turn
            self.low = turn if self.low is None else self.low
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        fault = self.fault(role, text)
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.pending.append((role, text))
        new: dict[int, tuple[int, str]] = {}

        def offer(state: int, cost: int, audit: str) -> None:
            if state not in new or (cost, audit) < new[state]:
                new[state] = (cost, audit)

        more = CUT_OFF if fault == "truncated" else 0
        for state, (cost, audit) in self.paths.items():
            offer(state, cost + DELETE, audit + "D")
            if fault not in ("blank", "duplicate"):
                if (state, initial) in AFTER:
                    offer(AFTER[state, initial], cost + KEEP + more, audit + "K")
                offer(NEXT[state][1], cost + REROLE + more, audit + "R")
        self.paths = new
        self._close()
        if len(self.pending) >= _SETTLE_AT and len(self.pending) % _SETTLE_AT == 0:
            self._settle(os.path.commonprefix([a for _, a in self.paths.values()]))

    def _close(self) -> None:
        """Inserts after a row: two lead from any state to any that inserts can reach, a third round changes nothing."""
        for _ in range(3):
            changed = False
            for state, (cost, audit) in list(self.paths.items()):
                to, best = NEXT[state][1], (cost + INSERT, audit + "I")
                if to not in self.paths or best < self.paths[to]:
                    self.paths[to], changed = best, True
            if not changed:
                break
        least = min(c for c, _ in self.paths.values())
        self.paths = {s: p for s, p in self.paths.items() if p[0] <= least + SLACK}

    def _settle(self, edits: str) -> None:
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.pending.popleft()
            if edit == "D":
                continue
            if edit == "K":
                self.at = AFTER[self.at, role[:1]]
            else:
                _, self.at, role = NEXT[self.at]
            self.out(edit, role, text)
        if edits:
            self.settled.append(edits)
            self.paths = {s: (c, a[len(edits) :]) for s, (c, a) in self.paths.items()}

    def finish(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit)"""
        cost, audit = min(self.paths[s] for s in (START, ASSISTANT) if s in self.paths)
        self._settle(audit)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled)


def damage(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) of every row; times is 0 for a dropped row, 2 for a repeated one."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable[[object], Repair], end: Callable[[object, Repair], None]) -> Iterator[None]:
    """Feed rows that come sorted by conversation and turn; yields after each batch so that the caller can hand on what is there."""
    current, repair = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times")]
        for conv, turn, role, text, times in zip(*columns, strict=True):
            if repair is None or conv != current:
                if repair is not None:
                    end(current, repair)
                current, repair = conv, begin(conv)
            for _ in range(times):
                repair.add(turn, role, text)
        yield
    if repair is not None:
        end(current, repair)
        yield


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _report(conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        digests: dict[int, tuple] = {}

        def begin(conv) -> Repair:
            sha, first = hashlib.sha256(), [True]

            def out(edit: str, role: str, text: str) -> None:
                sha.update((("" if first[0] else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                first[0] = False

            repair = Repair(out)
            digests[id(repair)] = sha
            return repair

        def end(conv, repair: Repair) -> None:
            found = repair.finish()
            rows.append((conv, *found, digests.pop(id(repair)).hexdigest()))

        for _ in _conversations(batches, begin, end):
            if rows:
                columns = list(zip(*rows, strict=True))
                rows = []
                types = [conv_type, *[pa.int64()] * len(_REPORT), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *_REPORT, "audit", "repaired_sha256"])

    return run


def _turns(conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def begin(conv) -> Repair:
            at = [0]

            def out(edit: str, role: str, text: str) -> None:
                rows.append((conv, at[0], role, text, edit))
                at[0] += 1

            return Repair(out)

        for _ in _conversations(batches, begin, lambda conv, repair: repair.finish()):
            while rows:
                some, rows[:1000] = rows[:1000], []
                types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], ["conv_id", "position", "role", "text", "edit"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _arrow_type(df: DataFrame, name: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[name].dataType
    return kind.simpleString(), to_arrow_type(kind)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations as rows (conv_id, position, role, text, edit), from (conv_id, turn, role, text, times)."""
    name, kind = _arrow_type(rows, "conv_id")
    return _dealt(rows).mapInArrow(_turns(kind), f"conv_id {name}, position long, role string, text string, edit string")


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation its faults, the cost and audit of its cheapest repair, and the digest of the repaired turns."""
    name, kind = _arrow_type(rows, "conv_id")
    return _dealt(rows).mapInArrow(_report(kind), f"conv_id {name}, {', '.join(f'{c} long' for c in _REPORT)}, audit string, repaired_sha256 string")
