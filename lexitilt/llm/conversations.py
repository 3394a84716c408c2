"""Conversation repair: the cheapest edits that give a system turn, if any, and turns by pairs.

A row is kept, given another role, or deleted; an empty turn may be put in anywhere. The roles
left must read ``(s?(ua)+)?`` by their initials. Among the cheapest edits, those count whose
letters (Keep, Rerole, Delete, Insert) in order are least as ASCII text.

Cost and letters are one integer. Its high digits carry the cost; below them stand ``width``
digits of ``DIGIT_BITS`` bits, one a letter by its place, the first letter highest, with zeros at
the end. So the order of integers is the order of (cost, letters), a shorter text before its
continuations, and the repair is an ordinary least-integer path through a graph without cycles:
nodes are (rows still to read, state of the pattern), an edge puts a letter before the letters of
the node it leads to and adds its cost. The audit is read off the digits of the least integer.

An insertion stays at its row and leads to another state. Costs are positive, so a least path
holds fewer insertions in a place than there are states, and over all no more than deleting what
is left and two insertions would cost; both bound ``width``.

A conversation is read twice, each time in order and row by row: first without its texts, for the
edits, then with them, for the hash of the repaired text. A task holds a few bytes a row of the
conversation it is at, and no texts beyond a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitilt.llm.common import durable

SEPARATORS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Letters in ASCII order; a digit of zero is no letter.
LETTERS = " DIKR"
DIGIT_BITS = 3
#: States of the pattern: nothing yet, after s, after u, after a; moves by initial.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
LEGAL_PAIRS = ("su", "ua", "au")
ROLE_OF = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def cheapest_edits(rows: str, costs: Costs = Costs()) -> tuple[int, str]:
    """(cost, letters) for rows given as two characters each: the role's initial (``-`` if it is
    none of s, u, a) and the fault: ``x`` must go, ``t`` is truncated, ``k`` is neither."""
    n = len(rows) // 2
    spare = (n + 1) * (len(MOVES) - 1)
    width = n + (min(spare, costs.delete * n // costs.insert + 2) if costs.insert > 0 else spare)
    top = DIGIT_BITS * width                     # the cost's digits begin here
    low = (1 << top) - 1

    def before(letter: str, cost: int, rest: int) -> int:
        """The integer of ``letter`` followed by the letters of ``rest``."""
        return (((rest >> top) + cost) << top
                | LETTERS.index(letter) << top - DIGIT_BITS | (rest & low) >> DIGIT_BITS)

    def with_insertions(best: list[int | None]) -> list[int | None]:
        for _ in range(len(MOVES) - 1):
            best = [min((v for v in (here, *(
                before("I", costs.insert, best[to]) for initial, to in moves.items()
                if initial in ROLE_OF and best[to] is not None)) if v is not None), default=None)
                for here, moves in zip(best, MOVES)]
        return best

    best = with_insertions([0 if state in FINAL else None for state in range(len(MOVES))])
    for k in range(n - 1, -1, -1):
        initial, fault = rows[2 * k], rows[2 * k + 1]
        extra = costs.truncated if fault == "t" else 0
        found: list[int | None] = []
        for state, moves in enumerate(MOVES):
            ways = [] if best[state] is None else [before("D", costs.delete, best[state])]
            if fault != "x":
                ways += [before("K", extra, best[to]) for i, to in moves.items()
                         if i == initial and best[to] is not None]
                ways += [before("R", costs.rerole + extra, best[to]) for i, to in moves.items()
                         if i in ROLE_OF and best[to] is not None]
            found.append(min(ways, default=None))
        best = with_insertions(found)
    least = best[0]
    letters = (least >> top - DIGIT_BITS * (j + 1) & 7 for j in range(width)) if width else ()
    return least >> top, "".join(LETTERS[d] for d in letters if d)


_short = lru_cache(maxsize=50_000)(cheapest_edits)


class Conversation:
    """One conversation without its texts, row by row in order."""

    def __init__(self, name: str | None) -> None:
        self.name = name
        self.rows: list[str] = []
        self.seen: set[bytes] = set()
        self.turns: tuple[int, int, int] | None = None  # least, largest, distinct
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None

    def add(self, turn: str | None, initial: str, fault: str, mark: bytes) -> None:
        if fault == "x":
            self.blank += 1
        elif mark in self.seen:
            fault = "x"
            self.duplicate += 1
        elif fault == "t":
            self.truncated += 1
        self.seen.add(mark)
        if self.last is not None and self.last + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.last = initial
        self.rows.append((initial if initial in ("s", "u", "a") else "-") + fault)
        if turn is not None:  # turns come in order
            t = int(turn)
            if self.turns is None:
                self.turns = (t, t, 1)
            elif t != self.turns[1]:
                self.turns = (self.turns[0], t, self.turns[2] + 1)

    def result(self, costs: Costs) -> tuple:
        rows = "".join(self.rows)
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        cost, letters = (_short if len(rows) <= 64 else cheapest_edits)(rows, costs)
        return (self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost,
                letters)


class Repaired:
    """The hash of a conversation after the edits ``letters``, row by row in order."""

    def __init__(self, letters: str) -> None:
        self.letters, self.at, self.state = letters, 0, 0
        self.hash, self.first = hashlib.sha256(), True

    def _put(self, role: str | None, text: str) -> None:
        """A turn; without a role, that of the user or the assistant, whichever may follow."""
        initial = role[0] if role else next(i for i in MOVES[self.state] if i in ROLE_OF)
        line = f"{'' if self.first else chr(10)}{role or ROLE_OF[initial]}:{text}"
        self.hash.update(line.encode("utf-8", "surrogatepass"))
        self.state, self.first = MOVES[self.state][initial], False

    def _insertions(self) -> None:
        while self.letters[self.at:self.at + 1] == "I":
            self._put(None, "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._insertions()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            self._put(role if letter == "K" else None, text)

    def result(self) -> str:
        self._insertions()
        return self.hash.hexdigest()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_EDITS = ["conv_id", *_COUNTS, "audit"]
_EDITS_TYPE = f"conv_id string, {', '.join(f'{c} long' for c in _COUNTS)}, audit string"


def _lists(batch: pd.DataFrame) -> Iterator[tuple]:
    """The rows of a batch; null as None."""
    return zip(*(batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in batch))


def _edits(rows: DataFrame, costs: Costs) -> DataFrame:
    """The counts, cost and letters of each conversation; of the rows, digests stand for texts."""
    kept = F.rtrim("text", F.lit(SEPARATORS))
    fault = F.when(kept == "", "x").when(F.substring(kept, -1, 1).isin(*ENDS), "k").otherwise("t")
    mark = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
                         .cast("binary")))
    narrow = rows.select("conv_id", "turn", "role", mark.alias("mark"),
                         F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "there")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        talk: Conversation | None = None
        for batch in batches:
            done = []
            for name, turn, initial, fault, mark, there in _lists(batch):
                if talk is None or name != talk.name:
                    if talk is not None:
                        done.append(talk.result(costs))
                    talk = Conversation(name)
                if there:
                    talk.add(turn, initial, fault, mark)
            yield pd.DataFrame(done, columns=_EDITS)
        if talk is not None:
            yield pd.DataFrame([talk.result(costs)], columns=_EDITS)

    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark") \
        .select("conv_id", F.col("turn").cast("string").alias("turn"), "initial", "fault", "mark",
                "there").mapInPandas(run, _EDITS_TYPE)


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row a
    conversation.

    ``turns``: conv_id, turn, role, text and there (false: the row only says that its
    conversation exists). Rows go by turn, null turns first; rows of one turn go by role, then by
    a digest of role and text. A null role or text is one blank. A null conv_id is a conversation
    of its own. A conversation without rows has zeros, an empty audit and the hash of nothing; an
    empty table gives no rows. Repeated rows are duplicates. Texts may be as long as a row may
    be. Other columns are not used.
    """
    kind = turns.schema["conv_id"].dataType
    rows = turns.select(
        F.col("conv_id").cast("string").alias("conv_id"), "turn",
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        "there")
    edits = durable(_edits(rows, costs))
    none = F.lit(None)
    heads = edits.select(
        "conv_id", F.lit(0).alias("place"), none.cast(turns.schema["turn"].dataType).alias("turn"),
        none.cast("string").alias("role"), none.cast("string").alias("text"),
        none.cast("string").alias("mark"), *_COUNTS, "audit")
    body = rows.where("there").select(
        "conv_id", F.lit(1).alias("place"), "turn", "role", "text",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
              .cast("binary")).alias("mark"),
        *[none.cast("long").alias(c) for c in _COUNTS], none.cast("string").alias("audit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, made = None, None
        columns = [*_EDITS, "repaired_sha256"]
        for batch in batches:
            done = []
            for name, place, role, text, *rest in _lists(batch):
                if place == 0:  # the conversation's own row comes first
                    if head is not None:
                        done.append((*head, made.result()))
                    head, made = (name, *map(int, rest[:-1]), rest[-1]), Repaired(rest[-1])
                else:
                    made.add(role, text)
            yield pd.DataFrame(done, columns=columns)
        if head is not None:
            yield pd.DataFrame([(*head, made.result())], columns=columns)

    return heads.unionByName(body).repartition("conv_id") \
        .sortWithinPartitions("conv_id", "place", "turn", "role", "mark") \
        .select("conv_id", "place", "role", "text", *_COUNTS, "audit") \
        .mapInPandas(run, _EDITS_TYPE + ", repaired_sha256 string") \
        .withColumn("conv_id", F.col("conv_id").cast(kind))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there after the planned damage of each row.

    The CRC-32 of ``conv_id:turn`` (a null is one blank) modulo 20 decides: 0 drops the row, 1
    empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats it, 4 makes it the
    user's.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" "))
                              for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", "role", "text",
                        (F.crc32(name.cast("binary")) % 20).alias("hit"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("hit") != 0).alias("there"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2)))
                  .otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")
