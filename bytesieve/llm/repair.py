"""Structure of conversations repaired by iterative-deepening A*.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn. The cheapest
edits to one are searched depth first, in ASCII order of their letters, under a bound on the cost that rises to the
least value at which the last bound was exceeded. States that failed are kept with the least cost they are known to need,
so a state is entered again only with more to spend. The first path accepted is the cheapest one and, among those,
the least in ASCII order.

Before the search from the front, states further and further from the end are searched in the same way, every
``STRIDE`` rows. What they are found to need prunes the searches in front of them, so the time grows in proportion
to the rows instead of with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Costs of edits, and what a truncated turn costs that is not deleted.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
# Rows between the states that are searched before the front one.
STRIDE = 32
# Signs that do not fill a text, and signs that end one.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"

# What the initials so far allow: nothing yet, a system turn, an open pair, closed pairs. -> role wanted next.
START, SYSTEM, OPEN, CLOSED = range(4)
WANTED = {START: "u", SYSTEM: "u", OPEN: "a", CLOSED: "u"}
AFTER = {(START, "s"): SYSTEM, (START, "u"): OPEN, (SYSTEM, "u"): OPEN, (OPEN, "a"): CLOSED, (CLOSED, "u"): OPEN}
NAMES = {"u": "user", "a": "assistant"}
# Inserts that the end of a conversation still needs.
ENDING = {START: 0, SYSTEM: 2 * INSERT, OPEN: INSERT, CLOSED: 0}


class Search:
    """Cheapest edits of one conversation, given as (initial, fault) of its rows; fault: b, d, t or empty."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = rows
        # What a row costs whatever is done around it; the sum over the rows left never exceeds the cost that is left.
        least = []
        for initial, fault in rows:
            cut = TRUNCATED if fault == "t" else 0
            if fault in ("b", "d"):
                least.append(DELETE)
            else:
                least.append(min(DELETE, cut if initial in ("s", "u", "a") else REROLE + cut))
        self.rest = list(accumulate(reversed(least), initial=0))[::-1]
        # (row, state) -> least cost it is known to need, and the states for which that is their cost.
        self.need: dict[tuple[int, int], int] = {}
        self.solved: set[tuple[int, int]] = set()

    def least(self, node: tuple[int, int]) -> int:
        known = self.need.get(node)
        if known is None:
            known = self.rest[node[0]] + (ENDING[node[1]] if node[0] == len(self.rows) else 0)
        return known

    def moves(self, node: tuple[int, int]) -> list[tuple[str, int, tuple[int, int]]]:
        """(letter, cost, next) of all edits at a state, in ASCII order of the letters."""
        i, state = node
        wanted = WANTED[state]
        insert = ("I", INSERT, (i, AFTER[state, wanted]))
        if i == len(self.rows):
            return [insert]
        initial, fault = self.rows[i]
        found = [("D", DELETE, (i + 1, state)), insert]
        if fault not in ("b", "d"):
            cut = TRUNCATED if fault == "t" else 0
            if (state, initial) in AFTER:
                found.append(("K", cut, (i + 1, AFTER[state, initial])))
            found.append(("R", REROLE + cut, (i + 1, AFTER[state, wanted])))
        return found

    def descend(self, root: tuple[int, int], bound: int, to_end: bool) -> str | None:
        """The first path from ``root`` of cost ``bound`` at most; None raises what the states on the way need.

        Without ``to_end`` a state of known cost ends the path.
        """
        size = len(self.rows)
        # One frame per open state: state, cost left, its edits, number tried, least cost that failed edits need.
        stack = [[root, bound, self.moves(root), 0, None]]
        path: list[str] = []
        while stack:
            node, left, moves, tried, failed = stack[-1]
            if tried == 0 and node[0] == size and node[1] in (START, CLOSED):
                return "".join(path)
            if tried == 0 and not to_end and node in self.solved and self.need[node] <= left:
                return "".join(path)
            if tried == len(moves):
                self.need[node] = max(self.least(node), failed)
                stack.pop()
                if path:
                    path.pop()
                if stack:
                    above = stack[-1]
                    needed = above[2][above[3] - 1][1] + self.need[node]
                    above[4] = needed if above[4] is None else min(above[4], needed)
                continue
            letter, cost, following = moves[tried]
            stack[-1][3] += 1
            needed = cost + self.least(following)
            if needed > left:
                stack[-1][4] = needed if failed is None else min(failed, needed)
                continue
            stack.append([following, left - cost, self.moves(following), 0, None])
            path.append(letter)
        return None

    def solve(self, root: tuple[int, int], to_end: bool = False) -> tuple[int, str]:
        """(cost, edits) of the cheapest path from ``root``; the edits are whole with ``to_end``."""
        while True:
            bound = self.least(root)
            path = self.descend(root, bound, to_end)
            if path is not None:
                self.need[root] = bound
                self.solved.add(root)
                return bound, path

    def best(self) -> tuple[int, str]:
        """(cost, edits) of the cheapest repair, the least in ASCII order among equals."""
        sums = list(self.rest)
        behind = (len(self.rows) - 1) // STRIDE * STRIDE
        for i in range(behind, -1, -STRIDE):
            if i < behind:
                # Every path goes on from one of the states that were searched last.
                lowest = min(self.need[i + STRIDE, state] for state in WANTED)
                for row in range(i, i + STRIDE):
                    self.rest[row] = sums[row] - sums[i + STRIDE] + lowest
            for state in WANTED if i else ():
                self.solve((i, state))
        return self.solve((0, START), to_end=True)


def edited(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """(role, text) of the turns that the edits of ``audit`` leave of ``rows`` (role, text)."""
    state, i, turns = START, 0, []
    for letter in audit:
        initial = WANTED[state]
        if letter == "K":
            initial = rows[i][0][:1]
            turns.append(rows[i])
        elif letter == "R":
            turns.append((NAMES[initial], rows[i][1]))
        elif letter == "I":
            turns.append((NAMES[initial], ""))
        if letter != "D":
            state = AFTER[state, initial]
        if letter != "I":
            i += 1
    return turns


def first_faults(turns: list[tuple[str, str]]) -> list[str]:
    """The first fault of each turn (role, text): b blank, d seen before, t not ended by a sign, or nothing."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for turn in turns:
        words = turn[1].strip(BLANKS)
        faults.append("b" if not words else "d" if turn in seen else "" if words[-1] in ENDS else "t")
        seen.add(turn)
    return faults


REPAIRED = "array<struct<role: string, text: string>>"
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    f"repaired {REPAIRED}"
)


def repair_turns(numbers: list[int | None], turns: list[tuple[str, str]]) -> tuple:
    """Everything in ``RESULT`` behind the id, for the turns (role, text) of one conversation in order."""
    faults = first_faults(turns)
    initials = [role[:1] for role, _ in turns]
    illegal = sum(pair not in (("s", "u"), ("u", "a"), ("a", "u")) for pair in pairwise(initials))
    known = {number for number in numbers if number is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    cost, audit = Search(list(zip(initials, faults, strict=True))).best()
    return gaps, *map(faults.count, "bdt"), illegal, cost, audit, edited(turns, audit)


def gathered(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, turns) of ``rows`` (conv_id, turn, role, text); ``copies`` says how often a row counts, once if not given.

    Turns are sorted by number (nulls first), then role, then text. Null roles and texts are one space. A conversation all of
    whose rows count zero times stays, without turns; rows of a null conv_id are one conversation.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    listed = F.collect_list(turn) if copies is None else F.flatten(F.collect_list(F.array_repeat(turn, copies)))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(listed).alias("turns"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of ``rows`` (conv_id, turn, role, text) with damage drawn from the crc32 of ``conv_id:turn``.

    Of every 20 rows one each is dropped, emptied, robbed of its end signs, repeated and given to the user.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    drawn = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return gathered(drawn, F.col("copies"))


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired turns (``RESULT``) of every row of ``conversations`` (conv_id, turns).

    ``turns`` are in order, as ``gathered`` gives them. A conversation without turns has zeros, no edits and no repaired
    turns; a role that begins with none of s, u, a, an empty one too, can be changed or deleted but not kept. Repeated rows
    are repaired each, other columns are ignored, an empty table gives no rows. A conversation is one row, so one must fit a
    task; the search takes memory in proportion to its turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: pa.ListArray = batch.column(1)
            numbers, roles, texts = (column.to_pylist() for column in lists.flatten().flatten())
            turns = list(zip(roles, texts, strict=True))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
            results, begin = [], 0
            for end in ends:
                results.append(repair_turns(numbers[begin:end], turns[begin:end]))
                begin = end
            columns = list(zip(*results, strict=True)) if results else [()] * 8
            left = [turn for result in columns[7] for turn in result]
            bounds = np.cumsum([0, *map(len, columns[7])])
            pairs = [pa.array([turn[i] for turn in left], pa.string()) for i in (0, 1)]
            structs = pa.StructArray.from_arrays(pairs, ["role", "text"])
            arrays = [batch.column(0), *(pa.array(column, pa.int64()) for column in columns[:6])]
            arrays += [pa.array(columns[6], pa.string()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)]
            yield pa.RecordBatch.from_arrays(
                arrays, ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
            )

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("turns", F.array()).alias("turns")
    )
    return rows.mapInArrow(run, RESULT)
