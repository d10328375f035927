"""Repair of conversations whose rows are blank, repeated, cut short or out of turn.

Rows are dealt by conversation and sorted by turn; a mapInPandas pass carries, over Arrow
batches, the least cost of each state of the grammar `(s?(ua)+)?` and, for each row, one
byte of backpointer for each state. Edits and their costs: Keep 0, Rerole to user or
assistant 2, Delete 3 (the only one for blank and repeated rows), Insert an empty user or
assistant row 2; a truncated row that stays adds 1. Of the cheapest edits those whose
initials are least as text are taken.

A conversation lies in one task, as its repair depends on all earlier rows, but that task
holds one batch of it, four running hashes and the backpointers of at most SPILL rows: of
longer conversations these go to the shared folder in pieces, are read back from the last
to the first, and are deleted. Whether a row's role and text were seen earlier is told by
a window in the JVM, which spills.

Nulls: a null conversation id is a conversation; null turns come first; null roles and texts
count as one space. Rows of one turn follow in the order of role and text, so ties and
repeated rows have one result. Initials are a role's first character as it stands; a role that is
empty or begins otherwise than s, u, a cannot be kept. Texts of any length are hashed as they
pass, and batches are bounded in bytes by Spark. An empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import publish, shared_dir, store

#: White space of the contract, as characters.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Backpointers (four bytes a row) held in memory before they are written out.
SPILL = 1 << 20
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: What an inserted or rerolled row has to be in each state, and whether rows may end there.
NEXT = (USER, USER, ASSISTANT, USER)
INSERTS_TO_END = (0, 2, 1, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DKR"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults put in, by crc32(`conv_id:turn`) modulo 20: 0 drops a row (it stays
    marked, as its conversation does), 1 empties its text, 2 takes out its `.!?`, 3 repeats
    it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), code.alias("code"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = out.withColumns({
        "text": F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("code") == 4, "user").otherwise(F.col("role")),
        "copy": F.explode(copies),
    })
    return out.withColumn("dropped", F.col("code") == 0).drop("code")


def faults(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted by turn, each with its first fault."""
    tail = F.rtrim(F.col("text"), F.lit(SPACE))
    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    fault = F.when(tail == "", BLANK).when(seen, DUPLICATE).when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return rows.repartition("conv_id").withColumn("fault", fault.cast("int")).sortWithinPartitions("conv_id", *order)


@dataclass(frozen=True)
class Step:
    """From one row to the next: the states reached, how much the least cost grew, each
    state's cost above it, the states in the order of their edits as text, and for each
    state where it came from: old state, inserts, letter."""

    grew: int
    costs: tuple[int | None, ...]
    order: tuple[int, ...]
    back: tuple[tuple[int, int, str] | None, ...]

    def packed(self) -> bytes:
        return bytes(255 if b is None else b[0] | b[1] << 2 | LETTERS.index(b[2]) << 4 for b in self.back)


def step(costs: tuple, order: tuple, initial: int | None, fault: int) -> Step:
    """Edits up to a row never begin one another (they use up the same rows and end with one),
    so the order of two of them decides that of all their continuations."""
    best: dict[int, tuple] = {}
    for place, old in enumerate(order):
        state, cost = old, costs[old]
        for inserts in range(3):  # a third would lead back to a state at a higher cost
            ways = [("D", state, DELETE)]
            if fault not in (BLANK, DUPLICATE):
                more = int(fault == TRUNCATED)
                if initial is not None and (initial == NEXT[state] or (initial == SYSTEM and state == START)):
                    ways.append(("K", initial, KEEP + more))
                ways.append(("R", NEXT[state], REROLE + more))
            for letter, new, price in ways:
                found = (cost + price, place, "I" * inserts + letter, old, inserts, letter)
                if new not in best or found < best[new]:
                    best[new] = found
            state, cost = NEXT[state], cost + INSERT
    least = min(b[0] for b in best.values())
    ranked = tuple(sorted(best, key=lambda s: best[s][1:3]))
    return Step(least, tuple(best[s][0] - least if s in best else None for s in range(4)), ranked, tuple(best[s][3:] if s in best else None for s in range(4)))


class Steps(dict):
    """Costs above the least are small, so few different steps occur: each is worked out once."""

    def __missing__(self, key: tuple) -> tuple[Step, bytes]:
        found = step(*key)
        self[key] = found, found.packed()
        return self[key]


@dataclass
class Repair:
    """The running repair of one conversation."""

    conv_id: int | None
    steps: Steps
    spills: str
    most: int = SPILL
    total: int = 0
    costs: tuple = (0, None, None, None)
    order: tuple = (START,)
    counts: list = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    before: str | None = None
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    back: bytearray = field(default_factory=bytearray)
    pieces: list = field(default_factory=list)
    hashes: list = field(default_factory=lambda: [hashlib.sha256(), None, None, None])

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.counts[fault] += 1
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.distinct += 1
                self.high = turn
        found, packed = self.steps[self.costs, self.order, INITIAL.get(initial), fault]
        old, self.hashes = self.hashes, [None] * 4
        body = None
        for new, came in enumerate(found.back):
            if came is None:
                continue
            state, inserts, letter = came
            h = old[state].copy()
            filled = state != START
            for _ in range(inserts):
                state = NEXT[state]
                h.update(f"{chr(10) * filled}{ROLES[state]}:".encode())
                filled = True
            if letter != "D":
                name = role if letter == "K" else ROLES[NEXT[state]]
                body = body if body is not None else text.encode("utf-8", "surrogatepass")
                h.update(f"{chr(10) * filled}{name}:".encode("utf-8", "surrogatepass"))
                h.update(body)
            self.hashes[new] = h
        self.total += found.grew
        self.costs, self.order = found.costs, found.order
        self.back += packed
        if len(self.back) >= 4 * self.most:
            self.pieces.append((publish(self.spills, "back", bytes(self.back)), len(self.back)))
            self.back = bytearray()

    def result(self) -> tuple:
        best = None
        for place, state in enumerate(self.order):
            found = (self.costs[state] + INSERTS_TO_END[state] * INSERT, place, state)
            best = found if best is None or found < best else best
        cost, _, state = best
        tail, h = INSERTS_TO_END[state], self.hashes[state]
        end = state
        for _ in range(tail):
            filled = end != START
            end = NEXT[end]
            h.update(f"{chr(10) * filled}{ROLES[end]}:".encode())
        letters = ["I" * tail]
        for piece in self._pieces_from_the_last():
            for at in range(len(piece) - 4, -1, -4):
                b = piece[at + state]
                letters.append("I" * (b >> 2 & 3) + LETTERS[b >> 4])
                state = b & 3
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.total + cost, "".join(reversed(letters)), h.hexdigest())

    def _pieces_from_the_last(self) -> Iterator[bytes]:
        yield bytes(self.back)
        for name, _ in reversed(self.pieces):
            fs, root = store(self.spills)
            with fs.open_input_file(f"{root}/{name}") as f:
                piece = f.read()
            fs.delete_file(f"{root}/{name}")
            yield piece


def repair(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """One row for each conversation of `rows` (conv_id, turn, role, text, copy, dropped, as
    `damaged` gives them): its faults, the cheapest edits and the digest of the result."""
    spills = f"{shared_dir(rows.sparkSession)}/turns-backpointers"

    def run(batches):
        steps, now, out = Steps(), None, []
        for batch in batches:
            for conv, turn, dropped, role, text, fault in zip(*(batch[c].tolist() for c in ("conv", "turn", "dropped", "role", "text", "fault"))):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = Repair(conv, steps, spills, spill)
                if not dropped:
                    now.add(int(turn) if turn else None, role, text, fault)
            if len(out) >= 1000:
                yield _frame(out)
                out = []
        if now is not None:
            out.append(now.result())
        yield _frame(out)

    # ids and turns as text, as pandas has no nulls among its integers
    sent = faults(rows).select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("turn"), "dropped", "role", "text", "fault")
    return sent.mapInPandas(run, REPAIRED.replace("conv_id long", "conv string")).select(F.nullif(F.col("conv"), F.lit("")).cast("long").alias("conv_id"), *[c.split()[0] for c in REPAIRED.split(", ")[1:]])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv", *(c.split()[0] for c in REPAIRED.split(", ")[1:])])


def repaired_damage(rows: DataFrame) -> DataFrame:
    """Damages the conversations and repairs them."""
    return repair(damaged(rows))
