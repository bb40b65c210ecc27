"""Operator 11: repair of conversation structure by iterative-deepening A*.

A repaired conversation's role initials have the form ``(s?(ua)+)?``.  Edits, in the
order of their letters: Delete a row (cost 4; required for blank and duplicate
rows), Insert an empty user or assistant row (3), Keep a row (0), Rerole a row to
user or assistant (3); a truncated row that stays costs 3 more.  Which role an
inserted or reroled row gets follows from what stands before it, so the letters
alone tell a repair.

The search goes depth first through the edits in ASCII order under a cost bound
that starts at the estimate and is raised to the least cost that was cut off, so the
first path that is accepted is the cheapest and, among the cheapest, the least in
ASCII order.  A state is (row, what has been written so far: nothing, s, u, a);
the transposition table keeps for every state that failed the least remaining
cost that could still succeed.  The estimate never overrates: every remaining row
costs what it needs by itself, and adjacent rows that don't fit cost what their
cheapest mending adds, over pairs without a common row.

Where it runs.  Damage, faults and duplicates are DataFrame expressions (duplicates
by a window over (conversation, role, text), so a long conversation is spread).
Then one shuffle by conversation, sorted there, hands each conversation over twice:
first its rows without texts, of which the search keeps about 100 bytes each
(codes, estimates, table, the open path), then the rows with their texts, which are hashed as
they stream by.  No conversation's texts are ever held together.

Cases: a null conv_id is one conversation; a null role or text is one space, a null
turn stands first and is a space in the damage key; rows with the same turn go by
role, then text; repeated rows are duplicates; extra columns are not read; a
conversation all of whose rows are dropped has zeros, an empty audit and the
hash of the empty string; an empty table gives no rows; gaps of turns that lie more
than the largest long apart are that long.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, table

SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
DELETE, INSERT, KEEP, REROLE = 4, 3, 0, 3
TRUNCATED = 3
#: characters of a text that take part in the order of rows of one turn and role before its hash does
HEAD = 64

#: role classes, and states: what the repaired rows so far end with
OTHER, S, U, A = range(4)
START = 0
CLEAN, CUT, GONE = range(3)
#: state -> state after a user or assistant row
NEXT = {START: U, S: U, U: A, A: U}
LETTERS = "DIKR"
FAR = 1 << 60
ROLE = {U: "user", A: "assistant"}


def fits(before: int, role: int) -> bool:
    """May a row of this class stand in this state?"""
    return NEXT[before] == role or (before == START and role == S)


class Search:
    """The cheapest repair of rows (role class, fault)."""

    def __init__(self, roles: bytes | bytearray, faults: bytes | bytearray):
        self.roles, self.faults, self.n = roles, faults, len(roles)
        n = self.n
        self.alone = array("q", bytes(8 * (n + 1)))   # what the rows from here on cost by themselves
        self.pairs = array("q", bytes(8 * (n + 2)))   # and the pairs of neighbours that don't fit
        self.spare = array("b", bytes(n + 1))         # what keeping one s row from here on would save
        self.after = array("q", [n]) * (n + 1)        # the first row from here on that isn't to be deleted
        for i in range(n - 1, -1, -1):
            role, fault, nxt = roles[i], faults[i], self.after[i + 1]
            self.after[i] = nxt if fault == GONE else i
            need = DELETE if fault == GONE else min(DELETE, TRUNCATED * (fault == CUT) + (0 if role in (U, A) else REROLE))
            self.alone[i] = self.alone[i + 1] + need
            self.spare[i] = self.spare[i + 1]
            if role == S and fault != GONE:
                self.spare[i] = max(self.spare[i], need - TRUNCATED * (fault == CUT))
            if fault == GONE:
                self.pairs[i] = self.pairs[i + 1]
            else:
                beyond = self.pairs[self.after[nxt + 1]] if nxt < n else 0
                self.pairs[i] = max(self.pairs[nxt] if nxt < n else 0, self.clash(i, nxt) + beyond)
        self.known = array("q", [-1]) * (4 * (n + 1))  # transposition table: least remaining cost that may succeed

    def clash(self, i: int, j: int) -> int:
        """The least that mending the neighbours i, j adds to what they cost by
        themselves: j = n is the end, where an a has to stand before it."""
        role, fault = self.roles[i], self.faults[i]
        if role not in (U, A):
            return 0
        if j == self.n:
            return 0 if role == A else self.least(fault)
        other = self.roles[j]
        if other not in (U, A) or other != role:
            return 0
        return min(self.least(fault), self.least(self.faults[j]))

    @staticmethod
    def least(fault: int) -> int:
        """Deleting a truncated row costs one more than keeping it."""
        return min(INSERT, REROLE, DELETE - (TRUNCATED if fault == CUT else 0))

    def estimate(self, i: int, state: int) -> int:
        """A lower bound of the cost from row i in this state."""
        n, j = self.n, self.after[i]
        rest = self.pairs[j] if j < n else 0
        if j == n:
            rest = {START: 0, S: 2 * INSERT, U: INSERT, A: 0}[state]
        elif self.roles[j] in (U, A) and not fits(state, self.roles[j]):
            k = self.after[j + 1]
            rest = max(rest, self.least(self.faults[j]) + (self.pairs[k] if k < n else 0))
        return self.alone[i] + rest - (self.spare[i] if state == START else 0)

    def move(self, i: int, state: int, k: int) -> tuple[int, int, int] | None:
        """(cost, next row, next state) of the k-th edit of LETTERS, if it may be made."""
        if k == 1:
            return INSERT, i, NEXT[state]
        if i == self.n:
            return None
        if k == 0:
            return DELETE, i + 1, state
        if self.faults[i] == GONE:
            return None
        more = TRUNCATED if self.faults[i] == CUT else 0
        if k == 3:
            return REROLE + more, i + 1, NEXT[state]
        return (KEEP + more, i + 1, self.roles[i]) if fits(state, self.roles[i]) else None

    def lower(self, i: int, state: int) -> int:
        at = 4 * i + state
        if self.known[at] < 0:
            self.known[at] = max(0, self.estimate(i, state))
        return self.known[at]

    def run(self) -> tuple[int, str]:
        bound = self.lower(0, START)
        while True:
            audit = self.bounded(bound)
            if audit is not None:
                return bound, audit
            bound = self.known[START]

    def bounded(self, bound: int) -> str | None:
        """The first accepting path of at most this cost; raises the table's
        entries of the states that fail."""
        # of each open state: row, state, remaining cost, the next letter to try, least cost seen to succeed
        rows, states, left, tried, least = (array("q", [x]) for x in (0, START, bound, 0, FAR))
        while rows:
            i, state, k = rows[-1], states[-1], tried[-1]
            if i == self.n and state in (START, A):
                return "".join(LETTERS[x - 1] for x in tried[:-1])
            if k == len(LETTERS):
                at = 4 * i + state
                self.known[at] = max(self.known[at], least[-1])
                for x in (rows, states, left, tried, least):
                    x.pop()
                if rows:
                    cost = self.move(rows[-1], states[-1], tried[-1] - 1)[0]
                    least[-1] = min(least[-1], cost + self.known[at])
                continue
            tried[-1] += 1
            step = self.move(i, state, k)
            if step is None:
                continue
            cost, row, now = step
            need = cost + self.lower(row, now)
            if need > left[-1]:
                least[-1] = min(least[-1], need)
                continue
            for x, value in ((rows, row), (states, now), (left, left[-1] - cost), (tried, 0), (least, FAR)):
                x.append(value)
        return None


def role_class(role: str) -> int:
    return {"s": S, "u": U, "a": A}.get(role[:1], OTHER)


# ------------------------------------------------------------------ DataFrames
def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone (dropped), copy (1: the repeated row)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                       text.alias("text"), (F.crc32(key) % 20).cast("int").alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))


def fault(text: Column, again: Column) -> Column:
    stripped = F.rtrim(text, F.lit(SPACES))
    return (F.when(stripped == "", "blank").when(again, "duplicate")
            .when(~F.right(stripped, F.lit(1)).isin(*STOPS), "truncated"))


def faulty(rows: DataFrame) -> DataFrame:
    """Damaged rows with ``fault`` (null: none).  Equal rows of one conversation
    meet in one window, whose first by turn is no duplicate."""
    order = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    return rows.withColumn("again", F.row_number().over(order) > 1).withColumn(
        "fault", F.when(~F.col("gone"), fault(F.col("text"), F.col("again"))))


class Conversation:
    """What is known of one conversation while its rows stream by."""

    def __init__(self, conv_id: int | None, texts: list | None):
        self.conv_id, self.texts = conv_id, texts
        self.roles, self.faults = bytearray(), bytearray()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.last = 0, None
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.audit, self.cost = None, 0
        self.sha, self.at, self.state, self.n = hashlib.sha256(), 0, START, 0

    def describe(self, turn: int | None, role: str, fault: str | None) -> None:
        self.roles.append(role_class(role))
        self.faults.append(GONE if fault in ("blank", "duplicate") else CUT if fault else CLEAN)
        if fault:
            self.counts[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high, self.turn, self.turns = turn, turn, self.turns + 1

    def decide(self) -> None:
        if self.audit is None:
            self.cost, self.audit = Search(self.roles, self.faults).run()

    def write(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.n else ''}{role}:{text}".encode())
        if self.texts is not None:
            self.texts.append((self.conv_id, self.n, role, text))
        self.n += 1

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self.write(ROLE[self.state], "")
            self.at += 1

    def repair(self, role: str, text: str) -> None:
        """The next row, with its text."""
        self.decide()
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = role_class(role)
            self.write(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self.write(ROLE[self.state], text)

    def result(self) -> tuple:
        self.decide()
        self.inserts()
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2 ** 63 - 1)
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, self.audit, self.sha.hexdigest())


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
TEXTS = "conv_id long, position long, role string, text string"
ARROW = {"long": pa.int64(), "string": pa.string()}


def streamed(rows: DataFrame, texts: bool) -> DataFrame:
    """Conversations of damaged rows (conv_id, turn, role, text, gone, copy): their
    results, or the rows of their repairs."""
    marked = faulty(rows).withColumn("head", F.left("text", F.lit(HEAD))).withColumn("hash", F.xxhash64("text"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows alike in all of these are repetitions, of which the first is no duplicate
    order = [F.col("conv_id").asc_nulls_first(), "pass", F.col("turn").asc_nulls_first(), "role", "head", "hash", "again", "copy"]
    # each row comes twice: first without its text, then (unless it was dropped) with it
    passes = F.when(F.col("gone"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    both = marked.withColumn("pass", F.explode(passes)).withColumn("text", F.when(F.col("pass") == 1, F.col("text")))
    both = both.repartition(spread, "conv_id").sortWithinPartitions(*order)
    schema = TEXTS if texts else RESULT
    names, types = zip(*(x.split() for x in schema.split(", ")))

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(zip(*out), types)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, results, repaired = None, [], [] if texts else None
        for b in batches:
            for conv_id, second, gone, turn, role, text, bad in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        results.append(now.result())
                    now = Conversation(conv_id, repaired)
                if second:
                    now.repair(role, text)
                elif not gone:
                    now.describe(turn, role, bad)
            out = repaired if texts else results
            if out:
                yield packed(out)
            results.clear()
            if texts:
                repaired.clear()
        if now is not None:
            results.append(now.result())
            if repaired if texts else results:
                yield packed(repaired if texts else results)

    return arrow_map(both.select("conv_id", (F.col("pass") == 1).alias("second"), "gone", "turn", "role", "text", "fault"), run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and letters of its repair, the hash of the repaired rows."""
    return streamed(rows, False)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text."""
    return streamed(rows, True)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
