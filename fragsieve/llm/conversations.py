"""Repair of conversations' structure by the cheapest edits.

A conversation is kept if the initials of its roles read ``(s?(ua)+)?``: four states of
a grammar. Cost-to-go runs backward over turns and states: what it costs at least to
bring the rest of the conversation into order. A walk forward then takes, of the edits
that keep to that cost, the one with the least letter: D(elete), I(nsert), K(eep),
R(erole). The repaired turns are put together for their hash.

Rows are sorted by conversation and turn over ranges, so that a long conversation is
spread over tasks. Conversations that lie within a task are finished there. Those that
reach over its borders, or are long, become chunks: each has the matrix (of min and +)
that takes the cost-to-go after it to the one before it, one pass over these small
matrices gives every chunk its cost-to-go, chunks are then walked in parallel from
each state, and a last pass joins the walks and streams the turns through the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tables import written

#: Turns and bytes of text of a chunk (or one longer turn).
CHUNK_ROWS, CHUNK_BYTES = 1024, 1 << 16
#: Keys of repeated turns that are broadcast, at most; more are joined by a shuffle.
BROADCAST = 100_000
#: White space of the contract: all else shows.
SPACE = "' \\t\\n\\u000B\\f\\r'"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, OPENED, USER, ASSISTANT = range(4)
#: From a state to the next with a role of this initial; states in which a conversation may end.
STEPS = {"s": {START: OPENED}, "u": {START: USER, OPENED: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The only role that can be inserted or assigned in a state.
NEXT = {START: USER, OPENED: USER, ASSISTANT: USER, USER: ASSISTANT}
LEGAL = {"su", "ua", "au"}


def _kind(initial: str, fault: int) -> int:
    """Kind of a turn: 0 must go; else its initial, and whether it is truncated."""
    return 0 if fault in (1, 2) else 1 + 2 * ("sua".index(initial) if initial and initial in "sua" else 3) + (fault == 3)


def _moves(kind: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a turn: letter, cost, next state; by letter."""
    initial, extra = ("sua-"[(kind - 1) // 2], TRUNCATED * ((kind - 1) % 2)) if kind else ("-", 0)
    found = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if kind and state in STEPS.get(initial, {}):
            edits.append(("K", KEEP + extra, STEPS[initial][state]))
        if kind:
            edits.append(("R", REROLE + extra, NEXT[state]))
        found.append(edits)
    return found


MOVES = [_moves(kind) for kind in range(9)]


def _with_inserts(base: list[int]) -> list[int]:
    """The least cost if turns may be inserted first: never more than two, which go round the grammar's cycle."""
    user, assistant = min(base[USER], INSERT + base[ASSISTANT]), min(base[ASSISTANT], INSERT + base[USER])
    return [min(base[START], INSERT + user), min(base[OPENED], INSERT + user), user, assistant]


_FAR = 1 << 50
#: Cost-to-go after the last turn.
END = _with_inserts([0, _FAR, _FAR, 0])


def _before(kind: int, after: list[int]) -> list[int]:
    return _with_inserts([min(cost + after[to] for _, cost, to in edits) for edits in MOVES[kind]])


def costs_to_go(kinds: list[int], more: list[int], after: list[int]) -> list[list[int]]:
    """Cost-to-go before each turn and, last, after them; ``more``: further turns right after each that must all go."""
    found = [after]
    for kind, n in zip(reversed(kinds), reversed(more), strict=True):
        after = _before(kind, [x + DELETE * n for x in after])
        found.append(after)
    return found[::-1]


def matrix(kinds: list[int], more: list[int]) -> list[int]:
    """``m[4 i + j]``: the least cost of a chunk from state i to state j, insertions before its turns included."""
    columns = [costs_to_go(kinds, more, [0 if i == j else _FAR for i in range(4)])[0] for j in range(4)]
    return [min(columns[j][i], _FAR) for i in range(4) for j in range(4)]


def walk(kinds: list[int], more: list[int], togo: list[list[int]], state: int) -> tuple[str, int]:
    """Letters of the edits of a chunk from a state on, and the state after it."""
    letters = []
    for i, (kind, n) in enumerate(zip(kinds, more, strict=True)):
        after = [x + DELETE * n for x in togo[i + 1]]
        while True:
            left = togo[i][state]
            tight = {letter: to for letter, cost, to in MOVES[kind][state] if cost + after[to] == left}
            letter = min([*tight, "I"] if INSERT + togo[i][NEXT[state]] == left else tight)
            letters.append(letter)
            state = NEXT[state] if letter == "I" else tight[letter]
            if letter != "I":
                break
        letters.append("D" * n)
    return "".join(letters), state


def closing(state: int) -> str:
    """Insertions after the last turn."""
    return {START: "", OPENED: "II", USER: "I", ASSISTANT: ""}[state]


_ROLES = {USER: "user", ASSISTANT: "assistant"}


class Repaired:
    """The repaired conversation's hash, fed with edits and turns in order."""

    def __init__(self) -> None:
        self.digest, self.state, self.any = hashlib.sha256(), START, False

    def _put(self, role: str, text: str) -> None:
        self.digest.update(("\n" * self.any + f"{role}:{text}").encode())
        self.any = True

    def feed(self, letters: str, roles: list[str], texts: list[str], more: list[int]) -> None:
        at = 0
        for role, text, n in zip(roles, texts, more, strict=True):
            while letters[at] == "I":
                self.insert()
                at += 1
            if letters[at] == "K":
                self.state = STEPS[role[0]][self.state]
                self._put(role, text)
            elif letters[at] == "R":
                self.state = NEXT[self.state]
                self._put(_ROLES[self.state], text)
            at += 1 + n

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self._put(_ROLES[self.state], "")


class Facts:
    """What a stretch of turns counts; stretches in order add up."""

    NAMES = ["blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "first_turn", "last_turn", "first", "last"]

    def __init__(self, **known: Any):
        self.__dict__ |= dict.fromkeys(self.NAMES[:5], 0) | dict.fromkeys(self.NAMES[5:]) | known

    def add(self, other: Facts) -> None:
        self.illegal += other.illegal + (self.last is not None and other.first is not None and self.last + other.first not in LEGAL)
        self.turns += other.turns - (self.last_turn is not None and self.last_turn == other.first_turn)
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        for name, pick in (("least", min), ("most", max)):
            known = [x for x in (getattr(self, name), getattr(other, name)) if x is not None]
            setattr(self, name, pick(known) if known else None)
        self.first = other.first if self.first is None else self.first
        self.last = other.last if other.last is not None else self.last
        self.last_turn = other.last_turn if other.last is not None else self.last_turn

    @classmethod
    def of(cls, turn: int | None, initial: str, fault: int, n: int) -> Facts:
        """``n`` equal rows."""
        counts = {"blank": n, "duplicate": 0} if fault == 1 else {"duplicate": n} if fault == 2 else {"duplicate": n - 1, "truncated": int(fault == 3)}
        return cls(**counts, illegal=n - 1, turns=int(turn is not None), least=turn, most=turn, first_turn=turn, last_turn=turn, first=initial, last=initial)

    def result(self, cost: int, audit: str, digest: str) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


class Chunk:
    def __init__(self) -> None:
        self.kinds, self.more, self.roles, self.texts, self.facts, self.bytes = [], [], [], [], Facts(), 0

    def put(self, turn: int | None, role: str, text: str, fault: int, n: int) -> None:
        initial = role[:1]
        self.kinds.append(_kind(initial, fault))
        self.more.append(n - 1)
        self.roles.append(role)
        self.texts.append(text)
        self.facts.add(Facts.of(turn, initial, fault, n))
        self.bytes += len(text)

    def finished(self) -> dict:
        """The result of a conversation that is this chunk."""
        togo = costs_to_go(self.kinds, self.more, END)
        letters, state = walk(self.kinds, self.more, togo, START)
        out = Repaired()
        out.feed(letters, self.roles, self.texts, self.more)
        for _ in closing(state):
            out.insert()
        return self.facts.result(togo[0][START], letters + closing(state), out.digest.hexdigest())

    def row(self) -> dict:
        return {"kinds": self.kinds, "more": self.more, "roles": self.roles, "texts": self.texts, "facts": {k: getattr(self.facts, k) for k in Facts.NAMES}, "matrix": matrix(self.kinds, self.more)}


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FACTS = "struct<blank: long, duplicate: long, truncated: long, illegal: long, turns: long, least: long, most: long, first_turn: long, last_turn: long, first: string, last: string>"
_CHUNK = f"chunk long, kinds array<int>, more array<long>, roles array<string>, texts array<string>, facts {_FACTS}, matrix array<long>"


def _arrow(ddl: str) -> pa.Schema:
    """Made by the driver; tasks get it ready."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def _out(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{name: r.get(name) for name in schema.names} for r in rows], schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _stretches(schema: pa.Schema, chunk_rows: int, chunk_bytes: int):
    """Sorted turns to results of conversations that lie within the task, and chunks of those that may not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, out = TaskContext.get().partitionId() << 33, []
        chunk, key, first, split = None, None, True, False

        def close(last: bool) -> None:
            nonlocal made
            if first or last or split:
                out.append({"conv_id": key[0], "chunk": made} | chunk.row())
                made += 1
            else:
                out.append({"conv_id": key[0]} | chunk.finished())

        for r in _rows(batches):
            if key is None or key[0] != r["conv_id"]:
                if key is not None:
                    close(False)
                    first = False
                chunk, key, split = Chunk(), (r["conv_id"],), False
            elif len(chunk.kinds) >= chunk_rows or chunk.bytes >= chunk_bytes:
                split = True
                close(False)
                chunk = Chunk()
            if r["n"]:
                chunk.put(r["turn"], r["role"], r["text"], r["fault"], r["n"])
            if len(out) >= 256:
                yield _out(out, schema)
                out.clear()
        if key is not None:
            close(True)
        yield _out(out, schema)

    return run


def _ends(schema: pa.Schema):
    """Matrices by conversation, last chunk first: cost-to-go after each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, after, out = None, END, []
        for r in _rows(batches):
            if key != (r["conv_id"],):
                key, after = (r["conv_id"],), END
            out.append({"chunk": r["chunk"], "after": after})
            after = [min(r["matrix"][4 * i + j] + after[j] for j in range(4)) for i in range(4)]
            if len(out) >= 4096:
                yield _out(out, schema)
                out.clear()
        yield _out(out, schema)

    return run


def _walks(schema: pa.Schema):
    """Chunks with the cost-to-go after them: letters and last state from each state, and the cost-to-go before the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                togo = costs_to_go(r["kinds"], r["more"], r["after"])
                walks = [walk(r["kinds"], r["more"], togo, state) for state in range(4)]
                out.append({"chunk": r["chunk"], "letters": [w for w, _ in walks], "states": [s for _, s in walks], "before": togo[0]})
            yield _out(out, schema)

    return run


def _joined(schema: pa.Schema):
    """Chunks by conversation, in order, with their walks: results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, facts, repaired, audit, cost, state = None, None, None, [], 0, START

        def result() -> dict:
            for _ in closing(state):
                repaired.insert()
            return {"conv_id": key[0]} | facts.result(cost, "".join(audit) + closing(state), repaired.digest.hexdigest())

        for r in _rows(batches):
            if key != (r["conv_id"],):
                if key is not None:
                    yield _out([result()], schema)
                key, facts, repaired, audit, cost, state = (r["conv_id"],), Facts(), Repaired(), [], r["before"][START], START
            facts.add(Facts(**r["facts"]))
            letters = r["letters"][state]
            repaired.feed(letters, r["roles"], r["texts"], r["more"])
            audit.append(letters)
            state = r["states"][state]
        if key is not None:
            yield _out([result()], schema)

    return run


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copies``: the rows after the contract's damage, chosen by the CRC-32 of ``conv_id:turn``; nulls count as one space.

    A dropped row stays with 0 copies and no values, so that its conversation is known; a repeated one has 2.
    """
    text = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    code = (F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20).cast("int")
    plain = rows.select(rows[conv_col].alias("conv_id"), rows[turn_col].cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), code.alias("code"))
    kept = F.col("code") != 0
    hurt = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return plain.select(
        "conv_id", F.when(kept, F.col("turn")).alias("turn"), F.when(kept, F.when(F.col("code") == 4, "user").otherwise(F.col("role"))).alias("role"), F.when(kept, hurt).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _fault(again: Column) -> Column:
    """1 blank, 2 duplicate, 3 truncated, 0 none; of equal rows in one turn only the first is judged here."""
    shown = F.expr(f"trim(TRAILING {SPACE} FROM text)")
    return F.when(shown == "", 1).when(again, 2).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0).cast("int")


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every conversation of ``rows`` (``conv_id, turn, role, text, copies``; ``copies`` 0 only makes the conversation known).

    Turns are taken in order, nulls first; rows of one turn by role, then by a hash of
    the text. Null ids are one conversation. Roles are told apart by their first
    character; those that are neither s, u nor a (empty ones too) fit nowhere. A
    conversation without rows has zeros and the hash of nothing; an empty table gives
    no rows. Equal rows are counted before they are sent on; what a task holds is
    one chunk of a conversation, whatever its length, and the letters of its audit.
    """
    named = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(F.concat("role", F.lit(":"), "text"), 256)).alias("digest"), "text", "copies")
    # Equal rows as one, with their number; then the first turn of those that occur in several.
    once = written(named.groupBy("conv_id", "turn", "role", "digest").agg(F.any_value("text").alias("text"), F.sum("copies").alias("n")))
    several = once.where("n > 0").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    several = written(several.select(F.col("conv_id").alias("__conv"), F.col("digest").alias("__digest"), F.col("first.turn").alias("__first"), F.lit(True).alias("__several")))
    several = F.broadcast(several) if several.limit(BROADCAST + 1).count() <= BROADCAST else several
    met = once.join(several, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("digest") == F.col("__digest")), "left")
    again = F.coalesce(F.col("__several"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("__first"))
    judged = met.select("conv_id", "turn", "role", "digest", "text", "n", _fault(again).alias("fault"))
    order = ["conv_id", "turn", "role", "digest"]
    kind = dict(rows.dtypes)["conv_id"]
    whole = f"conv_id {kind}, {_RESULT}"
    stretches = f"{whole}, {_CHUNK}"
    sorted_rows = judged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "n", "fault")
    found = written(sorted_rows.mapInArrow(_stretches(_arrow(stretches), chunk_rows, chunk_bytes), stretches))
    names = ["conv_id", *(x.split()[0] for x in _RESULT.split(", "))]
    chunks = found.where("chunk IS NOT NULL")
    ended, walked = "chunk long, after array<long>", "chunk long, letters array<string>, states array<int>, before array<long>"
    ends = chunks.select("conv_id", "chunk", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(_ends(_arrow(ended)), ended)
    walks = chunks.select("chunk", "kinds", "more").join(written(ends), "chunk").mapInArrow(_walks(_arrow(walked)), walked)
    ordered = chunks.select("conv_id", "chunk", "roles", "texts", "more", "facts").join(written(walks), "chunk").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return found.where("chunk IS NULL").select(*names).unionByName(ordered.mapInArrow(_joined(_arrow(whole)), whole))
