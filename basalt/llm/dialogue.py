"""Repair of conversations: the cheapest edits that give every conversation the shape of turns by a user and an assistant.

A message has a letter: u, a, s or o by the initial of its role (user, assistant, system, other), upper case if
its text is truncated, x if it is blank or a duplicate and has to go. The cheapest edits follow from these letters
alone, so conversations with the same letters share one computation, and those with the same first letters share
its beginning: signatures are sorted by range over the whole table, and each partition inserts its own, in order,
into a prefix trie. A node holds one layer of the dynamic program: for every state of the wanted shape the
smallest cost, and among equal costs the least string of edits. A layer is computed once, when its node is made;
what a terminal node holds is the answer of all conversations that end there. As signatures come sorted, only
the branch to the newest one can grow, and the rest of the trie is let go. A range may split the conversations of
one signature, so no signature makes a hot task.

A conversation of more than `size` messages is cut into segments. A later segment begins in an unknown state, so
its layers hold the answers from each state, and one pass in order composes them. No array holds more
messages than that; messages are numbered by a window that sorts on disk if need be, and the digest is a running one.

Shape: initials match (s?(ua)+)?. Keep costs 0, change the role 3, delete 4, insert an empty message of the next
role 3; a truncated message that stays costs 3 more. Edits are written K, R, D, I; among the cheapest the least
string is taken.

Defined results: null roles and texts are one space; an empty role has no initial and is never kept; the rows of a
conversation are taken by turn (nulls first), then role, then text; a null conv_id is a conversation of its own;
repeated rows are duplicates. A conversation of which no row is present has no counts, cost 0 and no edits. Texts
and conversations may be of any length. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import record_batch, written

SEGMENT = 512
KEEP, CHANGE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the shape: at the start, after s, after u, after a. A conversation may end in the first or the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: The only state that a changed or inserted message can lead to.
MADE = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
SUMS = (*COUNTS, "low", "high", "turns")
Best = tuple[int, str] | None
Layer = list[list[Best]]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows as they are after the crc32 of conv_id:turn has damaged one in four."""
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(kind == 4, "user").otherwise(text_of("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("present"))


def segments(rows: DataFrame, present: Column | None = None, size: int = SEGMENT) -> DataFrame:
    """conv_id, segment, signature, messages (role, text) in order, and the counts of the segment's faults and turns.

    A row that is not present only names its conversation.
    """
    own = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.lit(True) if present is None else present).alias("present"))
    own = own.repartition("conv_id")
    conversation = Window.partitionBy("conv_id", "present")
    own = own.withColumn("place", F.row_number().over(conversation.orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    own = own.withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("place")) > 1)
    in_order = conversation.orderBy("place")
    own = own.withColumns({"initial": F.substring("role", 1, 1), "before": F.lag("turn").over(in_order)})
    blank = ~F.col("text").rlike(NOT_SPACE)
    fault = F.when(blank, "blank").when(F.col("seen"), "duplicate").when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "truncated").otherwise("none")
    own = own.withColumns({"fault": fault, "pair": F.concat(F.lag("initial").over(in_order), "initial")})
    letter = F.when(F.col("initial").isin("u", "a", "s"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    here = F.col("present")
    number = lambda cond: F.sum(F.when(here & cond, 1).otherwise(0)).cast("long")
    counts = [number(F.col("fault") == name).alias(name) for name in COUNTS[:3]] + [number(~F.col("pair").isin("su", "ua", "au")).alias("illegal")]
    new = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before"))
    turns = [F.min(F.when(here, F.col("turn"))).cast("long").alias("low"), F.max(F.when(here, F.col("turn"))).cast("long").alias("high"), number(new).alias("turns")]
    segment = F.when(here, F.floor((F.col("place") - 1) / size)).otherwise(0).cast("long")
    message = F.when(here, F.struct("place", letter.alias("letter"), "role", "text"))
    out = own.groupBy("conv_id", segment.alias("segment")).agg(F.array_sort(F.collect_list(message)).alias("m"), *counts, *turns)
    signature = F.concat(F.when(F.col("segment") == 0, "^").otherwise("+"), F.array_join("m.letter", ""))
    return out.select("conv_id", "segment", signature.alias("signature"), F.transform("m", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("messages"), *SUMS)


def _better(one: Best, other: Best) -> Best:
    return other if one is None or (other is not None and other < one) else one


def _with_inserts(row: list[Best]) -> list[Best]:
    for state in (START, AFTER_S, AFTER_U, AFTER_A):  # in this order one pass is enough
        if (best := row[state]) is not None:
            row[MADE[state]] = _better(row[MADE[state]], (best[0] + INSERT, best[1] + "I"))
    return row


def _after(row: list[Best], letter: str) -> list[Best]:
    """The best of every state after one more message."""
    out: list[Best] = [None] * 4
    more = TRUNCATED if letter.isupper() else 0
    for state, best in enumerate(row):
        if best is None:
            continue
        cost, edits = best
        out[state] = _better(out[state], (cost + DELETE, edits + "D"))
        if letter != "x":
            to = NEXT.get((state, letter.lower()))
            if to is not None:
                out[to] = _better(out[to], (cost + KEEP + more, edits + "K"))
            out[MADE[state]] = _better(out[MADE[state]], (cost + CHANGE + more, edits + "R"))
    return _with_inserts(out)


class Trie:
    """Prefix trie of signatures that are inserted in sorted order; nodes off the newest branch are let go."""

    def __init__(self) -> None:
        self.letters, self.layers = "", []
        self.made = 0

    def insert(self, signature: str) -> Layer:
        """The layer of the signature's terminal node."""
        shared = 0
        for a, b in zip(self.letters, signature, strict=False):
            if a != b:
                break
            shared += 1
        del self.layers[shared:]
        for letter in signature[shared:]:
            self.layers.append(self._layer(letter))
            self.made += 1
        self.letters = signature
        return self.layers[-1]

    def _layer(self, letter: str) -> Layer:
        if letter == "^":  # of a first segment
            return [_with_inserts([(0, ""), None, None, None])]
        if letter == "+":  # of a later one: from each state
            return [[(0, "") if to == state else None for to in range(4)] for state in range(4)]
        return [_after(row, letter) for row in self.layers[-1]]


def answers(parts: DataFrame) -> DataFrame:
    """conv_id, segment, the segment's sums, best: for each state before and after it the cost and the edits, or null."""
    keys = parts.select("signature", "conv_id", "segment", *SUMS)
    keys = keys.repartitionByRange("signature", "conv_id", "segment").sortWithinPartitions("signature")
    kind = parts.schema["conv_id"].dataType.simpleString()
    best_type = pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            best = [[None if x is None else {"cost": x[0], "edits": x[1]} for row in trie.insert(s) for x in row] for s in batch.column(0).to_pylist()]
            rest = {name: batch.column(name) for name in ("conv_id", "segment", *SUMS)}
            yield record_batch(rest | {"best": pa.array(best, best_type)})

    return keys.mapInArrow(run, f"conv_id {kind}, segment long, {', '.join(f'{n} long' for n in SUMS)}, best array<struct<cost long, edits string>>")


def _placed(edits: str, cuts: int, size: int) -> list[list[tuple[int | None, str | None]]]:
    """For each of `cuts` segments the messages that stay: their place (null: inserted) and new role (null: as it is)."""
    odd = (len(edits) - edits.count("D")) % 2  # then the first one is of the system, and users and assistants follow
    out: list[list[tuple[int | None, str | None]]] = [[] for _ in range(cuts)]
    taken = stay = 0
    for edit in edits:
        role = "user" if (stay - odd) % 2 == 0 else "assistant"
        if edit == "I":
            out[min(cuts - 1, taken // size)].append((None, role))
        elif edit != "D":
            out[taken // size].append((taken % size, role if edit == "R" else None))
        taken += edit != "I"
        stay += edit != "D"
    return out


def edits(parts: DataFrame, size: int = SEGMENT) -> DataFrame:
    """conv_id, segment, stays (place in the segment, role), and in a conversation's first segment its cost, edits and sums."""
    best = answers(parts).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    kind = parts.schema["conv_id"].dataType
    stays_type = pa.list_(pa.struct([("place", pa.int32()), ("role", pa.string())]))
    numbers = ("gaps", *COUNTS, "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # of one conversation, without its messages

        def finished(rows: list[dict]) -> list[dict]:
            state: list[Best] = [(0, ""), None, None, None]
            for row in rows:
                cells = [None if x is None else (x["cost"], x["edits"]) for x in row["best"]]
                after: list[Best] = [None] * 4
                for i, cell in enumerate(cells):
                    so_far = state[i // 4]
                    if cell is not None and so_far is not None:
                        after[i % 4] = _better(after[i % 4], (so_far[0] + cell[0], so_far[1] + cell[1]))
                state = after
            cost, text = min(x for x in (state[q] for q in ENDS) if x is not None)
            lows, highs = [r["low"] for r in rows if r["low"] is not None], [r["high"] for r in rows if r["high"] is not None]
            total = {name: sum(r[name] for r in rows) for name in (*COUNTS, "turns")}
            gaps = max(highs) - min(lows) + 1 - total["turns"] if lows else 0
            out = [{"conv_id": r["conv_id"], "segment": r["segment"], "stays": [{"place": p, "role": x} for p, x in stay]} for r, stay in zip(rows, _placed(text, len(rows), size), strict=True)]
            out[0] |= {"gaps": gaps, **{name: total[name] for name in COUNTS}, "cost": cost, "audit": text}
            return out

        def batch_of(rows: list[dict], ids: pa.DataType) -> pa.RecordBatch:
            get = lambda name, t: pa.array([r.get(name) for r in rows], t)
            return record_batch({"conv_id": get("conv_id", ids), "segment": get("segment", pa.int64()), "stays": get("stays", stays_type)} | {n: get(n, pa.int64()) for n in numbers} | {"audit": get("audit", pa.string())})

        ids = pa.int64()
        for batch in batches:
            done, ids = [], batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if row["segment"] == 0 and held:
                    done += finished(held)
                    held = []
                held.append(row)
            if done:
                yield batch_of(done, ids)
        if held:
            yield batch_of(finished(held), ids)

    return best.mapInArrow(run, f"conv_id {kind.simpleString()}, segment long, stays array<struct<place int, role string>>, {', '.join(f'{n} long' for n in numbers)}, audit string")


def repair(rows: DataFrame, present: Column | None = None, size: int = SEGMENT) -> DataFrame:
    """conv_id, segment, messages (role, text) after repair; in the first segment also gaps, the counts of faults, cost and audit."""
    parts = written(segments(rows, present, size), "segments")
    plan = edits(parts, size)
    both = plan.join(parts.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.col("messages").alias("old")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    old = lambda x: F.element_at("old", x.place + 1)
    messages = F.transform("stays", lambda x: F.struct(F.coalesce(x.role, F.when(x.place.isNotNull(), old(x)["role"])).alias("role"), F.when(x.place.isNull(), "").otherwise(old(x)["text"]).alias("text")))
    return both.select("conv_id", "segment", messages.alias("messages"), "gaps", *COUNTS, "cost", "audit")


def report(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: its sums, audit and the sha256 of its repaired role:text lines."""
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.text)), "\n").cast("binary")
    rows = repaired.select("conv_id", "segment", F.when(F.size("messages") > 0, lines).alias("lines"), "gaps", *COUNTS, "cost", "audit")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    kind = repaired.schema["conv_id"].dataType.simpleString()
    own = ("gaps", *COUNTS, "cost", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict | None = None
        running, some = hashlib.sha256(), False
        types: dict[str, pa.DataType] = {}

        def out(rows: list[dict]) -> pa.RecordBatch:
            names = ("conv_id", *own, "repaired_sha256")
            return record_batch({n: pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names})

        for batch in batches:
            types, done = {f.name: f.type for f in batch.schema}, []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "segment", "lines", *own)]
            for conv_id, segment, text, *rest in zip(*columns, strict=True):
                if segment == 0:
                    if head is not None:
                        done.append(head | {"repaired_sha256": running.hexdigest()})
                    head = {"conv_id": conv_id} | dict(zip(own, rest, strict=True))
                    running, some = hashlib.sha256(), False
                if text is not None:
                    running.update(b"\n" + text if some else text)
                    some = True
            if done:
                yield out(done)
        if head is not None:
            yield out([head | {"repaired_sha256": running.hexdigest()}])

    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, {', '.join(f'{n} long' for n in COUNTS)}, cost long, audit string, repaired_sha256 string")
