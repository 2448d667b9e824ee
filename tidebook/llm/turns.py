"""Repair of the structure of conversations: which turns to keep, rename or delete, and where a turn is missing.

A repaired conversation is empty or an optional system turn followed by pairs of user and assistant. Its edits are found by
dynamic programming over *retained* turns, those kept or given another role: whatever lies between two retained turns is
deleted, at the difference of two prefix sums of deletion costs, and the pair of their roles says which turns have to be
inserted between them. So the best continuation of a turn needs one running minimum for each role that may come next, of
cost plus prefix sum, and a conversation of n turns takes n steps. Of edits that cost the same, the one whose audit (D, I, K
or R by edit, in order) is the smallest string is taken, letter by letter, from the costs to go.

Rows travel sorted by conversation and turn; the edits are found from hashes and flags alone, and texts are shuffled once.
A conversation's flags and costs stay in its task: one byte a turn, and the costs of every `BLOCK`th turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebook.llm.common import WHITE, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Turns between two places at which the costs to go are remembered.
BLOCK = 4096
#: States: at the start, after a system turn, a user's, an assistant's. What comes next, and what an end costs there.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
#: Inserts between a state and a retained role (system, user, assistant).
BETWEEN = ((0, 0, INSERT), (NEVER, 0, INSERT), (NEVER, INSERT, 0), (NEVER, 0, INSERT))
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A turn in one byte: the state its role leads to (0 for other roles), and what is wrong with it.
MUST_GO, CUT = 4, 8
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def to_go(codes: bytes | bytearray, least: tuple[int, int, int], at: int, n: int) -> Iterator[tuple[int, int, int]]:
    """Running minima from the last turn of `codes` back to the first, the turns from `at` on of n.

    Each is, by the role retained next (system, user, assistant), the least cost of all that follows, deletions counted from
    the conversation's start.
    """
    s, u, a = least
    end = n * DELETE
    for k in range(len(codes) - 1, -1, -1):
        code = codes[k]
        if not code & MUST_GO:
            role, fault = code & 3, TRUNCATED if code & CUT else 0
            before, after = (at + k) * DELETE + fault, (at + k + 1) * DELETE
            # the cost after this turn, by its role, less the deletions up to it
            as_user = min(end + END[USER], u + INSERT, a) - after
            as_assistant = min(end, u, a + INSERT) - after
            user, assistant = (before + as_user + (KEEP if role == USER else REROLE)), (before + as_assistant + (KEEP if role == ASSISTANT else REROLE))
            if role == SYSTEM:
                s = min(s, before + min(end + END[SYSTEM], u, a + INSERT) - after + KEEP)
            u, a = min(u, user), min(a, assistant)
        yield s, u, a


def repair(codes: bytes | bytearray) -> tuple[int, bytearray]:
    """Cost and audit of the cheapest edits of a conversation, given one code a turn."""
    n = len(codes)
    marks = {}  # the running minima at the end of each block
    least = (NEVER, NEVER, NEVER)
    for at in range((max(n, 1) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        marks[at] = least
        for least in to_go(codes[at : at + BLOCK], least, at, n):
            pass

    def cost(state: int, least: tuple[int, int, int], i: int) -> int:
        between = BETWEEN[state]
        return min(n * DELETE + END[state], *(x + y for x, y in zip(least, between, strict=True))) - i * DELETE

    state, audit, total = START, bytearray(), cost(START, least, 0)
    for at in range(0, max(n, 1), BLOCK):
        part = codes[at : at + BLOCK]
        ahead = [marks[at], *to_go(part, marks[at], at, n)][::-1]
        for k in range(len(part) + 1):
            i, code = at + k, part[k] if k < len(part) else None
            if code is None and i < n:
                break
            while True:
                left = cost(state, ahead[k], i)
                if code is not None and DELETE + cost(state, ahead[k + 1], i + 1) == left:
                    audit += b"D"
                    break
                if (code is not None or left) and INSERT + cost(NEXT[state], ahead[k], i) == left:
                    audit += b"I"
                    state = NEXT[state]
                    continue
                if code is None:
                    break
                fault, kept = TRUNCATED if code & CUT else 0, code & 3
                if kept and BETWEEN[state][kept - 1] == 0 and KEEP + fault + cost(kept, ahead[k + 1], i + 1) == left:
                    audit += b"K"
                    state = kept
                else:
                    audit += b"R"
                    state = NEXT[state]
                break
    return total, audit


ROWS = "conv_id", "turn", "role", "digest", "copy"


def prepared(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest, copy``; a null role or text is one space, `copy` orders what is else equal."""
    copy = F.col("copy") if "copy" in turns.columns else F.lit(0)
    df = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copy.alias("copy"))
    return df.withColumn("digest", F.unhex(F.md5("text")))


def judged(rows: DataFrame) -> DataFrame:
    """Prepared turns in order within their conversations, with faults and codes: ``conv_id, turn, fault, code, illegal, fresh``.

    `fault` is 1 for a blank turn, 2 for a duplicate, 3 for a truncated one, else 0; `fresh` marks the first row of a turn.
    Repeats are counted by conversation, role and text before they meet their rows, so no row waits for all of its copies.
    """
    shown = F.rtrim("text", F.lit(WHITE))
    when = F.struct(F.col("turn").isNotNull(), "turn")
    df = rows.select(*ROWS, (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(*".!?")).alias("cut"))
    first = df.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.count("*").alias("n"), F.min(when).alias("first")).filter("n > 1")
    df = df.join(first, df["conv_id"].eqNullSafe(first["c"]) & (df["role"] == first["r"]) & (df["digest"] == first["d"]), "left")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "digest", "copy")
    before = lambda c: F.lag(c).over(order)
    follows = before(F.lit(1)).isNotNull()
    initial = F.substring("role", 1, 1)
    df = df.select(
        *ROWS, "blank", "cut", (F.coalesce(when > F.col("first"), F.lit(False)) | follows & F.col("turn").eqNullSafe(before("turn")) & (F.col("role") == before("role")) & (F.col("digest") == before("digest"))).alias("seen"),
        initial.alias("initial"), F.concat(before(initial), initial).alias("pair"), F.coalesce(F.col("turn") != before("turn"), F.col("turn").isNotNull()).alias("fresh"),
    )
    fault = F.when(F.col("blank"), 1).when(F.col("seen"), 2).when(F.col("cut"), 3).otherwise(0)
    state = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(0)
    code = state + F.when(fault.isin(1, 2), MUST_GO).when(fault == 3, CUT).otherwise(0)
    return df.select("conv_id", "turn", fault.alias("fault"), code.alias("code"), F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False)).alias("illegal"), "fresh")


def _audit_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and audit of each conversation, of turns that come one conversation after the other, in order."""
    none = object()
    current, codes, counts, low, high, turns = none, bytearray(), [0] * 5, None, None, 0

    def row() -> tuple:
        cost, audit = repair(codes)
        return current, 0 if low is None else high - low + 1 - turns, *counts[1:4], counts[4], cost, audit.decode()

    for batch in batches:
        done = []
        for conv, turn, fault, code, illegal, fresh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != current:
                if current is not none:
                    done.append(row())
                current, codes, counts, low, high, turns = conv, bytearray(), [0] * 5, None, None, 0
            codes.append(code)
            counts[fault] += 1
            counts[4] += illegal
            if turn is not None:
                low, high, turns = turn if low is None else low, turn, turns + fresh
        if done:
            yield _rows(done)
    if current is not none:
        yield _rows([row()])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, *rest, audit = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, pa.int64()) for c in rest), pa.array(audit, pa.string())], ["conv_id", *COUNTS, "audit"])


def audits(turns: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    Turns come by `turn`, null first; of one turn, by role, then by the hash of the text. Turns without a conv_id are one
    conversation. `gaps` are the turns missing between the first and the last; without any number, 0. Null roles and texts
    are one space, so such a role is none of the known ones and such a text blank. Empty tables give an empty result.
    Repeated rows are duplicates. A text of any length is only hashed here. Further columns are ignored.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    df = judged(prepared(turns))
    return df.mapInArrow(_audit_each, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


def _edit_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of each conversation: a row with its audit comes first, then its turns in order."""
    conv, audit, at, state, place = None, "", 0, START, 0
    out: list[tuple] = []

    def inserted() -> None:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            out.append((conv, place, ROLES[state], "", "I"))
            at, place = at + 1, place + 1

    for batch in batches:
        for new, letters, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if letters is not None:
                conv, audit, at, state, place = new, letters, 0, START, 0
            else:
                letter, at = audit[at], at + 1
                if letter != "D":
                    state = NEXT[state] if letter == "R" else {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                    out.append((conv, place, ROLES[state] if letter == "R" else role, text, letter))
                    place += 1
            inserted()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (None, pa.int64(), *[pa.string()] * 3), strict=True)], ["conv_id", "place", "role", "text", "edit"])
            out.clear()


def repaired(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """The repaired turns, by the audits of `audits`: ``conv_id, place, role, text, edit`` (K, R or I).

    Rows of a conversation are in one partition, one after the other and in order. Texts pass by a batch at a time; a task
    holds one conversation's audit.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    none = [F.lit(None).cast(t).alias(n) for n, t in (("turn", turns.schema["turn"].dataType.simpleString()), ("role", "string"), ("digest", "binary"), ("copy", "int"), ("text", "string"))]
    rows = prepared(turns).select(*ROWS, "text", F.lit(None).cast("string").alias("audit")).unionByName(audit.select("conv_id", *none, "audit"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest", "copy")
    return rows.select("conv_id", "audit", "role", "text").mapInArrow(_edit_each, f"conv_id {kind}, place long, role string, text string, edit string")


def _hash_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = object()
    current, digest = none, None
    rows = lambda some: pa.RecordBatch.from_arrays([pa.array([c for c, _ in some]), pa.array([h for _, h in some], pa.string())], ["conv_id", "repaired_sha256"])
    for batch in batches:
        done = []
        for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != current or not place:
                if current is not none:
                    done.append((current, digest.hexdigest()))
                current, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield rows(done)
    if current is not none:
        yield rows([(current, digest.hexdigest())])


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired turns as `repaired` leaves them, those of `role:text` joined by newlines."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.select("conv_id", "place", "role", "text").mapInArrow(_hash_each, f"conv_id {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns as a transport may leave them, by the CRC of ``conv_id:turn`` modulo 20 (nulls are one space).

    0 loses the turn, 1 its text, 2 its marks of a sentence's end; 3 repeats it, 4 makes it a user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    return turns.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def repair_report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Faults, audit and the hash of the repaired turns of each conv_id in `conversations`, those without any turn included."""
    audit = stored(audits(turns), "audits")
    hashes = digests(repaired(turns, audit))
    ids = conversations.select("conv_id").distinct()
    found = audit.join(hashes.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of").withColumnRenamed("conv_id", "of")
    df = ids.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return df.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
