"""Conversation structure repair by weighted CYK interval parsing.

A conversation is well formed if its role initials are nothing, or an optional ``s`` followed by one or
more ``ua``. Rows are kept (K, cost 0), given the role user or assistant (R, 2) or deleted (D, 3); rows
with empty text may be inserted anywhere (I, 2). Blank and repeated rows must go, a truncated row that
stays costs 1 more. The cheapest edits are wanted, and of those the ASCII-least string of edit initials.

The language is given as a grammar in Chomsky normal form. Its nonterminals ``(p, q)`` derive what leads
from state p of the form to state q; binary rules are ``(p, q) -> (p, r) (r, q)``, terminals are edited
rows. The cell of a span of rows holds for each nonterminal the smallest (cost, edits). Insertions derive
from no row, so each row's cell is closed under them to both sides. Cells are combined bottom-up by
span length: 1, 2, 4, ... rows. Binary rules concatenate, so every split of a span gives the same cell and
one split is enough; of two equally cheap edit strings of one cell neither is a prefix of the other, so
the least of the parts is the least of the whole.

A conversation may hold any share of the rows: rows are dealt by ranges of (conversation, order), spans of up
to ``SPAN`` rows are parsed where they lie, and only their cells meet per conversation, as a stack of
spans of falling length. Repeated rows are found by a grouping of hashes, not by a set in memory. Repaired
texts stream through the task that writes them (``sha2`` of a conversation is one pass by nature).

Order: by turn (nulls first), then role, then hash of the text. Nulls: a null role or text is one blank; rows
without conv_id form a conversation of their own. Rows of an empty role can only be given another role or
deleted. Repeated rows are duplicates. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.llm.common import BLANKS, materialise, partition_count, text_batches

#: Steps of the form (s?(ua)+)?: state, role initial, next state. It may end in any of ENDS.
STEPS = [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)]
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPAN = 512
_CACHED = 8

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(pairs: Iterator[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    out: Cell = {}
    for rule, value in pairs:
        if rule not in out or value < out[rule]:
            out[rule] = value
    return out


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    return _least(((p, q), (c + d, a + b)) for (p, r), (c, a) in left.items() for (s, q), (d, b) in right.items() if r == s)


def _insertions() -> Cell:
    """What no row derives: up to as many insertions as there are states."""
    states = sorted({p for p, _, _ in STEPS} | {q for _, _, q in STEPS})
    once = {(p, q): (INSERT, "I") for p, initial, q in STEPS if initial in ROLES}
    closed: Cell = {(p, p): (0, "") for p in states}
    for _ in states:
        closed = _least(iter([*closed.items(), *combine(closed, once).items()]))
    return closed


NOTHING = _insertions()


def row_cell(code: str) -> Cell:
    """Cell of one row: its initial (``.`` if no step takes it), in upper case if truncated; ``-`` must go."""
    edits = [((p, p), (DELETE, "D")) for p, _ in NOTHING if (p, p) in NOTHING]
    if code != "-":
        more = TRUNCATED if code.isupper() else 0
        edits += [((p, q), (more, "K")) for p, initial, q in STEPS if initial == code.lower()]
        edits += [((p, q), (REROLE + more, "R")) for p, initial, q in STEPS if initial in ROLES]
    return combine(combine(NOTHING, _least(iter(edits))), NOTHING)


def parse(codes: str, known: dict[str, Cell]) -> Cell:
    """Cell of a span of rows, combined bottom-up; short spans are remembered in ``known``."""
    if not codes:
        return NOTHING
    cells = []
    for at in range(0, len(codes), _CACHED):
        part = codes[at : at + _CACHED]
        if part not in known:
            if len(known) > 100_000:
                known.clear()
            row = [row_cell(c) for c in part]
            while len(row) > 1:
                row = [combine(*row[k : k + 2]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
            known[part] = row[0]
        cells.append(known[part])
    while len(cells) > 1:
        cells = [combine(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


def apply_edits(edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired conversation, row by row."""
    after = {(p, initial): q for p, initial, q in STEPS}
    state = 0
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = next(ROLES[i] for p, i, _ in STEPS if p == state and i in ROLES)
        state = after[state, role[0]]
        yield edit, role, text


def _rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a null role or text is one blank."""
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the query damages them, by crc32 of ``conv_id:turn`` mod 20 (0 to 4: see the cases below)."""
    rows = _rows(conversations)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return out.where("times > 0").select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("_n")).drop("_n")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows in order with a number: parts of the order in parts of the table, a conversation across several."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    rows = rows.withColumn("digest", F.sha2("text", 256))
    n = partition_count(rows.sparkSession)
    return materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))


def _codes(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, initial, fault, code) of each row."""
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first_pos")).select("first_pos", F.lit(True).alias("is_first"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.rtrim(F.regexp_replace("text", BLANKS, " ")).rlike(r"[.!?]\z")
    slim = rows.select("conv_id", "pos", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), truncated.alias("truncated"))
    met = slim.join(first, slim["pos"] == first["first_pos"], "left")
    fault: Column = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    met = met.select("conv_id", "pos", "initial", fault.alias("fault"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(".")
    # a row of no known initial can only be given a role: a truncated one is told apart by a letter no step takes
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.when(letter == ".", "X").otherwise(F.upper(letter))).otherwise(letter)
    return met.withColumn("code", code)


_LEGAL = {"su", "ua", "au"}
_SPAN = "conv_id {0}, pos long, first string, last string, illegal long, blank long, duplicate long, truncated long, rules array<int>, costs array<long>, edits array<string>"


def _spans(codes: DataFrame, key_type: str) -> DataFrame:
    """One row per span of at most ``SPAN`` rows of one conversation, with its cell."""

    def out(held: list[dict], known: dict) -> pa.RecordBatch:
        cols: dict[str, list] = {k: [] for k in ("conv_id", "pos", "first", "last", "illegal", "blank", "duplicate", "truncated", "rules", "costs", "edits")}
        for s in held:
            cell = parse("".join(s["codes"]), known)
            initials, faults = s["initials"], s["faults"]
            cols["conv_id"].append(s["conv_id"])
            cols["pos"].append(s["pos"])
            cols["first"].append(initials[0])
            cols["last"].append(initials[-1])
            cols["illegal"].append(sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)))
            for fault in ("blank", "duplicate", "truncated"):
                cols[fault].append(faults.count(fault))
            cols["rules"].append([4 * p + q for p, q in cell])
            cols["costs"].append([c for c, _ in cell.values()])
            cols["edits"].append([e for _, e in cell.values()])
        arrays = [pa.array(v, t) for v, t in zip(cols.values(), arrow, strict=True)]
        return pa.record_batch(arrays, list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Cell] = {}
        held: list[dict] = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for conv, pos, initial, fault, code in zip(*columns, strict=True):
                if not held or held[-1]["conv_id"] != conv or len(held[-1]["codes"]) == SPAN:
                    if len(held) >= 1000:
                        yield out(held, known)
                        held = []
                    held.append({"conv_id": conv, "pos": pos, "codes": [], "initials": [], "faults": []})
                span = held[-1]
                span["codes"].append(code)
                span["initials"].append(initial)
                span["faults"].append(fault)
        if held:
            yield out(held, known)

    key = {"bigint": pa.int64(), "int": pa.int32()}.get(key_type, pa.string())
    arrow = [key, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
    n = partition_count(codes.sparkSession)
    rows = codes.select("conv_id", "pos", "initial", "fault", "code").repartitionByRange(n, "pos").sortWithinPartitions("pos")
    return rows.mapInArrow(run, _SPAN.format(key_type))


_PARSED = "conv_id {0}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _parsed(spans: DataFrame, key_type: str) -> DataFrame:
    """One row per conversation: its faults and cheapest edits."""

    def conversation(rows: Iterator[tuple]) -> tuple:
        counts = [0, 0, 0, 0]
        before = None
        stack: list[tuple[int, Cell]] = []  # spans of falling length, as in a binary counter
        for _, _, first, last, illegal, *faults, rules, costs, edits in rows:
            counts = [a + b for a, b in zip(counts, [*faults, illegal], strict=True)]
            counts[3] += before is not None and before + first not in _LEGAL
            before = last
            stack.append((1, {(r // 4, r % 4): (c, e) for r, c, e in zip(rules, costs, edits, strict=True)}))
            while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                n, right = stack.pop()
                _, left = stack.pop()
                stack.append((2 * n, combine(left, right)))
        while len(stack) > 1:
            _, right = stack.pop()
            _, left = stack.pop()
            stack.append((0, combine(left, right)))
        return (*counts, *cheapest(stack[0][1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        held: list[tuple] = []
        for conv, group in groupby(rows, key=lambda r: r[0]):
            held.append((conv, *conversation(group)))
            if len(held) == 1000:
                yield out(held)
                held = []
        if held:
            yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*held, strict=True), arrow, strict=True)], names)

    key = {"bigint": pa.int64(), "int": pa.int32()}.get(key_type, pa.string())
    arrow = [key, *[pa.int64()] * 5, pa.string()]
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    n = partition_count(spans.sparkSession)
    return spans.repartition(n, "conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, _PARSED.format(key_type))


def _keyed(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a conv_id that Arrow hands through (other types than integers as text), and its type."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        rows, kind = rows.withColumn("conv_id", F.col("conv_id").cast("string")), "string"
    return rows, kind


def _edited(rows: DataFrame, parsed: DataFrame, key_type: str, digest: bool) -> DataFrame:
    """The repaired conversations: a row per turn, or a hash per conversation."""

    def turns(rows: Iterator[tuple]) -> Iterator[tuple]:
        # the first row of a conversation, of no number, brings the edits
        for conv, group in groupby(rows, key=lambda r: r[0]):
            _, _, _, edits = next(group)
            yield conv, apply_edits(edits, ((role, text) for _, _, role, text in group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        held: list[tuple] = []
        size = 0
        for conv, repaired in turns(rows):
            if digest:
                h, between = hashlib.sha256(), b""
                for _, role, text in repaired:
                    h.update(between + f"{role}:{text}".encode())
                    between = b"\n"
                held.append((conv, h.hexdigest()))
                size += 100
            else:
                for n, (edit, role, text) in enumerate(repaired):
                    held.append((conv, n, edit, role, text))
                    size += 100 + len(text)
                    if size > 1 << 20:
                        yield out(held)
                        held, size = [], 0
            if size > 1 << 20:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*held, strict=True), arrow, strict=True)], names)

    key = {"bigint": pa.int64(), "int": pa.int32()}.get(key_type, pa.string())
    if digest:
        arrow, names, schema = [key, pa.string()], ["conv_id", "repaired_sha256"], f"conv_id {key_type}, repaired_sha256 string"
    else:
        arrow = [key, pa.int64(), pa.string(), pa.string(), pa.string()]
        names, schema = ["conv_id", "position", "edit", "role", "text"], f"conv_id {key_type}, position long, edit string, role string, text string"
    head = parsed.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    every = text_batches(rows).select("conv_id", "pos", "role", "text").unionByName(head)
    n = partition_count(rows.sparkSession)
    return every.repartition(n, "conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, schema)


def _repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    rows, key_type = _keyed(rows)
    numbered = _numbered(rows)
    return numbered, materialise(_parsed(_spans(_codes(numbered), key_type), key_type)), key_type


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text) of the cheapest well-formed conversations."""
    numbered, parsed, key_type = _repair(_rows(conversations))
    return _edited(numbered, parsed, key_type, digest=False)


def repair_audit(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, cost and audit of the cheapest repair, hash of the repaired one."""
    numbered, parsed, key_type = _repair(rows)
    hashes = _edited(numbered, parsed, key_type, digest=True).withColumnRenamed("conv_id", "_conv")
    turns = numbered.groupBy("conv_id", "turn").agg(F.lit(1).alias("_one"))
    gaps = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "_gap_conv")
    out = parsed.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv"))).join(gaps, F.col("conv_id").eqNullSafe(F.col("_gap_conv")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The audit of the damaged conversations; those of which no row is left have an empty one."""
    ids, _ = _keyed(conversations.select("conv_id").distinct())
    audit = repair_audit(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    met = ids.join(audit, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return met.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
