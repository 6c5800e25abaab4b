"""Conversation structure repair: least edits to a system row and user-assistant pairs, found by Hirschberg's method."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize

#: what a repaired conversation may be after so many rows: nothing yet, a system row, ... ends with user, with assistant
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)  # the state that a user or assistant row leads to
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5  # costs; a row that stays costs nothing, an unfinished one 5 more
NEVER = 1 << 60
#: rows inserted at the end, and their cost, by the state before
CLOSING = ("", "I" * 2, "I", "")
CLOSING_COST = tuple(INSERT * len(word) for word in CLOSING)
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"

LONG_ROWS, LONG_CHARS = 4096, 1 << 23  # a conversation beyond either is repaired block by block, by many tasks
EDITS = ("part long, block long, place long, edit string, fault string, turn long, was string, role string, text string")

#: step: for every state before, the (state after, cost, order of its edits among those from this state)
Step = tuple[tuple[tuple[int, int, int], ...], ...]


def fault_of(role: str, text: str, repeated: bool) -> str:
    """The first fault of a row, or none."""
    bare = text.rstrip(WHITE)
    return "blank" if not bare else "duplicate" if repeated else "" if bare[-1] in ".!?" else "truncated"


def kind_of(role: str, fault: str) -> int:
    """What edits know of a row: whether it must go or is unfinished, and what its role begins with."""
    return 4 * (2 if fault == "truncated" else 1 if fault else 0) + INITIALS.get(role[:1], 0)


def _edits_of(kind: int) -> tuple[Step, tuple[dict[int, str], ...]]:
    """The step of a row of that kind, and its cheapest edits by state before and after, rows inserted ahead included.

    Of edits that cost the same the least in ASCII stays. They end in the row's own letter, so none begins another.
    """
    fate, initial = divmod(kind, 4)
    step, words = [], []
    for before in range(4):
        best: dict[int, tuple[int, str]] = {}
        state = before
        for inserted in range(3):  # a third row would only lead to where the first did
            ahead, cost = "I" * inserted, INSERT * inserted
            stay = UNFINISHED if fate == 2 else 0
            ways = [(state, DELETE, "D")]
            if fate != 1:
                ways.append((FOLLOWS[state], REROLE + stay, "R"))
                if initial and initial == (SYSTEM if initial == SYSTEM and state == START else FOLLOWS[state]):
                    ways.append((initial, stay, "K"))
            for after, more, letter in ways:
                best[after] = min(best.get(after, (NEVER, "")), (cost + more, ahead + letter))
            state = FOLLOWS[state]
        order = sorted(best, key=lambda after: best[after][1])
        step.append(tuple((after, best[after][0], order.index(after)) for after in best))
        words.append({after: word for after, (_, word) in best.items()})
    return tuple(step), tuple(words)


STEPS, WORDS = zip(*map(_edits_of, range(12)))


def ahead(steps: Sequence[Step], low: int, high: int, start: int) -> tuple[list[int], list[int]]:
    """Cost of reaching every state over ``steps[low:high]``, and the order of the least edits that do.

    After a row no edits begin other ones, so their first difference, which the order holds, decides for good.
    """
    cost, order = [NEVER] * 4, [0] * 4
    cost[start] = 0
    for k in range(low, high):
        best: list = [None] * 4
        for before in range(4):
            if cost[before] < NEVER:
                for after, more, rank in steps[k][before]:
                    way = (cost[before] + more, order[before], rank)
                    if best[after] is None or way < best[after]:
                        best[after] = way
        cost = [NEVER if way is None else way[0] for way in best]
        for place, after in enumerate(sorted((a for a in range(4) if best[a]), key=lambda a: best[a][1:])):
            order[after] = place
    return cost, order


def behind(steps: Sequence[Step], low: int, high: int, end: Sequence[int]) -> list[int]:
    """Cost of going on from every state over ``steps[low:high]`` to an end."""
    cost = list(end)
    for k in range(high - 1, low - 1, -1):
        cost = [min((more + cost[after] for after, more, _ in ways), default=NEVER) for ways in steps[k]]
    return cost


def only(state: int) -> list[int]:
    return [0 if s == state else NEVER for s in range(4)]


def crossings(steps: Sequence[Step], start: int, end: Sequence[int]) -> list[int]:
    """The state after each step on the cheapest way from ``start`` to an end, of equal ones the audit-least.

    Cost vectors from both sides meet in the middle; the cheapest state there splits the work in two. Vectors are four
    numbers, so beside the result nothing grows with the conversation.
    """
    out: list[int] = []
    todo = [(0, len(steps), start, end)] if len(steps) else []
    while todo:
        low, high, first, last = todo.pop()
        middle = (low + high + 1) // 2
        cost, order = ahead(steps, low, middle, first)
        rest = behind(steps, middle, high, last)
        state = min(range(4), key=lambda s: (cost[s] + rest[s], order[s]))
        if high - low == 1:
            out.append(state)
        else:
            todo += [(middle, high, state, last), (low, middle, first, only(state))]
    return out


def composed(steps: Sequence[Step]) -> Step:
    """Many steps as one."""
    out = []
    for start in range(4):
        cost, order = ahead(steps, 0, len(steps), start)
        out.append(tuple((after, cost[after], order[after]) for after in range(4) if cost[after] < NEVER))
    return tuple(out)


def edited(rows: Sequence[tuple], start: int, states: Sequence[int], closing: str) -> Iterator[tuple]:
    """(edit, fault, turn, was, role, text) of every edit of rows (turn, role, text, fault), inserted rows among them.

    A deleted row has no role and text after it, an inserted one no turn and no role before.
    """
    state = start

    def inserted(count: int) -> Iterator[tuple]:
        nonlocal state
        for _ in range(count):
            state = FOLLOWS[state]
            yield "I", "", None, None, ROLES[state], ""

    for (turn, role, text, fault), after in zip(rows, states):
        word = WORDS[kind_of(role, fault)][state][after]
        yield from inserted(len(word) - 1)
        edit = word[-1]
        yield (edit, fault, turn, role, None if edit == "D" else ROLES[after] if edit == "R" else role,
               None if edit == "D" else text)
        state = after
    yield from inserted(len(closing))


def repaired(rows: Sequence[tuple]) -> Iterator[tuple]:
    """The edits of one whole conversation of rows (turn, role, text)."""
    seen, marked = set(), []
    for turn, role, text in rows:
        marked.append((turn, role, text, fault_of(role, text, (role, text) in seen)))
        seen.add((role, text))
    states = crossings([STEPS[kind_of(role, fault)] for _, role, _, fault in marked], START, CLOSING_COST)
    return edited(marked, START, states, CLOSING[states[-1]] if states else "")


class Report:
    """Gaps, faults, cost, audit and digest of one conversation, from its edits in order."""

    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.turns = 0
        self.first = self.last = self.role = None
        self.audit, self.digest, self.empty = [], hashlib.sha256(), True

    def add(self, edit: str, fault: str, turn: int | None, was: str | None, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if fault:
            self.faults[fault] += 1
            self.cost += UNFINISHED if fault == "truncated" and edit != "D" else 0
        if edit != "I":
            self.illegal += self.role is not None and self.role + was[:1] not in LEGAL
            self.role = was[:1]
            if turn is not None and turn != self.last:  # rows come by turn
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
        if edit != "D":
            line = f"{role}:{text}" if self.empty else f"\n{role}:{text}"
            self.digest.update(line.encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded length."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _fields(schema: str, **first: pa.DataType) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([*first.items(), *((n, types[t]) for n, t in (c.split() for c in schema.split(", ")))])


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, rows) of rows sorted by their first column."""
    held, conv_id = [], None
    for row in rows:
        if held and row[0] != conv_id:
            yield conv_id, held
            held = []
        conv_id = row[0]
        held.append(row[1:])
    if held:
        yield conv_id, held


def _named(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _measured(rows: DataFrame) -> DataFrame:
    """(conv_id, conv, long) of every conversation: its number, and whether it goes block by block."""
    weight = F.sum(F.length("role") + F.length("text"))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), weight.alias("chars"))
    big = (F.col("n") > LONG_ROWS) | (F.col("chars") > LONG_CHARS)
    return sizes.select("conv_id", F.monotonically_increasing_id().alias("conv"), big.alias("long"))


def _short_edits(rows: DataFrame, long: DataFrame, fold: bool) -> DataFrame:
    """Edits, or reports with ``fold``, of the conversations that one task may hold."""
    of_id = rows.schema["conv_id"].dataType
    short = rows.join(long.select(F.col("conv_id").alias("_long")), F.col("conv_id").eqNullSafe(F.col("_long")), "left_anti")
    fields = _fields(REPORT if fold else EDITS, conv_id=to_arrow_type(of_id))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for conv_id, held in _conversations(_rows(batches)):
                if fold:
                    report = Report()
                    for edit in repaired(held):
                        report.add(*edit)
                    yield conv_id, *report.row()
                else:
                    for place, edit in enumerate(repaired(held)):
                        yield conv_id, 0, 0, place, *edit

        yield from _batches(results(), fields)

    return (short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(found, f"conv_id {of_id.simpleString()}, {REPORT if fold else EDITS}"))


def _blocks(rows: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """Rows of long conversations in order, in blocks of bounded size: conv, part, block, place and their kind.

    Parts are ranges of the common order of all rows, so a conversation of any length is spread over tasks.
    """
    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    # the first of equal rows, by number where their turns tie
    first = numbered.groupBy("conv", "role", F.sha2(F.col("text").cast("binary"), 256).alias("same")).agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn", "row"))["row"].alias("_first"))
    marked = numbered.join(first.select("_first"), F.col("row") == F.col("_first"), "left")
    order = ["conv", "turn", "role", "text", "row"]
    placed = "conv long, part long, block long, place long, turn long, role string, text string, fault string"
    fields = _fields(placed)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def results() -> Iterator[tuple]:
            last, block, place, chars = None, 0, 0, 0
            for conv, turn, role, text, repeated in _rows(batches):
                if conv != last or place == block_rows or chars >= block_chars:
                    block, place, chars, last = block + 1, 0, 0, conv
                yield conv, part, block, place, turn, role, text, fault_of(role, text, repeated)
                place, chars = place + 1, chars + len(text)

        yield from _batches(results(), fields)

    in_order = marked.withColumn("repeated", F.col("_first").isNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(in_order.select("conv", "turn", "role", "text", "repeated").mapInArrow(found, placed))


FLAT = pa.list_(pa.int64())


def _flat(step: Step) -> list[int]:
    """before, after, cost, order of every way, one behind the other."""
    return [x for before, ways in enumerate(step) for way in ways for x in (before, *way)]


def _step(flat: list[int]) -> Step:
    ways: list[list] = [[], [], [], []]
    for k in range(0, len(flat), 4):
        ways[flat[k]].append(tuple(flat[k + 1:k + 4]))
    return tuple(map(tuple, ways))


def _steps_of(rows: DataFrame, keys: list[str], order: str, kinds: bool) -> DataFrame:
    """One step for all rows of a group, from kinds of rows or from the steps of the level below."""
    def found(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        steps = [STEPS[k] for k in table["kind"].to_pylist()] if kinds else list(map(_step, table["step"].to_pylist()))
        return pa.table({**{k: table[k][:1] for k in keys}, "step": pa.array([_flat(composed(steps))], FLAT)})

    columns = [*keys, order, "kind" if kinds else "step"]
    return rows.select(*columns).groupBy(*keys).applyInArrow(
        found, ", ".join(f"{k} long" for k in keys) + ", step array<long>")


def _ways_of(steps: DataFrame, wanted: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """State before and after each step of a group whose ``wanted`` ones are given; whole conversations end as they may.

    ``last`` marks the step that ends a conversation.
    """
    names, whole = [*keys, order], wanted is None

    def found(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        steps = list(map(_step, table["step"].to_pylist()))
        start, end, last = (START, None, True) if whole else (table[c][0].as_py() for c in ("before", "after", "last"))
        after = crossings(steps, start, CLOSING_COST if end is None else only(end))
        columns = {k: table[k] for k in names}
        return pa.table({**columns, "before": pa.array([start, *after[:-1]], pa.int64()), "after": pa.array(after, pa.int64()),
                         "last": pa.array([False] * (len(after) - 1) + [last], pa.bool_())})

    given = steps if wanted is None else steps.join(wanted, keys)
    return given.groupBy(*keys).applyInArrow(
        found, ", ".join(f"{k} long" for k in names) + ", before long, after long, last boolean")


def _long_edits(rows: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """Edits of long conversations: blocks become steps of parts, parts of conversations; there the vectors meet first,
    then inside parts, then inside blocks. A task holds a block, the blocks of a part, or a step for every part."""
    blocks = _blocks(rows, block_rows, block_chars)
    kinds = {(r, f): kind_of(r, f) for r in ("", "s", "u", "a") for f in ("", "blank", "truncated")}
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("")
    fate = F.when(F.col("fault") == "duplicate", "blank").otherwise(F.col("fault"))
    named = F.concat_ws("/", initial, fate)
    kind = F.create_map(*[F.lit(x) for (r, f), k in kinds.items() for x in (f"{r}/{f}", k)])[named]
    of_block = materialize(_steps_of(blocks.withColumn("kind", kind), ["conv", "part", "block"], "place", True))
    of_part = materialize(_steps_of(of_block, ["conv", "part"], "block", False))
    parts = _ways_of(of_part, None, ["conv"], "part")
    ways = materialize(_ways_of(of_block, parts, ["conv", "part"], "block"))
    fields = _fields("conv long, " + EDITS)

    def found(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        held = list(zip(*(table[c].to_pylist() for c in ("turn", "role", "text", "fault"))))
        conv, part, block, start, end, last = (table[c][0].as_py() for c in ("conv", "part", "block", "before", "after", "last"))
        states = crossings([STEPS[kind_of(role, fault)] for _, role, _, fault in held], start, only(end))
        out = [(conv, part, block, place, *edit) for place, edit in enumerate(
            edited(held, start, states, CLOSING[end] if last else ""))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), fields.types)], schema=fields)

    return blocks.join(ways, ["conv", "part", "block"]).groupBy("conv", "part", "block").applyInArrow(
        found, f"conv long, {EDITS}")


def _long_reports(edits: DataFrame) -> DataFrame:
    """Reports of long conversations. A digest reads its text in one run, so a conversation's edits stream through one
    task, which holds its audit and no text."""
    fields = _fields("conv long, " + REPORT)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            conv, report = None, None
            for row in _rows(batches):
                if row[0] != conv:
                    if report:
                        yield conv, *report.row()
                    conv, report = row[0], Report()
                report.add(*row[1:])
            if report:
                yield conv, *report.row()

        yield from _batches(results(), fields)

    return (edits.repartition("conv").sortWithinPartitions("conv", "part", "block", "place")
            .select("conv", "edit", "fault", "turn", "was", "role", "text").mapInArrow(found, f"conv long, {REPORT}"))


def _parted(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows, the long conversations, and their rows with the conversation's number."""
    rows = _named(conversations)
    long = materialize(_measured(rows).where("long"))
    numbers = long.select(F.col("conv_id").alias("_long"), "conv")
    own = rows.join(numbers, F.col("conv_id").eqNullSafe(F.col("_long"))).select("conv", "turn", "role", "text")
    return rows, long, own


def repair(conversations: DataFrame, block_rows: int = LONG_ROWS, block_chars: int = LONG_CHARS) -> DataFrame:
    """The edits that repair every conversation, in the order of part, block and place within a conv_id.

    Rows count by turn, null turns first, ties by role and text; a null role or text reads as one space. Edits are K
    (keep), R (another role), D (delete) and I (insert); role and text are those after the edit, ``was`` the role
    before. What stays has roles whose initials read ``(s?(ua)+)?``, at the least cost, the audit-least of equal ones.
    A null conv_id is a conversation too; an empty table has no edits.
    """
    rows, long, own = _parted(conversations)
    short = _short_edits(rows, long, fold=False)
    if long.isEmpty():
        return short
    names = [c.split()[0] for c in EDITS.split(", ")]
    return short.union(_long_edits(own, block_rows, block_chars).join(long, "conv").select("conv_id", *names))


def repair_report(conversations: DataFrame, block_rows: int = LONG_ROWS, block_chars: int = LONG_CHARS) -> DataFrame:
    """conv_id and gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the edits of ``repair``."""
    rows, long, own = _parted(conversations)
    short = _short_edits(rows, long, fold=True)
    if long.isEmpty():
        return short
    reports = _long_reports(_long_edits(own, block_rows, block_chars))
    return short.union(reports.join(long, "conv").select(*short.columns))


def damaged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows after the damage that the hash of conv_id and turn names, and all conv_ids there were before it."""
    def text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate"))
    hurt = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    left = rows.where("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"),
        copies.alias("copy")).drop("copy")
    return left, conversations.select("conv_id").distinct()


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """``repair_report`` of the damaged rows, with zeros for a conversation that lost all its rows."""
    left, ids = damaged(conversations)
    report = repair_report(left)
    values = [c for c in report.columns if c != "conv_id"]
    empty = hashlib.sha256().hexdigest()
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(empty)}
    joined = ids.join(report.withColumnRenamed("conv_id", "_conv_id"), F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    return joined.select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in values])
