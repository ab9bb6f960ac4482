"""Repair of conversation structure by depth-first branch and bound.

The repaired roles must read `(s?(ua)+)?` by their initials: perhaps a system turn, then user and assistant in
turns. A search node is (rows consumed, role state) with the cost and the audit of the edits so far. The
search keeps an explicit stack, takes cheap edits first, and gives a prefix up if its cost and the lower bound
of the rows left exceed the incumbent, if at equal cost its audit can no longer be less than the incumbent's, or
if the node's dominance entry holds a prefix that is as good. When the stack is empty, the incumbent is proved.

Rows are sorted over the whole table, so a conversation of any size is spread. A conversation that lies whole in
one task, which nearly all do, is repaired there. Others come in blocks of bounded size: each block is searched from
every role state to every other, and the small tables of the blocks are put together in order; at equal costs
no prefix of a node is the beginning of another, so the least of prefixes stays the least of wholes.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resona.llm.common import bounded_batches, col, read
from resona.session import cut_lineage

BLOCK_ROWS = 2000
BLOCK_CHARS = 4_000_000
TIE_CHARS = 256  # of a text, by which rows of one turn and role are ordered before its hash decides

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}  # what can be inserted, or a role become
AFTER = {"user": USER, "assistant": ASSISTANT}
LEGAL = {"su", "ua", "au"}
OPEN, DELETE, INSERT, REROLE, TRUNCATED = 1 << 40, 4, 3, 3, 3
AT_END = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}  # cost of inserting what is missing at the end


def fault_of(role: str, text: str, seen: set) -> str:
    """b(lank), d(uplicate), t(runcated) or - for a row, the first that holds; `seen` takes up its role and text."""
    end = text.rstrip(SPACE)
    if not end:
        return "b"
    if (role, text) in seen:
        return "d"
    seen.add((role, text))
    return "-" if end[-1] in ".!?" else "t"


def _edits(row: tuple[str, str] | None, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, state after, rows consumed) of every edit at a node; `row` is (initial of its role, fault)."""
    target = AFTER[WANTED[state]]
    found = [("I", INSERT, target, 0)]
    if row is not None:
        initial, fault = row
        found.append(("D", DELETE, state, 1))
        if fault not in "bd":
            extra = TRUNCATED if fault == "t" else 0
            found.append(("R", REROLE + extra, target, 1))
            if (state, initial) in KEEP:
                found.append(("K", extra, KEEP[state, initial], 1))
    return found


def lower_bounds(rows: list[tuple[str, str]], goal: int | None) -> list[list[int]]:
    """For each number of rows consumed and each state, what the rows left cost at least. `goal` is the state to
    end in, without an insertion behind the last row; None: any that the grammar accepts, with them."""
    last = [AT_END[q] if goal is None else (0 if q == goal else OPEN) for q in STATES]
    bounds = [last]
    for row in reversed(rows):
        behind = bounds[-1]
        own = [min(c + behind[q] for _, c, q, n in _edits(row, state) if n) for state in STATES]
        for _ in range(2):  # after two insertions a state comes again
            own = [min(own[state], INSERT + own[AFTER[WANTED[state]]]) for state in STATES]
        bounds.append(own)
    return bounds[::-1]


def search(rows: list[tuple[str, str]], start: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from `start` to `goal` (see `lower_bounds`), ties ASCII-least."""
    bounds, size = lower_bounds(rows, goal), len(rows)
    best: tuple[int, str] | None = None
    dominance: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, start)]
    while stack:
        cost, audit, i, state = stack.pop()
        total = cost + bounds[i][state]
        if total >= OPEN:
            continue
        if best is not None and (total > best[0] or total == best[0] and audit > best[1][:len(audit)]):
            continue
        known = dominance.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        dominance[i, state] = (cost, audit)
        at_end = i == size
        if at_end and (state == goal if goal is not None else AT_END[state] == 0):
            if best is None or (cost, audit) < best:
                best = (cost, audit)
            continue
        if at_end and goal is not None:
            continue
        edits = [
            (c + bounds[i + n][q], edit, cost + c, i + n, q)
            for edit, c, q, n in _edits(None if at_end else rows[i], state)
        ]
        edits.sort(reverse=True)  # the cheapest, then ASCII-least, is popped first
        stack += [(c, audit + edit, j, q) for _, edit, c, j, q in edits]
    return best


def applied(roles: list[str], texts: list[str], audit: str, state: int = START) -> tuple[list[str], list[str], int]:
    """The repaired roles and texts, and the state after them."""
    out, words, i = [], [], 0
    for edit in audit:
        role, text = (WANTED[state], "") if edit == "I" else (roles[i], texts[i])
        i += edit != "I"
        if edit == "D":
            continue
        state = KEEP[state, role[0]] if edit == "K" else AFTER[WANTED[state]]
        out.append(role if edit in "KI" else ("user" if state == USER else "assistant"))
        words.append(text)
    return out, words, state


# ---- rows of a block; a whole conversation is one block ----------------------------------------

COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _schema(conv: T.DataType, turn: T.DataType) -> T.StructType:
    """Of blocks. `faults` and `digests` are kept for blocks that may be part of a conversation only."""
    text, number = T.StringType(), T.LongType()
    return T.StructType([
        T.StructField("conv_id", conv), T.StructField("block", number), T.StructField("whole", T.BooleanType()),
        T.StructField("first_turn", turn), T.StructField("last_turn", turn), T.StructField("turns", number),
        T.StructField("first_initial", text), T.StructField("last_initial", text),
        *[T.StructField(c, number) for c in COUNTS], T.StructField("cost", number), T.StructField("audit", text),
        T.StructField("roles", T.ArrayType(text)), T.StructField("texts", T.ArrayType(text)),
        T.StructField("faults", text), T.StructField("digests", T.ArrayType(T.BinaryType())),
    ])


class _Block:
    """Rows of one conversation in order, as far as they came."""

    def __init__(self, conv, partition: int, number: int):
        self.conv, self.block = conv, (partition << 32) + number
        self.turns, self.roles, self.texts, self.chars = [], [], [], 0

    def add(self, turn, role: str, text: str, copies: int) -> None:
        self.turns += [turn] * copies
        self.roles += [role] * copies
        self.texts += [text] * copies
        self.chars += len(text) * copies

    def row(self, whole: bool) -> tuple:
        seen: set = set()
        faults = "".join(fault_of(r, t, seen) for r, t in zip(self.roles, self.texts))
        initials = [r[:1] for r in self.roles]
        turns = [t for t in self.turns if t is not None]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        facts = [
            self.conv, self.block, whole, *((turns[0], turns[-1]) if turns else (None, None)), len(set(turns)),
            *((initials[0], initials[-1]) if initials else (None, None)),
            faults.count("b"), faults.count("d"), faults.count("t"), illegal,
        ]
        if whole:
            cost, audit = search(list(zip(initials, faults)))
            roles, texts, _ = applied(self.roles, self.texts, audit)
            return (*facts, cost, audit, roles, texts, None, None)
        digests = [_digest(self.conv, r, t) for r, t in zip(self.roles, self.texts)]
        return (*facts, None, None, self.roles, self.texts, faults, digests)


def _digest(conv, role: str, text: str) -> bytes:
    return hashlib.blake2b(repr((conv, role, text)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _blocks(batches: Iterator[tuple], rows_each: int, chars_each: int) -> Iterator[tuple]:
    """Block rows of sorted rows (partition, conv_id, turn, role, text, copies) of one partition. The first and the
    last conversation may go on in other partitions, and a long one is cut: their blocks are not whole."""
    block, count, cut = None, 0, True
    for partition, conv, turn, role, text, copies in batches:
        if block is not None and conv != block.conv:
            yield block.row(whole=not cut)
            block, cut = None, False
        while copies or block is None:
            if block is None:
                block = _Block(conv, partition, count)
                count += 1
            room = max(1, min(rows_each - len(block.turns), (chars_each - block.chars) // max(1, len(text))))
            block.add(turn, role, text, min(copies, room))
            copies -= min(copies, room)
            if len(block.turns) >= rows_each or block.chars >= chars_each:
                cut = True
                yield block.row(whole=False)
                block = None
                if not copies:
                    break
        if block is None:  # the next row, or none, goes on
            block = _Block(conv, partition, count)
            count += 1
    if block is not None:
        yield block.row(whole=False)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 200) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _map(frame: DataFrame, run, schema: T.StructType) -> DataFrame:
    """`run` from an iterator of rows to one of rows, over each partition."""
    kind = to_arrow_schema(schema)
    return frame.mapInArrow(lambda batches: _batched(run(_rows(batches)), kind), schema)


# ---- conversations in several blocks -----------------------------------------------------------

TABLE = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("goal", T.IntegerType()),
    T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
]))


def _with_repeats(blocks: DataFrame) -> DataFrame:
    """`blocks` with `faults` that count rows whose role and text stand in an earlier block, too."""
    seen = blocks.select("block", F.explode(F.array_distinct("digests")).alias("digest"))
    first = seen.groupBy("digest").agg(F.min("block").alias("first"))
    again = seen.join(first, "digest").where("block > first").groupBy("block").agg(F.collect_list("digest").alias("known"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *facts, faults, digests, known in rows:
            known = set(known or ())
            faults = "".join("d" if f in "t-" and d in known else f for f, d in zip(faults, digests))
            yield (*facts[:9], faults.count("d"), faults.count("t"), *facts[11:], faults, digests)

    return _map(blocks.join(again, "block", "left").select(*blocks.columns, "known"), run, blocks.schema)


def _tables(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, table): the cheapest edits of each block from every state to every state."""
    schema = T.StructType([blocks.schema["conv_id"], blocks.schema["block"], T.StructField("table", TABLE)])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, block, roles, faults in rows:
            codes = list(zip([r[:1] for r in roles], faults))
            found = [(a, b, search(codes, a, b)) for a in STATES for b in STATES]
            yield conv, block, [{"start": a, "goal": b, "cost": f[0], "audit": f[1]} for a, b, f in found if f]

    return _map(blocks.select("conv_id", "block", "roles", "faults"), run, schema)


def _put_together(tables: DataFrame) -> DataFrame:
    """(block, start, cost, audit): the part of each block in its conversation's cheapest edits.

    Each conversation's blocks stream through in order. What all states have in common is passed on at once, so
    only the blocks about which they differ are held.
    """
    schema = T.StructType([
        tables.schema["block"], T.StructField("start", T.IntegerType()), T.StructField("cost", T.LongType()),
        T.StructField("audit", T.StringType()),
    ])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        live: dict[int, tuple[int, list]] = {}
        current, begun = None, False

        def finish() -> list:
            if not live:
                return []
            ends = [
                (cost + AT_END[q], "".join(p[3] for p in parts) + "I" * (AT_END[q] // INSERT), parts, AT_END[q])
                for q, (cost, parts) in live.items()
            ]
            *_, parts, extra = min(ends, key=lambda e: e[:2])
            *before, (block, start, cost, audit) = parts
            return [*before, (block, start, cost + extra, audit + "I" * (extra // INSERT))]

        for conv, block, table in rows:
            if not begun or conv != current:
                yield from finish()
                live, current, begun = {START: (0, [])}, conv, True
            found: dict[int, tuple[int, str, list]] = {}
            for entry in table:
                start, goal, cost, audit = entry["start"], entry["goal"], entry["cost"], entry["audit"]
                if start not in live:
                    continue
                total, parts = live[start]
                known = found.get(goal)
                if known is not None and total + cost > known[0]:
                    continue
                now = (total + cost, "".join(p[3] for p in parts) + audit)
                if known is None or now < known[:2]:
                    found[goal] = (*now, [*parts, (block, start, cost, audit)])
            live = {q: (cost, parts) for q, (cost, _, parts) in found.items()}
            one = next(iter(live.values()))[1]
            while len(one) > 1 and all(len(p) > 1 and p[0] == one[0] for _, p in live.values()):
                yield one[0]
                for _, parts in live.values():
                    del parts[0]
        yield from finish()

    parts = tables.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return _map(parts, run, schema)


def _repaired_blocks(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """`blocks` with cost and audit, and the repaired roles and texts instead of the given ones."""
    taken = blocks.drop("cost", "audit", "faults", "digests").join(parts, "block")
    names = [f.name for f in blocks.schema.fields[:-6]]

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *facts, roles, texts, cost, audit, start in rows:
            roles, texts, _ = applied(roles, texts, audit, start)
            yield (*facts, cost, audit, roles, texts, None, None)

    return _map(taken.select(*names, "roles", "texts", "cost", "audit", "start"), run, blocks.schema)


# ---- the operator ------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """`conversations` (conv_id, turn, role, text; null ones: one space in key, role and text) with `copies`, 0 to
    2, damaged by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats
    it, 4 makes its role user."""
    text = lambda name: F.coalesce(col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of each conversation, nearly always one per conversation, of `rows` (conv_id, turn, role, text
    and, if there, copies: how often a row counts, 0 included; other columns are not read).

    Columns: conv_id; block, which gives the order of a conversation's blocks; whole, if it is the only one; first_turn,
    last_turn and turns (distinct non-null ones); first_initial, last_initial; counts of faults (blank, duplicate,
    truncated) and of illegal neighbours in the block; cost and audit of the edits; repaired roles and texts.

    Null ids are one conversation, null roles and texts count as one space, null turns come first. Rows of one turn are
    ordered by role, then text (its first TIE_CHARS, then a hash). A role without a letter, or with another initial than
    s, u or a, cannot be kept. A conversation whose rows all count 0 times comes back with an empty block. Very long
    texts only make blocks shorter; a conversation of any number of rows is spread, copies of one row too. An empty table
    gives an empty result.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    copies = col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    text = lambda name: F.coalesce(col(name).cast("string"), F.lit(" "))
    chosen = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), copies.alias("copies"))
    keys = ["conv_id", "turn", "role", F.substring("text", 1, TIE_CHARS), F.xxhash64("text")]
    spread = chosen.withColumn("salt", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = spread.repartitionByRange(n, *keys, "salt").sortWithinPartitions(*keys)
    ordered = ordered.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "copies")
    schema = _schema(rows.schema["conv_id"].dataType, rows.schema["turn"].dataType)
    blocks = cut_lineage(_map(ordered, lambda r: _blocks(r, block_rows, block_chars), schema))
    cut = cut_lineage(_with_repeats(blocks.where("not whole")))
    parts = cut_lineage(_put_together(_tables(cut)))
    return blocks.where("whole").unionByName(_repaired_blocks(cut, parts)).drop("faults", "digests")


DIGESTS = ["gaps", *COUNTS, "cost"]


def _lines() -> Column:
    return F.concat_ws("\n", F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)))


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of `repair`'s blocks: conv_id, gaps, counts of faults, cost, audit, and the SHA-256 of the
    repaired `role:text` lines. The lines of a conversation in several blocks stream through the hash in order, for
    a digest has no parts; only counters and the audit are held."""
    whole, other = repaired.where("whole"), repaired.where("not whole")
    spread = (F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).cast("long")
    facts = [F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"), *COUNTS, "cost", "audit"]
    direct = whole.select("conv_id", *facts, F.sha2(_lines(), 256).alias("repaired_sha256"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        current, begun, state = None, False, None

        def finish() -> list[tuple]:
            if state is None:
                return []
            first, last, turns = state["first"], state["last"], state["turns"]
            gaps = 0 if first is None else last - first + 1 - turns
            return [(current, gaps, *state["counts"], "".join(state["audit"]), state["sha"].hexdigest())]

        for conv, _, first, last, turns, a, z, *counts, audit, lines, some in rows:
            if not begun or conv != current:
                yield from finish()
                current, begun = conv, True
                state = {"first": None, "last": None, "turns": 0, "initial": None, "counts": [0] * len(counts),
                         "audit": [], "sha": hashlib.sha256(), "some": False}
            if first is not None:
                state["turns"] += turns - (state["last"] == first)
                state["first"] = first if state["first"] is None else state["first"]
                state["last"] = last
            state["counts"] = [x + y for x, y in zip(state["counts"], counts)]
            if a is not None:
                if state["initial"] is not None and state["initial"] + a not in LEGAL:
                    state["counts"][COUNTS.index("illegal")] += 1
                state["initial"] = z
            state["audit"].append(audit)
            if some:
                state["sha"].update(("\n" * state["some"] + lines).encode())
                state["some"] = True
        yield from finish()

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in direct.schema.fields])
    parts = other.select(
        "conv_id", "block", "first_turn", "last_turn", "turns", "first_initial", "last_initial", *COUNTS, "cost", "audit",
        _lines().alias("lines"), (F.size("roles") > 0).alias("some"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return direct.unionByName(_map(parts, run, schema))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damage(read(spark, sf_dir, "conversations"))))
