"""Conversation structure repair by a Viterbi search over edits, with survivor coalescence.

A repaired conversation is empty or has the role initials ``s?(ua)+``. Each row is kept
(cost 0), given the role user or assistant (Rerole, 2) or deleted (3); an empty row may be
inserted before any row and at the end (2). Blank and duplicate rows must be deleted; a row
that stays although its text is cut off adds 1. Of the cheapest edits the ones with the
least initials (D, I, K, R) are taken.

The search has four states: nothing yet, after the system row, after a user row, after an
assistant row. One path per state survives. Paths are a tree of backpointers with reference
counts; a node is dropped when no survivor descends from it, and as soon as all survivors
share an ancestor, the edits up to it are final, are returned and are forgotten. A survivor
that costs strictly more than another one plus the most that the other needs to follow it can
neither win nor tie and is dropped too, so that hopeless paths do not hold the others back.

Ties compare the whole paths since the last shared node. Every node's edits end with the letter
of its row, so no path is a prefix of another one, and the order of two paths stays as it was
when they parted: the survivors' ranks hold the outcome of comparing their complete unresolved
edits, and a tie costs one look at them instead of a walk.

Rows of a conversation stream through a task in their order; memory holds the rows that are not
final: a few, except where two ways of equal cost go on side by side (user rows only, say: which
one is cheaper depends on whether their number is even). A conversation with very many rows is cut into slices that are searched in parallel from
each state; a chain over one small matrix per slice then says by which states the best path
goes, and each slice returns its part.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from creditpath.llm.common import crc_of, stash
from creditpath.plans.skew import HOT_ROWS, SLICE, hot_key_cuts, with_slices

SPACE = r"\x20\x09-\x0D"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
CUT_OFF = 1  # for a truncated row that stays

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"  # of the states after a row: SYSTEM, USER, ASSISTANT
ROLE = {USER: "user", ASSISTANT: "assistant"}
# The state after an inserted or reroled row.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# Where a row may be kept: its initial, by the state before it.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
# Inserts that end a conversation.
CLOSING = {NOTHING: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
# The most that the first state pays, beyond the second one's cost, to reach an end as the second would.
FOLLOWING = {
    (NOTHING, SYSTEM): 0, (NOTHING, USER): 2, (NOTHING, ASSISTANT): 0,
    (SYSTEM, NOTHING): 4, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 4,
    (USER, NOTHING): 5, (USER, SYSTEM): 2, (USER, ASSISTANT): 2,
    (ASSISTANT, NOTHING): 3, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 2,
}

LEGAL = {"su", "ua", "au"}

ORDER = ["turn", "same"]
EDITS = "step long, edit string, turn long, role string, text string, initial string, fault string, cost long"
DIGEST = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
# Rows and characters of a returned batch.
BATCH_ROWS, BATCH_CHARS = 8_000, 8_000_000


class _Node:
    """The edits of one row on a path: inserts, then the row's own."""

    __slots__ = ("parent", "edits", "state", "refs", "children")

    def __init__(self, parent: _Node | None, edits: str, state: int):
        self.parent, self.edits, self.state, self.refs, self.children = parent, edits, state, 0, []
        if parent is not None:
            parent.refs += 1
            parent.children.append(self)


class Survivors:
    """The cheapest path into each state over the rows seen so far; ``final`` takes each row's final edits."""

    def __init__(self, final, start: int = NOTHING):
        self.final = final
        self.root = _Node(None, "", start)
        self.root.refs = 1
        # State: (cost, rank among the survivors' paths, last node).
        self.paths = {start: (0, 0, self.root)}

    def row(self, initial: str, fault: str | None) -> None:
        """Take the next row."""
        must_go = fault in (BLANK, DUPLICATE)
        stays = CUT_OFF if fault == TRUNCATED else 0
        best: dict[int, tuple] = {}
        for source, (cost, rank, node) in self.paths.items():
            state, inserts = source, ""
            while True:
                moves = [(state, COST[DELETE], DELETE)]
                if not must_go:
                    kept = KEPT.get((state, initial))
                    if kept is not None:
                        moves.append((kept, stays, KEEP))
                    moves.append((NEXT[state], COST[REROLE] + stays, REROLE))
                for to, price, letter in moves:
                    found = (cost + price, rank, inserts + letter, node)
                    if to not in best or found[:3] < best[to][:3]:
                        best[to] = found
                # Two inserts lead back to the state after a user or an assistant row.
                if len(inserts) == (2 if source in (NOTHING, SYSTEM) else 1):
                    break
                state, inserts, cost = NEXT[state], inserts + INSERT, cost + COST[INSERT]
        order = {state: i for i, state in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        for state in [*best]:
            own = (best[state][0], order[state])
            if any(o != state and (best[o][0] + FOLLOWING[o, state], order[o]) < own for o in best):
                del best[state]
        before = [node for _, _, node in self.paths.values()]
        self.paths = {}
        for state, (cost, _, edits, parent) in best.items():
            node = _Node(parent, edits, state)
            node.refs = 1
            self.paths[state] = (cost, order[state], node)
        for node in before:
            self._release(node)
        # One descendant line: what it begins with is final.
        while self.root.refs == 1 and self.root.children:
            (child,) = self.root.children
            self.final(self.root.state, child.edits)
            child.parent = None
            self.root = child

    def _release(self, node: _Node) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs:
                return
            parent = node.parent
            if parent is not None:
                parent.children.remove(node)
            node = parent

    def unresolved(self, state: int) -> list[_Node]:
        """The nodes of a survivor's path that are not final yet."""
        nodes, node = [], self.paths[state][2]
        while node is not self.root:
            nodes.append(node)
            node = node.parent
        return nodes[::-1]

    def best_end(self) -> int:
        """The state in which the cheapest whole path ends, before its closing inserts."""

        def key(state):
            cost, rank, _ = self.paths[state]
            return cost + COST[INSERT] * len(CLOSING[state]), rank

        return min(self.paths, key=key)

    def finish(self, state: int) -> None:
        for node in self.unresolved(state):
            self.final(node.parent.state, node.edits)


def _values(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        columns = batch.to_pydict()
        yield from zip(*(columns[name] for name in names))


class _Edits:
    """Edit rows of one conversation (or slice), made as their edits become final."""

    def __init__(self, out: _Batches, conv_id, part, start: int, first_step: int = 0):
        self.out, self.key, self.step = out, (conv_id, part), first_step
        self.waiting: deque[tuple] = deque()
        self.search = Survivors(self._final, start)

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        # A row that must go decides nothing, so it may wait long; it waits without its text.
        self.waiting.append((turn, role, None if fault in (BLANK, DUPLICATE) else text, fault))
        self.search.row(role[:1], fault)

    def _final(self, state: int, edits: str) -> None:
        for letter in edits[:-1]:
            state = self.insert(state)
        turn, role, text, fault = self.waiting.popleft()
        letter, initial = edits[-1], role[:1]
        cost = COST[letter] + (CUT_OFF if fault == TRUNCATED and letter != DELETE else 0)
        if letter == REROLE:
            role = ROLE[NEXT[state]]
        self._put(letter, turn, role, None if letter == DELETE else text, initial, fault, cost)

    def insert(self, state: int) -> int:
        state = NEXT[state]
        self._put(INSERT, None, ROLE[state], "", None, None, COST[INSERT])
        return state

    def _put(self, *values) -> None:
        self.out.put((*self.key, self.step, *values))
        self.step += 1

    def end(self, state: int | None, closes: bool) -> None:
        state = self.search.best_end() if state is None else state
        self.search.finish(state)
        for _ in CLOSING[state] if closes else "":
            state = self.insert(state)


class _Batches:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def put(self, row: tuple) -> None:
        self.rows.append(row)
        self.chars += sum(len(v) for v in row if isinstance(v, str))

    def full(self) -> bool:
        return len(self.rows) >= BATCH_ROWS or self.chars >= BATCH_CHARS

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t.type) for c, t in zip(columns, self.schema)], schema=self.schema
        )


def _parse(ddl: str) -> list[StructField]:
    return list(StructType.fromDDL(ddl))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with planted faults, chosen by crc32(``conv_id:turn``) % 20.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    A NULL role or text, and a NULL part of the key, is one space. Further columns are left out.
    """
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    kind, text = F.pmod(crc_of(key), F.lit(20)), F.coalesce("text", one)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", one)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _prepared(conversations: DataFrame) -> DataFrame:
    one = F.lit(" ")
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, one).alias(c) for c in ("role", "text")]
    )
    return rows.withColumn("same", F.sha2(F.concat("role", F.lit("\n"), "text").cast("binary"), 256))


def _repeated_across(rows: DataFrame) -> DataFrame:
    """Add ``again``: whether an earlier slice of the conversation has the row's role and text."""
    seen = rows.where(F.col(SLICE).isNotNull()).groupBy("conv_id", "same", SLICE).count()
    seen = seen.withColumn("first", F.min(SLICE).over(Window.partitionBy("conv_id", "same"))).where(f"{SLICE} > first")
    seen = seen.select(F.col("conv_id").alias("_c"), F.col("same").alias("_t"), F.col(SLICE).alias("_s"))
    match = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("same") == F.col("_t")) & (F.col(SLICE) == F.col("_s"))
    return rows.join(seen, match, "left").withColumn("again", F.col("_s").isNotNull()).drop("_c", "_t", "_s")


def _with_faults(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation and slice, with their first fault."""
    part = ["conv_id", SLICE]
    rows = rows.repartition(*part)
    nth = F.row_number().over(Window.partitionBy(*part, "same").orderBy("turn"))
    last = F.substring(F.regexp_replace("text", f"[{SPACE}]+$", ""), -1, 1)
    fault = (
        F.when(last == "", BLANK).when(F.col("again") | (nth > 1), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED)
    )
    return rows.withColumn("fault", fault).select(*part, *ORDER, "role", "text", "fault")


def _matrices(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per slice: cost and rank of the best path from each state into each state."""
    out = _Batches(schema)

    def close(key, runs):
        found = []
        for start, (letters, search) in runs.items():
            for end in search.paths:
                path = "".join(letters) + "".join(node.edits for node in search.unresolved(end))
                found.append((path, start, end, search.paths[end][0]))
        places = {path: i for i, path in enumerate(sorted({f[0] for f in found}))}
        for path, start, end, cost in found:
            out.put((*key, start, end, cost, places[path]))

    key, runs = None, {}
    for conv_id, part, role, fault in _values(batches, ["conv_id", SLICE, "role", "fault"]):
        if key != (conv_id, part):
            if runs:
                close(key, runs)
            key, runs = (conv_id, part), {}
            for start in range(4):
                letters: list[str] = []
                runs[start] = (letters, Survivors(lambda _, edits, to=letters: to.append(edits), start))
        for _, search in runs.values():
            search.row(role[:1], fault)
        if out.full():
            yield out.take()
    if runs:
        close(key, runs)
    yield out.take()


def _chain(matrices: pd.DataFrame) -> pd.DataFrame:
    """The states between the slices of one conversation; a few numbers per slice."""
    conv_id = matrices["conv_id"].iloc[0]
    paths = {NOTHING: (0, (), ())}
    slices = sorted(matrices[SLICE].unique())
    for part in slices:
        reached: dict[int, tuple] = {}
        for row in matrices[matrices[SLICE] == part].itertuples():
            if row.start in paths:
                cost, ranks, states = paths[row.start]
                found = (cost + row.cost, (*ranks, row.rank), (*states, (row.start, row.end)))
                if row.end not in reached or found < reached[row.end]:
                    reached[row.end] = found
        paths = reached
    end = min(paths, key=lambda s: (paths[s][0] + COST[INSERT] * len(CLOSING[s]), paths[s][1]))
    rows = [
        (conv_id, part, start, to, part == slices[-1]) for part, (start, to) in zip(slices, paths[end][2])
    ]
    return pd.DataFrame(rows, columns=["conv_id", SLICE, "start", "end", "closes"])


def _edit_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out = _Batches(schema)
    names = ["conv_id", SLICE, "turn", "role", "text", "fault", "start", "end", "closes"]
    key, edits, way = None, None, (None, True)
    for conv_id, part, turn, role, text, fault, start, end, closes in _values(batches, names):
        if edits is None or key != (conv_id, part):
            if edits is not None:
                edits.end(*way)
            key, way = (conv_id, part), (end, closes)
            edits = _Edits(out, conv_id, part, start)
        edits.add(turn, role, text, fault)
        if out.full():
            yield out.take()
    if edits is not None:
        edits.end(*way)
    yield out.take()


def repairs(conversations: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The edits that repair each conversation of ``conversations`` (conv_id, turn, role, text).

    One row per row and inserted row, in the order (slice, step) within a conversation: ``edit``
    (K, R, D, I), the ``turn`` of the row, ``role`` and ``text`` after the edit (text NULL: deleted),
    ``initial`` of the role before it, ``fault`` (blank, duplicate, truncated or NULL) and ``cost``.

    Rows are taken by turn, NULL first; rows of one turn by a hash of role and text, so equal rows
    are neighbours and all but the first are duplicates. A NULL role or text is one space, which
    makes the row blank or leaves it without a valid role; so does an empty role. NULL is a
    conv_id like any other. Further columns are left out; an empty table has no edits.

    A conversation with more than ``hot_rows`` rows is cut into slices.
    """
    return _edits(conversations, hot_rows)[0]


def _edits(conversations: DataFrame, hot_rows: int) -> tuple[DataFrame, bool]:
    """The edits, and whether conversations were cut. If not, each one's edits are neighbours and in order."""
    key = ["conv_id"]
    rows = _prepared(conversations)
    cuts = hot_key_cuts(rows, key, ORDER, hot_rows)
    if cuts is None:
        rows = _with_faults(rows.withColumns({SLICE: F.lit(None).cast("int"), "again": F.lit(False)}))
        rows = rows.withColumns({"start": F.lit(NOTHING), "end": F.lit(None).cast("int"), "closes": F.lit(True)})
    else:
        rows = _with_faults(_repeated_across(with_slices(rows, key, ORDER, cuts)))
        rows = stash(rows, "conversation-rows").repartition("conv_id", SLICE)
        rows = rows.join(F.broadcast(_ways(rows)), _same_slice(), "left").drop("_c", "_s")
        rows = rows.withColumns({"start": F.coalesce("start", F.lit(NOTHING)), "closes": F.coalesce("closes", F.lit(True))})
    rows = rows.sortWithinPartitions("conv_id", SLICE, *ORDER).drop("same")
    edits = StructType([rows.schema["conv_id"], rows.schema[SLICE], *_parse(EDITS)])
    arrow = to_arrow_schema(edits)
    return rows.mapInArrow(lambda batches: _edit_rows(batches, arrow), edits), cuts is not None


def _same_slice() -> Column:
    return F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col(SLICE) == F.col("_s"))


def _ways(rows: DataFrame) -> DataFrame:
    """The states before and after each slice; one row per slice, and there are at most as many as cuts."""
    hot = rows.where(F.col(SLICE).isNotNull()).sortWithinPartitions("conv_id", SLICE, *ORDER)
    key = [rows.schema["conv_id"], rows.schema[SLICE]]
    kind = StructType([*key, *_parse("start int, end int, cost long, rank int")])
    arrow = to_arrow_schema(kind)
    found = hot.select("conv_id", SLICE, "role", "fault").mapInArrow(lambda batches: _matrices(batches, arrow), kind)
    chained = stash(found, "slice-costs").groupBy("conv_id").applyInPandas(
        _chain, StructType([*key, *_parse("start int, end int, closes boolean")])
    )
    return chained.withColumnsRenamed({"conv_id": "_c", SLICE: "_s"})


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out = _Batches(schema)
    names = ["conv_id", "edit", "turn", "role", "text", "initial", "fault", "cost"]
    key, seen = None, None

    def close():
        first, last, turns = seen["turns"]
        gaps = 0 if first is None else last - first + 1 - turns
        faults = [seen[f] for f in (BLANK, DUPLICATE, TRUNCATED)]
        out.put((key, gaps, *faults, seen["illegal"], seen["cost"], "".join(seen["audit"]), seen["sha"].hexdigest()))

    for conv_id, edit, turn, role, text, initial, fault, cost in _values(batches, names):
        if seen is None or key != conv_id:
            if seen is not None:
                close()
            key = conv_id
            seen = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256()}
            seen |= {"turns": (None, None, 0), "before": None, "rows": 0}
        seen["cost"] += cost
        seen["audit"].append(edit)
        if edit != DELETE:
            seen["sha"].update(f"{chr(10) if seen['rows'] else ''}{role}:{text}".encode())
            seen["rows"] += 1
        if edit == INSERT:
            continue
        if fault is not None:
            seen[fault] += 1
        if seen["before"] is not None and seen["before"] + initial not in LEGAL:
            seen["illegal"] += 1
        seen["before"] = initial
        first, last, turns = seen["turns"]
        if turn is not None and turn != last:
            seen["turns"] = (turn if first is None else first, turn, turns + 1)
        if out.full():
            yield out.take()
    if seen is not None:
        close()
    yield out.take()


def repair_digest(conversations: DataFrame, conv_ids: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per conv_id of ``conv_ids``: what was wrong with its rows, the edits and a hash of the result.

    conv_id, gaps (missing turns between the first and the last), blank, duplicate, truncated (rows by
    first fault), illegal (neighbours whose role initials are not su, ua, au), cost, audit (the edits'
    initials), repaired_sha256 (of ``role:text`` lines). A conversation without rows has zeros.

    The hash of a conversation needs its text in one order: edits stream through one task for each,
    which holds the hash and one letter per row.
    """
    edits, cut = _edits(conversations, hot_rows)
    if cut:
        edits = edits.repartition("conv_id").sortWithinPartitions("conv_id", SLICE, "step")
    kind = StructType([edits.schema["conv_id"], *_parse(DIGEST)])
    arrow = to_arrow_schema(kind)
    found = edits.mapInArrow(lambda batches: _digests(batches, arrow), kind)
    ids = conv_ids.select(F.col("conv_id").alias("_id")).distinct()
    rows = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    columns = [F.coalesce(f.name, empty.get(f.name, F.lit(0).cast("long"))).alias(f.name) for f in _parse(DIGEST)]
    return rows.select(F.col("_id").alias("conv_id"), *columns)
