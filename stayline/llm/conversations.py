"""Repair of damaged conversations by the cheapest edits, found by a run-length dynamic program.

A conversation's rows become symbols (role class and fault), equal consecutive ones collapse to runs.  The cost of
all that may follow a row is a vector over the four states of the role grammar ``(s?(ua)+)?``; a row is a 4 x 4 matrix in the
min-plus semiring, and a run of n rows its n-th power, put together from cached binary powers.  The costs are
carried back over the runs; going forward again, the choices inside each run are unrolled into the audit, halving
long runs on the way.

How it is spread: faults are found by groupings and joins on short rows (texts as digests).  Those rows are range-partitioned
by conversation *and* place, so that a conversation that holds a third of all rows is cut over many tasks; each task passes
on runs, a few bytes per run.  Texts are shuffled once, and the repaired rows of a conversation are written as a stream in
one batch's memory: its hash and its audit are sequences over the whole conversation.

Defined cases: null role or text is one space; a null id or turn is one space where rows are drawn for damage; rows
of null id are one conversation, of null id; rows of one turn are ordered by role and the digest of the text, equal rows are that many rows;
an empty role, like any other initial, can only be replaced or deleted; blank text, faults and edits of very long
texts are judged on the whole text; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# Symbols: role class x fault.
ROLES = "sua"
OTHER = 3
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
# States: nothing yet, after s, after u, after a.
STATES = range(4)
NEVER = 1 << 60
KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 2, 3, 2, 1
#: The state after one more user or assistant row, whichever of the two may follow.
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: The state after a row that keeps its role, by role class.
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
ENDS = (0, NEVER, NEVER, 0)
#: Rows of a run that are unrolled one by one.
SHORT_RUN = 64

Matrix = tuple[tuple[int, ...], ...]
Costs = tuple[int, ...]


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def _applied(a: Matrix, costs: Costs) -> Costs:
    return tuple(min(NEVER, *(a[i][k] + costs[k] for k in STATES)) for i in STATES)


def _inserts() -> Matrix:
    """Any number of inserted rows: three reach every state there is to reach."""
    once = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else NEVER for j in STATES) for i in STATES)
    return _product(_product(once, once), once)


INSERTS = _inserts()
#: What remains to be paid after the last row.
LAST = _applied(INSERTS, ENDS)


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row as (initial, cost, next state), ASCII-least first."""
    role, fault = divmod(symbol, 4)
    found = [("D", DELETE, state)]
    if fault in (CLEAN, TRUNCATED):
        left = STAYS_TRUNCATED * (fault == TRUNCATED)
        if state in KEPT[role]:
            found.append(("K", KEEP + left, KEPT[role][state]))
        found.append(("R", REROLE + left, NEXT[state]))
    return found


@lru_cache(maxsize=None)
def _power(symbol: int, k: int) -> Matrix:
    """2**k rows of one symbol, each after any inserted rows."""
    if k:
        half = _power(symbol, k - 1)
        return _product(half, half)
    row = [[NEVER] * 4 for _ in STATES]
    for state in STATES:
        for _, cost, to in _options(symbol, state):
            row[state][to] = min(row[state][to], cost)
    return _product(INSERTS, tuple(map(tuple, row)))


def _before(symbol: int, n: int, costs: Costs) -> Costs:
    """Costs before ``n`` rows of ``symbol``, from those after."""
    k = 0
    while n:
        if n & 1:
            costs = _applied(_power(symbol, k), costs)
        n >>= 1
        k += 1
    return costs


@lru_cache(maxsize=100_000)
def _row_edits(symbol: int, state: int, after: Costs) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits from ``state`` over one row, and the state then; costs less their least."""
    before, text = _applied(_power(symbol, 0), after), ""
    while True:
        delete, *others = _options(symbol, state)
        insert = ("I", INSERT + before[NEXT[state]], NEXT[state])
        tried = [(e, cost + after[to], to) for e, cost, to in [delete, *others]]
        for edit, cost, to in [tried[0], insert, *tried[1:]]:
            if cost == before[state]:
                break
        text, state = text + edit, to
        if edit != "I":
            return text, state


def _unrolled(symbol: int, n: int, state: int, after: Costs, out: list[str]) -> int:
    """Append the edits of a run, whose rows leave ``after`` to be paid; the state then."""
    if n > SHORT_RUN:
        half = n // 2
        state = _unrolled(symbol, half, state, _before(symbol, n - half, after), out)
        return _unrolled(symbol, n - half, state, after, out)
    costs = [after]
    for _ in range(n - 1):
        costs.append(_applied(_power(symbol, 0), costs[-1]))
    for after in reversed(costs):
        least = min(after)
        edits, state = _row_edits(symbol, state, tuple(min(NEVER, c - least) for c in after))
        out.append(edits)
    return state


def cheapest(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Cost and audit of runs (symbol, rows)."""
    costs = [LAST]
    for symbol, n in reversed(runs):
        costs.append(_before(symbol, n, costs[-1]))
    total, state, out = costs.pop()[0], 0, []
    for symbol, n in runs:
        state = _unrolled(symbol, n, state, costs.pop(), out)
    while ENDS[state]:
        out.append("I")
        state = NEXT[state]
    return total, "".join(out)


_short = lru_cache(maxsize=100_000)(lambda runs: cheapest(list(runs)))


def _judged(runs: list[tuple[int, int]]) -> tuple:
    """blank, duplicate, truncated, illegal, cost, audit."""
    faults, illegal, last = [0] * 4, 0, None
    for symbol, n in runs:
        role, fault = divmod(symbol, 4)
        faults[fault] += n
        illegal += n - 1 + (last is not None and (last, role) not in ((0, 1), (1, 2), (2, 1)))
        last = role
    return *faults[1:], illegal, *(_short(tuple(runs)) if len(runs) <= SHORT_RUN else cheapest(runs))


# --- the rows


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, key, turn, role, text, n: what the draw by conversation and turn leaves; n equal rows each."""

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return rows.filter(draw != 0).select(
        "conv_id",
        spaced("conv_id").alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.when(draw == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        F.when(draw == 3, 2).otherwise(1).cast("long").alias("n"),
    )


PLACE = ["key", "turn", "role", "digest"]


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def symbols(rows: DataFrame) -> DataFrame:
    """key, turn, role, digest, symbol, n: rows without texts; repeats of a turn's row are rows of their own."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    fault = F.when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), BLANK)
    fault = fault.when(~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), TRUNCATED).otherwise(CLEAN)
    short = rows.select("key", "turn", "role", _digest(), role.alias("class"), fault.alias("fault"), "n")
    same = short.groupBy(*PLACE).agg(F.first("class").alias("class"), F.first("fault").alias("fault"), F.sum("n").alias("n"))
    same = staged(same, "turns")
    turn = F.struct(F.col("turn").isNotNull(), "turn")  # nulls first
    first = same.groupBy("key", "role", "digest").agg(F.min(turn).alias("first"))
    found = same.join(first, ["key", "role", "digest"])
    again = (F.col("fault") != BLANK) & (turn > F.col("first"))
    fault = F.when(again, DUPLICATE).otherwise(F.col("fault"))
    repeat = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    parts = F.array(
        F.struct((F.col("class") * 4 + fault).alias("symbol"), F.lit(1).cast("long").alias("n")),
        F.struct((F.col("class") * 4 + repeat).alias("symbol"), (F.col("n") - 1).alias("n")),
    )
    return found.select(*PLACE, F.posexplode(parts).alias("repeat", "part")).select(
        *PLACE, "repeat", "part.symbol", "part.n"
    ).filter("n > 0")


RUNS = "key string, piece int, runs binary"
JUDGED = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _append(runs: array, symbol: int, n: int) -> None:
    """Runs are integers, the symbol in the last four bits."""
    if runs and runs[-1] % 16 == symbol:
        runs[-1] += n * 16
    else:
        runs.append(n * 16 + symbol)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the rows of each conversation that this task has, in their order."""
    piece, key, runs = TaskContext.get().partitionId(), None, array("q")

    def out(done: list) -> pa.RecordBatch:
        columns = [[k for k, _ in done], [piece] * len(done), [r for _, r in done]]
        kinds = [pa.string(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "piece", "runs"])

    for batch in batches:
        done = []
        for k, symbol, n in zip(*(batch.column(c).to_pylist() for c in ("key", "symbol", "n")), strict=True):
            if k != key:
                if runs:
                    done.append((key, runs.tobytes()))
                key, runs = k, array("q")
            _append(runs, symbol, n)
        yield out(done)
    if runs:
        yield out([(key, runs.tobytes())])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation follow one another; one row for each conversation."""
    names, kinds = [c.split()[0] for c in JUDGED.split(", ")], [pa.string(), *[pa.int64()] * 5, pa.string()]
    key, runs = None, array("q")

    def judged() -> tuple:
        return key, *_judged([(r % 16, r // 16) for r in runs])

    def out(done: list) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        done = []
        for k, data in zip(batch.column("key").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            if k != key:
                if runs:
                    done.append(judged())
                key, runs = k, array("q")
            own = array("q", data)
            _append(runs, own[0] % 16, own[0] // 16)
            runs.extend(own[1:])
        yield out(done)
    if runs:
        yield out([judged()])


def report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (as damaged): gaps, faults, cost, audit; ``found`` are its ``symbols``."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = staged(found, "symbols")
    order = [*PLACE, "repeat"]
    pieces = found.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("key", "symbol", "n")
    pieces = pieces.mapInArrow(_pieces, RUNS).repartition("key").sortWithinPartitions("key", "piece")
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = found.groupBy("key").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"))
    return gaps.join(pieces.mapInArrow(_decided, JUDGED), "key")


REPAIRED = "key string, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows after their conversation's audit, in order: the repaired rows."""
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    key, audit, at, state = None, "", 0, 0

    def inserted(out: list) -> None:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, NEXT[state]
            out.append((key, NAMES[state], ""))

    def batch_of(out: list) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)

    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("key", "audit", "role", "text", "n")]
        for k, plan, role, text, n in zip(*columns, strict=True):
            if plan is not None:
                inserted(out)  # what is left of the conversation before
                key, audit, at, state = k, plan, 0, 0
                continue
            for _ in range(n):
                inserted(out)
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = KEPT[ROLES.find(role[0])][state]
                    out.append((key, role, text))
                elif edit == "R":
                    state = NEXT[state]
                    out.append((key, NAMES[state], text))
        yield batch_of(out)
    out = []
    inserted(out)
    yield batch_of(out)


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """key, role, text of the repaired conversations; a conversation's rows lie together and in order in one partition."""
    none = F.lit(None).cast("string")
    plans = judged.select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"),
        F.lit(None).cast("binary").alias("digest"), none.alias("text"), F.lit(0).cast("long").alias("n"), "audit",
    )
    texts = rows.select("key", F.lit(1).alias("kind"), "turn", "role", _digest(), "text", "n", none.alias("audit"))
    order = ["key", "kind", "turn", "role", "digest"]
    stream = plans.union(texts).repartition("key").sortWithinPartitions(*order)
    return stream.select("key", "audit", "role", "text", "n").mapInArrow(_edited, REPAIRED)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None

    def out(done: list) -> pa.RecordBatch:
        columns = [pa.array([k for k, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["key", "repaired_sha256"])

    for batch in batches:
        done = []
        for k, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield out(done)
    if digest:
        yield out([(key, digest.hexdigest())])


def digests(lines: DataFrame) -> DataFrame:
    """key, repaired_sha256 of what ``repaired`` returns: ``role:text`` of all rows, newline-joined."""
    return lines.mapInArrow(_hashed, "key string, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report (one row per conversation that is left) and the repaired rows of damaged ``rows``."""
    judged = staged(report(rows, symbols(rows)), "judged")
    return judged, repaired(rows, judged)
