"""Repair of conversations: the cheapest edits that give roles (s?(ua)+)? by Dijkstra on a lattice of (turn index, grammar state).

A row is kept, given another role or deleted; empty user and assistant rows can be put in anywhere. Nodes are never
built beforehand: from a node (rows done, grammar state) the edits of the next row and the insertions lead on. The queue's key is (cost, audit), audit
being the edits' initials, and the first accepting end node that comes off it is the answer. Two different audits of one
node and one cost are never prefixes of each other (an insertion costs), so the order of audits holds when both are continued.

Conversations are sorted over all tasks by turn, not grouped: a task solves those that lie whole in its partition, one at a
time. Those that touch its borders, or are over LONG_ROWS, may be of any length. Their rows go on as they are; blocks of them are solved from each
state to each state, the blocks' tables are chained, and then each block is edited by its part of the audit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.llm.kernels import cut_lineage

#: What each edit costs, by its initial.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
#: Added for a truncated row that stays.
TRUNCATED = 3
#: Grammar states: nothing yet, after system, after user, after assistant; by role initial. Only START and ASSISTANT accept.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
ACCEPTS = (START, ASSISTANT)
#: The role that an insertion or a new role can have in each state, and the state after it.
NEW = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
#: Adjacent role initials that are legal.
LEGAL = {"su", "ua", "au"}
#: Rows of a conversation that a task solves at once; longer ones are chained from blocks of BLOCK_ROWS.
LONG_ROWS, BLOCK_ROWS = 4096, 256
#: Bytes of repaired text that are handed to the digest as one row.
PIECE_BYTES = 1 << 20
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
_SPACE = " \t\n\v\f\r"

Best = tuple[int, str]


def solved(rows: list[tuple[str, str | None]], start: int = START) -> Iterator[tuple[int, int, str]]:
    """(state, cost, audit) of the end nodes of rows (role initial, fault) in the order in which they come off the queue."""
    queue: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    done: set[tuple[int, int]] = set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        after = NEW[state][1]
        heapq.heappush(queue, (cost + COSTS["I"], audit + "I", i, after))
        if i == len(rows):
            yield state, cost, audit
            continue
        initial, fault = rows[i]
        heapq.heappush(queue, (cost + COSTS["D"], audit + "D", i + 1, state))
        if fault in (BLANK, DUPLICATE):
            continue
        stays = cost + TRUNCATED * (fault == CUT)
        if initial in STEPS[state]:
            heapq.heappush(queue, (stays + COSTS["K"], audit + "K", i + 1, STEPS[state][initial]))
        heapq.heappush(queue, (stays + COSTS["R"], audit + "R", i + 1, after))


def cheapest(rows: list[tuple[str, str | None]]) -> Best:
    """Cost and audit of the cheapest edits of a whole conversation."""
    return next((cost, audit) for state, cost, audit in solved(rows) if state in ACCEPTS)


def edited(rows: list[tuple[str, str]], audit: str, state: int = START) -> Iterator[str]:
    """The repaired `role:text` lines of rows (role, text)."""
    left = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit in "RI":
            role, state = NEW[state]
        else:
            state = STEPS[state][role[:1]]
        yield f"{role}:{text}"


def base_fault(text: str) -> str | None:
    """BLANK, CUT or None; a duplicate is known from the rows before."""
    bare = text.rstrip(_SPACE)
    return BLANK if not bare else CUT if bare[-1] not in ".!?" else None


@dataclass
class Tally:
    """Counts of a run of rows in order; runs of one conversation add up."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    turns: int = 0
    low: int | None = None
    high: int | None = None

    def row(self, turn: int | None, initial: str, fault: str | None) -> None:
        self.add(Tally(1, fault == BLANK, fault == DUPLICATE, fault == CUT, 0, initial, initial, int(turn is not None), turn, turn))

    def add(self, o: Tally) -> None:
        if self.rows and o.rows:
            self.illegal += self.last + o.first not in LEGAL
        if not self.rows:
            self.first = o.first
        if o.rows:
            self.last = o.last
        self.rows, self.blank, self.duplicate, self.truncated, self.illegal = self.rows + o.rows, self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated, self.illegal + o.illegal
        if o.low is not None:  # turns stand in order, so runs share one turn at most
            self.turns += o.turns - (self.high == o.low)
            self.low, self.high = o.low if self.low is None else self.low, o.high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) with the damage that each row's crc32 chooses; copies is 0 for dropped rows, which stay as marks of their conversation, and 2 for repeated ones."""
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv", "", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return plain.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _result(conv: object, t: Tally, cost: int, audit: str, sha: str) -> dict:
    return {"conv": conv, "gaps": t.gaps, "blank": t.blank, "duplicate": t.duplicate, "truncated": t.truncated, "illegal": t.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = "part int, pos long, turn long, role string, text string, copies int"
_INTS = "gaps blank duplicate truncated illegal cost part pos turn copies".split()


def _schema(kind: pa.DataType, *names: str) -> pa.Schema:
    of = {n: pa.int64() for n in _INTS} | {"part": pa.int32(), "copies": pa.int32(), "conv": kind}
    return pa.schema([(n, of.get(n, pa.string())) for n in names])


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_rows: int = LONG_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Damage rows, count their faults and repair each conversation: (conv id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Null roles and texts are one space, as are null ids and turns where the damage is chosen; rows of the null id are one conversation; null turns come first and make no
    gap. Rows of a like turn stand by role, then text, so repeated rows are adjacent duplicates. A row without a role can't be kept as it is. A
    conversation that has lost all rows gives zeros, an empty audit and the empty string's digest. Texts are read whole; equal rows of a turn and role go
    to one task, which holds long_rows rows at most. An empty table gives no rows; other columns, whatever their names, are left out.

    A long conversation's audit is one string, by the result's form, and its digest is taken over its text in order by one task, a piece at a time; no task holds its text.
    """
    sorted_rows = damaged(rows, conv_col, turn_col, role_col, text_col)
    order = ["conv", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64)]
    sorted_rows = sorted_rows.repartitionByRange(*order).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    first = cut_lineage(_solved_whole(sorted_rows.withColumn("part", F.spark_partition_id()), long_rows))
    columns = ["conv", *(p.split()[0] for p in _COUNTS.split(", "))]
    whole = first.where("audit IS NOT NULL").select(*columns)
    edge = first.where("audit IS NULL").select("conv", *(p.split()[0] for p in _ROW.split(", ")))
    return whole.unionByName(_chained(edge, block_rows)).withColumnRenamed("conv", conv_col)


def _solved_whole(sorted_rows: DataFrame, long_rows: int) -> DataFrame:
    """Results of the conversations that begin and end in a partition; the rows of the others, with their place."""
    conv_type = sorted_rows.schema["conv"].dataType.simpleString()
    result, row = ["conv", *(p.split()[0] for p in _COUNTS.split(", "))], [p.split()[0] for p in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: pa.DataType | None = None

        def out(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(found, _schema(kind, *result, *row))

        def passed(conv: object, held: list, pos: int) -> pa.RecordBatch:
            return out([{"conv": conv, "part": r[4], "pos": pos + i, "turn": r[0], "role": r[1], "text": r[2], "copies": r[3]} for i, r in enumerate(held)])

        def rows_of() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held, conv, at, edge, found = [], None, 0, True, []
        for next_conv, *rest in rows_of():
            if next_conv != conv and (at or held):
                if edge:
                    yield passed(conv, held, at)
                else:
                    found.append(_of_one(conv, held))
                    if len(found) >= 1000:
                        yield out(found)
                        found = []
                at, held, edge = at + len(held), [], False
            conv = next_conv
            held.append(rest)
            if len(held) >= long_rows:
                yield passed(conv, held, at)
                at, held, edge = at + len(held), [], True
        if found:
            yield out(found)
        if held:
            yield passed(conv, held, at)

    return sorted_rows.mapInArrow(run, f"conv {conv_type}, {_COUNTS}, {_ROW}")


def _of_one(conv: object, held: list) -> dict:
    """The result of a whole conversation, rows (turn, role, text, copies, part)."""
    tally, lattice, texts, seen = Tally(), [], [], set()
    for turn, role, text, copies, _ in held:
        for _ in range(copies):
            fault = base_fault(text)
            if fault != BLANK and (role, text) in seen:
                fault = DUPLICATE
            seen.add((role, text))
            tally.row(turn, role[:1], fault)
            lattice.append((role[:1], fault))
            texts.append((role, text))
    cost, audit = cheapest(lattice)
    return _result(conv, tally, cost, audit, hashlib.sha256("\n".join(edited(texts, audit)).encode("utf-8", "surrogatepass")).hexdigest())


def _chained(edge: DataFrame, block_rows: int) -> DataFrame:
    """Results of conversations that lie over several tasks, from their rows in order of (part, pos)."""
    conv_type = edge.schema["conv"].dataType.simpleString()
    place = F.struct("part", "pos")
    said = edge.where("copies > 0").groupBy("conv", "role", F.sha2("text", 256).alias("same")).agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), "same", "at")
    met = edge.join(said, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.sha2("text", 256) == F.col("same")), "left")
    rows = met.select("conv", "part", F.floor(F.col("pos") / block_rows).alias("block"), "pos", "turn", "role", "text", "copies", F.coalesce(place != F.col("at"), F.lit(False)).alias("again"))
    rows = cut_lineage(rows.repartition("part", "block").sortWithinPartitions("part", "block", "conv", "pos"))
    table = "start int, stop int, cost long, audit string, tally string"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, part, block, lattice, _, tally, kind in _blocks_of(batches):
            found = [{"conv": conv, "part": part, "block": block, "start": s, "stop": e, "cost": c, "audit": a, "tally": tally} for s in range(4) for e, c, a in solved(lattice, s)]
            yield pa.RecordBatch.from_pylist(found, _block_schema(kind, ("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("tally", pa.string())))

    tables = cut_lineage(rows.mapInArrow(solve, f"conv {conv_type}, part int, block long, {table}"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's blocks in order: what has been decided goes out a block at a time, or at its end."""
        kind = None

        def entries() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for (_, conv), own in groupby(entries(), key=lambda r: (r[0] is None, r[0])):
            best: dict[int, tuple[int, str, list]] = {START: (0, "", [])}
            tally = Tally()
            for (part, block), cells in groupby(own, key=lambda r: r[1:3]):
                cells = list(cells)
                tally.add(Tally(*_unpacked(cells[0][7])))
                nxt: dict[int, tuple[int, str, list]] = {}
                for _, _, _, start, stop, cost, audit, _ in cells:
                    if start in best:
                        before = best[start]
                        cell = (before[0] + cost, before[1] + audit, [*before[2], (part, block, start, audit)])
                        if stop not in nxt or cell[:2] < nxt[stop][:2]:
                            nxt[stop] = cell
                best = nxt
            cost, audit, steps = min((best[s] for s in ACCEPTS if s in best), key=lambda b: b[:2])
            total = {"conv": conv, **{k: v for k, v in _result(conv, tally, cost, audit, "").items() if k not in ("conv", "repaired_sha256")}}
            found = [total, *({"conv": conv, "part": p, "block": b, "start": s, "own": a} for p, b, s, a in steps)]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("conv", kind), *((n, pa.int64()) for n in _INTS[:6]), ("audit", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("start", pa.int32()), ("own", pa.string())]))

    counts = ", ".join(f"{n} long" for n in _INTS[:6])
    in_order = tables.repartition("conv").sortWithinPartitions("conv", "part", "block", "start", "stop")
    chained = cut_lineage(in_order.mapInArrow(chain, f"conv {conv_type}, {counts}, audit string, part int, block long, start int, own string"))
    steps = chained.where("own IS NOT NULL").select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("block").alias("b"), "start", "own")
    known = rows.join(steps, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))).select(*rows.columns, "start", "own")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, part, block, _, texts, (start, own), kind in _blocks_of(batches, steps=True):
            pieces, size = [[]], 0
            for line in edited(texts, own, start):
                if size >= PIECE_BYTES:
                    pieces.append([])
                    size = 0
                pieces[-1].append(line)
                size += len(line)
            found = [{"conv": conv, "part": part, "block": block, "piece": k, "lines": "\n".join(p)} for k, p in enumerate(pieces) if p]
            yield pa.RecordBatch.from_pylist(found, _block_schema(kind, ("piece", pa.int32()), ("lines", pa.string())))

    pieces = known.repartition("part", "block").sortWithinPartitions("part", "block", "conv", "pos").mapInArrow(edit, f"conv {conv_type}, part int, block long, piece int, lines string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def entries() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                for i in range(batch.num_rows):
                    yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

        for (_, conv), own in groupby(entries(), key=lambda r: (r[0] is None, r[0])):
            sha = hashlib.sha256()
            for k, (_, lines) in enumerate(own):
                sha.update(b"\n" * (k > 0) + lines.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])], names=["conv", "repaired_sha256"])

    digests = pieces.repartition("conv").sortWithinPartitions("conv", "part", "block", "piece").select("conv", "lines").mapInArrow(digest, f"conv {conv_type}, repaired_sha256 string")
    totals = chained.where("own IS NULL").select("conv", *_INTS[:6], "audit")
    empty = hashlib.sha256(b"").hexdigest()
    out = totals.join(digests.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left")
    return out.select("conv", *_INTS[:6], "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _block_schema(kind: pa.DataType, *more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("conv", kind), ("part", pa.int32()), ("block", pa.int64()), *more])


def _packed(t: Tally) -> str:
    return "\x1f".join("" if v is None else f"={v}" for v in vars(t).values())


def _unpacked(packed: str) -> list:
    parts = [None if p == "" else p[1:] for p in packed.split("\x1f")]
    return [p if i in (5, 6) or p is None else int(p) for i, p in enumerate(parts)]


def _blocks_of(batches: Iterator[pa.RecordBatch], steps: bool = False) -> Iterator[tuple]:
    """(conv, part, block, lattice rows, (role, text) rows, packed tally or the block's step, type of conv) from rows in order of (part, block, conv, pos)."""
    kind = None

    def entries() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.column(0).type
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for (conv, part, block), own in groupby(entries(), key=lambda r: r[:3]):
        tally, lattice, texts, step = Tally(), [], [], None
        for _, _, _, _, turn, role, text, copies, again, *step in own:
            for k in range(copies):
                fault = base_fault(text)
                if fault != BLANK and (again or k):
                    fault = DUPLICATE
                tally.row(turn, role[:1], fault)
                lattice.append((role[:1], fault))
                texts.append((role, text))
        yield conv, part, block, lattice, texts, tuple(step) if steps else _packed(tally), kind


def oracle_sql() -> str:
    """The same rows by a recursive table over rows, whose step holds the cheapest (cost, audit, text) of each grammar state."""

    def best(*of: str) -> str:
        return f"list_sort([{', '.join(of)}])[1]"

    def go(state: str, edit: str, cost: str, line: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {state}.r || {line}}}"

    def inserted(s: str) -> list[str]:
        u, a = "'user:' || chr(10)", "'assistant:' || chr(10)"
        two = best(f"{s}2", *(go(f"{s}{k}", "I", "3", u) for k in (START, SYSTEM, ASSISTANT)))
        return [f"{s}0", f"{s}1", two, best(f"{s}3", go(two, "I", "3", a))]

    never = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"
    kept, new_user, new_assistant = "role || ':' || text || chr(10)", "'user:' || text || chr(10)", "'assistant:' || text || chr(10)"
    stays = "CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END"

    def keep(state: int, initial: str) -> str:
        return f"CASE WHEN ini = '{initial}' THEN {go(f'w{state}', 'K', stays, kept)} ELSE {never} END"

    deleted = [go(f"w{k}", "D", "4", "''") for k in range(4)]
    to_user = [x for k in (START, SYSTEM, ASSISTANT) for x in (keep(k, "u"), go(f"w{k}", "R", f"3 + {stays}", new_user))]
    step = [deleted[0], best(deleted[1], keep(START, "s")), best(deleted[2], *to_user), best(deleted[3], keep(USER, "a"), go("w2", "R", f"3 + {stays}", new_assistant))]
    after = ", ".join(f"{x} AS w{k}" for k, x in enumerate(inserted("n")))
    return f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM h WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault FROM o),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS n0, {never} AS n1, {never} AS n2, {never} AS n3 FROM f
  UNION ALL SELECT w.conv_id, w.i, {", ".join(step)} FROM (SELECT f.conv_id, f.i, role, text, ini, fault, {after} FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1) w),
e AS (SELECT conv_id, i, {best("w0", "w3")} AS x FROM (SELECT conv_id, i, {after} FROM s)),
c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit,
  sha256(CASE WHEN x.r IS NULL OR x.r = '' THEN '' ELSE x.r[:-2] END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id AND e.i = c.n"""
