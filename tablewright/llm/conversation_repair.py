"""Repair of a conversation's structure by cheapest edits.

A repaired conversation is empty, or an optional system message followed by one or more pairs of
user and assistant.  Edits of a row, in order: Keep (0), Rerole to user or assistant (2), Delete
(3, required for blank and duplicate rows); an empty user or assistant message may be Inserted
anywhere (2); a truncated row that is not deleted adds 1.  The *edit lattice* has a node for each
number of rows consumed and state of the grammar; the initials of the edits along a path are its
audit.  A bidirectional Dijkstra search runs over it: a forward and a reverse heap meet, all
crossings of equal cost are finished, and the least concatenated audit among them is taken.

Rows are reduced to one character each (kind, fault) before any search.  A conversation is cut
into chunks of ``CHUNK`` rows, dealt to tasks by (conversation, chunk): a chunk is searched for
every state it may begin and end in, and the chunks of a conversation are then joined in order,
so that a very long one is neither searched by one task nor held whole.  What is inserted between
two chunks counts to the later one; all audits of a chunk then end in a row's edit, none is the
beginning of another, and the order of two joined audits is that of their first unequal parts.

Order of rows: turn (nulls first), then role and MD5 of the text.  Results: null roles and texts
are one space; a null ``conv_id`` is a conversation; repeated rows are duplicates; a blank text
has no character besides white space; other columns are ignored; an empty table gives an empty
result.  Text and role of a very long message travel once, to the task that applies the edits.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256
OUT_BYTES = 4 << 20
SPACE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

# grammar: state -> initial -> next state.  0: nothing yet, 1: after system, 2: after user, 3: after assistant
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
ANSWER = {0: 2, 1: 2, 2: 3, 3: 2}       # state after the message that Rerole or Insert supplies
ROLE = {2: "user", 3: "assistant"}


def _row_edges(code: str) -> list[tuple[int, int, str, int]]:
    """(state, next state, initial, cost) of every edit of a row.  ``code``: "d" for a row that
    must go, else its role's initial ("x": any other), in upper case if it is truncated."""
    edges = [(s, s, "D", DELETE) for s in NEXT]
    if code != "d":
        late = TRUNCATED if code.isupper() else 0
        edges += [(s, to[code.lower()], "K", late) for s, to in NEXT.items() if code.lower() in to]
        edges += [(s, t, "R", REROLE + late) for s, t in ANSWER.items()]
    return edges


EDGES = {c: _row_edges(c) for c in "dsuaxSUAX"}


class _Side:
    """One heap of the search: the cheapest way known to each node and its least audit."""

    def __init__(self, sources, codes: str, forward: bool, tail: bool):
        self.codes, self.forward, self.tail = codes, forward, tail
        self.known = {node: (0, "") for node in sources}
        self.heap = [(0, i if forward else -i, "", s) for i, s in sources]
        self.settled: set = set()

    def top(self) -> float:
        while self.heap and (abs(self.heap[0][1]), self.heap[0][3]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def step(self) -> list[tuple[int, int]]:
        """Settle the nearest node; the nodes whose way became shorter or its audit less.  Edges
        without a cost consume a row, so of nodes equally near the one with fewer rows consumed
        (more, in reverse) comes first and each node is settled with its least audit."""
        cost, i, audit, state = heapq.heappop(self.heap)
        i = abs(i)
        self.settled.add((i, state))
        changed = []
        for node, letter, price in self._edges(i, state):
            way = (cost + price, audit + letter if self.forward else letter + audit)
            if node not in self.known or way < self.known[node]:
                self.known[node] = way
                heapq.heappush(self.heap, (way[0], node[0] if self.forward else -node[0], way[1], node[1]))
                changed.append(node)
        return changed

    def _edges(self, i: int, state: int):
        n = len(self.codes)
        if self.forward:
            if i < n:
                yield from (((i + 1, t), letter, price) for s, t, letter, price in EDGES[self.codes[i]] if s == state)
            if i < n or self.tail:
                yield (i, ANSWER[state]), "I", INSERT
        else:
            if i:
                yield from (((i - 1, s), letter, price) for s, t, letter, price in EDGES[self.codes[i - 1]] if t == state)
            if i < n or self.tail:
                yield from (((i, s), "I", INSERT) for s, t in ANSWER.items() if t == state)


@functools.lru_cache(maxsize=1 << 15)
def cheapest(codes: str, start: int, goals: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """(cost, least audit) of the way from ``start`` before the first row to one of ``goals``
    after the last; with ``tail``, messages may be inserted after the last row.  None: no way."""
    ahead = _Side([(0, start)], codes, True, tail)
    back = _Side([(len(codes), g) for g in goals], codes, False, tail)
    best = float("inf")
    if not codes and start in goals:
        best = 0
    while (f := ahead.top()) + (r := back.top()) <= best and max(f, r) < float("inf"):
        side, other = (ahead, back) if f <= r else (back, ahead)
        for node in side.step():
            if node in other.known:
                best = min(best, side.known[node][0] + other.known[node][0])
    if best == float("inf"):
        return None
    crossings = (n for n, way in ahead.known.items() if n in back.known and way[0] + back.known[n][0] == best)
    return int(best), min(ahead.known[n][1] + back.known[n][1] for n in crossings)


def _facts(rows: DataFrame) -> DataFrame:
    """The small part of each row: conv_id, turn, role, digest of the text, its own faults."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    bare = F.rtrim(text, F.lit(SPACE))
    return rows.select("conv_id", F.col("turn").cast("long"), role.alias("role"), F.unhex(F.md5(text)).alias("digest"),
                       (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk of a conversation: its codes and its share of the counts.  One exchange,
    by conversation, of the small part of the rows, and one of single characters by chunk."""
    whole = Window.partitionBy("conv_id")
    placed = whole.orderBy(*_order())
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag("initial").over(placed), F.col("initial"))
    marked = (_facts(rows).repartition("conv_id").withColumn("seen", F.row_number().over(same) > 1)
              .withColumn("initial", initial)
              .withColumn("at", F.row_number().over(placed).cast("long") - 1)
              .withColumn("pair", pair).withColumn("before", F.lag("turn").over(placed))
              .withColumn("rows", F.count("*").over(whole)))
    fault = (F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("open"), "truncated"))
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = (F.when(F.col("fault").isin("blank", "duplicate"), "d")
            .when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind))
    coded = marked.withColumn("fault", fault).withColumn("code", code)
    listed = F.array_sort(F.collect_list(F.struct(F.col("at"), F.col("code"))))
    return coded.groupBy("conv_id", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(
        F.array_join(F.transform(listed, lambda x: x["code"]), "").alias("codes"), F.first("rows").alias("rows"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if(F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        F.min("turn").alias("least"), F.max("turn").alias("most"),
        F.count_if(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before"))).alias("turns"))


WAYS = "array<struct<start:int,end:int,cost:long,audit:string>>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Search every chunk from each state it may begin in to each it may end in (-1: a final one)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        ways = []
        for chunk, codes, rows in zip(*(batch.column(c).to_pylist() for c in ("chunk", "codes", "rows"))):
            last = (chunk + 1) * CHUNK >= rows
            found = ((s, e, cheapest(codes, s, FINAL if last else (e,), last))
                     for s in (NEXT if chunk else (0,)) for e in ((-1,) if last else NEXT))
            ways.append([{"start": s, "end": e, "cost": w[0], "audit": w[1]} for s, e, w in found if w])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, kind)], [*batch.schema.names, "ways"])


class _Joined:
    """The chunks of one conversation so far: for each state, cost, place of its audit among the
    states' audits, and the audit as a chain of parts."""

    def __init__(self):
        self.ends = {0: (0, 0, None)}

    def add(self, ways: list[dict]) -> None:
        best: dict[int, tuple] = {}
        for w in ways:
            if w["start"] in self.ends:
                cost, rank, chain = self.ends[w["start"]]
                way = (cost + w["cost"], rank, w["audit"], chain)
                if w["end"] not in best or way[:3] < best[w["end"]][:3]:
                    best[w["end"]] = way
        order = sorted({way[1:3] for way in best.values()})
        self.ends = {e: (way[0], order.index(way[1:3]), (way[3], way[2])) for e, way in best.items()}

    def result(self) -> tuple[int, str]:
        cost, _, chain = self.ends[-1]
        parts = []
        while chain:
            chain, part = chain
            parts.append(part)
        return cost, "".join(reversed(parts))


SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")
PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plan_repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): ``gaps`` (missing turn
    numbers), ``blank``, ``duplicate`` and ``truncated`` rows (a row's first fault counts),
    ``illegal`` (neighbours whose roles may not follow each other), ``cost`` and ``audit``."""
    keep = ["conv_id", "chunk", *SUMS, "least", "most"]
    chunks = _chunks(rows)
    solved = chunks.mapInArrow(_solve, f"{_ddl(chunks)}, ways {WAYS}").select(*keep, "ways")
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[c.split()[0] for c in PLAN.split(", ")]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, joined, sums, least, most = None, None, None, None, None

        def closed():
            cost, audit = joined.result()
            gaps = most - least + 1 - sums["turns"] if sums["turns"] else 0
            return (conv, gaps, *[sums[c] for c in SUMS[:4]], cost, audit)

        for batch in batches:
            out = []
            for row in (r for part in _cut(batch) for r in part.to_pylist()):
                if row["chunk"] == 0:
                    if joined:
                        out.append(closed())
                    conv, joined, sums = row["conv_id"], _Joined(), dict.fromkeys(SUMS, 0)
                    least = most = None
                joined.add(row["ways"])
                for c in SUMS:
                    sums[c] += row[c]
                if row["least"] is not None:
                    least = row["least"] if least is None else least
                    most = row["most"]
            if out:
                yield _batch(out, names, batch.schema.field("conv_id").type)
        if joined:
            yield _batch([closed()], names, batch.schema.field("conv_id").type)

    return (solved.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
            .mapInArrow(fold, f"conv_id {conv_type}, {PLAN}"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _cut(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _batch(rows: list[tuple], names: list[str], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type if n == "conv_id" else pa.string() if n in ("audit", "edit", "role", "text") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def apply_repairs(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The messages of the repaired conversations: conv_id, ``position`` (from 0), ``edit`` (K, R
    or I), role, text.  ``plans`` comes from ``plan_repairs`` over the same rows.  Rows of one
    conversation lie in one partition, in order; they stream past its audit."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    messages = rows.select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("long"), role.alias("role"),
                           text.alias("text"), F.lit(None).cast("string").alias("audit"))
    heads = plans.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"),
                         *[F.lit(None).cast("string").alias(c) for c in ("role", "text")], "audit")
    digest = F.unhex(F.md5(F.col("text")))
    together = (heads.unionByName(messages).repartition("conv_id").withColumn("digest", digest)
                .sortWithinPartitions("conv_id", "part", *_order()).drop("digest", "turn"))
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "position", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, position, state = None, "", 0, 0, 0
        out, size = [], 0

        def add(edit, role, text):
            nonlocal position, size
            out.append((conv, position, edit, role, text))
            position += 1
            size += len(text) + len(role) + 64

        def inserted():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = ANSWER[state], at + 1
                add("I", ROLE[state], "")

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in (r for part in _cut(batch) for r in part.to_pylist()):
                if row["part"] == 0:
                    conv, audit, at, position, state = row["conv_id"], row["audit"], 0, 0, 0
                else:
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = NEXT[state][row["role"][:1]]
                        add("K", row["role"], row["text"])
                    elif edit == "R":
                        state = ANSWER[state]
                        add("R", ROLE[state], row["text"])
                inserted()
                if size >= OUT_BYTES:
                    yield _batch(out, names, kind)
                    out, size = [], 0
            if out:
                yield _batch(out, names, kind)
                out, size = [], 0

    return together.mapInArrow(run, f"conv_id {conv_type}, position long, edit string, role string, text string")


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv_id and ``sha256`` of the newline-joined ``role:text`` of each conversation that has
    messages.  ``repaired`` comes from ``apply_repairs`` and is read where it lies, in its order."""
    conv_type = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind = None, None, None
        for batch in batches:
            kind, ids, sums = batch.schema.field("conv_id").type, [], []
            for part in _cut(batch):
                for key, position, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
                    if position == 0:
                        if state:
                            ids.append(conv)
                            sums.append(state.hexdigest())
                        conv, state = key, hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums, pa.string())], ["conv_id", "sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    return repaired.select("conv_id", "position", "role", "text").mapInArrow(run, f"conv_id {conv_type}, sha256 string")
