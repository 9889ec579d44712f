"""Conversations repaired by the cheapest edits that make their turns alternate.

The roles' initials of a sound conversation read ``(s?(ua)+)?``. Edits, and what each costs: K keeps a row (0), R gives it the role user
or assistant (2), D deletes it (3; blank and repeated rows must go), I inserts an empty turn of user or assistant (2); a
truncated row that stays adds 1. The edits of a conversation are the steps of a lattice: places between rows by states of the
pattern. The cheapest way through is found from both ends: a forward and a reverse heap meet, all crossings of equal cost
are finished, and of the cheapest ways that with the ASCII-least letters (the audit) is taken.

A conversation is cut into runs of at most 4096 rows, so that no task holds a long one. Runs of a long conversation
are first solved from each state to each other, those costs are chained, and each run is solved again between the
states that the chain passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .words import slices

#: Rows of a run are 2 to the power of this at most.
RUN_BITS = 12
#: States: nothing yet, after the system's turn, after a user's, after an assistant's. Kept roles are s, u, a by their initial.
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 0
#: Bits of a row's code above its role: it must go; it is truncated.
GOES, CUT = 4, 8
#: The state that a user's or assistant's turn, whichever fits, leads to, and the states it can follow.
AFTER = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
SPACES = r"\x20\x09-\x0D"

Move = tuple[str, int, int]  # letter, cost, next node


class Lattice:
    """The edits of a run of rows. Node 4 i + q stands before row i in state q.

    Equal copies of a row are one row here: all but the first must go, right behind it, as D is the least letter. Inserts
    behind the last row belong to the next run, and to this one if it is the ``last``.
    """

    def __init__(self, codes: list[int], last: bool):
        self.codes, self.last, self.n = codes, last, len(codes)

    def ahead(self, node: int) -> Iterator[Move]:
        """Edits from a node, by letter."""
        i, q = node >> 2, node & 3
        if i < self.n:
            yield "D", 3, node + 4
        if i < self.n or self.last:
            yield "I", 2, (node & ~3) + AFTER[q]
        if i < self.n and not self.codes[i] & GOES:
            code, cut = self.codes[i] & 3, self.codes[i] >> 3
            if code == SYSTEM and q == START or code > SYSTEM and AFTER[q] == code:
                yield "K", cut, (node & ~3) + 4 + code
            yield "R", 2 + cut, (node & ~3) + 4 + AFTER[q]

    def behind(self, node: int) -> Iterator[tuple[int, int]]:
        """Cost and origin of the edits that lead to a node."""
        i, q = node >> 2, node & 3
        if i < self.n or self.last:
            for p in BEFORE[q]:
                yield 2, (node & ~3) + p
        if i:
            yield 3, node - 4
            if not self.codes[i - 1] & GOES:
                code, cut = self.codes[i - 1] & 3, self.codes[i - 1] >> 3
                base = (node & ~3) - 4
                if code == q == SYSTEM:
                    yield cut, base + START
                for p in BEFORE[q]:
                    if code == q:
                        yield cut, base + p
                    yield 2 + cut, base + p

    def cheapest(self, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
        """Cost and audit of the cheapest edits from a state to one of ``exits``; None if there are none."""
        source, targets = entry, [4 * self.n + q for q in exits]
        ahead, back = {source: 0}, dict.fromkeys(targets, 0)
        front, rear = [(0, source)], [(0, t) for t in targets]
        met = {0} if source in back else set()
        best = 0 if met else None
        done_ahead: set[int] = set()
        done_back: set[int] = set()
        while front and rear and (best is None or front[0][0] + rear[0][0] <= best):
            if front[0][0] <= rear[0][0]:
                cost, node = heappop(front)
                if node in done_ahead:
                    continue
                done_ahead.add(node)
                for _, step, to in self.ahead(node):
                    if cost + step < ahead.get(to, cost + step + 1):
                        ahead[to] = cost + step
                        heappush(front, (cost + step, to))
                        if to in back and (best is None or cost + step + back[to] < best):
                            best = cost + step + back[to]
            else:
                cost, node = heappop(rear)
                if node in done_back:
                    continue
                done_back.add(node)
                for step, to in self.behind(node):
                    if cost + step < back.get(to, cost + step + 1):
                        back[to] = cost + step
                        heappush(rear, (cost + step, to))
                        if to in ahead and (best is None or cost + step + ahead[to] < best):
                            best = cost + step + ahead[to]
        if best is None:
            return None
        # Every node of a cheapest way is settled from one end at least; where both ends' costs add up to the best, both are final.
        # Nodes settled ahead only lead on if a crossing lies behind them.
        leads = {n for n in done_ahead if ahead[n] + back.get(n, best + 1) == best}
        leads |= {n for n in done_ahead if any(ahead[n] + step + back.get(to, best + 1) == best for _, step, to in self.ahead(n))}
        todo = list(leads)
        while todo:
            node = todo.pop()
            for step, origin in self.behind(node):
                if origin in done_ahead and origin not in leads and ahead[origin] + step == ahead[node]:
                    leads.add(origin)
                    todo.append(origin)
        # No audit of equal cost between two nodes begins another, so the least letter at each node gives the least audit.
        letters, node, spent = [], source, 0
        goal = set(targets)
        while spent < best or node not in goal:
            for letter, step, to in self.ahead(node):
                reached = spent + step
                if reached + back.get(to, best + 1) == best or to in leads and ahead[to] == reached:
                    letters.append(letter)
                    node, spent = to, reached
                    break
            else:
                raise AssertionError("a cheapest way leads on")
        return best, "".join(letters)


def with_copies(audit: str, copies: list[int]) -> str:
    """The audit of all rows, from that of distinct ones: copies of a row go right behind it."""
    if max(copies, default=1) == 1:
        return audit
    left, out = iter(copies), []
    for letter in audit:
        out.append(letter)
        if letter != "I":
            out.append("D" * (next(left) - 1))
    return "".join(out)


def legal(before: int, after: int) -> bool:
    """Whether a role may follow another: su, ua, au."""
    return (before, after) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


ENDS = (START, ASSISTANT)


def _matrices(batches):
    """Runs of long conversations: the cost of each way from state to state, and the rank of its audit among those of its entry."""
    for batch in slices(batches):
        rows = []
        for row in batch.to_pylist():
            lattice = Lattice([r["code"] for r in row["rows"]], row["run"] == row["tail"])
            costs, ranks = [], []
            for entry in range(4) if row["run"] > row["head"] else [START]:
                ways = [lattice.cheapest(entry, ENDS)] if lattice.last else [lattice.cheapest(entry, (q,)) for q in range(4)]
                order = sorted(w[1] for w in ways if w)
                costs.append([w and w[0] for w in ways])
                ranks.append([w and order.index(w[1]) for w in ways])
            rows.append((costs, ranks))
        yield pa.record_batch(
            [batch.column("conv_id"), batch.column("run"), pa.array([r[0] for r in rows], _GRID), pa.array([r[1] for r in rows], _GRID)],
            ["conv_id", "run", "costs", "ranks"],
        )


_GRID = pa.list_(pa.list_(pa.int64()))


def _chained(batches):
    """The states that the cheapest edits of a conversation pass between its runs."""
    for batch in slices(batches):
        ids, runs, entries, exits = [], [], [], []
        for at, row in enumerate(batch.column("runs").to_pylist()):
            rest = [c[0] for c in row[-1]["costs"]]  # from each state to the end
            rests = [rest]
            for run in reversed(row[:-1]):
                rest = [min(c + r for c, r in zip(costs, rest) if c is not None and r is not None) for costs in run["costs"]]
                rests.append(rest)
            rests.reverse()
            state = START
            for run, here, after in zip(row, rests, [*rests[1:], None]):
                runs.append(run["run"])
                ids.append(at)
                entries.append(state)
                if after is not None:
                    costs, ranks = run["costs"][state], run["ranks"][state]
                    fits = [q for q in range(4) if costs[q] is not None and costs[q] + after[q] == here[state]]
                    state = min(fits, key=ranks.__getitem__)
                exits.append(state if after is not None else None)
        yield pa.record_batch(
            [batch.column("conv_id").take(pa.array(ids, pa.int64())), pa.array(runs, pa.int64()), pa.array(entries, pa.int32()), pa.array(exits, pa.int32())],
            ["conv_id", "run", "entry", "exit"],
        )


def _solved(batches):
    """Runs with the states at their ends, to their costs, audits, first and last roles and illegal neighbours."""
    for batch in slices(batches):
        found = []
        for row in batch.to_pylist():
            codes, copies = [r["code"] for r in row["rows"]], [r["n"] for r in row["rows"]]
            lattice = Lattice(codes, row["run"] == row["tail"])
            cost, audit = lattice.cheapest(row["entry"] or START, ENDS if row["exit"] is None else (row["exit"],))
            roles = [c & 3 for c in codes]
            illegal = sum(copies) - len(copies) + sum(not legal(a, b) for a, b in zip(roles, roles[1:]))
            extra = 3 * (sum(copies) - len(copies))
            found.append((cost + extra, with_copies(audit, copies), roles[0], roles[-1], illegal))
        yield pa.record_batch(
            [batch.column("conv_id"), batch.column("run"), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(_SOLVED))],
            ["conv_id", "run", "cost", "audit", "first", "last", "illegal"],
        )


_SOLVED = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64())


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in, by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2
    takes its full stops, exclamation and question marks away, 3 repeats it, 4 gives it the role user.

    A NULL counts as one blank, in the role, in the text and in what is hashed.
    """

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    return (
        conversations.where(fault != 0)
        .select(
            "conv_id",
            "turn",
            F.when(fault == 4, "user").otherwise(known("role")).alias("role"),
            text.alias("text"),
            F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_"),
        )
        .drop("_")
    )


def _slim(turns: DataFrame) -> DataFrame:
    """The rows without their texts."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    initial = F.substring(role, 1, 1)
    return turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("mark"),
        F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER).alias("initial"),
        (~text.rlike(f"[^{SPACES}]")).alias("blank"),
        (~text.rlike(rf"[.!?][{SPACES}]*\z")).alias("cut"),
    )


def _placed(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number, code and place, in the order of conversations and their rows.

    A row is a repetition if its role and text stand in its conversation at a smaller turn; other rows of the
    same turn, role and text are its copies.
    """
    slim = _slim(turns)
    rows = slim.groupBy("conv_id", "turn", "role", "mark", "initial", "blank", "cut").agg(F.count("*").alias("n"))
    seen = slim.groupBy(F.col("conv_id").alias("in"), F.col("role").alias("as"), F.col("mark").alias("saying")).agg(
        F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("at_null")
    )
    same = F.col("conv_id").eqNullSafe(F.col("in")) & (F.col("role") == F.col("as")) & (F.col("mark") == F.col("saying"))
    fresh = F.when(F.col("at_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    code = F.col("initial") + F.when(F.col("blank") | ~fresh, GOES).otherwise(0) + F.when(F.col("cut") & ~F.col("blank") & fresh, CUT).otherwise(0)
    known = rows.join(seen, same).select("conv_id", "turn", "role", "mark", "blank", "n", code.cast("int").alias("code"))
    known = stage(known, "conversation-rows")
    order = ["conv_id", "turn", "role", "mark"]
    return stage(known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "conversation-places")


def _audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows."""
    placed = _placed(turns).withColumn("run", F.shiftright("place", RUN_BITS))
    goes, cut = F.col("code").bitwiseAND(GOES) > 0, F.col("code").bitwiseAND(CUT) > 0
    facts = placed.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(goes, F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(cut.cast("long")).alias("truncated"),
        F.min("run").alias("head"),
        F.max("run").alias("tail"),
    )
    facts = stage(facts.withColumnRenamed("conv_id", "conv"), "conversation-facts")
    own = F.col("conv_id").eqNullSafe(F.col("conv"))
    runs = placed.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list(F.struct("place", "code", "n"))).alias("rows"))
    runs = stage(runs.join(facts.select("conv", "head", "tail"), own).drop("conv"), "conversation-runs")
    kind = dict(runs.dtypes)["conv_id"]
    costs = runs.where("head < tail").mapInArrow(_matrices, f"conv_id {kind}, run long, costs array<array<long>>, ranks array<array<long>>")
    chains = costs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "costs", "ranks"))).alias("runs"))
    states = chains.mapInArrow(_chained, f"conv_id {kind}, run long, entry int, exit int")
    states = stage(states, "conversation-states").select(F.col("conv_id").alias("conv"), F.col("run").alias("at"), "entry", "exit")
    solved = (
        runs.join(states, own & (F.col("run") == F.col("at")), "left")
        .select("conv_id", "run", "tail", "rows", "entry", "exit")
        .mapInArrow(_solved, f"conv_id {kind}, run long, cost long, audit string, first int, last int, illegal long")
    )
    parts = solved.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "cost", "audit", "first", "last", "illegal"))).alias("parts"))
    meets = F.expr(
        "zip_with(parts, slice(parts, 2, size(parts)), (x, y) -> "
        f"if(y is null or (x.last, y.first) in (({SYSTEM}, {USER}), ({USER}, {ASSISTANT}), ({ASSISTANT}, {USER})), 0L, 1L))"
    )

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda a, b: a + b)

    return (
        parts.join(facts, own)
        .select(
            "conv_id",
            *[F.col(c).cast("long") for c in ("gaps", "blank", "duplicate", "truncated")],
            (total(F.col("parts.illegal")) + total(meets)).alias("illegal"),
            total(F.col("parts.cost")).alias("cost"),
            F.array_join("parts.audit", "").alias("audit"),
        )
    )


_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _stream(turns: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Every conversation's facts and audit (part 0) and behind them its rows in order (part 1)."""
    audits = _audits(turns)
    if ids is not None:
        every = ids.select(F.col("conv_id").alias("conv")).distinct()
        audits = every.join(audits, F.col("conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("conv", "conv_id")
    heads = audits.select("conv_id", F.lit(0).alias("part"), *[F.coalesce(c, F.lit(0)).alias(c) for c in _FACTS], F.coalesce("audit", F.lit("")).alias("audit"))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    mark = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = turns.select("conv_id", F.lit(1).alias("part"), "turn", role.alias("role"), mark.alias("mark"), text.alias("text"))
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "mark").drop("turn", "mark")


def _edits(batches) -> Iterator[tuple]:
    """Reads a stream of conversations: ("conversation", row) at each begin, then ("turn", letter, role, text) for each repaired turn."""
    letters, state = iter(()), START

    def inserted():
        nonlocal state
        state = AFTER[state]
        return "turn", "I", "user" if state == USER else "assistant", ""

    for batch in slices(batches):
        for row in batch.to_pylist():
            if not row["part"]:
                for _ in letters:  # what is left of an audit behind the last row are inserts
                    yield inserted()
                letters, state = iter(row["audit"]), START
                yield "conversation", row
                continue
            letter = next(letters)
            while letter == "I":
                yield inserted()
                letter = next(letters)
            if letter == "R":
                state = AFTER[state]
                yield "turn", "R", "user" if state == USER else "assistant", row["text"]
            elif letter == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[row["role"][0]]
                yield "turn", "K", row["role"], row["text"]
    for _ in letters:
        yield inserted()


def _in_batches(rows: Iterator[tuple], kind: pa.Schema, size: int = 1000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)


def _turns(kind: pa.Schema):
    def run(batches):
        def rows():
            conversation, step = None, 0
            for event, *rest in _edits(batches):
                if event == "conversation":
                    conversation, step = rest[0]["conv_id"], 0
                else:
                    yield conversation, step, *rest
                    step += 1

        yield from _in_batches(rows(), kind)

    return run


def _hashed(kind: pa.Schema):
    def run(batches):
        def rows():
            conversation, digest, begun = None, None, False

            def ended():
                return conversation["conv_id"], *(conversation[f] for f in _FACTS), conversation["audit"], digest.hexdigest()

            for event, *rest in _edits(batches):
                if event == "conversation":
                    if conversation is not None:
                        yield ended()
                    conversation, digest, begun = rest[0], hashlib.sha256(), False
                else:
                    _, role, text = rest
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
            if conversation is not None:
                yield ended()

        yield from _in_batches(rows(), kind)

    return run


def _streamed(turns: DataFrame, ids: DataFrame | None, run, columns: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spec = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {columns}"
    return _stream(turns, ids).mapInArrow(run(to_arrow_schema(StructType.fromDDL(spec))), spec)


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, step long (from 0), edit (K, R or I), role, text.

    ``turns`` has conv_id (of a type that can be sorted), turn long, role, text; other columns are ignored. Rows are taken by turn, NULL first; rows of one turn by
    role and the SHA-256 of their text. A NULL role or text counts as one blank; rows without a conversation are one
    conversation, NULL. A blank row (nothing but white space) and a row whose role and text stand earlier must
    go; of several faults of a row the first of blank, repeated, truncated counts. Equal rows of one turn are copies. A conversation of which
    nothing stays has no rows here, an empty table none.

    Rows move without texts until the edits are known; the last step streams a conversation's rows in order.
    """
    return _streamed(turns, None, _turns, "step long, edit string, role string, text string")


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Each conversation's faults, edits and the hash of what ``repair`` makes of it: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost (longs), audit, repaired_sha256 of its ``role:text``, joined by newlines.

    Every conv_id of ``ids`` gets a row, also without rows in ``turns``: zeros, an empty audit, the hash of nothing. gaps are the
    numbers missing between the smallest and the largest turn. SHA-256 takes a conversation's texts one
    after the other, so one task streams them; it holds the conversation's audit, and one batch of rows.
    """
    return _streamed(turns, ids, _hashed, ", ".join(f"{f} long" for f in _FACTS) + ", audit string, repaired_sha256 string")
