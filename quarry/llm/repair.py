"""Conversation structure repair by a rank-compressed dynamic programme.

A conversation's turns, in order, are edited into roles of the form ``(s?(ua)+)?`` at
least cost.  Each turn takes one macro edit: a run of inserted turns, then Keep, Rerole
or Delete.  A macro's code is the initials of its edits (``K``, ``ID``, ...); every code
ends in its only letter that is not ``I``, so codes are prefix-free and the order of two
audit strings of equally many turns is the order of their first codes that differ.  A
layer of the programme therefore keeps, per state, a cost and the *rank* of its audit
string among the layer's states instead of the string itself, and a pointer to the state
before; strings and turns are rebuilt afterwards by following the pointers.

Costs are kept relative to a layer's least, and a state that is worse by more than
``WORST`` cannot be on a best path (the difference between what two states still have to
pay is at most that), so there are few different layers.  A layer's successor for a kind
of turn is computed once and remembered: a turn costs one look-up.

Scale: turns are range-partitioned by (conversation, turn, row), so one conversation that
holds a third of all rows is spread over many tasks.  Conversations inside one partition
are finished there.  The others - at most two a partition, and the long ones - become
pieces: each piece gives the costs and ranks from every state to every state, pieces of a
conversation (at most one a partition) are joined, and the pieces are then rebuilt in
parallel.  The digest of a whole conversation is one hash over bytes in order: its pieces
are streamed through a hash in one task that holds one turn at a time.

Defined results: a null role or text counts as one space; a null conversation id is one
conversation; null turns come first, ties keep the table's order; a conversation without
turns has zeros, an empty audit and the digest of the empty text; an empty table gives an
empty result; other columns are ignored, whatever their names.  Insert runs of more than
two turns are never cheapest: two inserted turns lead back to the state before them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import UID, read_table, with_uid, written

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
STOPS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WORST = 12
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

# States: nothing yet, after system, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (EMPTY, ASSISTANT)
_ADD = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
RUN = 2  # inserted turns in a row

FINE, BLANK, DUPLICATE, CUT = range(4)
_ROW = 4096


def fault(text: str) -> int:
    """A turn's own fault: blank, cut off, or none."""
    s = text.strip(SPACE)
    return BLANK if not s else FINE if s[-1] in STOPS else CUT


def macros(initial: str, why: int) -> list[tuple[int, str, int, int]]:
    """(state before, code, cost, state after) of all macro edits of a turn."""
    out = []
    for start in range(4):
        q = start
        for run in range(RUN + 1):
            code, paid = "I" * run, INSERT * run
            out.append((start, code + "D", paid + DELETE, q))
            if why not in (BLANK, DUPLICATE):
                kept = paid + (TRUNCATED if why == CUT else 0)
                if initial == "s" and q == EMPTY:
                    out.append((start, code + "K", kept, SYSTEM))
                if (initial == "u" and q != USER) or (initial == "a" and q == USER):
                    out.append((start, code + "K", kept, _ADD[q]))
                out.append((start, code + "R", kept + REROLE, _ADD[q]))
            q = _ADD[q]
    return out


Entry = tuple[int, int] | None
Layer = tuple[tuple[Entry, ...], ...]


def ranked(found: dict[int, tuple]) -> dict[int, int]:
    """Ranks of the audit strings that states were reached by: (cost, rank before, code or rank)."""
    return {q: i for i, (_, q) in enumerate(sorted((v[1:3], q) for q, v in found.items()))}


class Programme:
    """Layers by number and the steps between them, computed when first met.  A layer has a row per state that the turns began in."""

    def __init__(self):
        self.layers: list[Layer] = []
        self.number: dict[Layer, int] = {}
        self.steps: dict[tuple[int, str, int], tuple[int, tuple, tuple]] = {}
        self.start = self._add(tuple(tuple((0, 0) if p == q else None for q in range(4)) for p in range(4)))

    def _add(self, layer: Layer) -> int:
        if layer not in self.number:
            self.number[layer] = len(self.layers)
            self.layers.append(layer)
        return self.number[layer]

    def step(self, at: int, initial: str, why: int) -> tuple[int, tuple[int, ...], tuple[dict[int, tuple[int, str]], ...]]:
        """The next layer, what its costs are relative to, and per first state the pointers: state -> (state before, code)."""
        key = (at, initial if initial in ("s", "u", "a") else "", why)
        if key not in self.steps:
            edits = macros(key[1], why)
            rows, bases, pointers = [], [], []
            for row in self.layers[at]:
                best: dict[int, tuple] = {}
                for q, code, cost, r in edits:
                    if row[q] is not None:
                        new = (row[q][0] + cost, row[q][1], code, q)
                        if r not in best or new < best[r]:
                            best[r] = new
                base = min(v[0] for v in best.values())
                best = {r: v for r, v in best.items() if v[0] <= base + WORST}
                rank = ranked(best)
                rows.append(tuple((best[r][0] - base, rank[r]) if r in best else None for r in range(4)))
                bases.append(base)
                pointers.append({r: (v[3], v[2]) for r, v in best.items()})
            self.steps[key] = self._add(tuple(rows)), tuple(bases), tuple(pointers)
        return self.steps[key]

    def forward(self, kinds: list[tuple[str, int]]) -> tuple[list[tuple], list[list]]:
        """The steps' pointers, and per first state [cost, rank] or None for each last state."""
        at, paid, trail = self.start, [0, 0, 0, 0], []
        for initial, why in kinds:
            at, bases, pointers = self.step(at, initial, why)
            paid = [x + y for x, y in zip(paid, bases)]
            trail.append(pointers)
        return trail, [[None if e is None else [paid[p] + e[0], e[1]] for e in row] for p, row in enumerate(self.layers[at])]

    @staticmethod
    def back(trail: list[tuple], first: int, last: int) -> list[str]:
        """The macro codes from the first state to the last."""
        codes, q = [], last
        for pointers in reversed(trail):
            q, code = pointers[first][q]
            codes.append(code)
        return codes[::-1]


def finish(row: list) -> tuple[int, int, str]:
    """(cost, last state, run of inserts at the end) of the best way out of states with [cost, rank]."""
    out = []
    for q, e in enumerate(row):
        if e is not None:
            end = q
            for run in range(RUN + 1):
                if end in FINAL:
                    out.append((e[0] + INSERT * run, e[1], "I" * run, q))
                end = _ADD[end]
    cost, _, run, q = min(out)
    return cost, q, run


def rebuilt(codes: list[str], first: int, turns: list[tuple[str, str]]) -> Iterator[tuple[int, str, str, str]]:
    """(index of the turn, edit, role, text) for every edit of the codes; a deletion has the role and text that go."""
    q = first
    for i, code in enumerate(codes):
        for edit in code:
            if edit == "I":
                q = _ADD[q]
                yield i, edit, _NAME[q], ""
            elif edit == "D":
                yield i, edit, *turns[i]
            else:
                role, text = turns[i]
                q = SYSTEM if edit == "K" and role[:1] == "s" else _ADD[q]
                yield i, edit, role if edit == "K" else _NAME[q], text


class Tally:
    """The counts of some turns in order, and what joining them to those of the next turns needs."""

    NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal")

    def __init__(self):
        self.low = self.high = self.before = None
        self.distinct = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, initial: str, why: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.faults[why] += 1
        self.illegal += self.before is not None and (self.before, initial) not in LEGAL
        self.before = initial

    def values(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal]


# --- inside a partition --------------------------------------------------------

_OUT = "rec string, part int, turn bigint, uid bigint, copy int, place bigint, role string, text string, edit string, why int, counts array<bigint>, cost bigint, audit string, sha256 string"
_FIELDS = [("rec", pa.string()), ("part", pa.int32()), ("turn", pa.int64()), ("uid", pa.int64()), ("copy", pa.int32()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()),
           ("why", pa.int32()), ("counts", pa.list_(pa.int64())), ("cost", pa.int64()), ("audit", pa.string()), ("sha256", pa.string())]


class Rows:
    """Collects records and yields them as batches of bounded size."""

    def __init__(self, kind: pa.DataType, fields: list):
        self.schema = pa.schema([("conv", kind), *fields])
        self.held: list[dict] = []
        self.size = 0

    def put(self, **record) -> None:
        self.held.append(record)
        self.size += 64 + len(record.get("text") or "") + len(record.get("audit") or "")

    def full(self) -> Iterator[pa.RecordBatch]:
        if len(self.held) >= _ROW or self.size > 4_000_000:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_pylist(self.held, schema=self.schema)
            self.held, self.size = [], 0


def _tuples(batches, names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, _ROW):
            part = batch.slice(a, _ROW)
            yield from zip(*(part.column(n).to_pylist() for n in names))


def _whole(out: Rows, programme: Programme, conv, held: list[tuple], rows: bool) -> None:
    """The records of a conversation whose turns (turn, uid, copy, role, text) are all held."""
    tally, seen, kinds = Tally(), set(), []
    for turn, _, _, role, text in held:
        why = fault(text)
        if why != BLANK and (role, text) in seen:
            why = DUPLICATE
        seen.add((role, text))
        kinds.append((role[:1], why))
        tally.add(turn, role[:1], why)
    trail, costs = programme.forward(kinds)
    cost, last, run = finish(costs[EMPTY])
    codes = [*programme.back(trail, EMPTY, last), run]
    turns = [(h[3], h[4]) for h in held]
    digest, place = hashlib.sha256(), 0
    for i, edit, role, text in rebuilt(codes, EMPTY, turns):
        if rows:
            turn, uid, copy = held[min(i, len(held) - 1)][:3]
            out.put(conv=conv, rec="row", turn=turn, uid=uid, copy=copy, place=place, role=role, text=text, edit=edit)
        elif edit != "D":
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        place += rows or edit != "D"
    if not rows:
        out.put(conv=conv, rec="report", counts=tally.values(), cost=cost, audit="".join(codes), sha256=digest.hexdigest())


def _partition(batches, kind: pa.DataType, rows: bool) -> Iterator[pa.RecordBatch]:
    """Conversations that begin and end inside the partition are done; the turns of its first and last are passed on as pieces."""
    part, out, programme = TaskContext.get().partitionId(), Rows(kind, _FIELDS), Programme()
    conv, held, first, any_row = None, [], True, False

    def piece(c, h):
        turn, uid, copy, role, text = h
        out.put(conv=c, rec="piece", part=part, turn=turn, uid=uid, copy=copy, role=role, text=text, why=fault(text))

    for c, *h in _tuples(batches, ["conv", "turn", "uid", "copy", "role", "text"]):
        if any_row and c != conv:
            if not first:
                _whole(out, programme, conv, held, rows)
            first, held = False, []
        conv, any_row = c, True
        if first:
            piece(c, h)
        else:
            held.append(h)
        yield from out.full()
    for h in held:
        piece(conv, h)
        yield from out.full()
    yield from out.rest()


# --- pieces ------------------------------------------------------------------------

_SEGMENT = "part int, turn bigint, uid bigint, copy int, costs array<bigint>, counts array<bigint>, first_initial string, last_initial string, low bigint, high bigint"
_SEGMENT_FIELDS = [("part", pa.int32()), ("turn", pa.int64()), ("uid", pa.int64()), ("copy", pa.int32()), ("costs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                   ("first_initial", pa.string()), ("last_initial", pa.string()), ("low", pa.int64()), ("high", pa.int64())]


def _segments(batches, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One record per piece: costs and ranks from every state to every state, counts, and its ends."""
    out, programme, key, state = Rows(kind, _SEGMENT_FIELDS), Programme(), None, None

    def close():
        place, at, paid, tally, initial = state
        flat = []
        for p, row in enumerate(programme.layers[at]):
            for e in row:
                flat += [-1, -1] if e is None else [paid[p] + e[0], e[1]]
        counts = [*tally.values()[1:], tally.distinct]
        out.put(conv=key[0], part=key[1], turn=place[0], uid=place[1], copy=place[2], costs=flat, counts=counts, first_initial=initial, last_initial=tally.before, low=tally.low, high=tally.high)

    for conv, part, turn, uid, copy, initial, why in _tuples(batches, ["conv", "part", "turn", "uid", "copy", "initial", "why"]):
        if key != (conv, part):
            if key is not None:
                close()
                yield from out.full()
            key, state = (conv, part), [(turn, uid, copy), programme.start, [0, 0, 0, 0], Tally(), initial]
        at, bases, _ = programme.step(state[1], initial, why)
        state[1], state[2] = at, [x + y for x, y in zip(state[2], bases)]
        state[3].add(turn, initial, why)
    if key is not None:
        close()
    yield from out.rest()


_PLAN = "part int, first int, last int, tail string, counts array<bigint>, cost bigint"
_PLAN_FIELDS = [("part", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("tail", pa.string()), ("counts", pa.list_(pa.int64())), ("cost", pa.int64())]


def _joined(batches, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Per piece the states it begins and ends in; a conversation's last piece has its cost, counts and closing inserts."""
    out, conv, pieces = Rows(kind, _PLAN_FIELDS), None, []

    def close():
        now, trail = [[0, 0], None, None, None], []
        blank, duplicate, cut, illegal, distinct = (sum(p["counts"][i] for p in pieces) for i in range(5))
        low = high = last = None
        for p in pieces:
            m, best = p["costs"], {}
            for q, e in enumerate(now):
                for r in range(4) if e is not None else ():
                    if (c := m[8 * q + 2 * r]) >= 0:
                        new = (e[0] + c, e[1], m[8 * q + 2 * r + 1], q)
                        if r not in best or new < best[r]:
                            best[r] = new
            rank = ranked(best)
            now = [[best[r][0], rank[r]] if r in best else None for r in range(4)]
            trail.append({r: v[3] for r, v in best.items()})
            illegal += last is not None and (last, p["first_initial"]) not in LEGAL
            last = p["last_initial"]
            if p["low"] is not None:
                distinct -= high == p["low"]
                low, high = p["low"] if low is None else low, p["high"]
        cost, q, run = finish(now)
        counts = [0 if low is None else high - low + 1 - distinct, blank, duplicate, cut, illegal]
        for i in range(len(pieces) - 1, -1, -1):
            end, q, done = q, trail[i][q], i == len(pieces) - 1
            out.put(conv=conv, part=pieces[i]["part"], first=q, last=end, tail=run if done else "", counts=counts if done else None, cost=cost if done else None)

    names = ["part", "costs", "counts", "first_initial", "last_initial", "low", "high"]
    for c, *rest in _tuples(batches, ["conv", *names]):
        if pieces and c != conv:
            close()
            pieces = []
            yield from out.full()
        conv = c
        pieces.append(dict(zip(names, rest)))
    if pieces:
        close()
    yield from out.rest()


def _edited(batches, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The edits of each piece as records in order; a piece's turns are held while its pointers are followed."""
    out, programme, key, held, plan = Rows(kind, _FIELDS), Programme(), None, [], None

    def close():
        first, last, tail, counts, cost = plan
        trail, _ = programme.forward([(h[3][:1], h[5]) for h in held])
        codes = [*programme.back(trail, first, last), tail]
        for n, (i, edit, role, text) in enumerate(rebuilt(codes, first, [(h[3], h[4]) for h in held])):
            turn, uid, copy = held[min(i, len(held) - 1)][:3]
            out.put(conv=key[0], rec="row", part=key[1], turn=turn, uid=uid, copy=copy, place=n, role=role, text=text, edit=edit, counts=counts, cost=cost)
            yield from out.full()

    names = ["conv", "part", "first", "last", "tail", "counts", "cost", "turn", "uid", "copy", "role", "text", "why"]
    for conv, part, first, last, tail, counts, cost, *h in _tuples(batches, names):
        if key is not None and key != (conv, part):
            yield from close()
            held = []
        key, plan = (conv, part), (first, last, tail, counts, cost)
        held.append(h)
    if key is not None:
        yield from close()
    yield from out.rest()


def _digests(batches, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Reports of conversations whose edits come in order; holds a hash, the audit and one turn."""
    out, conv, state = Rows(kind, _FIELDS), None, None

    def close():
        digest, _, audit, counts, cost = state
        out.put(conv=conv, rec="report", counts=counts, cost=cost, audit="".join(audit), sha256=digest.hexdigest())

    for c, role, text, edit, counts, cost in _tuples(batches, ["conv", "role", "text", "edit", "counts", "cost"]):
        if state is None or c != conv:
            if state is not None:
                close()
                yield from out.full()
            conv, state = c, [hashlib.sha256(), False, [], None, None]
        if edit != "D":
            state[0].update(f"{chr(10) if state[1] else ''}{role}:{text}".encode())
            state[1] = True
        state[2].append(edit)
        if counts is not None:
            state[3], state[4] = counts, cost
    if state is not None:
        close()
    yield from out.rest()


def _run(turns: DataFrame, rows: bool) -> DataFrame:
    """Records of kind row (rows) or report of all conversations of turns (conv, turn, uid, copy, role, text)."""
    kind = turns.schema["conv"].dataType
    name = kind.simpleString()
    arrow = to_arrow_type(kind)
    order = ["turn", "uid", "copy"]
    spread = turns.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order)
    first = written(spread.mapInArrow(lambda it: _partition(it, arrow, rows), f"conv {name}, {_OUT}"), "turns")
    done = first.filter(F.col("rec") != "piece")
    pieces = first.filter("rec = 'piece'").select("conv", "part", *order, "role", "text", "why")
    # The first of equal turns is known by its row and copy, which no other turn has: no key is hot.
    same = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    firsts = pieces.groupBy("conv", same.alias("same")).agg(F.min(F.struct(*order)).alias("f")).select(F.col("f.uid").alias("uid"), F.col("f.copy").alias("copy"), F.lit(True).alias("is_first"))
    why = F.when((F.col("why") != BLANK) & F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("why")).alias("why")
    pieces = written(pieces.join(firsts, ["uid", "copy"], "left").select("conv", "part", *order, "role", "text", why), "pieces")
    slim = pieces.select("conv", "part", *order, F.left("role", F.lit(1)).alias("initial"), "why").repartition("conv", "part").sortWithinPartitions("conv", "part", *order)
    segments = slim.mapInArrow(lambda it: _segments(it, arrow), f"conv {name}, {_SEGMENT}")
    plan = segments.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(lambda it: _joined(it, arrow), f"conv {name}, {_PLAN}")
    plan = plan.select(F.col("conv").alias("p_conv"), F.col("part").alias("p_part"), "first", "last", "tail", "counts", "cost")
    whole = pieces.join(plan, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part"))).drop("p_conv", "p_part")
    edits = whole.repartition("conv", "part").sortWithinPartitions("conv", "part", *order).mapInArrow(lambda it: _edited(it, arrow), f"conv {name}, {_OUT}")
    if not rows:
        edits = edits.repartition("conv").sortWithinPartitions("conv", *order, "place").mapInArrow(lambda it: _digests(it, arrow), f"conv {name}, {_OUT}")
    return done.unionByName(edits)


def _prepared(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    rows = turns if UID in turns.columns else with_uid(turns)
    some = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    copy = F.lit(0) if copies is None else F.explode(F.sequence(F.lit(0), copies.cast("int")))
    return rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.col(UID).alias("uid"), copy.alias("copy"), some("role"), some("text"))


def repaired(turns: DataFrame) -> DataFrame:
    """The edits of every conversation: conv_id, role, text and edit (K, R, D or I), in order by turn, row_id, copy and place."""
    rows = _run(_prepared(turns), True)
    return rows.select(F.col("conv").alias("conv_id"), "turn", F.col("uid").alias("row_id"), "copy", "place", "role", "text", "edit")


def report(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """One row per conversation: its faults, the least cost, the audit string and the digest of the repaired turns.

    copies: how many times each row is repeated right after itself.
    """
    found = _run(_prepared(turns, copies), False)
    counts = [F.get("counts", F.lit(i)).alias(n) for i, n in enumerate(Tally.NAMES)]
    return found.select(F.col("conv").alias("conv_id"), *counts, "cost", "audit", F.col("sha256").alias("repaired_sha256"))


# --- the query ---------------------------------------------------------------------

DROP, EMPTIED, UNSTOPPED, REPEATED, AS_USER = range(5)


def damage_code() -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations as the contract says, and repairs them."""
    rows = with_uid(read_table(spark, sf_dir, "conversations")).select(UID, "conv_id", "turn", "role", "text")
    code = F.col("_q_code")
    text = F.when(code == EMPTIED, "").when(code == UNSTOPPED, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    damaged = rows.withColumn("_q_code", damage_code()).filter(code != DROP).withColumns({"text": text, "role": F.when(code == AS_USER, "user").otherwise(F.col("role"))})
    found = report(damaged, F.when(code == REPEATED, 1).otherwise(0))
    every = rows.select("conv_id").distinct()
    names = found.columns[1:]
    other = found.withColumnRenamed("conv_id", "_q_conv")
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    joined = every.join(other, F.col("conv_id").eqNullSafe(F.col("_q_conv")), "left")
    return joined.select("conv_id", *(F.coalesce(F.col(n), none.get(n, F.lit(0).cast("bigint"))).alias(n) for n in names))


def _oracle() -> str:
    """The programme with whole audit strings instead of ranks, single inserts instead of macros, as one recursion over a conversation's turns."""
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    best = lambda *xs: f"list_sort(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))[1]"
    plus = lambda s, cost, edit, text="''": f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'r': {s}.r || {text}}} END"
    put = lambda role, body="''": f"{role} || ':' || {body} || chr(10)"
    user, assistant = put("'user'"), put("'assistant'")

    def closed(e: str, s: str, u: str, a: str) -> tuple[str, ...]:
        """With one more insert before the next turn; two are never cheapest."""
        return e, s, best(u, plus(e, 5, "I", user), plus(s, 5, "I", user), plus(a, 5, "I", user)), best(a, plus(u, 5, "I", assistant))

    ce, cs, cu, ca = (f"t.{x}" for x in "esua")
    _, _, iu, ia = closed("p.e", "p.s", "p.u", "p.a")
    add = "CASE WHEN why = 'c' THEN 5 ELSE 0 END"
    edit = lambda s, cond, name, cost, text: f"CASE WHEN {cond} THEN {plus(s, f'{cost} + {add}', name, text)} END"
    ok = "why NOT IN ('b', 'd')"
    bit = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({key}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: {bit}), 4294967295)"
    keep, ru, ra = put("role", "text"), put("'user'", "text"), put("'assistant'", "text")
    into_u = [edit(x, f"{ok} AND i = 'u'", "K", 0, keep) for x in (ce, cs, ca)] + [edit(x, ok, "R", 1, ru) for x in (ce, cs, ca)] + [plus(cu, 2, "D")]
    into_a = [edit(cu, f"{ok} AND i = 'a'", "K", 0, keep), edit(cu, ok, "R", 1, ra), plus(ca, 2, "D")]
    into_s = [edit(ce, f"{ok} AND i = 's'", "K", 0, keep), plus(cs, 2, "D")]
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, file_row_number AS row, CASE WHEN code = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM (SELECT *, row_number() OVER () AS file_row_number, {crc} % 20 AS code FROM conversations) WHERE code <> 0),
w AS (
  SELECT *, left(role, 1) AS i, row_number() OVER o AS n, lag(left(role, 1)) OVER o AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, row, copy) AS nth
  FROM src WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, row, copy)),
k AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'c' ELSE '' END AS why FROM w),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (why = 'b') AS blank, count(*) FILTER (why = 'd') AS duplicate, count(*) FILTER (why = 'c') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || '/' || i NOT IN ('s/u', 'u/a', 'a/u')) AS illegal, max(n) AS last FROM k GROUP BY conv_id),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': 0, 'a': '', 'r': ''}}::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS e, {none} AS s, {none} AS u, {none} AS a FROM c
  UNION ALL
  SELECT conv_id, n, {plus(ce, 2, "D")}, {best(*into_s)}, {best(*into_u)}, {best(*into_a)} FROM (
    SELECT p.conv_id, k.n, k.role, k.text, k.i, k.why, p.e, p.s, {iu} AS u, {ia} AS a FROM dp p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND k.n = p.n + 1) t),
z AS (
  SELECT c.*, {best("dp.e", "dp.a", plus("dp.u", 5, "I", assistant))} AS b FROM c JOIN dp ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.n = c.last)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(left(b.r, length(b.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN z ON d.conv_id IS NOT DISTINCT FROM z.conv_id"""


ORACLE_SQL = _oracle()
