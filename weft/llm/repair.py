"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's role initials should read (s?(ua)+)?. Every turn is kept, given the
role that is due (rerole), or deleted; turns may be inserted. Four states say what
was last: nothing, s, u or a. A piece of a conversation is halved: a forward vector
has the least cost of reaching each state, a backward one the least cost of going on
from it, and the cheapest crossing is where both halves go on. Of crossings that
cost the same, the one is taken to which the ASCII-least audit leads: the forward
vector ranks its states by their least audits, which never are one another's
prefixes, since each ends with an edit that consumes a turn.

Order and faults are settled without text: equal turns of a conversation are one
entry with a count, entries are sorted by range over the whole key, so that a
conversation of any length lies over as many partitions as it needs, and the pieces
of a conversation that partitions cut are joined by their four-by-four costs, at
most two of them a partition. Text is shuffled once, beside the audits that tell
what becomes of it, and passes in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import WS_CHARS, cut

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: States, and role initials: nothing or another, s, u, a.
OTHER, S, U, A = range(4)
#: What comes next by rerole or insertion, and what a finished conversation lacks.
DUE = (U, U, A, U)
TAIL = ("", "II", "I", "")
ROLES = {U: "user", A: "assistant"}
#: States after which a turn of an initial may be kept.
KEPT_AFTER = {OTHER: (), S: (OTHER,), U: (OTHER, S, A), A: (U,)}
NEVER = 1 << 60
#: Characters of a text by which turns of equal number and role are ordered; then by hash.
HEAD = 64
SOUND, CUT_OFF, FORCED = range(3)


def _moves(code: int, state: int) -> tuple[tuple[int, int, str], ...]:
    """(state, cost, edits) of what a turn of this code can lead to: insertions, then one edit of the turn."""
    fault, initial = divmod(code, 4)
    late = UNFINISHED if fault == CUT_OFF else 0
    best: dict[int, tuple[int, str]] = {}
    for n in range(4):
        ways = [(state, DELETE, "D")]
        if fault != FORCED:
            ways.append((DUE[state], REROLE + late, "R"))
            if state in KEPT_AFTER[initial]:
                ways.append((initial, KEEP + late, "K"))
        for to, cost, edit in ways:
            found = (n * INSERT + cost, "I" * n + edit)
            best[to] = min(best.get(to, found), found)
        state = DUE[state]
    return tuple((q, *x) for q, x in best.items())


MOVES = [[_moves(code, s) for s in range(4)] for code in range(12)]
TAIL_COST = tuple(INSERT * len(t) for t in TAIL)


def forward(codes: bytes, begin: int) -> dict[int, tuple[int, int]]:
    """Least cost of reaching each state from `begin`, and the rank of its least audit among the states'."""
    live = {begin: (0, 0)}
    for code in codes:
        best: dict[int, tuple] = {}
        for s, (cost, rank) in live.items():
            for q, more, edits in MOVES[code][s]:
                way = (cost + more, rank, edits)
                if q not in best or way < best[q]:
                    best[q] = way
        order = sorted(best, key=lambda q: best[q][1:])
        live = {q: (best[q][0], i) for i, q in enumerate(order)}
    return live


def backward(codes: bytes, tail: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost of going on from each state, `tail` after the last turn."""
    for code in reversed(codes):
        tail = tuple(min(more + tail[q] for q, more, _ in MOVES[code][s]) for s in range(4))
    return tail


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if q == state else NEVER for q in range(4))


def edits_of(codes: bytes, begin: int, tail: tuple[int, ...]) -> tuple[list[str], int, int]:
    """(edits of each turn, their cost, last state): the cheapest ones, of those the ASCII-least."""
    out, total, state = [], 0, begin
    pieces = [(0, len(codes), begin, tail)] if codes else []
    while pieces:
        lo, hi, s, end = pieces.pop()
        if hi - lo == 1:
            _, edits, more, state = min((more + end[q], edits, more, q) for q, more, edits in MOVES[codes[lo]][s])
            out.append(edits)
            total += more
            continue
        mid = (lo + hi) // 2
        reach, rest = forward(codes[lo:mid], s), backward(codes[mid:hi], end)
        q = min(reach, key=lambda q: (reach[q][0] + rest[q], reach[q][1]))
        pieces += [(mid, hi, q, end), (lo, mid, s, _only(q))]
    return out, total, state


@lru_cache(1 << 14)
def _short(codes: bytes, begin: int, tail: tuple[int, ...]) -> tuple[list[str], int, int]:
    return edits_of(codes, begin, tail)


def _due(state: int, edit: str, initial: int) -> int:
    return state if edit == "D" else initial if edit == "K" else DUE[state]


def _order(text: Column | None = None) -> list[Column]:
    """The order of a conversation's turns. Equal rows are not told apart."""
    ties = ["role", "head", "h1", "h2"] if text is None else ["role", F.substring(text, 1, HEAD), *_prints(text)]
    return [F.col("turn").asc_nulls_first(), *ties]


def _prints(text: Column) -> tuple[Column, Column]:
    return F.xxhash64("role", text), F.xxhash64(text, F.lit(1), "role")


def _entries(rows: DataFrame) -> DataFrame:
    """Different turns with counts and codes, in order, `part` telling the partition."""
    body = F.rtrim(F.col("text"), F.lit(WS_CHARS))
    initial = F.coalesce(F.get(F.array(*map(F.lit, (S, U, A))), F.instr(F.lit("sua"), F.substring("role", 1, 1)) - 1), F.lit(OTHER))
    own = rows.select(
        "conv", "turn", "role", F.substring("text", 1, HEAD).alias("head"), *[h.alias(n) for h, n in zip(_prints(F.col("text")), ("h1", "h2"), strict=True)],
        F.when(F.substring("role", 1, 1) == "", OTHER).otherwise(initial).alias("initial"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(*".!?")).alias("open"),
    )
    counted = cut(own.groupBy(*own.columns).agg(F.count("*").alias("n")))
    at = F.struct(F.col("turn").isNotNull().alias("z"), "turn")
    firsts = counted.groupBy(F.col("conv").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min(at).alias("first"), F.count("*").alias("m")).where("m > 1")
    # Cut, so that both sides of the join are plain shuffles, whose hot keys Spark can split.
    firsts = cut(firsts.drop("m"))
    met = counted.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    coded = met.withColumn("seen", F.coalesce(at > F.col("first"), F.lit(False))).drop("c", "g1", "g2", "first")
    order = [F.col("conv").asc_nulls_first(), *_order()]
    return cut(coded.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def _code(initial: int, blank: bool, seen: bool, open_: bool) -> int:
    return initial + 4 * (FORCED if blank or seen else CUT_OFF if open_ else SOUND)


def _stretches(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[object, list, bool]]:
    """(conversation, its rows' tuples, whether the partition ends there): codes only, so a few bytes a row."""
    conv, rows, any_ = None, [], False
    for b in batches:
        for c, *row in zip(*(b.column(i).to_pylist() for i in range(columns)), strict=True):
            if any_ and c != conv:
                yield conv, rows, False
                rows = []
            conv, any_ = c, True
            rows.append(row)
    if any_:
        yield conv, rows, True


def _cut_pieces(entries: DataFrame, kind: str) -> DataFrame:
    """(conv, part, enter, leave, last) of the conversations that lie over several partitions."""

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for conv, rows, last in _stretches(batches, 6):
            if first or last:
                codes = bytes(_code(*r[1:]) for r in rows)
                table = [forward(codes, s) for s in range(4)]
                flat = [x for s in range(4) for q in range(4) for x in table[s].get(q, (NEVER, 0))]
                yield pa.RecordBatch.from_arrays([pa.array([conv], b_kind), pa.array([rows[0][0]], pa.int32()), pa.array([flat], pa.list_(pa.int64()))], ["conv", "part", "costs"])
            first = False

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, pieces in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                live, trail = {OTHER: (0, 0)}, []
                for piece in pieces:
                    best: dict[int, tuple] = {}
                    for s, (cost, rank) in live.items():
                        for q in range(4):
                            more, own = piece["costs"][8 * s + 2 * q : 8 * s + 2 * q + 2]
                            way = (cost + more, rank, own, s)
                            if more < NEVER and (q not in best or way < best[q]):
                                best[q] = way
                    trail.append({q: x[3] for q, x in best.items()})
                    live = {q: (best[q][0], i) for i, q in enumerate(sorted(best, key=lambda q: best[q][1:3]))}
                q = min(live, key=lambda q: (live[q][0] + TAIL_COST[q], live[q][1]))
                out = []
                for piece, back in zip(reversed(pieces), reversed(trail), strict=True):
                    out.append((piece["part"], back[q], q, not out))
                    q = back[q]
                parts, enter, leave, last = map(list, zip(*out, strict=True))
                arrays = [pa.array([conv.as_py()] * len(out), b_kind), pa.array(parts, pa.int32()), pa.array(enter, pa.int32()), pa.array(leave, pa.int32()), pa.array(last)]
                yield pa.RecordBatch.from_arrays(arrays, ["conv", "part", "enter", "leave", "last"])

    b_kind = pa.string() if kind == "string" else pa.int64()
    pieces = entries.select("conv", "part", "initial", "blank", "seen", "open").mapInArrow(costs, f"conv {kind}, part int, costs array<long>")
    lists = cut(pieces).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "costs"))).alias("pieces"))
    return cut(lists.where(F.size("pieces") > 1).mapInArrow(joined, f"conv {kind}, part int, enter int, leave int, last boolean"))


_SEGMENT = {
    "part": pa.int32(), "audit": pa.string(), **{k: pa.int64() for k in ("cost", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")}, "first": pa.int32(), "final": pa.int32(),
}


def _segments(entries: DataFrame, kind: str) -> DataFrame:
    """The audit and counts of each piece of a conversation that lies in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("conv", *_SEGMENT)}

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(v, _SEGMENT.get(k, b_kind)) for k, v in out.items()]
            for v in out.values():
                v.clear()
            return pa.RecordBatch.from_arrays(arrays, list(out))

        for conv, rows, _ in _stretches(batches, 11):
            codes = bytes(_code(*r[1:5]) for r in rows)
            enter, leave, last = rows[0][7:]
            solve = _short if len(codes) <= 64 else edits_of
            edits, cost, state = solve(codes, OTHER if enter is None else enter, TAIL_COST if enter is None else _only(leave))
            tail = TAIL[state] if enter is None or last else ""
            audit = "".join([e + "D" * (r[6] - 1) for e, r in zip(edits, rows, strict=True)]) + tail
            cost += INSERT * len(tail) + DELETE * sum(r[6] - 1 for r in rows)
            blank = sum(r[6] for r in rows if r[2])
            twice = sum(r[6] - (not r[3]) for r in rows if not r[2])
            unfinished = sum(1 for r in rows if r[4] and not r[2] and not r[3])
            initials = [r[1] for r in rows]
            illegal = sum(r[6] - 1 for r in rows) + sum(not _legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
            turns = [r[5] for r in rows if r[5] is not None]
            low, high = (turns[0], turns[-1]) if turns else (None, None)
            different = sum(a != b for a, b in zip(turns, turns[1:], strict=False)) + bool(turns)
            for k, v in zip(out, (conv, rows[0][0], audit, cost, blank, twice, unfinished, illegal, different, low, high, initials[0], initials[-1]), strict=True):
                out[k].append(v)
            if len(out["conv"]) >= 4096:
                yield batch()
        yield batch()

    b_kind = pa.string() if kind == "string" else pa.int64()
    cuts = _cut_pieces(entries, kind).select(F.col("conv").alias("c"), F.col("part").alias("p"), "enter", "leave", "last")
    # At most two rows a partition.
    met = entries.join(F.broadcast(cuts), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    rows = met.select("conv", "part", "initial", "blank", "seen", "open", F.col("turn").cast("long"), "n", "enter", "leave", "last")
    schema = f"conv {kind}, part int, audit string, cost long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first int, final int"
    return cut(rows.mapInArrow(run, schema))


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((S, U), (U, A), (A, U))


def _summary(segments: DataFrame) -> DataFrame:
    fields = ["part", "audit", *[k for k in _SEGMENT if k not in ("part", "audit")]]
    lists = segments.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("s"))
    s = F.col("s")
    before = lambda i: F.get(s, i - 1)
    code = lambda x, i: before(i)["final"] * 4 + x["first"]
    across = F.transform(s, lambda x, i: F.when((i > 0) & ~code(x, i).isin(4 * S + U, 4 * U + A, 4 * A + U), 1).otherwise(0))
    # A turn that two pieces share is counted once.
    shared = F.transform(s, lambda x, i: F.when((i > 0) & (before(i)["high"] == x["low"]), 1).otherwise(0))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + F.coalesce(y, F.lit(0)))
    gaps = F.array_max(s["high"]) - F.array_min(s["low"]) + 1 - (total(s["turns"]) - total(shared))
    return lists.select(
        "conv", F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"), *[total(s[k]).alias(k) for k in ("blank", "duplicate", "truncated")],
        (total(s["illegal"]) + total(across)).alias("illegal"), total(s["cost"]).alias("cost"), F.array_join(s["audit"], "").alias("audit"),
    )


def _mended(audits: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """The repaired turns, a conversation's together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, state = None, "", 0, 0, OTHER

        def inserted(out: list, stop: int) -> None:
            nonlocal at, place, state
            while at < stop and audit[at] == "I":
                state = DUE[state]
                out.append((conv, place, ROLES[state], "", "I"))
                at, place = at + 1, place + 1

        for b in batches:
            out: list[tuple] = []
            for c, told, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if told is not None:
                    inserted(out, len(audit))
                    conv, audit, at, place, state = c, told, 0, 0, OTHER
                    continue
                inserted(out, len(audit))
                edit = audit[at]
                at += 1
                if edit != "D":
                    state = DUE[state] if edit == "R" else "sua".index(role[0]) + 1
                    out.append((conv, place, ROLES[state] if edit == "R" else role, text, edit))
                    place += 1
            if out:
                yield record(out)
        out = []
        inserted(out, len(audit))
        if out:
            yield record(out)

    def record(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv", "place", "role", "text", "edit"])

    both = audits.select("conv", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")).unionByName(
        rows.select("conv", F.lit(None).cast("string").alias("audit"), F.col("turn").cast("long"), "role", "text")
    )
    sorted_ = both.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("audit").isNull(), *_order(F.col("text")))
    return sorted_.select("conv", "audit", "role", "text").mapInArrow(run, f"conv {kind}, place long, role string, text string, edit string")


def repair(
    convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): what was found in each conversation, and the repaired turns.

    conversations: id, gaps, blank, duplicate, truncated, illegal, cost, audit; one row
    for each id that has rows. turns: id, place (from 0), role, text, edit (K kept, R
    reroled, I inserted); a conversation's turns come together and in order.

    Turns go by number, null first; rows of one number by role, by the first HEAD
    characters of the text and by hash. Rows that are equal in number, role and text
    are all but the first duplicates. A null role or text is one space. A null id is
    a conversation of its own. Ids are whole numbers or text, turns whole numbers. An
    empty table gives no rows; other columns are not looked at. All turns of a
    conversation stream through one task for `turns`; its audit is one value.
    """
    kind = "string" if convs.schema[id_col].dataType.simpleString() == "string" else "long"
    rows = convs.select(
        F.col(id_col).cast(kind).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    )
    found = cut(_summary(_segments(_entries(rows), kind)))
    name = lambda d: d.withColumnRenamed("conv", id_col).withColumn(id_col, F.col(id_col).cast(convs.schema[id_col].dataType))
    return name(found), name(_mended(found, rows, kind))


def digests(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, repaired_sha256) of repair()'s turns: SHA-256 of `role:text` lines, taken as they stream by."""
    kind = turns.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv = None, None
        for b in batches:
            out: list[tuple] = []
            for c, place, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if place == 0:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if out:
                yield record(out, b.schema.field(0).type)
        if state is not None:
            yield record([(conv, state.hexdigest())], b.schema.field(0).type)

    def record(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        ids, found = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(found, pa.string())], [id_col, "repaired_sha256"])

    return turns.select(id_col, "place", "role", "text").mapInArrow(run, f"{id_col} {kind}, repaired_sha256 string")


def damaged(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """convs with the faults that crc32(`id:turn`) % 20 deals: 0 drops a row, 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes it the user's.

    Nulls count as one space, but for a turn's place in the order.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat(shown(id_col), F.lit(":"), shown(turn_col))) % 20
    rows = convs.select(id_col, turn_col, shown(role_col).alias(role_col), shown(text_col).alias(text_col), deal.alias("_deal")).where("_deal <> 0")
    text = F.when(F.col("_deal") == 1, "").when(F.col("_deal") == 2, F.translate(text_col, ".!?", "")).otherwise(F.col(text_col))
    return rows.select(
        id_col, turn_col, F.when(F.col("_deal") == 4, "user").otherwise(F.col(role_col)).alias(role_col), text.alias(text_col),
        F.explode(F.when(F.col("_deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def audited(convs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Every id of convs with what repair() finds and does after damaged()."""
    found, turns = repair(damaged(convs, id_col), id_col)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = convs.select(F.col(id_col).alias("_id")).distinct()
    sums = digests(turns, id_col).withColumnRenamed(id_col, "_of")
    met = ids.join(found, F.col("_id").eqNullSafe(F.col(id_col)), "left").join(sums, F.col("_id").eqNullSafe(F.col("_of")), "left")
    return met.select(
        F.col("_id").alias(id_col), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
