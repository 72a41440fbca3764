"""Repair of a conversation's structure: the cheapest edits that bring its roles into order, by iterative-deepening A*.

Turns are sorted by a range exchange over conversation and turn, so that a conversation of any size lies in order over as many tasks as
it needs. A task works through its rows as a stream and repairs each conversation that lies inside it. The first and the last of a task,
which may go on elsewhere, and those of more than PIECE rows leave as pieces of bounded size. Pieces tell which texts they hold (digests,
partial minima find the earlier ones) and what each way through them costs, between four states of the roles' grammar; a conversation's
pieces are put together from these few numbers, and only the chosen way is spelled out. The digest of a repaired conversation is taken
over its pieces in order, as a stream: it has no parallel form.

The search runs depth first in the ASCII order of the edits' initials (Delete, Insert, Keep, Rerole) under a growing bound on cost so far
plus what each row left costs at least, and remembers with how much left to spend a state has failed; so the first accepting path is the
cheapest and, among these, the least in ASCII order. Rows are taken SEGMENT at a time from the back: what follows a segment is known by
what it costs from each of the four states. Edits of a segment end with its last row, so that none is the beginning of another.

Cases: null roles and texts are one space; a null turn comes first and counts in no gap; rows of one turn are taken by role and text; a
null id is a conversation of its own; an empty role has no initial and may be kept anywhere; a role whose initial is none of s, u and a
can't be kept; other columns are left behind; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Collection, Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import columns, partitions, stored

#: Rows that are searched at once, and rows and bytes of a piece.
SEGMENT, PIECE, PIECE_BYTES = 8, 1024, 4 << 20
#: Costs of the edits and of a truncated row that stays, white space, marks that end a text, pairs of roles in order.
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
SPACE, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")
FINE, MUST_GO, CUT_OFF = range(3)
# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. What must come next and leads where; what else may.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (("u", USER), ("u", USER), ("a", ASSISTANT), ("u", USER))
KEPT = ({"s": SYSTEM, "u": USER, "": START}, {"u": USER, "": SYSTEM}, {"a": ASSISTANT, "": USER}, {"u": USER, "": ASSISTANT})
#: What is inserted at the end, so that the whole is accepted.
CLOSING = ("", "II", "I", "")

Row = tuple[int, str]  # kind and initial


def search(rows: list[Row], state: int, after: list[float]) -> tuple[float, str]:
    """Cost and edits of the best way through rows from a state; after is what the rest costs from each state. No way costs inf."""
    n = len(rows)
    left = [min(after)] * (n + 1)
    for i in range(n - 1, -1, -1):
        kind, initial = rows[i]
        stays = (KEEP if initial in ("s", "u", "a", "") else REROLE) + (TRUNCATED if kind == CUT_OFF else 0)
        left[i] = left[i + 1] + (DELETE if kind == MUST_GO else min(DELETE, stays))
    most = DELETE * n + 3 * INSERT + max((x for x in after if x < inf), default=inf)
    bound, above = left[0], inf
    failed: dict[int, float] = {}
    path: list[str] = []

    def deeper(i: int, q: int, spent: float) -> bool:
        nonlocal above
        least = spent + (after[q] if i == n else left[i])
        if least > bound:
            above = min(above, least)
            return False
        if i == n:
            return True
        key = i * 4 + q
        if failed.get(key, -1) >= bound - spent:
            return False
        kind, initial = rows[i]
        more = TRUNCATED if kind == CUT_OFF else 0
        path.append("D")
        if deeper(i + 1, q, spent + DELETE):
            return True
        path[-1] = "I"
        if deeper(i, NEXT[q][1], spent + INSERT):
            return True
        if kind != MUST_GO:
            kept = KEPT[q].get(initial)
            path[-1] = "K"
            if kept is not None and deeper(i + 1, kept, spent + KEEP + more):
                return True
            path[-1] = "R"
            if deeper(i + 1, NEXT[q][1], spent + REROLE + more):
                return True
        path.pop()
        failed[key] = bound - spent
        return False

    while bound <= most < inf:
        above = inf
        failed.clear()  # what failed under a lower bound hasn't said what it would have taken
        if deeper(0, state, 0):
            return bound, "".join(path)
        bound = above
    return inf, ""


def ways(rows: list[Row], after: list[float], entries: Collection[int]) -> dict[int, tuple[float, str]]:
    """search from each of the entries, for any number of rows: segments from the back, then along the chosen ones."""
    cuts = list(range(0, len(rows), SEGMENT))
    tables: list[list[tuple[float, str]]] = []
    for at in reversed(cuts):
        tables.append([search(rows[at : at + SEGMENT], q, after) if at or q in entries else (inf, "") for q in range(4)])
        after = [cost for cost, _ in tables[-1]]
    tables.reverse()
    out = {}
    for entry in entries:
        if not rows:
            out[entry] = after[entry], ""
            continue
        edits, q = [], entry
        for at, table in zip(cuts, tables):
            edits.append(table[q][1])
            q = walked(rows[at : at + SEGMENT], table[q][1], q)
        out[entry] = tables[0][entry][0], "".join(edits)
    return out


def walked(rows: list[Row], edits: str, state: int) -> int:
    """The state in which edits of rows end."""
    i = 0
    for e in edits:
        if e in "IR":
            state = NEXT[state][1]
        elif e == "K":
            state = KEPT[state][rows[i][1]]
        i += e != "I"
    return state


ROLE = {"u": "user", "a": "assistant"}


def spelled(edits: str, rows: list[tuple[str, str]], state: int) -> Iterator[str]:
    """role:text of what edits leave of rows (role, text), from a state."""
    i = 0
    for e in edits:
        if e == "D":
            i += 1
            continue
        role, state = (rows[i][0], KEPT[state][rows[i][0][:1]]) if e == "K" else (ROLE[NEXT[state][0]], NEXT[state][1])
        yield f"{role}:{'' if e == 'I' else rows[i][1]}"
        i += e != "I"


def digest_of(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}:{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def judged(turns: list[tuple], earlier: set[bytes]) -> tuple[list[Row], dict[str, int]]:
    """Kind and initial of turns (turn, role, text), and counts; earlier has the digests of what was seen before and grows."""
    rows, count = [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    last_initial, last_turn = None, None
    for turn, role, text in turns:
        text_end = text.rstrip(SPACE)[-1:]
        own = digest_of(role, text)
        fault = "blank" if not text_end else "duplicate" if own in earlier else "truncated" if text_end not in ENDS else None
        earlier.add(own)
        if fault:
            count[fault] += 1
        initial = role[:1]
        count["illegal"] += last_initial is not None and last_initial + initial not in LEGAL
        count["turns"] += turn is not None and turn != last_turn
        last_initial, last_turn = initial, turn
        rows.append((CUT_OFF if fault == "truncated" else MUST_GO if fault else FINE, initial))
    return rows, count


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def gaps(turns: list, distinct: int) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - distinct if known else 0


def repaired(turns: list[tuple]) -> tuple:
    """RESULT of one conversation's turns."""
    rows, count = judged(turns, set())
    cost, edits = ways(rows, [INSERT * len(c) for c in CLOSING], [START])[START]
    edits += CLOSING[walked(rows, edits, START)]
    whole = "\n".join(spelled(edits, [t[1:] for t in turns], START)).encode("utf-8", "surrogatepass")
    return gaps([t[0] for t in turns], count["turns"]), count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, edits, hashlib.sha256(whole).hexdigest()


def scanned(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over a task's sorted rows: results of the conversations that lie inside it, pieces of those that may not."""
    names = ["conv_id", *[c.split()[0] for c in RESULT.split(", ")], "part", "seq", "piece"]
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        held: list[tuple] = []
        now, first, seq, size, open_ = None, True, 0, 0, False

        def piece() -> None:
            nonlocal held, seq, size, open_
            out.append((now[0], *[None] * 8, part, seq, pickle.dumps(held)))
            held, seq, size, open_ = [], seq + 1, 0, True

        def packed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            return made

        for b in batches:
            for conv, turn, role, text, present in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present"))):
                if now is None or now[0] != conv:
                    if now is not None:
                        if first or open_:
                            piece()
                        else:
                            out.append((now[0], *repaired(held), None, None, None))
                        first, held, seq, size, open_ = False, [], 0, 0, False
                    now = (conv,)
                if present:
                    held.append((turn, role, text))
                    size += len(text)
                    if len(held) >= PIECE or size >= PIECE_BYTES:
                        piece()
                if len(out) >= 500:
                    yield packed()
        if now is not None:
            piece()
        if out:
            yield packed()

    return run


def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of every piece, each once."""
    for b in batches:
        for i, raw in enumerate(b.column("piece").to_pylist()):
            own = pa.array(sorted({digest_of(role, text) for _, role, text in pickle.loads(raw)}), pa.binary())
            at = pa.array([i] * len(own), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("conv_id", "part", "seq")], own], ["conv_id", "part", "seq", "digest"])


#: What a piece tells of itself, ways(from, to, cost, place of its edits in ASCII order among those from the same state), and the edits.
TOLD = "turns long, blank long, duplicate long, truncated long, illegal long, low long, high long, first_turn long, last_turn long, first_initial string, last_initial string"
WAYS = "array<struct<a:int,b:int,cost:int,place:int>>"


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in TOLD.split(", ")]
    for b in batches:
        made: list[tuple] = []
        for raw, seen in zip(b.column("piece").to_pylist(), b.column("seen").to_pylist()):
            turns = pickle.loads(raw)
            rows, count = judged(turns, set(seen or ()))
            ends = {to: ways(rows, [0 if q == to else inf for q in range(4)], range(4)) for to in range(4)}
            found, edits = [], []
            for q in range(4):
                own = sorted((ends[to][q][1], to, ends[to][q][0]) for to in range(4) if ends[to][q][0] < inf)
                found += [{"a": q, "b": to, "cost": int(cost), "place": place} for place, (_, to, cost) in enumerate(own)]
                edits += [e for e, _, _ in own]
            known = [t[0] for t in turns if t[0] is not None]
            initials = [r[1] for r in rows]
            made.append((
                count["turns"], count["blank"], count["duplicate"], count["truncated"], count["illegal"], min(known, default=None), max(known, default=None),
                known[0] if known else None, known[-1] if known else None, initials[0] if rows else None, initials[-1] if rows else None, found, edits,
            ))
        kinds = [*[pa.int64()] * 9, pa.string(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int32()), ("place", pa.int32())])), pa.list_(pa.string())]
        columns_ = [pa.array(c, k) for c, k in zip(zip(*made), kinds)] if made else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv_id", "part", "seq", "piece")], *columns_], ["conv_id", "part", "seq", "piece", *names, "ways", "edits"])


def chosen(kind: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """A conversation's pieces (some numbers each), put together: the state in which each is entered and left, and the counts."""

    def run(group: pa.Table) -> pa.Table:
        pieces = sorted(group.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        after = [[float(INSERT * len(c)) for c in CLOSING]]
        for p in reversed(pieces):
            after.append([min((w["cost"] + after[-1][w["b"]] for w in p["ways"] if w["a"] == q), default=inf) for q in range(4)])
        after.reverse()
        total = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        low, high, last_turn, last_initial, q, rows = None, None, None, None, START, []
        for i, p in enumerate(pieces):
            for c in total:
                total[c] += p[c]
            if p["low"] is not None:
                low, high = p["low"] if low is None else min(low, p["low"]), p["high"] if high is None else max(high, p["high"])
                total["turns"] -= p["first_turn"] == last_turn
                last_turn = p["last_turn"]
            if p["first_initial"] is not None:
                total["illegal"] += last_initial is not None and last_initial + p["first_initial"] not in LEGAL
                last_initial = p["last_initial"]
            best = min((w for w in p["ways"] if w["a"] == q and w["cost"] + after[i + 1][w["b"]] == after[i][q]), key=lambda w: w["place"])
            rows.append({"part": p["part"], "seq": p["seq"], "way": p["ways"].index(best), "entered": q, "closing": CLOSING[best["b"]] if i == len(pieces) - 1 else "", "left": best["b"]})
            q = best["b"]
        for r in rows:
            r |= {"conv_id": pieces[0]["conv_id"], "gaps": 0 if low is None else high - low + 1 - total["turns"], "cost": int(after[0][START])} | {c: total[c] for c in COUNTS[1:5]}
        kinds = {"conv_id": kind, "part": pa.int32(), "seq": pa.int32(), "way": pa.int32(), "entered": pa.int32(), "left": pa.int32(), "closing": pa.string()} | {c: pa.int64() for c in COUNTS}
        return pa.table({c: pa.array([r[c] for r in rows], k) for c, k in kinds.items()})

    return run


def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen edits of every piece and the bytes that they leave."""
    for b in batches:
        edits, data = [], []
        for raw, all_, way, entered, left, closing in zip(*(b.column(c).to_pylist() for c in ("piece", "edits", "way", "entered", "left", "closing"))):
            turns = [t[1:] for t in pickle.loads(raw)]
            kept = [*spelled(all_[way], turns, entered), *spelled(closing, [], left)]
            edits.append(all_[way] + closing)
            data.append("".join(f"\n{x}" for x in kept).encode("utf-8", "surrogatepass"))
        names = ["conv_id", "part", "seq", *COUNTS]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(edits, pa.string()), pa.array(data, pa.binary())], [*names, "edits", "data"])


def joined(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted pieces of conversations: their edits in a row, and the digest over what they leave, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edits, hashed, empty = None, [], hashlib.sha256(), True

        def done() -> pa.RecordBatch:
            values = [*now[0], "".join(edits), hashed.hexdigest()]
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["conv_id", *[c.split()[0] for c in RESULT.split(", ")]])

        for b in batches:
            for r in b.to_pylist():
                if now is None or now[0][0] != r["conv_id"]:
                    if now is not None:
                        yield done()
                    now, edits, hashed, empty = ((r["conv_id"], *[r[c] for c in COUNTS]),), [], hashlib.sha256(), True
                edits.append(r["edits"])
                hashed.update(r["data"][1:] if empty else r["data"])
                empty &= not r["data"]
        if now is not None:
            yield done()

    return run


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """conv_id and, of its rows, gaps between turns, blank, duplicate and truncated rows, illegal neighbours, the cost of the cheapest repair, its
    edits' initials and the SHA-256 of the repaired role:text lines. Rows whose present_col is false only name their conversation."""
    spark = conversations.sparkSession
    named = {"conv_id": id_col, "turn": turn_col, "role": role_col, "text": text_col} | ({"present": present_col} if present_col else {})
    rows = columns(conversations, **named)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), (F.coalesce("present", F.lit(False)) if present_col else F.lit(True)).alias("present"))
    # Equal rows alone can't be told apart by the range; the beginning of a text keeps long ones out of its sample.
    ranged = rows.repartitionByRange(partitions(spark), "conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    arrow = to_arrow_type(rows.schema["conv_id"].dataType)
    scan = stored(ranged.mapInArrow(scanned(arrow), f"conv_id {id_type}, {RESULT}, part int, seq int, piece binary"), "conversations")
    whole = scan.where("piece is null").drop("part", "seq", "piece")
    pieces = scan.where("piece is not null").select("conv_id", "part", "seq", "piece")
    digests = pieces.mapInArrow(firsts, f"conv_id {id_type}, part int, seq int, digest binary")
    again = digests.groupBy("conv_id", "digest").agg(F.array_sort(F.collect_list(F.struct("part", "seq"))).alias("at")).where("size(at) > 1")
    again = again.select("conv_id", "digest", F.explode(F.slice("at", F.lit(2), F.size("at"))).alias("at")).groupBy("conv_id", "at").agg(F.collect_list("digest").alias("seen"))
    again = again.select(F.col("conv_id").alias("c"), F.col("at.part").alias("p"), F.col("at.seq").alias("s"), "seen")
    both = pieces.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")), "left")
    parts = stored(both.select("conv_id", "part", "seq", "piece", "seen").mapInArrow(told, f"conv_id {id_type}, part int, seq int, piece binary, {TOLD}, ways {WAYS}, edits array<string>"), "pieces")
    path = parts.drop("piece", "edits").groupBy("conv_id").applyInArrow(chosen(arrow), f"conv_id {id_type}, part int, seq int, way int, entered int, left int, closing string, " + ", ".join(f"{c} long" for c in COUNTS))
    path = path.withColumnsRenamed({"conv_id": "c", "part": "p", "seq": "s"})
    way = parts.select("conv_id", "part", "seq", "piece", "edits").join(path, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).drop("c", "p", "s")
    spelt = way.mapInArrow(written, f"conv_id {id_type}, part int, seq int, " + ", ".join(f"{c} long" for c in COUNTS) + ", edits string, data binary")
    dealt = spelt.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.unionByName(dealt.mapInArrow(joined(arrow), f"conv_id {id_type}, {RESULT}"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations as a keyed draw of conversation and turn harms them: rows dropped (present is false), emptied, without ends, repeated, or the user's."""
    rows = columns(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("draw"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return drawn.select("*", copies).select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("draw") != 0).alias("present"))
