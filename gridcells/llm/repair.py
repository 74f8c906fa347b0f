"""Conversation structure repair by rank-convergence parallel Viterbi (operator 11).

The roles of a conversation should read, by their initials, ``(s?(ua)+)?``: nothing, or
user and assistant in turn, maybe after one system row. Edits are Keep (0), Rerole to user
or assistant (1), Delete (2, required for blank and duplicate rows) and Insert (5, an empty
row); a truncated row that stays costs 5 more. The cheapest edits are found, of several the
ones whose initials, the audit, come first in ASCII.

A row is one of sixteen symbols (initial, fault); what is still to be paid behind a row is
a vector of four costs, one for each state of the pattern (start, after s, u, a). Rows are
put in order in range partitions that may cut a conversation anywhere, and into chunks of
at most ``chunk_rows``, from each of which a task walks backwards:

1. every chunk starts from a speculative vector, that of a conversation's end;
2. fix-up passes rerun each chunk whose vector is not that of the chunk behind it, until
   it differs from the vector of the walk before by a constant, from where on nothing
   changes; passes go on until every chunk has started right;
3. where vectors do not converge (long stretches in which every row goes), after FIXUPS
   passes the chunks hand on what they do to each of the few vectors that there are up to
   a constant, and these maps are put together by pointer doubling;
4. the stitched costs drive the trace: chunks tell the state they end in for each of the
   four they may begin in, doubling again gives the one they do, and each writes its part
   of the audit, taking at each step the first letter that the costs allow.

Only chunks of conversations that were cut take part in 2 to 4 beyond one task, so nearly
all conversations take one pass. Texts are shuffled once, to the repaired rows.

Edge cases: a null role or text counts as one space; a null conv_id is a conversation; rows
without turn come first; ties of turn go by a digest of role and text, equal rows being
duplicates of the first; roles are told by their first character, so other words than
system, user and assistant may stand; a text is blank without a character other than
``[\\x20\\x09-\\x0D]``; texts of any length are read in the JVM and written whole; an empty
table gives no rows; further columns are not part of the result, whatever their names. A
copy of one row that makes up much of the table is counted before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.llm.batches import map_arrow, sql_crc32
from gridcells.runtime import shuffle_partitions, staged, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
CHUNK_ROWS, FIXUPS = 1 << 16, 4
INITIALS = "sua"
NONE, CUT, BLANK, COPY = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row that continues the alternation, from each state.
ONWARD = (USER, USER, ASSISTANT, USER)
#: The state after a row that stays as it is, by state and initial (s, u, a, other).
STAYS = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
LEGAL = {(0, 1), (1, 2), (2, 1)}
END = (0, 2 * INSERT, INSERT, 0)


def letters(code: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done to a row, in ASCII order."""
    initial, fault = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault in (NONE, CUT):
        more = TRUNCATED if fault == CUT else 0
        if STAYS[state][initial] is not None:
            out.append(("K", KEEP + more, STAYS[state][initial]))
        out.append(("R", REROLE + more, ONWARD[state]))
    return out


def back(costs: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """The vector before a row from that behind it, less its least cost, and that cost."""
    v = [min(c + costs[to] for _, c, to in letters(code, state)) for state in range(4)]
    for _ in range(3):  # rows may be inserted before it
        v = [min(v[s], INSERT + v[ONWARD[s]]) for s in range(4)]
    return tuple(c - min(v) for c in v), min(v)


@lru_cache(maxsize=1)
def vectors() -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """All vectors that occur, up to a constant, and the number of the one before a row
    by the number of the one behind it and the row's symbol. Number 0 is that of the end."""
    known, step = [END], []
    number = {END: 0}
    for v in known:
        row = []
        for code in range(16):
            new, _ = back(v, code)
            if new not in number:
                number[new] = len(known)
                known.append(new)
            row.append(number[new])
        step.append(row)
    return known, step


def walk(codes: bytes, behind: int) -> int:
    """The vector before a chunk from the one behind it."""
    _, step = vectors()
    for code in reversed(codes):
        behind = step[behind][code]
    return behind


def rerun(codes: bytes, behind: int, was: int, left: int) -> int:
    """As ``walk``, after a walk from ``was`` that ended in ``left``: where both differ
    by a constant the rest is known."""
    _, step = vectors()
    for code in reversed(codes):
        behind, was = step[behind][code], step[was][code]
        if behind == was:
            return left
    return behind


def walk_all(codes: bytes) -> list[int]:
    """``walk`` from every vector."""
    _, step = vectors()
    table = np.array(step, np.int32)
    at = np.arange(len(step))
    for code in reversed(codes):
        at = table[at, code]
    return at.tolist()


@lru_cache(maxsize=None)
def move(behind: int, code: int, state: int) -> tuple[str, str, int]:
    """Initials of the rows inserted before a row, its own letter, and the state after."""
    known, _ = vectors()
    inserted, (own, paid) = "", back(known[behind], code)
    while True:
        todo = {letter: to for letter, cost, to in letters(code, state) if cost + known[behind][to] == own[state] + paid}
        if "D" in todo or INSERT + own[ONWARD[state]] != own[state]:
            letter = min(todo)
            return inserted, letter, todo[letter]
        state = ONWARD[state]
        inserted += INITIALS[state - 1]


def trace(codes: bytes, behind: int, state: int) -> tuple[list[tuple[str, str, int]], int]:
    """The moves of a chunk's rows and the state after them."""
    _, step = vectors()
    after = [behind]
    for code in reversed(codes[1:]):
        after.append(step[after[-1]][code])
    moves = []
    for code, v in zip(codes, reversed(after), strict=True):
        moves.append(move(v, code, state))
        state = moves[-1][2]
    return moves, state


def tail(state: int) -> str:
    """Initials of the rows to insert at a conversation's end."""
    return {SYSTEM: "ua", USER: "a"}.get(state, "")


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, tie (digest of role and text), code without duplicates, and copies:
    equal rows of one turn as one."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    first = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), F.substring(role, 1, 1)).cast("int") - 1, F.lit(-1))
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), NONE).otherwise(CUT)
    thin = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), tie_of(role, text).alias("tie"), (F.when(first < 0, 3).otherwise(first) * 4 + fault).alias("code"))
    return thin.groupBy("conv_id", "turn", "tie", "code").agg(F.count("*").alias("copies"))


def tie_of(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


CHUNK = "id long, conv_id {conv}, more boolean, follows boolean, codes binary, spots array<int>, turns array<long>, ties array<binary>, lo long, hi long, n_turns long, front int"


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of the conversations in order, by part and place: their symbols, and the
    place, turn and tie of each row that may stay. ``front`` is the vector before the
    chunk from the speculative one; ``more`` and ``follows`` tell of further chunks of the
    conversation in the partition, after and before it."""
    thin = symbols(rows)
    # a first occurrence is told by a mark just before it; all other copies have none
    marks = thin.groupBy("conv_id", "tie").agg(F.min(F.struct("turn"))["turn"].alias("turn")).select("conv_id", "turn", "tie", F.lit(-1).alias("code"), F.lit(0).cast("long").alias("copies"))
    marked = staged(thin.unionByName(marks), "symbols")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "tie")]
    dealt = marked.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order, "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, n_chunks = TaskContext.get().partitionId(), 0
        ready: list[dict] = []
        now: dict | None = None
        mark = None

        def close(more: bool) -> None:
            nonlocal n_chunks
            codes = bytes(now["codes"])
            ready.append({**now, "id": part << 40 | n_chunks, "codes": codes, "more": more, "front": walk(codes, 0)})
            n_chunks += 1

        def begin(conv, follows: bool) -> dict:
            return {"conv_id": conv, "follows": follows, "codes": bytearray(), "spots": [], "turns": [], "ties": [], "lo": None, "hi": None, "n_turns": 0}

        def flush() -> dict:
            out = {k: [c[k] for c in ready] for k in ("id", "conv_id", "more", "follows", "codes", "spots", "turns", "ties", "lo", "hi", "n_turns", "front")}
            ready.clear()
            return out

        for batch in batches:
            for conv, turn, tie, code, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "tie", "code", "copies")), strict=True):
                if code < 0:
                    mark = (conv, turn, tie)
                    continue
                if now is not None and conv != now["conv_id"]:
                    close(False)
                    now = None
                now = now or begin(conv, False)
                first = mark == (conv, turn, tie)
                again = code if code % 4 == BLANK else code | COPY
                while copies:
                    if len(now["codes"]) >= chunk_rows:
                        close(True)
                        now = begin(conv, True)
                    if turn is not None and turn != now["hi"]:
                        now["lo"] = turn if now["lo"] is None else now["lo"]
                        now["hi"], now["n_turns"] = turn, now["n_turns"] + 1
                    if first and code % 4 in (NONE, CUT):
                        for k, v in (("spots", len(now["codes"])), ("turns", turn), ("ties", tie)):
                            now[k].append(v)
                        now["codes"].append(code)
                        copies -= 1
                    else:
                        n = min(copies, chunk_rows - len(now["codes"]))
                        now["codes"] += bytes([again]) * n
                        copies -= n
                    first = False
                if len(ready) >= 4096 or sum(len(c["codes"]) for c in ready[-2:]) >= chunk_rows:
                    yield flush()
        if now is not None:
            close(False)
        yield flush()

    return staged(map_arrow(dealt, run, CHUNK.format(conv=dict(rows.dtypes)["conv_id"])), "chunks")


def linked(found: DataFrame) -> DataFrame:
    """``found`` with next and prev, the chunks of the conversation after and before each.
    At the ends of a partition the driver looks: two rows of it for each partition."""
    spark = found.sparkSession
    part = F.shiftright("id", 40)
    ends = found.groupBy(part.alias("part")).agg(F.min(F.struct("id", "conv_id")).alias("a"), F.max(F.struct("id", "conv_id")).alias("z")).orderBy("part").collect()
    pairs = [(x["z"]["id"], y["a"]["id"]) for x, y in zip(ends, ends[1:]) if x["z"]["conv_id"] == y["a"]["conv_id"]]
    links = spark.createDataFrame(pairs, "own long, other long")
    # a row for each partition, at most
    out = found.join(F.broadcast(links), F.col("id") == F.col("own"), "left").withColumn("next", F.when(F.col("more"), F.col("id") + 1).otherwise(F.col("other"))).drop("own", "other")
    out = out.join(F.broadcast(links), F.col("id") == F.col("other"), "left").withColumn("prev", F.when(F.col("follows"), F.col("id") - 1).otherwise(F.col("own")))
    return out.drop("own", "other")


def composed(maps: DataFrame) -> DataFrame:
    """id, value: ``m`` of the row after ``m`` of the one it points ``to``, and so on
    to the one that points nowhere, from 0, by pointer doubling."""
    rows = staged(maps.select("id", "to", "m"), "maps")
    while not rows.where("to IS NOT NULL").isEmpty():
        beyond = rows.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("m").alias("inner"))
        both = rows.join(beyond, "to", "left")
        rows = staged(both.select("id", F.col("further").alias("to"), F.when(F.col("inner").isNull(), F.col("m")).otherwise(F.transform("inner", lambda x: F.get("m", x))).alias("m")), "maps")
    return rows.select("id", F.col("m")[0].alias("value"))


def stitched(split: DataFrame, fixups: int = FIXUPS) -> DataFrame:
    """id, next, prev, behind: the vector behind each chunk of the conversations that
    were cut."""
    codes = split.select("id", "codes")
    borders = staged(split.select("id", "next", "prev", F.lit(0).alias("behind"), "front"), "borders")
    for k in range(fixups + 1):
        there = borders.select(F.col("id").alias("next"), F.col("front").alias("want"))
        met = staged(borders.join(there, "next", "left").withColumn("want", F.coalesce("want", F.lit(0))), "met")
        wrong = met.where("want <> behind")
        if wrong.isEmpty():
            return met.select("id", "next", "prev", "behind")
        if k == fixups:
            break

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                d = batch.to_pydict()
                yield d | {"front": [rerun(*x) for x in zip(d["codes"], d["want"], d["behind"], d["front"], strict=True)], "behind": d["want"]}

        mended = map_arrow(wrong.join(codes, "id"), again, "id long, next long, prev long, behind int, front int")
        borders = staged(met.where("want = behind").drop("want").unionByName(mended), "borders")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            d = batch.to_pydict()
            yield {"id": d["id"], "to": d["next"], "m": [walk_all(c) for c in d["codes"]]}

    fronts = composed(map_arrow(split.select("id", "next", "codes"), every, "id long, to long, m array<int>"))
    there = fronts.select(F.col("id").alias("next"), F.col("value").alias("behind"))
    return split.select("id", "next", "prev").join(there, "next", "left").select("id", "next", "prev", F.coalesce("behind", F.lit(0)).alias("behind"))


def edits(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, fixups: int = FIXUPS) -> DataFrame:
    """A row for each chunk: conv_id, id (in order), audit, the counts of a report, and
    what becomes of the rows that may stay: turns, ties, and the letter (``done``) and
    inserted initials (``lead``) of each; ``rear`` is inserted at the end."""
    found = linked(chunks(rows, chunk_rows))
    split = found.where("next IS NOT NULL OR prev IS NOT NULL")
    whole = found.where("next IS NULL AND prev IS NULL").withColumns({"behind": F.lit(0), "state": F.lit(START), "before": F.lit(-1), "last_turn": F.lit(None).cast("long")})
    if not split.isEmpty():
        known = staged(stitched(split, fixups), "stitched")

        def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                d = batch.to_pydict()
                yield {"id": d["id"], "to": d["prev"], "m": [[trace(c, b, s)[1] for s in range(4)] for c, b in zip(d["codes"], d["behind"], strict=True)]}

        ends = composed(map_arrow(known.join(split.select("id", "codes"), "id"), exits, "id long, to long, m array<int>"))
        ahead = split.select(F.col("id").alias("prev"), F.conv(F.hex(F.substring("codes", -1, 1)), 16, 10).cast("int").alias("before"), F.col("hi").alias("last_turn"))
        ahead = ahead.join(ends.select(F.col("id").alias("prev"), F.col("value").alias("state")), "prev")
        part = split.join(known.select("id", "behind"), "id").join(ahead, "prev", "left")
        part = part.withColumns({"state": F.coalesce("state", F.lit(START)), "before": F.coalesce("before", F.lit(-1))})
        whole = whole.unionByName(part.select(whole.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            d = batch.to_pydict()
            out: dict[str, list] = {k: [] for k in ("audit", "blank", "duplicate", "truncated", "illegal", "cost", "n_turns", "done", "lead", "rear")}
            for codes, behind, state, before, nxt, spots, n_turns, lo, last in zip(*(d[k] for k in ("codes", "behind", "state", "before", "next", "spots", "n_turns", "lo", "last_turn")), strict=True):
                moves, state = trace(codes, behind, state)
                rear = tail(state) if nxt is None else ""
                audit = "".join("I" * len(lead) + letter for lead, letter, _ in moves) + "I" * len(rear)
                faults = [c % 4 for c in codes]
                initials = [c // 4 for c in ([before] if before >= 0 else [])] + [c // 4 for c in codes]
                stays = sum(f == CUT and m[1] != "D" for f, m in zip(faults, moves, strict=True))
                for k, v in (
                    ("audit", audit), ("blank", faults.count(BLANK)), ("duplicate", faults.count(COPY)), ("truncated", faults.count(CUT)),
                    ("illegal", sum(p not in LEGAL for p in zip(initials, initials[1:]))), ("n_turns", n_turns - (last is not None and last == lo)),
                    ("cost", REROLE * audit.count("R") + DELETE * audit.count("D") + INSERT * audit.count("I") + TRUNCATED * stays),
                    ("done", [moves[s][1] for s in spots]), ("lead", [moves[s][0] for s in spots]), ("rear", rear),
                ):
                    out[k].append(v)
            yield {k: d[k] for k in ("id", "conv_id", "turns", "ties", "lo", "hi")} | out

    conv = dict(rows.dtypes)["conv_id"]
    return staged(map_arrow(whole, run, f"id long, conv_id {conv}, audit string, blank long, duplicate long, truncated long, illegal long, cost long, lo long, hi long, n_turns long, turns array<long>, ties array<binary>, done array<string>, lead array<string>, rear string"), "edits")


def report(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows``: conv_id, gaps (turns missing between the
    first and the last), blank, duplicate, truncated, illegal (neighbours not su, ua or
    au), cost and audit."""
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "n_turns"]
    pieces = planned.select("conv_id", "lo", "hi", *counts, F.struct("id", "audit").alias("piece"))
    g = pieces.groupBy("conv_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in counts], F.sort_array(F.collect_list("piece")).alias("pieces"))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n_turns"), F.lit(0))
    return g.select("conv_id", gaps.alias("gaps"), *counts[:-1], F.array_join("pieces.audit", "").alias("audit"))


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows after repair, and those deleted: conv_id, turn (null if inserted), edit,
    role and text. A conversation is one stretch of a partition, in order; a task streams
    through it and holds one row."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    none = lambda t: F.lit(None).cast(t)
    own = rows.select("conv_id", F.lit(0).alias("rear"), F.col("turn").cast("long").alias("turn"), tie_of(role, text).alias("tie"), F.lit(1).alias("kind"), role.alias("role"), text.alias("text"))
    todo = planned.select("conv_id", F.explode(F.arrays_zip("turns", "ties", "done", "lead")).alias("e")).where("e.done <> 'D' OR e.lead <> ''")
    todo = todo.select("conv_id", F.lit(0).alias("rear"), F.col("e.turns").alias("turn"), F.col("e.ties").alias("tie"), F.lit(0).alias("kind"), F.col("e.done").alias("role"), F.col("e.lead").alias("text"))
    rear = planned.where("rear <> ''").select("conv_id", F.lit(1).alias("rear"), none("long").alias("turn"), none("binary").alias("tie"), F.lit(0).alias("kind"), F.lit("").alias("role"), F.col("rear").alias("text"))
    order = ["conv_id", "rear", "turn", "tie", "kind"]
    dealt = own.unionByName(todo).unionByName(rear).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pending: tuple | None = None
        # states of the pattern, to name the roles of Rerole
        state, current = START, object()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "turn", "edit", "role", "text")}

            def put(conv, turn, edit: str, name: str, text: str) -> None:
                for k, v in zip(out, (conv, turn, edit, name, text), strict=True):
                    out[k].append(v)

            names = {"s": "system", "u": "user", "a": "assistant"}
            for conv, rear, turn, tie, kind, role, text in zip(*(batch.column(c).to_pylist() for c in (*order, "role", "text")), strict=True):
                if conv != current:
                    state, current, pending = START, conv, None
                if not kind:
                    for x in text:
                        put(conv, None, "I", names[x], "")
                        state = ONWARD[state]
                    pending = None if rear else (turn, tie, role)
                    continue
                edit = pending[2] if pending and pending[:2] == (turn, tie) else "D"
                pending = None
                if edit == "K":
                    state = STAYS[state][INITIALS.find(role[:1])]
                elif edit == "R":
                    state = ONWARD[state]
                    role = names[INITIALS[state - 1]]
                put(conv, turn, edit, role, text)
            yield out

    return map_arrow(dealt, run, f"conv_id {dict(rows.dtypes)['conv_id']}, turn long, edit string, role string, text string")


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the rows ``role:text`` of each conversation, joined
    by newlines; ``lines`` as ``repaired`` leaves them. SHA-256 has no parallel form: it
    takes a conversation as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, sha, sep = None, None, b""
        for batch in batches:
            out: dict[str, list] = {"conv_id": [], "repaired_sha256": []}
            for own, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")), strict=True):
                if sha is None or own != conv:
                    if sha is not None:
                        out["conv_id"].append(conv)
                        out["repaired_sha256"].append(sha.hexdigest())
                    conv, sha, sep = own, hashlib.sha256(), b""
                if edit != "D":
                    sha.update(sep + f"{role}:{text}".encode())
                    sep = b"\n"
            yield out
        if sha is not None:
            yield {"conv_id": [conv], "repaired_sha256": [sha.hexdigest()]}

    return map_arrow(lines, run, f"conv_id {dict(lines.dtypes)['conv_id']}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the query: by CRC-32 of ``conv_id:turn`` mod 20, a row is dropped
    (0), its text emptied (1) or stripped of end marks (2), repeated (3), or given to the
    user (4). Nulls count as one space, but for the turn itself."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    times = F.array_repeat(F.lit(0), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("int"))
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(original)
    planned = edits(rows)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = lambda t: F.lit(None).cast(t)
    # conversations of no rows meet the others in one grouping
    told = report(rows, planned).withColumn("repaired_sha256", none("string"))
    hashed = digests(repaired(rows, planned)).select("conv_id", *[none("long").alias(c) for c in counts], none("string").alias("audit"), "repaired_sha256")
    every = original.select("conv_id").distinct().select("conv_id", *[none("long").alias(c) for c in counts], none("string").alias("audit"), none("string").alias("repaired_sha256"))
    g = told.unionByName(hashed).unionByName(every).groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.max("repaired_sha256").alias("h"))
    return g.select("conv_id", *counts, "audit", F.coalesce("h", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}


def _sql() -> str:
    """The same search forwards, row by row: of each state of the pattern the cheapest
    (cost, audit) and the rows so far."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    joined = lambda s, out: f"CASE WHEN {s}.o IS NULL THEN {out} ELSE {s}.o || chr(10) || {out} END"
    pack = lambda c, a, o: f"{{'c': ({c})::BIGINT, 'a': {a}, 'o': {o}}}"
    never = 10**9
    step = lambda s, cost, letter, out: pack(f"{s}.c + {cost}", f"{s}.a || '{letter}'", joined(s, out) if out else f"{s}.o")
    deleted = lambda s: step(s, DELETE, "D", None)
    stays = f"CASE f WHEN 'n' THEN 0 WHEN 't' THEN {TRUNCATED} ELSE {never} END"
    kept = lambda s, r: step(s, f"{stays} + CASE WHEN r = '{r}' THEN {KEEP} ELSE {never} END", "K", "role || ':' || text")
    named = lambda s, name: step(s, f"{stays} + {REROLE}", "R", f"'{name}:' || text")
    put = lambda s, name: step(s, INSERT, "I", f"'{name}:'")
    user = ", ".join(["s2", *(put(s, "user") for s in ("s0", "s1", "s3"))])
    closed = lambda frm: f"SELECT conv_id, i, s0, s1, s2, least(s3, {put('s2', 'assistant')}) AS s3 FROM (SELECT conv_id, i, s0, s1, least({user}) AS s2, s3 FROM {frm}) u"
    start = lambda c: pack(c, "''", "NULL::VARCHAR")
    row = f"""SELECT st.conv_id, f.i, {deleted("s0")} AS s0, least({deleted("s1")}, {kept("s0", "s")}) AS s1,
        least({deleted("s2")}, {", ".join(g(s, x) for s in ("s0", "s1", "s3") for g, x in ((kept, "u"), (named, "user")))}) AS s2,
        least({deleted("s3")}, {kept("s2", "a")}, {named("s2", "assistant")}) AS s3
      FROM st JOIN f ON st.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = st.i + 1"""
    return rf"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
dm AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
       unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), c) AS i,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS k FROM dm),
f AS (SELECT conv_id, i, turn, role, text, left(role, 1) AS r, CASE WHEN trim(text, {spaces}) = '' THEN 'b' WHEN k > 1 THEN 'd' WHEN right(rtrim(text, {spaces}), 1) IN ('.', '!', '?') THEN 'n' ELSE 't' END AS f FROM o),
st AS (
  SELECT * FROM ({closed(f"(SELECT conv_id, 0::BIGINT AS i, {start('0')} AS s0, {start(str(never))} AS s1, {start(str(never))} AS s2, {start(str(never))} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations) c) b")}) z
  UNION ALL SELECT * FROM ({closed(f"({row}) n")}) y),
nb AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM f),
g AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate,
      count(*) FILTER (WHERE f = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM nb GROUP BY conv_id),
best AS (SELECT st.conv_id, least(s0, s3) AS b, gaps, blank, duplicate, truncated, illegal FROM st LEFT JOIN g ON st.conv_id IS NOT DISTINCT FROM g.conv_id WHERE st.i = coalesce(n, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       b.c AS cost, b.a AS audit, sha256(coalesce(b.o, '')) AS repaired_sha256 FROM best
"""


SQL = {"op11_conversation_repair": _sql()}
