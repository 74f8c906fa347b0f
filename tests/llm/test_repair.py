import hashlib
import heapq
import random
import re
import zlib

import pytest

from gridcells.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least (cost, audit) and its rows, by search over (place, roles so far): rows are
    (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (at, state) in done:
            continue
        done.add((at, state))
        turn = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}
        heapq.heappush(heap, (cost + 5, audit + "I", at, turn, (*out, (name[turn], ""))))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, turn, (*out, (name[turn], text))))
        if role[:1] == turn or (role[:1] == "s" and state == ""):
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*out, (role, text))))


def brute(rows):
    """The report and the repaired rows of one conversation, in order."""
    told, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, set()
    faults = []
    for _, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = None
        if not text.strip(SPACES):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(SPACES)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            told[fault] += 1
        faults.append((role, text, fault))
    illegal = sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(faults, faults[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit, out = cheapest(faults)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return {"gaps": gaps, **told, "illegal": illegal, "cost": cost, "audit": audit, "sha": sha}, out


def conversations(rng, count, longest=12):
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["One.", "Two!", "Three?", "four", "", " \n", None, "five ", "Six. \n", "É!"]
    for conv in range(count):
        turn = 0
        for _ in range(rng.randrange(1, longest)):
            turn += rng.choice([1, 1, 1, 2, 3])
            yield (conv, turn, rng.choices(roles, [1, 6, 6, 1, 0.3, 0.3])[0], rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}{rng.choice(['.', '!', ''])}")


def check(spark, df, chunk_rows=R.CHUNK_ROWS, fixups=R.FIXUPS):
    planned = R.edits(df, chunk_rows, fixups)
    reports = {r["conv_id"]: r for r in R.report(df, planned).collect()}
    lines = R.repaired(df, planned)
    shas = {r["conv_id"]: r["repaired_sha256"] for r in R.digests(lines).collect()}
    by = {}
    # ties of a turn: equal rows next to each other (the tests have no other ties)
    for r in df.select("conv_id", "turn", "role", "text").collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    made = {}
    for r in lines.collect():
        made.setdefault(r["conv_id"], []).append(r)
    assert set(by) == set(reports) == set(shas)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        want, out = brute(rows)
        got = {k: reports[conv][k] for k in want if k != "sha"} | {"sha": shas[conv]}
        assert got == want, (rows, got, want)
        assert [(r["role"], r["text"]) for r in made[conv] if r["edit"] != "D"] == list(out)
        assert "".join(r["edit"] for r in made[conv] if r["edit"] != "D") == want["audit"].replace("D", "")


@pytest.mark.parametrize(("chunk_rows", "fixups"), [(R.CHUNK_ROWS, R.FIXUPS), (1, 100), (3, 100), (2, 0)])
def test_against_search(spark, chunk_rows, fixups):
    """Chunks of a row or a few, mended by passes or by maps alone."""
    rows = list(conversations(random.Random(chunk_rows), 60, 5 if chunk_rows == 1 else 9))
    check(spark, spark.createDataFrame(rows, SCHEMA), chunk_rows, fixups)


@pytest.mark.parametrize("fixups", [1, 10])
def test_long_conversations_over_partitions(spark, fixups):
    """Cut by range partitions, with stretches of rows that all go."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"t{t}" if 100 < t < 250 else f"T{t}.") for t in range(400)]
    rows += [(2, t, "user", "Same.") for t in range(300)] + [(3, t, "assistant", f"cut {t}") for t in range(200)] + [(4, 0, "user", "Hi."), (4, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, SCHEMA)
    check(spark, df, 20, fixups)
    found = R.linked(R.chunks(df, 1000))
    assert found.where("next IS NOT NULL").count() > 0  # cut by partitions alone


def test_vectors_are_few_and_speculation_converges():
    known, step = R.vectors()
    assert len(known) == len(step) < 40
    # two whole rows of different roles settle any vector
    good = bytes([4, 8, 4, 8, 4, 8])
    assert len(set(R.walk_all(good))) == 1
    assert len(set(R.walk_all(bytes([7] * 50)))) > 1  # rows that go settle nothing
    for v in range(len(known)):
        codes = bytes(random.Random(v).choices(range(16), k=30))
        assert R.walk(codes, v) == R.walk_all(codes)[v] == R.rerun(codes, v, 0, R.walk(codes, 0))


def test_odd_rows_and_columns(spark):
    rows = [(None, 1, "user", "A."), (None, None, "assistant", "B."), (5, None, None, None), (6, 2, "user", "x" * 1_000_000 + "."), (6, 3, "assistant", "Y!"), (6, 3, "assistant", "Y!"), (7, 1, "unit", "U."), (7, 2, "aide", "V.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' AS code", "'t' AS tie", "1 AS id", "'k' AS kind")
    check(spark, df)
    none = spark.createDataFrame([], SCHEMA)
    planned = R.edits(none)
    assert R.report(none, planned).count() == R.repaired(none, planned).count() == R.digests(R.repaired(none, planned)).count() == 0
    names = df.withColumn("conv_id", df.conv_id.cast("string"))
    assert {r["conv_id"] for r in R.report(names, R.edits(names)).collect()} == {None, "5", "6", "7"}


def test_many_copies_of_one_row(spark):
    rows = spark.range(30_000).selectExpr("1L AS conv_id", "3L AS turn", "'user' AS role", "'Hi.' AS text")
    got = R.report(rows, R.edits(rows, 1000)).first()
    assert (got["duplicate"], got["cost"], got["gaps"]) == (29_999, 2 * 30_000, 0) and got["audit"] == "D" * 30_000


def test_query_against_search(spark):
    original = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    by = {r["conv_id"]: [] for r in original.collect()}
    for r in sorted(original.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        h = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", r["text"]) if h == 2 else r["text"]
        by[r["conv_id"]] += [(r["turn"], "user" if h == 4 else r["role"], text)] * (0 if h == 0 else 2 if h == 3 else 1)
    got = R.op11_conversation_repair(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(by)
    for r in got:
        want, _ = brute(by[r["conv_id"]])
        assert {k: r["repaired_sha256" if k == "sha" else k] for k in want} == want
