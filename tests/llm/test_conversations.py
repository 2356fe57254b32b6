"""Conversation repair against a search over all edits, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from spendlight.llm import conversations
from spendlight.llm.tables import table

DATA = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(turns, faults):
    """Cost, edits and repaired lines by a table of complete edits for every place and state, inserts in any order."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = [{} for _ in range(len(turns) + 1)]
    best[0][""] = (0, "", ())
    for i in range(len(turns) + 1):
        for _ in range(3):
            for state, (cost, edits, lines) in list(best[i].items()):
                for role in ("user", "assistant"):
                    end = follow.get((state, role[0]))
                    if end:
                        way = (cost + 2, edits + "I", (*lines, f"{role}:"))
                        best[i][end] = min(best[i].get(end, way), way, key=lambda w: w[:2])
        if i == len(turns):
            break
        role, text = turns[i]
        for state, (cost, edits, lines) in best[i].items():
            ways = [(state, (cost + 3, edits + "D", lines))]
            if faults[i] not in ("blank", "duplicate"):
                short = faults[i] == "truncated"
                if (state, role[:1]) in follow:
                    ways.append((follow[state, role[:1]], (cost + short, edits + "K", (*lines, f"{role}:{text}"))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in follow:
                        ways.append((follow[state, new[0]], (cost + 2 + short, edits + "R", (*lines, f"{new}:{text}"))))
            for end, way in ways:
                best[i + 1][end] = min(best[i + 1].get(end, way), way, key=lambda w: w[:2])
    return min((best[-1][s] for s in ("", "a") if s in best[-1]), key=lambda w: w[:2])


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in turns:
            bare = text.rstrip(BLANKS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = {r[1] for r in turns if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, edits, lines = cheapest([r[2:] for r in turns], faults)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha)
    return out


def made(spark, rows, tmp_path):
    folder = str(tmp_path / "rows")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return found(conversations.op13_conversation_repair(spark, folder))


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def some_rows(seed, convs, turns):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No", "Why? ", "", " \n", "Long text here.", "odd \x85", "é!", None, "a\nb."]
    return [(c, None if rng.random() < 0.05 else rng.randrange(turns * 2), rng.choice(roles), rng.choice(texts)) for c in range(convs) for _ in range(rng.randrange(turns))]


def test_repairs_against_all_edits(spark, tmp_path, monkeypatch):
    rows = some_rows(1, 300, 12)
    want = expected(rows)
    assert made(spark, rows, tmp_path) == want
    # the same over many small blocks
    for block in (1, 3):
        monkeypatch.setattr(conversations.repair, "__defaults__", (block, conversations.store))
        assert made(spark, rows, tmp_path / str(block)) == want


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(conversations.op13_conversation_repair(spark, DATA)) == expected(rows)


def test_sql_gives_the_same(tmp_path, spark):
    import duckdb

    rows = [r for r in some_rows(5, 60, 9) if None not in r]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = {r[0]: tuple(r[1:]) for r in connection.execute(conversations.ORACLE_SQL).fetchall()}
    assert got == expected(rows)


def test_odd_conversations(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (7000, None, "user", "Hi."), (7000, None, "user", "Hi."), (gone, 1, "user", "Gone."), (9000, 5, "system", "word. " * 200000)]
    got = made(spark, rows, tmp_path)
    assert got == expected(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert made(spark, [], tmp_path / "none") == {}


def test_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], SCHEMA)
    more = rows.withColumn("conv", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("kind", F.lit(9)).withColumn("a b", F.lit(0))
    repaired = conversations.repair(more)[3]
    assert [(r["edit"], r["role"], r["text"]) for r in repaired.orderBy("rank", "part").collect()] == [("K", "user", "Hi."), ("K", "assistant", "Ho.")]


def test_open_edits_stay_few():
    survivors = conversations.Survivors(conversations.NOTHING)
    rng = random.Random(2)
    most = 0
    for i in range(20000):
        letter = "ua"[i % 2] if rng.random() < 0.8 else rng.choice("sua")
        survivors.step(conversations.MOVES[letter, rng.choice((0, 0, 0, 0, 1, 2))])
        most = max(most, *(len(survivors.open_edits(s)) for s in survivors.live))
    assert most < 500
    assert len(survivors.done) > 19000


def test_deep_stems_are_let_go():
    """Edits that never coalesce are held, but each node has one parent and is counted once."""
    survivors = conversations.Survivors(conversations.NOTHING)
    for _ in range(3000):
        survivors.step(conversations.MOVES["u", 0])
    cost, state, tail = survivors.ended()
    edits = "".join(survivors.done) + "".join(survivors.open_edits(state)) + tail
    assert (cost, len(edits.replace("I", "").replace("J", ""))) == (3000, 3000)
