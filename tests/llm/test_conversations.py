import hashlib
import re
import zlib
from functools import cache

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wakelag.llm import conversations as C, queries

GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, letters, repaired) of rows (role, text, fault): every string of letters by its cost, least first, until the initials fit.
    The state is the output's initials, cut to what the grammar needs of them."""

    @cache
    def go(i, s, lead):  # s: initials so far: '', 's', or the last one of u and a
        best = [(0, "", ())] if i == len(rows) and s in ("", "a") else []

        def more(cost, letter, j, initial, out):
            if initial is None or initial in {"": "su", "s": "u", "u": "a", "a": "u"}[s]:
                got = go(j, s if initial is None else initial, 0)
                if got:
                    best.append((cost + got[0], letter + got[1], (out, *got[2]) if out else got[2]))

        if i < len(rows):
            role, text, fault = rows[i]
            more(4, "D", i + 1, None, None)
            if fault in ("", "cut"):
                extra = 3 * (fault == "cut")
                if role[:1]:
                    more(extra, "K", i + 1, role[:1], f"{role}:{text}")
                for r in ("user", "assistant"):
                    more(3 + extra, "R", i + 1, r[0], f"{r}:{text}")
        if lead < 2:  # two insertions at a place are the most that help
            for r in ("user", "assistant"):
                if r[0] in {"": "su", "s": "u", "u": "a", "a": "u"}[s]:
                    got = go(i, r[0], lead + 1)
                    if got:
                        best.append((3 + got[0], "I" + got[1], (f"{r}:", *got[2])))
        return min(best) if best else None

    return go(0, "", 0)


def fault_of(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "again" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Rows (conv, turn, role, text, n) to the summary of each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, n in rows if c == conv for _ in range(n)]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{len(x[1])}:{x[1]}:{x[2]}".encode()).hexdigest()))
        faults = fault_of([x[1:] for x in mine])
        turns = [x[0] for x in mine if x[0] is not None]
        cost, audit, left = cheapest(tuple((r, x, f) for (_, r, x), f in zip(mine, faults)))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("again"), faults.count("cut"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


ROLE = st.sampled_from(["system", "user", "assistant", "tool", "usher", ""])
TEXT = st.sampled_from(["", " \t", "a.", "b", "c? \n", "é!"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=9))
def test_walk(rows):
    faults = fault_of(rows)
    codes = bytes(C._INITIALS.index(r[:1] if r[:1] in ("s", "u", "a") else "") | (C.GOES if f in ("blank", "again") else 0) | (C.CUT if f == "cut" else 0) for (r, _), f in zip(rows, faults))
    first, last, counts = C.inserted([0, C.INF, C.INF, C.INF]), C.before_inserting(list(C.ENDS)), [1] * len(rows)
    letters = "".join(C.walk(codes, counts, first, last, {C.START}, True)[0])
    cost = min(f + b for f, b in zip(first, C.to_end(codes, counts, last)[0]))
    roles, texts, _ = C.apply(letters, [r for r, _ in rows], [t for _, t in rows], counts, C.START)
    assert GOOD.fullmatch("".join(r[:1] for r in roles))
    assert (cost, letters, tuple(f"{r}:{t}" for r, t in zip(roles, texts))) == cheapest(tuple((r, t, f) for (r, t), f in zip(rows, faults)))


ROWS = [
    *[(1, n, ("system", "user", "assistant", "user", "user", "assistant")[n % 6], f"text {n}" + "." * (n % 3)) for n in range(40)],
    *[(2, n // 2, "user", "the same.", 3) for n in range(12)],  # rows alike, at several turns
    (3, None, "user", "null turn.", 1), (3, 4, None, None, 1), (3, None, "assistant", "a", 2), (3, 9, "user", "null turn.", 1),
    (4, 1, "user", "gone.", 0),
    (None, 2, "assistant", "no id.", 1), (None, 0, "user", "no id.", 1),
    (5, 0, "tool", "é.", 1), (5, 1, "user", "", 1), (5, 7, "user", "x" * 200_000, 1),
    (6, 0, "system", "alone.", 1),
    *[(7, 5, ("user", "assistant", "system")[n % 3], f"one turn {n}.", 1) for n in range(30)],
]
ROWS = [r if len(r) == 5 else (*r, 1) for r in ROWS]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long").withColumns({"say": F.lit(1), "seen": F.lit("clash"), "conv": F.lit(2), "part": F.lit(3)}).repartition(5)


@pytest.mark.parametrize("block_rows", [C.BLOCK_ROWS, 1, 3, 7])
def test_blocks_of_any_size(spark, block_rows):
    blocks = C.repair(frame(spark, ROWS), block_rows=block_rows)
    got = {r[0]: tuple(r[1:]) for r in C.summary(blocks).collect()}
    want = brute(ROWS)
    assert got == want
    assert blocks.count() == len(want) or block_rows < 100
    said = {}
    for r in C.turns(blocks).orderBy("place").collect():
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in said.items()} == {c: w[-1] for c, w in want.items() if c in said}
    assert all(GOOD.fullmatch("".join(x[0] for x in rows)) for rows in said.values())


def test_one_row_repeated_without_end(spark):
    """Rows alike are a number, and the letters of those that go a run."""
    got = C.summary(C.repair(frame(spark, [(1, 0, "user", "q?", 100_000), (1, 1, "assistant", "a.", 1)]))).first()
    assert (got["duplicate"], got["illegal"], got["cost"], got["audit"]) == (99_999, 99_999, 4 * 99_999, "K" + "D" * 99_999 + "K")


def test_a_long_conversation_is_many_blocks(spark):
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("CASE WHEN id % 7 = 3 THEN 'user' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.expr("CASE WHEN id % 5 = 0 THEN '' ELSE '.' END")).alias("text"), F.lit(1).cast("long").alias("n"))
    many, one = (C.repair(rows, block_rows=n) for n in (100, 10_000))
    assert many.count() >= 50 and not many.where("whole").count()
    assert C.summary(many).collect() == C.summary(one).collect()


def test_none(spark):
    assert C.summary(C.repair(frame(spark, ROWS).limit(0))).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (0, 1, 2, None) for t in (*range(30), None)] + [(3, 3, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r[0], r[1]): tuple(r[2:]) for r in C.damaged(d).collect()}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if text is None else text
        assert got[c, t] == ("user" if kind == 4 else role or " ", "" if kind == 1 else "One Two" if kind == 2 and text != " " else text, {0: 0, 3: 2}.get(kind, 1))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(map(tuple, queries.op12_conversation_repair(spark, sf).collect())) == sorted(con.execute(queries.oracle_sql()["op12_conversation_repair"]).fetchall())
