"""Operator 12: conversation structure repair over a bidirectional DAG of tight arcs.

A conversation's rows, cut wherever its edits have got to in the grammar `(s?(ua)+)?` of role initials, are the
nodes of a DAG; keeping, changing the role of, deleting a row and inserting one are its arcs. Costs forward from the
start and backward from the end tell which arcs lie on a cheapest path (tight: both costs and the arc's sum to the
optimum); a walk over them takes the least letter at each step. Rows are sorted by range and packed in blocks of bounded size,
so that a conversation of any length is many blocks: (min, +) matrices carry the costs, and maps of states the walk, from
block to block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from wakelag.llm.common import kept, scratch

#: Costs of the edits; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of text of a block, at most (a longer text stands alone).
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
INF = 1 << 60
#: Where the output has got to: nothing yet, behind s, behind u, behind a. It may end in the first and last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (0, INF, INF, 0)
#: The state that a user or an assistant inserted or rewritten leads to, by state.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: The state that a kept row leads to, by its initial and the state; None: not allowed.
KEEP = {"s": (AFTER_S, None, None, None), "u": (AFTER_U, AFTER_U, None, AFTER_U), "a": (None, None, AFTER_A, None), "": (None,) * 4}
_INITIALS = ("s", "u", "a", "")
#: A row's code: its initial (other ones are ""), and whether it must go or is truncated.
GOES, CUT = 4, 8
_SPACE = " \t\n\v\f\r"


def arcs(code: int, count: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, state behind, cost) of the arcs over a row; a row that must go may stand for `count` such rows."""
    yield "D", state, DELETE * count
    if not code & GOES:
        more = TRUNCATED if code & CUT else 0
        if (to := KEEP[_INITIALS[code & 3]][state]) is not None:
            yield "K", to, more
        yield "R", NEXT[state], REROLE + more


_ARCS = {(code, state): list(arcs(code, 1, state)) for code in range(16) for state in range(4)}


def inserted(costs: list[int]) -> list[int]:
    """Forward costs at a place, with insertions there."""
    c = list(costs)
    c[AFTER_U] = min(c[AFTER_U], c[START] + INSERT, c[AFTER_S] + INSERT, c[AFTER_A] + INSERT)
    c[AFTER_A] = min(c[AFTER_A], c[AFTER_U] + INSERT)
    return c


def forward(costs: list[int], code: int, count: int) -> list[int]:
    """Costs behind a row from those before it."""
    out = [INF] * 4
    for state, held in enumerate(costs):
        if held < INF:
            for _, to, cost in _ARCS[code, state] if count == 1 else arcs(code, count, state):
                out[to] = min(out[to], held + cost)
    return inserted(out)


def backward(costs: list[int], code: int, count: int) -> list[int]:
    """Costs to the end from before a row, by those from behind it."""
    c = [min(costs[to] + cost for _, to, cost in (_ARCS[code, state] if count == 1 else arcs(code, count, state))) for state in range(4)]
    return before_inserting(c)


def before_inserting(c: list[int]) -> list[int]:
    u, a = min(c[AFTER_U], c[AFTER_A] + INSERT), min(c[AFTER_A], c[AFTER_U] + INSERT)
    return [min(c[START], u + INSERT), min(c[AFTER_S], u + INSERT), u, a]


def to_end(codes: bytes, counts: list[int], last: list[int]) -> list[list[int]]:
    """Backward costs before each row of a block and behind it."""
    out = [last]
    for code, count in zip(reversed(codes), reversed(counts), strict=True):
        out.append(backward(out[-1], code, count))
    return out[::-1]


def walk(codes: bytes, counts: list[int], first: list[int], last: list[int], entry: set[int], closing: bool) -> tuple[list[str], set[int]]:
    """The least letters over the tight arcs of a block, and the frontier behind it. first: forward costs before it;
    last: backward costs behind it; entry: the frontier before it, states reached by one and the same string.
    closing: nothing follows, so insertions at the end are the block's."""
    n, then = len(codes), to_end(codes, counts, last)
    best = min(f + b for f, b in zip(first, then[0], strict=True))
    costs, frontier, out, i = list(first), set(entry), [], 0
    while True:
        if i == n and (not closing or any(costs[q] == best and ENDS[q] == 0 for q in frontier)):
            return out, frontier
        steps: dict[str, set[int]] = {}
        for q in frontier:
            for letter, to, cost in (_ARCS[codes[i], q] if counts[i] == 1 else arcs(codes[i], counts[i], q)) if i < n else ():
                if costs[q] + cost + then[i + 1][to] == best:
                    steps.setdefault(letter, set()).add(to)
            if costs[q] + INSERT + then[i][NEXT[q]] == best:
                steps.setdefault("I", set()).add(NEXT[q])
        letter = min(steps)
        frontier = steps[letter]
        if letter == "I":
            out.append(letter)
        else:
            out.append(letter * counts[i])
            costs, i = forward(costs, codes[i], counts[i]), i + 1


def apply(letters: str, roles: list[str], texts: list[str], counts: list[int], state: int) -> tuple[list[str], list[str], int]:
    """Roles and texts of the rows that the letters leave, and the state behind them."""
    i = seen = 0
    out_roles, out_texts = [], []
    for letter in letters:
        if letter != "D":
            kept_row = letter == "K"
            state = KEEP[roles[i][:1]][state] if kept_row else NEXT[state]
            out_roles.append(roles[i] if kept_row else "user" if state == AFTER_U else "assistant")
            out_texts.append("" if letter == "I" else texts[i])
        if letter != "I":
            seen += 1
            if seen == counts[i]:
                i, seen = i + 1, 0
    return out_roles, out_texts, state


_STATS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns")


def _packed(kind: object) -> StructType:
    s = lambda n, t: StructField(n, t)
    return StructType([
        s("conv", kind), s("part", IntegerType()), s("seq", IntegerType()), s("roles", ArrayType(StringType())), s("texts", ArrayType(StringType())), s("codes", BinaryType()), s("counts", ArrayType(LongType())),
        *[s(n, LongType()) for n in _STATS], s("low_turn", LongType()), s("high_turn", LongType()), s("first_role", StringType()), s("last_role", StringType()),
    ])


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Block:
    """Rows of one conversation, in order, with what is counted over them."""

    def __init__(self, conv: object):
        self.conv, self.bytes, self.low, self.high = conv, 0, None, None
        self.roles, self.texts, self.codes, self.counts = [], [], bytearray(), []
        self.stats = dict.fromkeys(_STATS, 0)

    def add(self, turn: int | None, role: str, text: str, n: int, seen: bool) -> None:
        s = self.stats
        if turn is not None and turn != self.high:
            s["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        s["n_rows"] += n
        s["illegal"] += n - 1 + (bool(self.roles) and not legal(self.roles[-1][:1], role[:1]))
        bare = text.strip(_SPACE)
        again = n - (not seen) if bare else 0  # rows alike: only the first may be new
        s["blank"] += 0 if bare else n
        s["duplicate"] += again
        code = _INITIALS.index(role[:1] if role[:1] in ("s", "u", "a") else "")
        if bare and not seen:
            short = bare[-1] not in ".!?"
            s["truncated"] += short
            self._put(role, text, code | (CUT if short else 0), 1)
        if again or not bare:
            self._put(role, text, code | GOES, n if not bare else again)

    def _put(self, role: str, text: str, code: int, count: int) -> None:
        self.roles.append(role)
        self.texts.append("" if code & GOES else text)  # a row that goes needs none
        self.codes.append(code)
        self.counts.append(count)
        self.bytes += len(self.texts[-1])


def _pack(schema: StructType, block_rows: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the rows of a range, which are sorted; a range that begins inside a conversation begins with a block."""
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        done: list[_Block] = []
        block, number = None, 0

        def rows() -> pa.RecordBatch:
            nonlocal number
            out = [[b.conv for b in done], [part] * len(done), list(range(number, number + len(done))), [b.roles for b in done], [b.texts for b in done], [bytes(b.codes) for b in done], [b.counts for b in done]]
            out += [[b.stats[n] for b in done] for n in _STATS]
            out += [[b.low for b in done], [b.high for b in done], [b.roles[0][:1] if b.roles else None for b in done], [b.roles[-1][:1] if b.roles else None for b in done]]
            number += len(done)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for conv, turn, role, text, n, seen in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block is None or conv != block.conv or len(block.codes) >= block_rows or block.bytes >= block_bytes:
                    if block is not None:
                        done.append(block)
                        if len(done) >= 1000 or sum(b.bytes for b in done) >= block_bytes:
                            yield rows()
                            done = []
                    block = _Block(conv)
                if n:
                    block.add(turn, role, text, n, seen)
        if block is not None:
            done.append(block)
            yield rows()

    return run


def packed(df: DataFrame, key: str, turn: str, role: str, text: str, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the rows of each conversation in order. Rows alike are one row with a number, so that one that
    repeats without end is no group; a row is seen before if its role and text stand at an earlier turn."""
    kind = df.schema[key].dataType
    none = F.col("n") == 0
    d = df.select(F.col(key).alias("conv"), F.when(~none, F.col(turn).cast("long")).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), "n")
    d = d.withColumn("say", F.when(none, "").otherwise(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text").cast("binary"))))
    alike = d.groupBy("conv", "turn", "say").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("n").alias("n"))
    first = d.where(~none).groupBy("conv", "say").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_if(F.col("turn").isNull()).alias("nulls"))
    first = first.where("low < high OR nulls > 0 AND low IS NOT NULL").select(F.col("conv").alias("of"), F.col("say").alias("said"), F.when(F.col("nulls") == 0, F.col("low")).alias("turn_first"))
    d = alike.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("say") == F.col("said")), "left")
    d = d.withColumn("seen", F.col("said").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_first")))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("say")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "n", "seen")
    schema = _packed(kind)
    return kept(d.mapInArrow(_pack(schema, block_rows, block_bytes), schema), scratch(df.sparkSession, "conversations"))


_AT = ("conv", "part", "seq")


def entries(blocks: DataFrame) -> DataFrame:
    """For each block of a conversation of several: costs before (first) and behind it (last), the state before it (entry), and
    whether it is the last one (closing). What blocks need of each other is a matrix and four states each."""
    kind = blocks.schema["conv"].dataType
    at = [StructField("conv", kind), StructField("part", IntegerType()), StructField("seq", IntegerType())]
    longs, spark = ArrayType(LongType()), blocks.sparkSession
    many = blocks.groupBy("conv").count().where("count > 1").select(F.col("conv").alias("of"))
    several = blocks.select(*_AT, "codes", "counts").join(many, F.col("conv").eqNullSafe(F.col("of")), "left_semi")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, counts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                rows = [inserted([0 if q == state else INF for q in range(4)]) for state in range(4)]
                for code, count in zip(codes, counts, strict=True):
                    rows = [forward(r, code, count) for r in rows]
                out.append([x for r in rows for x in r])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*_AT, "codes", "counts", "matrix"])

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "seq"], ignore_index=True)
        now, first = inserted([0, INF, INF, INF]), []
        for m in pdf["matrix"]:
            first.append(now)
            now = [min(INF, *[now[a] + int(m[4 * a + b]) for a in range(4)]) for b in range(4)]
        then, last = before_inserting(list(ENDS)), []
        for m in reversed(pdf["matrix"].tolist()):
            last.append(then)
            then = [min(INF, *[int(m[4 * a + b]) + then[b] for b in range(4)]) for a in range(4)]
        return pdf[list(_AT)].assign(first=first, last=last[::-1], closing=[False] * (len(pdf) - 1) + [True])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, counts, first, last, closing in zip(*[batch.column(i).to_pylist() for i in range(3, 8)], strict=True):
                to = to_end(codes, counts, last)[0]
                best = min(f + b for f, b in zip(first, to, strict=True))
                out.append([min(walk(codes, counts, first, last, {q}, closing)[1]) if first[q] + to[q] == best else None for q in range(4)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *batch.columns[5:], pa.array(out, pa.list_(pa.int64()))], [*_AT, "first", "last", "closing", "exits"])

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "seq"], ignore_index=True)
        state, entry = START, []
        for e in pdf["exits"]:
            entry.append(state)
            state = int(e[state])
        return pdf.drop(columns="exits").assign(entry=entry)

    costs = [StructField("first", longs), StructField("last", longs), StructField("closing", BooleanType())]
    code = [StructField("codes", BinaryType()), StructField("counts", longs)]
    made = kept(several.mapInArrow(matrices, StructType([*at, *code, StructField("matrix", longs)])), scratch(spark, "matrices"))
    found = made.drop("codes", "counts").groupBy("conv").applyInPandas(carried, StructType([*at, *costs]))
    found = _beside(made.select(*_AT, "codes", "counts"), found, "inner").mapInArrow(exits, StructType([*at, *costs, StructField("exits", longs)]))
    return found.groupBy("conv").applyInPandas(chained, StructType([*at, *costs, StructField("entry", IntegerType())]))


def _beside(blocks: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """The columns of blocks, then those that `more` has of the same block."""
    of = more.withColumnsRenamed({c: f"{c}_" for c in _AT})
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")) & (F.col("seq") == F.col("seq_"))
    return blocks.join(of, same, how).drop("conv_", "part_", "seq_")


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of repaired conversations, written: conv, part, seq (their order), whether it is the whole conversation, the least
    cost of all its edits, the block's letters, roles and texts, and what `summary` counts.

    df's column n says how often a row stands there; a row with 0 only names its conversation. Rows follow by turn (nulls first), those
    of a turn by a digest of role and text. Null roles and texts are one space, null ids one conversation. A row is blank without a character other than
    white space, else a duplicate where an earlier one has its role and text, else truncated where its last such character
    is none of .!?. Keeping costs 0, another role (user or assistant) 3, deleting 4, which blank and duplicate rows must be,
    inserting an empty user or assistant row 3, an undeleted truncated row 3 more; of the cheapest ways to role initials `(s?(ua)+)?` the one
    of the least letters (D, I, K, R) is taken. Other columns are not read. A conversation of more than block_rows rows or
    block_bytes of text is several blocks.
    """
    blocks = packed(df, key, turn, role, text, block_rows, block_bytes)
    rows = _beside(blocks, entries(blocks), "left")
    names = [*_AT, *_STATS, "low_turn", "high_turn", "first_role", "last_role"]
    schema = StructType([*[blocks.schema[c] for c in names], StructField("whole", BooleanType()), StructField("cost", LongType()), StructField("letters", StringType()), StructField("roles", ArrayType(StringType())), StructField("texts", ArrayType(StringType()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.names.index(c)).to_pylist()  # noqa: B023, E731
            out = []
            for roles, texts, codes, counts, first, last, closing, entry in zip(*map(get, ("roles", "texts", "codes", "counts", "first", "last", "closing", "entry")), strict=True):
                whole = entry is None
                if whole:
                    first, last, closing, entry = inserted([0, INF, INF, INF]), before_inserting(list(ENDS)), True, START
                letters = "".join(walk(codes, counts, first, last, {entry}, closing)[0])
                cost = min(f + b for f, b in zip(first, to_end(codes, counts, last)[0], strict=True))
                out.append((whole, cost, letters, *apply(letters, roles, texts, counts, entry)[:2]))
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in names], *made], schema.names)

    return kept(rows.mapInArrow(solve, schema), scratch(df.sparkSession, "repaired"))


def turns(blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    """The rows of repaired conversations: id, place (part, seq, n: their order), role, text."""
    rows = blocks.select(F.col("conv").alias(key), "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("n", "row"))
    return rows.select(key, F.struct("part", "seq", "n").alias("place"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def summary(blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit (all letters), repaired_sha256.

    A digest runs over a conversation's rows in order, so the blocks of one of several stream through one task, which holds one
    of them at a time, and the letters, which are one value of the result."""
    spell = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("high_turn") - F.col("low_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    counted = ("blank", "duplicate", "truncated", "illegal", "cost")
    alone = blocks.where("whole").select(F.col("conv").alias(key), gaps.alias("gaps"), *counted, F.col("letters").alias("audit"), F.sha2(spell.cast("binary"), 256).alias("repaired_sha256"))

    names = alone.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def row(x: dict) -> pa.RecordBatch:
            n = x["high"] - x["low"] + 1 - x["turns"] if x["high"] is not None else 0
            return pa.RecordBatch.from_arrays([pa.array([x["conv"]], kind), *[pa.array([v], pa.int64()) for v in (n, *[x[c] for c in counted])], pa.array(["".join(x["letters"])]), pa.array([x["sha"].hexdigest()])], names)

        for batch in batches:
            kind = batch.column(0).type
            for n in range(batch.num_rows):
                b = {c: v[0] for c, v in batch.slice(n, 1).to_pydict().items()}
                if now is None or now["conv"] != b["conv"]:
                    if now:
                        yield row(now)
                    now = {"conv": b["conv"], "sha": hashlib.sha256(), "letters": [], "low": None, "high": None, "role": None, "turns": 0, "begun": False} | dict.fromkeys(counted, 0)
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    now[c] += b[c]
                now["cost"] = b["cost"]
                if now["role"] is not None and b["first_role"] is not None:
                    now["illegal"] += not legal(now["role"], b["first_role"])
                now["role"] = now["role"] if b["last_role"] is None else b["last_role"]
                now["turns"] += b["turns"] - (b["low_turn"] is not None and b["low_turn"] == now["high"])
                now["low"] = b["low_turn"] if now["low"] is None else now["low"]
                now["high"] = now["high"] if b["high_turn"] is None else b["high_turn"]
                now["letters"].append(b["letters"])
                for r, t in zip(b["roles"], b["texts"], strict=True):
                    now["sha"].update(f"{chr(10) * now['begun']}{r}:{t}".encode())
                    now["begun"] = True
        if now:
            yield row(now)

    rest = blocks.where("NOT whole").repartition("conv").sortWithinPartitions(*_AT).select("conv", "blank", "duplicate", "truncated", "illegal", "turns", "low_turn", "high_turn", "first_role", "last_role", "cost", "letters", "roles", "texts")
    return alone.unionByName(rest.mapInArrow(run, alone.schema))


def damaged(df: DataFrame) -> DataFrame:
    """conversations with planted faults, by a checksum of `conv_id:turn`: n is 0 where a row is dropped, 2 where it stands twice."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return df.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def _oracle() -> str:
    add = lambda s, cost, letter: f"(printf('%09d', CAST({s}[1:9] AS INTEGER) + {cost}) || {s}[10:] || '{letter}')"
    least = lambda *x: f"least({', '.join(x)}, NULL)"
    go = lambda states, cost, letter: [add(s, cost, letter) for s in states]
    if_ = lambda ini, x: f"CASE WHEN NOT goes{f" AND ini = '{ini}'" if ini else ''} THEN {x} END"
    t = "CASE WHEN cut THEN 3 ELSE 0 END"
    n0, n1 = add("q0", 4, "D"), least(add("q1", 4, "D"), if_("s", add("q0", t, "K")))
    n2 = least(add("q2", 4, "D"), if_("u", least(*go(("q0", "q1", "q3"), t, "K"))), if_("", least(*go(("q0", "q1", "q3"), f"3 + {t}", "R"))))
    n3 = least(add("q3", 4, "D"), if_("a", add("q2", t, "K")), if_("", add("q2", f"3 + {t}", "R")))
    c2 = least("n2", *go(("n0", "n1", "n3"), 3, "I"))
    return f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
d1 AS (SELECT *, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM d0, crc),
d2 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d1),
d3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text), copy) AS i, role[1:1] AS ini FROM d2),
d4 AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS two FROM d3),
d5 AS (SELECT *, blank OR again AS goes, NOT (blank OR again) AND open AS cut FROM d4),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM d5 GROUP BY conv_id),
s AS (SELECT conv_id, 0 AS i, '000000000' AS q0, CAST(NULL AS VARCHAR) AS q1, '000000003I' AS q2, '000000006II' AS q3 FROM c
 UNION ALL SELECT conv_id, i, n0, n1, c2, least(n3, {add("c2", 3, "I")}) FROM (SELECT *, {c2} AS c2 FROM (SELECT s.conv_id, d5.i, {n0} AS n0, {n1} AS n1, {n2} AS n2, {n3} AS n3 FROM s JOIN d5 ON s.conv_id IS NOT DISTINCT FROM d5.conv_id AND d5.i = s.i + 1))),
b AS (SELECT c.*, CAST(least(q0, q3)[1:9] AS BIGINT) AS cost, least(q0, q3)[10:] AS audit FROM c JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n),
l AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM b),
o AS (SELECT l.conv_id, p, audit[p] AS e, length(replace(audit[1:p], 'I', '')) AS i FROM l),
k AS (SELECT o.conv_id, p, e, role, ini, text, row_number() OVER w AS n, first_value(CASE WHEN e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER w AS lead FROM o LEFT JOIN d5 ON d5.conv_id IS NOT DISTINCT FROM o.conv_id AND d5.i = o.i WHERE e <> 'D' WINDOW w AS (PARTITION BY o.conv_id ORDER BY p)),
z AS (SELECT conv_id, string_agg((CASE WHEN e = 'K' THEN role WHEN (n - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN e = 'I' THEN '' ELSE text END), chr(10) ORDER BY p) AS said FROM k GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""


ORACLE = _oracle()
