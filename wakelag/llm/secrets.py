"""Operator 3 (native): secret scan through a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query. The index holds, for the trigrams that the
queries name, the documents they occur in; intersecting postings leaves candidates, which the rule's
regular expression verifies. Rules without mandatory trigrams scan every text. All of it is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as C, _parser  # the standard library's own parse tree of a regular expression

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The kinds of the contract, in its order.
BASE = (
    Rule("assign", "(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)
#: Further kinds, by the public formats of their issuers.
EXTRA = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = (*BASE, *EXTRA)
#: Strings that one part of an expression may spell out before it counts as open.
MOST = 64


def _fold(code: int) -> str:
    c = chr(code)
    return c.lower() if c.isascii() else c


def _conj(strings: set[str]) -> list[frozenset[str]]:
    """As alternatives of sets of trigrams; [frozenset()] asks for nothing."""
    return _least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _least(dnf: list[frozenset[str]]) -> list[frozenset[str]]:
    out = {x for x in dnf if not any(y < x for y in dnf)}
    return sorted(out, key=sorted)


def _and(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    if len(a) * len(b) > MOST:  # weaker, still necessary
        return a if len(a) <= len(b) else b
    return _least([x | y for x in a for y in b])


def _walk(items) -> tuple[set[str] | None, list[frozenset[str]]]:
    """What a sequence of parsed items spells out (None: too much or open), and its trigram query."""
    query: list[frozenset[str]] = [frozenset()]
    run: set[str] = {""}
    open_ = False
    for op, arg in items:
        exact, own = _item(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a, b in product(run, exact)}
            continue
        query = _and(query, _conj(run))
        if exact is not None:
            run = exact
        else:
            query, run = _and(query, own), {""}
        open_ = True
    if open_:
        return None, _and(query, _conj(run))
    return run, _conj(run)


def _item(op, arg) -> tuple[set[str] | None, list[frozenset[str]]]:
    nothing = [frozenset()]
    if op is C.LITERAL:
        return {_fold(arg)}, nothing
    if op is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in arg):
        codes = [c for k, v in arg for c in ([v] if k is C.LITERAL else range(v[0], min(v[1], v[0] + MOST) + 1))]
        spelt = {_fold(c) for c in codes}
        return (spelt, nothing) if len(spelt) <= 4 else (None, nothing)
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST:
            return set().union(*(e for e, _ in parts)), nothing
        return None, _least([x for e, q in parts for x in (q if e is None else _conj(e))])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _walk(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, nothing
        return None, nothing if low == 0 else query if exact is None else _conj(exact)
    if op is C.AT:
        return {""}, nothing
    return None, nothing


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that all occur in any match; [] never arises, and
    an empty set among them means that the rule has no mandatory trigram and must scan fully."""
    exact, query = _walk(_parser.parse(pattern))
    query = query if exact is None else _conj(exact)
    return [frozenset()] if frozenset() in query else query


def folded(text: Column) -> Column:
    """Lower-case A-Z only, as the queries are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(keyed: DataFrame, trigrams: list[str], key: str = "key", text: str = "text") -> DataFrame:
    """The inverted index over the named trigrams: one row (trigram, key) for each that a text holds."""
    low = F.col("low")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return keyed.select(key, folded(F.col(text)).alias("low")).select(F.explode(held).alias("trigram"), key)


def candidates(index: DataFrame, rules: tuple[Rule, ...], key: str = "key") -> DataFrame:
    """Keys whose postings meet a rule's trigram query, with the kinds in question. The queries' table is
    as large as the rules, so it is broadcast; counts are summed before the shuffle by key."""
    terms = [(r.kind, n, len(q), t) for r in rules for n, q in enumerate(trigram_query(r.pattern)) for t in q]
    asked = index.sparkSession.createDataFrame(terms, "kind string, alternative int, needed int, trigram string")
    met = index.join(F.broadcast(asked), "trigram").groupBy(key, "kind", "alternative", "needed").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = needed").groupBy(key).agg(F.collect_set("kind").alias("kinds"))


#: Gaps and matches of a text that are walked through at a time: a span is added to a list of as many at most.
PARTS = 4096


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array of int what `step` makes of 0 and all values before it. By blocks as long as their number: n values take n * sqrt(n)
    short steps and no copies of what is done."""
    upto = lambda x, n: F.aggregate(F.slice(x, 1, n), F.lit(0), step)

    def blocks(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / width).cast("int") - 1), lambda k: F.slice(x, k * width + 1, width))
        return F.when(F.size(x) == 0, F.array().cast("array<array<int>>")).otherwise(cut)

    def sums(cut: Column) -> Column:
        whole = F.transform(cut, lambda x: F.aggregate(x, F.lit(0), step))
        one = lambda x, base: F.transform(x, lambda v, j: step(base, upto(x, j)))
        return let(whole, lambda w: F.flatten(F.transform(cut, lambda x, k: let(upto(w, k), lambda base: one(x, base)))))

    return let(values, lambda x: let(blocks(x), sums))


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end, kind) of the rule's leftmost non-overlapping matches, in code points.

    The text falls into gaps and matches; running lengths give positions. Matches that fail `least` still
    use up their characters.
    """
    pattern = rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.zip_with(gaps, F.zip_with(found, value, lambda a, b: F.struct(F.length(a).alias("n"), F.length(b).alias("v"))), lambda g, m: F.struct(g.alias("g"), m["n"].alias("n"), m["v"].alias("v")))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(acc: Column, p: Column) -> Column:
        start, end = acc["pos"] + p["g"], acc["pos"] + p["g"] + F.coalesce(p["n"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("pos"), F.when(p["v"] >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    walk = lambda parts, begin: F.aggregate(parts, F.struct(begin.alias("pos"), none.alias("spans")), step, lambda acc: acc["spans"])
    add = lambda a, p: a + p["g"] + F.coalesce(p["n"], F.lit(0))

    def by_parts(parts: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(parts) / PARTS).cast("int") - 1), lambda k: F.slice(parts, k * PARTS + 1, PARTS))
        sums = lambda cut: F.transform(cut, lambda x: F.aggregate(x, F.lit(0), add))
        each = lambda cut, sums: F.flatten(F.transform(cut, lambda x, k: walk(x, F.aggregate(F.slice(sums, 1, k), F.lit(0), lambda a, n: a + n))))
        return let(cut, lambda cut: let(sums(cut), lambda sums: each(cut, sums)))

    return let(parts, lambda parts: F.when(F.size(parts) <= PARTS, walk(parts, F.lit(0))).otherwise(by_parts(parts)))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, spans: str = "spans") -> DataFrame:
    """df with a column `spans` (or as named): array of (start, rank, end, kind), by start, then by the rules' order.

    Null text counts as empty. Rows may repeat and ids may be null or repeat: index entries are keyed by a
    hash of id and text, so a row is only ever verified too often, never too seldom. A column of df that
    is already named so is replaced; an empty table gives no rows.
    """
    hidden = ("__key", "__text", "__kinds")
    asked = [r for r in rules if trigram_query(r.pattern) != [frozenset()]]
    keyed = df.drop(spans).withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__key", F.xxhash64(F.col(key), F.col("__text")))
    trigrams = sorted({t for r in asked for q in trigram_query(r.pattern) for t in q})
    if asked:
        hits = candidates(postings(keyed, trigrams, "__key", "__text"), tuple(asked), "__key").withColumnRenamed("kinds", "__kinds")
        keyed = keyed.join(hits, "__key", "left")
    else:
        keyed = keyed.withColumn("__kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    each = [rule_spans(F.col("__text"), r, n) if r not in asked else F.when(F.array_contains("__kinds", r.kind), rule_spans(F.col("__text"), r, n)).otherwise(none) for n, r in enumerate(rules)]
    return keyed.withColumn(spans, F.array_sort(F.concat(*each))).drop(*hidden)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: Code points of a block of a text that pieces are taken from.
BLOCK = 4096


def pieces(text: Column, ranges: Column) -> Column:
    """The texts of ranges (from, to: code points) of a text, which is cut into blocks once: no piece is looked for from its start."""

    def one(blocks: Column, r: Column) -> Column:
        first, last = F.shiftright(r["from"], 12), F.shiftright(r["to"] - 1, 12)
        at, upto = r["from"] - first * BLOCK, r["to"] - last * BLOCK
        inside = F.substring(blocks[first], at + 1, r["to"] - r["from"])
        over = F.concat(F.substring(blocks[first], at + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(blocks[last], F.lit(1), upto))
        return F.when(r["to"] <= r["from"], "").when(first == last, inside).otherwise(over)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: F.transform(ranges, lambda r: one(blocks, r)))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", spans: str = "spans") -> DataFrame:
    """`scan`'s rows with every span of the text replaced by `mark`, overlapping spans by one; null texts stay null."""
    whole = F.coalesce(F.col(text), F.lit(""))
    ends = F.transform(F.col(spans), lambda s: s["end"])
    between = lambda a, b: F.struct(a.alias("from"), b.alias("to"))

    def gaps(before: Column) -> Column:
        """What lies before each span that begins behind all earlier ones, and behind the last."""
        each = F.transform(F.col(spans), lambda s, i: between(before[i], s["start"]))
        return F.concat(F.filter(each, lambda g: g["to"] >= g["from"]), F.array(between(F.array_max(ends), F.length(whole))))

    clean = let(running(ends, lambda a, x: F.greatest(a, x)), lambda before: F.array_join(pieces(whole, gaps(before)), mark))
    return df.withColumn(text, F.when(F.size(spans) == 0, F.col(text)).otherwise(clean))


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of `scan`'s rows, one for one: counts of the base kinds, the checksum of their spans in
    code points, and all spans spelt out. Rows without spans have counts 0 and the checksum of the empty text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return scanned.select(
        key,
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def oracle(documents: str = "documents") -> str:
    """`digests(scan(...))` in DuckDB SQL: every rule scans every text."""
    cols, spans = [], []
    for n, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        cols += [f"regexp_extract_all(t, '{p}', 0) AS m{n}", f"regexp_extract_all(t, '{p}', {r.group}) AS v{n}", f"regexp_split_to_array(t, '{p}') AS g{n}"]
        gaps = f"coalesce(list_sum(list_transform(g{n}[1:i], lambda x: length(x))), 0)"
        before = f"coalesce(list_sum(list_transform(m{n}[1:i - 1], lambda x: length(x))), 0)"
        spans.append(
            f"list_transform(list_filter(range(1, len(m{n}) + 1), lambda i: length(v{n}[i]) >= {r.least}), lambda i: "
            f"{{'s': CAST({gaps} + {before} AS BIGINT), 'r': {n}, 'e': CAST({gaps} + {before} + length(m{n}[i]) AS BIGINT), 'k': '{r.kind}'}})"
        )
    text = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"CAST(len(list_filter(sp, lambda x: x.k = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {documents}), m AS (SELECT doc_id, {", ".join(cols)} FROM d), s AS (SELECT doc_id, list_sort(list_concat({", ".join(spans)})) AS sp FROM m)
SELECT doc_id, {counts}, sha256(coalesce({text.format(f"list_filter(sp, lambda x: x.r < {len(BASE)})")}, '')) AS base_sha256, coalesce({text.format("sp")}, '') AS spans FROM s"""
