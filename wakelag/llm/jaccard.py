"""Operator 6: n-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Equal sets form classes; their smallest ids stand for them. Candidates share a shingle of their prefixes
(a set's rarest shingles: two sets that reach the threshold can't differ in all of these). Candidates
meet in tiles of compatible sizes, where bit counts of hashed bitmaps bound their overlap from above;
what is left is settled by intersecting sorted arrays. Links join components. First each class is tried
with its best candidate only; the components that this gives spare the pairs inside them. Of any two
components that bitmaps can't keep apart the likeliest pair is tried next; where that fails, all classes
of the smaller component visit the larger one's tiles. So a large group of near copies sends about a row
a member and tile, never its pairs, and no two components with a link between them stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wakelag.llm.common import collect, drop, gathered, kept, mapped, scratch, small_batches, text_slices
from wakelag.llm.components import components

#: Bits of the smallest and largest bitmap; between, twice as many as a set has shingles, or
#: up to the next power of two.
LEAST_BITS, MOST_BITS = 256, 1 << 20
#: Rows of a sample of documents that tells common shingles; it only orders prefixes, any order is exact.
SAMPLE = 20_000
#: Documents of the sample that make a shingle common, and how many common shingles are kept.
COMMON, MOST_COMMON = 3, 1_000_000
#: Prefix shingles of a bucket, about; and of one step within a bucket.
BUCKET, STEP = 400_000, 4_000_000
#: Members of a group that make their component its host.
HOST = 8
#: Members of a side of a tile of bitmaps; shingles of a side of a tile of arrays, about.
TILE, TILE_SHINGLES = 1024, 400_000
#: Tasks that the rows of one shingle are dealt to where they meet what is known of it.
SPREAD = 16
#: Rows of a table of what is known that goes to every task instead.
LOOKUP = 20_000
#: Words whose hashes a worker keeps.
CACHE = 300_000
_PRIME = np.uint64(0x9E3779B185EBCA87)
_PACKED = np.dtype([("h", "<u8"), ("id", "<i8"), ("n", "<i4"), ("place", "<u2")])
_words: dict[bytes, int] = {}


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes (64 bits) of the word n-grams of text: A-Z lowered, words as in WORD."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > CACHE:
        _words.clear()
    get, out = _words.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    codes = np.array(out, dtype=np.uint64)
    n = min(size, len(codes))
    h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i]) * _PRIME
        h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def forget() -> None:
    """Clears the hashes that a worker keeps."""
    _words.clear()


def least_overlap(a, b, percent: int):
    """Shared shingles that sets of sizes a and b need at least."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(h: np.ndarray) -> bytes:
    """The leading bits of each hash give its place, so halving a bitmap joins neighbouring bits."""
    size = max(LEAST_BITS, min(MOST_BITS, 1 << max(0, 2 * len(h) - 1).bit_length()))
    bits = np.zeros(size, dtype=np.uint8)
    bits[(h >> np.uint64(65 - size.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def fold(rows: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) brought down to `size` bytes."""
    while rows.shape[1] > size:
        rows = np.packbits(np.unpackbits(rows, axis=1).reshape(len(rows), -1, 2).max(axis=2), axis=1)
    return rows


def prefix(h: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The first shingles of h, rare ones before common ones, of which a partner shares one at least; none
    where only an equal set could be a partner. common: hashes by rising order of use (sorted, with ranks)."""
    n = len(h)
    low, high = -(-percent * n // 100), n * 100 // percent
    if not n or low == high:
        return h[:0]
    length = n - low + 1
    keys, ranks = common
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[at] == h
        rare = h[~known]
        if len(rare) >= length:
            return rare[:length]
        often = h[known]
        return np.concatenate([rare, often[np.argsort(ranks[at[known]], kind="stable")][: length - len(rare)]])
    return h[:length]


def common_shingles(df: DataFrame, key: str, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of the shingles that the sample holds often: at most MOST_COMMON."""
    total = df.count()
    unit = 1 << 20
    share = unit if total <= SAMPLE else -(-SAMPLE * unit // total)
    picked = df.where(F.pmod(F.xxhash64(key), F.lit(unit)) < share).select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, "text"):
                found = [shingles(t, size) for t in piece.column(0).to_pylist()]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = mapped(picked, run, "h long, n long", forget).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    path = scratch(df.sparkSession, "common")
    got = kept(counts, path).orderBy(F.col("n").desc(), "h").limit(MOST_COMMON).toArrow()
    drop(df.sparkSession, path)
    h, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    ranks = np.empty(len(h), dtype=np.int64)
    ranks[np.lexsort((h, n))] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], ranks[order]


def profile(df: DataFrame, size: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, n, k1, k2, bits, prefix) of each row (id, text): set size, 128-bit digest, bitmap, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, "text"):
                sets = [shingles(t, size) for t in piece.column(1).to_pylist()]
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), dtype=np.int64).reshape(-1, 2)
                firsts = [prefix(h, percent, common) for h in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
                flat = np.concatenate(firsts).view(np.int64) if firsts else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([bitmap(h) for h in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["id", "n", "k1", "k2", "bits", "prefix"],
                )

    return mapped(df, run, "id long, n long, k1 long, k2 long, bits binary, prefix array<long>", forget)


def reach(n: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes (low, high) of the sets that may link with a set of size n whose first shared shingle stands
    at `place` of its order: no more than n - place shingles can be shared then."""
    n, left = n.astype(np.int64), n.astype(np.int64) - place
    return -(-percent * n // 100), (100 + percent) * left // percent - n


def matches(classes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(h, leader, id): the members but one of each prefix shingle that several classes share.

    Shingles travel packed by bucket, with the class's size and the shingle's place in its order. Members
    with no other of a size that they may link with are left out; what is left may have a partner. Within
    a bucket the first class seen of a shingle leads it; in a bucket that takes several steps later ones
    are passed on as they come, so a common shingle takes no more memory than a rare one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            lists = batch.column(2)
            h = lists.flatten().to_numpy().view(np.uint64)
            if not len(h):
                continue
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            place = np.arange(len(h)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            rows = np.empty(len(h), dtype=_PACKED)
            rows["h"], rows["id"], rows["n"], rows["place"] = h, batch.column(0).to_numpy()[owner], np.minimum(batch.column(1).to_numpy()[owner], 1 << 30), np.minimum(place, 65_535)
            bucket = ((h * _PRIME) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1))
            out = [(int(bucket[order[a]]), rows[order[a:b]].tobytes()) for a, b in zip(edges, [*edges[1:], len(order)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "rows"])

    def alone(r: np.ndarray) -> np.ndarray:
        """Which rows, sorted by (h, n), have no other row of their shingle in reach."""
        first = np.concatenate([[True], r["h"][1:] != r["h"][:-1]])
        base = np.cumsum(first).astype(np.int64) << 31
        low, high = reach(r["n"], r["place"], percent)
        key = base + r["n"]
        met = np.searchsorted(key, base + np.maximum(high, -1), side="right") - np.searchsorted(key, base + low)
        return met - ((r["n"] >= low) & (r["n"] <= high)) <= 0

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, leaders = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held: list[np.ndarray] = []
        n = 0

        def step(only: bool) -> Iterator[pa.RecordBatch]:
            nonlocal known, leaders, held, n
            r = np.concatenate(held)
            held, n = [], 0
            if only:  # all of the bucket is here
                r = r[np.lexsort((r["id"], r["n"], r["h"]))]
                r = r[~alone(r)]
            r = r[np.lexsort((r["id"], r["h"]))]
            h, ids = r["h"].copy(), r["id"].copy()
            if not len(h):
                return
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            lead = ids[heads]
            if len(known):
                at = np.minimum(np.searchsorted(known, h[heads]), len(known) - 1)
                old = known[at] == h[heads]
                lead = np.where(old, leaders[at], lead)
            else:
                old = np.zeros(len(heads), dtype=bool)
            mine = np.repeat(lead, np.diff([*heads, len(h)]))
            keep = mine != ids
            for a in range(0, len(h), 1 << 18):
                k = keep[a : a + (1 << 18)]
                if k.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 18)][k]) for x in (h.view(np.int64), mine, ids)], ["h", "leader", "id"])
            if not only:
                known = np.concatenate([known, h[heads][~old]])
                leaders = np.concatenate([leaders, lead[~old]])
                order = np.argsort(known)
                known, leaders = known[order], leaders[order]

        whole = True
        for batch in batches:
            for raw in batch.column(1):
                held.append(np.frombuffer(raw.as_buffer(), dtype=_PACKED).copy())
                n += len(held[-1])
                if n >= STEP:
                    whole = False
                    yield from step(False)
        if n:
            yield from step(whole)

    packed = mapped(classes.select("id", "n", "prefix"), pack, "bucket int, rows binary")
    return mapped(packed.repartition(buckets, "bucket"), group, "h long, leader long, id long")


def _room(na, nb, ba: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """The overlap at most: each bit of one bitmap that the other lacks is a shingle that is not shared."""
    less_a = np.bitwise_count(ba & ~bb).sum(axis=-1).astype(np.int64)
    less_b = np.bitwise_count(bb & ~ba).sum(axis=-1).astype(np.int64)
    return np.minimum(na - less_a, nb - less_b)


def _rows(raw: list[bytes]) -> np.ndarray:
    """Equally long bitmaps as rows of bytes."""
    return np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)


def rooms(na: np.ndarray, nb: np.ndarray, ba: list[bytes], bb: list[bytes]) -> np.ndarray:
    """_room of pairs whose bitmaps may differ in length."""
    la, lb = np.array([len(x) for x in ba]), np.array([len(x) for x in bb])
    out = np.zeros(len(na), dtype=np.int64)
    for x, y in {*zip(la.tolist(), lb.tolist(), strict=True)}:
        at = np.flatnonzero((la == x) & (lb == y))
        a, b = (fold(_rows([z[i] for i in at]), min(x, y)).view(np.uint64) for z in (ba, bb))
        out[at] = _room(na[at], nb[at], a, b)
    return out


def small(df: DataFrame) -> DataFrame:
    """df written as a table: joins with it know its size, and send it to every task only if it is small."""
    return kept(df, scratch(df.sparkSession, "small"))


def spread(rows: DataFrame, each: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows (keys, id, ...) joined to each, a written table with one row for a key that any number of rows may have.
    One of LOOKUP rows or fewer goes to every task; each row of a larger one stands in SPREAD tasks, and the rows
    are dealt to them. That one is never sent whole: estimates of its size don't count the copies."""
    if each.limit(LOOKUP + 1).count() <= LOOKUP:
        return rows.join(F.broadcast(each), keys, how)
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))
    return rows.withColumn("__s", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).join(each.withColumn("__s", places).hint("merge"), [*keys, "__s"], how).drop("__s")


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that sizes and bitmaps allow, with the shares they may reach at most."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                room = rooms(na, nb, batch.column(4).to_pylist(), batch.column(5).to_pylist())
                keep = room >= least_overlap(na, nb, percent)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(pa.array(keep)) for i in range(2)), pa.array((room / (na + nb - room))[keep])], ["a", "b", "most"])

    return mapped(both, run, "a long, b long, most double")


def arrays(df: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, set): the sorted shingle array of each row (id, text) whose id may be among ids (id).

    Texts stay where they are: a bitmap of the ids (16 bits an id, at most 8 MB) goes to the scan, which
    passes on the arrays of those that it may hold, each id's once a task however often its row repeats.
    """
    bits = 1 << max(12, min(26, int(16 * ids.count()).bit_length()))
    spot = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(spot.alias("spot")).selectExpr("spot div 64 AS w", "shiftleft(1L, CAST(spot % 64 AS INT)) AS x").groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    mask = np.zeros(bits // 64, dtype=np.int64)
    mask[words.column(0).to_numpy()] = words.column(1).to_numpy()
    mask = mask.view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()  # 16 bytes of text hash for each id that is passed on

        def fresh(id_: int, text: str | None) -> bool:
            key = (id_, xxhash.xxh128_digest((text or "").encode()))
            new = key not in seen
            seen.add(key)
            return new

        for batch in batches:
            at = batch.column(1).to_numpy().astype(np.uint64)
            asked = (mask[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(asked.astype(bool)))
            batch = batch.filter(pa.array([fresh(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_()))
            for piece in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([shingles(t, size).tobytes() for t in piece.column(2).to_pylist()], pa.binary())], ["id", "set"])

    return mapped(df.where("id is not null").withColumn("spot", spot).select("id", "spot", "text"), run, "id long, set binary", forget)


def verify(pairs: DataFrame, df: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by intersecting sorted arrays."""
    path = scratch(df.sparkSession, "asked")
    sets = arrays(df, kept(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), path), size)
    drop(df.sparkSession, path)
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "y"}), "b").select("a", "b", "x", "y")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [reaches(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], ["a", "b"])

    return mapped(both, test, "a long, b long")


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact test, on sorted arrays of distinct shingles."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return bool(len(x) and len(y)) and 100 * shared >= percent * (len(x) + len(y) - shared)


class _Side:
    """One side of a tile: sets in order of size, with bitmaps sharp enough to rule out most near misses."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.ids, self.sets, self.percent = [ids[i] for i in order], [sets[i] for i in order], percent
        self.n = np.array([len(s) for s in self.sets])
        self.shift = np.uint64(64 - max(8, min(17, int(8 * self.n.max() - 1).bit_length())))
        self.bits = np.stack([self.draw(s) for s in self.sets])

    def draw(self, h: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << (64 - int(self.shift)), dtype=np.uint8)
        bits[(h >> self.shift).astype(np.int64)] = 1
        return np.packbits(bits).view(np.uint64)

    def partners(self, h: np.ndarray, allowed: np.ndarray | None = None, own: np.ndarray | None = None) -> Iterator[int]:
        """Places of the sets that reach the threshold with h, the likeliest first; only sizes of h's band
        are looked at. allowed: may be narrowed by the caller as it goes."""
        n = len(h)
        low, high = np.searchsorted(self.n, -(-n * self.percent // 100)), np.searchsorted(self.n, n * 100 // self.percent, side="right")
        y = np.arange(low, high)
        if allowed is not None:
            y = y[allowed[y]]
        if not len(y):
            return
        room = _room(n, self.n[y], self.draw(h) if own is None else own, self.bits[y])
        keep = room >= least_overlap(n, self.n[y], self.percent)
        y, room = y[keep], room[keep]
        for k in y[np.argsort(-(room / (n + self.n[y] - room)), kind="stable")].tolist():
            if (allowed is None or allowed[k]) and reaches(h, self.sets[k], self.percent):
                yield k


def _tiles(df: DataFrame, keys: list[str], work, out: str = "a long, b long") -> DataFrame:
    """work(groups' rows as (role, id, label, set) lists) over the tiles of df, one tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, done = None, [], []

        def put() -> pa.RecordBatch:
            both = sorted(set(done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in both], pa.int64()) for i in range(2)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (*keys, "role", "id", "label", "set")]
            for *key, role, id_, label, raw in zip(*cols, strict=True):
                if key != now:
                    if rows:
                        done += work(rows)
                    now, rows = key, []
                rows.append((role, id_, label, np.frombuffer(raw, dtype=np.uint64)))
            if len(done) > 100_000:
                yield put()
        if rows:
            done += work(rows)
        if done:
            yield put()

    dealt = df.select(*keys, "role", "id", "label", "set").repartition(*keys).sortWithinPartitions(*keys, "role", "id")
    return mapped(dealt, run, out)


def band(n: Column, percent: int) -> Column:
    """Sets that may link stand in the same band of sizes or in neighbouring ones: a band is a little wider
    than the threshold lets sizes differ."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent * 1.0001)).cast("int")


def grid(left: DataFrame, right: DataFrame, key: str, percent: int, weight: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """left and right (key, id, n, ...) dealt to tiles (key, cell, i, j) in which they meet.

    A cell is a band of left's sizes; right's rows go to the cells next to theirs too. Each side of a cell is
    cut into pieces of about `most` of `weight` by a hash of the id, and every piece of the left meets every
    piece of the right: a tile holds one of each, whatever the sides hold.
    """
    low = band(F.col("n"), percent)
    left, right = left.withColumn("cell", low), right.withColumn("cell", F.explode(F.array(low - 1, low, low + 1)))
    count = lambda d, to: d.groupBy(key, "cell").agg(F.greatest(F.ceil(F.sum(weight) / most), F.lit(1)).cast("int").alias(to))
    sizes = small(count(left, "rows_").join(count(right, "columns_"), [key, "cell"]))  # a row a cell
    piece = lambda many: F.pmod(F.xxhash64("id", F.lit(1)), F.col(many)).cast("int")
    all_ = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    left = spread(left, sizes, [key, "cell"]).withColumn("i", piece("rows_")).withColumn("j", all_("columns_"))
    right = spread(right, sizes, [key, "cell"]).withColumn("j", piece("columns_")).withColumn("i", all_("rows_"))
    return left.drop("rows_", "columns_"), right.drop("rows_", "columns_")


def guests(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between guests (id, host, n) and the members (host, id, n) of the components they visit:
    one for each guest and tile at most. Both stand in tiles by their band of sizes and a hash of the id."""
    own, come = grid(members.select("host", "id", "n"), pairs.select("host", "id", "n"), "host", percent, F.col("n"), TILE_SHINGLES)
    role = lambda d, x: d.select("host", "cell", "i", "j", F.lit(x).alias("role"), "id", F.lit(0).cast("long").alias("label"))

    def work(rows: list) -> list[tuple[int, int]]:
        own = [r for r in rows if r[0] == 0]
        if not own or len(own) == len(rows):
            return []
        side = _Side([r[1] for r in own], [r[3] for r in own], percent)
        return [(r[1], side.ids[k]) for r in rows[len(own) :] for k in [next(side.partners(r[3]), None)] if k is not None]

    return _tiles(role(own, 0).unionByName(role(come, 1)).join(sets, "id"), ["host", "cell", "i", "j"], work)


_TILED = ("h", "cell", "i", "j", "side", "id", "n", "bits", "label")
#: Added to the number of a tile's column where its sides are two kinds of rows.
_CROSSED = 1 << 30


def group_tiles(groups: DataFrame, percent: int, tile: int | None = None) -> DataFrame:
    """Rows of tiles for groups (h, id, n, bits, label): in each band of sizes all pieces of about `tile`
    members against each other, and against those of the band below."""
    tile = tile or TILE
    d = groups.withColumn("cell", band(F.col("n"), percent))
    many = small(d.groupBy("h", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("many")))
    below = many.select("h", (F.col("cell") + 1).alias("cell"), F.col("many").alias("under"))
    above = many.select("h", (F.col("cell") - 1).alias("cell"), F.col("many").alias("over"))
    known = small(many.join(below, ["h", "cell"], "left").join(above, ["h", "cell"], "left"))
    d = spread(d, known, ["h", "cell"])
    d = d.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(1)), F.col("many")).cast("int"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    same = d.withColumn("other", numbers("many")).withColumns({"i": F.least("piece", "other"), "j": F.greatest("piece", "other"), "side": F.col("piece")})
    upper = d.where("under IS NOT NULL").withColumn("other", numbers("under")).withColumns({"i": F.col("piece"), "j": F.col("other") + _CROSSED, "side": F.lit(0)})
    lower = d.where("over IS NOT NULL").withColumn("i", numbers("over")).withColumns({"j": F.col("piece") + _CROSSED, "side": F.lit(1), "cell": F.col("cell") + 1})
    return same.select(*_TILED).unionByName(upper.select(*_TILED)).unionByName(lower.select(*_TILED))


def host_tiles(lodged: DataFrame, visits: DataFrame, percent: int, tile: int | None = None) -> DataFrame:
    """Rows of tiles for components (host, id, n, bits) and their visitors (host, id, n, bits, label)."""
    own, come = grid(lodged, visits, "host", percent, F.lit(1), tile or TILE)
    rows = own.withColumns({"side": F.lit(0), "label": F.col("host")}).unionByName(come.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn("h", F.col("host")).withColumn("j", F.col("j") + _CROSSED).select(*_TILED)


def rivals(tiled: DataFrame, percent: int) -> DataFrame:
    """(p, q, a, b, most): for each tile and pair of labels p < q the two rows that may overlap most, if
    sizes and bitmaps allow a link at all. Where a tile has two sides, only rows of different sides meet."""
    dealt = tiled.repartition("h", "cell", "i", "j").sortWithinPartitions("h", "cell", "i", "j", "n", "id")

    def best(t: dict[str, np.ndarray]) -> list[tuple]:
        n, ids, label, side, found = t["n"], t["id"], t["label"], t["side"], {}
        crossed = t["i"][0] != t["j"][0]
        length = np.array([len(x) for x in t["bits"]])  # rises with n
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            begin, stop = own[0], np.searchsorted(n, n[own[-1]] * 100 // percent, side="right")
            bits = np.concatenate([fold(_rows(list(t["bits"][begin:stop][length[begin:stop] == x])), size) for x in np.unique(length[begin:stop])]).view(np.uint64)
            for x in own:
                y = np.arange(x + 1, np.searchsorted(n, n[x] * 100 // percent, side="right"))  # the band of sizes that fit
                y = y[(label[y] != label[x]) & ((side[y] != side[x]) | (not crossed))]
                if not len(y):
                    continue
                room = _room(n[x], n[y], bits[x - begin], bits[y - begin])
                keep = room >= least_overlap(n[x], n[y], percent)
                y, room = y[keep], room[keep]
                most = room / (n[x] + n[y] - room)
                order = np.argsort(-most, kind="stable")
                for k in order[np.unique(label[y][order], return_index=True)[1]]:
                    key = (min(label[x], label[y[k]]), max(label[x], label[y[k]]))
                    if key not in found or found[key][0] < most[k]:
                        found[key] = (most[k], min(ids[x], ids[y[k]]), max(ids[x], ids[y[k]]))
        return [(*key, a, b, m) for key, (m, a, b) in found.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        done: list[tuple] = []

        def put() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(np.array(c, dtype=np.int64)) for c in cols[:4]], pa.array(np.array(cols[4], dtype=np.float64))], ["p", "q", "a", "b", "most"])

        def all_(t: dict[str, np.ndarray], final: bool) -> dict[str, np.ndarray] | None:
            new = np.flatnonzero(np.concatenate([[True], (t["h"][1:] != t["h"][:-1]) | (t["cell"][1:] != t["cell"][:-1]) | (t["i"][1:] != t["i"][:-1]) | (t["j"][1:] != t["j"][:-1])]))
            ends = [*new[1:], len(t["h"])]
            for a, b in zip(new if final else new[:-1], ends if final else ends[:-1], strict=True):
                done.extend(best({k: v[a:b] for k, v in t.items()}))
            return None if final else {k: v[new[-1] :] for k, v in t.items()}

        for batch in batches:
            if not batch.num_rows:
                continue
            t = {k: batch.column(k).to_numpy() for k in ("h", "cell", "i", "j", "side", "id", "n", "label")} | {"bits": np.array([*batch.column("bits").to_pylist(), None], dtype=object)[:-1]}
            held = all_(t if held is None else {k: np.concatenate([held[k], v]) for k, v in t.items()}, False)
            if len(done) > 100_000:
                yield put()
        if held is not None:
            all_(held, True)
        if done:
            yield put()

    return mapped(dealt, run, "p long, q long, a long, b long, most double")


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) with the components that links (a, b) between ids join as well."""
    if links.isEmpty():
        return labels
    over = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("p")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("label").alias("q")), "b", "left")
    over = components(over.select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")))
    # a component's members, which may be many, meet its new label in several tasks; ids that had no link are new
    old = spread(labels.select("id", F.col("label").alias("mid")), over.select(F.col("id").alias("mid"), F.col("label").alias("to")), ["mid"], "left").select("id", F.coalesce("to", "mid").alias("label"))
    return small(old.unionByName(over.join(labels.select("id"), "id", "left_anti")))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of df: key, n_shingles, class_id, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of `size`-word
    shingles (a text of fewer words is one shingle). A document without words, or with a null text, has
    an empty set and links with nothing: it is its own component. class_id is the smallest key with the
    same set, component_id the smallest that links reach. Rows with a null key get null ids. Keys that
    repeat with another text count as one document that has both sets. An empty table gives no rows;
    other columns of df are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    root = scratch(spark, "jaccard")
    hold = lambda what, d: kept(d, f"{root}/{what}")

    def gone(*what: str) -> None:
        drop(spark, *[f"{root}/{x}" for x in what])
        collect(spark)

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    common = common_shingles(rows, "id", "text", size)
    sets = hold("sets", profile(rows, size, percent, common))
    same = hold("same", sets.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("first")))
    reps = same.select("k1", "k2", F.col("first").alias("id"))
    classes = hold("classes", sets.join(reps, ["id", "k1", "k2"], "left_semi").groupBy("id", "k1", "k2").agg(*[F.first(x).alias(x) for x in ("n", "bits", "prefix")]).drop("k1", "k2"))
    digests = hold("digests", sets.select("id", "n", "k1", "k2"))
    gone("sets")
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0

    found = hold("found", matches(classes, max(1, -(-total // BUCKET)), percent))
    thin = hold("thin", classes.select("id", "n", "bits"))
    gone("classes")
    tried = hold("tried", found.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    best = bounded(tried, thin, percent)
    best = hold("best", best.groupBy("b").agg(F.max_by("a", F.struct("most", -F.col("a"))).alias("a")))
    links = hold("links", verify(best.select("a", "b"), rows, size, percent))
    gone("tried")
    labels = components(links)

    # groups whose classes are not all in one component yet, but for pairs that were just tried
    known = lambda d, id_, to: d.join(labels.select(F.col("id").alias(id_), F.col("label").alias("__l")), id_, "left").withColumn(to, F.coalesce("__l", id_)).drop("__l")
    named = hold("named", known(known(found, "leader", "p"), "id", "q"))
    gone("found", "links")
    mixed = named.groupBy("h").agg(F.min(F.least("p", "q")).alias("low"), F.max(F.greatest("p", "q")).alias("high"), (F.count("*") + 1).alias("members"))
    open_ = spread(named, hold("mixed", mixed.where("low <> high")), ["h"]).join(best.select(F.col("a").alias("leader"), F.col("b").alias("id"), F.lit(True).alias("tried")), ["leader", "id"], "left")
    open_ = open_.where("members > 2 OR tried IS NULL")
    open_ = hold("open", open_)
    members = hold("members", open_.select("h", "id", F.col("q").alias("label")).unionByName(open_.select("h", F.col("leader").alias("id"), F.col("p").alias("label"))).distinct())

    def inside(roots: DataFrame, c: str) -> DataFrame:
        """(c, id, n): the classes of the components named in c, roots without links included."""
        own = labels.select(F.col("label").alias(c), "id").join(roots, c, "left_semi").unionByName(roots.select(c, F.col(c).alias("id"))).distinct()
        return own.join(thin.select("id", "n"), "id")

    # a group's large component meets the others once, not once a group; the others meet group by group.
    # Of each two components that bitmaps can't keep apart, the likeliest two classes are tried first
    gone("named", "mixed", "best", "open")
    counts = members.groupBy("h", "label").agg(F.count("*").alias("m")).where(F.col("m") >= HOST)
    placed = spread(members, hold("hosts", counts.groupBy("h").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("host"))), ["h"], "left")
    placed = hold("placed", placed.where("host IS NULL OR label <> host"))
    gone("members", "hosts")
    first = inside(placed.where("host IS NOT NULL").select("host").distinct(), "host").join(thin.select("id", "bits"), "id")
    visitors = placed.where("host IS NOT NULL").select("id", "label", "host").distinct().join(thin, "id")
    torn = hold("torn", placed.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h"))
    apart = rivals(group_tiles(spread(placed.select("h", "id", "label"), torn, ["h"]).join(thin, "id"), percent).unionByName(host_tiles(first, visitors, percent)), percent)
    likeliest = hold("likeliest", apart.groupBy("p", "q").agg(F.max_by(F.struct("a", "b"), F.struct("most", -F.col("a"), -F.col("b"))).alias("best")).select("p", "q", "best.a", "best.b"))
    gone("placed", "torn")
    once = relabel(labels, hold("tested", verify(likeliest.select("a", "b").distinct(), rows, size, percent)))
    of = lambda d, c, to: d.join(once.select(F.col("id").alias(c), F.col("label").alias("__l")), c, "left").withColumn(to, F.coalesce("__l", c)).drop("__l")
    apart = hold("apart", of(of(likeliest.select("p", "q"), "p", "l"), "q", "r").where("l <> r").select("p", "q"))

    # where that failed, every class of the smaller component visits the larger one's tiles
    grown = labels.groupBy("label").agg(F.count("*").alias("m"))
    for c in "pq":
        apart = apart.join(grown.select(F.col("label").alias(c), F.col("m").alias(f"m{c}")), c, "left").withColumn(f"m{c}", F.coalesce(f"m{c}", F.lit(1)))
    visited = hold("visited", apart.select(F.when(F.col("mp") < F.col("mq"), F.col("q")).otherwise(F.col("p")).alias("host"), F.when(F.col("mp") < F.col("mq"), F.col("p")).otherwise(F.col("q")).alias("guest")).distinct())

    lodged = hold("lodged", inside(visited.select("host").distinct(), "host"))
    sizes = lodged.groupBy("host").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    visits = visited.join(inside(visited.select("guest").distinct(), "guest"), "guest").join(sizes, "host").where(f"100 * n >= {percent} * low AND 100 * high >= {percent} * n")
    visits = hold("visits", visits.select("id", "host", "n").distinct())
    sets_ = arrays(rows, hold("asked", lodged.select("id").unionByName(visits.select("id")).distinct()), size)
    labels = relabel(once, hold("joined", guests(visits, lodged, sets_, percent))).withColumnRenamed("id", "first")

    final = hold("final", same.join(labels, "first", "left").select("k1", "k2", F.col("first"), F.coalesce("label", "first").alias("label")))
    gone("same", "thin", "likeliest", "tested", "apart", "visited", "lodged", "visits", "asked", "joined")
    out = digests.join(final, ["k1", "k2"], "left")
    own = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id"))
    reached = F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("class_id"), reached.alias("component_id"))


def oracle(size: int = 3, percent: int = 90, documents: str = "documents") -> str:
    """doc_id, n_shingles, component_id and class_id in DuckDB SQL, by counting shared shingles of all pairs."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shingle = " || ' ' || ".join(f"w[i + {n}]" for n in range(size))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size} + 2), lambda i: {shingle}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.i >= {percent} * (x.n + y.n - c.i)),
r AS (SELECT doc_id, doc_id AS to_ FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_),
k AS (SELECT doc_id, min(to_) AS component_id FROM r GROUP BY doc_id), g AS (SELECT s, min(doc_id) AS class_id FROM s WHERE len(s) > 0 GROUP BY s)
SELECT k.doc_id, n.n AS n_shingles, k.component_id, coalesce(g.class_id, k.doc_id) AS class_id FROM k JOIN n USING (doc_id) JOIN s USING (doc_id) LEFT JOIN g ON g.s = s.s"""
