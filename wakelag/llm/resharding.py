"""Operator 5: resharding by minimum-cost flow.

A layout is a folder of shards; a shard is cut into blocks, and runs of blocks stand in pieces, folders of
a file each. Block sizes are summed on the cluster; their number is fixed, so the driver solves, on a graph
of shards, the transfers that move the fewest bytes into the new capacities, and turns the flows into whole
blocks that follow each other. Only pieces that hold a block that moves are rewritten, all in one job; they
are published by renaming folders, after a journal of what comes and goes.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wakelag.llm.common import drop, free, kept, scratch

#: Blocks of an old shard; the plan has old shards x BLOCKS rows at most, whatever the data.
BLOCKS = 256
#: Pieces of an old shard at least, a divisor of BLOCKS; bytes of text of a piece beyond that, about.
PIECES, PIECE_BYTES = 8, 512 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Whole-number flows[i][j] that ship all supply within capacity at the least cost, by successive
    shortest paths with potentials. sum(capacity) must reach sum(supply)."""
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards hold less than the old ones")
    s, t = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # to, room, cost, place of the reverse edge

    def edge(a: int, b: int, room: int, c: int) -> list[int]:
        graph[a].append([b, room, c, len(graph[b])])
        graph[b].append([a, 0, -c, len(graph[a]) - 1])
        return graph[a][-1]

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
    kept = [[edge(i, n + j, supply[i], cost[i][j]) for j in range(m)] for i in range(n)]
    for j, x in enumerate(capacity):
        edge(n + j, t, x, 0)
    potential, left = [0] * len(graph), sum(supply)
    while left:
        far, back, heap = [float("inf")] * len(graph), [(-1, -1)] * len(graph), [(0, s)]
        far[s] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, c, _) in enumerate(graph[a]):
                if room and (e := d + c + potential[a] - potential[b]) < far[b]:
                    far[b], back[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        path, b = [], t
        while b != s:
            path.append(graph[back[b][0]][back[b][1]])
            b = back[b][0]
        push = min(left, *(x[1] for x in path))
        for x in path:
            x[1] -= push
            graph[x[0]][x[3]][1] += push
        left -= push
    return [[supply[i] - kept[i][j][1] for j in range(m)] for i in range(n)]


def move_cost(old: int, new: int) -> list[list[int]]:
    """A byte that stays in the shard of its number costs nothing, another one 1."""
    return [[int(i != j) for j in range(new)] for i in range(old)]


def place_blocks(sizes: dict[tuple[int, int], int], old: int, capacity: list[int], cost: list[list[int]] | None = None, run: int = 1) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard: each old shard's flows as runs of blocks by number, what stays first
    (unusually large blocks before that, where most room is), then exchanges of single blocks while they
    bring the fullest and the emptiest shard closer to their capacity. Exchanges keep to runs of `run` blocks that move in part already, where they serve as well."""
    new = len(capacity)
    cost = cost or move_cost(old, new)
    supply = [sum(n for (i, _), n in sizes.items() if i == s) for s in range(old)]
    flow = min_cost_flow(supply, capacity, cost)
    out, filled = {}, [0] * new
    put = lambda i, b, j: (out.__setitem__((i, b), j), flow[i].__setitem__(j, flow[i][j] - sizes[i, b]), filled.__setitem__(j, filled[j] + sizes[i, b]))
    usual = 2 * sum(sizes.values()) / max(1, len(sizes))
    for n, i, b in sorted((-n, i, b) for (i, b), n in sizes.items() if n > usual):  # large ones where most room is
        put(i, b, max(range(new), key=lambda j: (flow[i][j], -cost[i][j], -j)))
    order = {i: sorted((j for j in range(new) if flow[i][j] > 0), key=lambda j: (cost[i][j], j)) or [min(range(new), key=lambda j: (cost[i][j], j))] for i in range(old)}
    for i, b in sorted(x for x in sizes if x not in out):
        while len(order[i]) > 1 and 2 * flow[i][order[i][0]] < sizes[i, b]:  # less than half of the block fits
            order[i].pop(0)
        put(i, b, order[i][0])
    for _ in range(16 * new):
        high = max(range(new), key=lambda j: filled[j] - capacity[j])
        low = min(range(new), key=lambda j: filled[j] - capacity[j])
        gap = (filled[high] - capacity[high]) - (filled[low] - capacity[low])
        fits = [(cost[i][low] - cost[i][high], abs(2 * sizes[i, b] - gap), i, b) for (i, b), j in out.items() if j == high and 0 < sizes[i, b] < gap]
        if not fits:
            break
        good = [x for x in fits if x[0] <= 0 and x[1] < 0.8 * gap]  # first those that move no further byte
        torn = {(i, b // run) for (i, b), j in out.items() if cost[i][j]}
        near = [x for x in good if (x[2], x[3] // run) in torn and x[1] < 0.4 * gap]
        _, _, i, b = min(near or good or fits, key=lambda x: x[1:])
        out[i, b] = low
        filled[high] -= sizes[i, b]
        filled[low] += sizes[i, b]
    return out


def even_capacity(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def write_layout(df: DataFrame, path: str, old: int, text: str = "text", blocks: int = BLOCKS, pieces: int = PIECES, piece_bytes: int = PIECE_BYTES) -> dict[str, str]:
    """df as files by shard and piece, with the block of each row: the layout that `rewrite` works on. Returns
    the names of its columns shard, piece and block, which get underscores where df has such columns itself.

    Rows are dealt by a hash of their place in df, so neither rows alike nor texts alike crowd one shard; nulls
    are rows like others, and an empty table gives a layout without files. Numbers of blocks and pieces are
    unique over the whole layout. Pieces grow in number with the data: first a piece holds fewer blocks, then
    a block has several pieces.
    """
    names = {x: free(x, df.columns) for x in ("shard", "piece", "block")}
    total = df.agg(F.sum(size_of(F.col(text)))).first()[0] or 0
    while pieces < blocks and total > old * pieces * piece_bytes:
        pieces *= 2
    parts = max(1, -(-total // (old * pieces * piece_bytes)))  # pieces of a block, once each has its own
    h = F.xxhash64(F.monotonically_increasing_id())
    shard, block = F.pmod("__h", F.lit(old)).cast("int"), F.pmod(F.shiftrightunsigned("__h", 20), F.lit(blocks)).cast("int")
    laid = df.withColumn("__h", h).withColumn(names["shard"], shard).withColumn(names["block"], F.col(names["shard"]) * blocks + block)
    laid = laid.withColumn(names["piece"], F.call_function("div", F.col(names["block"]), F.lit(blocks // pieces)) * parts + F.pmod(F.shiftrightunsigned("__h", 40), F.lit(parts)))
    laid = laid.drop("__h").repartition(names["shard"], names["piece"]).sortWithinPartitions(names["shard"], names["piece"], names["block"])
    laid.write.partitionBy(names["shard"], names["piece"]).parquet(path)
    _write(df.sparkSession, f"{path}/_layout.json", {"names": names, "shards": old, "run": blocks // pieces, "blocks": blocks})
    return names


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write(spark: SparkSession, path: str, data: dict) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(data).encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    got = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(got)).decode())
    finally:
        got.close()


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a layout with their shard and block; a move that was broken off is finished first. While
    none is, a plain spark.read.parquet says the same."""
    finish(spark, path)
    return spark.read.parquet(path)


def plan(layout: DataFrame, old: int, new: int, names: dict[str, str], text: str = "text", capacity: list[int] | None = None, run: int = BLOCKS // PIECES) -> list[tuple[int, int, int]]:
    """(old shard, block, shard): at most old x BLOCKS, from sums that are as few."""
    sums = layout.groupBy(*[F.col(names[x]) for x in ("shard", "block")]).agg(F.sum(size_of(F.col(text)))).collect()
    sizes = {(r[0], r[1]): int(r[2]) for r in sums}
    placed = place_blocks(sizes, old, capacity or even_capacity(sum(sizes.values()), new), run=run) if sizes else {}
    return [(i, b, j) for (i, b), j in sorted(placed.items())]


def rewrite(spark: SparkSession, path: str, moves: list[tuple[int, int, int]]) -> int:
    """Moves blocks (old shard, block, new shard) of a layout; pieces without such a block stay as they are.
    Returns the number of blocks moved.

    One job writes the rows of the others anew, those that stay and those that move, to a hidden folder. Then a
    journal is written, and by it folders are renamed into place and the old ones go. A run lost before
    the journal leaves the layout as it was; one lost later is finished by `finish`, which readers and the
    next run call.
    """
    finish(spark, path)
    names, moves = _read(spark, f"{path}/_layout.json")["names"], [m for m in moves if m[0] != m[2]]
    shard, piece, block = (names[x] for x in ("shard", "piece", "block"))
    staged = f"{path}/_moving"
    drop(spark, staged)
    if not moves:
        return 0
    to = spark.createDataFrame(moves, "__from int, __block int, __to int")  # a row a block
    layout = spark.read.parquet(path)
    torn = layout.select(shard, piece, block).distinct().join(F.broadcast(to), (F.col(shard) == F.col("__from")) & (F.col(block) == F.col("__block")))
    torn = sorted({(r[0], r[1]) for r in torn.select(shard, piece).distinct().collect()})  # a row a piece that is rewritten
    base = (layout.agg(F.max(piece)).first()[0] or 0) + 1
    new = max(max(i, j) for i, _, j in moves) + 1
    held = spark.read.option("basePath", path).parquet(*[f"{path}/{shard}={i}/{piece}={g}" for i, g in torn])
    made = held.join(F.broadcast(to), (F.col(shard) == F.col("__from")) & (F.col(block) == F.col("__block")), "left")
    made = made.withColumn("__now", F.coalesce("__to", F.col(shard))).drop("__to", "__from", "__block")
    made = made.withColumn("__piece", F.lit(base).cast("long") + F.col(piece).cast("long") * new + F.col("__now"))
    made = made.drop(shard, piece).withColumnsRenamed({"__now": shard, "__piece": piece})
    made.write.partitionBy(shard, piece).parquet(staged)
    fs, root = _fs(spark, staged)
    fresh = [f"{x.getPath().getName()}/{y.getPath().getName()}" for x in fs.listStatus(root) if "=" in x.getPath().getName() for y in fs.listStatus(x.getPath())]
    _write(spark, f"{path}/_journal.json", {"add": fresh, "remove": [f"{shard}={i}/{piece}={g}" for i, g in torn]})
    finish(spark, path)
    return len(moves)


def finish(spark: SparkSession, path: str) -> None:
    """Publishes what a journal says; done twice or half done before, it ends the same."""
    journal = _read(spark, f"{path}/_journal.json")
    if journal is None:
        return
    for leaf in journal["add"]:
        fs, staged = _fs(spark, f"{path}/_moving/{leaf}")
        _, final = _fs(spark, f"{path}/{leaf}")
        if fs.exists(staged):
            fs.mkdirs(final.getParent())
            fs.rename(staged, final)
    drop(spark, *[f"{path}/{leaf}" for leaf in journal["remove"]])
    for top in {x.split("/")[0] for x in journal["remove"]}:
        fs, left = _fs(spark, f"{path}/{top}")
        if fs.exists(left) and not fs.listStatus(left):
            fs.delete(left, True)
    drop(spark, f"{path}/_moving", f"{path}/_journal.json")


def slots(layout: DataFrame, names: dict[str, str], *columns: Column) -> DataFrame:
    """`columns` of layout's rows with `slot`, gapless from 0 in each shard: a row's place in its file behind all
    files of its shard that come before. The table of files is written, a row a file, so that Spark knows
    how small it is; rows stay where they are read."""
    rows = layout.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = layout.groupBy(F.col(names["shard"]).alias("__shard"), F.col("_metadata.file_path").alias("__of")).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(W.partitionBy("__shard").orderBy("__of")) - F.col("n")
    first = kept(files.select("__of", ahead.alias("__first")), scratch(layout.sparkSession, "files"))
    return rows.join(first, F.col("__file") == F.col("__of")).withColumn("slot", (F.col("__first") + F.col("__row")).cast("long")).drop("__file", "__of", "__row", "__first")


def reshard(df: DataFrame, old: int = 12, new: int = 16, key: str = "doc_id", text: str = "text", path: str | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row for each row of df: key, size, text_crc32, law, shard, slot, grown_shard, old_shard, block.

    df is written as a layout of `old` shards at `path` (a scratch folder if none is given) and resharded to
    `new` ones there; what is returned is read from the files that this leaves. Law `bytes`: sizes are nearly
    equal, so rows alike (the groups that may be large) are not kept together: one group may be larger than a
    shard. A null text has size 1 and the checksum of the empty text; null and repeated keys are rows like
    others, each with its slot; an empty table gives no rows; columns of df of any name are carried along
    in the files.
    """
    spark = df.sparkSession
    path = path or scratch(spark, "shards")
    names = write_layout(df, path, old, text, piece_bytes=piece_bytes)
    block = F.col(names["block"])
    shown = [
        F.col(key).alias(key), size_of(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col(names["shard"]).cast("int").alias("shard"), F.lit(None).cast("int").alias("grown_shard"),
        F.call_function("div", block, F.lit(BLOCKS)).cast("int").alias("old_shard"), block.cast("int").alias("block"),
    ]
    order = (key, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard", "block")
    if _empty(spark, path, names):
        none = df.limit(0).withColumns({x: F.lit(0) for x in names.values()})
        return none.select(*shown, F.lit(0).cast("long").alias("slot")).select(*order)
    rewrite(spark, path, plan(spark.read.parquet(path), old, new, names, text, run=_read(spark, f"{path}/_layout.json")["run"]))
    return slots(read_layout(spark, path), names, *shown).select(*order)


def _empty(spark: SparkSession, path: str, names: dict[str, str]) -> bool:
    fs, root = _fs(spark, path)
    return not any(x.getPath().getName().startswith(f"{names['shard']}=") for x in fs.listStatus(root))
