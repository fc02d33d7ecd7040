"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, CalendarIntervalType, DataType, MapType, StringType, StructField, StructType, TimestampType, VariantType

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session. Where none is set, a local master takes
    a temporary folder; a cluster is refused, since its executors would not see it."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        path = spark.conf.get("spark.checkpoint.dir", "")
        if not path and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="wakelag-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder for intermediate tables below the shared one. All of them go when the program ends;
    `drop` removes one that is no longer read."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        jvm, conf, root = spark._jvm, spark._jsc.hadoopConfiguration(), _scratch[app]
        atexit.register(lambda: _delete(jvm, conf, root))
    return f"{_scratch[app]}/{what}-{uuid.uuid4().hex}"


def _delete(jvm, conf, path: str) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass


def drop(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        _delete(spark._jvm, spark._jsc.hadoopConfiguration(), p)


def collect(spark: SparkSession) -> None:
    """Has the driver collect its garbage: what Spark keeps for plans that are done (tables sent to every task, on the
    driver and the executors) goes only then, and a driver with room to spare seldom does so itself."""
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 2_000, most: int = 1 << 20) -> None:
    """Arrow batches of `rows` rows and about `most` bytes (a larger row stands alone) between JVM and Python workers, in
    place of 10,000 rows of any size: a batch stands in memory several times on either side, and rows of packed
    shingles are long. A session that sets a number itself keeps it."""
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", most)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(value))


def release() -> None:
    """Gives the system back what this process holds but does not use: Arrow's pool and, where the C library can
    do so, its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, forget: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow whose Python worker keeps no memory of a task that has ended. Workers wait for later tasks beside the
    JVM, and what they hold counts there, in stages without any Python too. forget: clears caches."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            release()

    return df.mapInArrow(whole, schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least `rows` rows (the last one may have fewer)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


#: Bytes on disk of a table that `kept` lets a join send to every task: in memory it takes several times that,
#: and the driver builds it.
MOST_SENT = 1 << 20


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings (dots as two underscores) changed for a while."""
    names = {k: k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    try:
        for k, value in values.items():
            spark.conf.set(names[k], value)
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(names[k]) if value is None else spark.conf.set(names[k], value)


def sent(spark: SparkSession) -> int:
    """Bytes of a table that joins of the session may send to every task, MOST_SENT at most."""
    return min(MOST_SENT, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def kept(df: DataFrame, path: str) -> DataFrame:
    """df written to `path` as Parquet and read back: plans that follow know its size. The shuffle files behind it go
    at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=str(sent(spark)), spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, taken: Sequence[str]) -> str:
    """`name`, with underscores behind it until no column (in any case) is called so."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back, so that later plans neither repeat nor lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; 2 marks a held-out row. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 2


def text_slices(batch: pa.RecordBatch, name: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text each (a longer row stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, text: str | None = None) -> DataFrame:
    """mapInArrow with one output batch for each bounded piece of an input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, text) if text else (batch,):
                yield step(piece)

    return df.mapInArrow(run, schema)


def with_fields(fields: Sequence[StructField], **more: DataType) -> StructType:
    """A schema of fields, of whatever names and types, and further ones; all may be null."""
    return StructType([*[StructField(f.name, f.dataType) for f in fields], *[StructField(n, t) for n, t in more.items()]])


def spelt(value: Column, kind: DataType) -> Column:
    """A value of any type as text, so that different values are different texts: null apart from everything, times to the
    microsecond, texts and bytes by their md5, maps by their entries in order."""
    if isinstance(kind, StructType):
        text = F.concat(F.lit("("), F.concat_ws(",", *[spelt(value.getField(f.name), f.dataType) for f in kind.fields]), F.lit(")"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: spelt(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(spelt(e["key"], kind.keyType), F.lit("="), spelt(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(F.array_sort(pairs), ","), F.lit("}"))
    elif isinstance(kind, (StringType, BinaryType)):
        text = F.md5(value.cast("binary"))
    elif isinstance(kind, TimestampType):
        text = F.unix_micros(value).cast("string")
    else:
        text = F.to_json(value) if isinstance(kind, VariantType) else value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.lit("+"), text))


def quoted(names: Sequence[str]) -> list[Column]:
    """Columns by their whole names, dots and back quotes included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def orderable(kind: DataType) -> bool:
    """Whether values of a type can be compared: no map, variant or calendar interval in it."""
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType, CalendarIntervalType))


def plain(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, called by their places: Arrow functions look columns up by name, which dots and back quotes break."""
    return df.select(*quoted(names)).toDF(*[f"c{n}" for n in range(len(names))])


def row_digest(df: DataFrame) -> Column:
    """A digest of all columns of df, of whatever types and names: rows that differ anywhere have different ones."""
    return F.md5(F.concat_ws(",", *[spelt(c, f.dataType) for c, f in zip(quoted(df.columns), df.schema.fields, strict=True)]).cast("binary"))
