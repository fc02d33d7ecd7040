import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wakelag.llm import jaccard
from wakelag.llm.common import gathered, mapped, small_batches
from wakelag.llm.langid import Model

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_gathered_keeps_rows_and_order():
    parts = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64())], ["x"]) for a, b in ((0, 3), (3, 3), (3, 8), (8, 9))]
    got = list(gathered(iter(parts), 4))
    assert [b.num_rows for b in got] == [8, 1]
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(9))
    assert list(gathered(iter([]))) == []


def test_a_set_batch_size_stays(spark):
    before = spark.conf.get(NAME, None)
    try:
        spark.conf.set(NAME, "17")
        small_batches(spark)
        assert spark.conf.get(NAME) == "17"
        spark.conf.unset(NAME)
        small_batches(spark)
        assert spark.conf.get(NAME) == "2000"
    finally:
        spark.conf.unset(NAME)
        if before is not None:
            spark.conf.set(NAME, before)


def test_batches_are_bounded_in_bytes(spark):
    before = spark.conf.get(BYTES, None)
    try:
        spark.conf.unset(BYTES)
        small_batches(spark)
        rows = spark.range(0, 100, 1, 1).select(F.expr("repeat('x', 100000)").alias("text"))
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) == 100
        assert max(r.n for r in sizes) <= 12
        spark.conf.set(BYTES, "123456")
        small_batches(spark)
        assert spark.conf.get(BYTES) == "123456"
    finally:
        spark.conf.unset(BYTES)
        if before is not None:
            spark.conf.set(BYTES, before)


def _own() -> int:
    """Bytes of this process that no file backs."""
    with open("/proc/self/smaps_rollup") as f:
        return 1024 * sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read())))


def test_a_worker_keeps_nothing_of_a_task(spark):
    """Caches go, and so does the heap, when a task has ended."""

    def state() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (os.getpid(), len(jaccard._words), _own())], ["worker", "words", "own"])

    def fill(batches):
        for _ in batches:
            jaccard.shingles(" ".join(f"word{i}" for i in range(200_000)), 5)
            yield state()

    def look(batches):
        yield from (state() for _ in batches)

    schema = "worker long, words long, own long"
    full = mapped(spark.range(0, 1, 1, 1), fill, schema, jaccard.forget).collect()[0]
    after = spark.range(0, 64, 1, 64).mapInArrow(look, schema).collect()  # every waiting worker gets some
    assert full.words == 200_000 and max(r.words for r in after) == 0
    assert all(r.own < full.own - (10 << 20) for r in after if r.worker == full.worker)


def test_forget_changes_no_score():
    model = Model.fit([("en", "the cat and the dog"), ("de", "der hund und die katze")], ["the", " the", "hund", " d", "er"])
    texts = ["the hund", None, "x" * 60 + " der", "und die the cat"]
    first = model.predict(texts)
    model.forget()
    assert not {"_known", "_table", "_scorer", "_index"} & set(model.__dict__)
    model.forget()
    assert model.predict(texts) == first
    assert np.isfinite(first[1]).all()


def test_row_digest_tells_all_rows_apart(spark):
    """Below a millisecond, nulls against absent values, columns that swap theirs, maps, structs with odd names, bytes."""
    from pyspark.sql import functions as F

    from wakelag.llm.common import row_digest

    base = "CAST('2024-01-01 00:00:00.000001' AS TIMESTAMP) AS t, 'a' AS x, CAST(NULL AS STRING) AS y, array(1, NULL) AS l, map('k', 1) AS m, named_struct('a b', 1, 'c`d', CAST(NULL AS INT)) AS s, 1.50BD AS d, DOUBLE('NaN') AS f, X'00' AS b, array(map(1, array(X'FF'))) AS n, '-' AS z"
    other = ["CAST('2024-01-01 00:00:00.000002' AS TIMESTAMP) AS t", "CAST(NULL AS STRING) AS x", "'a' AS y", "array(1) AS l", "map('k', CAST(NULL AS INT)) AS m", "named_struct('a b', CAST(NULL AS INT), 'c`d', 1) AS s", "1.51BD AS d", "-0.0D AS f", "X'01' AS b", "array(map(1, array(X'FE'))) AS n", "CAST(NULL AS STRING) AS z"]
    whole = spark.sql(f"SELECT {base}")
    rows = [whole, whole]
    for o in other:
        name = o.rsplit(" ", 1)[1]
        rows.append(whole.withColumn(name, F.expr(o.rsplit(" AS ", 1)[0])))
    rows.append(whole.withColumns({"x": F.lit(None).cast("string"), "y": F.lit("a")}))
    got = [d.select(row_digest(d)).first()[0] for d in rows]
    assert got[0] == got[1] and len(set(got)) == len(got) - 1
