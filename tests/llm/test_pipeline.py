import hashlib
from collections import Counter

import pytest

from tests.llm.conftest import ROWS
from tests.llm.test_jaccard import brute as near
from tests.llm.test_secrets import brute as found
from wakelag.llm import mixing

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_what_they_should(spark, made):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    lang, near_, clean, mixed, coded = made
    assert [d.columns for d in made[:4]] == [start.columns] * 4
    texts = {r["doc_id"]: r["text"] for r in start.collect()}
    assert {r["doc_id"] for r in lang.collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    groups = near(sorted(texts.items()), 5, 80)
    kept = {r["doc_id"] for r in near_.collect()}
    assert kept == {i for i, (_, g) in groups.items() if i == g} and near_.count() == len(kept)
    for r in clean.collect():
        assert not found(r["text"]) and (found(texts[r["doc_id"]]) or r["text"] == texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    assert clean.count() == near_.count() and mixed.count() > 0
    final = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in coded.collect():
        assert r["decoded_sha256"] == hashlib.sha256(final[r["doc_id"]].encode()).hexdigest()
    assert coded.count() == mixed.count()


def test_run_gives_the_stages_result(spark, made):
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, made[-1].collect()))


def test_texts_under_one_id_are_judged_apart(spark):
    words = lambda c: " ".join(f"{c}{n}" for n in range(60))
    rows = [(1, words("a")), (6, words("a") + " end"), (6, words("b")), (6, words("b")), (7, words("c")), (7, words("d")), (8, ""), (8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pipeline.jaccard_join(spark, d, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, words("a")), (6, words("b")), (7, words("c")), (7, words("d")), (8, ""), (8, None)], key=str)


def test_counts_of_rows_without_an_id_are_their_own(spark):
    rows = [(None, f"{c} " * n, "en", s, 2 * n) for n in (5, 40, 300) for c in "abc" for s in ("x", "y", None)] + [(4, "a b c", "en", "x", 5)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = Counter()
    for r in mixing.mix(d).where("size > 0").collect():
        want[r["source"], r["size"]] += (2 * r["taken"] + r["size"]) // (2 * r["size"])
    got = Counter((r["source"], len(r["text"].split())) for r in pipeline.mix(spark, d, SF).collect())
    assert got == +want and len(got) > 1


def edge_docs(docs):
    """The edge rows with every clashing column and those that stages make up themselves."""
    from pyspark.sql import functions as F

    d = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("row", "times", "copy", "lang_found", "score_found", "digest", "least", "first", "component_id", "row_digest", "taken"):
        d = d.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    return d


def test_edges(spark, docs, none):
    d = edge_docs(docs)
    plain = lambda rows: sorted(map(str, map(tuple, rows)))
    start = d.collect()
    for name, stage in pipeline.STAGES:
        assert stage(spark, d.limit(0), SF).count() == 0
        got = stage(spark, d, SF)
        if name != "bpe":
            assert got.columns == d.columns
        rows = got.collect()
        if name == "language_id":
            assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS if any(c.isalpha() for c in r[1] or "")}
            assert all(r["lang"] for r in rows) and [r["doc_id"] for r in rows].count(6) == 2
            same = lambda r: {k: v for k, v in r.asDict().items() if k != "lang"}
            assert all(same(r) in map(same, start) for r in rows)
        if name == "jaccard_join":  # 6 is a copy of 1; rows without words or an id stay
            assert plain(rows) == plain({str(r): r for r in start if r["doc_id"] != 6}.values())
        if name == "secret_scan":
            assert len(rows) == len(start) and {r["spans"] for r in rows} == {"clash"}
            for r in rows:
                was = next(x for x in start if x["doc_id"] == r["doc_id"])
                assert (r["text"] == was["text"]) == (not found(was["text"] or "")) and (r["text"] is None or r["n_chars"] == len(r["text"]))
        if name == "mixing":
            want = Counter()
            for r in mixing.mix(d).where("size > 0").collect():
                want[r["doc_id"]] += (2 * r["taken"] + r["size"]) // (2 * r["size"])
            assert Counter(r["doc_id"] for r in rows) == +want and set(plain(rows)) <= set(plain(start))
        if name == "bpe":
            assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in rows) == sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in start)


def test_rows_that_repeat_an_id_and_text_leave_the_same_one(spark):
    rows = [(3, "one two three four five six", s, n) for s in "cab" for n in (2, None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = {tuple(map(tuple, pipeline.jaccard_join(spark, d.repartition(n), SF).collect())) for n in (1, 3)}
    assert got == {((3, "one two three four five six", "a", None),)}


def odd(spark, rows):
    """rows (doc_id, text, lang, source, micros) with columns of every kind under odd names, among them one that only differs below a millisecond."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, us long").repartition(3)
    return d.select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.timestamp_micros("us").alias("at.time"),
        F.create_map(F.lit("k"), F.col("us").cast("string")).alias("a map"), F.struct(F.col("us").alias("a b"), F.lit(None).cast("decimal(9,3)").alias("c`d")).alias("st`ruct"), F.array(F.col("us").cast("decimal(20,4)")).alias("spans"),
    )


def test_columns_of_any_kind_through_all_stages(spark):
    """No row is lost or swapped for one that differs below a millisecond; maps, structs and decimals pass under whatever names."""
    words = lambda c, n: " ".join(f"{c}{'xyz'[k % 3]}{chr(97 + k % 26)}" for k in range(n))
    rows = [(n, words(c, 40 + n), "en" if n % 2 else "de", s, 1_700_000_000_000_000 + n) for n, (c, s) in enumerate([(c, s) for c in ("the", "und", "of", "der") for s in ("p", "q", None)])]
    rows += [(None, words("also", 50), "en", "p", 1_700_000_000_000_100 + k) for k in range(3)]
    start = odd(spark, rows)
    docs = start
    for name, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == start.columns, name
        before = {str(r) for r in start.collect()}
        got = Counter(str(r) for r in docs.collect())
        assert set(got) <= before, name
        if name in ("jaccard_join", "secret_scan"):
            assert sum(got.values()) == len(got)
    spelt = {r["at.time"] for r in docs.where("doc_id IS NULL").collect()}
    assert len(spelt) == 3
    assert pipeline.encode(spark, docs, SF).count() == docs.count()
