"""Batches and versions: killed between data and record, nothing is read half or doubled."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.sources import ledger as lg
from folioforge.sources import sinks
from folioforge.sources import store as st

SCHEMA = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])


def pages(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def read(ledger):
    return sorted(tuple(r) for r in ledger.read().collect())


def test_a_writer_that_dies_before_the_record_has_written_nothing(spark, tmp_path, monkeypatch):
    ledger = lg.Ledger(spark, str(tmp_path / "t"), SCHEMA)
    assert read(ledger) == [] and ledger.batches().count() == 0
    assert ledger.append("a", pages(spark, (1, "x"), (2, "y")))
    with monkeypatch.context() as m:

        def killed(*_):
            raise KeyboardInterrupt

        m.setattr(lg.Ledger, "_record", killed)
        with pytest.raises(KeyboardInterrupt):
            ledger.append("b", pages(spark, (3, "z")))
    assert read(ledger) == [(1, "x"), (2, "y")] and ledger.orphans().count() == 1
    assert ledger.append("b", pages(spark, (3, "z"))) and not ledger.append("b", pages(spark, (3, "z"))) and not ledger.append("a", pages(spark, (9, "q")))
    assert read(ledger) == [(1, "x"), (2, "y"), (3, "z")]
    assert sorted((r["batch"], r["rows"]) for r in ledger.batches().collect()) == [("a", 2), ("b", 1)]


def test_a_job_that_fails_while_it_writes_leaves_no_rows(spark, tmp_path):
    ledger = lg.Ledger(spark, str(tmp_path / "t"), SCHEMA)
    broken = pages(spark, *((k, "x") for k in range(100))).repartition(4).withColumn("text", F.when(F.col("page") == 57, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        ledger.append("a", broken)
    assert read(ledger) == [] and not ledger.has("a")


def test_two_writers_of_one_batch_count_once(spark, tmp_path):
    ledger = lg.Ledger(spark, str(tmp_path / "t"), SCHEMA)
    assert ledger.append("a", pages(spark, (1, "x")))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lg.Ledger, "has", lambda *_: False)  # the other one looked before
        assert ledger.append("a", pages(spark, (1, "x")))
    assert read(ledger) == [(1, "x")]


def test_batches_of_a_stream_that_run_again_are_written_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        pages(spark, (k, f"t{k}"), (k + 10, "u")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ledger = lg.Ledger(spark, str(tmp_path / "out"), SCHEMA)
    for checkpoint in ("c1", "c2"):  # a lost checkpoint: every batch comes again
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(ledger.sink("run-")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert ledger.batches().count() == 3 and len(read(ledger)) == 6


def test_results_are_added_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "h", 5), (2, "h", 6)], "page int, source_sha256 string, chars int")
    path = str(tmp_path / "r")
    assert sinks.append_results(rows, path, ["page"]).count() == 2 and sinks.append_results(rows, path, ["page"]).count() == 0
    more = rows.unionByName(spark.createDataFrame([(3, "h", 7), (1, "new", 8)], rows.schema))
    with monkeypatch.context() as m:
        m.setattr(lg.Ledger, "_record", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            sinks.append_results(more, path, ["page"])
    assert lg.Ledger(spark, path, rows.schema).read().count() == 2
    assert sorted(r["chars"] for r in sinks.append_results(more, path, ["page"]).collect()) == [7, 8]
    assert lg.Ledger(spark, path, rows.schema).read().count() == 4


def draft(spark, book, texts):
    return {
        "verses": spark.createDataFrame([(book, "d", f"v{k}", k, t, 0.5) for k, t in enumerate(texts)], "book_id string, division_id string, id string, number long, text string, confidence double"),
        "divisions": spark.createDataFrame([(book, "d", 0, "section", "T")], "book_id string, id string, ordinal long, kind string, title string"),
        "notes": spark.createDataFrame([(book, 1, "n", "note")], "book_id string, page long, block_id string, text string"),
        "set_aside": spark.createDataFrame([(book, 1, "s", "head")], "book_id string, page long, block_id string, text string"),
    }


def texts(store, version=None):
    return sorted((r["book_id"], r["id"], r["text"], r["orphaned"]) for r in store.read("verses", version).collect())


def folders(path):
    return {str(p): os.path.getmtime(p) for p in path.rglob("*.parquet")}


def test_an_import_is_one_version_of_all_tables(spark, tmp_path, monkeypatch):
    store = st.BookStore(spark, str(tmp_path / "s"), st.WORKING)
    assert store.version() == 0 and texts(store) == []
    assert st.import_drafts(store, draft(spark, "a", ["one", "two"])) == 1
    assert st.import_drafts(store, draft(spark, "b", ["other"])) == 2
    before, files = texts(store), folders(tmp_path)
    assert before == [("a", "v0", "one", False), ("a", "v1", "two", False), ("b", "v0", "other", False)]
    with monkeypatch.context() as m:
        m.setattr(st.BookStore, "_record", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            st.import_drafts(store, draft(spark, "a", ["changed"]))
    assert store.version() == 2 and texts(store) == before
    assert st.import_drafts(store, draft(spark, "a", ["changed"])) == 3
    assert texts(store) == [("a", "v0", "changed", False), ("a", "v1", "two", True), ("b", "v0", "other", False)]
    assert texts(store, 2) == before and texts(store, 1) == before[:2] and texts(store, 0) == []
    after = folders(tmp_path)
    assert all(after[p] == t for p, t in files.items())  # nothing that stood was rewritten
    written = spark.read.parquet(*[p for p in after if p not in files and "/data/verses/" in p])
    assert {r["book_id"] for r in written.collect()} == {"a"}
    assert sorted((r["id"], r["action"], r["version"]) for r in store.read("revisions").where("book_id = 'a'").collect()) == [("v0", "inserted", 1), ("v0", "refreshed", 3), ("v1", "inserted", 1), ("v1", "orphaned", 3)]
    assert store.delete_books(spark.createDataFrame([("a",)], "book_id string")) == 4
    assert texts(store) == [("b", "v0", "other", False)] and store.read("notes").count() == 1 and texts(store, 3) != texts(store)
    assert json.dumps(texts(store, 2)) == json.dumps(before)


def test_many_tasks_name_the_books_of_a_version_and_one_row_names_it(spark, tmp_path):
    store = st.BookStore(spark, str(tmp_path / "s"), {"verses": "book_id string, text string"})
    verses = spark.range(4000).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("book_id"), F.lit("x").alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert store.commit({"verses": verses}, verses, 0) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "s" / "books").rglob("part-*.parquet"))) == 4 and spark.read.parquet(str(tmp_path / "s" / "versions")).count() == 1
    assert store.version() == 1 and store.read("verses").count() == 4000
    assert store.delete_books(verses.where("book_id < 'b2'")) == 2 and store.read("verses").count() == verses.where("book_id >= 'b2'").count()
    assert store.read("verses", 1).count() == 4000


def test_a_version_has_one_writer(spark, tmp_path, monkeypatch):
    store = st.BookStore(spark, str(tmp_path / "s"), st.WORKING)
    st.import_drafts(store, draft(spark, "a", ["one"]))
    verses, books = store.read("verses"), spark.createDataFrame([("a",)], "book_id string")
    with pytest.raises(st.Conflict):
        store.commit({"verses": verses}, books, 0)
    with monkeypatch.context() as m:
        m.setattr(st.BookStore, "version", lambda self: 0)  # both looked before the other wrote
        with pytest.raises(st.Conflict):
            store.commit({"verses": verses.withColumn("text", F.lit("late"))}, books, 0)
    assert texts(store) == [("a", "v0", "one", False)]
