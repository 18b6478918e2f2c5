"""The pipeline on tables with nulls, repeated rows, clashing columns, and on empty ones."""

import corpus_pipeline

from .fixtures import documents

LABELS = "doc_id long, quality int, toxic int"


def write(spark, path, docs, labels=(), items=()):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    docs, rows = documents(spark, 3)
    where = write(spark, tmp_path, docs, [(k, 1, 0) for k in range(30)] + [(None, 1, 1)], [(1, None), (2, "")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns, name
    out = corpus_pipeline.run(spark, where).collect()
    ids = {d for d, _ in rows}
    assert out and {r["doc_id"] for r in out} <= ids and None in {r["doc_id"] for r in out}
    spans = {}
    for r in out:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in spans.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_empty_tables_give_no_rows(spark, tmp_path):
    docs, _ = documents(spark)
    where = write(spark, tmp_path, docs.limit(0))
    assert corpus_pipeline.run(spark, where).count() == 0
