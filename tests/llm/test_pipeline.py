"""The pipeline's stages against their operators and planted documents."""

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlint.llm.common import stored, table

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        kept.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2] > 0
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_planted_documents(spark):
    base = table(spark, FOLDER, "documents")
    item = table(spark, FOLDER, "benchmark").orderBy("item_id").first()["text"]
    long = " ".join(f"plain{i}" for i in range(60))
    planted = [(900001, long, "en", "src0", len(long)), (900002, long, "en", "src1", len(long)),
               (900003, long.replace("plain7 ", "other ", 1), "en", "src2", len(long)),
               (900004, f"start {item} end", "en", "src0", 10), (900005, "write to some.body@example.com now", "en", None, 1),
               (900006, None, None, None, None)]
    docs = base.union(spark.createDataFrame(planted, base.schema))
    docs = stored(docs, "planted")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), name)
    ids = {r["doc_id"]: r["text"] for r in docs.where("doc_id > 900000").collect()}
    assert set(ids) == {900001, 900005, 900006}
    assert ids[900005] != planted[4][1] and ids[900005].endswith("@example.com now")


def test_the_mix_is_written(spark, tmp_path):
    docs = table(spark, FOLDER, "documents").where("doc_id < 60")
    report = corpus_pipeline.write_mix(docs, str(tmp_path / "mix"))
    taken = {r["doc_id"]: r["taken"] for r in report.collect()}
    written = {}
    shards = set()
    for r in spark.read.parquet(str(tmp_path / "mix")).collect():
        assert len(r["text"].split()) == r["n_words"]
        written[r["doc_id"]] = written.get(r["doc_id"], 0) + r["n_words"]
        shards.add(r["shard"])
    assert written == {k: n for k, n in taken.items() if n} and len(shards) > 1


def test_stages_on_an_empty_table_and_on_odd_rows(spark):
    base = table(spark, FOLDER, "documents")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (2, "same words here", None, "s", 3),
         (2, "same words here", None, "s", 3)], base.schema)
    for rows in (base.limit(0), odd):
        docs = stored(rows.withColumn("score", F.lit(1)).withColumn("__key", F.lit("x")), "odd")
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            done = stored(stage(spark, docs, FOLDER), name)
            if name != "mixing":
                assert done.columns == docs.columns
                docs = done
            assert docs.count() <= before
