"""Settling new documents against older ones, as the query does it: texts are folded once, and the SQL holds on odd rows too."""

import unicodedata

import duckdb
import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans import queries


def test_texts_are_folded_once_for_base_and_batch(spark, tmp_path):
    # the result read the whole table again before, and folded the base's texts when it was asked for
    spark.createDataFrame([(1, "Same.", "src1"), (2, "same", "src3")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.incremental_settle(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and not any("documents.parquet" in f for f in got.inputFiles())
    assert [tuple(r) for r in got.collect()] == [(2, "duplicate", 1)]


def test_null_and_empty_texts_are_settled_as_the_sql_has_it(spark, tmp_path):
    # null texts of the batch were equal to empty ones before
    rows = [(1, "", "src1"), (2, None, "src1"), (3, "a b", "src0"), (4, "A, b!", None), (5, None, "src3"), (6, "", "src3"), (7, None, "src4"), (8, "?!", "src5"), (9, "new", "src3"), (10, "New.", "src9"), (11, "a-b", "src3"), (12, None, None)]
    rows += [(100 + i, "One hot text" + "." * (i % 3), "src7") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(queries.ORACLES["incremental_settle"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in queries.incremental_settle(spark, str(tmp_path)).select("doc_id", "status", "main_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 207
    assert {(5, "kept", None), (6, "duplicate", 1), (7, "duplicate", 5), (8, "duplicate", 1)} <= set(got)


def test_the_join_of_a_hot_key_can_be_split(spark, tmp_path):
    # the sources of a key met an aggregate in its own partitions before, which Spark does not split
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Same.").otherwise(F.col("id").cast("string")).alias("text"), F.lit("src3").alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        got = queries.incremental_settle(spark, str(tmp_path))
        assert sum(r["status"] == "duplicate" and r["main_id"] == 0 for r in got.collect()) == 19_999
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_texts_in_ascii_have_the_form_that_others_have():
    # beside a letter of its own a text takes the general way
    for a in map(chr, range(128)):
        for b in map(chr, range(128)):
            text = f"{a}{b}X{a}y{b}{b}"
            general = T.cosmetic(text + " ż")
            assert (T.cosmetic(text) + " ż").strip(" ") == general
    assert T.cosmetic("") == T.cosmetic(" .\n") == ""
    assert unicodedata.is_normalized("NFC", "".join(map(chr, range(128)))) and np.count_nonzero(T._apart()[:128]) == 32 + 6
