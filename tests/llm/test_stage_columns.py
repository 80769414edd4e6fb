from helpers import DOC_SCHEMA, prose, row
from pyspark.sql import functions as F

from cohortflow.llm import decontaminate, simhash


def test_a_callers_hash_columns_stay(spark):
    docs = spark.createDataFrame([row(1, prose(1)), row(2, prose(1)), row(3, prose(2)), row(4, prose(3, 40)), row(None, None)], DOC_SCHEMA)
    docs = docs.withColumn("TEXT_HASH__", F.lit("mine")).withColumn("text_hash___", F.lit(5))
    benchmark = spark.createDataFrame([(1, prose(3, 40))], "item_id long, text string")
    one = simhash.keep_one(docs)
    clean = decontaminate.clean_documents(one, benchmark)
    assert one.columns == clean.columns == docs.columns
    assert {(r["doc_id"], r["TEXT_HASH__"], r["text_hash___"]) for r in one.collect()} == {(k, "mine", 5) for k in (1, 3, 4, None)}
    assert {r["doc_id"] for r in clean.collect()} == {1, 3, None}
