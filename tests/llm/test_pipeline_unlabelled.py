import corpus_pipeline
from tests.llm.helpers import frame
from pyspark.sql import functions as F


def test_language_stage_without_labels(spark):
    rows = [(1, "some clean words"), (2, None), (3, ""), (4, "12 !?"), (5, "é")]
    docs = frame(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 5]
