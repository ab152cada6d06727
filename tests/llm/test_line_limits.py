import pytest
from pyspark.sql import functions as F

from reviewmine.llm import line_rules


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_limits_of_the_pipeline_do_not_grow_with_the_host(spark, most):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    short, long = "read more about us here", " ".join(f"footer{k}" for k in range(20))
    rows = [(i, "\n".join([own(i), *[short] * (i < 55), *[long] * (i < 5), *["see also"] * (i < 49)])) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("hot"))
    limits = {"enough": line_rules.TEXTS, "long_texts": line_rules.LONG_TEXTS}
    texts = dict(line_rules.clean(docs, most=most, **limits).select("doc_id", "text").where("doc_id < 60").collect())
    assert texts == {i: "\n".join([own(i), *["see also"] * (i < 49)]) for i in range(60)}
