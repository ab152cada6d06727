import math

from messy import TEXTS, messy
from pyspark.sql import functions as F

from reviewmine.llm import rule_quality as q
from reviewmine.llm.batches import held_out

TREE = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=3
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 0.75)
    Predict: 1.0
   Else (feature 0 > 0.75)
    Predict: 0.0
"""


def test_paths_become_rules():
    inf = math.inf
    assert q.tree_rules(TREE) == {
        ((0, -inf, 0.5),), ((0, 0.5, inf),), ((0, -inf, 0.5), (1, -inf, 2.0)), ((0, -inf, 0.5), (1, 2.0, inf)),
        ((0, 0.5, 0.75),), ((0, 0.75, inf),),
    }


def test_compiled_score(spark):
    rule = ((0, -math.inf, 0.5), (1, 2.0, math.inf))
    model = q.Ensemble(-1.0, {rule: 2.0, ((0, 0.5, math.inf),): 0.25})
    rows = spark.createDataFrame([(0.5, 2.5), (0.5, 2.0), (0.6, 9.0)], "a double, b double")
    got = [r[0] for r in rows.select(model.score([F.col("a"), F.col("b")])).collect()]
    assert all(math.isclose(g, 1 / (1 + math.exp(-x))) for g, x in zip(got, (1.0, -1.0, -0.75), strict=True))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("held", held_out("doc_id", 4))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = q.train(docs.where("not held"), labels)
    assert 0 < len(model.weights) < 100  # the lasso leaves few rules
    found = q.predict(docs.where("held").join(labels, "doc_id"), model).select("row.quality", "score").toPandas()
    assert ((found.score >= q.PASSED) == (found.quality == 1)).mean() > 0.95


def test_messy_rows(spark):
    docs = messy(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (8, 7)], "doc_id bigint, quality int")
    model = q.train(docs, labels)
    found = q.predict(docs, model).select("row.text", "score").collect()
    assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 for r in found)
    one = q.train(docs, labels.where("quality = 1"))
    assert {r.score for r in q.predict(docs, one).select("score").collect()} == {1.0}
    none = q.train(docs, labels.limit(0))
    assert {r.score for r in q.predict(docs, none).select("score").collect()} == {0.5}
    assert q.predict(messy(spark, empty=True), none).count() == 0
