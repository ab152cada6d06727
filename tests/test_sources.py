import glob
import json

import pytest
from pyspark.sql import functions as F

from reviewmine.operators import profile
from reviewmine.sources import readers, writers
from reviewmine.sources.shared import materialize, shared_folder

REVIEWS = [
    {"review_id": "r1", "user_id": "u1", "business_id": "b1", "stars": 5.0, "useful": 1, "text": "good"},
    {"review_id": "r2", "user_id": "u1", "business_id": "b2", "stars": 4.9, "useful": 0, "text": "emoji \U0001f600"},
    {"review_id": "r3", "user_id": "u2", "business_id": "b1", "stars": 2.0, "useful": 3, "text": None},
    {"review_id": "r4", "user_id": "u3", "business_id": "b3", "stars": 1.0, "useful": 2, "text": ""},
    {"review_id": "r1", "user_id": "u1", "business_id": "b1", "stars": 5.0, "useful": 1, "text": "good"},
]


@pytest.fixture(scope="module")
def reviews(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "review.json"
    path.write_text("\n".join(json.dumps(r) for r in REVIEWS))
    return readers.read_reviews(spark, str(path))


@pytest.fixture(scope="module")
def business(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "business.json"
    rows = [{"business_id": "b1", "state": "AZ", "stars": 3.5}, {"business_id": "b2", "state": "NV", "stars": 4.5}]
    rows += [{"business_id": "b9", "state": "NV", "stars": 1.5}]
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return readers.read_businesses(spark, str(path))


def text_of(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_profile_counts(reviews):
    assert profile.useful_reviews(reviews).first()[:] == (3, 3)
    assert profile.five_star_reviews(reviews).first()[:] == (1, 1)
    assert profile.longest_text(reviews).first()[0] == 7  # an emoji is one character
    assert profile.users_with_text(reviews).first()[0] == 1
    assert profile.distinct_business(reviews).first()[0] == 3
    assert [tuple(r) for r in profile.top_keys(reviews, "business_id").collect()] == [("b1", 2), ("b2", 1)]


def test_profile_json(reviews, tmp_path):
    row = profile.review_profile(reviews)
    writers.write_profile_json(row, str(tmp_path / "out"))
    assert json.loads(text_of(tmp_path / "out")) == {
        "n_review_useful": 3,
        "n_review_5_star": 1,
        "n_characters": 7,
        "n_user": 1,
        "n_business": 3,
        "top20_user": [["u1", 3]],
        "top20_business": [["b1", 2], ["b2", 1]],
    }


def test_state_averages(reviews, business, tmp_path):
    averages = profile.state_average(reviews, business)
    got = [(r.state, round(r.stars, 6)) for r in averages.collect()]
    assert got == [("NV", 4.9), ("AZ", 4.0), (None, 1.0)]
    writers.write_state_averages(averages, str(tmp_path / "out"))
    lines = [line for line in text_of(tmp_path / "out").splitlines() if line != "state,stars"]
    assert lines == ["NV,4.9", "AZ,4.0", ",1.0"]
    two = {r.state: r.stars for r in profile.state_average_of_averages(reviews, business).collect()}
    assert two == {"AZ": 4.0, "NV": 4.9}
    own = {r.state: r.stars for r in profile.state_average_of_business_stars(business).collect()}
    assert own == {"AZ": 3.5, "NV": 3.0}


def test_csv_readers(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    path.write_text("user,business,rating\nu1, b1, 4\nu2,b2 ,2.5\nu1,b1,3\n")
    ratings = readers.read_ratings(spark, str(path)).withColumnRenamed("business_id", "item_id")
    assert sorted((r.user_id, r.item_id, r.rating) for r in ratings.collect())[0] == ("u1", "b1", 3.0)
    latest = {(r.user_id, r.item_id): r.rating for r in profile.latest_ratings(ratings).collect()}
    assert latest == {("u1", "b1"): 3.0, ("u2", "b2"): 2.5}
    path = tmp_path / "pairs.csv"
    path.write_text("user_id,business_id\na,1\nb,2\n")
    assert sorted(map(tuple, readers.read_pairs(spark, str(path)).collect())) == [("a", "1"), ("b", "2")]


def test_broken_json_fails(spark, tmp_path):
    path = tmp_path / "broken.json"
    path.write_text('{"business_id": "b1", "state"')
    with pytest.raises(Exception):
        readers.read_businesses(spark, str(path)).collect()


def test_itemset_report(spark, tmp_path):
    candidates = spark.createDataFrame([(1, ["b"]), (1, ["a"]), (2, ["a", "b"]), (1, ["c"])], "size int, items array<string>")
    frequent = candidates.where("items[0] <> 'c'")
    report = writers.itemset_report(candidates, frequent)
    writers.write_itemset_report(report, str(tmp_path / "out"))
    assert text_of(tmp_path / "out") == (
        "Candidates:\n('a'),('b'),('c')\n\n('a', 'b')\n\nFrequent Itemsets:\n('a'),('b')\n\n('a', 'b')"
    )


def test_graph_text(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 1.5), ("b", "d", 12.0), ("a", "c", 1.5)], "src string, dst string, betweenness double")
    writers.write_betweenness(edges, str(tmp_path / "b"))
    assert text_of(tmp_path / "b") == "('b', 'd'), 12.0\n('a', 'b'), 1.5\n('a', 'c'), 1.5\n"
    members = spark.createDataFrame([("d", "a"), ("e", "a"), ("c", "c"), ("a", "a")], "node string, community string")
    writers.write_communities(members, str(tmp_path / "c"))
    assert text_of(tmp_path / "c") == "'c'\n'a', 'd', 'e'"


def test_large_reports_are_not_cut(spark, tmp_path):
    name = F.format_string("n%05d", "id")
    candidates = spark.range(1001).select(F.lit(1).alias("size"), F.array(name).alias("items"))
    report = writers.itemset_report(candidates, candidates.limit(0))
    writers.write_itemset_report(report, str(tmp_path / "r"))
    assert text_of(tmp_path / "r") == "Candidates:\n" + ",".join(f"('n{i:05d}')" for i in range(1001))
    members = spark.range(1001).select(name.alias("node"), F.lit("n00000").alias("community"))
    writers.write_communities(members, str(tmp_path / "c"))
    assert text_of(tmp_path / "c") == ", ".join(f"'n{i:05d}'" for i in range(1001))


def test_later_line_of_several_files(spark, tmp_path):
    """A later file counts, though its small size puts it into the same task as, or before, a large one."""
    rows = "".join(f"u{i},b{i},1\n" for i in range(20_000))
    (tmp_path / "a.csv").write_text("user,business,rating\nu,b,1\n" + rows)
    (tmp_path / "b.csv").write_text("user,business,rating\n" + rows + rows + "u,b,2\n")
    (tmp_path / "c.csv").write_text("user,business,rating\nu,b,3\nu,b,4\n")
    ratings = readers.read_ratings(spark, str(tmp_path)).where("user_id = 'u'").withColumnRenamed("business_id", "item_id")
    assert [r.rating for r in profile.latest_ratings(ratings).collect()] == [4.0]


def test_pair_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("b", "c", 0.5), ("a", "z", 1.0)], "a string, b string, similarity double")
    writers.write_similar_pairs(pairs, str(tmp_path / "s"))
    lines = [line for line in text_of(tmp_path / "s").splitlines() if not line.startswith("business_id_1")]
    assert lines == ["a,z,1.0", "b,c,0.5"]
    writers.write_predictions(pairs, str(tmp_path / "p"))
    assert "user_id,business_id,prediction" in text_of(tmp_path / "p")


def test_work_tables_use_the_configured_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    kept = materialize(spark.range(5))
    assert kept.count() == 5
    assert all(folder in f for f in kept.inputFiles())
    assert materialize(spark.range(5).where("id > 9")).isEmpty()


def test_positions(spark):
    from reviewmine.functions.ordering import dense_index, listed, running_total

    rows = spark.range(25).select(F.lit("k").alias("k"), (24 - F.col("id")).alias("v"))
    rows = rows.unionByName(rows).unionByName(spark.createDataFrame([("z", 7)], "k string, v long"))
    got = sorted(map(tuple, listed(rows, "k", "v").collect()))
    assert got == [*(("k", i, i) for i in range(25)), ("z", 0, 7)]
    ids = dense_index(spark.range(0, 300, 3).union(spark.range(0, 300, 3)), "id")
    assert sorted(map(tuple, ids.collect())) == [(3 * i, i) for i in range(100)]
    sums = running_total(spark.range(1, 101).withColumn("x", F.col("id")), "x", "id", name="s")
    assert all(r.s == r.id * (r.id + 1) // 2 for r in sums.collect())
