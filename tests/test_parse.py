import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder import Options, inspect, parse, parse_many, record_queries
from larder.operators import foods as FD
from larder.plans.parse import build_records, check_options, phrases, register_sql
from larder.sources.models import Models, read_foods, read_glove
from larder.sources.records import to_json_lines


def test_parse_keeps_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "2 cups flour", "a", 5), (1, "2 cups flour", "a", 5), (2, None, "b", None), (3, "", "c", 7)], "id int, sentence string, parsed_by string, tokens int")
    rows = parse(df).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 1, 2, 3] and rows[0].tokens == 5
    assert rows[0].parsed.amount[0].text == "2 cups" and rows[0].parsed.name[0].text == "flour"
    assert rows[2].parsed.name == [] and rows[2].parsed.sentence is None
    assert parse(df.limit(0)).count() == 0


def test_options(spark):
    with pytest.raises(ValueError, match="language"):
        check_options(None, "xx")
    with pytest.raises(ValueError, match="volumetric"):
        check_options(Options(volumetric_units_system="roman"))
    with pytest.warns(DeprecationWarning):
        assert check_options(Options(imperial_units=True, volumetric_units_system="metric")).volumetric_units_system == "imperial"
    got = parse_many(spark, ["1 cup milk", "3 gizmos milk"], Options(volumetric_units_system="metric", custom_units={"gizmos": "gizmo"})).orderBy("sentence_id").collect()
    assert got[0].parsed.amount[0].amounts[0].unit.name == "metric_cup"
    assert got[1].parsed.amount[0].text == "3 gizmos"


def test_inspect(spark):
    r = inspect(spark.createDataFrame([("1/2 cup chicken broth",)], "sentence string")).first()
    assert r.normalised == "#1$2 cup chicken broth" and r.tokens == ["#1$2", "cup", "chicken", "broth"]
    assert [x.feat_text for x in r.labelled] == ["!num", "cup", "chicken", "broth"]
    assert r.features[1]["prev_stem"] == "!num" and r.features[0]["next_pos_ngram"].startswith("CD+") and r.features[2]["prefix_3"] == "chi"
    assert len(r.marginals) == 4 and sum(r.marginals[0]) == pytest.approx(1, abs=1e-5)


def test_given_labels_and_json(spark):
    tokens = [(0, "2", "CD", "QTY", 1.0, False), (1, "cup", "NN", "UNIT", 1.0, True), (2, "milk", "NN", "B_NAME_TOK", 1.0, False)]
    df = spark.createDataFrame([("2 cups milk", tokens)], "sentence string, labelled_tokens array<struct<index:int,text:string,pos_tag:string,label:string,score:double,plural:boolean>>")
    value = json.loads(to_json_lines(build_records(df)).first().value)
    assert value["amount"][0]["quantity"] == {"__fraction__": [2, 1]} and value["amount"][0]["unit"] == "cup"
    assert value["name"][0]["text"] == "milk" and value["size"] is None


def test_sql_function(spark):
    register_sql(spark)
    row = spark.sql("select parse_ingredient('2cups flour—sifted') p").first()
    assert row.p.amount[0].text == "2 cups" and row.p.name[0].text == "flour" and row.p.sentence == "2cups flour—sifted"
    assert spark.sql("select parse_ingredient(null) p").first().p.amount == []
    row = spark.sql("select parse_ingredient_tokens('2 cups flour', array('2', 'cups', 'flour')) p").first()
    assert row.p.amount[0].text == "2 cups"


def test_stream(spark, tmp_path):
    from larder.streaming import parse_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("2 cups flour\n1 lb 2 oz beef\n")
    query = parse_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("said").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert sorted(r.t for r in spark.sql("select parsed.amount[0].text t from said").collect()) == ["1 lb 2 oz", "2 cups"]


def test_sources(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "v.txt.gz", "wt") as f:
        f.write("2 3\nsalt 1 0 0\nmilk 0 1 0.5\n")
    assert {r.token: list(r.vec) for r in read_glove(spark, str(tmp_path / "v.txt.gz")).collect()} == {"salt": [1, 0, 0], "milk": [0, 1, 0.5]}
    (tmp_path / "f.csv").write_text('fdc_id,data_type,description,category\r\n7,foundation_food,"Milk, ""whole""",Dairy\r\n')
    assert read_foods(spark, str(tmp_path / "f.csv")).first().description == 'Milk, "whole"'


FOODS = [(1, "foundation_food", "Milk, whole", "Dairy"), (2, "sr_legacy_food", "Milk, coconut, canned", "Nuts"), (3, "foundation_food", "Beans, dry", "Legumes"), (4, "foundation_food", "Qqq", "None")]


def test_foods(spark):
    words = ["milk", "whole", "coconut", "can", "bean", "dri", "raw"]
    vectors = spark.createDataFrame([(w, [float(x) for x in np.eye(len(words))[i] + 0.1]) for i, w in enumerate(words)], "token string, vec array<float>")
    index = FD.FoodIndex(spark.createDataFrame(FOODS, "fdc_id int, data_type string, description string, category string"), vectors)
    assert index.table.ids == [1, 2, 3]  # the last has no known token
    names = [("a", ["coconut", "milk"], ["NN", "NN"]), ("b", ["sea", "salt"], ["NN", "NN"]), ("c", ["xyzzy"], ["NN"]), ("d", [], [])]
    got = {r.key: r for r in FD.match_foods(spark.createDataFrame(names, "key string, tokens array<string>, tags array<string>"), index).collect()}
    assert got["a"].fdc_id == 2 and got["b"].fdc_id == 746775 and "c" not in got and "d" not in got
    row = parse_many(spark, ["2 tsp salt"], Options(foundation_foods=True)).first()
    assert row.parsed.foundation_foods[0].fdc_id == 746775 and row.parsed.foundation_foods[0].url.endswith("746775/nutrients")


def test_food_helpers():
    assert FD.usual_spelling([("plain", "JJ"), ("flour", "NN"), ("water", "NN")]) == [("all", "JJ"), ("purpos", "JJ"), ("flour", "JJ"), ("tap", "NN"), ("water", "NN")]
    assert FD.without_misleading([("hot", "JJ"), ("milk", "NN")]) == [("milk", "NN")]
    assert FD.without_misleading([("hot", "JJ")]) == [("hot", "JJ")]
    assert FD.agreement([1, 2], [1, 2]) == pytest.approx(0.05 * (0.95 + 0.9025))
    assert FD.normalised([1, 1]) == [0.5, 0.5] and FD.normalised([1, 2, 3]) == [0, 0.5, 1]
    assert FD.confidence([1.0]) == 0 and FD.confidence([1.0, 0.0]) == pytest.approx(1.0)
    ranked = FD.fused([(0, 2.0), (1, 1.0)], [], [(1, 0.1), (0, 0.3)], ["sr_legacy_food", "foundation_food"])
    assert [i for i, _ in ranked] == [1, 0] and ranked[0][1] == ranked[1][1]  # equal scores: by dataset


def test_fuzzy_distance_of_equals_is_zero():
    vectors = {"a": np.array([1.0, 0], np.float32), "b": np.array([0, 1.0], np.float32)}
    assert FD.fuzzy_distance(["a"], ["a"], vectors) == 0 and 0 < FD.fuzzy_distance(["a"], ["b"], vectors) < 1


def test_command_line(capsys):
    from larder.__main__ import main

    assert main([]) == 1 and "usage" in capsys.readouterr().err.lower()
    assert main(["-h"]) == 0
    capsys.readouterr()
    assert main(["2 cups flour"]) == 0
    assert json.loads(capsys.readouterr().out)["amount"][0]["text"] == "2 cups"
    assert main(["2 cups flour", "1 egg"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 2


def test_phrases_alone_are_those_of_inspect_and_need_no_labels(spark):
    said = ["2 cups butter or olive oil", "1 cup herbs such as thyme", "3 inch piece ginger", "1 tin or 2 cups beans", "", None]
    df = spark.createDataFrame(list(enumerate(said)), "n int, sentence string")
    want = {r.n: r.phrases for r in inspect(df).select("n", "phrases").collect()}

    class Unlabelled(Models):
        def chain(self):
            raise AssertionError("labels aren't needed")

    for partitions in (None, 3):
        found = phrases(df, models=Unlabelled(), partitions=partitions)
        assert found.columns == ["n", "sentence", "phrases"]
        assert {r.n: r.phrases for r in found.collect()} == want
    assert want[0].multiple and want[1].examples and want[2].dimensional and want[3].splits and want[4] is None


def test_phrases_query_deals_out_its_rows(spark, tmp_path):
    """A table of one small file isn't left to one task."""
    rows = spark.range(4000).selectExpr("id p_partkey", "cast(id % 50 as int) p_size", "'green bolt' p_name")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = record_queries.chunk_phrases(spark, str(tmp_path))
    assert found.count() == 4000
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == spark.sparkContext.defaultParallelism
