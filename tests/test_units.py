import math

import pytest
from pyspark.sql import functions as F

from larder.functions import units as U


def test_lookup_and_regions():
    assert U.get_unit("tbsp").name == "tablespoon" and U.get_unit("TBSP") is None
    assert U.unit_for("cup", "japanese").name == "jp_cup" and U.unit_for("cup", "us_customary").name == "cup"
    assert U.unit_for("pint", "metric").name == "pint"


@pytest.mark.parametrize(
    ("text", "system", "want"),
    [("fl oz", "us_customary", "fluid_ounce"), ("fl oz", "imperial", "imperial_fluid_ounce"), ("C", "metric", "metric_cup"), ("G", "us_customary", "gram"), ("oz", "imperial", "imperial_ounce")],
)
def test_to_unit(text, system, want):
    assert U.to_unit(text, system).name == want


@pytest.mark.parametrize("text", ["", "bag", "pinch", "Tin", "cup-size", "large handful"])
def test_unknown_units_stay_texts(text):
    assert U.to_unit(text) == text


def test_products_and_prefixes():
    found = U.parse_unit_expression("pint fluid_ounce")
    assert found.name == "fluid_ounce * pint" and math.isnan(found.si_factor)
    assert U.parse_unit_expression("kcup").name == "kilocup" and U.parse_unit_expression("cup bag") is None


def test_conversion():
    assert U.convert(1, U.get_unit("kg"), "g")[0] == pytest.approx(1000)
    assert U.convert(1, U.get_unit("cup"), "gram")[0] == pytest.approx(236.5882365)
    assert U.convert(1, U.get_unit("cup"), "gram", 500)[0] == pytest.approx(118.29411825)
    assert U.convert(236.5882365, U.get_unit("gram"), "cup")[0] == pytest.approx(1)
    with pytest.raises(ValueError, match="Unknown unit"):
        U.convert(1, U.get_unit("cup"), "nothing")


@pytest.mark.parametrize(
    ("unit", "want"),
    [("", "none"), ("cup", "us_customary"), ("imperial_cup", "imperial"), ("metric_cup", "metric"), ("jp_cup", "japanese"), ("aus_pint", "australian"), ("gram", "metric"), ("gallon", "other"), ("bag", "other")],
)
def test_systems(spark, unit, want):
    assert U.unit_system(unit) == want
    assert spark.range(1).select(U.system_of(F.lit(unit))).first()[0] == want


def test_columns_agree_with_the_registry(spark):
    table = U.unit_table(spark)
    wrong = table.where(~U.resolve_name(F.col("alias"), F.col("system")).eqNullSafe(F.col("name")) | (U.si_factor(F.col("name")) != F.col("si_factor")))
    assert table.count() == len(U.REGISTRY) * len(U.SYSTEMS) and wrong.count() == 0


def test_plurals():
    assert U.plural_units("2 cup") == "2 cups"
    assert U.plural_units("1 loaf", {"loafs": "loaf"}) == "1 loaves"
    assert U.plural_units("cupcake") == "cupcake"
