"""Parsed records as JSON lines: fractions as ``{"__fraction__": [n, d]}``, units by name, keys in snake case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quantity(q: Column) -> Column:
    fraction = F.concat(F.lit('{"__fraction__":['), q["num"].cast("string"), F.lit(","), q["den"].cast("string"), F.lit("]}"))
    number = q["value"].cast("string")
    return F.when(q["num"].isNotNull(), fraction).when(q["text"].isNotNull(), F.to_json(F.array(q["text"])).substr(F.lit(2), F.length(F.to_json(F.array(q["text"]))) - 2)).otherwise(number)


def _text(c: Column) -> Column:
    return F.coalesce(F.to_json(c), F.lit("null"))


def _part(a: Column) -> Column:
    unit = F.to_json(F.array(F.coalesce(a["unit"]["name"], a["unit_text"])))
    rest = F.to_json(
        F.struct(*[a[k].alias(k) for k in ("text", "confidence", "starting_index", "unit_system", "APPROXIMATE", "SINGULAR", "RANGE", "MULTIPLIER", "PREPARED_INGREDIENT")])
    )
    return F.concat(
        F.lit('{"quantity":'), _quantity(a["quantity"]), F.lit(',"quantity_max":'), _quantity(a["quantity_max"]), F.lit(',"unit":'), unit.substr(F.lit(2), F.length(unit) - 2), F.lit(","), rest.substr(F.lit(2), F.length(rest) - 1)
    )


def _amount(a: Column) -> Column:
    rest = F.to_json(F.struct(a["join"].alias("join"), a["subtractive"].alias("subtractive")))
    whole = F.concat(F.lit('{"amounts":['), F.array_join(F.transform(a["amounts"], _part), ","), F.lit("],"), rest.substr(F.lit(2), F.length(rest) - 1))
    return F.when(a["kind"] == "composite", whole).otherwise(_part(a["amounts"][0]))


def to_json_lines(parsed: DataFrame, column: str = "parsed") -> DataFrame:
    """One row (value) for each record; ``write.text`` makes a file of it."""
    p = F.col(column)
    lists = [("name", F.to_json(p["name"])), ("foundation_foods", F.to_json(p["foundation_foods"]))]
    texts = [(k, _text(p[k])) for k in ("size", "preparation", "comment", "purpose")]
    amount = F.concat(F.lit("["), F.array_join(F.transform(p["amount"], _amount), ","), F.lit("]"))
    sentence = F.to_json(F.array(p["sentence"]))
    fields = [*lists, ("amount", amount), *texts, ("sentence", sentence.substr(F.lit(2), F.length(sentence) - 2))]
    body = [x for k, v in fields for x in (F.lit(f',"{k}":'), F.coalesce(v, F.lit("null")))]
    joined = F.concat(*body)
    return parsed.select(F.concat(F.lit("{"), joined.substr(F.lit(2), F.length(joined)), F.lit("}")).alias("value"))


def write_json_lines(parsed: DataFrame, path: str, column: str = "parsed") -> None:
    to_json_lines(parsed, column).write.mode("overwrite").text(path)
