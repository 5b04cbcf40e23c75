"""Queries of food matching: a small food table and small vectors are made from the words of parts, so that SQL can say what matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import foods as O
from .operators.amounts import Options
from .plans import parse as P

#: Vectors of two numbers for stems, by rule from a word's place in this list.
_STEMS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget", "blue", "cold", "hot", "larg", "new", "old", "red", "small", "metal", "raw"]
_ADJECTIVES = ["cold", "hot", "large", "red", "small"]  # those that the rule tagger knows


def _vector(i: int) -> tuple[float, float]:
    return (i * 7 % 11 + 1) / 4, (i * 5 % 13 + 1) / 8


def _foods(spark, sf_dir) -> DataFrame:
    """The parts' distinct names as foods: noun first, every food of metal, some raw."""
    words = F.split("p_name", " ")
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(words[0].alias("a"), words[1].alias("n")).distinct()
    said = F.concat(F.col("n"), F.lit(", "), F.col("a"), F.lit(", metal"), F.when(F.col("a").isin("new", "red"), ", raw").otherwise(""))
    number = F.array_position(F.array(*[F.lit(x) for x in _STEMS]), F.when(F.col("a") == "large", "larg").otherwise(F.col("a"))) * 100
    number = number + F.array_position(F.array(*[F.lit(x) for x in _STEMS]), F.col("n"))
    kind = F.when(F.col("a") < "h", "sr_legacy_food").otherwise("foundation_food")
    return names.select(number.cast("int").alias("fdc_id"), kind.alias("data_type"), said.alias("description"), F.lit("metal").alias("category"))


def _index(spark, sf_dir, words: list[str]) -> O.FoodIndex:
    rows = [(w, list(_vector(i))) for i, w in enumerate(_STEMS) if w in words]
    return O.FoodIndex(_foods(spark, sf_dir), spark.createDataFrame(rows, "token string, vec array<float>"))


def _names(spark, sf_dir, tokens, tags) -> DataFrame:
    words = F.split("p_name", " ")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", words[0].alias("a"), words[1].alias("n"))
    return parts.select(F.col("p_partkey").cast("string").alias("key"), tokens.alias("tokens"), tags.alias("tags"))


def food_overrides(spark, sf_dir):
    """Names with one food: misleading adjectives go, hyphens split, other spellings count."""
    cases = [["hot", "pepper"], ["sea", "salt"], ["plain", "flour"], ["caster-sugar"], ["Eggs"]]
    turn = (F.col("p_partkey") % 6 + 1).cast("int")
    given = F.array(*[F.array(*[F.lit(w) for w in c]) for c in cases], F.array("a", "n"))
    tags = F.array(*[F.array(*[F.lit("JJ" if w == "hot" else "NN") for w in c]) for c in cases], F.array(F.lit("NN"), F.lit("NN")))
    found = O.match_foods(_names(spark, sf_dir, F.element_at(given, turn), F.element_at(tags, turn)), None)
    return found.select(F.col("key").cast("bigint").alias("p_partkey"), "text", "fdc_id", "confidence")


def foods_by_words(spark, sf_dir):
    """Names without a vector: the best food by words, towards raw ones."""
    index = _index(spark, sf_dir, ["metal"])
    found = O.match_foods(_names(spark, sf_dir, F.array("n"), F.array(F.lit("NN"))), index)
    return found.select(F.col("key").cast("bigint").alias("p_partkey"), "fdc_id", "text", "data_type")


def food_vectors(spark, sf_dir):
    """Embeddings of foods: weights fall with a token's frequency, by tag, and from phrase to phrase."""
    made = _index(spark, sf_dir, _STEMS).table
    rows = [(i, *(float(x) for x in v)) for i, v in zip(made.ids, made.matrix)]
    return spark.createDataFrame(rows, "fdc_id int, x double, y double").select("fdc_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def foods_by_vectors(spark, sf_dir):
    """The nearest foods by cosine distance of embeddings, for the names of parts."""
    made = _index(spark, sf_dir, _STEMS).table
    out = []
    for n, noun in enumerate(_STEMS[:8]):
        distance, near = made.nearest(made.vectors.embed([noun], ["NN"], [1.0]))
        out += [(noun, made.ids[i], float(round(d, 4))) for i, d in near[:1]]
        del n, distance
    return spark.createDataFrame(out, "noun string, fdc_id int, distance double").select("noun", F.round("distance", 3).alias("distance"))


def food_matches(spark, sf_dir):
    """Records of sentences with their foods, all rankers together."""
    index = _index(spark, sf_dir, _STEMS)
    said = F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("cups"), F.col("p_name"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", said.alias("sentence"))
    parsed = P.parse(rows, options=Options(foundation_foods=True), foods=index, partitions=spark.sparkContext.defaultParallelism)
    return parsed.select("p_partkey", F.transform("parsed.foundation_foods", lambda f: F.struct(f["fdc_id"], f["text"], f["name_index"], f["url"])).alias("foods"))


QUERIES = {f.__name__: f for f in (food_overrides, foods_by_words, food_vectors, foods_by_vectors, food_matches)}

_LIST = "[" + ", ".join(f"'{w}'" for w in _STEMS) + "]"
_FOOD = f"""w as (select distinct string_split(p_name, ' ')[1] a, string_split(p_name, ' ')[2] n from part),
f as (select list_position({_LIST}, case a when 'large' then 'larg' else a end) * 100 + list_position({_LIST}, n) fdc_id, a, n, n || ', ' || a || ', metal' || case when a in ('new', 'red') then ', raw' else '' end text,
  [n, case a when 'large' then 'larg' else a end, 'metal'] || case when a in ('new', 'red') then ['raw'] else [] end tokens, case when a < 'h' then 'sr_legacy_food' else 'foundation_food' end data_type from w)"""
_X = "map {" + ", ".join(f"'{w}': [{_vector(i)[0]}, {_vector(i)[1]}]" for i, w in enumerate(_STEMS)) + "}"
_EMBEDDED = f"""{_FOOD},
t as (select fdc_id, unnest(tokens) token, generate_subscripts(tokens, 1) place, a from f),
c as (select token, count(*) / (select count(*) from t)::double p from t group by token),
s as (select count(*) size, (select count(*) // (select count(*) from f) from t) usual from c),
al as (select count(*) filter (p > 1 - pow(1 - 1 / size::double, usual)) / any_value(size)::double alpha, any_value(size) size from c, s),
aa as (select case when alpha > 0 then (1 - alpha) / (alpha * 0.5 * size) else 1 end a from al),
k as (select fdc_id, token, {_X}[token][1]::double x, {_X}[token][2]::double y, (1 - (place - 1) * 0.001::double) * aa.a / (0.5 * aa.a + c.p)
  * case when place = 2 and t.a in ({', '.join(repr(x) for x in _ADJECTIVES)}) or token = 'raw' then 1.05::double else 1.2::double end coef from t join c using (token), aa)"""

SQL = {
    "food_overrides": """select p_partkey, (['Spices, pepper, black', 'Salt, table, iodized', 'Flour, wheat, all-purpose, unenriched, unbleached', 'Sugar, NFS', 'Eggs, Grade A, Large, egg whole'])[(p_partkey % 6 + 1)::int] text,
  ([170931, 746775, 790018, 2710257, 748967])[(p_partkey % 6 + 1)::int] fdc_id, 1.0::double confidence from part where p_partkey % 6 < 5""",
    "foods_by_words": f"""with {_FOOD}, t as (select fdc_id, unnest(tokens) token, len(tokens) dl from f), av as (select avg(len(tokens)) avgdl, count(*) n from f),
i as (select token, ln((select n from av) / count(*)) idf from t group by token),
sc as (select q.n, t.fdc_id, sum(idf * 2.5 / (1.5 * (0.25 + 0.75 * dl / avgdl) + 1)) score from (select distinct n from f) q join t on t.token in (q.n, 'raw') join i using (token), av group by all
  having bool_or(t.token = q.n)),
b as (select n, arg_min(fdc_id, (-round(score, 9), fdc_id)) fdc_id from sc group by n)
select p_partkey, f.fdc_id::int fdc_id, text, data_type from part join b on b.n = string_split(p_name, ' ')[2] join f on f.fdc_id = b.fdc_id""",
    "food_vectors": f"""with {_EMBEDDED} select fdc_id::int fdc_id, round(sum(coef * x) / sqrt(sum(x * x)) / count(*), 4) x, round(sum(coef * y) / sqrt(sum(y * y)) / count(*), 4) y from k group by fdc_id""",
    "foods_by_vectors": f"""with {_EMBEDDED}, v as (select fdc_id, sum(coef * x) / sqrt(sum(x * x)) / count(*) x, sum(coef * y) / sqrt(sum(y * y)) / count(*) y from k group by fdc_id)
select q.n noun, round(min(1 - (x + y) / (sqrt(2::double) * sqrt(x * x + y * y))), 3) distance from (select distinct n from w) q, v group by q.n""",
}
