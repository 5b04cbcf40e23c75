"""Queries of records, names, texts and amounts: tokens with given labels are built from the words and numbers of parts, so that
what is read from them is known by rule, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import lexicon as L
from .functions import tokenise as T
from .functions.chain import Chain
from .functions.normalise import add_normalised
from .functions.stem import stem
from .functions.tagger import PerceptronTagger
from .operators import sequences as S
from .operators.amounts import Options
from .plans import parse as P

_TOKEN = "array<struct<index:int,text:string,pos_tag:string,label:string,score:double,plural:boolean>>"


def _parts(spark, sf_dir) -> DataFrame:
    words = F.split("p_name", " ")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").alias("s"), words[0].alias("a"), words[1].alias("n"))


def _said(*tokens: tuple) -> Column:
    """An array of labelled tokens from (text, label, tag, score), the last two optional."""
    made = []
    for i, token in enumerate(tokens):
        text, label, tag, score = (*token, *("", 0.5)[len(token) - 2 :])
        made.append(
            F.struct(
                F.lit(i).alias("index"),
                (F.lit(text) if isinstance(text, str) else text.cast("string")).alias("text"),
                F.lit(tag).alias("pos_tag"),
                F.lit(label).alias("label"),
                (score if isinstance(score, Column) else F.lit(float(score))).cast("double").alias("score"),
                F.lit(False).alias("plural"),
            )
        )
    return F.array(*made).cast(_TOKEN)


def _records(spark, sf_dir, *cases: Column, options: Options | None = None) -> DataFrame:
    """Records of parts, with one of the cases each, in turn by p_partkey."""
    said = cases[-1]
    for k, case in enumerate(cases[:-1]):
        said = F.when(F.col("p_partkey") % len(cases) == k, case).otherwise(said)
    rows = _parts(spark, sf_dir).select("p_partkey", F.lit("").alias("sentence"), said.alias("labelled_tokens"))
    return P.build_records(rows, options)


def _case(*cases: str) -> str:
    whens = " ".join(f"when {k} then {c}" for k, c in enumerate(cases))
    return f"case p_partkey % {len(cases)} {whens} end"


def _a() -> Column:
    return F.col("a")


def _n() -> Column:
    return F.col("n")


def _s() -> Column:
    return F.col("s")


def _names(df: DataFrame) -> DataFrame:
    name = F.col("parsed.name")
    return df.select("p_partkey", F.array_join(F.transform(name, lambda x: x["text"]), "|").alias("names"), F.array_join(F.transform(name, lambda x: x["starting_index"].cast("string")), "|").alias("places"))


def names_by_variant(spark, sf_dir):
    """Variants and modifiers of a name, several names, and adjectives that wait for the next name."""
    cases = (
        _said((_a(), "NAME_MOD"), ("beef", "NAME_VAR"), ("or", "NAME_SEP"), ("chicken", "NAME_VAR"), (_n(), "B_NAME_TOK")),
        _said(("large", "B_NAME_TOK", "JJ"), ("or", "NAME_SEP", "CC"), ("small", "B_NAME_TOK", "JJ"), (_n(), "I_NAME_TOK", "NN")),
        _said((_a(), "B_NAME_TOK", "JJ"), (_n(), "I_NAME_TOK", "NN"), ("or", "NAME_SEP", "CC"), ("oil", "B_NAME_TOK", "NN")),
        _said((_a(), "NAME_MOD", "NN"), (_n(), "B_NAME_TOK", "NN"), ("raw", "NAME_MOD", "NN"), ("oil", "B_NAME_TOK", "NN")),
    )
    return _names(_records(spark, sf_dir, *cases))


def names_as_one(spark, sf_dir):
    case = _said((_a(), "B_NAME_TOK"), ("or", "NAME_SEP"), (_n(), "B_NAME_TOK"))
    return _names(_records(spark, sf_dir, case, options=Options(separate_names=False)))


def names_repeated(spark, sf_dir):
    """Equal names become one, with the mean of their confidences."""
    key = F.col("p_partkey")
    df = _records(spark, sf_dir, _said((_n(), "B_NAME_TOK", "NN", key % 8 / 8), (",", "PUNC"), (_n(), "B_NAME_TOK", "NN", (key + 3) % 8 / 8)))
    one = F.col("parsed.name")
    return df.select("p_partkey", F.size(one).alias("n"), one[0]["text"].alias("name"), one[0]["confidence"].alias("confidence"))


def text_assembly(spark, sf_dir):
    """Preparation in brackets, a comment in two places, an opening bracket without its match."""
    cases = (
        _said((_n(), "B_NAME_TOK"), (",", "PUNC"), ("(", "PUNC"), ("chopped", "PREP"), (",", "PUNC"), (_a(), "PREP"), (")", "PUNC")),
        _said((_a(), "COMMENT", "JJ", 0.25), (_s(), "QTY"), ("cup", "UNIT"), (_a(), "COMMENT", "JJ", 0.75), (_n(), "B_NAME_TOK")),
        _said((_n(), "B_NAME_TOK"), ("(", "PUNC"), ("sliced", "PREP"), (",", "PUNC")),
    )
    p = F.col("parsed")
    return _records(spark, sf_dir, *cases).select(
        "p_partkey", p["preparation"]["text"].alias("preparation"), p["comment"]["text"].alias("comment"), p["comment"]["confidence"].alias("confidence"), p["comment"]["starting_index"].alias("place")
    )


def stop_words_alone(spark, sf_dir):
    cases = (_said(("of", "COMMENT"), (_n(), "B_NAME_TOK")), _said(("of", "COMMENT"), (_a(), "COMMENT"), (_n(), "B_NAME_TOK")))
    dropped = _records(spark, sf_dir, *cases).select("p_partkey", F.col("parsed.comment.text").alias("dropped"))
    kept = _records(spark, sf_dir, *cases, options=Options(discard_isolated_stop_words=False)).select("p_partkey", F.col("parsed.comment.text").alias("kept"))
    return dropped.join(kept, "p_partkey")


def _flags(df: DataFrame) -> DataFrame:
    named = ("APPROXIMATE", "SINGULAR", "PREPARED_INGREDIENT")
    one = lambda x: F.concat(*[F.when(x["amounts"][0][f], f[0]).otherwise("-") for f in named])
    return df.select("p_partkey", F.array_join(F.transform("parsed.amount", one), "|").alias("flags"))


def prepared_side(spark, sf_dir):
    """An amount on the far side of the preparation is one of the prepared ingredient."""
    cases = (
        _said((_s(), "QTY"), ("cup", "UNIT"), (_n(), "B_NAME_TOK"), (",", "PUNC"), ("chopped", "PREP"), (",", "PUNC"), (_s() + 1, "QTY"), ("cup", "UNIT")),
        _said((_s(), "QTY"), ("cup", "UNIT"), ("chopped", "PREP"), (_n(), "B_NAME_TOK"), (_s() + 1, "QTY"), ("cup", "UNIT")),
    )
    return _flags(_records(spark, sf_dir, *cases))


def each_and_about(spark, sf_dir):
    cases = (
        _said((_s(), "QTY"), ("cup", "UNIT"), ("each", "COMMENT"), (_n(), "B_NAME_TOK")),
        _said((_n(), "B_NAME_TOK"), ("each", "COMMENT"), ("about", "COMMENT"), (_s(), "QTY"), ("cup", "UNIT")),
        _said((_n(), "B_NAME_TOK"), ("to", "COMMENT"), ("yield", "COMMENT"), (_s(), "QTY"), ("cup", "UNIT")),
        _said(("to", "COMMENT"), ("make", "COMMENT"), ("about", "COMMENT"), (_s(), "QTY"), ("cup", "UNIT")),
        _said((_s(), "QTY"), ("cup", "UNIT"), ("or", "COMMENT"), ("so", "COMMENT"), (_n(), "B_NAME_TOK")),
    )
    return _flags(_records(spark, sf_dir, *cases))


_WORDS = {"two": 2, "three": 3, "seven": 7, "eleven": 11}


def _picked(words, key: str = "p_partkey") -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.col(key), F.lit(len(words))) + 1).cast("int"))


def _sql_picked(words, key: str = "p_partkey") -> str:
    return f"([{', '.join(repr(w) for w in words)}])[({key} % {len(words)} + 1)::int]"


def number_words(spark, sf_dir):
    """Number words and halves joined by ``and`` are one quantity, a rational."""
    df = _records(spark, sf_dir, _said((_picked(_WORDS), "QTY"), ("and", "QTY"), ("1/2", "QTY"), ("cup", "UNIT"), (_n(), "B_NAME_TOK")))
    q = F.col("parsed.amount")[0]["amounts"][0]
    return df.select("p_partkey", q["quantity"]["num"].alias("num"), q["quantity"]["den"].alias("den"), q["text"].alias("said"))


def fraction_values(spark, sf_dir):
    cases = (
        _said((F.concat(_s(), F.lit("#3$4")), "QTY"), ("cup", "UNIT"), (_n(), "B_NAME_TOK")),
        _said((F.concat(_s(), F.lit("-"), _s(), F.lit("#1$2")), "QTY"), ("cup", "UNIT"), (_n(), "B_NAME_TOK")),
    )
    q = F.col("parsed.amount")[0]["amounts"][0]
    return _records(spark, sf_dir, *cases).select(
        "p_partkey", *[q[side][part].alias(f"{name}_{part}") for side, name in (("quantity", "low"), ("quantity_max", "high")) for part in ("num", "den")], q["RANGE"].alias("is_range")
    )


def composite_fields(spark, sf_dir):
    """Text, confidence, place and system of a composite amount, and its sum in the first part's unit."""
    cases = (
        _said((_s(), "QTY", "", 0.5), ("lb", "UNIT", "", 0.5), (_s() + 3, "QTY", "", 0.25), ("oz", "UNIT", "", 0.25), (_n(), "B_NAME_TOK")),
        _said((_s() + 2, "QTY"), ("cup", "UNIT"), ("minus", "COMMENT"), (_s() + 1, "QTY"), ("tablespoon", "UNIT"), (_n(), "B_NAME_TOK")),
    )
    df = P.combine_amounts(_records(spark, sf_dir, *cases))
    a = F.col("amount")
    return df.select("p_partkey", a["text"].alias("said"), a["confidence"].alias("confidence"), a["starting_index"].alias("place"), a["unit_system"].alias("system"), "unit", F.round("combined", 6).alias("combined"))


def unit_words(spark, sf_dir):
    """Units of two words, misread words, units of thousandths and products of units."""
    cases = (
        _said((_s() + 1, "QTY"), ("fl", "UNIT"), ("oz", "UNIT"), (_n(), "B_NAME_TOK")),
        _said((_s() + 1, "QTY"), ("tin", "UNIT"), (_n(), "B_NAME_TOK")),
        _said((_s() + 1, "QTY"), ("mg", "UNIT"), (_n(), "B_NAME_TOK")),
        _said((_s() + 1, "QTY"), ("gram", "UNIT"), ("cup", "UNIT"), (_n(), "B_NAME_TOK")),
    )
    q = F.col("parsed.amount")[0]["amounts"][0]
    return _records(spark, sf_dir, *cases).select("p_partkey", q["unit"]["name"].alias("unit"), q["unit"]["dimension"].alias("dimension"), q["unit_text"].alias("said"))


def unit_options(spark, sf_dir):
    """Units as strings, units of another region, and units of one's own."""
    case = _said((_s() + 1, "QTY"), ("cup", "UNIT"), (_n(), "B_NAME_TOK"))
    q = F.col("parsed.amount")[0]["amounts"][0]
    found = _parts(spark, sf_dir).select("p_partkey")
    for name, options in (("strings", Options(string_units=True)), ("imperial", Options(volumetric_units_system="imperial")), ("japanese", Options(volumetric_units_system="japanese"))):
        df = _records(spark, sf_dir, case, options=options).select("p_partkey", q["unit_text"].alias(name), q["unit_system"].alias(f"{name}_system"))
        found = found.join(df, "p_partkey")
    own = _parts(spark, sf_dir).select("p_partkey", F.concat_ws(" ", (_s() + 1).cast("string"), F.lit("snargs"), _a(), _n()).alias("sentence"))
    own = P.parse(own, options=Options(custom_units={"snargs": "snarg"})).select("p_partkey", q["unit_text"].alias("own"), q["text"].alias("own_said"))
    return found.join(own, "p_partkey")


def guessed_name(spark, sf_dir):
    """A sentence without a name gets its likeliest stretch as one where that is asked for."""
    rows = _parts(spark, sf_dir).select("p_partkey", F.concat_ws(" ", _s().cast("string"), F.lit("cups")).alias("sentence"))
    plain = P.parse(rows, options=Options(expect_name_in_output=False)).select("p_partkey", F.size("parsed.name").alias("n_names"))
    many = P.parse_many(spark, ["1 cup oil", "", "2 cups oil"]).select(F.col("sentence_id").alias("p_partkey"), F.get("parsed.amount", F.lit(0))["text"].alias("said"))
    return plain.join(many, "p_partkey", "left")


# Path search, marginals and confidences of a small chain with weights by rule.
_LABELS = ["A", "B", "C"]
_NAME_LABELS = ["B_NAME_TOK", "I_NAME_TOK", "NAME_SEP", "QTY"]


def _state_weight(i: int, j: int) -> int:
    return (i * 7 + j * 3) % 11 - 5


def _step_weight(i: int, j: int) -> int:
    return (i * 5 + j * 2) % 7 - 3


def small_chain(labels: list[str]) -> Chain:
    places = range(len(labels))
    state = {(f"x{i}", labels[j]): _state_weight(i, j) for i in range(5) for j in places}
    return Chain(labels, state, {(labels[i], labels[j]): _step_weight(i, j) for i in places for j in places})


def _observed(spark, sf_dir, n: int) -> DataFrame:
    key = F.col("p_partkey")
    found = F.array(*[F.array(F.concat(F.lit("x"), (F.floor(key / 5**t) % 5).cast("string"))) for t in range(n)])
    return _parts(spark, sf_dir).select("p_partkey", found.alias("attributes"))


def viterbi_small(spark, sf_dir):
    found = P.label_sequences(_observed(spark, sf_dir, 3), small_chain(_LABELS))
    return found.select("p_partkey", F.array_join("labels", "").alias("path"), F.transform("scores", lambda x: F.round(x, 9))[1].alias("middle"))


def viterbi_of_names(spark, sf_dir):
    """No name goes on that didn't begin."""
    found = P.label_sequences(_observed(spark, sf_dir, 2), small_chain(_NAME_LABELS))
    return found.select("p_partkey", F.array_join("labels", ">").alias("path"))


def marginals_small(spark, sf_dir):
    found = P.label_sequences(_observed(spark, sf_dir, 3), small_chain(_LABELS))
    m = F.col("marginals")
    return found.select("p_partkey", *[F.round(m[t][j], 9).alias(f"m{t}{j}") for t in range(3) for j in range(3)])


def _enumerated(n: int, labels: list[str]) -> str:
    """SQL: every path of each part with its score."""
    k = len(labels)
    x = [f"(p_partkey // {5**t}) % 5" for t in range(n)]
    state = [f"((({x[t]}) * 7 + j{t} * 3) % 11 - 5)" for t in range(n)]
    step = [f"((j{t} * 5 + j{t + 1} * 2) % 7 - 3)" for t in range(n - 1)]
    froms = ", ".join(["part"] + [f"range({k}) r{t}(j{t})" for t in range(n)])
    return f"select p_partkey, {', '.join(f'j{t}' for t in range(n))}, {' + '.join(state + step)} score from {froms}"


def inside_brackets(spark, sf_dir):
    words = [(_a(), "(", _n(), "x", ")", "y"), ("(", _a(), ")", _n(), "(", "z"), (_a(), ")", "[", _n(), "]", "x"), (_a(), _n(), "x", "y", "z", "w")]
    cases = [F.array(*[F.lit(w) if isinstance(w, str) else w for w in c]) for c in words]
    texts = F.element_at(F.array(*cases), (F.col("p_partkey") % len(cases) + 1).cast("int"))
    inside = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(T.inside_parentheses(F.col("texts"), i), "1").otherwise("0"))
    return _parts(spark, sf_dir).select("p_partkey", texts.alias("texts")).select("p_partkey", F.array_join(inside, "").alias("inside"))


def chunk_phrases(spark, sf_dir):
    """Phrases of several ingredients, examples, dimensions, and where another ingredient begins."""
    n = _s().cast("string")
    cases = [
        F.concat_ws(" ", n, F.lit("cups butter or"), _a(), _n()),
        F.concat_ws(" ", n, F.lit("cups"), _n(), F.lit("such as"), _a(), F.lit("rings")),
        F.concat_ws(" ", n, F.lit("inch piece"), _n()),
        F.concat_ws(" ", n, F.lit("cups"), _n(), F.lit("or 2 cups"), _a(), F.lit("rings")),
    ]
    said = F.element_at(F.array(*cases), (F.col("p_partkey") % 4 + 1).cast("int"))
    found = P.phrases(_parts(spark, sf_dir).select("p_partkey", said.alias("sentence")), partitions=spark.sparkContext.defaultParallelism)
    return found.select("p_partkey", *[F.to_json(F.col("phrases")[k]).alias(k) for k in ("multiple", "splits", "examples", "dimensional")])


def collapsed_ranges(spark, sf_dir):
    n, m = _s().cast("string"), (_s() + 2).cast("string")
    said = F.element_at(F.array(F.concat(n, F.lit(" -  "), m, F.lit(" cups")), F.concat(n, F.lit(" or "), m, F.lit(" cups")), F.concat(n, F.lit("x "), m, F.lit(" cups"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return add_normalised(_parts(spark, sf_dir).select("p_partkey", said.alias("sentence"))).select("p_partkey", "normalised")


def joined_conjunction(spark, sf_dir):
    said = F.concat_ws(" ", _a(), _picked(["and / or", "and/or", "and / nor"]), _n(), F.lit("(x),"))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(T.tokens(said), "|").alias("tokens"))


def token_flags(spark, sf_dir):
    """Capitals, units, punctuation, ambiguous units and dimensions of tokens, and their feature texts."""
    words = F.array(F.initcap(_n()), F.lit("cup"), F.lit("inch"), F.lit(","), F.lit("--"), F.lit("thick"), _s().cast("string"), F.lit("clove"))
    bits = lambda test: F.array_join(F.transform(words, lambda w: F.when(test(w), "1").otherwise("0")), "")
    tests = {"capital": T.is_capitalised, "unit": T.is_unit, "punctuation": T.is_punctuation, "ambiguous": T.is_ambiguous_unit, "dimension": T.is_dimension}
    return _parts(spark, sf_dir).select("p_partkey", *[bits(test).alias(name) for name, test in tests.items()], F.array_join(F.transform(words, lambda w: T.feature_text(w)), " ").alias("features"))


_TAG_WEIGHTS = {
    "bias": {"JJ": 0.5, "NN": 0.25},
    "i pref1 b": {"JJ": 1.5},
    "i suffix ing": {"NN": 2.0},
    "i-1 tag JJ": {"NN": 1.0},
    "i word !DIGITS": {"CD": 5.0},
    "i word !HYPHEN": {"XX": 5.0},
    "i word !YEAR": {"CD": 3.0},
}


def perceptron_tags(spark, sf_dir):
    """An averaged perceptron with given weights: each tag depends on the one before."""
    tagger = PerceptronTagger(_TAG_WEIGHTS, {"plate": "NNP"}, ["NN", "JJ", "CD", "XX"])
    words = F.array(_s().cast("string"), _a(), _n(), F.lit("two-fold"), F.lit("1999"))
    tags = F.udf(lambda w: " ".join(tagger.tag(list(w))), "string", useArrow=True)
    return _parts(spark, sf_dir).select("p_partkey", tags(words).alias("tags"))


#: Words and their stems, by the published rules of the English stemmer.
_STEMS = {"chopped": "chop", "tomatoes": "tomato", "generously": "generous", "skies": "sky", "hopping": "hop", "national": "nation", "relational": "relat", "berries": "berri", "ties": "tie", "knives": "knive"}


def stems(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in _STEMS], "word string").select("word", F.udf(stem, "string", useArrow=True)("word").alias("stem"))
    return _parts(spark, sf_dir).select("p_partkey", _picked(list(_STEMS)).alias("word")).join(F.broadcast(words), "word").select("p_partkey", "stem")


def stop_word_stretches(spark, sf_dir):
    """Stretches of neighbouring stop words: how many of each length."""
    tokens = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("place", "t"))
    found = S.consecutive_runs(tokens.where(S.is_stop_word(F.col("t"))).select("item_id", "place"), "item_id", "place")
    return found.groupBy(F.col("n").alias("length")).agg(F.count("*").alias("stretches"))


QUERIES = {
    f.__name__: f
    for f in (
        names_by_variant, names_as_one, names_repeated, text_assembly, stop_words_alone, prepared_side, each_and_about, number_words, fraction_values, composite_fields,
        unit_words, unit_options, guessed_name, viterbi_small, viterbi_of_names, marginals_small, inside_brackets, chunk_phrases, collapsed_ranges, joined_conjunction,
        token_flags, perceptron_tags, stems, stop_word_stretches,
    )
}

_P = "(select p_partkey, p_size s, string_split(p_name, ' ')[1] a, string_split(p_name, ' ')[2] n from part)"
_PATHS = f"with e as ({_enumerated(3, _LABELS)}), z as (select p_partkey, sum(exp(score::double)) z from e group by 1)"
_TOKENS = r"""regexp_extract_all(text, '[()\[\]{},/:;?!*~]|[^\s()\[\]{},/:;?!*~]+')"""
_SPLIT = f"flatten(list_transform({_TOKENS}, lambda t: case when length(t) > 1 and t like '%.' and not regexp_matches(t, '\\.\\w\\.$') then [left(t, length(t) - 1), '.'] else [t] end))"

SQL = {
    "names_by_variant": f"""select p_partkey, {_case("a || ' beef ' || n || '|' || a || ' chicken ' || n", "'large small ' || n", "a || ' ' || n || '|oil'", "a || ' ' || n || '|' || a || ' raw oil'")} "names",
  {_case("'0|0'", "'0'", "'0|3'", "'0|0'")} places from {_P}""",
    "names_as_one": f"select p_partkey, a || ' or ' || n \"names\", '0' places from {_P}",
    "names_repeated": f"select p_partkey, 1 n, n \"name\", (p_partkey % 8 / 8.0::double + (p_partkey + 3) % 8 / 8.0::double) / 2 confidence from {_P}",
    "text_assembly": f"""select p_partkey, {_case("'(chopped, ' || a || ')'", 'null', "'sliced'")} preparation, {_case('null', 'a', 'null')} comment,
  {_case('null', '0.75::double', 'null')} confidence, {_case('null', '0', 'null')} place from {_P}""",
    "stop_words_alone": f"select p_partkey, {_case('null', chr(39) + 'of ' + chr(39) + ' || a')} dropped, {_case(chr(39) + 'of' + chr(39), chr(39) + 'of ' + chr(39) + ' || a')} kept from {_P}",
    "prepared_side": f"""select p_partkey, {_case("'---|--P'", "'--P|---'")} flags from part""",
    "each_and_about": f"""select p_partkey, {_case("'-S-'", "'AS-'", "'--P'", "'A-P'", "'A--'")} flags from part""",
    "number_words": f"select p_partkey, {_sql_picked(list(_WORDS.values()))} * 2 + 1 num, 2 den, {_sql_picked(list(_WORDS.values()))} || ' 1/2 cups' said from part",
    "fraction_values": f"""select p_partkey, {_case('4 * p_size + 3', 'p_size')} low_num, {_case('4', '1')} low_den, {_case('4 * p_size + 3', '2 * p_size + 1')} high_num, {_case('4', '2')} high_den,
  p_partkey % 2 = 1 is_range from part""",
    "composite_fields": f"""select p_partkey, {_case("p_size || case p_size when 1 then ' lb ' else ' lbs ' end || (p_size + 3) || ' oz'", "(p_size + 2) || ' cups minus ' || (p_size + 1) || ' tablespoons'")} said, {_case('0.375::double', '0.5::double')} confidence,
  0 place, 'us_customary' system, {_case("'pound'", "'cup'")} unit, round({_case('p_size + (p_size + 3) / 16::double', '(p_size + 2) - (p_size + 1) / 16::double')}, 6) combined from part""",
    "unit_words": f"""select p_partkey, {_case("'fluid_ounce'", 'null', "'milligram'", "'cup * gram'")} unit, {_case("'volume'", 'null', "'mass'", "'dimensionless'")} dimension,
  {_case("'fluid_ounce'", "'tins'", "'milligram'", "'cup * gram'")} said from part""",
    "unit_options": """select p_partkey, 'cups' strings, 'other' strings_system, 'imperial_cup' imperial, 'imperial' imperial_system, 'jp_cup' japanese, 'japanese' japanese_system,
  'snargs' own, (p_size + 1) || ' snargs' own_said from part""",
    "guessed_name": """select p_partkey, 0 n_names, case p_partkey when 0 then '1 cup' when 2 then '2 cups' end said from part""",
    "viterbi_small": f"""{_PATHS}, b as (select *, row_number() over (partition by p_partkey order by score desc, j2, j1, j0) r from e)
select p_partkey, chr(65 + j0::int) || chr(65 + j1::int) || chr(65 + j2::int) path,
  round((select sum(exp(e.score::double)) from e where e.p_partkey = b.p_partkey and e.j1 = b.j1) / (select z from z where z.p_partkey = b.p_partkey), 9) middle from b where r = 1""",
    "viterbi_of_names": f"""with e as ({_enumerated(2, _NAME_LABELS)}), b as (select *, row_number() over (partition by p_partkey order by score desc, j1, j0) r from e where j0 <> 1 and (j1 <> 1 or j0 = 0))
select p_partkey, ({_NAME_LABELS!r})[(j0 + 1)::int] || '>' || ({_NAME_LABELS!r})[(j1 + 1)::int] path from b where r = 1""",
    "marginals_small": f"""{_PATHS} select p_partkey, {', '.join(f'round(sum(exp(score::double)) filter (j{t} = {j}) / any_value(z), 9) m{t}{j}' for t in range(3) for j in range(3))}
from e join z using (p_partkey) group by p_partkey""",
    "inside_brackets": f"select p_partkey, {_case(*[repr(x) for x in ('011110', '111010', '011010', '000000')])} inside from part",
    "chunk_phrases": f"""select p_partkey, {_case("'[[2,3,4,5]]'", "'[]'", "'[]'", "'[]'")} multiple, {_case("'[]'", "'[]'", "'[]'", "'[3]'")} splits, {_case("'[]'", "'[[3,4,5,6]]'", "'[]'", "'[]'")} examples,
  {_case("'[]'", "'[]'", "'[[0,1]]'", "'[]'")} dimensional from part""",
    "collapsed_ranges": f"""select p_partkey, p_size || {_case("'-'", "'-'", "'x '")} || (p_size + 2) || ' cups' normalised from part""",
    "joined_conjunction": f"select p_partkey, a || '|' || {_sql_picked(['and/or', 'and/or', 'and|/|nor'])} || '|' || n || '|(|x|)|,' tokens from {_P}",
    "token_flags": f"""select p_partkey, '10000000' capital, '01000001' unit, '00011000' punctuation, '00000001' ambiguous, '00000100' dimension,
  upper(left(n, 1)) || right(n, length(n) - 1) || ' cup inch , -- thick !num clove' features from {_P}""",
    "perceptron_tags": f"""select p_partkey, 'CD ' || 'JJ ' || case when n = 'plate' then 'NNP XX CD' when n in ('bolt') then 'JJ XX CD' else 'NN XX CD' end tags from {_P}""",
    "stems": f"select p_partkey, {_sql_picked(list(_STEMS.values()))} stem from part",
    "stop_word_stretches": f"""with t as (select item_id, unnest(w) t, generate_subscripts(w, 1) i from (select item_id, {_SPLIT} w from benchmark)),
g as (select item_id, i - row_number() over (partition by item_id order by i) g from t where lower(t) in ({', '.join("'" + w.replace("'", "''") + "'" for w in sorted(L.STOP_WORDS))}))
select length, count(*) stretches from (select count(*) length from g group by item_id, g) group by length""",
}
