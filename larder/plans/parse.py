"""The public plans: parse and inspect sentences of a DataFrame, batch or streaming.

Normalising and tokenising are column expressions. Tags, features, labels and the record need the state of a whole
sentence, so they share one crossing into Python, in Arrow batches. Nothing shuffles, but for food matching.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import replace
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import lexicon as L
from ..functions import units as U
from ..functions.chain import Chain, guess_name
from ..functions.features import Sentence, attributes
from ..functions.normalise import add_normalised, normalise_text
from ..functions.tokenise import tokens
from ..functions.words import tokenise
from ..operators.amounts import Amount, Composite, Labelled, Options
from ..operators.record import Record, RecordBuilder, Text
from ..sources.models import Models

SUPPORTED_LANGUAGES = ("en",)
TEXT = "struct<text:string,confidence:double,starting_index:int>"
QUANTITY = "struct<num:bigint,den:bigint,value:double,text:string>"
UNIT = "struct<name:string,dimension:string,si_factor:double>"
PART = (
    f"struct<quantity:{QUANTITY},quantity_max:{QUANTITY},unit:{UNIT},unit_text:string,text:string,confidence:double,starting_index:int,unit_system:string,"
    "APPROXIMATE:boolean,SINGULAR:boolean,`RANGE`:boolean,MULTIPLIER:boolean,PREPARED_INGREDIENT:boolean>"
)
AMOUNT = f"struct<kind:string,amounts:array<{PART}>,join:string,subtractive:boolean,text:string,confidence:double,starting_index:int,unit_system:string>"
FOOD = "struct<text:string,confidence:double,fdc_id:int,category:string,data_type:string,name_index:int,url:string>"
RECORD = f"struct<name:array<{TEXT}>,size:{TEXT},amount:array<{AMOUNT}>,preparation:{TEXT},comment:{TEXT},purpose:{TEXT},foundation_foods:array<{FOOD}>,sentence:string>"
NAME_TOKENS = "array<struct<name_index:int,tokens:array<string>,tags:array<string>>>"
LABELLED = "array<struct<index:int,text:string,feat_text:string,pos_tag:string,label:string,score:double,plural:boolean>>"


def check_options(options: Options | None, lang: str = "en") -> Options:
    """Errors and the deprecation are raised when the plan is made, before any job runs."""
    options = options or Options()
    if lang not in SUPPORTED_LANGUAGES:
        raise ValueError(f'Unsupported language "{lang}"')
    if options.volumetric_units_system not in U.SYSTEMS:
        raise ValueError(f'Unsupported volumetric_units_system "{options.volumetric_units_system}"')
    if options.imperial_units:
        warnings.warn("imperial_units is deprecated: use volumetric_units_system='imperial'", DeprecationWarning, stacklevel=3)
        options = replace(options, volumetric_units_system="imperial")
    return replace(options, custom_units=L.with_custom_units(options.custom_units))


def label_words(words: list[str], options: Options, models: Models) -> tuple[Sentence, list[Labelled], list[list[float]]]:
    """Tags, features and labels of a tokenised sentence."""
    sentence = Sentence(words, models.tagger(), options.custom_units, models.tagdict())
    chain = models.chain()
    labels, scores, marginals = chain.label([attributes(f) for f in sentence.features()])
    if options.expect_name_in_output and not any("NAME" in x for x in labels):
        labels, scores = guess_name(labels, scores, lambda name, i: float(marginals[i, chain.number[name]]) if name in chain.number else 0.0)
    singular = set(sentence.singularised)
    labelled = [Labelled(t.index, t.text, t.pos_tag, label, score, t.index in singular) for t, label, score in zip(sentence.tokens, labels, scores)]
    return sentence, labelled, marginals.tolist()


def _quantity(q: Fraction | float | str) -> dict:
    if isinstance(q, Fraction):
        small = max(abs(q.numerator), q.denominator) < 1 << 63
        return {"num": q.numerator if small else None, "den": q.denominator if small else None, "value": float(q), "text": None if small else str(q)}
    return {"num": None, "den": None, "value": q if isinstance(q, float) else None, "text": q if isinstance(q, str) else None}


def _part(a: Amount) -> dict:
    known = isinstance(a.unit, U.Unit)
    return {
        "quantity": _quantity(a.quantity),
        "quantity_max": _quantity(a.quantity_max),
        "unit": a.unit._asdict() if known else None,
        "unit_text": a.unit.name if known else a.unit,
        **{k: getattr(a, k) for k in ("text", "confidence", "starting_index", "unit_system", "APPROXIMATE", "SINGULAR", "RANGE", "MULTIPLIER", "PREPARED_INGREDIENT")},
    }


def amount_row(a: Amount | Composite) -> dict:
    whole = isinstance(a, Composite)
    return {
        "kind": "composite" if whole else "plain",
        "amounts": [_part(x) for x in (a.amounts if whole else [a])],
        "join": a.join if whole else None,
        "subtractive": a.subtractive if whole else None,
        **{k: getattr(a, k) for k in ("text", "confidence", "starting_index", "unit_system")},
    }


def record_row(r: Record) -> dict:
    text = lambda t: vars(t) if isinstance(t, Text) else None
    return {
        "name": [text(n) for n in r.name],
        "size": text(r.size),
        "amount": [amount_row(a) for a in r.amount],
        "preparation": text(r.preparation),
        "comment": text(r.comment),
        "purpose": text(r.purpose),
        "foundation_foods": [],
        "sentence": r.sentence,
    }


_EMPTY = Record([], None, [], None, None, None, "")
PHRASES = "struct<multiple:array<array<int>>,splits:array<int>,examples:array<array<int>>,dimensional:array<array<int>>>"
_STAGES = f"labelled {LABELLED}, marginals array<array<double>>, features array<map<string,string>>, phrases {PHRASES}"


def _crossing(df: DataFrame, options: Options, models: Models, stages: bool) -> DataFrame:
    """Adds ``parsed`` and ``name_tokens``, and with ``stages`` what lies between; reads ``sentence`` and ``tokens``."""
    added = f"parsed {RECORD}, name_tokens {NAME_TOKENS}" + (f", {_STAGES}" if stages else "")
    schema = StructType([*df.schema.fields, *_schema(added).fields])

    target = to_arrow_schema(_schema(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for sentence, words in zip(batch["sentence"].to_pylist(), batch["tokens"].to_pylist()):
                rows.append(_row(sentence, words or [], options, models, stages))
            made = [pa.array([r[f.name] for r in rows], f.type) for f in target]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *target.names])

    return df.mapInArrow(run, schema)


def _schema(ddl: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


def _phrases(s: Sentence) -> dict:
    return {"multiple": s.multiple, "splits": s.splits, "examples": s.examples, "dimensional": s.dimensional}


def _row(sentence: str | None, words: list[str], options: Options, models: Models, stages: bool) -> dict:
    if not words:  # a null or blank sentence is an empty record
        empty = {"parsed": record_row(replace(_EMPTY, sentence=sentence)), "name_tokens": []}
        return empty | {"labelled": [], "marginals": [], "features": [], "phrases": None} if stages else empty
    parsed, labelled, marginals = label_words(words, options, models)
    out: dict = {}
    if stages:
        out["labelled"] = [
            {"index": t.index, "text": t.text, "feat_text": s.feat_text, "pos_tag": t.pos_tag, "label": t.label, "score": t.score, "plural": t.plural} for t, s in zip(labelled, parsed.tokens)
        ]
        out["marginals"] = marginals
        out["features"] = [[(k, v if isinstance(v, str) else str(v).lower()) for k, v in f.items()] for f in parsed.features()]
        out["phrases"] = _phrases(parsed)
    record = RecordBuilder(sentence or "", labelled, options).build()
    out["parsed"] = record_row(record)
    out["name_tokens"] = [{"name_index": n, "tokens": t, "tags": g} for n, t, g in record.name_tokens]
    return out


def prepare(df: DataFrame, column: str = "sentence") -> DataFrame:
    """(row, sentence, normalised, tokens): the whole row of ``df`` travels as one struct, so that no name clashes."""
    said = df.select(F.struct("*").alias("row"), F.col(column).cast("string").alias("sentence"))
    return add_normalised(said).withColumn("tokens", tokens(F.col("normalised")))


def parse(
    df: DataFrame, column: str = "sentence", options: Options | None = None, lang: str = "en", models: Models | None = None, foods=None, partitions: int | None = None
) -> DataFrame:
    """``df`` with a column ``parsed``: the record of each sentence. Works on streaming DataFrames too.

    ``foods`` (a ``FoodIndex``) is needed for food matching beyond the built-in overrides. ``partitions`` deals the rows out
    first, for inputs that come in fewer partitions than there are cores.
    """
    options = check_options(options, lang)
    df = df.repartition(partitions) if partitions else df
    crossed = _crossing(prepare(df, column), options, models or Models(), stages=False)
    if options.foundation_foods:
        from ..operators.foods import add_foods

        crossed = add_foods(crossed, foods)
    return crossed.select("row.*", "parsed")


def parse_many(spark: SparkSession, sentences: Iterable[str], options: Options | None = None, **more) -> DataFrame:
    """Records of a list of sentences, with their numbers: ``sentence_id`` keeps the order."""
    rows = [(i, s) for i, s in enumerate(sentences)]
    return parse(spark.createDataFrame(rows, "sentence_id bigint, sentence string"), options=options, **more)


def inspect(df: DataFrame, column: str = "sentence", options: Options | None = None, lang: str = "en", models: Models | None = None) -> DataFrame:
    """Like ``parse``, with every stage: normalised text, tokens, labels, marginals, features and phrases."""
    options = check_options(options, lang)
    crossed = _crossing(prepare(df, column), options, models or Models(), stages=True)
    return crossed.select("row.*", *[c for c in crossed.columns if c not in ("row", "sentence", "name_tokens")])


def phrases(df: DataFrame, column: str = "sentence", options: Options | None = None, lang: str = "en", models: Models | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with the column ``phrases`` of ``inspect`` alone: these need tags, but neither labels nor features nor a record."""
    options, models = check_options(options, lang), models or Models()
    df = df.repartition(partitions) if partitions else df
    said = prepare(df, column).select("row", "tokens")
    added = _schema(f"phrases {PHRASES}")
    target = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_phrases(Sentence(w, models.tagger(), options.custom_units, models.tagdict())) if w else None for w in batch["tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, target[0].type)], ["row", "phrases"])

    return said.mapInArrow(run, StructType([said.schema["row"], *added.fields])).select("row.*", "phrases")


def describe(row) -> str:
    """One row of ``inspect`` as text, stage by stage, for a look at what became of a sentence."""
    words = [f"{t['index']}: {t.text} ({t.feat_text}) {t.pos_tag} {t.label} {t.score:.3f}" for t in row.labelled]
    phrases = [f"{k}: {v}" for k, v in (row.phrases.asDict() if row.phrases else {}).items() if v]
    return "\n".join([f"sentence: {row.sentence}", f"normalised: {row.normalised}", "tokens:", *(f"  {w}" for w in words), *phrases])


def build_records(df: DataFrame, options: Options | None = None, labelled: str = "labelled_tokens", sentence: str = "sentence") -> DataFrame:
    """Records of tokens that are labelled already: ``labelled`` is an array of (index, text, pos_tag, label, score, plural)."""
    options = check_options(options)

    added = _schema(f"parsed {RECORD}, name_tokens {NAME_TOKENS}")
    target = to_arrow_schema(added)

    def run(batches):
        for batch in batches:
            rows = []
            for said, given in zip(batch[sentence].to_pylist(), batch[labelled].to_pylist()):
                fields = ("index", "text", "pos_tag", "label", "score", "plural")
                r = RecordBuilder(said or "", [Labelled(*(t[k] for k in fields)) for t in given or []], options).build()
                rows.append({"parsed": record_row(r), "name_tokens": [{"name_index": n, "tokens": t, "tags": g} for n, t, g in r.name_tokens]})
            made = [pa.array([r[f.name] for r in rows], f.type) for f in target]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *target.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def convert_amounts(df: DataFrame, unit: str, density: float = U.DENSITY, column: str = "parsed") -> DataFrame:
    """Rows (…, amount, converted, converted_max): plain amounts of known quantity and unit, in another unit."""
    plain = df.withColumn("amount", F.explode(f"{column}.amount")).where("amount.kind = 'plain' and amount.amounts[0].unit is not null and amount.amounts[0].quantity.num is not null")
    part = F.col("amount.amounts")[0]
    value = lambda q: part[q]["num"].cast("double") / part[q]["den"]
    return plain.withColumn("converted", U.converted(value("quantity"), part["unit"]["name"], unit, density)).withColumn(
        "converted_max", U.converted(value("quantity_max"), part["unit"]["name"], unit, density)
    )


def combine_amounts(df: DataFrame, density: float = U.DENSITY, column: str = "parsed") -> DataFrame:
    """Rows (…, amount, combined, unit): composite amounts of known quantities and units as one value in their first part's unit."""
    whole = df.withColumn("amount", F.explode(f"{column}.amount")).where("amount.kind = 'composite'")
    whole = whole.where(F.forall("amount.amounts", lambda p: p["unit"].isNotNull() & p["quantity"]["num"].isNotNull()))
    parts = F.col("amount.amounts")
    first = parts[0]["unit"]

    def value(p: Column) -> Column:
        return p["quantity"]["num"].cast("double") / p["quantity"]["den"]

    def in_first(p: Column) -> Column:
        si, to = value(p) * p["unit"]["si_factor"], first["dimension"]
        bridge = F.when(p["unit"]["dimension"] == to, si).when((p["unit"]["dimension"] == "volume") & (to == "mass"), si * density)
        bridge = bridge.when((p["unit"]["dimension"] == "mass") & (to == "volume"), si / density)
        return bridge.otherwise(F.raise_error(F.concat(F.lit("Cannot convert "), p["unit"]["name"])).cast("double")) / first["si_factor"]

    sign = F.when(F.col("amount.subtractive"), -1.0).otherwise(1.0)
    total = F.aggregate(F.slice(parts, 2, F.size(parts)), value(parts[0]), lambda total, p: total + sign * in_first(p))
    return whole.withColumn("combined", total).withColumn("unit", first["name"])


def label_sequences(df: DataFrame, chain: Chain, column: str = "attributes") -> DataFrame:
    """``df`` with labels, their marginals as scores, and all marginals of sequences of attribute sets (an array of arrays of strings)."""
    added = _schema("labels array<string>, scores array<double>, marginals array<array<double>>")
    target = to_arrow_schema(added)

    def run(batches):
        for batch in batches:
            found = [chain.label([set(a or ()) for a in seen or []]) for seen in batch[column].to_pylist()]
            made = [pa.array([r[k] if k < 2 else r[k].tolist() for r in found], f.type) for k, f in enumerate(target)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *target.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def register_sql(spark: SparkSession, options: Options | None = None, models: Models | None = None, name: str = "parse_ingredient") -> None:
    """A SQL function from sentences to records: ``parse_ingredient(sentence)``; and ``parse_ingredient_tokens(sentence, tokens)`` for
    tokens that are there already."""
    options, models = check_options(options), models or Models()
    kind = _schema(f"parsed {RECORD}")["parsed"].dataType

    @F.udf(returnType=kind, useArrow=True)
    def of_sentence(sentence):
        return _row(sentence, tokenise(normalise_text(sentence)) if sentence is not None else [], options, models, False)["parsed"]

    @F.udf(returnType=kind, useArrow=True)
    def of_tokens(sentence, words):
        return _row(sentence, list(words) if words is not None else [], options, models, False)["parsed"]

    spark.udf.register(name, of_sentence)
    spark.udf.register(f"{name}_tokens", of_tokens)
