"""Unit registry, regional volumes, conversion by density: a small table, and columns over it."""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as L
from .literals import map_of

SYSTEMS = ("us_customary", "imperial", "metric", "australian", "japanese")
DENSITY = 1000.0


class Unit(NamedTuple):
    name: str
    dimension: str
    si_factor: float


# Name, factor to SI, other names.
_VOLUMES = """
teaspoon 4.92892159375e-6 tsp teaspoons
tablespoon 1.478676478125e-5 tbsp tablespoons
fluid_ounce 2.95735295625e-5 floz fluid_ounces
cup 2.365882365e-4 cups
pint 4.73176473e-4 pints pt
quart 9.46352946e-4 quarts qt
gallon 3.785411784e-3 gallons gal
liter 1e-3 litre l liters litres
milliliter 1e-6 ml milliliters millilitre millilitres
deciliter 1e-4 dl deciliters
centiliter 1e-5 cl centiliters
imperial_cup 2.84130625e-4
imperial_fluid_ounce 2.84130625e-5
imperial_pint 5.6826125e-4
imperial_quart 1.1365225e-3
imperial_gallon 4.54609e-3
imperial_tablespoon 1.7758164062500002e-5 imperial_tbsp UK_tablespoon UK_tbsp
imperial_teaspoon 5.919388020833333e-6 imperial_tsp UK_teaspoon UK_tsp
metric_cup 2.5e-4
metric_tablespoon 1.5e-5 metric_tbsp
metric_teaspoon 5e-6 metric_tsp
aus_tablespoon 2e-5 aus_tbsp
aus_pint 5.7e-4
jp_cup 2e-4
"""
_MASSES = """
gram 1e-3 g grams
kilogram 1 kg kilograms
milligram 1e-6 mg milligrams
ounce 0.028349523125 oz ounces
pound 0.45359237 lb lbs pounds
imperial_ounce 0.028349523125
imperial_pound 0.45359237
"""
# SI prefixes in the order in which they are tried.
_PREFIXES = "da:deca Y:yotta Z:zetta E:exa P:peta T:tera G:giga M:mega k:kilo h:hecto d:deci c:centi m:milli u:micro µ:micro n:nano p:pico f:femto a:atto z:zepto y:yocto"
# Units that a region understands otherwise, with their regional names.
_REGIONAL = {
    "cup": {"imperial": "imperial_cup", "japanese": "jp_cup", "australian": "metric_cup", "metric": "metric_cup"},
    "fluid_ounce": {"imperial": "imperial_fluid_ounce"},
    "quart": {"imperial": "imperial_quart"},
    "pint": {"imperial": "imperial_pint", "australian": "aus_pint"},
    "gallon": {"imperial": "imperial_gallon"},
    "tablespoon": {"imperial": "imperial_tablespoon", "japanese": "metric_tablespoon", "australian": "aus_tablespoon", "metric": "metric_tablespoon"},
    "teaspoon": {"imperial": "imperial_teaspoon", "japanese": "metric_teaspoon", "australian": "metric_teaspoon", "metric": "metric_teaspoon"},
    "ounce": {"imperial": "imperial_ounce"},
    "pound": {"imperial": "imperial_pound"},
}
_REGIONAL |= {"floz": _REGIONAL["fluid_ounce"], "tbsp": _REGIONAL["tablespoon"], "tsp": _REGIONAL["teaspoon"], "oz": _REGIONAL["ounce"], "lb": _REGIONAL["pound"]}
# Words that a unit parser would take for something else.
MISREAD = frozenset("pinch pinches bar bars link links shake shakes tin tins unit units fat".split())
# Spellings replaced, in order, before a unit is looked up.
_SPELLINGS = [
    ("fl oz", "floz"), ("fluid oz", "fluid_ounce"), ("fl ounce", "fluid_ounce"), ("fluid ounce", "fluid_ounce"), ("C", "cup"), ("c", "cup"), ("qt", "quart"),
    ("Cl", "centiliter"), ("G", "gram"), ("Ml", "milliliter"), ("Mm", "millimeter"), ("Pt", "pint"), ("Tb", "tablespoon"),
]
# Units by measuring system.
METRIC_WORDS = frozenset("g gram kg kilogram l liter litre ml milliliter millilitre".split())
CUSTOMARY_WORDS = frozenset("lb pound oz ounce fluid_ounce st stone c cup tsp teaspoon tbsp tablespoon pt pint in inch".split())
_MARKS = (("imperial_", "imperial"), ("metric_", "metric"), ("aus_", "australian"), ("jp_", "japanese"))


def _registry() -> dict[str, Unit]:
    out = {}
    for dimension, table in (("volume", _VOLUMES), ("mass", _MASSES)):
        for row in table.strip().split("\n"):
            name, factor, *others = row.split()
            unit = Unit(name, dimension, float(factor))
            out |= dict.fromkeys([name, *others], unit)
    return out


REGISTRY = _registry()
_PREFIX_LIST = [p.split(":") for p in _PREFIXES.split()]
_SPELLING_PATTERNS = [(re.compile(rf"(?<![A-Za-z0-9_]){a}(?![A-Za-z0-9_])"), b) for a, b in _SPELLINGS]


def get_unit(name: str) -> Unit | None:
    return REGISTRY.get(name)


def unit_for(name: str, system: str) -> Unit | None:
    """The unit as a region understands it."""
    return REGISTRY.get(_REGIONAL.get(name, {}).get(system, name))


def _resolve(word: str) -> str | None:
    if word in REGISTRY:
        return REGISTRY[word].name
    for symbol, long in _PREFIX_LIST:
        if word.startswith(symbol) and (base := REGISTRY.get(word[len(symbol) :])):
            return long + base.name
    return None


def parse_unit_expression(text: str) -> Unit | None:
    """Words that are all units, prefixed ones too; several make a product without dimension."""
    names = [_resolve(w) for w in text.split()]
    if not names or None in names:
        return None
    if len(names) == 1 and names[0] in REGISTRY:
        return REGISTRY[names[0]]
    return Unit(" * ".join(sorted(names)), "dimensionless", math.nan)


@lru_cache(maxsize=65536)
def to_unit(text: str, system: str = "us_customary") -> Unit | str:
    """The registered unit of a unit's text, or the text where there is none."""
    if "-" in text or text.lower() in MISREAD:
        return text
    for pattern, replacement in _SPELLING_PATTERNS:
        text = pattern.sub(replacement, text)
    return (unit_for(text, system) or parse_unit_expression(text) or text) if text else text


def unit_system(unit: Unit | str) -> str:
    name = unit.name if isinstance(unit, Unit) else unit
    if name == "":
        return "none"
    mark = next((system for prefix, system in _MARKS if prefix in name), "us_customary")
    for prefix, _ in _MARKS:
        name = name.replace(prefix, "", 1)
    for word in name.lower().split():
        if word in METRIC_WORDS:
            return "metric"
        if word in CUSTOMARY_WORDS:
            return mark
    return "other"


def convert(value: float, unit: Unit, target: Unit | str, density: float = DENSITY) -> tuple[float, Unit]:
    """A value in another unit; volumes and masses by density in kilograms a cubic metre."""
    to = REGISTRY.get(target) if isinstance(target, str) else target
    if to is None:
        raise ValueError(f"Unknown unit: {target}")
    si = value * unit.si_factor
    if to.dimension == unit.dimension:
        return si / to.si_factor, to
    if (unit.dimension, to.dimension) == ("volume", "mass"):
        return si * density / to.si_factor, to
    if (unit.dimension, to.dimension) == ("mass", "volume"):
        return si / density / to.si_factor, to
    raise ValueError(f"Cannot convert {unit.name} ({unit.dimension}) to {to.name} ({to.dimension})")


def plural_units(text: str, custom: dict[str, str] | None = None) -> str:
    """Each singular unit in the text becomes plural, one unit after the other."""
    return _plural(text, tuple((custom or {}).items()))


@lru_cache(maxsize=65536)
def _plural(text: str, custom: tuple) -> str:
    for singular, pattern, plural in _plural_patterns(custom):
        if singular in text:
            text = pattern.sub(plural, text)
    return text


@lru_cache(maxsize=64)
def _plural_patterns(custom: tuple) -> list[tuple[str, re.Pattern, str]]:
    units = L.UNITS | dict(custom)
    return [(s, re.compile(rf"(?<![A-Za-z0-9_])({re.escape(s)})(?![A-Za-z0-9_])"), p) for p, s in units.items()]


def unit_table(spark: SparkSession) -> DataFrame:
    """(alias, system, name, dimension, si_factor): every name of a unit in every region."""
    rows = [(alias, system, *unit_for(alias, system)) for alias in REGISTRY for system in SYSTEMS]
    return spark.createDataFrame(rows, "alias string, system string, name string, dimension string, si_factor double")


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(map_of(values), key)


def resolve_name(alias: Column, system: Column | str = "us_customary") -> Column:
    """The registered name of a unit as a region understands it, null for unknown ones."""
    system = F.lit(system) if isinstance(system, str) else system
    regional = {f"{name}|{s}": to for name, by in _REGIONAL.items() for s, to in by.items()}
    return F.coalesce(_lookup(regional, F.concat_ws("|", alias, system)), _lookup({a: u.name for a, u in REGISTRY.items()}, alias))


def si_factor(name: Column) -> Column:
    return _lookup({u.name: u.si_factor for u in REGISTRY.values()}, name)


def dimension(name: Column) -> Column:
    return _lookup({u.name: u.dimension for u in REGISTRY.values()}, name)


def converted(value: Column, unit: Column, target: str, density: float | Column = DENSITY) -> Column:
    """``value`` of registered units as ``target``; an unconvertible row raises, a null stays null."""
    to = REGISTRY.get(target)
    if to is None:
        raise ValueError(f"Unknown unit: {target}")
    density = F.lit(float(density)) if not isinstance(density, Column) else density
    si = value * si_factor(unit)
    bridge = F.when(dimension(unit) == to.dimension, si)
    bridge = bridge.when((dimension(unit) == "volume") & F.lit(to.dimension == "mass"), si * density)
    bridge = bridge.when((dimension(unit) == "mass") & F.lit(to.dimension == "volume"), si / density)
    bridge = bridge.when(unit.isNull() | value.isNull(), None)
    return bridge.otherwise(F.raise_error(F.concat(F.lit("Cannot convert "), unit, F.lit(f" to {to.name}"))).cast("double")) / F.lit(to.si_factor)


def system_of(name: Column) -> Column:
    """The measuring system of a registered unit's name."""
    bare = name
    for prefix, _ in _MARKS:
        bare = F.regexp_replace(bare, f"^(.*?){prefix}", "$1")
    mark = F.lit("us_customary")
    for prefix, system in reversed(_MARKS):
        mark = F.when(F.contains(name, F.lit(prefix)), system).otherwise(mark)
    first = F.try_element_at(F.filter(F.split(F.lower(bare), r"\s+"), lambda w: w.isin(*METRIC_WORDS, *CUSTOMARY_WORDS)), F.lit(1))
    return F.when(name == "", "none").when(first.isin(*METRIC_WORDS), "metric").when(first.isNotNull(), mark).otherwise("other")
