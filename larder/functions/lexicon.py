"""Word lists and number tables of recipe sentences, and what is derived from them."""

from __future__ import annotations


def capitalise(word: str) -> str:
    """First letter upper, the rest lower case."""
    return word[:1].upper() + word[1:].lower()


def _pairs(text: str) -> dict[str, str]:
    return dict(entry.split(":") for entry in text.split())


# Plural and singular units, in order.
BASE_UNITS = _pairs("""
balls:ball bags:bag bars:bar baskets:basket batches:batch blocks:block bottles:bottle boxes:box
branches:branch buckets:bucket bulbs:bulb bunches:bunch bundles:bundle c:c cans:can canisters:canister
chunks:chunk cloves:clove clusters:cluster counts:count cl:cl cL:cL cubes:cube cups:cup cutlets:cutlet
dashes:dash dessertspoons:dessertspoon dollops:dollop drops:drop ears:ear envelopes:envelope feet:foot fl:fl
floz:floz g:g gm:gm gal:gal gallons:gallon glasses:glass grams:gram grinds:grind handfuls:handful heads:head
jars:jar jiggers:jigger kg:kg kilograms:kilogram knobs:knob ladles:ladle lbs:lb leaves:leaf lengths:length
links:link l:l liters:liter litres:litre loaves:loaf milliliters:milliliter millilitres:millilitre ml:ml mL:mL
mugs:mug ounces:ounce oz:oz packs:pack packages:package packets:packet pairs:pair pieces:piece pinches:pinch
pints:pint pods:pod pots:pot pounds:pound pts:pt punnets:punnet racks:rack rashers:rasher recipes:recipe
rectangles:rectangle ribs:rib quarts:quart qt:qt sachets:sachet scoops:scoop sections:section segments:segment
shakes:shake sheets:sheet shots:shot shoots:shoot slabs:slab slices:slice sprigs:sprig squares:square
stalks:stalk stems:stem sticks:stick strips:strip tablespoons:tablespoon tbsps:tbsp tbs:tb teaspoons:teaspoon
tins:tin tsps:tsp tubs:tub tubes:tube twists:twist units:unit wedges:wedge vials:vial wheels:wheel
""")

# Units that can be part of a name.
AMBIGUOUS_BASE = "cloves leaves slabs wedges ribs gram glass".split()

# Words of size.
SIZES = """
big bite-size bite-sized extra-large jumbo large lg little md medium medium-large medium-size medium-sized
medium-small medium-to-large miniature regular slim sm small small-to-medium smaller smallest thick thin tiny
""".split()

# Words for numbers, in order.
NUMBER_WORDS = {
    "one-quarter": "1/4", "one-half": "1/2", "three-quarter": "3/4", "three-quarters": "3/4",
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17",
    "eighteen": "18", "nineteen": "19",
}

# Fraction characters, in order.
FRACTION_CHARACTERS = {
    "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅙": "1/6", "⅚": "5/6", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5",
    "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "½": "1/2",
}

# High-frequency grammatical words.
STOP_WORDS = frozenset("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any each few more most other some
such no nor not only own same so than too very can will just don't should should've now aren't
couldn't didn't doesn't hadn't hasn't haven't isn't mightn't mustn't needn't shan't shouldn't wasn't
weren't won't wouldn't
""".split())

# Words around amounts.
APPROXIMATE_BEFORE = ("about", "approx", "approximately", "nearly", "roughly", "~", "generous")
APPROXIMATE_AFTER = (("or", "so"),)
SINGULAR_WORDS = ("each",)
PREPARED_WORDS = (("to", "yield"), ("to", "make"))
INDEFINITE_QUANTIFIERS = ("couple", "few", "many", "plenty", "more", "several", "some")
CONTAINERS = "bag block bottle box bucket can carton container envelope jar loaf package packet piece sachet slice tin".split()

# Units that are the same unit.
UNIT_SYNONYMS = (
    ("cup", "c"), ("gram", "g", "gm"), ("kilogram", "kg"), ("litre", "liter", "l"), ("ounce", "oz"), ("pound", "lb"),
    ("quart", "qt"), ("tablespoon", "tbsp", "tbs", "tb"), ("teaspoon", "tsp"),
)

# Lengths and dimensions.
LENGTH_UNITS = ("centimeter", "centimetre", "cm", "in", "inch", "inches", "millimeter", "millimetre", "mm")
DIMENSIONS = ("diameter", "inch-long", "inch-thick", "length", "long", "thick", "thickness", "wide", "width")
LENGTH_BUCKETS = (2, 4, 8, 12, 16, 20, 32, 64)

UNITS = BASE_UNITS | {capitalise(p): capitalise(s) for p, s in BASE_UNITS.items()}
#: All plurals and singulars, in order and once each.
UNIT_WORDS = list(dict.fromkeys(w for pair in UNITS.items() for w in pair))
SYNONYM_GROUP = {word: n for n, group in enumerate(UNIT_SYNONYMS) for word in group}
AMBIGUOUS_UNITS = list(
    dict.fromkeys(
        AMBIGUOUS_BASE + [x for u in AMBIGUOUS_BASE for x in (capitalise(u), UNITS.get(u), UNITS.get(capitalise(u))) if x]
    )
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def same_unit(a: str, b: str) -> bool:
    """Whether two known units are synonyms, in singular or plural."""
    if a not in _KNOWN or b not in _KNOWN:
        return False
    group = SYNONYM_GROUP.get(UNITS.get(a, a))
    return group is not None and group == SYNONYM_GROUP.get(UNITS.get(b, b))


_KNOWN = frozenset(UNIT_WORDS)


def with_custom_units(custom: dict[str, str] | None) -> dict[str, str]:
    """Custom plurals and singulars, with capitalised forms."""
    custom = custom or {}
    return custom | {capitalise(p): capitalise(s) for p, s in custom.items()}
