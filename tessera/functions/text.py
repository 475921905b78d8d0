"""Token and key expressions on normalized strings; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street words and their canonical forms, words that carry no street name, generic business words, and
# the ordered substitutions and letters of the consonant skeleton.
STREET_CANON = {
    "street": "st", "str": "st", "saint": "st", "avenue": "ave", "av": "ave", "road": "rd",
    "drive": "dr", "lane": "ln", "court": "ct", "boulevard": "blvd", "bd": "blvd", "bld": "blvd",
    "place": "pl", "trail": "trl", "parkway": "pkwy", "highway": "hwy", "circle": "cir",
    "terrace": "ter", "square": "sq", "suite": "ste", "sainte": "ste", "apartment": "apt",
    "building": "bldg", "floor": "fl", "north": "n", "south": "s", "east": "e", "west": "w",
    "route": "rte", "chemin": "ch", "impasse": "imp", "allee": "all", "faubourg": "fg",
    "near": "nr", "opposite": "opp", "opp": "opp", "sector": "sec", "extension": "extn",
    "ext": "extn", "phase": "ph", "nagar": "ngr", "colony": "col",
}
STREET_STOP_WORDS = "road street near opp post office city main cross floor shop unit pmb box rue".split()
BIZ_WORDS = """
holdings holding group groupe partners partner associates associes services service solutions
enterprises enterprise international global industries industry trading ventures systems center
centre consulting consultants company co corp corporation inc llc ltd limited private pvt public
exports export imports import agency agencies management technologies technology tech labs lab
foundation trust society network networks worldwide america india france national
""".split()
SKELETON_SUBSTITUTIONS = [("ph", "f"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("sh", "s"), ("ck", "k"), ("x", "ks"), ("q", "k"), ("c", "k"), ("w", "v"), ("z", "j")]
SKELETON_LETTERS = "bdfgjklmnprstv"

STREET_STOP = sorted({*STREET_CANON.values(), *STREET_STOP_WORDS})


def text(c: str | Column) -> Column:
    """The string, '' for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: str | Column) -> Column:
    """Tokens between single spaces, without empty ones."""
    return F.filter(F.split(text(c), " "), lambda t: t != "")


def token_set(c: str | Column) -> Column:
    """Distinct tokens in first-seen order."""
    return F.array_distinct(tokens(c))


def sorted_key(c: str | Column) -> Column:
    """Sorted tokens joined by spaces, duplicates kept: the order-free name and address key."""
    return F.array_join(F.array_sort(tokens(c)), " ")


def sorted_set_key(c: str | Column) -> Column:
    return F.array_join(F.array_sort(token_set(c)), " ")


def unpadded(c: str | Column) -> Column:
    """Without leading zeros."""
    return F.regexp_replace(text(c), "^0+", "")


def compact(c: str | Column) -> Column:
    return F.regexp_replace(text(c), " ", "")


def house_street_key(house: str = "a_house", street: str = "a_street") -> Column:
    """House without leading zeros, then the sorted distinct street words of 3 letters or more that are not stop words;
    '' if either is missing."""
    words = F.array_join(F.array_sort(F.filter(token_set(street), lambda t: (F.char_length(t) >= 3) & ~t.isin(STREET_STOP))), " ")
    number = unpadded(house)
    return F.when((number != "") & (words != ""), F.concat_ws("|", number, words)).otherwise("")


def house_street_raw_key(house: str = "a_house", street: str = "a_street") -> Column:
    """House as it is, then all street tokens sorted; '' if either is missing."""
    return F.when((text(house) != "") & (sorted_key(street) != ""), F.concat_ws("|", text(house), sorted_key(street))).otherwise("")


def skeleton(c: str | Column, n: int = 2) -> Column:
    """Consonant skeleton of the first n tokens: ordered substitutions, no vowels, no repeated letters."""
    letters = F.regexp_replace(F.lower(text(c)), "[^a-z ]", "")
    swapped = reduce(lambda s, ab: F.replace(s, F.lit(ab[0]), F.lit(ab[1])), SKELETON_SUBSTITUTIONS, letters)
    bare = F.filter(F.split(F.regexp_replace(swapped, "[aeiouy]", ""), " "), lambda t: t != "")
    return F.regexp_replace(F.array_join(F.slice(bare, 1, n), "|"), f"([{SKELETON_LETTERS}])\\1+", "$1")


def numbers(c: str | Column) -> Column:
    """Distinct address numbers, split at space, - and /, without leading zeros."""
    parts = F.split(F.regexp_replace(text(c), "[/\\-]", " "), " ")
    return F.array_distinct(F.filter(F.transform(parts, lambda t: F.regexp_replace(t, "^0+", "")), lambda t: t != ""))


def name_number_keys(name: str = "n_core", number: str = "a_numbers") -> Column:
    """One key for each address number: sorted distinct name tokens | number; none without name tokens."""
    key = sorted_set_key(name)
    return F.when(key != "", F.transform(numbers(number), lambda t: F.concat_ws("|", key, t))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, empty: float = -1.0) -> Column:
    """Jaccard similarity of two arrays as sets; `empty` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_ngrams(c: str | Column, n: int = 3) -> Column:
    """Character n-grams within words, each word padded by one space on both sides."""
    words = F.transform(tokens(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))
    return F.flatten(grams)


def dot(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Dense cosine; null where a vector is null or zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
