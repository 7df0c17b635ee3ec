"""Address text: cleaning, abbreviations, component extraction, similarities. All native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.exprs import map_literal

# Abbreviated words and what they stand for. "h no" is handled by HOUSE_NO.
ABBREVIATIONS = {
    "apt": "apartment", "appt": "apartment", "flt": "flat", "hno": "house number", "rd": "road",
    "st": "street", "ave": "avenue", "avn": "avenue", "ln": "lane", "nr": "near",
    "opp": "opposite", "sec": "sector", "blr": "bengaluru", "bglr": "bengaluru",
    "bangalore": "bengaluru", "bombay": "mumbai", "calcutta": "kolkata", "madras": "chennai",
}
HOUSE_NO = (r"\bh\s*no\b", "house number")

# Ordered replacements of the short canonical form.
SHORT_REPLACEMENTS = [
    (r"\brd\b", "road"),
    (r"\bst\b", "street"),
    (r"\bapt\b", "apartment"),
    (r"\bappt\b", "apartment"),
    (r"\bfl\b", "flat"),
    (r"\bblr\b", "bengaluru"),
    (r"\bbangalore\b", "bengaluru"),
]

# City names and other names of them.
CITY_ALIASES = {
    "bengaluru": "bengaluru", "bangalore": "bengaluru", "blr": "bengaluru", "mumbai": "mumbai",
    "bombay": "mumbai", "kolkata": "kolkata", "calcutta": "kolkata", "chennai": "chennai",
    "madras": "chennai", "new delhi": "delhi", "delhi": "delhi", "hyderabad": "hyderabad",
    "pune": "pune", "ahmedabad": "ahmedabad", "jaipur": "jaipur", "surat": "surat",
    "lucknow": "lucknow", "kanpur": "kanpur", "nagpur": "nagpur", "indore": "indore",
    "bhopal": "bhopal", "patna": "patna", "kochi": "kochi", "coimbatore": "coimbatore",
}

# State names and codes.
STATE_ALIASES = {
    "ka": "karnataka", "karnataka": "karnataka", "mh": "maharashtra", "maharashtra": "maharashtra",
    "tn": "tamil nadu", "tamil nadu": "tamil nadu", "dl": "delhi", "delhi": "delhi",
    "gj": "gujarat", "gujarat": "gujarat", "rj": "rajasthan", "rajasthan": "rajasthan",
    "ts": "telangana", "telangana": "telangana", "wb": "west bengal", "west bengal": "west bengal",
    "up": "uttar pradesh", "uttar pradesh": "uttar pradesh", "mp": "madhya pradesh",
    "madhya pradesh": "madhya pradesh", "hr": "haryana", "haryana": "haryana", "pb": "punjab",
    "punjab": "punjab", "kl": "kerala", "kerala": "kerala", "ap": "andhra pradesh",
    "andhra pradesh": "andhra pradesh", "od": "odisha", "orissa": "odisha", "odisha": "odisha",
    "uk": "uttarakhand", "uttarakhand": "uttarakhand", "bihar": "bihar", "jharkhand": "jharkhand",
    "chhattisgarh": "chhattisgarh", "goa": "goa", "assam": "assam", "hp": "himachal pradesh",
    "himachal pradesh": "himachal pradesh", "jk": "jammu and kashmir",
    "jammu and kashmir": "jammu and kashmir", "chandigarh": "chandigarh",
}

# Words that end a street, words that start an area, words that say nothing.
STREET_WORDS = ["road", "street", "lane", "avenue", "highway", "marg"]
AREA_WORDS = ["colony", "nagar", "sector", "layout", "phase"]
STOP_WORDS = ["the", "road", "street", "lane", "near", "opposite"]
HOUSE_PREFIX = "flat|apartment|house number|house no|house|hno|plot"

# basic() leaves only a-z, 0-9 and blanks, so this never occurs in cleaned text.
NEVER = "#"


def none_if_blank(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def basic(c: Column) -> Column:
    low = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\s]", " "), r"\s+", " "))


def expand(cleaned: Column) -> Column:
    """Spell out abbreviated words of text that ``basic`` has cleaned (words and blanks only)."""
    words = F.split(F.regexp_replace(cleaned, *HOUSE_NO), " ")
    table = map_literal(ABBREVIATIONS)
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def short_form(c: Column) -> Column:
    """Compact canonical form: punctuation dropped, a few words spelled out."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), SHORT_REPLACEMENTS, bare)


def alias(c: Column, table: dict[str, str]) -> Column:
    """Canonical name of an exact alias; other text is kept as cleaned."""
    text = basic(c)
    return F.coalesce(F.try_element_at(map_literal(table), text), text)


def detect(text: Column, table: dict[str, str]) -> Column:
    """Canonical name of the longest alias found in cleaned text; null when none is there.

    One scan collects every alias present; the best place in the length order wins.
    """
    order = sorted(table, key=lambda name: -len(name))
    place = map_literal({name: i + 1 for i, name in enumerate(order)})
    found = F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(order)})\b"), 1)
    best = F.array_min(F.transform(found, lambda a: F.try_element_at(place, a)))
    return F.try_element_at(map_literal({i + 1: table[name] for i, name in enumerate(order)}), best)


def pincode(text: Column) -> Column:
    return none_if_blank(F.regexp_extract(text, r"\b(\d{6})\b", 1))


def clean_pincode(c: Column) -> Column:
    """Six digits out of a value that may have been read as a number."""
    return pincode(F.regexp_replace(F.trim(c.cast("string")), r"^(\d+)\.0$", "$1"))


def house_number(text: Column) -> Column:
    named = F.regexp_extract(text, r"\b(?:house number|house no|hno|house|flat|apartment|plot)\s*([a-z]?\d+[a-z]?)\b", 1)
    leading = F.regexp_extract(text, r"^\s*([a-z]?\d+[a-z]?)\b", 1)
    return F.coalesce(none_if_blank(named), none_if_blank(leading))


def canonical_house(c: Column) -> Column:
    return F.trim(F.regexp_replace(basic(c), rf"^(?:{HOUSE_PREFIX})\s+", ""))


def street(text: Column) -> Column:
    """Up to two words and the first street word, without a leading house number or near/opposite."""
    words = "|".join(STREET_WORDS)
    found = F.regexp_extract(text, rf"(?:^| )((?:\S+ ){{0,2}}?(?:{words}))(?= |$)", 1)
    no_house = F.regexp_replace(found, r"^[a-z]?\d+[a-z]?(?: |$)", "")
    return none_if_blank(F.regexp_replace(no_house, r"^(?:(?:near|opposite)(?: |$))+", ""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without(text: Column, values: list[Column]) -> Column:
    """Plain substring removal of each non-null value."""
    return squeeze(
        reduce(lambda t, v: F.replace(t, F.coalesce(none_if_blank(v), F.lit(NEVER)), F.lit(" ")), values, text)
    )


def area(residual_without_street: Column) -> Column:
    """Area word and the word after it, else the last two words."""
    marked = [
        none_if_blank(F.regexp_extract(residual_without_street, rf"(?:^| )({w}(?: \S+)?)(?= |$)", 1))
        for w in AREA_WORDS
    ]
    return F.coalesce(*marked, none_if_blank(F.regexp_extract(residual_without_street, r"((?:\S+ )?\S+)$", 1)))


def country(text: Column) -> Column:
    return F.when(text.rlike(r"\b(?:india|bharat)\b"), "india")


def canonical_country(c: Column) -> Column:
    text = basic(c)
    return F.when(text.isin("india", "bharat", "in"), "india").otherwise(text)


def word_set(cleaned: Column) -> Column:
    """Distinct words of clean, expanded text that say something."""
    return F.array_distinct(F.filter(F.split(cleaned, " "), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def tokens(c: Column) -> Column:
    return word_set(expand(basic(c)))


def trigrams(c: Column) -> Column:
    """Distinct three-letter windows of clean text without blanks; empty below three letters."""
    t = F.replace(c, F.lit(" "), F.lit(""))
    n = F.length(t)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3)))
    return F.when(n >= 3, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))
