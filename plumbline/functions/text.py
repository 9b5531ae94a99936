"""Text normalization and the query grammar, as Column builders."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The words that normalization expands, US regions by code, words that end the name of a street, and words for a unit of a building.
EXPANSIONS = {"st": "street", "ave": "avenue", "rd": "road", "blvd": "boulevard", "ln": "lane", "dr": "drive", "ct": "court", "pl": "place"}
REGIONS = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut",
    "DE": "delaware", "DC": "district of columbia", "FL": "florida", "GA": "georgia", "HI": "hawaii", "ID": "idaho", "IL": "illinois",
    "IN": "indiana", "IA": "iowa", "KS": "kansas", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland",
    "MA": "massachusetts", "MI": "michigan", "MN": "minnesota", "MS": "mississippi", "MO": "missouri", "MT": "montana", "NE": "nebraska",
    "NV": "nevada", "NH": "new hampshire", "NJ": "new jersey", "NM": "new mexico", "NY": "new york", "NC": "north carolina",
    "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon", "PA": "pennsylvania", "RI": "rhode island",
    "SC": "south carolina", "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah", "VT": "vermont", "VA": "virginia",
    "WA": "washington", "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming",
}
STREET_SUFFIXES = ["avenue", "boulevard", "circle", "court", "drive", "highway", "lane", "parkway", "road", "route", "street", "terrace", "trail", "way"]
UNIT_WORDS = ["apt", "apartment", "unit", "suite", "ste", "floor", "fl", "room"]
#: Spellings of one thing in an address context; a region's own list is configuration.
CONTEXT_ALIASES = [("rhode island", "ri"), ("united states", "us"), ("usa", "us")]


def fold_text(text: str) -> str:
    """Lower case without marks; each letter by itself, so a final sigma is not told from others."""
    lowered = "".join(c.lower() if c != "Σ" else "σ" for c in text)
    return "".join(c for c in unicodedata.normalize("NFD", lowered) if unicodedata.category(c) != "Mn")


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold_text(t))


def fold(c: Column) -> Column:
    """Lower case without accents: built-in for ASCII, and Arrow batches for the rest only."""
    plain = c.rlike(r"^\p{ASCII}*$")
    return F.when(plain, F.lower(c)).otherwise(_fold(F.when(~plain, c)))


def words_of(folded: Column) -> Column:
    """Words of letters and numbers, with the common street abbreviations written out."""
    lookup = F.create_map(*[F.lit(x) for pair in EXPANSIONS.items() for x in pair])
    spaced = F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))
    words = F.transform(F.split(spaced, " "), lambda w: F.coalesce(F.try_element_at(lookup, w), w))
    return F.filter(words, lambda w: w != "")


def normalize(c: Column, ascii_only: bool = False) -> Column:
    """The search form of a text: folded words joined by one blank.

    ``ascii_only`` skips the Arrow branch where the input is known to be ASCII.
    """
    return F.array_join(words_of(F.lower(c) if ascii_only else fold(c)), " ")


def word_count(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, " ")))


def address_key(c: Column, ascii_only: bool = False) -> Column:
    """House number without leading zeros, its suffix letter, and the normalized street; null if the text is no such address."""
    parts = F.split(F.trim(c), r"\s+", 2)
    rest = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    number, street = house_number(F.get(parts, F.lit(0))), normalize(rest, ascii_only)
    ok = F.left(rest, F.lit(1)).rlike(r"\p{L}") & ~rest.contains("\n") & (street != "")
    return F.when(ok, F.concat(number, F.lit(" "), street))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is evaluated, and written into the plan, once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def house_number(word: Column) -> Column:
    """A word of digits and an ASCII letter or none, without leading zeros and in lower case; null for other words."""

    def of(w: Column) -> Column:
        last = F.lower(F.right(w, F.lit(1)))
        letter = F.when(last.between("a", "z") & (F.octet_length(last) == 1), last).otherwise(F.lit(""))
        return once(F.struct(F.left(w, F.length(w) - F.length(letter)).alias("digits"), letter.alias("letter")), written)

    def written(n: Column) -> Column:
        digits, bare = n["digits"], F.ltrim(n["digits"], F.lit("0"))
        return F.when((digits != "") & (F.translate(digits, "0123456789", "") == ""), F.concat(F.when(bare == "", F.lit("0")).otherwise(bare), n["letter"]))

    return once(word, of)


def names_unit(c: Column) -> Column:
    """Whether a text has a number sign, or a word for a unit among its words of ASCII letters, digits and underscores."""
    words = F.split(F.lower(c), "[^0-9a-z_]")
    return c.contains("#") | F.arrays_overlap(words, F.array(*map(F.lit, UNIT_WORDS)))


def address_context(name: Column, formatted: Column, ascii_only: bool = False) -> Column:
    """Normalized words that follow the name in a formatted address; null where the address cannot be indexed."""
    ok = address_key(name, ascii_only).isNotNull() & ~names_unit(name) & (formatted.startswith(name) | (formatted == ""))
    return F.when(ok, normalize(F.substr(formatted, F.length(name) + 1), ascii_only))


def forward_outcome(c: Column, ascii_only: bool = False) -> Column:
    """What the grammar makes of a geocoding input: ok, invalid_input or unsupported_input."""
    blank = c.isNull() | (F.trim(c) == "") | (F.length(c) > 200)
    return F.when(blank, "invalid_input").when(names_unit(c), "unsupported_input").when(address_key(F.split_part(c, F.lit(","), F.lit(1)), ascii_only).isNull(), "unsupported_input").otherwise("ok")


def requested_context(c: Column, ascii_only: bool = False, aliases: list[tuple[str, str]] = CONTEXT_ALIASES) -> Column:
    """Normalized words after the first comma, with aliases applied."""
    parts = F.split(c, ",")
    out = F.concat(F.lit(" "), normalize(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " "), ascii_only), F.lit(" "))
    for long_, short in aliases:
        out = F.replace(out, F.lit(f" {long_} "), F.lit(f" {short} "))
    return F.trim(out)


def context_matches(stored: Column, requested: Column) -> Column:
    """Whether the requested words occur in order among the stored ones."""
    have, want = F.split(stored, " "), F.split(requested, " ")

    def step(at: Column, w: Column) -> Column:
        rest = F.slice(have, at + 1, F.size(have) + 1)
        found = F.array_position(rest, w).cast("int")
        return F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(at + found)

    return (requested == "") | (F.aggregate(want, F.lit(0), step) >= 0)


def region_code(normalized: Column) -> Column:
    """The code of a US region from its normalized name or code, with or without blanks; null if it is none."""
    table: dict[str, str] = {}
    for code, name in REGIONS.items():
        table[EXPANSIONS.get(code.lower(), code.lower())] = code
        table[name] = code
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, normalized), F.try_element_at(lookup, F.replace(normalized, F.lit(" "))))


def locality_form(raw: Column, normalized: Column) -> Column:
    """``St. X`` of a locality is a saint, not a street."""
    first = F.btrim(F.split_part(F.trim(F.lower(raw)), F.lit(" "), F.lit(1)), F.lit("."))
    is_saint = (first == "st") & normalized.startswith("street ")
    return F.when(is_saint, F.concat(F.lit("saint "), F.substr(normalized, F.lit(8)))).otherwise(normalized)


def context_of(c: Column, ascii_only: bool = False) -> Column:
    """STRUCT<name, locality, region_code> of ``city, state`` or ``street, city, state``; null for other inputs."""
    parts = F.transform(F.split(c, ","), F.trim)
    n = F.size(parts)
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    code = region_code(normalize(F.element_at(parts, -1), ascii_only))
    first, second = normalize(at(0), ascii_only), normalize(at(1), ascii_only)
    name = F.when(n == 2, locality_form(at(0), first)).otherwise(first)
    locality = F.when(n == 3, locality_form(at(1), second))
    ok = n.isin(2, 3) & ~F.exists(parts, lambda p: p == "") & code.isNotNull() & (name != "") & at(0).rlike(r"\p{L}")
    ok &= (n == 2) | (locality != "") & at(1).rlike(r"\p{L}")
    return F.when(ok, F.struct(name.alias("name"), locality.alias("locality"), code.alias("region_code")))


def has_street_suffix(normalized: Column) -> Column:
    return F.element_at(F.split(normalized, " "), -1).isin(STREET_SUFFIXES)


def text_match_class(query: Column, name: Column) -> Column:
    """0 equal, 1 prefix, 2 other; a leading ``the`` of the name may be left out."""
    bare = F.regexp_replace(name, "^the ", "")
    return F.when((name == query) | (bare == query), 0).when(name.startswith(query) | bare.startswith(query), 1).otherwise(2)


def display_name(kind: Column, subtype: Column, name: Column) -> Column:
    return F.when((kind == "area") & (subtype == "locality"), F.regexp_replace(name, "^Saint ", "St. ")).otherwise(name)


def public_id(anchor: Column, prefix: str = "pl_", domain: str = "plumbline:entity:v1:") -> Column:
    """A stable id from an anchor key."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(domain), anchor), 256), 1, 32))
