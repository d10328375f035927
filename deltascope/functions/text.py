"""Text functions as Column expressions: base text, match keys, missing values, aliases."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as missing, once normalised.
MISSING = ("", "n/a", "na", "null", "none", "-", "undefined", "(blank)")
UNKNOWN = "Unknown"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cp1252() -> tuple[str, str]:
    """Characters that Windows-1252 has in the place of the C1 controls, and those."""
    specials, controls = "", ""
    for byte in range(0x80, 0xA0):
        try:
            specials += bytes([byte]).decode("cp1252")
            controls += chr(byte)
        except UnicodeDecodeError:
            pass
    return specials, controls


def repair_mojibake(c: Column) -> Column:
    """Repairs UTF-8 that was read as Windows-1252; keeps the text if it was not."""
    specials, controls = _cp1252()

    def fix(bytes_: Column) -> Column:
        return F.when(F.is_valid_utf8(bytes_.cast("string")) & ~F.contains(bytes_.cast("string"), F.lit("\ufffd")), bytes_.cast("string"))

    def try_(t: Column) -> Column:
        return F.when(~t.rlike("[^\\x{00}-\\x{ff}]"), let(F.encode(t, "ISO-8859-1"), fix))

    return F.when(c.rlike("[ÃÂâ]"), F.coalesce(let(F.translate(c, specials, controls), try_), c)).otherwise(c)


@cache
def _compositions() -> dict[str, str]:
    """Letters and marks that have a composed form, by the Unicode tables (below U+2000)."""
    found = {}
    for code in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(code))
        if len(d) == 2 and unicodedata.normalize("NFC", d) == chr(code):
            found[d] = chr(code)
        elif len(d) == 3 and unicodedata.normalize("NFC", d) == chr(code):
            found[unicodedata.normalize("NFC", d[:2]) + d[2]] = chr(code)
    return found


def composed(c: Column) -> Column:
    """Canonical composition of letters with up to two marks behind them. Only texts with
    combining marks are taken apart."""
    pairs = _compositions()
    marks = "".join(sorted({x[1] for x in pairs}))
    table = F.str_to_map(F.lit("\n".join("\t".join(x) for x in pairs.items())), F.lit("\n"), F.lit("\t"))  # folded to one literal

    def once(t: Column) -> Column:
        units = F.regexp_extract_all(t, F.lit(f"(?s).[{marks}]?"), 0)
        return F.array_join(F.transform(units, lambda u: F.coalesce(F.try_element_at(table, u), u)), "")

    return F.when(c.rlike(f"[{marks}]"), let(once(c), once)).otherwise(c)


def unicode_form(c: Column, form: str) -> Column:
    """A Unicode normal form, by the Unicode tables in Python: for the distinct values of a
    column, not for all rows."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return normal(c)


#: Printable ASCII without space at either end: base text as it stands.
PLAIN = r"^[\x21-\x7e](?:[\x20-\x7e]*[\x21-\x7e])?$"
#: Printable ASCII that may have spaces at its ends: base text once these are cut off.
SPACED = r"^[\x20-\x7e]+\z"


def _trimmed(c: Column) -> Column:
    c = F.regexp_replace(c, "[\u00ad\u200b-\u200d\u2060\ufeff]", "")
    return F.regexp_replace(F.regexp_replace(c, "\u00a0", " "), r"^\s+|\s+$", "")


def bare_text(c: Column) -> Column:
    """Base text that is not composed: enough where marked letters do not matter, as in
    numbers, dates and placeholders, and a smaller plan."""
    c = c.cast("string")
    return F.when(c.rlike(PLAIN), c).when(c.rlike(SPACED), F.trim(c)).otherwise(_trimmed(let(F.coalesce(c, F.lit("")), repair_mojibake)))


def base_text(c: Column) -> Column:
    """Repaired, without invisible format characters, composed, no-break spaces as spaces,
    trimmed; null as empty. Plain text takes one test."""
    c = c.cast("string")
    return F.when(c.rlike(PLAIN), c).when(c.rlike(SPACED), F.trim(c)).otherwise(let(_trimmed(let(F.coalesce(c, F.lit("")), repair_mojibake)), composed))


def _plain_words(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "[._-]+", " "), r"\s+", " ")))


def normalise(c: Column) -> Column:
    return _plain_words(base_text(c))


def missing(c: Column) -> Column:
    """Whether a text is a placeholder for nothing; none of them has a digit, and one of
    letters alone needs no normalising."""
    c = c.cast("string")
    letters = c.rlike("^[A-Za-z]+$")
    return F.when(c.rlike("[0-9]"), False).when(letters, F.lower(c).isin(*MISSING)).otherwise(_plain_words(bare_text(c)).isin(*MISSING))


#: Accented letters of Latin-1 and Latin Extended-A, and the plain ones.
def _accents() -> tuple[str, str]:
    marked, plain = "", ""
    for code in range(0xC0, 0x180):
        d = unicodedata.normalize("NFKD", chr(code))
        if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:]):
            marked, plain = marked + chr(code), plain + d[0]
    return marked, plain


def fold_accents(c: Column) -> Column:
    """Without accents: letters of the Latin blocks by translation, combining marks dropped."""
    marked, plain = _accents()
    return F.regexp_replace(F.translate(c, marked, plain), "[\u0300-\u036f]", "")


def match_key(c: Column) -> Column:
    """What categories are compared by: no accents, quotes, punctuation or case; hyphens,
    underscores and slashes as spaces."""
    c = fold_accents(base_text(c))
    c = F.regexp_replace(c, "[‘’‚‛“”„‟'\"]", "")
    c = F.regexp_replace(c, r"[-\u2010-\u2015_\\/.,;:!?]+", " ")
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def compact_key(c: Column) -> Column:
    return F.regexp_replace(match_key(c), "[^a-z0-9]+", "")


def category_text(c: Column) -> Column:
    """Base text with single spaces; empty is Unknown."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(base_text(c), r"\s+", " ")), F.lit("")), F.lit(UNKNOWN))


def display_form(c: Column) -> Column:
    """Separators as spaces, no punctuation at the end."""
    c = F.regexp_replace(base_text(c), r"[-\u2010-\u2015_\\/]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[.,;:!?]+$", ""), r"\s+", " "))


def title_case(c: Column) -> Column:
    """Lower case, with a capital at every start of a run of letters, digits and underscores."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))), "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def is_abbreviation(c: Column) -> Column:
    return base_text(c).rlike(r"^(?:[A-Z]{2,5}|(?:[A-Z]\.){2,5})$")


#: Controlled aliases, by what a column's name must contain: compact form -> label.
ALIASES = (
    (("region", "state", "city", "location", "area"), {"newyork": "New York", "losangeles": "Los Angeles", "eastcoast": "East Coast", "westcoast": "West Coast"}),
    (("country", "nation", "market"), {"unitedstates": "United States"}),
    (("industry", "sector"), {"crypto": "Crypto", "cryptocurrency": "Crypto"}),
    (
        ("channel", "source", "platform", "medium"),
        {
            "online": "Online", "web": "Online", "website": "Online", "webstore": "Online", "ecommerce": "Online", "ecommercewebsite": "Online",
            "instore": "In Store", "retailstore": "In Store", "physicalstore": "In Store", "store": "In Store",
        },
    ),
)


def aliases_of(column: str) -> dict[str, str]:
    """The controlled aliases that hold for a column of this name."""
    out: dict[str, str] = {}
    for words, labels in ALIASES:
        if any(w in column.lower() for w in words):
            out = {**labels, **out}
    return out


def alias(c: Column, column: str) -> Column:
    found = aliases_of(column)
    if not found:
        return F.lit(None).cast("string")
    labels = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
    return F.try_element_at(labels, compact_key(c))
