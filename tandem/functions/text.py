"""Text column expressions: terms, stems, filename variants, evidence primitives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions import vocab

NOT_TERM = r"[^\p{L}\p{M}\p{N}]+"


def terms(text: Column, least: int = 3) -> Column:
    """Maximal runs of letters, marks and digits after lower-casing, of at least ``least`` characters,
    in order and with repeats; null text gives null, text without terms an empty array."""
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda w: F.length(w) >= least)


def stem(word: Column) -> Column:
    """Drops the first suffix of the list that leaves at least four characters."""
    return F.regexp_replace(word, vocab.STEM_PATTERN, "$1")


def tokenize(text: Column) -> Column:
    """Stemmed caption tokens: at least three characters, no stop-words; null text gives an empty array."""
    kept = F.filter(terms(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(*vocab.STOP_WORDS))
    return F.transform(kept, stem)


def filename_bases(name: Column) -> Column:
    """The base forms of a file name: as is, without a leading counter, without a trailing one, without both."""
    low = F.lower(name)
    no_lead = F.regexp_replace(low, r"^\d+-", "")
    tail = r"-\d+(\.\w+)$"
    return F.array_distinct(F.array(low, no_lead, F.regexp_replace(low, tail, "$1"), F.regexp_replace(no_lead, tail, "$1")))


def filename_variants(a: Column, b: Column) -> Column:
    """True for different non-empty names (case ignored) that share a base form; null or empty: False."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (F.lower(a) != F.lower(b)) & (a != "") & (b != "") & F.arrays_overlap(filename_bases(a), filename_bases(b))


def normalize_evidence(text: Column) -> Column:
    """Lower case, straight quotes, single spaces, trimmed."""
    straight = F.translate(F.lower(text), "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(straight, r"\s+", " "))


def whole_json(text: Column) -> Column:
    """The variant of a text that is one JSON value as a whole; null for null, for anything else, and where more
    than white space follows the value (the parser alone would stop there and accept it)."""
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(one, "$[1]", "variant").isNull(), F.try_variant_get(one, "$[0]", "variant"))
