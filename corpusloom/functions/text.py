"""Pretokens, splitting on special tokens, prompts and small string helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the public GPT-2 pretoken pattern. (?U) makes \s the Unicode class.
PRETOKEN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pretokens(text: Column) -> Column:
    """All pretokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def split_specials(text: Column, specials: list[str]) -> Column:
    """A text cut at special tokens, longest first; the tokens stay as parts of their own, empty parts go."""
    if not specials:
        return F.array(text)
    quoted = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
    # a special token, or all up to the next one; the possessive loop does not recurse, however long the text
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:{quoted})|(?:(?!{quoted}).)++"), F.lit(0))


def special_pretokens(text: Column, specials: list[str], keep: bool = True) -> Column:
    """Pretokens of the parts between special tokens; the tokens themselves stay (encoding) or go (training)."""
    atoms = F.array(*[F.lit(s) for s in specials]) if specials else F.array().cast("array<string>")
    part = lambda x: F.when(F.array_contains(atoms, x), F.array(x) if keep else F.array().cast("array<string>")).otherwise(pretokens(x))
    return F.flatten(F.transform(split_specials(text, specials), part))


def slug(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def crlf_insensitive_digest(text: Column) -> Column:
    """The digest of a text with all line ends as CRLF, so that checkouts with either agree."""
    return F.sha2(F.regexp_replace(text, "\r?\n", "\r\n"), 256)


def strict_json(text: Column) -> Column:
    """A JSON text as a variant; null if it is none, also where something stands behind a value, which Spark's parser passes
    over. An array that a text is put into has as many items as were put there only if the text is one value."""
    alone = [F.json_array_length(F.concat(F.lit("["), text, F.lit(more + "]"))) == n for more, n in ((",0", 2), (",0,0", 3))]
    return F.when(alone[0] & alone[1], F.try_parse_json(text))


def last_json_object(text: Column) -> Column:
    """The variant between the first { and the last }, null if that is no JSON."""
    return strict_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def arguments(raw: Column) -> Column:
    """Call arguments as JSON text: an object as it is; anything else, also broken JSON, as {}."""
    parsed = strict_json(raw)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)).otherwise("{}")


def matches_any(text: Column, patterns: list[str]) -> Column:
    return F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns))


def contained(answer: Column, expected: Column) -> Column:
    """Is the expected answer in the answer? No expectation: null; an empty one: true; no answer counts as empty."""
    return F.contains(F.coalesce(answer, F.lit("")), expected)


def id_parts(name: Column) -> tuple[Column, Column]:
    """What is in front of and behind the last hyphen; the whole name and null where there is none."""
    at = F.length(F.substring_index(name, "-", -1))
    has = F.contains(name, F.lit("-"))
    return F.when(has, F.left(name, F.length(name) - at - 1)).otherwise(name), F.when(has, F.right(name, at))
