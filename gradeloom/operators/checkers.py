"""Instruction-following checks of a response, as boolean expressions. An empty response never passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACES

#: A sign of a word in any script, as Python's regular expressions have it; Java's own class is ASCII only.
W = r"[\p{L}\p{N}_]"


def stripped(v: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(v, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def _relation(n: Column, relation: str, k: int) -> Column:
    return n < k if relation == "less than" else n >= k


def _count(v: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def keywords(v, words):
    return _all([v.rlike(f"(?iu){w}") for w in words])


def keyword_frequency(v, word, relation, k):
    return _relation(_count(v, f"(?iu){word}"), relation, k)


def forbidden(v, words):
    return ~_any([v.rlike(rf"(?iu)(?<!{W}){w}(?!{W})") for w in words])


def letter_frequency(v, letter, relation, k):
    low = F.lower(v)
    return _relation(F.length(low) - F.length(F.replace(low, F.lit(letter.lower()))), relation, k)


def language(label, code):
    """Against a detector's label; no label counts as followed."""
    return F.coalesce(label == code, F.lit(True))


def sentences(v, relation, k):
    """Runs that end in . ! or ? count; a stated stand-in for a trained sentence splitter."""
    return _relation(_count(v, r"[^.!?]+[.!?]+"), relation, k)


def paragraphs(v, k):
    parts = F.transform(F.split(v, r"\s?\*\*\*\s?"), lambda p: stripped(p) != "")
    inner = F.forall(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x)
    return inner & (F.size(F.filter(parts, lambda x: x)) == k)


def word_count(v, relation, k):
    return _relation(_count(v, f"{W}+"), relation, k)


def paragraph_first_word(v, k, nth, word):
    parts = F.filter(F.split(v, r"\n\n"), lambda p: stripped(p) != "")
    first = F.lower(F.regexp_extract(stripped(F.try_element_at(parts, F.lit(nth))), r"""^\s*['"]*([^\s.,?!'"]*)""", 1))
    return (F.size(parts) == k) & F.coalesce(first == word.lower(), F.lit(False))


def placeholders(v, k):
    return _count(v, r"\[.*?\]") >= k


def postscript(v, marker="P.S."):
    patterns = {"P.P.S": r"(?mU)\s*p\.\s?p\.\s?s.*$", "P.S.": r"(?mU)\s*p\.\s?s\..*$"}
    return F.lower(v).rlike(patterns.get(marker, rf"(?mU)\s*{marker.lower()}.*$"))


def bullets(v, k):
    return _count(v, r"(?m)^\s*\*[^\*].*$") + _count(v, r"(?m)^\s*-.*$") == k


def constrained(v, options=("My answer is yes.", "My answer is no.", "My answer is maybe.")):
    return _any([v.contains(o) for o in options])


def highlights(v, k):
    one = F.size(F.filter(F.regexp_extract_all(v, F.lit(r"\*([^\n\*]*)\*"), F.lit(1)), lambda x: stripped(x) != ""))
    two = F.size(F.filter(F.regexp_extract_all(v, F.lit(r"\*\*([^\n\*]*)\*\*"), F.lit(1)), lambda x: stripped(x) != ""))
    return one + two >= k


def sections(v, splitter, k):
    return F.size(F.split(v, rf"\s?{splitter}\s?\d+\s?")) - 1 >= k


def json_format(v):
    body = F.regexp_replace(stripped(v), r"(?i)^```(?:json)?\s*|\s*```$", "")
    return F.try_parse_json(body).isNotNull()


def title(v):
    return F.exists(F.regexp_extract_all(v, F.lit(r"<<([^\n]+)>>"), F.lit(1)), lambda x: stripped(x) != "")


def two_responses(v):
    parts = F.transform(F.split(v, r"\*\*\*\*\*\*"), lambda p: stripped(p))
    inner = F.forall(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != "")
    given = F.filter(parts, lambda x: x != "")
    return inner & (F.size(given) == 2) & (F.size(F.array_distinct(given)) == 2)


def repeats_prompt(v, prompt):
    return F.startswith(F.lower(stripped(v)), F.lower(stripped(prompt)))


def ends_with(v, phrase):
    return F.lower(F.regexp_replace(stripped(v), r'^"+|"+$', "")).endswith(phrase.strip().lower())


def quoted(v):
    t = stripped(v)
    return (F.length(t) > 1) & t.startswith('"') & t.endswith('"')


def capital_words(v, relation, k):
    """Words (runs of letters and digits) with letters of which none is lower case."""
    return _relation(F.size(F.filter(F.regexp_extract_all(v, F.lit(f"{W}+"), F.lit(0)), lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"))), relation, k)


def all_capitals(v, label):
    return (v == F.upper(v)) & v.rlike(r"\p{Lu}") & language(label, "en")


def all_lower(v, label):
    return (v == F.lower(v)) & v.rlike(r"\p{Ll}") & language(label, "en")


def no_comma(v):
    return ~v.contains(",")


def starts_some_line(v, starter):
    return v.rlike(rf"(?mU)^\s*{starter}.*$")


def rephrased(v, original):
    cut = lambda x: F.regexp_replace(x, r"\*[^*]*\*", "")
    return cut(v) == cut(original)


def key_sentences(v, listed, k):
    return sum((v.contains(s).cast("int") for s in listed), F.lit(0)) == k


def word_overlap(v, original, low, high):
    """Distinct words in common, within bounds."""
    a, b = (F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(f"{W}+"), F.lit(0))) for x in (v, original))
    return F.size(F.array_intersect(a, b)).between(low, high)


def followed(v: Column, check, *args) -> Column:
    return F.coalesce((stripped(v) != "") & check(v, *args), F.lit(False))


def loose_variants(v: Column) -> Column:
    """With and without asterisks, first line, last line, and both lines."""
    lines = F.split(v, "\n")
    n = F.size(lines)
    part = lambda a, k: stripped(F.array_join(F.slice(lines, a, F.greatest(n - k, F.lit(0))), "\n"))
    base = [v, part(2, 1), part(1, 1), part(2, 2)]
    return F.array(*base, *(F.replace(x, F.lit("*")) for x in base))


def followed_loosely(v: Column, check, *args) -> Column:
    return F.exists(loose_variants(v), lambda x: followed(x, check, *args))
