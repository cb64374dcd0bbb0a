"""Normal forms of answers before they are compared, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PUNCTUATION, SPACES

#: Words that count as articles, by language.
ARTICLES = {
    "en": ("a", "an", "the"),
    "es": ("el", "la", "los", "las", "un", "una", "unos", "unas"),
    "pt": ("o", "a", "os", "as", "um", "uma", "uns", "umas"),
    "it": ("il", "lo", "la", "i", "gli", "le", "un", "uno", "una"),
    "fr": ("le", "la", "les", "l'", "un", "une", "des"),
    "de": ("der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "eines", "einem", "einen"),
    "fi": ("se", "yksi", "yks"),
    "el": ("ὁ", "οἱ", "τοῦ", "τῶν", "τόν", "τούς", "ὦ", "ἡ", "αἱ", "τῆς", "τήν", "τάς", "τό", "τά"),
    "he": ("ה",),
    "no": ("en", "ei", "et", "den", "det", "de"),
    "sv": ("en", "ett", "den", "det", "de"),
    "tr": ("bir",),
    "nl": ("de", "het", "een"),
    "hu": ("a", "az", "egy"),
    "ca": ("el", "la", "els", "les", "un", "una", "uns", "unes"),
    "gl": ("o", "a", "os", "as", "un", "unha", "uns", "unhas"),
}
_W = r"\p{L}\p{N}_"


def one_spaced(x: Column) -> Column:
    """Runs of white space become one space, none around the text."""
    return F.trim(F.regexp_replace(x, rf"[{SPACES}]+", " "))


def without_articles(x: Column, language: str = "en") -> Column:
    """Articles that stand as words become a space; languages without a list keep theirs."""
    words = ARTICLES.get(language, ())
    if not words:
        return x
    # A word boundary after "l'" asks for a word's sign to follow.
    ends = [rf"{w}(?=[{_W}])" if w.endswith("'") else rf"{w}(?![{_W}])" for w in words]
    return F.regexp_replace(x, rf"(?<![{_W}])(?:{'|'.join(ends)})", " ")


def quiz(x: Column) -> Column:
    """For quasi-exact matches of question answering: word by word (parted at spaces and hyphens) lower-cased, without ASCII punctuation and English articles; whole numbers as decimal numbers, so that 7 and 07 are one (of any length: long ones aren't rounded)."""

    def word(w: Column) -> Column:
        bare = F.translate(F.lower(w), PUNCTUATION, "")
        whole = F.concat(F.regexp_replace(bare, "^0+([0-9])", "$1"), F.lit(".0"))
        number = F.when(bare.rlike("^[0-9]+$"), whole).when(bare.rlike("^[0-9]{1,300}e[0-9]{1,3}$"), bare.try_cast("double").cast("string"))
        return one_spaced(without_articles(F.coalesce(number, bare)))

    return F.trim(F.array_join(F.filter(F.transform(F.split(x, "[ -]"), word), lambda w: w != ""), " "))


def trivia(x: Column) -> Column:
    """Lower-cased, without ASCII punctuation."""
    return F.translate(F.lower(x), PUNCTUATION, "")


def task_lines(x: Column) -> Column:
    """A full stop between spaces ends a line."""
    return F.replace(x, F.lit(" . "), F.lit(".\n"))


def school_math(x: Column) -> Column:
    """The number after four hash signs, without thousands commas; else ``[invalid]``."""
    found = F.regexp_extract(x, r"#### (-?[0-9.,]+)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).otherwise("[invalid]")


def multilingual(x: Column, language: str, lower: bool = True) -> Column:
    """Without the language's articles and any punctuation, words parted by single spaces. Words are what white space parts."""
    bare = F.regexp_replace(without_articles(x, language), r"[\p{P}$+<=>^`|~]", "")
    return one_spaced(F.lower(bare) if lower else bare)


def per_character(log_probs: Column, choices: Column, ignore_first_space: bool = False) -> Column:
    """Log-probabilities over the choices' lengths."""
    size = (lambda c: F.length(c) - F.when(c.startswith(" "), 1).otherwise(0)) if ignore_first_space else F.length
    return F.zip_with(log_probs, choices, lambda p, c: p / size(c))


def per_token(log_probs: Column, n_tokens: Column) -> Column:
    return F.zip_with(log_probs, n_tokens, lambda p, n: p / n)


def over_unconditioned(log_probs: Column, unconditioned: Column) -> Column:
    """Pointwise mutual information: how much likelier a choice gets by the question."""
    return F.zip_with(log_probs, unconditioned, lambda p, q: p - q)
