"""Text assembly rules, tokens, n-grams and counts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split() parts at, as a regular-expression class that Java and RE2 read alike.
SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_TOKEN = rf"[^{SPACES}]+"
#: Words and single other signs; stands in for a Treebank tokenizer.
GRAM_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACES}]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside lambdas Spark would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _given(c: str) -> Column:
    """A field as text, null where it counts as missing (null or empty)."""
    text = F.col(c).cast("string")
    return F.when(text != "", text)


def record_text(instruction: str = "instruction", input: str = "input", output: str = "output") -> Column:
    """Instruction, input if there is one, output: one per line; an empty output keeps its line."""
    more = F.when(F.coalesce(F.col(input), F.lit("")) != "", F.concat(F.col(input), F.lit("\n"))).otherwise("")
    return F.concat(F.coalesce(F.col(instruction), F.lit("")), F.lit("\n"), more, F.coalesce(F.col(output), F.lit("")))


def field_text(*fields: str) -> Column:
    """The given fields that aren't empty, one per line."""
    return F.concat_ws("\n", *(_given(f) for f in fields or ("instruction", "input", "output")))


def single_field(field: str = "output") -> Column:
    return F.coalesce(F.col(field), F.lit(""))


def stripped_fields(*fields: str, separator: str = "\n") -> Column:
    strip = lambda f: F.regexp_replace(F.coalesce(F.col(f).cast("string"), F.lit("")), rf"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.concat_ws(separator, *(F.when(strip(f) != "", strip(f)) for f in fields or ("instruction", "input", "output")))


def always_joined(*fields: str) -> Column:
    """All fields joined, empty ones too."""
    return F.concat_ws("\n", *(F.coalesce(F.col(f), F.lit("")) for f in fields or ("instruction", "input", "output")))


def prompt_text() -> Column:
    """Instruction and input without the output."""
    return F.concat_ws("\n", F.col("instruction"), _given("input"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(0))


def grams(text: Column) -> Column:
    """Lower-cased words and signs."""
    return F.regexp_extract_all(F.lower(text), F.lit(GRAM_TOKEN), F.lit(0))


def bare_words(text: Column) -> Column:
    """Words lower-cased, ASCII punctuation taken out; words that become empty stay as the empty string."""
    return F.transform(words(text), lambda w: F.lower(F.translate(w, PUNCTUATION, "")))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, as strings parted by a sign that no token holds."""
    some = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), "\x1f"))
    return let(tokens, lambda t: F.when(F.size(t) >= n, some(t)).otherwise(F.array().cast("array<string>")))


def unique_share(items: Column) -> Column:
    return let(items, lambda x: F.when(F.size(x) > 0, F.size(F.array_distinct(x)) / F.size(x)).otherwise(0.0))


def folded_counts(items: Column, each) -> Column:
    """Sum of each(count) over the distinct items: one pass over the sorted array, no shuffle. ``each`` maps a Column to a Column; each(0) must be 0."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sum"))

    def step(a, x):
        same = x == a["last"]
        return F.struct(x.alias("last"), F.when(same, a["n"] + 1).otherwise(F.lit(1)).cast("long").alias("n"), F.when(F.coalesce(same, F.lit(False)), a["sum"]).otherwise(a["sum"] + each(a["n"])).alias("sum"))

    return F.aggregate(F.array_sort(items), start, step, lambda a: a["sum"] + each(a["n"]))


def entropy_bits(items: Column) -> Column:
    """Shannon entropy in bits of the items' frequencies; 0 without items."""
    total = lambda x: folded_counts(x, lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0))
    return let(items, lambda x: F.when(F.size(x) > 0, F.greatest(F.log2(F.size(x).cast("double")) - total(x) / F.size(x), F.lit(0.0))).otherwise(0.0))


THINK_TAG = r"(?i)</?(?:think|redacted_reasoning)\s*>"
THINK_BLOCK = r"(?is)<(think|redacted_reasoning)\s*>(.*?)</(?:think|redacted_reasoning)\s*>"


def has_think(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike(THINK_TAG), 1.0).otherwise(0.0)


def pure_think(text: Column) -> Column:
    """-2 without tags; -1 if no code fence stands outside the blocks; 0 if the first block holds one; else 1."""
    text = F.coalesce(text, F.lit(""))
    outside, first = F.regexp_replace(text, THINK_BLOCK, ""), F.regexp_extract(text, THINK_BLOCK, 2)
    return F.when(~text.rlike(THINK_TAG), -2.0).when(~outside.contains("```"), -1.0).when(first.contains("```"), 0.0).otherwise(1.0)


def occurrences(text: Column, word: Column | str) -> Column:
    """Non-overlapping places of a word in a text."""
    w = F.lit(word) if isinstance(word, str) else word
    return ((F.length(text) - F.length(F.replace(text, w, F.lit("")))) / F.length(w)).cast("long")


def logical_words(text: Column, listed: list[str], mode: str = "substring") -> Column:
    """How often listed words stand in a text, A to Z alike; ``token`` takes whole words, with punctuation as space. Words listed twice in other case count twice as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    listed = [w.lower() for w in dict.fromkeys(listed) if w]
    if mode == "substring":
        return sum((occurrences(low, w) for w in listed), F.lit(0).cast("long"))
    marks = PUNCTUATION + "，。！？；：、（）【】《》“”‘’"
    plain = F.translate(low, marks, " " * len(marks))
    return F.size(F.filter(words(plain), lambda w: w.isin(*sorted(set(listed))))).cast("long")


def logical_word_counts(text: Column, listed: list[str], mode: str = "substring") -> Column:
    """The same word by word, as a map; words that don't occur have 0. Case variants of a word share its count as a token."""
    words_ = [w for w in dict.fromkeys(listed) if w]
    return F.create_map(*(x for w in words_ for x in (F.lit(w), logical_words(text, [w], mode))))
