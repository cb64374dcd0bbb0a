"""Quality rules, line first: judge every line, remove failing ones, then reject texts that lose too much.

A line, of any length, without the white space around it, fails if it
* looks like navigation: parts between | > / or bullets, one for every three words or more, or a menu word alone (en, fr, de, es);
* is boilerplate: sentences with a notice (cookies, scripts, copyright, subscriptions; en, fr, de, es) hold half of its signs, or the line is
  widespread in the corpus;
* has ``prose_words`` words or more and no closing punctuation. Headings (marked, or with capitals on all words but short ones), list items (marked)
  and code (indented, or with operators) are told by form and need none.
Lines without words neither count nor fail. A text is kept if its base rules hold and the words in surviving
lines are at least ``least_kept`` of all its words.

Widespread lines are counted over all texts: a line that stands between at least ``LEAST_PLACES`` different pairs of neighbours, and in half as many
such pairs as texts or more. The latter tells a site's footer from the lines of texts with many copies, which have the same
neighbours everywhere and don't fail. Neither number depends on the size of the corpus. A text's lines and what else is judged of it are
written once to the shared folder; widespread lines are a table too, joined to the lines, so that there may be any number of them. Lines count as equal
if their 64-bit hashes are.

Windows of eight words are compared within a text by sorting arrays of word numbers: exact, whole texts, no cap.
Null and empty texts have no words and fail; rows that repeat an id are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

LEAST_PLACES = 20
#: Only the SQL of op10 still lets the least number of places rise, so that there are at most so many widespread lines.
MOST_LINES = 1 << 20
#: bytes.split() parts at the six signs \x20 and \x09-\x0D; str.split() would part at more.
_SIGNS = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Patterns that Python's regex module and RE2 read alike; MENU and NOTICE see A-Z lower-cased.
MENU = (
    r"^[^\p{L}\p{N}]*(?:home|menu|search|login|log in|sign in|sign up|share|next|previous|back to top|read more|skip to content|contact|about us|accueil|rechercher|connexion|se connecter|partager|suivant|"
    r"précédent|lire la suite|haut de page|startseite|suche|anmelden|teilen|weiter|zurück|mehr lesen|nach oben|[üÜ]ber uns|impressum|inicio|menú|buscar|iniciar sesión|compartir|siguiente|anterior|leer más|volver arriba)[^\p{L}\p{N}]*$"
)
NOTICE = (
    r"all rights reserved|enable javascript|cookie policy|use of cookies|terms of (?:use|service)|privacy policy|subscribe to our newsletter|lorem ipsum|tous droits réservés|politique de confidentialité|utilisation de cookies|"
    r"conditions d.utilisation|alle rechte vorbehalten|datenschutzerklärung|verwendung von cookies|nutzungsbedingungen|todos los derechos reservados|política de privacidad|uso de cookies|términos de uso"
)
BARS = r"[ \t][|>»•/·][ \t]"
SENTENCE = r"[^.!?。！？]+[.!?。！？]*"
MARKED = r"^(?:[-*+•·–—‣▪◦]|#{1,6}|\(?(?:[0-9]{1,3}(?:\.[0-9]{1,3})*|[A-Za-z]|[ivxIVX]{1,5})[.)]|[0-9]{1,3}(?:\.[0-9]{1,3})+)[ \t]"
CODE = r"^(?:\t|  |//|#include)|[ \t](?:[-+*/%|&:]?=|[=!]=|[-=]>|&&|\|\|)[ \t]"
LETTERS = r"[\p{L}\p{N}]+"
CAPITAL = r"^[\p{Lu}\p{Nd}]"
ENDS = ".!?:;\"'”’»)]}…。！？"
_MENU, _NOTICE, _BARS, _SENTENCE, _MARKED, _CODE, _LETTERS, _CAPITAL = map(regex.compile, (MENU, NOTICE, BARS, SENTENCE, MARKED, CODE, LETTERS, CAPITAL))
_ENDS = tuple(x.encode() for x in ENDS)


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that stand twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))
    if len(numbers) == len(words):
        return 0
    # A window can only repeat where its first word does.
    often = np.bincount(ids)[ids[:n]] > 1
    starts = np.flatnonzero(often)
    if len(starts) < 2:
        return 0
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, width)[starts])
    _, inverse, counts = np.unique(windows.view(np.dtype((np.void, windows.dtype.itemsize * width))).ravel(), return_inverse=True, return_counts=True)
    hit = starts[counts[inverse] > 1]
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_hash(line: bytes) -> int:
    """Of a line without the white space around it, signed."""
    h = xxhash.xxh64_intdigest(line, seed=42)
    return h - (1 << 64) if h >> 63 else h


def _free_form(line: str, stripped: str) -> bool:
    """A heading, list item or line of code by its form."""
    if _MARKED.search(stripped) or _CODE.search(line):
        return True
    long = [w for w in _LETTERS.findall(stripped) if len(w) > 3]
    return bool(long) and all(map(_CAPITAL.search, long))


def line_fails(line: bytes, n_words: int, prose_words: int = 5, widespread: frozenset[int] | set[int] = frozenset()) -> str | None:
    """The rule that removes a line, or none."""
    bare = line.strip()
    text = bare.decode("utf-8", "surrogatepass")
    low = text.translate(_LOWER)
    if len(_BARS.findall(text)) * 3 >= n_words or _MENU.search(low):
        return "navigation"
    if _NOTICE.search(low) and 2 * sum(len(x) for x in _SENTENCE.findall(low) if _NOTICE.search(x)) >= len(low):
        return "boilerplate"
    if widespread and line_hash(bare) in widespread:
        return "boilerplate"
    if n_words >= prose_words and not bare.endswith(_ENDS) and not _free_form(line.decode("utf-8", "surrogatepass"), text):
        return "punctuation"
    return None


def line_places(raw: bytes) -> dict[int, int]:
    """Hashes of a text's distinct lines, each with a hash of the neighbours where it stands first."""
    lines = [line_hash(x) for x in (y.strip() for y in raw.split(b"\n")) if x]
    first: dict[int, int] = {}
    for before, line, after in zip([0, *lines], lines, [*lines[1:], 0], strict=False):
        if line not in first:
            h = xxhash.xxh64_intdigest(b"%d %d" % (before, after))
            first[line] = h - (1 << 64) if h >> 63 else h
    return first


def _lines():
    def each(rows):
        found = [line_places((text or "").encode("utf-8", "surrogatepass")) for (text,) in rows]
        return [(list(x), list(x.values())) for x in found]

    return each


def _counted(rows: DataFrame, least_places: int) -> DataFrame:
    """(line, places, texts) of (line array, place array). Lines in too few places only add to the total, so they are summed to one row."""
    each = rows.select(F.explode(F.arrays_zip("line", "place")).alias("z")).groupBy("z.line", "z.place").count()
    each = each.groupBy("line").agg(F.count("*").alias("places"), F.sum("count").alias("texts"))
    return each.groupBy(F.when(F.col("places") >= least_places, F.col("line")).alias("line")).agg(F.sum("places").alias("places"), F.sum("texts").alias("texts"))


def widespread(rows: DataFrame, least_places: int = LEAST_PLACES) -> DataFrame:
    """The widespread lines (line) of texts' (line array, place array), any number of them."""
    return _counted(rows, least_places).where(F.col("line").isNotNull() & (2 * F.col("places") >= F.col("texts"))).select("line")


def widespread_lines(docs: DataFrame, least_places: int = LEAST_PLACES, most_lines: int | None = None) -> np.ndarray:
    """Hashes of the lines of ``docs`` that are widespread, sorted. For callers that can hold only ``most_lines``, the least number of places rises with the corpus."""
    each = _counted(arrow_map(docs.select("text"), "line array<long>, place array<long>", _lines), least_places)
    need = least_places
    if most_lines:
        each = materialize(each, "line-places")
        need = max(need, -(-(each.agg(F.sum("texts")).first()[0] or 0) // most_lines))
    found = each.where(F.col("line").isNotNull() & (F.col("places") >= need) & (2 * F.col("places") >= F.col("texts"))).select("line").toArrow()
    return np.sort(found.column("line").to_numpy())


def judge(text: str | None, min_words: int = 20, most_repeat: int = 30, least_kept: float = 0.5, prose_words: int = 5, widespread: frozenset[int] | set[int] = frozenset()) -> dict:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, seen, dup, left, kept = raw.split(), set(), 0, 0, []
    n = len(words)
    for line in raw.split(b"\n"):
        if not (k := len(line.split())):
            continue
        dup += line in seen
        seen.add(line)
        if line_fails(line, k, prose_words, widespread) is None:
            left += k
            kept.append((line, k))
    repeats = repeat_words(words)
    failed = n < min_words or 100 * repeats > most_repeat * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, _SIGNS)),
        "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": not failed and left >= least_kept * n,
        "kept_words": left,
        "kept_lines": kept,
        "cleaned": b"\n".join(x for x, _ in kept).decode("utf-8", "surrogatepass"),
    }
