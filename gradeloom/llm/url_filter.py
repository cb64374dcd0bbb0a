"""URL filters: pattern rules indexed by their rarest literal token.

A rule is an action and a regular expression over the url (A-Z lower-cased). A url's tokens are its longest runs of a-z and 0-9. The
expression's tree says which tokens a match must hold: it is unrolled into its alternatives (branches, and optional
parts with and without), and a literal run counts in one of them where other signs, ends of the url or classes without token signs stand on
both sides. Every alternative takes its rarest token, the one that fewest rules hold, and the rule is indexed under each of these. A url's
tokens fetch candidate rules and only those run their expressions, so the cost of a url follows its own
length, not the number of rules. A rule with an alternative that has no sure token is tried on every url; one in ten of the rules here is.

Before them stand exact host / path rules, which decide alone: a rule fits its host and all subdomains if the path
starts with the rule's; the longest host + path wins. They are found by walking the host's suffixes in a dict.

Every url is judged whole, whatever its length; rows that repeat an id are judged each. Pattern rules see urls without ``://`` too; null urls are allowed.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import product
from re import _constants as C
from re import _parser

HOST_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: (action, expression). An allow outweighs a block. Python and RE2 read the expressions alike.
PATTERN_RULES = [
    # advertising and tracking hosts
    ("block", r"//(?:[^/?#]*\.)?(?:ads|adserver|doubleclick|adservice)\.[^/?#]*"),
    ("block", r"//(?:[^/?#]*\.)?(?:tracker|tracking|analytics|pixel|beacon)\.[^/?#]*"),
    ("block", r"/(?:adframe|adclick|banners?|sponsored)(?:[/.?#]|$)"),
    # accounts and shops
    ("block", r"/(?:wp-)?login(?:[./?#]|$)"),
    ("block", r"/(?:signin|signup|register|logout)(?:[./?#]|$)"),
    ("block", r"/(?:cart|basket|checkout|wishlist)(?:[/?#]|$)"),
    ("block", r"[?&]add-to-cart=[0-9]+"),
    ("block", r"/my-?account(?:[/?#]|$)"),
    # machines' pages
    ("block", r"/wp-(?:admin|json|content|includes)/"),
    ("block", r"/cgi-bin/"),
    ("block", r"/xmlrpc\.php(?:[?#]|$)"),
    ("block", r"/(?:feed|rss|atom)(?:/|\.xml)?(?:[?#]|$)"),
    ("block", r"/(?:search|suche|recherche|buscar)(?:[/?#]|$)"),
    # lists of lists
    ("block", r"/tag/[^/?#]+/page/[0-9]+"),
    ("block", r"/calendar/[0-9]{4}/[0-9]{1,2}(?:[/?#]|$)"),
    ("block", r"[?&]replytocom=[0-9]+"),
    ("block", r"[?&](?:sort|order)(?:by|_by)?=[a-z]+"),
    ("block", r"[?&]print=1(?:[&#]|$)"),
    # sessions and campaigns
    ("block", r"[?&](?:sessionid|phpsessid|jsessionid)=[0-9a-z]{8,}"),
    ("block", r"[?&]sid=[0-9a-f]{16,}"),
    ("block", r"//blog\.[^/?#]*/[^?#]*\?(?:[^#]*&)?utm_source=feed(?:[&#]|$)"),
    ("block", r"//m\.[^/?#]*/[^?#]*\?(?:[^#]*&)?ref=x(?:[&#]|$)"),
    ("block", r"[?&]utm_campaign=[^&#]*spam"),
    # what holds no text
    ("block", r"\.(?:zip|exe|jpg|jpeg|png|gif|mp4|mp3|iso|dmg|tar|gz)(?:[?#]|$)"),
    ("block", r"//[^/?#]*(?:casino|viagra|porn)[^/?#]*(?:[/?#]|$)"),
    ("block", r"//[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:[/?#]|$)"),
    # what is wanted all the same
    ("allow", r"//blog\.[^/?#]*/fr/"),
    ("allow", r"/(?:docs|manual|help)/[^?#]*search(?:[/?#]|$)"),
    ("allow", r"/licen[sc]es?/[^?#]*\.gz(?:[?#]|$)"),
    ("allow", r"//archive\.[^/?#]*/"),
]
_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = {i: i + 32 for i in range(65, 91)}


def lower_ascii(text: str) -> str:
    return text.translate(_UPPER)


def host_path(url: str | None) -> tuple[str, str]:
    """Host and path as the contract defines them; both empty without a url or ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = re.split("[?#]", url[at + 3 :], maxsplit=1)[0]
    k = rest.find("/")
    return (lower_ascii(rest), "") if k < 0 else (lower_ascii(rest[:k]), rest[k:])


#: Of an unrolled alternative: a sign that is surely no token sign, an end or edge of words, and anything else.
SEPARATOR, EDGE, UNKNOWN = "sep", "edge", "any"
MOST_ALTERNATIVES = 256


def _is_token(code: int) -> bool:
    return 97 <= code <= 122 or 48 <= code <= 57


def _unrolled(tree) -> list[list[str]]:
    """Alternatives as lists of literal signs, SEPARATOR, EDGE and UNKNOWN. Where there would be too many, a part becomes UNKNOWN."""
    parts: list[list[list[str]]] = []
    for op, value in tree:
        if op is C.LITERAL:
            parts.append([[chr(value)]])
        elif op is C.IN:
            plain = all(o is C.LITERAL and not _is_token(v) or o is C.RANGE and not any(map(_is_token, range(v[0], min(v[1], 127) + 1))) for o, v in value)
            parts.append([[SEPARATOR if plain else UNKNOWN]])
        elif op is C.BRANCH:
            parts.append([x for alternative in value[1] for x in _unrolled(alternative)])
        elif op is C.SUBPATTERN:
            parts.append(_unrolled(value[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            once = _unrolled(inner)
            if high == 1:
                parts.append(([[]] if low == 0 else []) + once)
            elif low and all(len(x) == 1 and (x[0] == SEPARATOR or len(x[0]) == 1 and not _is_token(ord(x[0]))) for x in once):
                parts.append([[SEPARATOR]])
            else:
                parts.append([[UNKNOWN]])
        elif op is C.AT:
            parts.append([[EDGE]])
        else:
            parts.append([[UNKNOWN]])
    n = 1
    for i, p in enumerate(parts):
        if n * len(p) > MOST_ALTERNATIVES:
            parts[i] = [[UNKNOWN]]
        n *= len(parts[i])
    return [[x for p in chosen for x in p] for chosen in product(*parts)]


def sure_tokens(pattern: str) -> list[set[str]]:
    """For each alternative of the expression the tokens that stand whole in every match of it."""
    out = []
    for signs in _unrolled(_parser.parse(pattern)):
        found, run, open_ = set(), "", False
        for x in [*signs, UNKNOWN]:
            if len(x) == 1 and _is_token(ord(x)):
                run += x
                continue
            free = x in (SEPARATOR, EDGE) or len(x) == 1
            if run and open_ and free:
                found.add(run)
            run, open_ = "", free
        out.append(found)
    return out


class UrlFilter:
    """``judge(url)`` gives (host, path, rule, verdict, patterns run)."""

    def __init__(self, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for host, path, action in host_rules:
            self.by_host[host].append((path, action))
        sure = [sure_tokens(p) for _, p in pattern_rules]
        seen = Counter(t for s in sure for t in set().union(*s))
        self.rules = [(action, re.compile(p)) for action, p in pattern_rules]
        self.index: dict[str, list[int]] = defaultdict(list)
        self.always = [i for i, s in enumerate(sure) if not all(s)]
        for i, s in enumerate(sure):
            if all(s):
                for t in {min(x, key=lambda t: (seen[t], -len(t), t)) for x in s}:
                    self.index[t].append(i)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        host, path = host_path(url)
        best, action = None, ""
        at = 0
        while host and at >= 0:
            tail = host[at:]
            for start, what in self.by_host.get(tail, ()):
                if path.startswith(start) and (best is None or len(tail + start) > len(best)):
                    best, action = tail + start, what
            at = host.find(".", at) + 1 or -1
        if best is not None:
            return host, path, best, action, 0
        low, verdict, found = lower_ascii(url or ""), "allow", set()
        tried = {i for t in set(_TOKEN.findall(low)) if t in self.index for i in self.index[t]}.union(self.always)
        for i in sorted(tried):
            what, p = self.rules[i]
            if what not in found and p.search(low):
                found.add(what)
        if "block" in found and "allow" not in found:
            verdict = "block"
        return host, path, None, verdict, len(tried)
