"""License scans, quality rules, BPE, token files, URL rules."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import NASTY, SCHEMA, collect, documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradeloom.llm.byte_bpe import BytePairEncoder, load_ranks
from gradeloom.llm.license_scan import TEMPLATES, Automaton, Template, _parse, scanner, words_of
from gradeloom.llm.line_rules import judge, line_fails
from gradeloom.llm.queries_byte_bpe import byte_bpe_digests
from gradeloom.llm.queries_license_scan import license_scan
from gradeloom.llm.queries_line_rules import SQL, line_rules
from gradeloom.llm.queries_url_filter import url_filter
from gradeloom.llm.batch_tokenizer import BatchTokenizer
from gradeloom.llm.token_files import read_tokens, token_file_digests, write_tokens
from gradeloom.llm.url_filter import PATTERN_RULES, UrlFilter, host_path, sure_tokens

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def bpe():
    return BytePairEncoder(load_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in RANKS.splitlines())}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n\t　'sé漢😀1.,!\x1c\x85")), max_size=40), max_size=4))
def test_bpe_equals_tiktoken(texts):
    e, k = _bpe(), _known()
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_texts(texts)] == [k.encode_ordinary(t) for t in texts]


_KEPT = {}


def _bpe():
    if "bpe" not in _KEPT:
        _KEPT["bpe"] = BytePairEncoder(load_ranks(RANKS), public_tokenizers.PATTERN)
    return _KEPT["bpe"]


def _known():
    if "known" not in _KEPT:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in RANKS.splitlines())}
        _KEPT["known"] = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _KEPT["known"]


def test_bpe_long_pieces_and_forgetting(bpe, known):
    bpe.chunks.most = 50
    texts = ["ab" * 700, "x" * 65, "é" * 100, "a b c " * 30, "".join(random.Random(1).choices("abcde", k=4000))]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(texts)] == [known.encode_ordinary(t) for t in texts]
        texts.append(" ".join(f"word{len(texts)}{i}" for i in range(80)))
    bpe.chunks.most = 900_000


def test_bpe_with_other_patterns():
    """A pattern that joins words across spaces is split whole; one that parts before them isn't."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in RANKS.splitlines())}
    texts = ["one two  three", "a b c d", " x", "", "it's 3 o'clock\nnow then"]
    for pattern in (r"\w+ \w+|\s+|\S+", r"[a-z]+ ?|[^a-z]", r"(?s).+", public_tokenizers.PATTERN):
        e, k = BytePairEncoder(load_ranks(RANKS), pattern), tiktoken.Encoding("p", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_texts(texts)] == [k.encode_ordinary(t) for t in texts]
        assert e.parts == (pattern == public_tokenizers.PATTERN)


def test_bpe_query(spark, known):
    rows = documents()
    want = []
    for doc_id, text, *_ in rows:
        ids = known.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert collect(byte_bpe_digests(frame(spark, rows))) == sorted(want, key=repr)
    assert byte_bpe_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_files(spark, tmp_path):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    rows, want, at = documents(), [], 0
    for doc_id, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert collect(token_file_digests(frame(spark, rows), JSON, str(tmp_path / "t"))) == sorted(want, key=repr)
    one = read_tokens(spark, str(tmp_path / "t")).where("doc_id = 5").collect()
    assert [r.start for r in one] == [want[5][1]]
    write_tokens(spark.createDataFrame([], SCHEMA), JSON, str(tmp_path / "e"))
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0
    twice = frame(spark, [(1, "b", "", "", 0), (1, "a", "", "", 0), (None, "c", "", "", 0)])
    assert sorted(r.start for r in token_file_digests(twice, JSON).collect()) == [0, 2, 4]
    same = frame(spark, [(7, "b c", "", "", 0)] * 300)  # one id and text on all rows
    assert sorted((r.start, r.n_tokens) for r in token_file_digests(same, JSON).collect()) == [(3 * i, 3) for i in range(300)]


def test_batches_equal_single_texts(monkeypatch):
    import pyarrow as pa

    from gradeloom.llm import batch_tokenizer

    t, rng = BatchTokenizer(open(JSON, "rb").read()), random.Random(0)
    signs = ["a", "Word", "été", " ", " ", "  ", "\n", "\n", "\t", "\r", ".", ",", "!", "'s", "1", "漢", "😀", "\x1c", "\x85", "　", "\xa0", "<|endoftext|>", "ſ"]
    for most in (1 << 18, 3):
        monkeypatch.setattr(batch_tokenizer, "REMEMBERED", most)
        monkeypatch.setattr(batch_tokenizer, "AT_ONCE", 5 if most == 3 else 5000)
        for _ in range(30):
            texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(50)] + NASTY + ["a   b", "end ", " \n x", "it's I'LL", "one\ntwo. three\nfour"]
            assert t.encode(pa.array(texts), 0).to_pylist() == [[*t.whole(x or ""), 0] for x in texts]
    assert len(t.encode(pa.array([], pa.string()))) == 0


def brute_matches(items, words):
    """All lengths that a template's items accept at the start of words."""
    ends = {0}
    for x in items:
        if isinstance(x, bytes):
            ends = {e + 1 for e in ends if e < len(words) and words[e] == x}
        elif x[0] == "opt":
            ends |= {e + k for e in ends for k in brute_matches(x[1], words[e:])}
        else:
            ends = {e + k for e in ends for k in range(x[1] + 1) if e + k <= len(words)}
    return ends


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=8))
def test_automata_equal_brute_force(words):
    for markup in ("a [[b]] {{x:2}} c", "[[a [[b]] c]] a", "{{x:1}} [[a]] [[b]]", "a b"):
        items = _parse(markup)
        assert Automaton(items).longest(words, 0) == max(brute_matches(items, words), default=None)


def test_templates_accept_only_exact_mandatory_words():
    t = Template("t", "permission to use [[and copy]] {{what:2}} is granted")
    spans = lambda s: t.spans(b" " + b" ".join(words_of(s)) + b" ", words_of(s))
    assert spans("x Permission to use, and copy this is GRANTED y") == [(1, 9)]
    assert spans("permission to use one two three is granted") == []
    assert spans("permission to use is granted permission to use x is granted") == [(0, 5), (5, 11)]
    assert all(Template(k, v).n >= 2 for k, v in TEMPLATES.items() if k != "cc0-line")


MIT = """MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def filled(label: str, optional: bool) -> str:
    """A template's text, its replaceable regions by their usual wording, with or without what is optional."""
    t = TEMPLATES[label]
    while "[[" in t:
        t = re.sub(r"\[\[((?:(?!\[\[|\]\]).)*)\]\]", r" \1 " if optional else " ", t, flags=re.S)
    return re.sub(r"\{\{[^}|]*\|?([^}]*)\}\}", r" \1 ", t)


@pytest.mark.parametrize("label", sorted(TEMPLATES))
def test_whole_licences(label):
    s = scanner()
    for optional in (False, True):
        text = filled(label, optional)
        assert label in s(f"Before it, {text.upper()}. After it")["labels"], label
        if label.endswith("-text"):
            x = s(text)
            assert x["score"] == 1.0 and x["labels"] == [label]  # no other licence
    if label.endswith("-text"):  # every mandatory word changed or left out in turn
        words = [x for x in _parse(TEMPLATES[label]) if isinstance(x, bytes) or x[0] == "var"]
        text = [x.decode() if isinstance(x, bytes) else "someone" for x in words]
        t = Template(label, TEMPLATES[label])
        accepts = lambda w: bool(t.spans(b" " + " ".join(w).encode() + b" ", [x.encode() for x in w]))
        assert accepts(text)
        for i, x in enumerate(words):
            if isinstance(x, bytes):
                assert not accepts([*text[:i], "otherwise9", *text[i + 1 :]]) and not accepts([*text[:i], *text[i + 1 :]])


def test_licence_of_a_file():
    x = scanner()(MIT)
    assert x["labels"] == ["mit-text"] and x["score"] == 1.0 and x["base"] == []
    assert scanner()("intro words here " + MIT)["spans"][0][0] == 3
    assert "mit-text" not in scanner()(MIT.replace("without limitation", "with some limitation"))["labels"]


def test_replaceable_regions_stay_inside():
    for bad in ("{{x:2}} a b", "a b [[c {{x:2}}]]", "[[{{x:2}} c]] a"):
        with pytest.raises(ValueError):
            Template("t", bad)
    x = scanner()("many other words stand before it this is licensed under the mit license and many others after it")
    assert x["score"] == pytest.approx(6 / 18)


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = sorted((i, label) for p, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


def as_regex(items):
    return b"".join(re.escape(x) + b" " if isinstance(x, bytes) else b"(?:" + as_regex(x[1]) + b")?" if x[0] == "opt" else b"(?:[^ ]+ ){0,%d}" % x[1] for x in items)


def test_license_query_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(None, MIT, "", "", 0), (7, "cc by nc cc-by-nc", "", "", 0), (7, "CC BY NC", "", "", 0), (8, "x " * 50000 + "under the MIT license", "", "", 0), (9, None, "", "", 0), (10, "\x00\x7fcc\x01by`nc", "", "", 0)]
    got = sorted((tuple(r) for r in license_scan(d).union(license_scan(frame(spark, odd))).collect()), key=repr)
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] + [(r[0], r[1]) for r in odd]
    assert sorted((r[:6] for r in got), key=repr) == sorted(((i, *brute_base(t)) for i, t in rows), key=repr)
    patterns = {k: re.compile(b" " + as_regex(_parse(v))) for k, v in TEMPLATES.items()}

    def labels(text):
        norm = b" " + b"".join(w + b" " for w in words_of(text))
        return ",".join(sorted({k for k, p in patterns.items() if p.search(norm)} | set(filter(None, brute_base(text)[4].split(",")))))

    assert sorted((r[0] or -1, r[6]) for r in got) == sorted((i or -1, labels(t)) for i, t in rows)
    assert all(0 <= r[7] <= 1 and (r[7] > 0) == bool(r[6]) for r in got)
    assert license_scan(frame(spark, odd).limit(0)).count() == 0


def test_license_base_counts():
    s = scanner()
    x = s("Under the MIT License. under the mit-license! CC BY NC cc by-nc\nApache License, Version 2.0")
    assert len(x["starts"]) == 5 and min(x["starts"]) == 0
    assert {"mit", "apache-2", "cc-by-nc"} <= set(x["labels"]) and x["base"] == ["apache-2", "cc-by-nc", "mit"]
    assert 0 < x["score"] <= 1
    assert s(None) == s("") and s("")["score"] == 0.0


def test_license_query(spark):
    rows = documents(12) + [(900, "This work is under the MIT license", "", "", 0)]
    got = {r.doc_id: r for r in license_scan(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert (got[900].n_base, got[900].first_word, got[900].base_labels) == (1, 3, "mit")
    assert got[0].first_word is None and got[0].labels == ""
    for doc_id, text, *_ in rows:
        assert got[doc_id].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def test_line_rules_equal_sql(spark):
    import duckdb
    import pandas as pd

    rows = documents() + [(500, "same line here\nsame line here\n \nx #*$", "", "", 0), (501, "a b c d e f g h " * 5, "", "", 0), (None, "one\ntwo", "", "", 0), (500, "again", "", "", 0)]
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    shapes = ["{}.\n{}", "- {}\n  {}", "{} = {}", "A | B | {}\n{}!", "{}. All rights reserved.\n{}", "Über uns\n{}\n{};", "Tous droits réservés {}. {}", "1.2 {}\n(a) {}", "{}”\n{}…", "Zzzzz Yyyyy\r\n{}\t{}\nHOME"]
    rows += [(600 + i, shapes[i % len(shapes)].format(words(i, 3 + i % 30), words(-i, 12)) + "\nEvery page ends so: see below now\n", "", "", 0) for i in range(60)]
    documents_table = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    documents_table["doc_id"] = documents_table["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents_table)
    found = con.execute(SQL)
    names = [x[0] for x in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = line_rules(frame(spark, rows)).collect()
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == want
    assert len({r.kept for r in got}) == 2
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert line_rules(frame(spark, rows).limit(0)).count() == 0


def test_widespread_lines_but_not_copies(spark):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n)) + "."
    footer, copied = "Shop hours are nine to five, see the map for how to get here.", "\n".join(words(f"c{j}", 9) for j in range(6))
    pages = [(i, f"{words(i, 9)}\n{footer}\n{words(-i, 3)}\n{footer}", "", "", 0) for i in range(40)]
    near = ["\n".join(words(f"n{j}" if j != i % 20 else f"n{j}y{i}", 9) for j in range(20)) for i in range(200)]  # each copy has one line of its own
    rows = pages + [(100 + i, copied, "", "", 0) for i in range(300)] + [(1000 + i, t, "", "", 0) for i, t in enumerate(near)]
    got = {r.doc_id: r for r in line_rules(frame(spark, rows)).collect()}
    assert all(not got[i].kept and got[i].kept_words == 12 for i in range(40))
    assert all(got[i].kept and got[i].kept_words == got[i].n_words for i in got if i >= 100)
    from gradeloom.llm.line_rules import line_hash, widespread_lines

    assert widespread_lines(frame(spark, rows)).tolist() == [line_hash(footer.encode())]
    assert widespread_lines(frame(spark, rows), most_lines=3).tolist() == []  # the bound rises with the corpus


def test_widespread_lines_at_any_size_of_the_corpus(spark):
    """A footer fails as before when the corpus has very many other lines, and there may be more widespread lines than texts."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n)) + "."
    footers = [f"Shop number {j} is open from nine to five, see the map." for j in range(50)]
    pages = [(i, "\n".join(f"{words(f'p{i}j{j}', 4)}\n{f}" for j, f in enumerate(footers)), "", "", 0) for i in range(25)]
    # As if lines were 21 million and more, where the least number of places rose: the bound of 2 ** 20 lines, made smaller.
    others = [(100 + i, "\n".join(words(f"o{i}j{j}", 5) for j in range(20)), "", "", 0) for i in range(30)]
    from gradeloom.llm import line_rules as module

    bound, sizes = module.MOST_LINES, module.widespread_lines.__defaults__
    try:
        module.MOST_LINES = 30
        module.widespread_lines.__defaults__ = tuple(30 if x == bound else x for x in sizes)
        few = {r.doc_id: tuple(r) for r in line_rules(frame(spark, pages)).collect()}
        more = {r.doc_id: tuple(r) for r in line_rules(frame(spark, pages + others)).collect()}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = {r.doc_id: tuple(r) for r in line_rules(frame(spark, pages + others)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        module.MOST_LINES, module.widespread_lines.__defaults__ = bound, sizes
    assert all(more[i] == few[i] and few[i][-1] == 200 and not few[i][-2] for i in few)
    assert joined == more


def test_line_rules_method():
    assert line_fails(b"Home | About | Contact", 5) == "navigation"
    assert line_fails(b"Login", 1) == "navigation"
    assert line_fails("Über uns".encode(), 2) == line_fails("« Précédent".encode(), 1) == "navigation"
    assert line_fails(b"All rights reserved.", 3) == "boilerplate"
    assert line_fails(b"w " * 40, 40) == "punctuation"
    assert line_fails(b"w " * 40 + b"end.", 41) is None
    good = "This is a clean sentence with many plain words in it."
    repeated = "\n".join(f"{good} number {i} stands alone here." for i in range(5))
    assert judge(repeated)["base_failed"] and not judge(repeated)["kept"]  # eight words of each line stand in all of them
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(12)) + " stands here." for i in range(5))
    assert judge(text)["kept"] and judge(text)["cleaned"] == text
    assert not judge(text + "\nHome | A | B" * 30)["kept"]
    assert not judge(None)["kept"]


def brute_verdict(url):
    low = url.translate({i: i + 32 for i in range(65, 91)})
    hits = {a for a, p in PATTERN_RULES if re.search(p, low)}
    return "block" if "block" in hits and "allow" not in hits else "allow"


def test_url_index_misses_no_rule():
    rng, f = random.Random(3), UrlFilter()
    hosts = ["ads", "blog", "m", "www", "tracker", "archive", "casino", "x-casino-y", "1.2.3.4", "pixel"]
    parts = ["login", "wp-login.php", "wp-admin", "cart", "mycart", "tag", "page", "7", "a.zip", "a.tar.gz", "fr", "x", "feed", "feed.xml", "search", "docs", "licences", "my-account", "myaccount", "calendar", "2024", "05", "cgi-bin", "xmlrpc.php", "banner", "banners"]
    args = ["utm_source=feed", "ref=x", "sessionid=0123abcd", "replytocom=5", "sid=0123456789abcdef", "sortby=name", "order=up", "print=1", "print=12", "utm_campaign=big-spam", "add-to-cart=7"]
    hits = set()
    for _ in range(6000):
        url = f"http://{rng.choice(hosts)}{rng.choice(['.site.info', '', ':80'])}" + rng.choice(["/", "", "//"]) + "/".join(rng.choices(parts, k=rng.randint(0, 4))) + rng.choice(["", "/", "?", "#t", "?q&"]) + "&".join(rng.choices(args, k=rng.randint(0, 2)))
        assert f.judge(url)[3] == brute_verdict(url), url
        hits |= {p for _, p in PATTERN_RULES if re.search(p, url)}
    assert len(hits) > 0.9 * len(PATTERN_RULES)
    assert len(f.always) <= 0.1 * len(PATTERN_RULES)


def test_tokens_from_expression_trees():
    assert sure_tokens(r"/cart(?:[/?#]|$)") == [{"cart"}] * 2
    assert sure_tokens(r"a.cart/") == [set()] and sure_tokens(r"a\.cart/") == [{"cart"}]  # a bare dot may be a letter
    assert sure_tokens(r"/(?:ads|pixel)/") == [{"ads"}, {"pixel"}]
    assert sure_tokens(r"/tags?/x/") == [{"tag", "x"}, {"tags", "x"}]
    assert sure_tokens(r"[?&]ref=\w+-end\b") == [{"ref", "end"}]
    assert sure_tokens(r"/a+/-+b/") == [{"b"}]
    assert sure_tokens(r"x(?:/|yy)") == [set(), set()]
    many = "/" + "(?:aa|bb|cc|dd)/" * 8
    assert all(sure_tokens(many)) and len(sure_tokens(many)) <= 256


def test_few_rules_run_on_the_tables_urls():
    import pyarrow.parquet as pq

    f = UrlFilter()
    urls = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["url"]).column(0).to_pylist()
    found = [x for x in map(f.judge, urls) if x[2] is None]
    assert sum(x[4] for x in found) <= (len(f.always) + 1) * len(found)


def test_url_rules(spark):
    rows = [(1, "http://a.Example.com/en/712?x"), (2, "https://com/en/1"), (3, "http://x.net/de/"), (4, "http://example.net/de/8"), (5, "http://org/es/1#t"), (6, None), (7, "nothing"), (8, "http://notexample.com/en/7"), (9, "http://h?/en/"), (10, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' html", "1 host")
    got = {r.page_id: tuple(r)[1:] for r in url_filter(df).collect()}
    assert got[1] == ("a.example.com", "/en/712", "example.com/en/7", "allow")
    assert got[2] == ("com", "/en/1", "com/en/", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("org/es/", "block")
    assert got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[8][2:] == ("com/en/", "block") and got[9][:2] == ("h", "")
    assert host_path("x://a:80/b") == ("a:80", "/b")
    assert url_filter(df.limit(0)).count() == 0
