"""License scans by template-markup matching.

A template is license text with markup: ``[[ ... ]]`` is an optional region, ``{{name:N}}`` a replaceable one of
up to N words (``{{name:N|original words}}`` documents the usual wording). A template compiles to a token
automaton; a text is accepted where all mandatory words stand exactly and consecutively, with any of the optional
regions and any words in the replaceable ones. A replaceable region stands between words of its own template, never at the edge of a match, where it
would take in any neighbours. White space, punctuation and the case of A-Z never matter.

Whole licences are templates with all their conditions and disclaimers: an opening with other conditions isn't accepted, and licences that
differ by one clause get the label of theirs. Notices and lines that only name a licence have labels of their own.

The scan normalizes a text once to words joined by single spaces, in UTF-8 bytes. The longest run of mandatory
words of a template is searched as bytes; the automaton runs only around such places, forwards and
backwards over regions. So a text without licenses costs a few byte searches. Every text is seen whole; the map
needs no shuffle, and its memory is that of a few texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Lower-cases A-Z; every other ASCII sign that is no digit or letter separates words.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The wording of public licences, and of the notices that name them. Whole licences have labels that end in -text.
TEMPLATES = {
    "mit-text": """[[the]] [[mit license]] [[copyright [[c]] {{holder:12}}]] permission is hereby granted free of charge to any person obtaining a copy of this
        software and associated documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all
        copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but
        not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {{who:12|authors or
        copyright holders}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of
        or in connection with the software or the use or other dealings in the software""",
    "isc-text": """[[isc license]] [[copyright [[c]] {{holder:12}}]] permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{who:6|the
        author}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall
        {{who:6|the author}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or
        profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this
        software""",
    "0bsd-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and
        {{who:6|the author}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event
        shall {{who:6|the author}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data
        or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this
        software""",
    "bsd-2-text": """[[copyright [[c]] {{holder:12}} [[all rights reserved]]]] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
        are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]]
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or
        other materials provided with the distribution this software is provided by {{who:12|the copyright holders and contributors}} as is and any express or
        implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no
        event shall {{who:12|the copyright holder or contributors}} be liable for any direct indirect incidental special exemplary or consequential damages
        including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any
        theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software
        even if advised of the possibility of such damage""",
    "bsd-3-text": """[[copyright [[c]] {{holder:12}} [[all rights reserved]]]] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
        are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]]
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or
        other materials provided with the distribution [[3]] neither the name of {{name:12|the copyright holder}} nor the names of its contributors may be used
        to endorse or promote products derived from this software without specific prior written permission this software is provided by {{who:12|the
        copyright holders and contributors}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability
        and fitness for a particular purpose are disclaimed in no event shall {{who:12|the copyright holder or contributors}} be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or
        profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
        otherwise arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "zlib-text": """[[copyright [[c]] {{holder:12}}]] this software is provided as is without any express or implied warranty in no event will the {{who:1|authors}} be held liable for any damages arising from the
        use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you
        wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not
        required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may
        not be removed or altered from any source distribution""",
    "boost-text": """boost software license version 1 0 [[august 17th 2003]] permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare
        derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright
        notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in
        all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form
        of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or
        implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the
        copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from
        out of or in connection with the software or the use or other dealings in the software""",
    "unlicense-text": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize
        copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of
        any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no
        event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with the software or the use or other dealings in the software [[for more information please refer to [[http]] [[https]] unlicense org]]""",
    "apache-2-notice": """licensed under the apache license version 2 [[0]] the license you may not use {{what:3|this file}} except in compliance with the license you may obtain a copy
        of the license at [[http]] [[https]] [[www]] apache org licenses license 2 0 [[txt]] [[html]] unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license""",
    "gpl-notice": """is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
        software foundation [[either]] version {{version:1|3}} of the license [[or at your option any later version]] {{name:4|this program}} is distributed in the hope that it will be useful but without any
        warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""",
    "lgpl-notice": """is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free
        software foundation [[either]] version {{version:2|2 1}} of the license [[or at your option any later version]] {{name:4|this library}} is distributed in the hope that it will be useful but without any
        warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details""",
    "agpl-notice": """is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free
        software foundation [[either]] version {{version:1|3}} of the license [[or at your option any later version]] {{name:4|this program}} is distributed in the hope that it will be useful but without any
        warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details""",
    "mpl-2-notice": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can
        obtain one at [[http]] [[https]] [[www]] mozilla org mpl 2 0""",
    "cc-notice": "[[this work is]] licensed under [[a]] [[the]] creative commons {{kind:6|attribution}} [[{{version:2|4 0}}]] [[international]] [[unported]] license",
    "mit-line": "[[is]] [[released]] [[licensed]] [[available]] under the [[terms of the]] mit license",
    "apache-2-line": "[[released]] [[licensed]] under the [[terms of the]] apache license [[version]] 2 [[0]]",
    "gpl-line": "[[released]] [[licensed]] under the [[terms of the]] gnu [[lesser]] [[affero]] general public license [[version 2]] [[version 3]] [[v2]] [[v3]] [[or later]]",
    "bsd-line": "[[released]] [[licensed]] under the [[terms of the]] [[2 clause]] [[3 clause]] [[new]] [[modified]] [[simplified]] bsd license",
    "mpl-2-line": "[[released]] [[licensed]] under the [[terms of the]] mozilla public license [[v]] [[version]] 2 [[0]]",
    "cc0-line": "[[released]] [[dedicated]] [[licensed]] [[to the public domain]] [[under]] [[the]] cc0 [[1 0]] [[universal]]",
}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def places(norm: bytes, run: bytes) -> Iterator[int]:
    """Word numbers at which a run of words stands in a normalized text; each sign is counted once, however many places there are."""
    k, done, at = -1, 0, norm.find(run)
    while at >= 0:
        k, done = k + norm.count(b" ", done, at + 1), at + 1
        yield k
        at = norm.find(run, at + 1)


def _parse(markup: str) -> list:
    """Nested regions: bytes for a word, ("opt", [...]), ("var", most words)."""
    stack: list[list] = [[]]
    for t in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", markup):
        if t == "[[":
            stack.append([])
        elif t == "]]":
            part = stack.pop()
            stack[-1].append(("opt", part))
        elif t.startswith("{{"):
            stack[-1].append(("var", int(re.search(r":(\d+)", t)[1])))
        else:
            stack[-1] += words_of(t)
    if len(stack) != 1:
        raise ValueError(f"unbalanced regions in {markup!r}")
    return stack[0]


class Automaton:
    """States are numbers; ``step[s]`` has the words leaving s, ``any_[s]`` a state reached by any word, ``free[s]`` states reached by none."""

    def __init__(self, items: list):
        self.step: list[dict[bytes, set[int]]] = [{}]
        self.any_: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        self.final = self._add(items, 0)
        self.closure = [self._closed(s) for s in range(len(self.step))]

    def _new(self) -> int:
        self.step.append({})
        self.any_.append(set())
        self.free.append(set())
        return len(self.step) - 1

    def _add(self, items: list, at: int) -> int:
        for x in items:
            if isinstance(x, bytes):
                to = self._new()
                self.step[at].setdefault(x, set()).add(to)
                at = to
            elif x[0] == "opt":
                end, to = self._add(x[1], at), self._new()
                self.free[end].add(to)
                self.free[at].add(to)
                at = to
            else:
                to, here = self._new(), at
                self.free[here].add(to)
                for _ in range(x[1]):
                    nxt = self._new()
                    self.any_[here].add(nxt)
                    self.free[nxt].add(to)
                    here = nxt
                at = to
        return at

    def _closed(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def longest(self, words: list[bytes], at: int, by: int = 1) -> int | None:
        """Most words from ``at`` (towards ``by``) that the automaton accepts."""
        states, best, n = set(self.closure[0]), None, 0
        while True:
            if self.final in states:
                best = n
            i = at + n * by
            if not 0 <= i < len(words):
                return best
            states = {c for s in states for t in (self.step[s].get(words[i], set()) | self.any_[s]) for c in self.closure[t]}
            if not states:
                return best
            n += 1


class Template:
    """The longest run of mandatory words is the anchor; automata cover what precedes it (reversed) and what follows."""

    def __init__(self, label: str, markup: str):
        self.label, items, runs, run = label, _parse(markup), [], []
        for i, x in enumerate([*items, None]):
            if isinstance(x, bytes):
                run.append((i, x))
            elif run:
                runs.append(run)
                run = []
        if not runs:
            raise ValueError(f"{label}: a template needs mandatory words")
        if _open_edge(items) or _open_edge(_reversed(items)):
            raise ValueError(f"{label}: a replaceable region must stand between words")
        best = max(runs, key=len)
        self.anchor, self.n = b" " + b" ".join(x for _, x in best) + b" ", len(best)
        self.before, self.after = Automaton(_reversed(items[: best[0][0]])), Automaton(items[best[-1][0] + 1 :])

    def spans(self, norm: bytes, words: list[bytes]) -> list[tuple[int, int]]:
        """All places as (first word, end)."""
        out = []
        for k in places(norm, self.anchor):
            if (after := self.after.longest(words, k + self.n)) is not None and (before := self.before.longest(words, k - 1, -1)) is not None:
                out.append((k - before, k + self.n + after))
        return out


def _open_edge(items: list) -> bool:
    """Whether what the items accept may begin with a replaceable region."""
    for x in items:
        if isinstance(x, bytes):
            return False
        if x[0] == "var" or _open_edge(x[1]):
            return True
    return False


def _reversed(items: list) -> list:
    return [("opt", _reversed(x[1])) if isinstance(x, tuple) and x[0] == "opt" else x for x in reversed(items)]


def scanner(phrases: dict[str, str] = BASE_PHRASES, templates: dict[str, str] = TEMPLATES):
    """A function from a text to a dict of results."""
    base = [(b" " + b" ".join(words_of(p)) + b" ", label, len(words_of(p))) for p, label in phrases.items()]
    compiled = [Template(k, v) for k, v in templates.items()]

    def scan(text: str | None) -> dict:
        words = words_of(text)
        norm = b" " + b" ".join(words) + b" "
        starts, found, labels, spans = [], set(), set(), []
        for phrase, label, n in base:
            for k in places(norm, phrase):
                starts.append(k)
                spans.append((k, k + n))
                found.add(label)
        for t in compiled:
            if matched := t.spans(norm, words):
                labels.add(t.label)
                spans += matched
        covered, end = 0, 0
        for a, b in sorted(spans):
            covered += max(0, b - max(a, end))
            end = max(end, b)
        return {"n_words": len(words), "starts": starts, "base": sorted(found), "labels": sorted(found | labels), "spans": sorted(spans), "score": covered / len(words) if words else 0.0}

    return scan
