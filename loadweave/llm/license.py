"""License scans: phrases, and templates compiled to token automata.

A template is a license's wording with mark-up: `[[ ... ]]` is a region that may be absent,
`<<n>>` one that stands for any words, at most n of them, `<<n#>>` for at most n version numbers,
`#` is one version number, `one|two` is either word, and `!` at the end bars the words of a restriction
(`BARRED`) from following. Templates are compiled to automata over words. A stretch of text matches a
template when its words follow the automaton from start to end, so the mandatory words must be
there exactly, in their order.

`TEMPLATES` are notices, which name a license; `WHOLE` are the terms of a license from their first
word to their last, conditions and warranty parts included, with names and list marks replaceable.
The terms of the long licenses lie in `wording/` as they were published.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loadweave.llm.common import values

#: Fixed phrases: where these words stand consecutively, and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The restrictions of Creative Commons licenses, as codes and in all spellings
RESTRICTIONS = {
    "nc": ["noncommercial", "non commercial"],
    "nd": ["noderivatives", "noderivs", "no derivatives", "no derivs"],
    "sa": ["sharealike", "share alike"],
}
#: Words, or pairs of words without the space, that may not follow where a template bars them
BARRED = {w.replace(" ", "").encode() for code, names in RESTRICTIONS.items() for w in (code, *names)}
_PORT = "[[ international|unported|generic ]]"


def _creative_commons(*codes: str) -> list[str]:
    """The notices of the license with these restrictions and no others."""
    short = " ".join(["cc by", *codes])
    out = [f"licensed under [[ a|the ]] {short} [[ version ]] <<3#>> {_PORT} [[ license ]] !"]
    for names in product(*(RESTRICTIONS[c] for c in codes)):
        start = f"licensed under [[ a|the ]] creative commons {' '.join(['attribution', *names])}"
        out.append(f"{start} [[ version ]] <<3#>> {_PORT} [[ {short} <<3#>> ]] [[ public ]] license !")
        out.append(f"{start} [[ version ]] # <<2#>> {_PORT} [[ {short} <<3#>> ]] !")
    return out


#: Notices of public licenses, with mark-up
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license"],
    "apache-2.0": ["licensed under the apache license version 2 0", "licensed under the apache license 2 0"],
    "gpl": [
        "[[ this work is ]] licensed under the gnu general public license [[ version <<2#>> ]]",
        "under the terms of the gnu general public license as published by the free software foundation either version <<2#>> of the license or at your option any later version",
    ],
    "cc-by": _creative_commons(),
    "cc-by-nc": _creative_commons("nc"),
    "cc-by-sa": _creative_commons("sa"),
    "cc-by-nd": _creative_commons("nd"),
    "cc-by-nc-sa": _creative_commons("nc", "sa"),
    "cc-by-nc-nd": _creative_commons("nc", "nd"),
    "copyright-notice": ["copyright [[ c ]] <<8>> all rights reserved"],
}

_MARK = "[[ 1|2|3|4|a|b|c|d|i|ii|iii|iv ]]"
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[ the software ]] "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    f"{_MARK} the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and {spelt} in no event shall <<20>> be liable for any claim damages or other liability whether in an action of contract "
    "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    f"{_MARK} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    f"{_MARK} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution {more} "
    "this software is provided by <<20>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<20>> be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence "
    "or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ADVERTISING = f"{_MARK} all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<20>>"
_NO_NAMES = (
    f"{_MARK} neither the name|names [[ of ]] <<20>> nor the names of <<8>> contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission"
)
_ISC = (
    "permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
    "notice and this permission notice appear in all copies the software is provided as is and <<20>> disclaims|disclaim all warranties with regard to this software "
    "including all implied warranties of merchantability and fitness in no event shall <<20>> be liable for any special direct indirect or consequential damages "
    "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
    "arising out of or in connection with the use or performance of this software"
)

_SEPARATORS = bytes(b for b in range(0x80) if not (chr(b).isdigit() or chr(b).isalpha()))
#: Lower case for A-Z and a space for all that is not part of a word
_FOLD = bytes(ord(" ") if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Dashes, quotes, bullets and signs beyond ASCII (of U+2010-U+2027 and Latin-1), which templates do not spell
_TYPOGRAPHY = re.compile(rb"\xe2\x80[\x90-\xa7]|\xc2[\xa9\xab\xae\xb7\xbb]")
_MARKUP = re.compile(rb"\[\[|\]\]|<<\d+#?>>|\S+")
#: A word in an automaton: one of a set, any word, or a version number
_ANY, _NUMBER = "any", "number"


def _terms(name: str) -> str:
    """The words of the published terms."""
    return resources.files("loadweave.llm").joinpath("wording", f"{name}.txt").read_bytes().translate(_FOLD).decode()


#: The terms of public licenses, from the first word to the last
WHOLE = {
    "mit": [_MIT.replace("{spelt}", x) for x in ("noninfringement", "non infringement")],
    "bsd": [_BSD.replace("{more}", x) for x in ("", _NO_NAMES, f"{_ADVERTISING} {_NO_NAMES}")],
    "isc": [_ISC],
    "apache-2.0": [_terms("apache-2.0")],
    "gpl": [_terms("gpl-2"), _terms("gpl-3")],
}


class Automaton:
    """One template: states with the words that lead on, skips, and free regions."""

    def __init__(self, template: str):
        #: state -> (the words that lead on, next state)
        self.step: list[list[tuple[frozenset[bytes] | str, int]]] = [[]]
        self.skip: list[list[int]] = [[]]
        self.barred = False
        opened: list[int] = []
        for token in _MARKUP.findall(template.encode()):
            here = len(self.step) - 1
            if token == b"[[":
                opened.append(here)
            elif token == b"]]":
                self.skip[opened.pop()].append(here)
            elif token.startswith(b"<<"):
                first, count = here, int(token[2:-2].rstrip(b"#"))
                for _ in range(count):
                    self._grow(_NUMBER if token.endswith(b"#>>") else _ANY)
                for state in range(first, first + count):
                    self.skip[state].append(first + count)
            elif token == b"!":
                self.barred = True
            else:
                self._grow(_NUMBER if token == b"#" else frozenset(token.split(b"|")))
        self.last = len(self.step) - 1
        self.first = {word for state in self._closed({0}) for taken, _ in self.step[state] if taken not in (_ANY, _NUMBER) for word in taken}
        #: words that every match holds; the rarest kind of word makes the best early test
        self.mandatory = self._mandatory(template)

    def _grow(self, taken: frozenset[bytes] | str) -> None:
        self.step[-1].append((taken, len(self.step)))
        self.step.append([])
        self.skip.append([])

    @staticmethod
    def _mandatory(template: str) -> bytes:
        """The longest stretch of mandatory words, between spaces."""
        plain = re.sub(r"\[\[.*?\]\]|<<\d+#?>>|\S+\|\S+|[#!]", "|", template)
        return b" " + " ".join(max((p.split() for p in plain.split("|")), key=len)).encode() + b" "

    @staticmethod
    def _takes(taken: frozenset[bytes] | str, word: bytes) -> bool:
        return taken == _ANY or (word.removeprefix(b"v").isdigit() if taken == _NUMBER else word in taken)

    def _may_end(self, words: list[bytes], end: int) -> bool:
        return not (self.barred and any(b"".join(words[end : end + n]) in BARRED for n in (1, 2)))

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.skip[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def end_of_match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest match that starts at this word, if there is one."""
        states, end = self._closed({0}), None
        for at in range(start, len(words)):
            states = self._closed({to for s in states for taken, to in self.step[s] if self._takes(taken, words[at])})
            if not states:
                break
            if self.last in states and self._may_end(words, at + 1):
                end = at + 1
        return end


class Scanner:
    """All phrases and templates; scans one text at a time."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], whole: dict[str, list[str]] = WHOLE):
        self.phrases = [(label, b" " + p.encode() + b" ", re.compile(b" " + p.encode() + b"(?= )")) for p, label in phrases.items()]
        self.automata = [(label, Automaton(t), full) for kind, full in ((templates, False), (whole, True)) for label, ts in kind.items() for t in ts]

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, bool]]]:
        """The number of words, the places of phrases (label, word), and the matches of templates (label, word, end, whole)."""
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        line = b" " + b" ".join(words) + b" "
        places = []
        starts: np.ndarray | None = None
        for label, needle, pattern in self.phrases:
            if needle in line:
                if starts is None:
                    starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                at = [m.start() for m in pattern.finditer(line)]
                places += zip([label] * len(at), np.searchsorted(starts, at).tolist())
        n_words, number = len(words), range(len(words))
        if not line.isascii() and _TYPOGRAPHY.search(line):
            words = [_TYPOGRAPHY.sub(b"", w) for w in words]
            number = [i for i, w in enumerate(words) if w]
            words = [w for w in words if w]
            line = b" " + b" ".join(words) + b" "
        spans = []
        for label, automaton, full in self.automata:
            if automaton.mandatory in line:
                done = 0
                for at, word in enumerate(words):
                    if at >= done and word in automaton.first and (end := automaton.end_of_match(words, at)):
                        spans.append((label, number[at], number[end - 1] + 1, full))
                        done = end
        return n_words, places, sorted(set(spans), key=lambda s: (s[1], s[2], s[0]))


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner(PHRASES, TEMPLATES)


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_words, places, matches).

    `places` lists (label, word) of every phrase, `matches` (label, word, end, whole) of every template, words from 0 and
    ends exclusive; `whole` tells terms from notices; matches of one template do not overlap. Words are runs of letters a-z, digits and all beyond
    ASCII, after lower-casing A-Z.

    Defined cases: terms of which a mandatory word is missing or changed do not match; in templates, dashes, quotes and
    bullets beyond ASCII do not count; null and empty texts have no words; ties start at the same word and come in the order of their
    ends, then labels; rows that repeat come out as often; a null doc_id stays null; other columns are ignored.
    """
    places = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    matches = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("end", pa.int64()), ("whole", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for batch in batches:
            found = [scanner.scan(t or "") for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"label": a, "word": w} for a, w in f[1]] for f in found], places),
                    pa.array([[{"label": a, "word": w, "end": e, "whole": x} for a, w, e, x in f[2]] for f in found], matches),
                ],
                ["doc_id", "n_words", "places", "matches"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, places array<struct<label:string,word:long>>, matches array<struct<label:string,word:long,end:long,whole:boolean>>"
    )
