"""License scans against plain searches."""

from __future__ import annotations

import random
import re
import time

import pytest

from loadweave.llm import license, queries
from loadweave.llm.license import Automaton, Scanner
from tests.conftest import SF
from tests.llm.frames import by_id, frame, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(folded)
    found = [(label, i) for phrase, label in license.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


TEXTS = ["CC BY", "cc-by cc by cc", "acc by cc bye", "All rights  reserved. ALL RIGHTS RESERVED", "GNU General-Public/License", "all\nrights\treserved", "Éall rights reserved", "cc by cc by"]


def test_places_of_phrases(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, (_, t) in enumerate(odd_rows())]
    out = by_id(license.licenses(frame(spark, rows)), "n_words", "places")
    for doc_id, text in rows:
        n, found = out[doc_id][0]
        assert (n, sorted((p["label"], p["word"]) for p in found)) == places(text)


@pytest.mark.parametrize(
    "text,label,matches",
    [
        ("Released under the MIT License.", "mit", True),
        ("Released under this MIT License.", "mit", False),
        ("Licensed under the GNU General Public License", "gpl", True),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl", True),
        ("Licensed under the GNU Lesser General Public License", "gpl", False),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", True),
        ("licensed under the apache license, version 2.0", "apache-2.0", True),
        ("licensed under the apache license, version 3.0", "apache-2.0", False),
        ("Copyright (c) 2024 by A. N. Author. All rights reserved.", "copyright-notice", True),
        ("Copyright is a word and then far too many words follow before all rights reserved", "copyright-notice", False),
    ],
)
def test_templates(text, label, matches):
    _, _, spans = Scanner(license.PHRASES, license.TEMPLATES).scan(text)
    assert (label in {s[0] for s in spans}) is matches


def test_automaton_takes_optional_and_free_regions():
    a = Automaton("alpha [[ beta gamma ]] delta <<2>> omega")
    for text, end in [("alpha delta omega", 3), ("alpha beta gamma delta x omega", 6), ("alpha delta x y omega", 5), ("alpha beta delta omega", None), ("alpha delta x y z omega", None)]:
        assert a.end_of_match(text.encode().split(), 0) == end
    assert a.mandatory == b" alpha "


def test_spans_are_words(spark):
    out = by_id(license.licenses(frame(spark, [(1, "Well. Released under the MIT license, and so on. Released under the MIT license")])), "matches")
    assert [(m["label"], m["word"], m["end"]) for m in out[1][0][0]] == [("mit", 1, 6), ("mit", 9, 14)]


def test_no_rows(spark):
    assert license.licenses(frame(spark, [])).count() == 0


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_license_scan(spark, SF).collect()
    assert len(rows) == len(texts) and any(r["n_base"] for r in rows) and any(r["labels"] != r["base_labels"] for r in rows)
    for r in rows:
        n, found = places(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n, len(found)) and 0 <= r["score"] <= 1
        assert r["base_labels"] == ",".join(sorted({label for label, _ in found}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert (r["first_word"], r["last_word"]) == ((min(i for _, i in found), max(i for _, i in found)) if found else (None, None))


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def spans(text):
    return Scanner(license.PHRASES, license.TEMPLATES).scan(text)[2]


def test_whole_terms():
    n = len(MIT.replace("/", " ").split())
    assert spans("The MIT License\n" + MIT) == [("mit", 3, 3 + n, True)]
    assert spans(MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "Example Inc.").replace('"', "”"))[0][3]
    # marks that stand alone count as words where words are numbered
    assert spans("— " + MIT) == [("mit", 1, 1 + n, True)]


@pytest.mark.parametrize("change", [("shall be included in all copies", "may be left out of all copies"), ("WITHOUT WARRANTY", "WITH WARRANTY"), ("IN NO EVENT SHALL", "ON ANY EVENT SHALL")])
def test_changed_terms_do_not_match(change):
    assert change[0] in MIT and spans(MIT.replace(*change)) == []


@pytest.mark.parametrize("name,label", [("apache-2.0", "apache-2.0"), ("gpl-2", "gpl"), ("gpl-3", "gpl")])
def test_published_terms(name, label):
    words = license._terms(name).split()
    assert (label, 0, len(words), True) in spans(" ".join(words))
    assert not any(s[3] for s in spans(" ".join(words[:-5])))


@pytest.mark.parametrize(
    "text,labels",
    [
        ("licensed under a Creative Commons Attribution-NonCommercial 4.0 License", {"cc-by-nc"}),
        ("licensed under a Creative Commons Attribution 4.0 International License", {"cc-by"}),
        ("licensed under a Creative Commons Attribution 4.0 International (CC BY 4.0) License", {"cc-by"}),
        ("licensed under a Creative Commons Attribution-Share Alike 3.0 Unported License", {"cc-by-sa"}),
        ("licensed under CC BY-NC-ND 4.0", {"cc-by-nc-nd"}),
        ("licensed under CC BY ND", {"cc-by-nd"}),
        ("licensed under CC BY. No rights are lost", {"cc-by"}),
        ("licensed under a creative commons attribution but not free license", set()),
    ],
)
def test_creative_commons(text, labels):
    assert {s[0] for s in spans(text)} == labels


def test_notices_score_below_terms(spark, tmp_path):
    rows = [(1, MIT), (2, "Released under the MIT license"), (3, "all rights reserved"), (4, "none"), (5, MIT.split(", including")[0])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert by_id(queries.op4_license_scan(spark, str(tmp_path)), "score") == {1: [(1.0,)], 2: [(0.75,)], 3: [(0.5,)], 4: [(0.0,)], 5: [(0.0,)]}


def test_many_phrases_in_one_text_take_seconds():
    n = 500_000
    scanner = license._scanner()
    start = time.perf_counter()
    n_words, places, _ = scanner.scan("cc by all rights reserved " * n)
    assert time.perf_counter() - start < 60
    assert n_words == 5 * n and len(places) == 2 * n
    assert sorted(places, key=lambda p: p[1])[-2:] == [("cc-by", 5 * n - 5), ("reserved", 5 * n - 3)]


def as_regex(template):
    """A template as a regular expression over words that are each followed by a space."""
    barred = "|".join(sorted(w.decode() for w in license.BARRED))
    end = rf"(?!(?:{barred}) )(?!(?:{'|'.join(w.decode()[:k] + ' ' + w.decode()[k:] for w in license.BARRED for k in range(1, len(w)))}) )" if template.split()[-1] == "!" else ""
    out = []
    for token in template.split():
        if token == "[[":
            out.append("(?:")
        elif token == "]]":
            out.append(")?")
        elif token == "!":
            continue
        elif token.startswith("<<"):
            n, version = token[2:-2].rstrip("#"), token.endswith("#>>")
            out.append(rf"(?:{'[0-9]+' if version else '[^ ]+'} ){{0,{n}}}")
        elif token == "#":
            out.append("[0-9]+ ")
        else:
            out.append(f"(?:{token}) ")
    return re.compile("".join(out) + end)


@pytest.mark.parametrize("seed", range(40))
def test_automata_equal_regular_expressions(seed):
    rnd = random.Random(seed)
    alphabet = ["a", "b", "c", "1", "22"]

    def region(depth):
        out = []
        for _ in range(rnd.randint(1, 3)):
            kind = rnd.random()
            if kind < 0.15 and depth:
                out += ["[[", *region(depth - 1), "]]"]
            elif kind < 0.25:
                out.append(f"<<{rnd.randint(1, 3)}>>")
            elif kind < 0.35:
                out.append(f"<<{rnd.randint(1, 2)}#>>")
            elif kind < 0.45:
                out.append("#")
            elif kind < 0.6:
                out.append("a|b")
            else:
                out.append(rnd.choice("abc"))
        return out

    template = " ".join(["b", *region(2), "c"])
    automaton, pattern = license.Automaton(template), as_regex(template)
    for _ in range(60):
        words = [rnd.choice(alphabet) for _ in range(rnd.randint(1, 12))]
        line = " ".join(words) + " "
        for at in range(len(words)):
            ends = [k for k in range(at + 1, len(words) + 1) if pattern.fullmatch(" ".join(words[at:k]) + " ")]
            got = automaton.end_of_match([w.encode() for w in words], at)
            assert got == (max(ends) if ends else None), (template, line, at)
