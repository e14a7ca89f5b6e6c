import itertools
import random
import re
import time

import pytest

from trackweave.llm import licences as L

from .helpers import documents

MIT = "\n".join(L.SENTENCES[x] for x in ("mit-grant", "mit-notice", "mit-warranty"))


def wrapped(text, mark="# ", width=40):
    out, line = [], mark
    for word in text.split():
        if len(line) + len(word) > width:
            out.append(line)
            line = mark
        line += word + " "
    return "\n".join([*out, line])


CASES = [
    (None, []),
    ("", []),
    ("Nothing here. The license is unknown.", []),
    ("Intro. Released under the MIT License. More.", ["MIT"]),
    ("x | y\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", ["CC-BY-NC-4.0", "proprietary"]),
    (wrapped(MIT), ["MIT"]),
    (MIT.upper(), ["MIT"]),
    (L.SENTENCES["mit-grant"] + " One. Two. " + L.SENTENCES["mit-notice"], ["MIT"]),
    (L.SENTENCES["mit-notice"] + " " + L.SENTENCES["mit-grant"], []),
    (" ".join(L.SENTENCES[x] for x in ("bsd-grant", "bsd-source", "bsd-binary")), ["BSD-2-Clause"]),
    (" ".join(L.SENTENCES[x] for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")), ["BSD-3-Clause"]),
    ("Licensed under the Apache License, Version 2.0. " * 2, ["Apache-2.0", "Apache-2.0"]),
    ("word " * 100_000 + ". All rights reserved.", ["proprietary"]),
]


def test_cases(spark):
    got = {r.doc_id: r for r in L.find_licences(documents(spark, [t for t, _ in CASES])).collect()}
    assert [[x.licence for x in got[i].found] for i in range(len(CASES))] == [w for _, w in CASES]
    for i, (text, _) in enumerate(CASES):
        for x in got[i].found:
            first = L.normalise(L.SENTENCES[x.sentences[0]])
            assert L.normalise(text[x.start : x.end]).startswith(first[:20])
    assert L.find_licences(documents(spark, ["a"]).limit(0)).count() == 0


def test_every_sentence_is_known():
    own = L.Recogniser(L.SENTENCES, L.RULES)
    for name, sentence in L.SENTENCES.items():
        assert [x[1] for x in own.sentences(f"Before.\n{sentence}\nAfter.") if x[1]] == [name]
        assert any(hint in sentence.lower() for hint in own.hints)


def test_planted_lines(spark):
    """On the given documents the rules find what a plain search for the notices finds."""
    from .conftest_data import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    notices = ["mit-name", "apache-name", "gpl3-name", "cc-by-nc", "all-rights"]
    found = sum(len(r.found) for r in L.find_licences(docs).collect())
    assert found == sum((r.text or "").count(L.SENTENCES[n]) for r in docs.collect() for n in notices) > 0


BSD = """Copyright (c) 1994, The Regents

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of Foo Systems, Inc. nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
OF SUCH DAMAGE."""
MIT_END = """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND JANE DOE DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL JANE DOE BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
GPL_ONLY = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
version 2 as published by the Free Software Foundation."""


def test_named_holders_and_families():
    own = L.Recogniser(L.SENTENCES, L.RULES)
    whole = [
        (BSD[BSD.index("Redist") :], "BSD-3-Clause"),
        (BSD[BSD.index("Redist") :].replace("Foo Systems, Inc.", "the University"), "BSD-3-Clause"),
        (BSD[BSD.index("Redist") : BSD.index("3. N")] + BSD[BSD.index("THIS") :], "BSD-2-Clause"),
        (f"{MIT}\n{MIT_END}", "MIT"),
        (ISC, "ISC"),
        (LGPL, "LGPL-2.1-or-later"),
        (LGPL.replace("Lesser", "Affero").replace("2.1", "3").replace("library", "program"), "AGPL-3.0-or-later"),
        (GPL_ONLY, "GPL-2.0-only"),
        ("This project is licensed under the MIT License.", "MIT"),
        ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", "MIT"),
        ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 2.5 Generic License.", "CC-BY-NC-2.5"),
        ("SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0-only"),
    ]
    for text, licence in whole:
        for shown in (text, wrapped(text)):
            assert [(x[0], x[3]) for x in own.licences(shown)] == [(licence, len(shown))], text
    for text in ("Neither the name of a rose nor the names of flowers matter.", "This project is licensed under terms unknown.", "SPDX-License-Identifier: Foo"):
        assert own.licences(text) == []


def test_more_families():
    own = L.Recogniser(L.SENTENCES, L.RULES)
    zlib = " ".join(L.SENTENCES[x] for x in ("zlib-warranty", "zlib-liability", "zlib-grant")).replace("{holder}", "the authors")
    for text, licence in [(zlib, "Zlib"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), (L.SENTENCES["epl2-made"], "EPL-2.0"), ("SPDX-License-Identifier: EPL-1.0", "EPL-1.0")]:
        assert [x[0] for x in own.licences(text)] == [licence], text


@pytest.mark.parametrize("filler", ["\n", ". ", "\n \n", "x.\n", "license ", "Permission\n\n"])
def test_time_is_linear(filler):
    """Long texts of pieces without words, or of words that begin sentences, take time in proportion."""
    own = L.Recogniser(L.SENTENCES, L.RULES)
    begun = time.perf_counter()
    assert own.licences("The license" + filler * 100_000 + "\nAll rights reserved.")[-1][0] == "proprietary"
    assert time.perf_counter() - begun < 20


def test_against_brute_force():
    """Sentences and rules as a plain search over all runs of pieces finds them."""
    known = {"a": "The cat sat; the dog ran.", "b": "No rights, none.", "c": "By {holder} for all.", "d": "The cat sat."}
    rules = [("L1", ["a", "b"]), ("L2", ["a"]), ("L3", ["c", "b", "c"]), ("L4", ["b"])]
    own, r = L.Recogniser(known, rules, max_gap=1), random.Random(4)
    bits = ["The cat sat; the dog ran.", "The cat\nsat; the\ndog ran.", "No rights, none.", "By Ann\nLee for all.", "By for all.", "the cat sat.", "Else.", "\n\n", "... ", "By Bob for", "all."]
    patterns = {name: re.compile(re.sub(r"\{holder\}", r"\\S+(?: \\S+){0,15}", re.sub(r"[^a-z{} ]", "", text.lower()))) for name, text in known.items()}
    for _ in range(300):
        text = r.choice([" ", "\n"]).join(r.choice(bits) for _ in range(r.randint(1, 9)))
        pieces = [p for x in L.pieces_of(text) if (p := L.normalise(x))]
        names, i = [], 0
        while i < len(pieces):
            fits = [(j, name) for j in range(i + 1, len(pieces) + 1) for name, pattern in patterns.items() if pattern.fullmatch(" ".join(pieces[i:j]))]
            exact = [x for x in fits if x[1] != "c"]
            j, name = exact[-1] if exact else fits[0] if fits else (i + 1, None)
            names.append(name)
            i = j
        assert [x[1] for x in own.sentences(text)] == (names if any(names) else [x[1] for x in own.sentences(text)]), text
        places, found = [i for i, name in enumerate(names) if name], []
        while places:
            rule = next((rule for rule in sorted(rules, key=lambda x: -len(x[1])) if [names[p] for p in places[: len(rule[1])]] == rule[1] and all(b - a <= 2 for a, b in itertools.pairwise(places[: len(rule[1])]))), None)
            found += [rule[0]] if rule else []
            places = places[len(rule[1]) if rule else 1 :]
        assert [x[0] for x in own.licences(text)] == found, text


def test_repeated_rows(spark):
    rows = [(1, "Licensed under the MIT License."), (1, "Licensed under the MIT License."), (None, None)]
    got = L.find_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(len(r.found) for r in got) == [0, 1, 1]
