"""Licence scan: sentences are mapped to known licence sentences, their sequences to licence rules.

Sentences are normalised to lower-case words without punctuation, comment marks and white space runs;
a sentence may be wrapped over lines. Known sentences may have slots such as `{holder}`, each of which stands for
as many words as SLOTS allows. Known sentences have identifiers; a rule is an ordered list of
identifiers that must follow each other in a text, with at most `max_gap` unknown sentences between
two of them. The longest rule that fits at a place wins, and its sentences are not used again.

Sentences and rules are parameters; the built-in ones are listed below. Texts are read whole.

Defined results: a null text counts as empty; a text without known sentences has no licences;
repeated rows are each given; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-name": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-name": "Licensed under the Apache License, Version 2.0.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved.",
    "mit-liability": "IN NO EVENT SHALL {holder} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-names-of": "Neither the name of {holder} nor the names of {contributors} may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name-of": "The name of {holder} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY {holder} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL {holder} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND {holder} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-liability": "IN NO EVENT SHALL {holder} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "epl2-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "epl1-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "bsl-name": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will {holder} be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "gpl-hope-of": "This {project} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
}

#: The least and the most words that a slot stands for.
SLOTS = {"holder": (1, 16), "contributors": (1, 16), "project": (1, 4), "file": (1, 8), "the": (0, 4), "port": (0, 1)}

#: Licences and the sentence sequences that state them.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-licensed"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-licensed", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-name"]),
    ("GPL-3.0", ["gpl3-name"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("MPL-2.0", ["mpl2"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("EPL-2.0", ["epl2-made"]),
    ("EPL-1.0", ["epl1-made"]),
    ("BSL-1.0", ["bsl-name"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("proprietary", ["all-rights"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    *[
        (licence, ["bsd-grant", "bsd-source", "bsd-binary", *names, *end])
        for licence, names in (("BSD-3-Clause", ["bsd-names"]), ("BSD-3-Clause", ["bsd-names-of"]), ("BSD-3-Clause", ["bsd-name-of"]), ("BSD-2-Clause", []))
        for end in (["bsd-warranty", "bsd-liability"], ["bsd-warranty"], [])
        if end or names in (["bsd-names-of"], ["bsd-name-of"])
    ],
    *[("ISC", [grant, *end]) for grant in ("isc-grant", "isc-grant-and") for end in (["isc-warranty", "isc-liability"], ["isc-warranty"], [])],
]

_VERSIONS = {
    ("General", "GPL"): ("2", "3"),
    ("Lesser General", "LGPL"): ("2.1", "3"),
    ("Library General", "LGPL"): ("2",),
    ("Affero General", "AGPL"): ("3",),
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivs", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivs"}


def _add_families() -> None:
    """Notices that differ in licence, version and wording only: GNU notices, Creative Commons, SPDX tags and one-line notices."""
    known = {normalise(x) for x in SENTENCES.values()}

    def add(licence: str, sentence: str, more: tuple[str, ...] = ()) -> None:
        if normalise(sentence) in known:
            return
        known.add(normalise(sentence))
        name = f"{licence} notice {len(known)}"
        SENTENCES[name] = sentence
        RULES.append((licence, [name]))
        RULES.extend((licence, [name, x]) for x in more)

    named = {
        "MIT": ["MIT License"],
        "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
        "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
        "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
        "ISC": ["ISC License"],
        "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
        "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
        "Unlicense": ["Unlicense"],
        "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License, version 1.0", "Eclipse Public License v1.0"],
        "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0"],
        "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
        "Zlib": ["zlib License"],
    }
    tags = [*named]
    hope = ("gpl-hope", "gpl-hope-of")
    for (family, short), versions in _VERSIONS.items():
        for version in versions:
            number = version if "." in version else f"{version}.0"
            licence, gnu = f"{short}-{number}", f"GNU {family} Public License"
            free = "This {project} is free software; you can redistribute it and/or modify it under the terms of the"
            fsf = "as published by the Free Software Foundation"
            add(f"{licence}-or-later", f"{free} {gnu} {fsf}; either version {version} of the License, or (at your option) any later version.", hope)
            add(f"{licence}-only", f"{free} {gnu} {fsf}; version {version} of the License.", hope)
            add(f"{licence}-only", f"{free} {gnu} {fsf}; version {version}.", hope)
            add(f"{licence}-only", f"{free} {gnu} version {version} as published by the Free Software Foundation.", hope)
            add(f"{licence}-only", f"{free} {gnu}, version {version}, only, as published by the Free Software Foundation.", hope)
            tags += [licence, f"{licence}-only", f"{licence}-or-later"]
            named[licence] = [f"{gnu}, version {version}", f"{gnu} v{number}", f"{short}v{version}"]
            named[f"{licence}-or-later"] = [f"{x} or later" for x in named[licence]]
            named[f"{licence}-only"] = [f"{x} only" for x in named[licence]]
    for kind, long in _CC.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            licence = f"CC-{kind}-{version}"
            tags.append(licence)
            full = {long, long.replace("NoDerivs", "NoDerivatives")}
            named[licence] = [f"CC {kind} {version}", *[f"Creative Commons {x} {version} {{port}} License" for x in sorted(full)]]
    for tag in tags:
        add(tag, f"SPDX-License-Identifier: {tag}")
    add("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0+")
    add("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0+")
    add("CC0-1.0", "To the extent possible under law, {holder} has waived all copyright and related or neighboring rights to this work.")
    for licence, names in named.items():
        for name in names:
            for opening in ("Licensed", "Released", "This {project} is licensed"):
                for ending in ("", ", see {file} for details"):
                    add(licence, f"{opening} under {{the}} {name}{ending}.")


MAX_GAP = 2
_PIECE = re.compile(r"[^\n.!?;:]*(?:[.!?;:](?!\s|$)[^\n.!?;:]*)*[.!?;:]*[ \t]*\n?")
_STOP = re.compile(r"[.!?;:][ \t]*\n?$")
_WORD = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*")


def normalise(sentence: str) -> str:
    """Lower-case words, single blanks between them; https counts as http."""
    return " ".join(_WORD.findall(sentence.lower().replace("https://", "http://")))


_add_families()


class Slotted:
    """Known sentences with slots that begin with the same words."""

    def __init__(self, head: str):
        self.head, self.most, self.tails = head, 0, {}

    def add(self, parts: list[str], name: str) -> None:
        pattern, most = "", 0
        for i, part in enumerate(parts):
            own = part.split() if i % 2 == 0 else []
            pattern += "".join(f" {re.escape(w)}" for w in own) if i % 2 == 0 else rf"(?: \S+){{{SLOTS[part][0]},{SLOTS[part][1]}}}?"
            most += len(own) if i % 2 == 0 else SLOTS[part][1]
        self.most = max(self.most, most)
        self.tails.setdefault(parts[-1].split()[-1], []).append((parts[-1], re.compile(pattern), name))

    def may_begin(self, text: str) -> bool:
        return self.head.startswith(text) or (text.startswith(self.head + " ") and text.count(" ") < self.most)

    def find(self, text: str) -> str | None:
        """The name of the sentence that the text is, if any; the one with most words of its own wins."""
        if text.startswith(self.head + " "):
            for tail, pattern, name in self.tails.get(text.rsplit(" ", 1)[1], ()):
                if text.endswith(tail) and pattern.fullmatch(f" {text}"):
                    return name
        return None


class Recogniser:
    """Known sentences and rules, prepared for scanning."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, list[str]]], max_gap: int = MAX_GAP):
        self.known: dict[str, str] = {}
        slotted: list[tuple[list[str], str]] = []
        for name, sentence in sentences.items():
            parts = re.split(r"\{(\w+)\}", sentence)
            parts[::2] = [" ".join(x for x in map(normalise, pieces_of(part)) if x) for part in parts[::2]]
            if len(parts) > 1:
                slotted.append((parts, name))
            else:
                self.known[parts[0]] = name
        heads: dict[str, Slotted] = {}
        for parts, name in sorted(slotted, key=lambda x: -sum(len(part.split()) for part in x[0][::2])):
            heads.setdefault(parts[0], Slotted(parts[0])).add(parts, name)
        self.slotted = list(heads.values())
        self.sorted = sorted(self.known)
        self.openers = {text.split(" ", 1)[0] for text in [*self.known, *heads]}
        self.hints = _hints([*self.known, *[" ".join(parts[::2]) for parts, _ in slotted]])
        self.rules: dict[str, list[tuple[str, list[str]]]] = {}
        for rule in sorted(rules, key=lambda rule: -len(rule[1])):
            self.rules.setdefault(rule[1][0], []).append(rule)
        self.max_gap = max_gap

    def _may_begin(self, text: str) -> bool:
        at = bisect.bisect_left(self.sorted, text)
        return (at < len(self.sorted) and self.sorted[at].startswith(text)) or any(x.may_begin(text) for x in self.slotted)

    def _name(self, text: str) -> str | None:
        return self.known.get(text) or next(filter(None, (x.find(text) for x in self.slotted)), None)

    def sentences(self, text: str) -> list[tuple[int, str | None, int, int]]:
        """Sentences as (number, identifier or None, start, end): known ones over as many pieces as they take, others by piece."""
        low = text.lower()
        if not any(hint in low for hint in self.hints):
            return []
        pieces = [(words, *m.span()) for m in _PIECE.finditer(text) if m.end() > m.start() and (words := normalise(m[0]))]
        out, i = [], 0
        while i < len(pieces):
            name, end, joined, j = None, i + 1, "", i
            while j < len(pieces):
                joined = f"{joined} {pieces[j][0]}" if joined else pieces[j][0]
                own = self._name(joined)
                if own and (name is None or joined in self.known):
                    name, end = own, j + 1
                if not (joined.split(" ", 1)[0] in self.openers and self._may_begin(joined)):
                    break
                j += 1
            out.append((len(out), name, pieces[i][1], pieces[end - 1][2]))
            i = end
        return out

    def licences(self, text: str) -> list[tuple[str, list[str], int, int]]:
        """(licence, identifiers, start, end) in text order."""
        return self.match(self.sentences(text))

    def match(self, sentences: list[tuple[int, str | None, int, int]]) -> list[tuple[str, list[str], int, int]]:
        """The licences that the sentences of a text state."""
        found = [x for x in sentences if x[1]]
        out, i = [], 0
        while i < len(found):
            for licence, names in self.rules.get(found[i][1], ()):
                run = found[i : i + len(names)]
                if [x[1] for x in run] == names and all(b[0] - a[0] - 1 <= self.max_gap for a, b in zip(run, run[1:], strict=False)):
                    out.append((licence, names, run[0][2], run[-1][3]))
                    i += len(names)
                    break
            else:
                i += 1
        return out


def pieces_of(text: str) -> list[str]:
    return [m[0] for m in _PIECE.finditer(text) if m[0]]


def _hints(known: list[str]) -> list[str]:
    """A few words, one of which is in every known sentence: the words that cover most, until all are covered."""
    left, out = [set(text.split()) for text in known], []
    while left:
        words = sorted({w for x in left for w in x if len(w) > 4} or {w for x in left for w in x})
        best = max(words, key=lambda w: (sum(w in x for x in left), len(w)))
        out.append(best)
        left = [x for x in left if best not in x]
    return out


_FOUND = pa.list_(pa.struct([("licence", pa.string()), ("sentences", pa.list_(pa.string())), ("start", pa.int64()), ("end", pa.int64())]))


def find_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per document: id, found (array of licence, sentences, start, end in code points), n_sentences (known ones)."""
    recogniser = Recogniser(sentences, rules, max_gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, known = [], []
            for text in batch.column(1):
                own = recogniser.sentences(text.as_py() or "")
                found.append([dict(zip(("licence", "sentences", "start", "end"), x, strict=True)) for x in recogniser.match(own)])
                known.append(sum(1 for x in own if x[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND), pa.array(known, pa.int64())], names=["id", "found", "n_sentences"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, found array<struct<licence:string,sentences:array<string>,start:long,end:long>>, n_sentences long").withColumnRenamed("id", id_col)
