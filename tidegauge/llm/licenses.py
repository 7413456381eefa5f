"""Licence recognition by sentences and rules.

A text is cut into pieces at marks and line ends; the pieces, and runs of adjacent
ones, are normalised and mapped to the identifiers of known licence sentences, of
which some have a variable part: a version, a holder's name. A tag line
(``SPDX-License-Identifier: A OR B``) is a sentence whose variable part is the
expression. The identifiers, in the order of the text, are then matched against
ordered rules: a rule names a licence by a run of identifiers and takes the ones
that it matches, so that a full licence text is not read as the short notice that it
begins with. Names carry the version that the text names.

``texts`` adds full licence texts: their sentences get identifiers of their own, and
a rule for the whole sequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import slices

#: Known sentences of public licences and notices, normalised as `normal` does; {n} stands for a version, {x} for any words.
SENTENCES = {
    "mit-name": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "the mit license", "mit license"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is-mit": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "liable-mit": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache-name": ["licensed under the apache license version {n}", "released under the apache license version {n}", "apache license version {n}"],
    "apache-the-license": ["licensed under the apache license version {n} the license"],
    "apache-may-not": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www.apache.org licenses license 2.0", "you may obtain a copy of the license at https www.apache.org licenses license 2.0"],
    "as-is-apache": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl-name": ["this work is licensed under the gnu general public license version {n}", "licensed under the gnu general public license version {n}", "gnu general public license version {n}", "licensed under the gpl v{n}", "licensed under the gplv{n}"],
    "gpl-later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {n} of the license or at your option any later version"],
    "gpl-only": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version {n} of the license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version {n} as published by the free software foundation",
    ],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-details": ["see the gnu general public license for more details"],
    "gpl-copy": ["you should have received a copy of the gnu general public license along with this program"],
    "agpl-name": ["licensed under the gnu affero general public license version {n}", "gnu affero general public license version {n}"],
    "agpl-later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {n} of the license or at your option any later version"],
    "agpl-details": ["see the gnu affero general public license for more details"],
    "agpl-copy": ["you should have received a copy of the gnu affero general public license along with this program"],
    "lgpl-name": ["licensed under the gnu lesser general public license version {n}", "gnu lesser general public license version {n}"],
    "lgpl-later": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {n} of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {n} of the license or at your option any later version",
    ],
    "lgpl-warranty": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl-details": ["see the gnu lesser general public license for more details"],
    "lgpl-copy": ["you should have received a copy of the gnu lesser general public license along with this library", "you should have received a copy of the gnu lesser general public license along with this program"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-advert": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-endorse": [
        "neither the name of {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of {x} nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd3-name": ["licensed under the bsd 3 clause license", "bsd 3 clause license"],
    "bsd2-name": ["licensed under the bsd 2 clause license", "bsd 2 clause license"],
    "mpl-form": ["this source code form is subject to the terms of the mozilla public license v {n}"],
    "mpl-obtain": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-warranty": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "boost-name": ["distributed under the boost software license version {n}", "boost software license version {n}"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "zlib-warranty": ["this software is provided as is without any express or implied warranty"],
    "zlib-liable": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "zlib-origin": ["the origin of this software must not be misrepresented you must not claim that you wrote the original software"],
    "zlib-altered": ["altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
    "zlib-notice": ["this notice may not be removed or altered from any source distribution"],
    "epl-name": ["this program and the accompanying materials are made available under the terms of the eclipse public license v{n}", "this program and the accompanying materials are made available under the terms of the eclipse public license {n}", "eclipse public license v {n}"],
    "artistic-name": ["licensed under the artistic license {n}", "the artistic license {n}"],
    "wtfpl-name": ["do what the fuck you want to public license"],
    "wtfpl-grant": ["you just do what the fuck you want to"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by-nc": ["licensed under cc by nc {n}", "this work is licensed under a creative commons attribution noncommercial {n} international license"],
    "cc-by-sa": ["licensed under cc by sa {n}", "this work is licensed under a creative commons attribution sharealike {n} international license"],
    "cc-by": ["licensed under cc by {n}", "this work is licensed under a creative commons attribution {n} international license"],
    "cc0": ["licensed under cc0 {n}"],
    "reserved": ["all rights reserved"],
}
#: Rules in the order in which they are tried; a licence and the run of sentence identifiers that names it. {} stands for the version of the first sentence that has one.
RULES = [
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is-mit", "liable-mit"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-mit", "liable-mit"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is-mit"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-mit"]),
    ("Apache-{}", ["apache-the-license", "apache-may-not", "apache-copy", "as-is-apache", "apache-see"]),
    ("GPL-{}-or-later", ["gpl-later", "gpl-warranty", "gpl-details", "gpl-copy"]),
    ("GPL-{}-or-later", ["gpl-later", "gpl-warranty", "gpl-details"]),
    ("GPL-{}-only", ["gpl-only", "gpl-warranty", "gpl-details", "gpl-copy"]),
    ("GPL-{}-only", ["gpl-only", "gpl-warranty", "gpl-details"]),
    ("AGPL-{}-or-later", ["agpl-later", "gpl-warranty", "agpl-details", "agpl-copy"]),
    ("AGPL-{}-or-later", ["agpl-later", "gpl-warranty", "agpl-details"]),
    ("LGPL-{}-or-later", ["lgpl-later", "lgpl-warranty", "lgpl-details", "lgpl-copy"]),
    ("LGPL-{}-or-later", ["lgpl-later", "gpl-warranty", "lgpl-details", "lgpl-copy"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-warranty", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("MPL-{}", ["mpl-form", "mpl-obtain"]),
    ("BSL-{}", ["boost-name", "boost-grant"]),
    ("WTFPL", ["wtfpl-name", "wtfpl-grant"]),
    ("Apache-{}", ["apache-the-license"]),
    ("Apache-{}", ["apache-name"]),
    ("MIT", ["mit-name"]),
    ("GPL-{}-or-later", ["gpl-later"]),
    ("GPL-{}-only", ["gpl-only"]),
    ("GPL-{}", ["gpl-name"]),
    ("AGPL-{}-or-later", ["agpl-later"]),
    ("AGPL-{}", ["agpl-name"]),
    ("LGPL-{}-or-later", ["lgpl-later"]),
    ("LGPL-{}", ["lgpl-name"]),
    ("BSD-3-Clause", ["bsd3-name"]),
    ("BSD-2-Clause", ["bsd2-name"]),
    ("MPL-{}", ["mpl-form"]),
    ("ISC", ["isc-grant"]),
    ("BSL-{}", ["boost-name"]),
    ("BSL-1.0", ["boost-grant"]),
    ("EPL-{}", ["epl-name"]),
    ("Artistic-{}", ["artistic-name"]),
    ("WTFPL", ["wtfpl-name"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-NC-{}", ["cc-by-nc"]),
    ("CC-BY-SA-{}", ["cc-by-sa"]),
    ("CC-BY-{}", ["cc-by"]),
    ("CC0-{}", ["cc0"]),
]
#: Every known sentence and tag holds one of these; texts without any are not cut up.
TRIGGER = r"(?i)licen[sc]|permission|warrant|redistribut|copyright|rights reserved|public domain|free software|under cc|apache|provided|altered|misrepresented|advertising|held liable|shall the authors|under the gpl|if a copy|you just do|you may obtain|neither the name"

TAG = "spdx"
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)")
_WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
_APART = re.compile(r"[^a-z0-9.]+|\.(?![a-z0-9])|(?<![a-z0-9])\.")
_LINE = re.compile(r"[.!?;:](?=\s|$)|\n")
#: Where the sentences of a full licence text end.
_SENTENCE = re.compile(r"[.!?;:](?=\s|$)|\n[^a-zA-Z0-9\n]*\n")
VERSION = r"[0-9]+(?:\.[0-9]+)*"


def normal(sentence: str) -> str:
    """Lower case; everything but letters, digits and inner dots as single blanks."""
    return _APART.sub(" ", sentence.lower()).strip()


def _cut(text: str, ends: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    for m in ends.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _pieces(text: str) -> list[tuple[int, int, str]]:
    return [(s, e, n) for s, e in _cut(text, _LINE) if (n := normal(text[s:e]))]


class Known:
    """Known sentences and rules; ``texts`` are further full licence texts by name, each with a rule of its own before all others."""

    def __init__(self, texts: Mapping[str, str] | None = None):
        self.exact = {s: k for k, v in SENTENCES.items() for s in v if "{" not in s}
        versions = [(s, k) for k, v in SENTENCES.items() for s in v if "{n}" in s]
        self.versions = [(re.compile(re.escape(s).replace(r"\{n\}", f"({VERSION})")), k) for s, k in versions]
        #: what the sentences with a version begin with, and the most that they may grow to
        self.heads = [(s[: s.index("{")], len(s) + 12) for s, _ in versions]
        self.free = [(*map(str.strip, s.split("{x}")), k) for k, v in SENTENCES.items() for s in v if "{x}" in s]
        for name, text in sorted((texts or {}).items()):
            for i, part in enumerate(_SENTENCE.split(text)):
                if s := normal(part):
                    self.exact.setdefault(s, f"{name}#{i}")
        #: hashes of what the sentences without a variable part begin with
        self.prefixes = {hash(" ".join(w[:i])) for s in self.exact for w in [s.split()] for i in range(1, len(w) + 1)}
        whole = [(name, [k for _, _, k, _ in self.identified(text)]) for name, text in sorted((texts or {}).items())]
        self.rules = [*sorted(whole, key=lambda x: -len(x[1])), *RULES]

    def sentence(self, s: str) -> tuple[str, str] | None:
        """The identifier and the version of a normalised sentence without free words."""
        if k := self.exact.get(s):
            return k, ""
        if any(s.startswith(h) for h, _ in self.heads):
            return next(((k, m[1]) for p, k in self.versions if (m := p.fullmatch(s))), None)
        return None

    def goes_on(self, s: str) -> bool:
        """Whether a known sentence without free words may begin with ``s``."""
        return hash(s) in self.prefixes or any(h.startswith(s + " ") or s.startswith(h) and len(s) <= n for h, n in self.heads)

    def _run(self, pieces: list, i: int) -> tuple[int, tuple[str, str]] | None:
        """The longest sentence without free words that begins with piece ``i``, and its last piece."""
        run, last = "", None
        for j in range(i, len(pieces)):
            run = f"{run} {pieces[j][2]}" if run else pieces[j][2]
            if k := self.sentence(run):
                last = j, k
            if not self.goes_on(run):
                break
        return last

    def _free_run(self, text: str, pieces: list, i: int) -> tuple[int, tuple[str, str]] | None:
        """The shortest sentence with free words that begins with piece ``i``: within its paragraph, and before the next piece that begins like it."""
        for prefix, suffix, k in self.free:
            head = tail = ""
            for j in range(i, len(pieces)):
                s = pieces[j][2]
                if j > i and (s.startswith(prefix) or text.count("\n", pieces[j - 1][1], pieces[j][0]) > 1):
                    break
                if len(head) <= len(prefix):
                    head = f"{head} {s}" if head else s
                    if not (head + " ").startswith(prefix + " ") and not (prefix + " ").startswith(head + " "):
                        break
                    tail = head[len(prefix) :]
                else:
                    tail = f"{tail} {s}"
                if len(tail) > len(suffix) + 2 and tail.endswith(" " + suffix):
                    return j, (k, "")
                tail = tail[-len(suffix) - 3 :]
        return None

    def identified(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, identifier, variable part) of the known sentences and tags. Sentences may run over lines and hold marks, and may stand on lines of their own amid other text."""
        out = []
        for m in _TAG.finditer(text):
            words = _WORD.findall(m[1])
            if words:
                out.append((m.start(), m.end(1), TAG, " ".join(words)))
        if out:
            text = _TAG.sub(lambda m: "\n" * len(m[0]), text)
        pieces, i = _pieces(text), 0
        while i < len(pieces):
            last = self._run(pieces, i) or self._free_run(text, pieces, i)
            if last:
                s, e = pieces[i][0], pieces[last[0]][1]
                out.append((s + len(text[s:e]) - len(text[s:e].lstrip()), e, *last[1]))
            i = last[0] + 1 if last else i + 1
        return sorted(out)

    def licences(self, found: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
        """The licences that rules and tags name, in order of first appearance, and the identifiers that nothing takes; ``found`` has identifiers with their variable parts."""
        left: list[str | None] = [k for k, _ in found]
        named: list[tuple[int, int, str]] = []
        for at, (k, value) in enumerate(found):
            if k == TAG:
                left[at] = None
                named += [(at, i, name) for i, name in enumerate(expression(value))]
        for name, run in self.rules:
            at = 0
            while at + len(run) <= len(left) and run:
                if left[at : at + len(run)] == run:
                    version = next((v for _, v in found[at : at + len(run)] if v), "")
                    named.append((at, 0, name.replace("{}", version if "." in version else f"{version}.0")))
                    left[at : at + len(run)] = [None] * len(run)
                    at += len(run)
                else:
                    at += 1
        return list(dict.fromkeys(n for *_, n in sorted(named))), [x for x in left if x]


def expression(value: str) -> list[str]:
    """The licences of a tag's expression; an exception stays with its licence."""
    out, words = [], iter(value.split())
    for w in words:
        if w == "WITH" and out:
            out[-1] += f" WITH {next(words, '')}".rstrip()
        elif w not in ("AND", "OR", "WITH"):
            out.append(w)
    return out


@cache
def _known(texts: tuple) -> Known:
    return Known(dict(texts))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, licences, sentences, unmatched, spans), one row for each row of ``docs``.

    ``licences``, ``sentences`` and ``unmatched`` are comma-joined names and
    identifiers in the order of the text, ``spans`` the places of the sentences in
    code points (start:end, ends exclusive). All are empty where nothing is known.
    ``texts`` are full licence texts by name, to be known as well.

    Null text counts as empty; null and repeated ids come back row by row. An
    empty table gives an empty result. Other columns are not read, so they may have
    any name.
    """
    names = ["doc_id", "licences", "sentences", "unmatched", "spans"]
    more = tuple(sorted((texts or {}).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(more)
        for batch in slices(batches, "text"):
            text = pc.fill_null(batch.column("text"), "")
            out = [["", "", "", ""]] * batch.num_rows
            for i in range(batch.num_rows) if more else pc.indices_nonzero(pc.match_substring_regex(text, TRIGGER)).to_pylist():
                got = known.identified(text[i].as_py())
                ids = [k for _, _, k, _ in got]
                found, left = known.licences([x[2:] for x in got])
                out[i] = [",".join(found), ",".join(ids), ",".join(left), ",".join(f"{s}:{e}" for s, e, *_ in got)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.string()) for c in zip(*out, strict=True)]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, licences string, sentences string, unmatched string, spans string")
