"""License scan: license wording, written as templates with optional and replaceable regions, found in whole texts.

A template is compiled into a token automaton: a literal word is one edge, an optional region may be skipped, and a
replaceable region takes between its least and most number of any words. A place is accepted when all mandatory
wording stands there exactly, word by word. Beside the templates, base phrases are found wherever their words stand
consecutively. Everything happens inside a row, so there is no shuffle, and nothing but the compiled templates travels.

Cases: null and empty texts have no words, no places and a score of 0; repeated rows are scanned each; an empty table
gives an empty result; other columns are ignored. Very long texts are read whole; where a template accepts several wordings from
one place, the longest counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, texts, words

#: The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label. <<optional>> ... <<end>> may be missing; <<any 1..3>> stands for one to three other words.
TEMPLATES = [
    ("mit", "under the <<optional>>terms of the<<end>> MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this <<any 1..4>> and associated"
        " documentation files <<optional>>(the <<any 1..2>>)<<end>>, to deal in the <<any 1..2>> without restriction",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 <<optional>>(the License)<<end>>"),
    ("gpl-3.0", "licensed under the <<optional>>terms of the<<end>> GNU General Public License, version 3 <<optional>>or later<<end>>"),
    (
        "gpl",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
        " Software Foundation, either version <<any 1..1>> of the License, or (at your option) any later version",
    ),
    ("cc-by-nc", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-NC <<any 1..2>>"),
    ("cc-by-sa", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-SA <<any 1..2>>"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    ("copyright-notice", "Copyright <<optional>>(c)<<end>> <<any 1..6>> All rights reserved"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal"
        " in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
        " of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this"
        " permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS"
        " PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<any 1..6>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " <<optional>>1<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " <<optional>>2<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution. <<optional>><<optional>>3<<end>> Neither the name of <<any 1..12>> may be used to endorse or"
        " promote products derived from this software without specific prior written permission.<<end>> THIS SOFTWARE IS PROVIDED BY <<any 1..8>> AS IS AND ANY EXPRESS OR"
        " IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT"
        " SHALL <<any 1..8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF"
        " SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
        " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above"
        " copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND <<any 1..8>> ALL WARRANTIES WITH REGARD TO THIS"
        " SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 1..8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR"
        " CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS"
        " ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
    (
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this <<any 1..2>> except in compliance with the License. You may obtain a copy of"
        " the License at <<optional>>http<<end>><<optional>>https<<end>> www.apache.org/licenses/LICENSE-2.0<<optional>>.txt<<end>> Unless required by applicable law or agreed"
        " to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
        " See the License for the specific language governing permissions and limitations under the License",
    ),
]


@dataclass
class Automaton:
    """States are numbers; edges[s] maps a word to the next states, None stands for any word."""

    label: str
    edges: list[dict[bytes | None, list[int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    end: int = 0
    mandatory: int = 0
    first: bytes = b""

    def state(self) -> int:
        self.edges.append({})
        self.free.append([])
        return len(self.edges) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, tokens: list[bytes], at: int) -> int:
        """Where the longest accepted wording that begins at this word ends; -1 if there is none."""
        now, found = self.closure({0}), -1
        for i in range(at, len(tokens) + 1):
            if self.end in now:
                found = i
            if not now or i == len(tokens):
                break
            word = tokens[i]
            now = self.closure({t for s in now for t in (*self.edges[s].get(word, ()), *self.edges[s].get(None, ()))})
        return found


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of one template; its first word must be mandatory, for candidates are looked up by it."""
    a = Automaton(label)
    here, opened, least_words = a.state(), [], 0
    for part in re.split(r"(<<[^>]*>>)", markup):
        if part == "<<optional>>":
            opened.append(here)
        elif part == "<<end>>":
            a.free[opened.pop()].append(here)
        elif m := re.fullmatch(r"<<any (\d+)\.\.(\d+)>>", part):
            least, most = map(int, m.groups())
            exits = [here] if not least else []
            for n in range(1, most + 1):
                step = a.state()
                a.edges[here].setdefault(None, []).append(step)
                here = step
                if n >= least:
                    exits.append(here)
            for e in exits[:-1]:
                a.free[e].append(here)
        else:
            for word in words(part):
                step = a.state()
                a.edges[here].setdefault(word, []).append(step)
                a.first = a.first or word
                if not opened:
                    least_words += 1
                here = step
    if opened or not a.first or None in a.edges[0] or a.free[0]:
        raise ValueError(f"a template must begin with mandatory wording and close its regions: {markup!r}")
    a.end, a.mandatory = here, least_words
    return a


def literal_prefix(a: Automaton) -> bytes:
    """The words that every accepted place begins with, for a quick look before the automaton runs."""
    said, s = [], 0
    while s != a.end and not a.free[s] and len(a.edges[s]) == 1 and None not in a.edges[s]:
        (word, (s,)), = a.edges[s].items()
        said.append(word)
    return b" " + b" ".join(said) + b" "


def places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Word positions at which the phrase, with a space at both ends, stands in the spaced line."""
    at = line.find(phrase)
    before = words_before = 0
    while at >= 0:
        words_before += line.count(b" ", before, at)
        before = at
        yield words_before
        at = line.find(phrase, at + 1)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """id_col, n_words, base (array of label, start, end), found (array of label, start, end, mandatory) and score for every row;
    words count from 0 and end is exclusive.

    score: 0 without any place; otherwise m / (m + 2), m the mandatory words of the longest accepted wording, so that
    long exact wording counts for nearly 1 and a bare two-word phrase for one half.
    """
    automata = [compile_template(*t) for t in (TEMPLATES if templates is None else templates)]
    looked_up = [(literal_prefix(a), a) for a in automata]
    base = [(b" " + b" ".join(words(p)) + b" ", len(words(p)), label) for p, label in (BASE_PHRASES if phrases is None else phrases).items()]
    span = [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    base_type, found_type = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("mandatory", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, founds, scores = [], [], [], []
            for text in texts(batch):
                tokens = words(text)
                line = b" " + b" ".join(tokens) + b" "
                spans = [{"label": name, "start": i, "end": i + n} for phrase, n, name in base if phrase in line for i in places(line, phrase)]
                found = [
                    {"label": a.label, "start": i, "end": end, "mandatory": a.mandatory}
                    for prefix, a in looked_up
                    if prefix in line
                    for i in places(line, prefix)
                    if (end := a.match(tokens, i)) >= 0
                ]
                longest = max([0, *(f["mandatory"] for f in found), *(s["end"] - s["start"] for s in spans)])
                counts.append(len(tokens))
                bases.append(spans)
                founds.append(found)
                scores.append(longest / (longest + 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(bases, base_type), pa.array(founds, found_type), pa.array(scores, pa.float64())],
                ["id", "n_words", "base", "found", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    place = "label: string, start: long, end: long"
    return columns(docs, id=id_col, text=text_col).mapInArrow(
        scan,
        f"id {kind}, n_words long, base array<struct<{place}>>, found array<struct<{place}, mandatory: long>>, score double",
    ).withColumnRenamed("id", id_col)
