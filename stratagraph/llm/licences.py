"""Licence scans: template markup compiled into token automata.

Markup::

    <<optional>> ... <</optional>>     wording that may be left out
    <<var most=N>>                     replaceable: up to N words (25 if no N is given)
    <<var least=M; most=N>>            replaceable: M (0 if none is given) to N words
    <<var most=N; match=REGEX>>        replaceable: each word matches REGEX as a whole

All other words are mandatory and must match one by one, in order.  A template
becomes a nondeterministic automaton over words: states are positions of the
word list, an optional region adds an empty edge over it, a variable a bounded
loop.  Words are those of the scan: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases, fixed by the query's contract: words -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The wording of public licences and notices, as markup.  Numbers of clauses and the names of
#: copyright holders are replaceable, as are words that a licence's own text marks as such.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_ISC_WARRANTY = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_NUMBER = "<<var most=1; match=[0-9a-z]>>"
_BSD = f"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {_NUMBER} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {_NUMBER} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = f"{_NUMBER} neither the name of <<var most=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_WARRANTY = "this software is provided by the <<var least=1; most=8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the <<var least=1; most=8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
#: A notice begins behind the program's name: a template that may begin with any word would be tried at every word.
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation either version <<var least=1; most=2; match=[0-9]+>> of the license or at your option any later version"
_GNU_WARRANTY = "<<var least=1; most=4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {kind} public license for more details"
_GNU_COPY = "<<optional>>you should have received a copy of the gnu {kind} public license along with this <<var least=1; most=4>> if not <<optional>>see<</optional>> <<optional>><<var most=1; match=https?>> www gnu org licenses<</optional>><</optional>>"
#: label -> markup.
TEMPLATES = {
    "mit": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software {_WARRANTY}",
    "isc": f"permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies {_ISC_WARRANTY}",
    "bsd-2-clause": f"{_BSD} {_BSD_WARRANTY}",
    "bsd-3-clause": f"{_BSD} {_BSD_NAMES} {_BSD_WARRANTY}",
    "zlib": f"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions {_NUMBER} the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {_NUMBER} altered source versions must be plainly marked as such and must not be misrepresented as being the original software {_NUMBER} this notice may not be removed or altered from any source distribution",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var least=1; most=10>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<var most=1; match=https?>> mozilla org mpl 2 0",
    **{f"{short}-header": " ".join((_GNU, _GNU_WARRANTY, _GNU_COPY)).replace("{kind}", kind) for short, kind in (("gpl", "general"), ("lgpl", "lesser general"), ("agpl", "affero general"))},
    # notices of one line
    "mit-notice": "<<optional>>this <<optional>>software<</optional>><<optional>>work<</optional>><<optional>>code<</optional>> is<</optional>> <<optional>>released<</optional>><<optional>>licensed<</optional>><<optional>>distributed<</optional>> under the <<optional>>terms of the<</optional>> mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 <<optional>>0<</optional>>",
    "apache-notice": "under the <<optional>>terms of the<</optional>> apache <<optional>>software<</optional>> license",
    "gpl-notice": "licensed under the <<optional>>terms of the<</optional>> gnu <<optional>>lesser<</optional>><<optional>>affero<</optional>> general public license <<optional>>version <<var most=2; match=[0-9]+>><</optional>>",
    "cc-by-nc-notice": "under <<optional>>the<</optional>> <<optional>>terms of the<</optional>> cc by nc <<optional>>nd<</optional>><<optional>>sa<</optional>> <<var most=2; match=[0-9]+>>",
    "copyright": "copyright <<optional>>c<</optional>> <<var least=1; most=3; match=[0-9]{4}>> <<var most=8>> all rights reserved",
}

_MARK = re.compile(r"<<(/?optional|var[^>]*)>>|([^<\s]+)")


@dataclass
class Automaton:
    """steps[s]: [(word or regex or None for any, next)]; skips[s]: empty edges."""

    label: str
    steps: list[list[tuple]] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    final: int = 0
    mandatory: int = 0
    longest_word: bytes = b""

    def state(self) -> int:
        self.steps.append([])
        self.skips.append([])
        return len(self.steps) - 1

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def longest(self, tokens: list[bytes], at: int) -> int:
        """Words of the longest accepted run from `at`; 0 if none is accepted."""
        now, best, n = self.closure((0,)), 0, 0
        while now:
            if self.final in now:
                best = n
            if at + n >= len(tokens):
                break
            word = tokens[at + n]
            now = self.closure({t for s in now for test, t in self.steps[s] if (word == test if isinstance(test, bytes) else test is None or test.fullmatch(word))})
            n += 1
        return best

    def openers(self) -> set[bytes] | None:
        """Words a match may begin with; None if any may."""
        tests = [test for s in self.closure((0,)) for test, _ in self.steps[s]]
        return None if any(not isinstance(x, bytes) for x in tests) else set(tests)


def compile_template(label: str, markup: str) -> Automaton:
    """ValueError for regions that aren't closed, or a template without mandatory words."""
    a = Automaton(label)
    now, opened = a.state(), []
    for mark, plain in _MARK.findall(markup):
        if plain:
            for w in WORD.findall(plain.lower().encode()):
                to = a.state()
                a.steps[now].append((w, to))
                if not opened:
                    a.mandatory += 1
                    a.longest_word = max(a.longest_word, w, key=len)
                now = to
        elif mark == "optional":
            opened.append(now)
            to = a.state()
            a.skips[now].append(to)
            now = to
        elif mark == "/optional":
            if not opened:
                raise ValueError(f"{label}: a region is closed that wasn't opened")
            to = a.state()
            a.skips[now].append(to)
            a.skips[opened.pop()].append(to)
            now = to
        else:
            options = dict(x.strip().split("=", 1) for x in mark[3:].split(";") if "=" in x)
            test = re.compile(options["match"].encode()) if "match" in options else None
            end = a.state()
            for k in range(int(options.get("most", 25))):
                to = a.state()
                if k >= int(options.get("least", 0)):
                    a.skips[now].append(end)
                a.steps[now].append((test, to))
                now = to
            a.skips[now].append(end)
            now = end
    a.final = now
    if opened or not a.mandatory:
        raise ValueError(f"{label}: an optional region isn't closed, or nothing is mandatory")
    return a


class Scanner:
    """All templates at once: a word starts only those automata that may begin with it."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE):
        self.automata = [compile_template(k, v) for k, v in templates.items()]
        self.by_word: dict[bytes, list[Automaton]] = defaultdict(list)
        self.anywhere = []
        for a in self.automata:
            if (first := a.openers()) is None:
                self.anywhere.append(a)
            for w in first or ():
                self.by_word[w].append(a)
        self.base = [(compile_template(label, phrase), len(phrase.split())) for phrase, label in base.items()]
        self.base_words: dict[bytes, list] = defaultdict(list)
        for a, n in self.base:
            for w in a.openers() or ():
                self.base_words[w].append((a, n))
        #: A match holds all mandatory words of its template: a text without the longest of any template can't match.
        self.possible = re.compile(b"|".join(sorted({re.escape(a.longest_word) for a in (*self.automata, *(a for a, _ in self.base))})))

    def scan(self, low: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, int]]]:
        """Of a lower-cased text: base places (start, label) and the templates' matches (start, words, label,
        mandatory words), the longest from each start; all words count from 0."""
        tokens = WORD.findall(low)
        base, found = [], []
        for i, w in enumerate(tokens):
            for a, n in self.base_words.get(w, ()):
                if a.longest(tokens[i : i + n], 0) == n:
                    base.append((i, a.label))
            for a in (*self.by_word.get(w, ()), *self.anywhere):
                if n := a.longest(tokens, i):
                    found.append((i, n, a.label, a.mandatory))
        return base, found


#: Mandatory words from which on an accepted run is a whole licence text.
FULL_TEXT = 60


def score(base: list, found: list) -> float:
    """0 without evidence, 0.5 for a base phrase alone, and above it 0.5 to 1 with the mandatory
    words of the longest template that accepts a run: a whole licence text counts for more than a mention."""
    if found:
        return 0.5 + 0.5 * min(1.0, max(f[3] for f in found) / FULL_TEXT)
    return 0.5 if base else 0.0


SCAN = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<start:long,words:long,label:string>>"


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row a document: word count, base places, labels, score, and `matches`, the templates'
    accepted runs (start word, words, label).

    One pass, no shuffle; rows keep their order and repeated rows stay.  A null
    or empty text has no words, no labels and score 0.  Labels are distinct,
    sorted, comma-joined ("" if none).  Further columns are left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        target = pa.schema([("id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string())])))])
        for b in batches:
            ids = words.column(b, "id")
            buf, offsets = words.text_bytes(words.column(b, "text"))
            for i, j in words.slices(offsets):
                at = offsets[i : j + 1] - offsets[i]
                low, _, _, first = words.split(buf[offsets[i] : offsets[j]], at, words.ALNUM)
                whole = low.tobytes()
                rows = []
                for d, n in enumerate(np.diff(first).tolist()):
                    places, found = [], []
                    if n and scanner.possible.search(whole, at[d], at[d + 1]):
                        places, found = scanner.scan(whole[at[d] : at[d + 1]])
                    starts = [p for p, _ in places]
                    own = {label for _, label in places}
                    rows.append({"id": ids[i + d].as_py(), "n_words": n, "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {f[2] for f in found})), "score": score(places, found), "matches": [{"start": f[0], "words": f[1], "label": f[2]} for f in found]})
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, SCAN)
