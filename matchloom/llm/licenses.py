"""License scans by template-markup matching.

A template is a license's whole wording with marked regions: ``<<beginOptional>>`` … ``<<endOptional>>``, which may be nested,
may be missing; ``<<var;name=…>>`` stands for words of any kind and number, up to the wording that follows;
``<<var;name=…;within=sentence>>`` for words of one sentence, so that a holder's name isn't a whole text; and
``<<var;name=…;match=a|b c>>`` for one of the wordings listed. A region that ends a template is as short as it can be: it takes no
words. Whole texts of longer licenses are templates in files, numbers of their paragraphs optional. Templates are compiled into token automata; a text holds
the license where the automaton accepts, that is where all mandatory wording stands word for word and in order. A text that
has the first sentences of a license and then goes on otherwise isn't accepted.

A sentence ends at a blank line, at a mark of the end, or at a full stop with white space behind it, unless what stands before has three letters
or fewer and so may be an abbreviation.

An automaton takes a text's words once, from all possible beginnings together: each state remembers the latest beginning
that reached it, so that time grows with the words and a region is as short as it can be. A text that lacks any mandatory word
of a template isn't run through its automaton, which loses nothing.

Beside the templates, three base phrases are looked for; their labels always stay.

Defined cases: a null or blank text has no words, no labels and score 0; any length is scanned whole; repeated rows each
get their row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

_LOWER = str.maketrans(UPPER, LOWER)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# What ends a sentence in a gap between words.
_SENTENCE = re.compile(r"\n[ \t\r]*\n|[!?][\s\"')]|(?<=[^\W_]{4})[\"')]*\.[\"')]*\s")
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = (
    "<<beginOptional>>this software is provided <<endOptional>><<beginOptional>>by <<var;name=holder;within=sentence>> <<endOptional>>as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;name=holder;within=sentence>> be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<beginOptional>>1 <<endOptional>>redistributions of source code must retain the <<beginOptional>>above <<endOptional>>copyright notice this list of conditions and the following disclaimer "
    "<<beginOptional>>2 <<endOptional>>redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_NO_WARRANTY = "<<beginOptional>>this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<var;name=kind;match=lesser |library |affero |>>general public license for more details<<endOptional>>"

#: Label -> template. Those ending in -text or -header are a license's own whole wording, the others short notices.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0<<beginOptional>> the license<<endOptional>>",
    "apache-2.0-header": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "<<beginOptional>>http <<endOptional>><<beginOptional>>https <<endOptional>>www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause-text": _BSD + _AS_IS,
    "bsd-3-clause-text": _BSD + "<<beginOptional>>3 <<endOptional>>neither the name of <<var;name=holder;within=sentence>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _AS_IS,
    "bsl-1.0-text": "boost software license version 1.0 <<beginOptional>>august 17th 2003 <<endOptional>>permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
    "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following "
    "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software "
    "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement "
    "in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "cc-by": "licensed under<<beginOptional>> a<<endOptional>><<beginOptional>> the<<endOptional>><<beginOptional>> creative commons attribution<<endOptional>> cc by <<var;name=version;match=1.0|2.0|2.5|3.0|4.0>>",
    "cc-by-nc": "licensed under<<beginOptional>> a<<endOptional>><<beginOptional>> the<<endOptional>> cc by nc<<beginOptional>> <<var;name=version;match=1.0|2.0|2.5|3.0|4.0>><<endOptional>>",
    "cc-by-sa": "licensed under<<beginOptional>> a<<endOptional>><<beginOptional>> the<<endOptional>> cc by sa<<beginOptional>> <<var;name=version;match=1.0|2.0|2.5|3.0|4.0>><<endOptional>>",
    "cc0": "<<beginOptional>>released under <<endOptional>>cc0 1.0<<beginOptional>> universal<<endOptional>>",
    "gpl-2.0": "licensed under<<beginOptional>> the terms of<<endOptional>> the gnu general public license<<beginOptional>> as published by the free software foundation<<endOptional>> version 2",
    "gpl-3.0": "licensed under<<beginOptional>> the terms of<<endOptional>> the gnu general public license<<beginOptional>> as published by the free software foundation<<endOptional>> version 3",
    "gpl-header": "<<var;name=what;match=this program|this file|this library|this software>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
    "either version <<var;name=version;match=2|3>> of the license or<<beginOptional>> at your option<<endOptional>> any later version " + _NO_WARRANTY,
    "lgpl": "gnu <<var;name=kind;match=lesser|library>> general public license",
    "lgpl-header": "<<var;name=what;match=this program|this file|this library|this software>> is free software you can redistribute it and or modify it under the terms of the gnu <<var;name=kind;match=lesser|library>> general public license as published by the free software foundation "
    "either version <<var;name=version;match=2|2.1|3>> of the license or<<beginOptional>> at your option<<endOptional>> any later version " + _NO_WARRANTY,
    "isc-text": "permission to use copy modify and<<beginOptional>> or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <<var;name=holder;within=sentence>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;name=holder;within=sentence>> be liable for any special direct indirect or consequential damages "
    "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to "
    "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice<<beginOptional>> including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall <<var;name=holder;within=sentence>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0": "subject to the terms of the mozilla public license <<beginOptional>>version <<endOptional>><<beginOptional>>v <<endOptional>>2.0",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at <<beginOptional>>http <<endOptional>><<beginOptional>>https <<endOptional>>mozilla org mpl 2.0",
    "all-rights-reserved": "copyright <<var;name=holder;within=sentence>> all rights reserved",
    "public-domain": "dedicated to the public domain<<beginOptional>> by <<var;name=holder;within=sentence>><<endOptional>>",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
    "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
    "<<beginOptional>>1 <<endOptional>>the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
    "<<beginOptional>>2 <<endOptional>>altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
    "<<beginOptional>>3 <<endOptional>>this notice may not be removed or altered from any source distribution",
}


def all_templates() -> dict[str, str]:
    """All templates: those above, and the whole texts in files beside this module."""
    texts = {f"{f.name.removesuffix('.txt')}-text": f.read_text(encoding="utf-8") for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    return TEMPLATES | texts


def split(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


@dataclass
class Automaton:
    """States are numbers; word[s] has the moves by word, skip[s] those by none; any[s] those by any word, and whether only within a
    sentence."""

    label: str
    word: list[dict[str, set[int]]] = field(default_factory=list)
    skip: list[set[int]] = field(default_factory=list)
    any: dict[int, tuple[int, bool]] = field(default_factory=dict)
    mandatory: list[str] = field(default_factory=list)
    start: frozenset[int] = frozenset()
    last: int = 0
    moves: list[dict[str, frozenset[int]]] = field(default_factory=list)
    stays: dict[int, tuple[frozenset[int], bool]] = field(default_factory=dict)

    def state(self) -> int:
        self.word.append({})
        self.skip.append(set())
        return len(self.word) - 1

    def close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)

    def path(self, at: int, words: list[str]) -> int:
        for x in words:
            new = self.state()
            self.word[at].setdefault(x, set()).add(new)
            at = new
        return at

    def done(self, begin: int, last: int) -> "Automaton":
        self.start, self.last = self.close({begin}), last
        self.moves = [{x: self.close(to) for x, to in m.items()} for m in self.word]
        self.stays = {s: (self.close({to}), bound) for s, (to, bound) in self.any.items()}
        return self

    def spans(self, w: list[str], where: dict[str, list[int]], begins: set[int] = frozenset()) -> list[tuple[int, int]]:
        """Where the automaton accepts: stretches that don't overlap, each from the latest beginning to the farthest end. begins has the
        words that begin a sentence."""
        firsts = sorted({i for s in self.start for x in self.moves[s] for i in where.get(x, ())})
        ends: dict[int, int] = {}
        active: dict[int, int] = {}  # state: the latest beginning
        k, i, n = 0, 0, len(w)
        while i < n:
            if not active:  # nothing has begun: on to the next word that can begin a match
                while k < len(firsts) and firsts[k] < i:
                    k += 1
                if k == len(firsts):
                    break
                i = firsts[k]
            x, now = w[i], {}
            for s, at in active.items():
                for t in self.moves[s].get(x, ()):
                    now[t] = max(at, now.get(t, -1))
                if s in self.stays:
                    to, bound = self.stays[s]
                    if not bound or i not in begins:
                        for t in to:
                            now[t] = max(at, now.get(t, -1))
            for s in self.start:
                for t in self.moves[s].get(x, ()):
                    now[t] = i
            if self.last in now:
                ends[now[self.last]] = i + 1
            active = now
            i += 1
        out: list[tuple[int, int]] = []
        for s, e in sorted(ends.items()):
            if not out or s >= out[-1][1]:
                out.append((s, e))
        return out


_REGION = r"<<var;name=\w+(;within=sentence)?>>"


def compile_template(label: str, markup: str) -> Automaton:
    a = Automaton(label)
    at, opened = a.state(), []
    begin = at
    parts = [p for p in re.split(r"(<<.*?>>)", markup) if p.strip()]
    while parts and parts[-1] == "<<endOptional>>" and len(parts) > 1 and re.fullmatch(_REGION, parts[-2]):
        del parts[-2]
    while parts and re.fullmatch(_REGION, parts[-1]):
        parts.pop()
    for part in parts:
        if part == "<<beginOptional>>":
            opened.append(at)
        elif part == "<<endOptional>>":
            new = a.state()
            a.skip[at].add(new)
            a.skip[opened.pop()].add(new)
            at = new
        elif m := re.fullmatch(r"<<var;name=\w+;match=(.+)>>", part):
            end = a.state()
            for choice in m[1].split("|"):
                a.skip[a.path(at, split(choice))].add(end)
            at = end
        elif m := re.fullmatch(_REGION, part):
            # The first word of a region may begin a sentence, but where it is bound none after it.
            inner, end = a.state(), a.state()
            a.any[at], a.any[inner] = (inner, False), (inner, m[1] is not None)
            a.skip[at].add(end)
            a.skip[inner].add(end)
            at = end
        elif part.startswith("<<"):
            raise ValueError(f"{label}: unknown markup {part}")
        else:
            words = split(part)
            if not opened:
                a.mandatory += words
            at = a.path(at, words)
    if opened or not a.mandatory:
        raise ValueError(f"{label}: an optional region isn't closed, or no wording is mandatory")
    return a.done(begin, at)


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        self.phrases = {label: re.compile(r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + _GAP.join(p.split()) + r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])") for p, label in PHRASES.items()}
        self.automata = [compile_template(k, v) for k, v in sorted((all_templates() if templates is None else templates).items())]
        self.needed = [sorted(set(a.mandatory), key=lambda x: (-len(x), x)) for a in self.automata]

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans [(label, start, end)]."""
        low = (text or "").translate(_LOWER)
        # All mandatory words of a template, or a base phrase, must stand in the text.
        chosen = [a for a, x in zip(self.automata, self.needed, strict=True) if all(y in low for y in x)]
        found = [(label, m.start(), m.end()) for label, p in self.phrases.items() for m in p.finditer(low)] if "license" in low else []
        if not chosen and not found:
            return len(_WORD.findall(low)), 0, None, None, "", "", 0.0, []
        places, w, begins, end = {}, [], set(), 0
        for i, m in enumerate(_WORD.finditer(low)):
            places[m.start()] = i
            if m.start() - end > 1 and _SENTENCE.search(low, end, m.start()):
                begins.add(i)
            w.append(m[0])
            end = m.end()
        where: dict[str, list[int]] = {}
        for i, x in enumerate(w):
            where.setdefault(x, []).append(i)
        spans = [(a.label, s, e) for a in chosen if where.keys() >= set(a.mandatory) for s, e in a.spans(w, where, begins)]
        lengths = {label: len(p.split()) for p, label in PHRASES.items()}
        base = [(label, places[s], places[s] + lengths[label]) for label, s, _ in found]
        firsts, labels = [s for _, s, _ in base], sorted({label for label, _, _ in base})
        covered, reach = 0, 0
        for s, e in sorted((s, e) for _, s, e in base + spans):
            covered += max(0, e - max(s, reach))
            reach = max(reach, e)
        return (
            len(w), len(base), min(firsts, default=None), max(firsts, default=None), ",".join(labels),
            ",".join(sorted({*labels, *(label for label, _, _ in spans)})), covered / len(w) if w else 0.0, spans,
        )


@functools.cache
def default_scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, id_col="doc_id", text_col="text", templates: dict[str, str] | None = None) -> DataFrame:
    """A row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score (share of the words
    that licenses cover), spans (label, start, end in words)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates) if templates else default_scanner()
        for b in batches:
            rows = [scanner.scan(x.as_py()) for x in b.column(1)]
            cols = [[r[k] for r in rows] for k in range(7)] + [[[{"label": n, "start": s, "end": e} for n, s, e in r[7]] for r in rows]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", *names])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, start long, end long>>")
