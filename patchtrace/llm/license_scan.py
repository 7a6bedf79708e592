"""License scans: conditional compression against license templates.

A text's sentences (lines, cut at sentence ends) that hold a cue word open a region: they and
all around them that a notice could reach, counted in words and never in lines. Every template
whose identifying words (name, version) a region holds is aligned with the region's words in one
pass: the best local alignment, in which a word in order gains 2 and a word between costs 1, so a
notice may be wrapped at any width and cut by any line end. Alignments that hold enough of the
template's words are candidate blocks. The stretch that the aligned words span, so not the prose
around it, is compressed by itself and with the template as zstandard raw dictionary, and must
shrink enough. The exact wording decides between candidates that share sentences, then the size
reductions rank.

Defined results: null and empty texts have no blocks; every confirmed block gives one row, from
the first to the last sentence of the notice, its reduction is that of the stretch; a sentence
belongs to one notice; repeated rows give their own rows; equal reductions rank by template name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from patchtrace.llm.common import pick, strings, text_slices

# Wording of public license notices, with the words that identify each.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "All-Rights-Reserved": ("All rights reserved.", ("all", "rights", "reserved")),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.", ("apache", "2.0")),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", ("bsd", "2-clause")),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", ("bsd", "3-clause")),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", ("cc0", "1.0")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                ("gnu", "general", "public", "2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                ("gnu", "general", "public", "3")),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("permission", "use", "fee", "granted")),
    "MIT": ("Released under the MIT License.", ("mit",)),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.", ("permission", "free", "charge", "sublicense")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                ("mozilla", "public", "2.0")),
}
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version {} of the License, or (at your option) any "
    "later version.")
TEMPLATES |= {f"GPL-{v}.0-header": (_GNU_HEADER.format(v), ("gnu", "general", "public", "foundation", v)) for v in "23"}
TEMPLATES["BSD-text"] = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.", ("redistribution", "source", "binary", "permitted", "retain"))
# tags are no sentences: they end with their line
TAGS = {f"SPDX-{x}": (f"SPDX-License-Identifier: {x}", ("spdx-license-identifier", x.lower())) for x in (
    "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "MIT", "MPL-2.0")}
# cue words stand alone: a line end may cut any phrase
CUE = re.compile(r"(?i)licen[sc]|copyright|\brights\b|\bdomain\b|permission|warrant|redistribut|\bgnu\b|\bgpl\b|\bcc0?\b")
_WORD = re.compile(r"[^\s\"'(),;:]*[^\s\"'(),;:.]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Least share of the template's words that stand in the block in order, and least reduction.
LEAST_WORDS, LEAST_REDUCTION = 0.8, 0.3


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, stop) of lines cut at sentence ends; blank ones left out."""
    out, at = [], 0
    for line in text.split("\n"):
        cuts = [0, *(m.end() for m in _SENTENCE.finditer(line)), len(line)]
        out += [(at + a, at + b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if line[a:b].strip()]
        at += len(line) + 1
    return out


@dataclass(frozen=True)
class Match:
    start: int
    stop: int
    license: str
    reduction: float
    missing: int
    added: int


#: An alignment is one number: three for each word in order plus its start, above its start.
_SHIFT = 32


class Scanner:
    def __init__(self, templates=None, level: int = 19):
        self.templates = templates or TEMPLATES | TAGS
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.given, self.words, self.places = {}, {}, {}
        for name, (wording, _) in sorted(self.templates.items()):
            held = zstandard.ZstdCompressionDict(wording.encode("utf-8"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False,
                                                        write_checksum=False, write_dict_id=False)
            self.words[name] = words_of(wording)
            places = self.places.setdefault(name, {})
            for i in reversed(range(len(self.words[name]))):
                places.setdefault(self.words[name][i], []).append(i)
        # an alignment that gains has less than two words between for each in order
        self.reach = 3 * max(len(w) for w in self.words.values())

    def reduction(self, text: str, name: str) -> float:
        """Share of a text's compressed size that the template saves; line ends play no part."""
        data = " ".join(text.split()).encode("utf-8")
        return 1 - len(self.given[name].compress(data)) / len(self.plain.compress(data))

    def alignments(self, own: list[str], name: str) -> list[tuple[int, int, int]]:
        """(first word, last word, words of the template in order) of local alignments that hold enough of it.

        One pass over the words: ``best[i]`` is the best alignment so far within the template's
        words up to i. With the start added to its gain, a word between costs nothing to record.
        """
        places, least = self.places[name], (1 - LEAST_WORDS) * len(self.words[name])
        best, out, top = np.full(len(self.words[name]), -1, dtype=np.int64), [], -1
        for j, word in enumerate(own):
            if word not in places:
                continue
            fresh = j << _SHIFT | j
            for i in places[word]:                        # later places first: a word is used once
                value = (max(int(best[i - 1]), fresh) if i else fresh) + (3 << _SHIFT)
                np.maximum(best[i:], value, out=best[i:])
            if best[-1] > top:
                top = int(best[-1])
                start = top & (1 << _SHIFT) - 1
                same = ((top >> _SHIFT) - start) // 3
                if len(self.words[name]) - same <= least:
                    out.append((start, j, same))
        return out

    def regions(self, text: str, spans: list[tuple[int, int]]):
        """Runs of blocks (first, last) that a notice with a cue word in it can reach."""
        sizes: dict[int, int] = {}

        def size(k: int) -> int:
            if k not in sizes:
                sizes[k] = sum(1 for _ in _WORD.finditer(text, *spans[k]))
            return sizes[k]

        first = last = None
        for at in range(len(spans)):
            if not CUE.search(text, *spans[at]):
                continue
            lo, hi, left, right = at, at, self.reach, self.reach
            while lo and left > 0:
                lo -= 1
                left -= size(lo)
            while hi + 1 < len(spans) and right > 0:
                hi += 1
                right -= size(hi)
            if last is not None and lo <= last + 1:
                last = max(last, hi)
                continue
            if last is not None:
                yield first, last
            first, last = lo, hi
        if last is not None:
            yield first, last

    def scan(self, text: str) -> list[Match]:
        """Confirmed blocks of a text, in order."""
        if not CUE.search(text):
            return []
        spans = blocks(text)
        return [m for lo, hi in self.regions(text, spans) for m in self._region(text, spans, lo, hi)]

    def _region(self, text: str, spans, lo: int, hi: int) -> list[Match]:
        at, block, starts = [], [], []
        for k in range(lo, hi + 1):
            starts.append(len(at))
            at += [m.span() for m in _WORD.finditer(text, *spans[k])]
            block += [k] * (len(at) - len(block))
        starts.append(len(at))
        own = [text[a:b].lower() for a, b in at]
        held, found = set(own), []
        for name, (_, identifying) in self.templates.items():
            if held.issuperset(identifying):
                found += [(len(self.words[name]) - 3 * same + last + 1 - first, len(self.words[name]) - same, name, first,
                           last) for first, last, same in self.alignments(own, name)]
        taken, out = set(), []
        for (_, missing), equal in groupby(sorted(found), key=lambda x: x[:2]):
            confirmed = []
            for *_, name, first, last in equal:
                if not taken.isdisjoint(range(block[first], block[last] + 1)):
                    continue
                if not set(own[first:last + 1]).issuperset(self.templates[name][1]):
                    continue
                reduction = self.reduction(text[at[first][0]:at[last][1]], name)
                if reduction >= LEAST_REDUCTION:
                    confirmed.append((-reduction, name, first, last))
            for reduction, name, first, last in sorted(confirmed):
                a, b = block[first], block[last]
                if taken.isdisjoint(range(a, b + 1)):
                    taken.update(range(a, b + 1))
                    added = starts[b + 1 - lo] - starts[a - lo] - (len(self.words[name]) - missing)
                    out.append(Match(spans[a][0], spans[b][1], name, -reduction, missing, added))
        return sorted(out, key=lambda m: m.start)


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=None) -> DataFrame:
    """One row per confirmed block: id_col, start, length, license, reduction, words missing and added, exact."""

    def run(batches):
        own = Scanner(templates)
        for b in text_slices(batches):
            ids = b.column("id").to_pylist()
            rows = [(i, m) for i, t in zip(ids, strings(b.column("text")), strict=True) for m in own.scan(t)]
            m = [x for _, x in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], b.schema.field("id").type), pa.array([x.start for x in m], pa.int64()),
                 pa.array([x.stop - x.start for x in m], pa.int64()), pa.array([x.license for x in m], pa.string()),
                 pa.array([x.reduction for x in m], pa.float64()), pa.array([x.missing for x in m], pa.int32()),
                 pa.array([x.added for x in m], pa.int32()),
                 pa.array([x.missing + x.added == 0 for x in m], pa.bool_())],
                names=["id", "start", "length", "license", "reduction", "words_missing", "words_added", "exact"])

    src = pick(docs, id=id_col, text=text_col)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, start long, length long, license string, reduction double, "
                               "words_missing int, words_added int, exact boolean").withColumnRenamed("id", id_col)
