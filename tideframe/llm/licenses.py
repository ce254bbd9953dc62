"""License scans: a trained paragraph classifier, applied in DataFrame operations only.

A multinomial logistic regression over word one- and two-grams tells licence families, licences of none of them, and
anything else. It is trained on the driver from notices, headers and whole short licences below, and calibrated on notices
and on families that a fold's model has not seen. The scan evaluates its weights as column expressions inside each row,
without a shuffle. A family counts if its probability is high enough and one of its texts has enough of its grams in the
paragraph; otherwise the licence is unknown.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, NONE = "unknown", "none"

# Names of each family's licences, their SPDX identifiers, and how its texts are worded.
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
FAMILIES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "mit": (
        ["MIT License", "MIT license", "Expat License"],
        ["MIT", "MIT-0", "X11"],
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            _NO_WARRANTY,
        ],
    ),
    "isc": (
        ["ISC License", "ISC license"],
        ["ISC"],
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.',
        ],
    ),
    "bsd": (
        ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "BSD-style license", "New BSD License", "Simplified BSD License", "BSD license"],
        ["BSD-2-Clause", "BSD-3-Clause", "0BSD", "BSD"],
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        ],
    ),
    "apache-2.0": (
        ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License"],
        ["Apache-2.0", "Apache 2.0"],
        [
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
            'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
            "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0",
            "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        ],
    ),
    "gpl": (
        ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GNU GPL, version 2 or later", "GPLv3", "GPLv2", "GNU General Public License v3.0"],
        ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL"],
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
            "This work is licensed under the GNU General Public License, version 3.",
            "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        ],
    ),
    "agpl": (
        ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3", "GNU AGPL, version 3 or later"],
        ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL"],
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
            "See the GNU Affero General Public License for more details.",
        ],
    ),
    "lgpl": (
        ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL, version 3", "GNU Library General Public License", "LGPLv3"],
        ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL"],
        [
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details.",
            "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
        ],
    ),
    "mpl-2.0": (
        ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "Mozilla Public License"],
        ["MPL-2.0", "MPL"],
        [
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
            'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.',
        ],
    ),
    "epl": (
        ["Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v1.0", "Eclipse Public License, version 2.0"],
        ["EPL-1.0", "EPL-2.0", "EPL"],
        [
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
            "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
        ],
    ),
    "cc-by": (
        ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "Creative Commons Attribution 3.0 Unported License"],
        ["CC-BY-4.0", "CC-BY-3.0"],
        ["This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    ),
    "cc-by-sa": (
        ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike license", "Creative Commons Attribution-Share Alike 3.0 Unported License"],
        ["CC-BY-SA-4.0", "CC-BY-SA-3.0"],
        ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    ),
    "cc-by-nc": (
        ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial license", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
        ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"],
        ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    ),
    "cc-by-nd": (
        ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs license"],
        ["CC-BY-ND-4.0", "CC-BY-ND-3.0"],
        ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License, visit http://creativecommons.org/licenses/by-nd/4.0/"],
    ),
    "public-domain": (
        ["Unlicense", "public domain", "CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero license"],
        ["Unlicense", "CC0-1.0"],
        [
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
            "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain.",
            "This work has been dedicated to the public domain under CC0 1.0.",
            "No rights reserved; released into the public domain.",
        ],
    ),
}
#: Licences of no family, by name, and general wording.
_STRANGERS = ["Foo License", "Acme Software License 1.2", "Server Side Public License", "Business Source License 1.1", "Elastic License 2.0", "Vendor License Agreement", "company terms", "proprietary license", "custom license", "Artistic License 2.0", "SIL Open Font License 1.1", "zlib License", "PostgreSQL License", "Academic Free License 3.0", "Open Database License", "Microsoft Public License", "Boost Software License 1.0", "Python Software Foundation License"]
_GENERAL = [
    "All rights reserved.",
    "Copyright (c) 2020 by the authors. All rights reserved.",
    "Copyright 2019 The Company. All rights reserved.",
    "Licensed under the terms of the accompanying license agreement.",
    "This work is licensed; see the license file for details.",
    "Use of this software is subject to a license agreement.",
    "Licensed material, may not be copied without permission of the copyright holder.",
    "Permission to copy is granted by the copyright holder.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies.",
    "Permission is granted to copy and distribute modified versions of this manual under the conditions for verbatim copying.",
    "See the LICENSE file for license terms.",
    "The source code is licensed separately; contact the authors for a license.",
]
_ALSO_WORDS = {"MIT", "X11", "ISC"}
_NOTICES = [
    "Licensed under the {}.", "Released under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}; see the file LICENSE for details.", "This work is licensed under a {}.", "License: {}",
    "This file is made available under the {}", "Copyright (c) 2021 the authors, {}, all rights reserved", "Lizenziert unter der {}.", "Dieses Programm ist freie Software unter den Bedingungen der {}.", "Publié sous la licence {}.", "Distribuido bajo la licencia {}.",
]
_TAGS = ["SPDX-License-Identifier: {}", "License {}", "license: {}", "Licensed under {}."]
#: An identifier by itself, and how it is named in passing; not for those that are words as well.
_BARE = ["{}", "Available under {}", "You may use this file under {}"]
_OTHER = [
    "The driver lost his license after the second offence.", "A fishing license is required for the lake.", "The record was released under a new name in spring.", "The general public was invited to the version shown in March.",
    "He attended the institute and studied software for two years.", "The Apache helicopter landed near the work site.", "She asked for permission to leave the room.", "The house came with a warranty for ten years.",
    "Free software for the public was presented in the library.", "The bar needs a liquor license, version or not.", "This work was done by the team in May.", "The common creative attribution of the painting is to his pupil.",
    "The copyright debate in parliament went on for hours.", "Licensed pharmacists work in the hospital.", "The source of the river is subject to dispute.", "Under the terms of the treaty both sides withdrew.",
    "The licensed games were sold in version two and three.", "She is a licensed pilot and this is her second year.", "His driving license was renewed in the morning.", "They copy the notes and distribute them in all classes.",
    "Er fuhr mit der Bahn in die Stadt und kam mit einem Buch zurück.", "Die Lizenz zum Fischen gilt für das ganze Jahr.", "La licence de pêche est valable un an.", "El permiso de conducir caduca en mayo.", "Sie ging mit den Kindern in die Bibliothek.",
    "The license plate of the car was stolen.", "A business license costs more in the city.", "Without a license you may not marry there.", "He has no license to practise medicine.", "The copyright of the film expired last year.",
    "They sell software and hardware under one roof.", "Her rights and duties are set out in the contract.", "The poet took some license with the facts.", "The dog license must be renewed every year.", "We went without water under the bridge.",
    "All rights of the prisoners were respected.", "Unter der Brücke stand ein Boot.", "The taxi license was sold for a fortune.", "My gun license is valid for five years.", "The software crashed without warning.", "Television license fees will rise.",
    "The conditions of the road are met with care and the following rules apply.", "In the event of rain the purpose of the visit is to see the house.", "It is the of and to in for with that on as by at from.",
]

_SLOTS = 1 << 15
_SPLIT = r"[^\p{L}\p{N}.+-]+"
_STOPS = r"(?<=\S)[.]+(?= |$)"
#: Between licences of which one is to be chosen, or that all hold; and what marks a part of such a line.
_CHOICE, _PART = r"(?i)\s+(?:or|and|oder|und|ou|et|o|y)\s+|\s*[/;|]\s*", "\x02"
#: What begins a line in a comment or a list, and is no part of its text.
_MARKER = r"(?m)^[ \t]*(?:/\*+|\*+/|//+|#+|;+|--+|\*+|>+|<!--|%+)[ \t]*"


def _words(text: str) -> list[str]:
    return [w for w in regex.sub(_STOPS, "", regex.sub(_SPLIT, " ", text.lower().replace("licence", "license")).strip()).split(" ") if w]


def _grams(text: str) -> list[str]:
    words = _words(text)
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def _number(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def notices() -> list[tuple[str, str]]:
    """(class, text) of everything that trains the model: names and identifiers in notices by turns, and texts as they are."""
    out, turn = [], 0

    def put(family: str, names: list[str], frames: list[str], each: int) -> None:
        nonlocal turn
        for x in names:
            out.extend((family, frames[(turn + k) % len(frames)].format(x)) for k in range(each))
            turn += each

    for family, (names, ids, texts) in FAMILIES.items():
        put(family, names, _NOTICES, 3)
        put(family, ids, _TAGS, len(_TAGS))
        put(family, [x for x in ids if x not in _ALSO_WORDS], _BARE, len(_BARE))
        out += [(family, t) for t in texts]
    put(UNKNOWN, _STRANGERS, _NOTICES, 4)
    put(UNKNOWN, _STRANGERS, _TAGS, 2)
    out += [(UNKNOWN, t) for t in _GENERAL]
    return out + [(NONE, t) for t in _OTHER]


@functools.lru_cache(maxsize=1)
def templates() -> dict[str, list[list[str]]]:
    """Grams of each family's texts, names and identifiers, to be found again in a paragraph; identifiers that are words of
    some language don't do alone."""
    out = {}
    for family, (names, ids, texts) in FAMILIES.items():
        worded = [*texts, *(n for n in names if len(_words(n)) > 1), *(t.format(x) for x in ids for t in _TAGS)]
        worded += [n for n in (*names, *ids) if len(_words(n)) == 1 and n not in _ALSO_WORDS]
        out[family] = [_grams(t) for t in worded]
    return out


@dataclass(frozen=True)
class LicenseModel:
    """Class names, the vocabulary's numbers, weights (classes x grams), biases, the temperature of calibrated
    probabilities, the least probability and similarity for a family, and the words without which nothing is judged."""

    classes: list[str]
    numbers: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    least_similarity: float
    gate: tuple[str, ...]

    def probabilities(self, text: str) -> np.ndarray:
        """Calibrated class probabilities of a paragraph (the columns below compute the same)."""
        place = {int(n): k for k, n in enumerate(self.numbers)}
        at = [place[n] for n in {_number(g) for g in _grams(text)} if n in place]
        z = (self.weights[:, at].sum(axis=1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, text: str, family: str) -> float:
        have = set(_grams(text))
        return max((len(have.intersection(t)) / len(t) for t in templates().get(family, [])), default=0.0)

    def decide(self, text: str) -> tuple[str, float, float]:
        """(family, probability, similarity) of a paragraph."""
        p = self.probabilities(text)
        guess, top = self.classes[int(p.argmax())], float(p.max())
        s = self.similarity(text, guess) if guess in FAMILIES else 0.0
        if guess in FAMILIES and top >= self.least and s >= self.least_similarity:
            return guess, top, s
        return NONE if top < self.least or p[self.classes.index(NONE)] >= p[self.classes.index(UNKNOWN)] else UNKNOWN, top, s


def _fit(rows: list[np.ndarray], y: np.ndarray, grams: int, classes: int, rounds: int = 40, rate: float = 0.2, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (grams x classes) and biases by Adam, for rows of gram numbers; every class weighs the same."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    at, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    first = np.cumsum(size) - size
    by_gram = np.argsort(at, kind="stable")
    used, start = np.unique(at[by_gram], return_index=True)
    target = np.eye(classes)[y]
    share = (target / np.maximum(target.sum(axis=0), 1)).sum(axis=1, keepdims=True) / max((target.sum(axis=0) > 0).sum(), 1)
    w, m, v, g = (np.zeros((grams + 1, classes)) for _ in range(4))
    for k in range(1, rounds + 1):
        z = np.add.reduceat(w[at], first) + w[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = (p - target) * share
        g[:] = decay * w
        g[used] += np.add.reduceat(off[of[by_gram]], start)
        g[-1] += off.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return w[:-1], w[-1]


def _disturbed(text: str, rng: np.random.Generator, filler: list[str]) -> str:
    """A text that lost some words and stands among others."""
    words = text.split()
    kept = [w for w in words if len(words) < 6 or rng.random() > 0.08]
    around = [str(w) for w in rng.choice(filler, int(rng.integers(0, 12)))]
    cut = int(rng.integers(0, len(around) + 1))
    return " ".join([*around[:cut], *kept, *around[cut:]])


def _choose_gate(texts: list[tuple[str, str]]) -> tuple[str, ...]:
    """Words of which every text about licences has one, or a word that begins with one.

    First all words of licences' names and identifiers that no other text has, and what the word for a licence begins with,
    so that a notice is judged in whatever language and wording it names one; for texts without any of them more words are
    chosen greedily, those that other texts have last.
    """
    about = [set(_words(t)) for c, t in texts if c != NONE]
    other = [set(_words(t)) for c, t in texts if c == NONE]
    common = {w: sum(w in ws for ws in other) / len(other) for ws in about for w in ws}
    named = {w for names, ids, _ in FAMILIES.values() for x in (*names, *ids) for w in _words(x) if len(w) > 2 and not w[0].isdigit()}
    chosen = ["licen", "lizen", *sorted(w for w in named if not any(v.startswith(w) for ws in other for v in ws))]
    about = [ws for ws in about if not any(w.startswith(x) for w in ws for x in chosen)]
    while about:
        gain: dict[str, float] = {}
        for ws in about:
            for w in ws:
                gain[w] = gain.get(w, 0.0) + 1
        best = max(gain, key=lambda w: (gain[w] * (1 - common[w]) ** 4 * min(len(w), 6), w))
        chosen.append(best)
        about = [ws for ws in about if not any(w.startswith(best) for w in ws)]
    return tuple(sorted({w for w in chosen if not any(w != v and w.startswith(v) for v in chosen)}))


@functools.lru_cache(maxsize=1)
def train_model(copies: int = 1, folds: int = 3, seed: int = 7) -> LicenseModel:
    """The model, from the notices and ``copies`` disturbed copies of each; the same arguments give the same model.

    A fold's model sees neither that fold's notices of the families nor any of a third of the families. The temperature is
    the one under which its notices are likeliest; the least probability and similarity are those that best tell unseen
    notices of known families from those of families that the model doesn't know.
    """
    classes = [*FAMILIES, UNKNOWN, NONE]
    rng = np.random.default_rng(seed)
    told = notices()
    filler = sorted({w for c, t in told if c == NONE for w in t.split()})
    texts, fold, seen = [], [], {}
    for c, t in told:
        seen[c] = turn = seen.get(c, -1) + 1
        for own in [t, *[_disturbed(t, rng, filler) for _ in range(copies)]]:
            texts.append((c, own))
            fold.append(turn % folds)
    fold, y = np.array(fold), np.array([classes.index(c) for c, _ in texts])
    rows = [_grams(t) for _, t in texts]
    often = Counter(g for r in rows for g in r)
    slots: dict[int, str] = {}
    for g in sorted(often, key=lambda g: (-often[g], g)):  # of grams that share a slot, the commonest has it
        slots.setdefault(_number(g) % _SLOTS, g)
    every = sorted(slots.values())
    place = {g: k for k, g in enumerate(every)}
    rows = [np.array([place[g] for g in r if g in place], np.int64) for r in rows]
    family = np.isin(y, range(len(FAMILIES)))
    logits, strange = np.zeros((len(rows), len(classes))), np.zeros(len(rows), bool)
    outcomes = []
    for f in range(folds):
        hidden = family & (y % folds == f)
        train = (fold != f) & ~hidden
        w, b = _fit([r for r, t in zip(rows, train, strict=True) if t], y[train], len(every), len(classes))
        z = np.stack([w[r].sum(axis=0) + b for r in rows])
        logits[(fold == f) & ~hidden] = z[(fold == f) & ~hidden]
        outcomes += [(z[k], k, True) for k in np.flatnonzero(hidden & (fold == f))] + [(z[k], k, False) for k in np.flatnonzero((fold == f) & ~hidden & family)]
    strange = family & (y % folds == fold)

    def loss(t: float) -> float:
        z = logits[~strange] / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), y[~strange]]).mean())

    temperature = float(min(np.arange(0.5, 6.01, 0.25), key=loss))
    draft = LicenseModel(classes, np.zeros(0), np.zeros((0, 0)), np.zeros(0), temperature, 0.0, 0.0, ())
    hits, misses = [], []
    for z, k, hidden in outcomes:
        p = np.exp((z - z.max()) / temperature)
        p /= p.sum()
        guess = classes[int(p.argmax())]
        if guess in FAMILIES:
            (misses if hidden else hits).append((float(p.max()), draft.similarity(texts[k][1], guess)))
    hits, misses = np.array(hits).reshape(-1, 2), np.array(misses).reshape(-1, 2)
    grid = [(a, b) for a in np.arange(0.3, 0.91, 0.05) for b in np.arange(0.3, 0.91, 0.05)]
    passes = lambda rows, a, b: ((rows[:, 0] >= a) & (rows[:, 1] >= b)).mean() if len(rows) else 0.0
    least, similarity = max(grid, key=lambda ab: (round(passes(hits, *ab) - passes(misses, *ab), 6), -ab[0], -ab[1]))
    w, b = _fit(rows, y, len(every), len(classes))
    return LicenseModel(classes, np.array([_number(g) for g in every], np.int64), w.T.astype(float), b.astype(float), temperature, float(least), float(similarity), _choose_gate(told))


def _one(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _constant(values: list, kind: str) -> Column:
    """An array that the optimizer folds into one literal; a list goes to the JVM value by value."""
    return F.split(F.lit("\x01".join(map(str, values))), "\x01").cast(f"array<{kind}>")


def _gram_column(paragraph: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.trim(F.regexp_replace(F.replace(F.lower(paragraph), F.lit("licence"), F.lit("license")), _SPLIT, " ")), _STOPS, ""), " "), lambda w: w != "")
    pairs = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda k: F.concat_ws(" ", F.element_at(ws, k), F.element_at(ws, k + 1)))
    return _one(words, lambda ws: F.array_distinct(F.concat(ws, F.when(F.size(ws) > 1, pairs(ws)).otherwise(F.array().cast("array<string>")))))


def classify_paragraph(paragraph: Column, model: LicenseModel) -> Column:
    """struct(family, probability, similarity): a known family needs the model and one of its texts to agree.

    similarity: the largest share of a text's one- and two-grams, over the family's texts, that the paragraph has. Where
    the likeliest class is no family, or one that is not sure or not confirmed, it is the likelier of ``unknown`` and ``none``, and
    ``none`` where no class is likely enough.
    """
    slots = [0] * _SLOTS
    for k, n in enumerate(model.numbers.tolist()):
        slots[n % _SLOTS] = k + 1
    owner = _constant([int(model.numbers[k - 1]) if k else 0 for k in slots], "bigint")
    table = [_constant([float(np.round(row[k - 1], 5)) if k else 0.0 for k in slots], "double") for row in model.weights]
    worded = {c: [_constant(t, "string") for t in ts] for c, ts in templates().items()}
    slot_of = lambda n: F.pmod(n, F.lit(_SLOTS)).cast("int") + 1

    def plus(row: Column):
        return lambda s, i: s + F.element_at(row, i)

    def judge(grams: Column) -> Column:
        numbers = F.filter(F.transform(grams, lambda g: F.xxhash64(g)), lambda n: F.element_at(owner, slot_of(n)) == n)

        def scored(at: Column) -> Column:
            logit = [F.aggregate(at, F.lit(float(b)), plus(t)) / F.lit(model.temperature) for t, b in zip(table, model.bias, strict=True)]
            return _one(F.array(*logit), chosen)

        def chosen(z: Column) -> Column:
            top = F.array_max(z)
            p = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))
            guess = F.element_at(_constant(model.classes, "string"), F.array_position(z, top).cast("int"))
            likelier = F.element_at(z, model.classes.index(NONE) + 1) >= F.element_at(z, model.classes.index(UNKNOWN) + 1)
            other = F.when(likelier | (p < model.least), F.lit(NONE)).otherwise(F.lit(UNKNOWN))
            return F.struct(guess.alias("guess"), other.alias("other"), p.alias("p"))

        def confirmed(s: Column) -> Column:
            share = F.lit(0.0)
            for c, lists in worded.items():
                share = F.when(s["guess"] == c, F.greatest(*[F.size(F.array_intersect(grams, t)) / F.size(t) for t in lists], F.lit(0.0))).otherwise(share)
            known = ~s["guess"].isin(UNKNOWN, NONE) & (s["p"] >= model.least)
            return _one(share, lambda x: F.struct(F.when(known & (x >= model.least_similarity), s["guess"]).otherwise(s["other"]).alias("family"), s["p"].alias("probability"), x.alias("similarity")))

        return _one(_one(F.transform(numbers, slot_of), scored), confirmed)

    return _one(_gram_column(paragraph), judge)


def gate_pattern(model: LicenseModel) -> str:
    """A regular expression for the gate's words, as beginnings of words."""
    return r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(regex.escape(w, special_only=True) for w in model.gate) + ")"


def paragraphs(text: Column) -> Column:
    """Arrays of what is to be judged, one for each paragraph: its lines, all of it on one line, and what choices are between.

    Paragraphs end at blank lines; comment and list markers go. One that follows a short line alone, such as a heading, is
    also taken together with it.
    """
    blocks = F.split(F.regexp_replace(text, _MARKER, ""), r"\n[ \t\r]*\n\s*")
    flat = lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))

    def units(b: Column, k: Column) -> Column:
        lines = F.when(F.instr(F.trim(b), "\n") > 0, F.split(b, "\n")).otherwise(F.array().cast("array<string>"))
        before = F.get(blocks, k - 1)
        headed = F.when((k > 0) & (F.char_length(before) <= 40) & (F.char_length(b) <= 400), F.array(F.concat_ws(" ", flat(before), flat(b)))).otherwise(F.array().cast("array<string>"))
        own = F.concat(lines, F.array(flat(b)), headed)
        parts = F.flatten(F.transform(F.filter(own, lambda u: u.rlike(_CHOICE)), lambda u: F.transform(F.split(u, _CHOICE), lambda p: F.concat(F.lit(_PART), p))))
        return F.concat(own, F.array_distinct(parts))

    return F.transform(blocks, units)


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, family, families, n_paragraphs, probability, similarity.

    A paragraph is judged by its lines and as one line; of a line that names several licences each part is judged too. ``families`` are all that are found, sorted, ``family`` is the surest
    (of equals the first), known families before ``unknown``, and ``none`` where no paragraph is about a licence;
    ``n_paragraphs`` counts those that are. Lines without any word of the model's gate
    aren't judged. Null, empty and wordless texts: ``none``, with probability and similarity 0. Rows are judged one by
    one: null or repeated doc_id and repeated rows stay as they are; other columns are ignored. Empty table: no rows.
    """
    model = model or train_model()
    text, gate = F.coalesce("text", F.lit("")), gate_pattern(model)
    nothing = F.struct(F.lit(NONE).alias("family"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("similarity"))
    better = lambda s: F.struct((s["family"] != UNKNOWN).alias("known"), s["probability"].alias("probability"))
    best = lambda found: F.aggregate(found, nothing, lambda a, s: F.when((s["family"] != NONE) & ((a["family"] == NONE) | (better(s) > better(a))), s).otherwise(a))
    units = F.transform(paragraphs(text), lambda us: F.filter(us, lambda u: u.rlike(gate)))
    units = F.when(text.rlike(gate), F.filter(units, lambda us: F.size(us) > 0)).otherwise(F.array().cast("array<array<string>>"))
    rows = docs.select("doc_id", units.alias("_units"))
    # a part of a line only adds a family that is named in it
    judge = lambda u: _one(classify_paragraph(u, model), lambda s: F.when(F.startswith(u, F.lit(_PART)) & (s["family"] == UNKNOWN), nothing).otherwise(s))
    judged = F.transform("_units", lambda us: F.filter(F.transform(us, judge), lambda s: s["family"] != NONE))
    found = rows.select("doc_id", F.filter(judged, lambda ps: F.size(ps) > 0).alias("_found")).select("doc_id", F.size("_found").cast("long").alias("n_paragraphs"), F.flatten("_found").alias("_all"))
    found = found.select("doc_id", "n_paragraphs", best(F.col("_all")).alias("_best"), F.array_sort(F.array_distinct(F.transform("_all", lambda s: s["family"]))).alias("families"))
    return found.select("doc_id", "_best.family", "families", "n_paragraphs", "_best.probability", "_best.similarity")
