"""Licences by sentences and ordered rules: texts as they stand in files, and both steps against their definitions."""

from __future__ import annotations

import random
import re

import pytest
from lumenlake.llm import licenses
from lumenlake.llm.license_sentences import RULES, SENTENCES

MIT = '''MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
APACHE = '''# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
'''
GPL = '''/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {}General Public License for more details.
 *
 * You should have received a copy of the GNU {}General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */
'''
BSD = '''Copyright (c) 2001, Some University
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES.
'''
THIRD = '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
ISC = '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
'''
MPL = '''// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
'''
EPL = '''This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/'''


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        (MIT, ["MIT"]),
        (APACHE, ["Apache-2.0"]),
        (GPL.format("", "", ""), ["GPL-3"]),
        (GPL.format(*["Lesser "] * 3), ["LGPL-3"]),
        (GPL.format(*["Affero "] * 3), ["AGPL-3"]),
        (BSD.format(""), ["BSD-2-Clause"]),
        (BSD.format(THIRD), ["BSD-3-Clause"]),
        (ISC, ["ISC"]),
        (MPL, ["MPL-2.0"]),
        (EPL.replace("\nwhich", ",\nwhich"), ["EPL-2.0"]),
        (EPL, ["EPL-2.0"]),
        (MIT + "\n" + APACHE + "\n" + MPL, ["MIT", "Apache-2.0", "MPL-2.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Text before. Released under the MIT Licence. Text after.", ["MIT"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("All rights  reserved.", ["proprietary"]),
        ("You may not use this file except in compliance with the License.", ["unmatched:apache-file"]),
        ("They said that much of it was released under the MIT License last year", []),
        ("This program is licensed to nobody.", []),
        ("Released under\n\nthe MIT License.", []),
        ("", []),
        (None, []),
    ],
)
def test_texts(text, wanted):
    assert [x for x, _ in licenses.match_rules(licenses.sentences(text))] == wanted


def test_every_known_sentence_is_found_by_itself_and_shown_by_a_rule():
    used = {w.removesuffix("?") for _, wanted in RULES for w in wanted}
    words = {}
    for name, wordings in SENTENCES.items():
        assert name in used
        for wording in wordings:
            assert words.setdefault(licenses.normalised(wording), name) == name
            shown = "Now it " * wording.startswith("...") + wording.removeprefix("...").replace("{v}", "2.0")
            assert [x[0] for x in licenses.sentences(f"# {shown}.")] == [name], shown
            wrapped = re.sub(" ", lambda m, c=iter(range(10**6)): "\n * " if next(c) % 5 == 4 else " ", shown)
            assert [x[0] for x in licenses.sentences(wrapped)] == [name], wrapped


def sentences_by_definition(text: str) -> list[tuple[str, int]]:
    """All known sentences at all words, the leftmost and longest first, without an index."""
    known = [(licenses.normalised(w), name, w.startswith("...")) for name, ws in SENTENCES.items() for w in ws]
    out, free = [], 0
    tokens = [(m.start(), m.end(), "{v}" if m[1] else licenses.SPELLINGS.get(m[0], m[0])) for m in licenses.WORD.finditer(text.lower())]
    for i in range(len(tokens)):
        best = None
        for words, name, anywhere in known:
            j = i + len(words)
            if i < free or j > len(tokens) or tuple(t[2] for t in tokens[i:j]) != words:
                continue
            before = text[tokens[i - 1][1] : tokens[i][0]] if i else "\n"
            after = text[tokens[j - 1][1] : tokens[j][0]] if j < len(tokens) else "\n"
            whole = not re.search(r"\n[\W_]*\n", text[tokens[i][0] : tokens[j - 1][1]])
            if whole and (anywhere or re.search(r"\S|\n", before)) and re.search(r"\S|\n", after) and (best is None or len(words) > best[0]):
                best = len(words), name
        if best:
            out.append((best[1], tokens[i][0]))
            free = i + best[0]
    return out


def test_sentences_equal_the_definition():
    rng = random.Random(2)
    all_of = [w.removeprefix("...").replace("{v}", "2.0") for ws in SENTENCES.values() for w in ws]
    for _ in range(120):
        parts = [rng.choice([rng.choice(all_of), "lorem ipsum", "the software is", "Unless required", "all rights"]) for _ in range(rng.randint(1, 5))]
        text = "".join(p + rng.choice([" ", ". ", "\n", "\n\n", "; ", "\n# \n"]) for p in parts)
        text = re.sub(" ", lambda m: rng.choice([" ", " ", " ", "  ", "\n * "]), text)
        assert [(x[0], x[2]) for x in licenses.sentences(text)] == sentences_by_definition(text), text


def test_longer_rules_win_and_use_up_their_sentences():
    found = [("mit-grant", "", 0), ("mit-notice", "", 10), ("mit-as-is", "", 20), ("mit-grant", "", 30)]
    assert licenses.match_rules(found) == [("MIT", 0), ("MIT", 30)]


def by_definition(found):
    """Left to right, the first rule in order of which all that is needed stands there."""
    if not found:
        return []
    names = [x[0] for x in found]
    for name, wanted in RULES:
        left, fits = list(names), True
        for w in wanted:
            if left and left[0] == w.rstrip("?"):
                left.pop(0)
            elif not w.endswith("?"):
                fits = False
        if fits and len(left) < len(names):
            n = len(names) - len(left)
            version = next((x[1] for x in found[:n] if x[1]), "")
            shown = name.replace("{v}", version) if "{v}" in name else f"{name}-{version}" if version else name
            return [(shown, found[0][2]), *by_definition(found[n:])]
    return [(f"unmatched:{names[0]}", found[0][2]), *by_definition(found[1:])]


def test_sequences_equal_the_definition():
    rng = random.Random(1)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(0, 3)):
            found += [w.rstrip("?") for w in rng.choice(RULES)[1] if rng.random() < 0.8] + rng.choices(list(SENTENCES), k=rng.randint(0, 2))
        found = [(n, rng.choice(["", "2", "3.0"]), i) for i, n in enumerate(found)]
        assert licenses.match_rules(found) == by_definition(found)


def test_rows_of_any_kind(spark):
    text = "Released under the MIT license."
    rows = [(1, text, "q"), (1, text, "q"), (2, None, None), (None, "", "x"), (3, "filler word. " * 100_000 + text, "x"), (4, "İ" * 9 + "\n" + text, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    found = sorted(((r["doc_id"] or 0, r["licenses"], r["n_licenses"], r["places"]) for r in licenses.scan_licenses(docs, ["doc_id"]).collect()))
    assert found == [(0, "", 0, ""), (1, "MIT", 1, "0"), (1, "MIT", 1, "0"), (2, "", 0, ""), (3, "MIT", 1, "1300000"), (4, "MIT", 1, "10")]
    assert licenses.scan_licenses(docs.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "(GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause"),
        ("# SPDX-License-Identifier: Apache-2.0 AND MIT and more", "Apache-2.0 AND MIT"),
        ("Distributed under the MIT License. See LICENSE.", "MIT"),
        ("This code is licensed under the terms of the MIT license", "MIT"),
        ("Code released under the BSD 3-Clause License", "BSD-3-Clause"),
        ("It is licensed under the MIT License.", "MIT"),
        ("Licensed under either of Apache License, Version 2.0 or MIT", "Apache-2.0 OR MIT"),
        ("dual-licensed under the MIT License or the Apache License 2.0 at your option.", "MIT OR Apache-2.0"),
        ("made available under the terms of the\n * Mozilla Public License 2.0.", "MPL-2.0"),
        ("docs are distributed under the GNU Lesser General Public License, version 3", "LGPL-3"),
        ("licensed under the MIT License agreement of nobody", None),
        ("see SPDX-License-Identifier for what it means", None),
    ],
)
def test_tags_and_names_in_running_text(text, licence):
    found = licenses.match_rules(licenses.sentences(text))
    assert [x[0] for x in found] == ([licence] if licence else [])
