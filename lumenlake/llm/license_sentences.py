"""Known sentences of licences and licence notices, and the ordered rules over them."""

from __future__ import annotations

from itertools import product

# Known sentences by identifier, in all their wordings. {v} stands for a version or year, "..." for a beginning in the middle of a sentence.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-grant": ("Licensed under the Apache License, Version {v}",),
    "apache-file": ("you may not use this file except in compliance with the License",),
    "apache-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-{v}", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-{v}"),
    "apache-as-is": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "apache-limits": ("See the License for the specific language governing permissions and limitations under the License",),
    "apache-title": ("Apache License Version {v}, January {v}",),
    "mit-release": ("...Released under the MIT License",),
    "mit-licensed": ("...Licensed under the MIT License", "This project is licensed under the MIT License"),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit-as-is": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "mit-liability": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    "isc-grant": tuple(f"Permission to use, copy, modify, {x} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies" for x in ("and/or", "and")),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "isc-as-is": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',),
    "isc-liability": (
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-endorse": tuple(f"...nor the names of {x} contributors may be used to endorse or promote products derived from this software without specific prior written permission" for x in ("its", "his", "other")),
    "bsd-as-is": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    ),
    "bsd-liability": tuple(f"IN NO EVENT SHALL THE COPYRIGHT {x} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES" for x in ("HOLDER", "OWNER", "HOLDERS")),
    "bsd-style": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",),
    "gnu-hope": tuple(f"This {x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY" for x in ("program", "library", "file", "software")),
    "gnu-fitness": ("...without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "mpl-form": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}",),
    "mpl-copy": tuple(f"If a copy of the MPL was not distributed with this file, You can obtain one at {x}://mozilla.org/MPL/{{v}}" for x in ("http", "https")),
    "epl-terms": tuple(f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {x}{{v}}" for x in ("", "version ", "v. ")),
    "boost-grant": ("Distributed under the Boost Software License, Version {v}",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "zlib-as-is": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "cc-zero": ("Licensed under CC0 {v}", "This work is licensed under CC0 {v}", "This work is dedicated to the public domain under CC0 {v}"),
    "all-rights": ("All rights reserved",),
}
# The GNU licences say the same of themselves.
for _id, _name in (("gpl", ""), ("lgpl", "Lesser "), ("agpl", "Affero ")):
    _public = f"GNU {_name}General Public License"
    SENTENCES |= {
        f"{_id}-work": (f"This work is licensed under the {_public}, version {{v}}", f"Licensed under the {_public}, version {{v}}", f"Licensed under the {_public} {{v}}"),
        f"{_id}-later": tuple(f"...is free software: you can redistribute it and/or modify it under the terms of the {_public} as published by the Free Software Foundation, either version {{v}} {x} License, or (at your option) any later version" for x in ("of the", "of this")),
        f"{_id}-only": (f"...is free software; you can redistribute it and/or modify it under the terms of the {_public} as published by the Free Software Foundation, version {{v}}", f"...is free software; you can redistribute it and/or modify it under the terms of the {_public} version {{v}} as published by the Free Software Foundation", f"...under the terms of the {_public} as published by the Free Software Foundation; version {{v}}"),
        f"{_id}-details": (f"See the {_public} for more details",),
        f"{_id}-copy": tuple(f"You should have received a copy of the {_public} along with this {x}" for x in ("program", "library", "file")),
        f"{_id}-title": (f"{_public} Version {{v}}, {{v}} June {{v}}", f"{_public} Version {{v}}, {{v}} November {{v}}", f"{_public} Version {{v}}, June {{v}}", f"{_public} Version {{v}}, February {{v}}"),
    }
# So do the Creative Commons licences, by their parts.
_PARTS = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
CC_KINDS = tuple("-".join(["by", *[p for p in (nc, rest) if p]]) for nc, rest in product(("", "nc"), ("", "sa", "nd")))
for _kind in CC_KINDS:
    _full = "Attribution" + "".join(f"-{_PARTS[p]}" for p in _kind.split("-")[1:])
    SENTENCES[f"cc-{_kind}"] = (
        f"Licensed under CC {_kind} {{v}}",
        f"This work is licensed under CC {_kind} {{v}}",
        *(f"This work is licensed under {a}Creative Commons {_full} {{v}} {b} License" for a in ("a ", "the ") for b in ("International", "Unported", "")),
    )

# How a licence is named in running text, and what leads to the name.
NAMED: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT/Expat License", "Expat License"),
    "Apache": ("Apache License, Version {v}", "Apache License {v}", "Apache {v} License", "Apache Software License, Version {v}", "Apache Software License {v}"),
    "BSD-{v}-Clause": ("BSD {v}-Clause License", "{v}-Clause BSD License"),
    "BSD-3-Clause": ("New BSD License", "Modified BSD License"),
    "BSD-2-Clause": ("Simplified BSD License", "FreeBSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "BSL": ("Boost Software License {v}", "Boost Software License, Version {v}"),
    "MPL": ("Mozilla Public License {v}", "Mozilla Public License, version {v}", "Mozilla Public License v. {v}"),
    "EPL": ("Eclipse Public License {v}", "Eclipse Public License, version {v}"),
    "GPL": ("GNU General Public License {v}", "GNU General Public License, version {v}", "GNU GPL License {v}"),
    "LGPL": ("GNU Lesser General Public License {v}", "GNU Lesser General Public License, version {v}"),
    "AGPL": ("GNU Affero General Public License {v}", "GNU Affero General Public License, version {v}"),
}
LEADS = tuple(f"{verb} {terms}{article}" for verb in ("licensed under", "distributed under", "released under", "available under", "provided under", "published under") for terms in ("", "the terms of ") for article in ("the ", "a ", "an ", ""))
SPDX = "spdx:"


def _plain(wording: str) -> str:
    return " ".join("".join(c if c.isalnum() or c in "{}" else " " for c in wording.lower()).split())


def _fresh(wordings: list[str], known: set[str]) -> tuple[str, ...]:
    """The wordings whose words no sentence has yet."""
    out = []
    for w in wordings:
        if _plain(w) not in known:
            known.add(_plain(w))
            out.append(w)
    return tuple(out)


_known = {_plain(w.removeprefix("...")) for wordings in SENTENCES.values() for w in wordings}
for _name, _forms in NAMED.items():
    SENTENCES[f"named-{_name}"] = _fresh([f"...{lead}{form}" for lead in LEADS for form in _forms], _known)
# Two licences to choose from, in either order.
EITHER = (("Apache", "MIT"), ("MIT", "Apache"))
for _a, _b in EITHER:
    _first, _second = ([*NAMED[x], *(["MIT"] if x == "MIT" else ["Apache {v}", "Apache-{v}"])] for x in (_a, _b))
    SENTENCES[f"either-{_a}-{_b}"] = _fresh([f"...licensed under {e}{x} {o}{y}{z}" for e in ("", "the ", "either ", "either of ", "either the ") for x in _first for o in ("or ", "or the ") for y in _second for z in ("", " at your option")], _known)

_GNU_END = ("gnu-hope?", "gnu-fitness?")
# Licences and the sequences of sentences that show them; earlier rules win, "?" marks what may be missing.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("all-rights?", "mit-grant", "mit-notice?", "mit-as-is?", "mit-liability?")),
    ("ISC", ("all-rights?", "isc-grant", "isc-as-is?", "isc-liability?")),
    ("0BSD", ("all-rights?", "0bsd-grant", "isc-as-is?", "isc-liability?")),
    ("BSD-3-Clause", ("all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is?", "bsd-liability?")),
    ("BSD-2-Clause", ("all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is?", "bsd-liability?")),
    ("BSD", ("all-rights?", "bsd-style")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Apache", ("apache-grant", "apache-file?", "apache-copy?", "apache-as-is?", "apache-limits?")),
    ("Apache", ("apache-title",)),
    *((name, (f"{x}-{form}", *_GNU_END, f"{x}-details?", f"{x}-copy?")) for x, name in (("gpl", "GPL"), ("lgpl", "LGPL"), ("agpl", "AGPL")) for form in ("later", "only")),
    *((name, (f"{x}-{form}",)) for x, name in (("gpl", "GPL"), ("lgpl", "LGPL"), ("agpl", "AGPL")) for form in ("work", "title")),
    ("MPL", ("mpl-form", "mpl-copy?")),
    ("EPL", ("epl-terms",)),
    ("BSL", ("boost-grant",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("mit-release",)),
    ("MIT", ("mit-licensed",)),
    *((f"CC-{kind.upper()}", (f"cc-{kind}",)) for kind in CC_KINDS),
    ("CC0", ("cc-zero",)),
    *((name, (f"named-{name}",)) for name in NAMED),
    *((" OR ".join(x if x == "MIT" else f"{x}-{{v}}" for x in pair), (f"either-{pair[0]}-{pair[1]}",)) for pair in EITHER),
    ("proprietary", ("all-rights",)),
)
