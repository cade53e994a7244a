"""Known license texts, notices and spellings."""

from __future__ import annotations

import re
from collections import Counter
from importlib import resources

# Spellings that mean the same in licenses, (found, canonical), on canonical words.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
    ("sub license", "sublicense"), ("sub licence", "sublicense"), ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authorised", "authorized"),
    ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"), ("modelled", "modeled"),
    ("cancelled", "canceled"), ("fulfil", "fulfill"), ("whilst", "while"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("http", "https"), ("v", "version"),
)

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so{conditions}"""
_MIT_CONDITIONS = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
"""
_MIT_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted{conditions}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_END = re.compile(r"^[ \t]*END OF TERMS AND CONDITIONS[^\n]*\n", re.MULTILINE)


def _full_texts() -> dict[str, str]:
    """The published texts in ``license_files``; those with an appendix on their use also without it."""
    out = {}
    for file in resources.files(__package__).joinpath("license_files").iterdir():
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        out[name] = text
        if (end := _END.search(text)) and text[end.end() :].strip():
            out[f"{name} (terms)"] = text[: end.end()]
    return out


# The texts of public licenses.
LICENSE_TEXTS = {
    "MIT": _MIT_GRANT.format(conditions=_MIT_CONDITIONS) + _MIT_WARRANTY,
    "MIT (titled)": "MIT License\n\n" + _MIT_GRANT.format(conditions=_MIT_CONDITIONS) + _MIT_WARRANTY,
    "MIT-0": _MIT_GRANT.format(conditions=".\n") + _MIT_WARRANTY,
    "ISC": _ISC_GRANT.format(
        conditions=", provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "0BSD": _ISC_GRANT.format(conditions=""),
    "BSD-2-Clause": _BSD_GRANT + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY,
    "Zlib": _ZLIB,
    **_full_texts(),
}

# Names that notices use for licenses.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
_SAID = [
    f"{subject}{verb} under {article}{{}}"
    for subject, verbs in (("", ("Licensed", "Released", "Distributed")), ("This work is ", ("licensed",)),
                           ("This software is ", ("licensed", "released")), ("This project is ", ("licensed",)))
    for verb in verbs
    for article in ("", "the ", "a ")
]


def notice_rows() -> list[tuple[str, str]]:
    """(license, notice): the usual sentences with every name, and the machine-readable line."""
    out = [(key, said.format(name)) for key, names in NAMES.items() for name in names for said in _SAID]
    return out + [(key, f"SPDX-License-Identifier: {key}") for key in NAMES]


def notice_marks() -> list[str]:
    """A few words of which every line with the canonical form of a notice holds one, as it is spelt there.

    Only words that EQUIVALENT neither replaces nor puts in: those stand in the line itself.
    """
    respelt = {word for pair in EQUIVALENT for form in pair for word in form.split()}
    left = [set(re.findall(r"[^\W_]+", text.lower())) - respelt for _, text in notice_rows()]
    marks = []
    while left:
        held = Counter(word for words in left for word in words)
        marks.append(min(held, key=lambda word: (-held[word], word)))
        left = [words for words in left if marks[-1] not in words]
    return marks
