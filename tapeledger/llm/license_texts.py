"""Licence templates: wordings by name, and the words that a passage must hold or lack to be given the name."""

from tapeledger.llm.license_full_texts import TEXTS

# Wordings of public licences and of usual licence notices.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

_BSD = TEMPLATES["BSD-2-Clause"]
TEMPLATES["BSD-3-Clause"] = _BSD.replace("THIS SOFTWARE IS PROVIDED", """3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED""")
TEMPLATES["Unlicense"] = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"""
TEMPLATES["MPL-2.0-header"] = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GPL = TEMPLATES["GPL-3.0-header"]
_FREE = """You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""
TEMPLATES["GPL-2.0-header"] = (
    _GPL.replace("either version 3", "either version 2"),
    _GPL.replace("either version 3", "either version 2").replace("is free software: you", "is free software; you").split("You should have")[0] + _FREE)


def _relative(header: str, kind: str, version: str, things: str) -> str:
    out = header.replace("General Public", f"{kind} General Public").replace("either version 3", f"either version {version}").replace("either version 2", f"either version {version}")
    return out.replace("This program", f"This {things}").replace("this program", f"this {things}")


TEMPLATES["AGPL-3.0-header"] = _relative(_GPL, "Affero", "3", "program")
TEMPLATES["LGPL-3.0-header"] = tuple(_relative(_GPL, "Lesser", "3", t) for t in ("program", "library"))
TEMPLATES["LGPL-2.1-header"] = tuple(_relative(h, "Lesser", "2.1", t) for h in TEMPLATES["GPL-2.0-header"] for t in ("program", "library"))
TEMPLATES["LGPL-2.0-header"] = tuple(_relative(h, "Library", "2", t) for h in TEMPLATES["GPL-2.0-header"] for t in ("program", "library"))

TEMPLATES |= TEXTS
# The Affero licence is the GPL 3 under its own title and with another section 13.
_BEFORE, _REST = TEXTS["GPL-3.0"].split("13. Use with the GNU Affero General Public License.", 1)
TEMPLATES["AGPL-3.0"] = _BEFORE.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU General Public", "GNU Affero General Public") + """13. Remote Network
Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified
version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an
opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge,
through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for
any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other
provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public
License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is the
covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License. 14. Revised Versions""" + _REST.split(
    "14. Revised Versions", 1)[1].replace("GNU General Public", "GNU Affero General Public")

#: What a notice begins with. The first is in most others; they are listed so that a passage covers the whole notice.
LEADS = ("under", "licensed under", "released under", "distributed under", "available under", "published under", "this work is licensed under", "this project is licensed under",
         "this software is licensed under", "under the terms of")


def _versions(version: str) -> list[str]:
    """The ways to write a version: 3 and 3.0 are the same."""
    short = version.removesuffix(".0")
    return [f"{v}{n}" for n in dict.fromkeys((short, version)) for v in ("version ", "v", "v. ", "")]


def _gnu(kind: str, letters: str, version: str) -> list[str]:
    names = [f"GNU {kind}General Public License", f"GNU {kind}General Public License ({letters})", f"GNU {letters}", letters]
    out = [f"{name} {v}" for name in names for v in _versions(version)]
    return out + [f"version {n} of the {name}" for name in names[:3] for n in dict.fromkeys((version, version.removesuffix(".0")))] + [f"{letters}v{version.removesuffix('.0')}", f"GNU {letters}v{version.removesuffix('.0')}"]


def _named(names: tuple[str, ...], version: str = "") -> list[str]:
    return [f"{n}{v}{end}" for n in names for v in ([f" {v}" for v in _versions(version)] if version else [""]) for end in ("", " license")]


_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _creative(kind: str, version: str) -> list[str]:
    place = {"4.0": " International", "3.0": " Unported"}.get(version, "")
    longs = [_CC[kind], *([_CC[kind].replace("NoDerivatives", "NoDerivs")] if "ND" in kind else [])]
    longs += [x.replace("NonCommercial", "Non-Commercial") for x in longs if "NC" in kind]
    out = [f"Creative Commons {x} {version}{end}" for x in longs for end in dict.fromkeys(("", " License", place, f"{place} License", f"{place} Public License"))]
    return out + [f"{cc} {kind} {version}{end}" for cc in ("CC", "Creative Commons") for end in ("", " license")]


NOTICES: dict[str, list[str]] = {
    "MIT": _named(("MIT", "MIT/Expat", "Expat")), "MIT-0": ["MIT-0", "MIT-0 License", "MIT No Attribution License"], "ISC": _named(("ISC",)), "Unlicense": ["Unlicense", "Unlicense License"],
    "Apache-2.0": _named(("Apache", "Apache License", "Apache Software License"), "2.0") + [f"Apache {v} license" for v in _versions("2.0")],
    "BSD-2-Clause": _named(("BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "FreeBSD")), "BSD-3-Clause": _named(("BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD")),
    "MPL-1.1": _named(("MPL", "Mozilla Public License"), "1.1"), "MPL-2.0": _named(("MPL", "Mozilla Public License", "Mozilla Public License (MPL)"), "2.0"),
    "GPL-2.0": _gnu("", "GPL", "2.0"), "GPL-3.0": _gnu("", "GPL", "3.0"), "LGPL-2.0": _gnu("Library ", "LGPL", "2.0"), "LGPL-2.1": _gnu("Lesser ", "LGPL", "2.1"), "LGPL-3.0": _gnu("Lesser ", "LGPL", "3.0"),
    "AGPL-3.0": _gnu("Affero ", "AGPL", "3.0"), "Artistic-1.0": _named(("Artistic", "Artistic License"), "1.0"),
    "CC0-1.0": [f"{n}{end}" for n in ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Creative Commons Zero 1.0") for end in ("", " License", " Public Domain Dedication")],
} | {f"CC-{kind}-{v}": _creative(kind, v) for kind in _CC for v in ("2.0", "2.5", "3.0", "4.0")}

for _name, _phrases in NOTICES.items():
    _own = TEMPLATES.get(f"{_name}-notice")
    _spdx = [f"SPDX-License-Identifier: {_name}"] + ([f"SPDX-License-Identifier: {_name}-{_end}" for _end in ("only", "or-later")] if "GPL" in _name else [])
    TEMPLATES[f"{_name}-notice"] = tuple(dict.fromkeys([*([_own] if _own else []), *_spdx, *(f"{_lead} {_article}{_p}" for _lead in LEADS for _article in ("", "the ", *(("a ",) if _name.startswith("CC-") else ())) for _p in dict.fromkeys(_phrases))]))


def _needs(name: str) -> tuple[list[str], list[str]]:
    """Words of which a passage must hold one, and words of which it must hold none, for the licence and for its relatives apart."""
    family, _, form = name.partition("-notice") if name.endswith("-notice") else name.partition("-header")
    whole = family == name
    kind, _, version = family.rpartition("-")
    short = version.removesuffix(".0")
    gnu = {"GPL": "", "LGPL": "library" if version == "2.0" else "lesser", "AGPL": "affero"}
    if kind in gnu and whole:
        return [f"gnu {gnu[kind]} general public license version {version if version == '2.1' else short}"], []
    if kind in gnu:
        bans = {"GPL": ["lesser", "library", "affero", "lgpl", "agpl"], "LGPL": ["affero", "agpl"] + ["lesser", "version 2.1"] * (version == "2.0"), "AGPL": ["lesser", "library", "lgpl"]}[kind]
        short = "2.1" if version == "2.1" else short
        return [f"version {short}", f"v {short}", f"v{short}", f"{kind}v{short}", f"{kind} {short}", f"license {short}", f"{kind}-{version}"], bans
    if kind == "Apache" and not whole:
        return ["version 2", "v2", "v 2", "apache 2", "license 2", "licenses license 2"], []
    if kind == "MPL":
        return [f"version {version}", f"v {version}", f"v{version}", f"license {version}", f"mpl {version}", f"mpl {short}", f"version {short}", f"license {short}", f"v{short}", f"v {short}"], []
    if kind == "BSD-2":
        return ["redistribution", "2 clause", "simplified", "freebsd"], ["neither the name", "endorse", "3 clause"]
    if kind == "BSD-3":
        return ["endorse", "3 clause", "new bsd", "modified bsd", "revised bsd"], []
    if kind.startswith("CC-"):
        has = kind.split("-")[1:]
        words = {"SA": ["sharealike", "sa"], "ND": ["noderivatives", "noderivs", "nd"], "NC": ["noncommercial", "non commercial", "nc"]}
        return [version], [w for k, ws in words.items() if k not in has for w in ws]
    key = {"MIT": ["mit", "expat"] if form == "" and name.endswith("-notice") else [], "CC0-1.0": ["cc0", "zero"], "ISC": ["isc"] if not whole else [], "Unlicense": ["unlicense", "unencumbered"]}
    return key.get(family, []), []


#: By template name: phrases of which a passage holds at least one (if there are any), and phrases of which it holds none.
MARKS = {_n: _needs(_n) for _n in TEMPLATES}
