"""Known licence texts and notices, by SPDX identifier (public texts).

NOTICES are also in the SQL of the scan; texts() adds complete texts (license_files), headers and headings.
"""

from __future__ import annotations

import re
from pathlib import Path

NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
)

_FOLDER = Path(__file__).with_name("license_files")
#: Where the terms of a complete text end and instructions for its use begin; both forms are in use.
_END = "END OF TERMS AND CONDITIONS"

#: Headings that files put above a text.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense", "The Unlicense (Unlicense)"),
}
_NO_WARRANTY = "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_ADDRESS = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301"


def _gnu(work: str, name: str, version: str, mark: str, last: str) -> str:
    """The header of the GNU licences, as they tell how to apply them."""
    return f"""{work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{"," if mark == ":" else ";"} either version {version} of the License, or (at your option) any later version.

{work} is distributed in the hope that it will be useful, {_NO_WARRANTY} See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with {work.lower()}{last}"""


def _complete() -> list[tuple[str, str]]:
    texts = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(_FOLDER.glob("*.txt"))]
    texts += [(i, t[: t.index(_END) + len(_END)]) for i, t in texts if _END in t] + [(i, _code(t)) for i, t in texts if i.startswith("CC-")]
    return texts + [(i, _rewrapped(t)) for i, t in texts]


def _rewrapped(text: str) -> str:
    """One line for each paragraph: a copyright line then takes the rest of its paragraph with it."""
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text))


def _code(text: str) -> str:
    """The legal code of a Creative Commons licence, without what is said before and after it between its rules."""
    return max(re.split(r"\n=====+\n", text), key=len)


def _headers() -> list[tuple[str, str]]:
    general, lesser = "General Public License", "Lesser General Public License"
    out = []
    for spdx, work, name, version in (
        ("GPL-2.0-or-later", "This program", general, "2"),
        ("GPL-3.0-or-later", "This program", general, "3"),
        ("AGPL-3.0-or-later", "This program", f"Affero {general}", "3"),
        ("LGPL-2.1-or-later", "This library", lesser, "2.1"),
        ("LGPL-3.0-or-later", "This program", lesser, "3"),
        ("LGPL-3.0-or-later", "This library", lesser, "3"),
    ):
        site = "https://www.gnu.org/licenses/"
        lasts = [f". If not, see <{site}>.", f". If not, see {site}"]
        lasts += [f"; if not, write to the Free Software Foundation, Inc., {_ADDRESS}{land}" for land in (" USA.", ", USA.", " USA")]
        out += [(spdx, _gnu(work, name, version, mark, last)) for mark in (":", ";") for last in lasts]
    apache = next(t for i, t in NOTICES if i == "Apache-2.0" and "obtain" in t)
    return [*out, ("Apache-2.0", apache.replace(" at http", " at\nhttp"))]


def texts() -> list[tuple[str, str, bool]]:
    """(SPDX identifier, text, whether a heading was put above it): NOTICES, complete texts, headers, texts with headings."""
    bsd = next(t for i, t in NOTICES if i == "BSD-2-Clause").split("\n")
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    short = [(i, t) for i, t in NOTICES if i in TITLES and "\n" in t]
    short.append(("BSD-3-Clause", "\n".join([*bsd[:3], third, bsd[3]])))
    # Lists with marks in place of numbers.
    short += [(i, re.sub(r"(?m)^[0-9]\. ", "* ", t)) for i, t in short if i.startswith("BSD")]
    complete = _complete()
    short += [(i, t) for i, t in complete if i in TITLES]
    reserved = "All rights reserved.\n"
    headings = [(i, f"{title}{rest}{t}") for i, t in short for title in ("", *[f"{x}\n" for x in TITLES[i]]) for rest in ("", reserved) if title or rest]
    boost = next(t for i, t in complete if i == "BSL-1.0").split("\n\n", 1)[1]
    plain = [*NOTICES, *complete, *_headers(), *short, ("BSL-1.0", boost)]
    return [(*x, False) for x in plain] + [(*x, True) for x in headings]
