"""Wording by which texts name their license: notices, statements and whole texts.

Sibling versions stand beside each other, so that the exact one wins in a scan.
"""

from __future__ import annotations

from importlib import resources

_GNU_END = (
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. "
    "You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
)
_GNU = (
    "This {0} is free software{2} you can redistribute it and/or modify it under the terms of the GNU {1} "
    "as published by the Free Software Foundation; either version {3} of the License, or (at your option) any later version. "
)

# SPDX name, name of the license in GNU notices, version.
_GNU_LICENSES = [
    ("GPL-1.0", "General Public License", "1"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
    ("LGPL-2.0", "Library General Public License", "2"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"),
]

# Names by which statements call a license.
_NAMES: list[tuple[str, str]] = [
    *((f"Apache-{v}", form.format(v)) for v in ("1.0", "1.1", "2.0") for form in ("the Apache License, Version {}", "the Apache License {}", "Apache-{}")),
    ("MIT", "the MIT License"), ("MIT", "MIT"), ("X11", "the X11 License"), ("ISC", "the ISC License"),
    ("BSD", "the BSD License"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("BSD-4-Clause", "the BSD 4-Clause License"), ("0BSD", "the BSD Zero Clause License"), ("Zlib", "the zlib License"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"), ("Unlicense", "the Unlicense"), ("WTFPL", "the WTFPL"), ("PSF-2.0", "the PSF License"),
    *((f"MPL-{v}", form.format(v)) for v in ("1.0", "1.1", "2.0") for form in ("the Mozilla Public License, v. {}", "the Mozilla Public License {}")),
    *((f"EPL-{v}", form.format(v)) for v in ("1.0", "2.0") for form in ("the Eclipse Public License, v. {}", "the Eclipse Public License {}")),
    *((f"EUPL-{v}", f"the European Union Public Licence {v}") for v in ("1.0", "1.1", "1.2")),
    *((f"Artistic-{v}", f"the Artistic License {v}") for v in ("1.0", "2.0")),
    *((f"GFDL-{v}", f"the GNU Free Documentation License, version {v}") for v in ("1.1", "1.2", "1.3")),
    ("OFL-1.1", "the SIL Open Font License, Version 1.1"),
    *((name, form.format(own, v)) for name, own, v in _GNU_LICENSES for form in ("the GNU {}, version {}", "the GNU {} v{}")),
    *((f"{name}-{v}.0", f"the {name}v{v}") for name, v in (("GPL", 1), ("GPL", 2), ("GPL", 3), ("LGPL", 2), ("LGPL", 3), ("AGPL", 3))),
    ("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "CC0 1.0 Universal"), ("CC0-1.0", "the Creative Commons CC0 1.0 Universal Public Domain Dedication"),
]

_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

_STATEMENTS = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This software is licensed under {}.")


def statements() -> list[tuple[str, str]]:
    """Single sentences that name a license and its version."""
    names = list(_NAMES)
    for kind, words in _CC.items():
        for version, port in _CC_VERSIONS.items():
            name = f"CC-{kind}-{version}"
            names += [(name, f"CC {kind} {version}"), (name, f"CC-{kind}-{version}"), (name, f"a Creative Commons {words} {version} {port} License")]
    return [(name, form.format(called)) for name, called in names for form in _STATEMENTS]


def notices() -> list[tuple[str, str]]:
    """Notices that files carry in place of the whole text."""
    out = []
    for name, own, version in _GNU_LICENSES:
        for what in ("program", "library") if name.startswith("LGPL") else ("program",):
            out.append((name, (_GNU + _GNU_END).format(what, own, ":" if version == "3" else ";", version)))
    out.append(
        (
            "MPL-2.0",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
            "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        )
    )
    return out


def texts() -> list[tuple[str, str]]:
    """Whole texts, by the names of their files."""
    files = sorted((resources.files("loomgraph.llm") / "license_texts").iterdir(), key=lambda f: f.name)
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files if f.name.endswith(".txt")]
