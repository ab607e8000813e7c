"""License notices: wording, label and mandatory phrases of each template of the license scan."""

from __future__ import annotations

from aerolens.llm.texts import plain_words

#: Wording of notices and clauses, with the phrases that each must hold in their places: (label, wording, phrases).
#: Long licenses stand as clauses, so that an inserted holder's name or clause number shifts one of them, not all.
WORDINGS = [
    ("mit", "Released under the MIT License", ["MIT License"]),
    ("mit", "Licensed under the MIT License", ["MIT License"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
     ["Permission is hereby granted, free of charge"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
     ["this permission notice shall be included in all copies or substantial portions"]),
    ("mit-0", "to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
     ["furnished to do so. The software is provided"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["Apache License"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["Apache License, Version 2.0"]),
    ("apache-2.0", "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution",
     ["Apache License Version 2.0", "Terms and conditions for use, reproduction, and distribution"]),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0", ["You may obtain a copy of the License", "apache.org/licenses/LICENSE-2.0"]),
    ("apache-1.1", "This product includes software developed by the Apache Software Foundation (http://www.apache.org/). Alternately, this "
                   "acknowledgment may appear in the software itself", ["developed by the Apache Software Foundation", "this acknowledgment may appear in the software itself"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["General Public License"]),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License", ["General Public License"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted",
     ["Redistribution and use in source and binary forms"]),
    ("bsd-2-clause", "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
                     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"", ["with the distribution. This software is provided"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                     "from this software without specific prior written permission", ["Neither the name of", "endorse or promote products derived"]),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
                     "written permission", ["nor the names of its contributors", "endorse or promote products derived"]),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement",
     ["advertising materials mentioning features or use"]),
    ("mpl", "Subject to the terms of the Mozilla Public License, v. 2.0", ["Mozilla Public License"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at http://mozilla.org/MPL/2.0/", ["Mozilla Public License, v. 2.0"]),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except "
                "in compliance with the License", ["Mozilla Public License Version 1.1"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ["Permission to use, copy, modify"]),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies", ["this permission notice appear in all copies"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
             "arising from the use of this software", ["In no event will the authors be held liable"]),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
     ["Altered source versions must be plainly marked"]),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ["Boost Software License, Version 1.0"]),
    ("epl-1.0", "made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", ["Eclipse Public License v1.0"]),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
     ["Eclipse Public License 2.0"]),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as "
              "the name is changed", ["changing it is allowed as long as the name is changed"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["CC BY-NC"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["CC BY-SA"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
     ["waived all copyright and related or neighboring rights"]),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ["CC0 1.0 Universal"]),
]

#: Fixed values: (family, name, what its header calls the work, versions).
GNU = [("gpl", "GNU General Public License", "program", ["2", "3"]), ("lgpl", "GNU Library General Public License", "library", ["2"]),
       ("lgpl", "GNU Lesser General Public License", "library", ["2.1", "3"]), ("agpl", "GNU Affero General Public License", "program", ["3"])]

#: Label and name of the attribution licenses, and the two wordings of their versions.
CREATIVE = [("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"),
            ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")]
EDITIONS = [("3.0", "Unported"), ("4.0", "International")]

#: Identifiers of ``SPDX-License-Identifier`` lines; a line may go on behind them (``-only``, ``-or-later``).
IDENTIFIERS = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Zlib",
               "BSL-1.0", "EPL-2.0", "Unlicense", "CC0-1.0"]


def plain(text: str) -> bytes:
    """A wording as the scan sees it: lower-cased words between single blanks."""
    return b" ".join(plain_words(text.encode()))


def templates() -> list[tuple[str, bytes, tuple[bytes, ...]]]:
    """(label, words, phrases) of all notices: as worded above, and by rule for families whose versions differ in a number.

    A version is told apart by a phrase that holds its number, so a text never gets another version's label.
    """
    made = list(WORDINGS)
    for family, name, work, versions in GNU:
        for v in versions:
            label = f"{family}-{v if '.' in v else v + '.0'}"
            made.append((label, f"{name}, version {v}", [f"{name}, version {v}"]))
            made.append((label, f"This {work} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the "
                                f"Free Software Foundation; either version {v} of the License, or (at your option) any later version",
                         [name, f"version {v} of the License"]))
    for short, name in CREATIVE:
        for v, edition in EDITIONS:
            made.append((f"cc-{short}-{v}", f"This work is licensed under a Creative Commons {name} {v} {edition} License", [f"Creative Commons {name} {v}"]))
    made += [(i.lower(), f"SPDX-License-Identifier: {i}", [f"Identifier: {i}"]) for i in IDENTIFIERS]
    return [(label, plain(text), tuple(plain(p) for p in phrases)) for label, text, phrases in made]
