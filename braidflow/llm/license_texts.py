"""Licence notices, identifiers and whole texts for ``license_scan``: (label, words)."""

from __future__ import annotations

import itertools
import re


def words(text: str) -> str:
    """A text's words as the scan takes them, one space apart."""
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))


# Notices by which works state their licence, and their labels.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "apache license version 2 0 january 2004"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("cc0-1", "cc0 1 0 universal"),
    ("cc0-1", "creative commons zero v1 0 universal"),
    ("cc0-1", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license version 3 29 june 2007"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "gnu general public license version 2 june 1991"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("bsd", "released under the bsd license"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("bsd", "licensed under the bsd 2 clause license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("epl-2", "eclipse public license version 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("bsl-1", "boost software license"),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("zlib", "released under the zlib license"),
    ("zlib", "licensed under the zlib license"),
    ("isc", "licensed under the isc license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("ofl-1", "this font software is licensed under the sil open font license version 1 1"),
    ("eupl-1", "licensed under the european union public licence version 1 2"),
    ("proprietary", "all rights reserved"),
]

# Identifiers of the SPDX list, by label.
SPDX = {
    "mit": ["MIT"], "apache-2": ["Apache-2.0"], "gpl-3": ["GPL-3.0-only", "GPL-3.0-or-later"], "gpl-2": ["GPL-2.0-only", "GPL-2.0-or-later"], "agpl-3": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "mpl-2": ["MPL-2.0"], "epl-2": ["EPL-2.0"], "bsl-1": ["BSL-1.0"], "zlib": ["Zlib"], "isc": ["ISC"],
    "unlicense": ["Unlicense"], "cc0-1": ["CC0-1.0"], "wtfpl": ["WTFPL"], "ofl-1": ["OFL-1.1"], "eupl-1": ["EUPL-1.2"],
}

# Parts of the Creative Commons licences' names.
COMMONS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
COMMONS_KINDS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]

# Whole texts, without their titles and holders.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
notice may not be removed or altered from any source distribution."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY
DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""

WHOLE = [("mit", MIT), ("bsd", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"), ("bsd", f"{BSD_CONDITIONS} {BSD_NAMES} {BSD_DISCLAIMER}"), ("isc", ISC), ("zlib", ZLIB), ("bsl-1", BOOST), ("unlicense", UNLICENSE)]


def commons() -> list[tuple[str, str]]:
    """Notices and SPDX lines of each Creative Commons licence, by its parts."""
    out = []
    for kind in COMMONS_KINDS:
        label, whole = f"cc-{kind.replace(' ', '-')}", " ".join(COMMONS[k] for k in kind.split())
        out += [(label, f"licensed under cc {kind} 4 0"), (label, f"creative commons {whole} 4 0 international license"), (label, f"spdx license identifier cc {kind} 4 0")]
        if " " in kind:  # "cc by" alone is the beginning of any of them
            out.append((label, f"cc {kind}"))
    return out


def templates() -> list[tuple[str, str]]:
    """All templates: notices, SPDX lines and whole texts."""
    spdx = [(label, words(f"SPDX-License-Identifier: {x}")) for label, own in SPDX.items() for x in own]
    return list(dict.fromkeys(itertools.chain(NOTICES, commons(), spdx, ((label, words(text)) for label, text in WHOLE))))
