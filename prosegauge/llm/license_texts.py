"""License templates: the wording of public licenses and of their customary notices, with markup for what may differ.

<<opt>>...<</opt>> may be left out, <<var:n>> stands for any run of up to n words,
a|b for either word. Case, punctuation and line breaks don't matter.

Whole texts: mit, bsd-2-clause, bsd-3-clause, isc, unlicense, zlib, 0bsd. The
other labels stand for notices (the words by which a work names its license),
since their licenses are too long to be copied into a work: a text that is
labelled so refers to the license.
"""

from __future__ import annotations

_WARRANTY_MIT = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the <<opt>>authors or<</opt>> copyright holders <<opt>>or <<var:6>><</opt>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
    "arising from out of or in connection with the software or the use or other dealings in the software"
)
_REDISTRIBUTION = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_TWO = (
    "<<opt>>1|a<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<opt>>2|b<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_THREE = "<<opt>>3|c<</opt>> neither the name of <<var:12>> nor the names of its|their contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_WARRANTY = (
    "this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    "the software is provided as is and the author|authors disclaims|disclaim all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author|authors be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)


def _gnu(name: str, version: str) -> list[str]:
    """Notices that name a GNU license and a version."""
    works = f"<<opt>>this <<var:3>> is<</opt>> <<opt>>licensed|released|distributed<</opt>> under <<opt>>the terms of<</opt>> the gnu {name} <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> version {version}"
    free = f"free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation <<opt>>either<</opt>> version {version} of the license <<opt>>or at your option any later version<</opt>>"
    return [works, free]


def _cc(code: str, words: str) -> list[str]:
    """Notices that name a Creative Commons license of version 4.0."""
    return [
        f"<<opt>>this <<var:3>> is<</opt>> licensed under <<opt>>a|the<</opt>> cc {code} 4.0",
        f"licensed under <<opt>>a|the<</opt>> creative commons {words} 4.0 <<opt>>international<</opt>> <<opt>>public<</opt>> license",
    ]


#: Templates by label.
TEMPLATES: dict[str, list[str]] = {
    "0bsd": [f"{_ISC} {_ISC_WARRANTY}"],
    "agpl-3.0": _gnu("affero general public license", "3"),
    "apache-2.0": [
        "<<opt>>this <<var:3>> is<</opt>> licensed under the apache license <<opt>>version<</opt>> 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at <<opt>>http|https<</opt>> www apache org licenses license 2 0 "
        "<<opt>>unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied<</opt>>",
    ],
    "bsd-2-clause": [f"{_REDISTRIBUTION} {_BSD_TWO} {_BSD_WARRANTY}"],
    "bsd-3-clause": [f"{_REDISTRIBUTION} {_BSD_TWO} {_BSD_THREE} {_BSD_WARRANTY}"],
    "bsd-notice": [_REDISTRIBUTION],
    "cc-by-4.0": _cc("by", "attribution"),
    "cc-by-sa-4.0": _cc("by sa", "attribution sharealike"),
    "cc-by-nc-4.0": _cc("by nc", "attribution noncommercial"),
    "cc-by-nd-4.0": _cc("by nd", "attribution noderivatives"),
    "cc0-1.0": ["cc0 1.0 <<opt>>universal<</opt>>", "to the extent possible under law <<var:8>> has waived all copyright and related or neighboring rights to"],
    "gpl-2.0": _gnu("general public license", "2"),
    "gpl-3.0": _gnu("general public license", "3"),
    "isc": [f"{_ISC} provided that the above copyright notice and this permission notice appear in all copies {_ISC_WARRANTY}"],
    "isc-notice": [f"{_ISC} provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl-2.1": _gnu("lesser general public license", "2.1"),
    "lgpl-3.0": _gnu("lesser general public license", "3"),
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        f"subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software {_WARRANTY_MIT}",
    ],
    "mit-notice": [
        "<<opt>>released|licensed|distributed|available<</opt>> under <<opt>>the terms of<</opt>> the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v <<opt>>version<</opt>> 2.0 "
        "<<opt>>if a copy of the mpl was not distributed with this file you can obtain one at <<opt>>http|https<</opt>> <<opt>>www<</opt>> mozilla org mpl 2 0<</opt>>",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the author|authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "<<opt>>1<</opt>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "<<opt>>2<</opt>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "<<opt>>3<</opt>> this notice may not be removed or altered from any source distribution",
    ],
}
