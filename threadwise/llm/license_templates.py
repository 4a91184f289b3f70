"""Licence wordings as template markup. Public licence texts and notices.

``<<beginOptional>>`` and ``<<endOptional>>`` enclose wording that may be left out, ``<<var;...>>``
stands for any words, as many as its ``words`` say. ``a|b`` is either word. Everything else is
mandatory. A template starts and ends with mandatory wording: titles and copyright lines around a
licence are free anyway.
"""

from __future__ import annotations

# label, weight of an accepted text (whole licence or notice 1, a mere statement less), markup
TEMPLATES: tuple[tuple[str, float, str], ...] = (
    ("mit", 1.0, """
Permission is hereby granted, free of charge, to any person obtaining a copy of
<<var;name="software";words="1-12">> and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>>
shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";words="1-20">> BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE
"""),
    ("isc", 1.0, """
Permission to use, copy, modify, and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in
all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holders";words="1-20">> DISCLAIMS|DISCLAIM ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL <<var;name="liable";words="1-20">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE
"""),
    ("bsd-2-clause", 1.0, """
Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
<<var;name="bullet";words="0-1">> Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.
<<var;name="bullet";words="0-1">> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY <<var;name="holders";words="1-20">> "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED
"""),
    ("bsd-3-clause", 1.0, """
Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
<<var;name="bullet";words="0-1">> Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.
<<var;name="bullet";words="0-1">> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
<<var;name="bullet";words="0-1">> Neither the name of <<var;name="organisation";words="1-20">> nor the names of
<<beginOptional>>its|the<<endOptional>> contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY <<var;name="holders";words="1-20">> "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED
"""),
    ("zlib", 1.0, """
This software is provided 'as-is', without any express or implied warranty. In no event will
<<var;name="authors";words="1-12">> be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<var;name="bullet";words="0-1">> The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an acknowledgment|acknowledgement
in the product documentation would be appreciated but is not required.
<<var;name="bullet";words="0-1">> Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
<<var;name="bullet";words="0-1">> This notice may not be removed or altered from any source distribution
"""),
    ("apache-2", 1.0, """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use
<<var;name="work";words="1-6">> except in compliance with the License. You may obtain a copy of the License at
<<var;name="address";words="1-12">>
Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License
"""),
    ("gpl-2", 1.0, """
is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation;
<<beginOptional>>either<<endOptional>> version 2 of the License
"""),
    ("gpl-3", 1.0, """
is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation,
<<beginOptional>>either<<endOptional>> version 3 of the License
"""),
    ("lgpl-2-1", 1.0, """
is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation;
<<beginOptional>>either<<endOptional>> version 2.1 of the License
"""),
    ("lgpl-3", 1.0, """
is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation,
<<beginOptional>>either<<endOptional>> version 3 of the License
"""),
    ("agpl-3", 1.0, """
is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation,
<<beginOptional>>either<<endOptional>> version 3 of the License
"""),
    ("mpl-2", 1.0, """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at
<<beginOptional>>http|https<<endOptional>> <<beginOptional>>www<<endOptional>> mozilla.org/MPL/2.0
"""),
    ("unlicense", 1.0, """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means
"""),
    ("boost-1", 1.0, """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce,
display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software
"""),
    # Statements that name a licence.
    ("mit", 0.8, """
licensed|released|distributed|available|provided|published|covered under the
<<beginOptional>>terms of the<<endOptional>> MIT <<beginOptional>>X11|Expat<<endOptional>> license|licence
"""),
    ("apache-2", 0.8, """
licensed|released|distributed|available|provided|published|covered under the
<<beginOptional>>terms of the<<endOptional>> Apache <<beginOptional>>Software|Public<<endOptional>>
license|licence <<beginOptional>>version|v<<endOptional>> 2
"""),
    ("gpl-2", 0.8, """
licensed|released|distributed|available|provided|published|covered under the
<<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public
license|licence <<beginOptional>>GPL<<endOptional>> <<beginOptional>>version|v<<endOptional>> 2|v2
"""),
    ("gpl-3", 0.8, """
licensed|released|distributed|available|provided|published|covered under the
<<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public
license|licence <<beginOptional>>GPL<<endOptional>> <<beginOptional>>version|v<<endOptional>> 3|v3
"""),
    ("lgpl-3", 0.8, """
licensed|released|distributed|available|provided|published|covered under the
<<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> Lesser General Public
license|licence <<beginOptional>>LGPL<<endOptional>> <<beginOptional>>version|v<<endOptional>> 3|v3
"""),
    ("agpl-3", 0.8, """
licensed|released|distributed|available|provided|published|covered under the
<<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> Affero General Public
license|licence <<beginOptional>>AGPL<<endOptional>> <<beginOptional>>version|v<<endOptional>> 3|v3
"""),
    ("mpl-2", 0.8, """
licensed|released|distributed|available|provided|published|covered under the
<<beginOptional>>terms of the<<endOptional>> Mozilla Public license|licence
<<beginOptional>>version|v<<endOptional>> 2
"""),
    ("bsd", 0.8, """
licensed|released|distributed|available|provided|published|covered under the|a
<<beginOptional>>terms of the<<endOptional>>
<<beginOptional>>2|3|4|two|three|four|new|modified|simplified|revised<<beginOptional>>clause<<endOptional>><<endOptional>>
BSD <<beginOptional>>2|3|4|style<<beginOptional>>clause<<endOptional>><<endOptional>> license|licence
"""),
    ("cc-by", 0.8, """
licensed|released|distributed|available|provided|published|covered under
<<beginOptional>>a|the<<endOptional>>
Creative Commons Attribution <<beginOptional>>4|3|2 0<<endOptional>>
<<beginOptional>>International|Unported|Generic<<endOptional>> license|licence
"""),
    ("cc-by-sa", 0.8, """
licensed|released|distributed|available|provided|published|covered under
<<beginOptional>>a|the<<endOptional>>
Creative Commons Attribution Share|ShareAlike
"""),
    ("cc-by-nc", 0.8, """
licensed|released|distributed|available|provided|published|covered under
<<beginOptional>>a|the<<endOptional>> CC BY NC
"""),
    ("cc-by-nc", 0.8, """
licensed|released|distributed|available|provided|published|covered under
<<beginOptional>>a|the<<endOptional>>
Creative Commons Attribution Non|NonCommercial
"""),
    ("cc-by-nc-sa", 0.8, "CC BY NC SA"),
    ("cc-by-nc-nd", 0.8, "CC BY NC ND"),
    ("cc-by-sa", 0.8, "CC BY SA"),
    ("cc-by-nd", 0.8, "CC BY ND"),
    ("cc0", 0.8, """
waived all copyright and related or neighboring|neighbouring rights to
"""),
)

# Phrases of the contract: words that stand consecutively, and their label.
PHRASES: tuple[tuple[str, str], ...] = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
PHRASE_WEIGHT = 0.5
