"""Licence templates: headings and notices, whole texts of short licences, and
the openings of the texts of long ones."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Licence, the word by which a page's words are laid against the
#: template's (it stands in the template once), and the wording.
WORDINGS = (
    ("0bsd", "tortious", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages
        whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or
        in connection with the use or performance of this software."""),
    ("agpl-3.0", "redistribute", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("agpl-3.0", "november", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("all-rights-reserved", "reserved", "All rights reserved."),
    ("apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "compliance", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2.0", "definitions", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction,
        and distribution 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1
        through 9 of this document."""),
    ("artistic-2.0", "artistic", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation."),
    ("bsd-2-clause", "redistribution", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("bsd-3-clause", "endorse", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("bsd-3-clause", "governed", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsl-1.0", "organization", """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or
        organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
        distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
        is furnished to do so"""),
    ("bsl-1.0", "accompanying", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("cc-by-4.0", "cc", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "attribution", "Creative Commons Attribution 4.0 International"),
    ("cc-by-nc-4.0", "cc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "attribution", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-nd-4.0", "cc", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd-4.0", "attribution", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("cc-by-sa-4.0", "cc", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "attribution", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("cc0-1.0", "cc0", "CC0 1.0 Universal"),
    ("epl-2.0", "eclipse", "Eclipse Public License - v 2.0"),
    ("eupl-1.2", "eupl", "Licensed under the EUPL, Version 1.2"),
    ("gpl-2.0", "gnu", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "redistribute", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-2.0", "1991", "GNU General Public License Version 2, June 1991"),
    ("gpl-3.0", "gnu", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "redistribute", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-3.0", "june", "GNU General Public License Version 3, 29 June 2007"),
    ("isc", "tortious", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. The software is provided "as is" and the author disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable
        for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an
        action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."""),
    ("lgpl-2.1", "redistribute", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("lgpl-2.1", "february", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("lgpl-3.0", "redistribute", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("lgpl-3.0", "june", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("mit", "mit", "MIT License"),
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "sublicense", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("mpl-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "mozilla", "Mozilla Public License Version 2.0"),
    ("ms-pl", "governs", """This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the
        license, do not use the software."""),
    ("postgresql", "agreement", """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and
        without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs
        appear in all copies."""),
    ("unlicense", "unencumbered", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means."""),
    ("wtfpl", "want", "Do What The Fuck You Want To Public License"),
    ("zlib", "appreciated", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required."""),
)


@dataclass(frozen=True)
class Template:
    license: str
    key: str
    words: tuple[str, ...]

    @property
    def place(self) -> int:
        """The key's place among the words, from 0."""
        return self.words.index(self.key)


def plain_words(text: str) -> tuple[str, ...]:
    return tuple(re.findall("[a-z0-9]+", text.lower()))


def _identifier(license: str) -> Template:
    """The line by which source files name a licence."""
    own = plain_words(license)
    return Template(license, own[0], (*plain_words("SPDX-License-Identifier"), *own))


#: All templates; a template's number is its place.
TEMPLATES = tuple(Template(name, key, plain_words(text)) for name, key, text in WORDINGS) + tuple(
    _identifier(name) for name in dict.fromkeys(name for name, *_ in WORDINGS) if name != "all-rights-reserved"
)
