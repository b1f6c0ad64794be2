"""Licence scans by sentence rules, DataFrame functions only.

A text is cut into sentences twice: once with every line break as a sentence end,
once as a wrapped notice: without comment marks before its lines (a line of marks
alone is a blank one), with an address on a line of its own as a paragraph, and with
single line breaks as spaces. Sentences are normalised, looked up among known licence
sentences, and the identifiers found are joined to the steps of ordered rules: a rule
fits if its identifiers occur in its order, others between them allowed, which one
pass over the steps met shows. The first rule that fits names the document's licence;
all that fit are reported.

Texts without any of the anchor words can not hold a known sentence (each known
sentence has one, which is checked when the table is made) and are passed over.

Defined results: null and empty texts, and texts without known sentences, give no
row; rows of equal id and text give one row; a text with known sentences that no
rule fits gets a null licence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, require, written

# Sentences of public licences and usual one-line notices, by identifier.
SENTENCES = {
    "mit-line": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Distributed under the MIT License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                  "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
                  "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                  "furnished to do so, subject to the following conditions:"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
              "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "apache-line": ["Licensed under the Apache License, Version 2.0.",
                    "Licensed under the Apache License, Version 2.0 (the \"License\");", "This project is licensed under the Apache License 2.0."],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                   "in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                  "from this software without specific prior written permission."],
    "bsd-line": ["Licensed under the BSD License.", "Released under the BSD License."],
    "gpl3-line": ["This work is licensed under the GNU General Public License, version 3.",
                  "Licensed under the GNU General Public License v3.0."],
    "gpl2-line": ["This work is licensed under the GNU General Public License, version 2."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "mpl-line": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
                  "that the above copyright notice and this permission notice appear in all copies."],
    "cc-by-nc-line": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "cc-by-sa-line": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "cc-by-line": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "cc-by-nd-line": ["Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0."],
    "cc0-line": ["Licensed under CC0 1.0.", "This work is licensed under CC0 1.0.", "This work is licensed under CC0 1.0 Universal."],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "version-2-or-later": ["either version 2 of the License, or (at your option) any later version."],
    "version-2.1-or-later": ["either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-line": ["Licensed under the GNU Lesser General Public License.", "Licensed under the LGPL License."],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
                  "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "epl-line": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
                 "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
                   "redistribute it freely, subject to the following restrictions:"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "boost-line": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "mit0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                   "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
                   "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
                      "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "x11-names": ["Except as contained in this notice, the name of the copyright holder shall not be used in advertising or otherwise to promote the sale, "
                  "use or other dealings in this Software without prior written authorization from the copyright holder."],
    "json-good": ["The Software shall be used for Good, not Evil."],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-as-is": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
                  "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "bsd2-line": ["Licensed under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."],
    "bsd3-line": ["Licensed under the BSD 3-Clause License.", "Licensed under the New BSD License.",
                  "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "apache-obtain": ["You may obtain a copy of the License at"],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "apache-asf": ["Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."],
    "apache-llvm": ["Part of the LLVM Project, under the Apache License v2.0 with LLVM Exceptions."],
    "gpl-line": ["Licensed under the GNU General Public License.", "Released under the GNU General Public License.", "Licensed under the GPL License."],
    "gpl2-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "version-2": ["version 2 of the License."],
    "version-3-or-later": ["either version 3 of the License, or (at your option) any later version."],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program.",
                     "You should have received a copy of the GNU General Public License along with this program;"],
    "gpl-warranty": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                  "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                  "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                  "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl21-line": ["Licensed under the GNU Lesser General Public License v2.1.", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "lgpl3-line": ["Licensed under the GNU Lesser General Public License v3.0.", "Licensed under the GNU Lesser General Public License, version 3."],
    "agpl-line": ["Licensed under the GNU Affero General Public License.", "Licensed under the GNU Affero General Public License v3.0.", "Licensed under the AGPL-3.0 License."],
    "gfdl-terms": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 "
                   "or any later version published by the Free Software Foundation;"],
    "mpl2-line": ["Licensed under the Mozilla Public License 2.0.", "This project is licensed under the Mozilla Public License 2.0."],
    "mpl11-line": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");"],
    "cddl-line": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
                  "Licensed under the Common Development and Distribution License."],
    "epl1-line": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"],
    "eupl-line": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL "
                  "(the \"Licence\");", "Licensed under the EUPL-1.2 License."],
    "artistic-line": ["This is free software, licensed under the Artistic License 2.0.", "Licensed under the Artistic License 2.0."],
    "postgresql-line": ["This software is released under the PostgreSQL License.", "Licensed under the PostgreSQL License."],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a "
                         "written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs "
                         "appear in all copies."],
    "hpnd-grant": ["Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee, "
                   "provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in "
                   "supporting documentation."],
    "openssl-line": ["This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit."],
    "psf-line": ["Licensed to PSF under a Contributor Agreement.", "Licensed under the Python Software Foundation License."],
    "php-line": ["This source file is subject to version 3.01 of the PHP license,", "Licensed under the PHP License, version 3.01."],
    "isc-line": ["Licensed under the ISC License.", "Released under the ISC License."],
    "zlib-line": ["Licensed under the zlib License.", "Released under the zlib/libpng License."],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-origin": ["The origin of this software must not be misrepresented;"],
    "zlib-altered": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                    "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and "
                    "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "ncsa-line": ["Licensed under the University of Illinois/NCSA Open Source License.", "This file is distributed under the University of Illinois Open Source License."],
    "mulan-terms": ["You can use this software according to the terms and conditions of the Mulan PSL v2."],
    "ofl-line": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the SIL Open Font License 1.1."],
    "ms-pl-line": ["Licensed under the Microsoft Public License.", "Licensed under the MS-PL License."],
    "cecill-line": ["This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software."],
    "w3c-line": ["This work is distributed under the W3C Software License", "This work is distributed under the W3C Software and Document License"],
    "wtfpl-line": ["Licensed under the WTFPL License.", "Licensed under the WTFPL."],
    "vim-line": ["Distributed under the Vim License.", "Licensed under the Vim License."],
    "ruby-line": ["Licensed under the Ruby License.", "Distributed under the Ruby License."],
    "upl-line": ["Licensed under the Universal Permissive License v 1.0", "Licensed under the Universal Permissive License 1.0."],
    "blueoak-line": ["Licensed under the Blue Oak Model License 1.0.0."],
    "unicode-title": ["UNICODE LICENSE V3"],
    "busl-title": ["Business Source License 1.1", "Use of this software is governed by the Business Source License 1.1."],
    "sspl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the Server Side Public License, version 1, as published by MongoDB, Inc."],
    "elastic-line": ["Licensed under the Elastic License 2.0.", "Licensed under the Elastic License 2.0;"],
    "commons-clause": ["The Software is provided to you by the Licensor under the License, as defined below, subject to the following condition."],
    "odbl-line": ["This database is made available under the Open Database License", "Licensed under the Open Database License."],
    "odc-by-line": ["This database is made available under the Open Data Commons Attribution License"],
    "pddl-line": ["Licensed under the Open Data Commons Public Domain Dedication and License."],
    "cc-by-3-line": ["This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "cc-by-sa-3-line": ["This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "cc-by-full": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-full": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nd-full": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-full": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nc-sa-full": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nc-nd-full": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "cc0-dedication": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "unlicense-line": ["Licensed under the Unlicense.", "Released under the Unlicense."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                         "binary, for any purpose, commercial or non-commercial, and by any means."],
    "proprietary": ["This software is proprietary and confidential."],
    "reserved": ["All rights reserved."],
}
# Rules in order; the most specific come first.
RULES = [
    ("JSON", ["mit-grant", "mit-condition", "json-good"]),
    ("X11", ["mit-grant", "mit-condition", "as-is", "x11-names"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant"]),
    ("MIT-0", ["mit0-grant"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-1-Clause", ["bsd-grant", "bsd-source", "bsd-as-is"]),
    ("Apache-2.0 WITH LLVM-exception", ["apache-llvm"]),
    ("Apache-2.0", ["apache-line", "apache-comply", "apache-basis"]),
    ("Apache-2.0", ["apache-asf", "apache-comply", "apache-basis"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("LGPL-3.0-or-later", ["lgpl-free"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "version-2.1-or-later"]),
    ("LGPL-2.0-or-later", ["lgpl-terms", "version-2-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "version-3-or-later"]),
    ("GPL-2.0-or-later", ["gpl-terms", "version-2-or-later"]),
    ("GPL-3.0-or-later", ["gpl-terms", "version-3-or-later"]),
    ("GPL-2.0-only", ["gpl-terms", "version-2"]),
    ("GPL-2.0-only", ["gpl2-terms"]),
    ("GFDL-1.3-or-later", ["gfdl-terms"]),
    ("SSPL-1.0", ["sspl-free"]),
    ("Zlib", ["zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered"]),
    ("Zlib", ["zlib-grant"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("HPND-sell-variant", ["hpnd-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-line"]),
    ("EPL-2.0", ["epl-line"]),
    ("EPL-1.0", ["epl1-line"]),
    ("EUPL-1.2", ["eupl-line"]),
    ("CDDL-1.0", ["cddl-line"]),
    ("MPL-1.1", ["mpl11-line"]),
    ("MPL-2.0", ["mpl-line"]),
    ("MPL-2.0", ["mpl2-line"]),
    ("AGPL-3.0", ["agpl-line"]),
    ("LGPL-2.1", ["lgpl21-line"]),
    ("LGPL-3.0", ["lgpl3-line"]),
    ("LGPL", ["lgpl-line"]),
    ("GPL-3.0", ["gpl3-line"]),
    ("GPL-2.0", ["gpl2-line"]),
    ("GPL", ["gpl-line"]),
    ("Apache-2.0", ["apache-line"]),
    ("MIT", ["mit-line"]),
    ("BSD-2-Clause", ["bsd2-line"]),
    ("BSD-3-Clause", ["bsd3-line"]),
    ("BSD", ["bsd-line"]),
    *[(name, [line]) for name, line in [
        ("Artistic-2.0", "artistic-line"), ("PostgreSQL", "postgresql-line"), ("OpenSSL", "openssl-line"), ("PSF-2.0", "psf-line"), ("PHP-3.01", "php-line"), ("ISC", "isc-line"),
        ("Zlib", "zlib-line"), ("NCSA", "ncsa-line"), ("MulanPSL-2.0", "mulan-terms"), ("OFL-1.1", "ofl-line"), ("MS-PL", "ms-pl-line"), ("CECILL-2.1", "cecill-line"), ("W3C", "w3c-line"),
        ("WTFPL", "wtfpl-line"), ("Vim", "vim-line"), ("Ruby", "ruby-line"), ("UPL-1.0", "upl-line"), ("BlueOak-1.0.0", "blueoak-line"), ("Unicode-3.0", "unicode-title"),
        ("BUSL-1.1", "busl-title"), ("Elastic-2.0", "elastic-line"), ("Commons-Clause", "commons-clause"), ("ODbL-1.0", "odbl-line"), ("ODC-By-1.0", "odc-by-line"), ("PDDL-1.0", "pddl-line"),
        ("CC-BY-NC-ND-4.0", "cc-by-nc-nd-full"), ("CC-BY-NC-SA-4.0", "cc-by-nc-sa-full"), ("CC-BY-NC-4.0", "cc-by-nc-full"), ("CC-BY-SA-4.0", "cc-by-sa-full"), ("CC-BY-ND-4.0", "cc-by-nd-full"),
        ("CC-BY-4.0", "cc-by-full"), ("CC-BY-SA-3.0", "cc-by-sa-3-line"), ("CC-BY-3.0", "cc-by-3-line"), ("CC-BY-NC-4.0", "cc-by-nc-line"), ("CC-BY-SA-4.0", "cc-by-sa-line"),
        ("CC-BY-ND-4.0", "cc-by-nd-line"), ("CC-BY-4.0", "cc-by-line"), ("CC0-1.0", "cc0-dedication"), ("CC0-1.0", "cc0-line"), ("Unlicense", "unlicense"), ("Unlicense", "unlicense-anyone"),
        ("Unlicense", "unlicense-line"), ("proprietary", "proprietary"), ("all-rights-reserved", "reserved")]],
]
# Identifiers of the public licence list that a tag line may name.
SPDX_IDS = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "MPL-2.0", "EPL-2.0", "Unlicense",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0",
    "MIT-0", "X11", "JSON", "BSD-1-Clause", "BSD-4-Clause", "Artistic-2.0", "AFL-3.0", "APSL-2.0", "BlueOak-1.0.0", "BUSL-1.1", "CC-BY-3.0", "CC-BY-SA-3.0",
    "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CDDL-1.0", "CECILL-2.1", "Elastic-2.0", "EPL-1.0", "EUPL-1.2", "GFDL-1.3-or-later", "GPL-1.0-or-later", "HPND",
    "LGPL-2.0-only", "LGPL-2.0-or-later", "MPL-1.1", "MS-PL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OpenSSL", "PDDL-1.0", "PHP-3.01", "PostgreSQL",
    "PSF-2.0", "Python-2.0", "Ruby", "SSPL-1.0", "Unicode-3.0", "UPL-1.0", "Vim", "W3C", "WTFPL",
]
#: A normalised tag line, and what joins the names in it: each name is looked up for itself.
SPDX, SPDX_JOIN = "spdx license identifier", " (?:or|and) "
#: In such lines "or later" belongs to a name.
OR_LATER = " orlater"
#: Lower-case strings; each known sentence holds one.
ANCHORS = ["licens", "software", "redistribution", "the above copyright notice", "warranty", "rights reserved", "copyright holder", "cc0"]

#: Larger catalogues are joined by a shuffle.
MOST_BROADCAST = 10_000
SENTENCE_END = r"[.!?;]+(?:[\x20\x09-\x0D]+|$)|[\x0A\x0D]+"
#: Comment marks before a line, ends of comments, and an address that stands alone.
_MARKS = r"(^|\x0A)[\x20\x09]*(?:#+|/{2,}|/\*+!?|\*+/?|--+|;+|%+|<!--|dnl |REM )[\x20\x09]*"
_CLOSED = r"\*/|-->"
_ADDRESS = r"(^|\x0A)[\x20\x09]*<?(https?://[^\x20\x09-\x0D]+)[\x20\x09\x0D]*\x0A"
_WRAP = r"([^.!?;:\x20\x09-\x0D])[\x20\x09\x0D]*\x0A[\x20\x09]*([^\x20\x09-\x0D])"


#: How a wrapped notice is read: what is replaced by what, one after the other.
READING = [(r"^#![^\x0A]*", "\n"), (_CLOSED, "\n"), (_MARKS, "$1"), (_ADDRESS, "$1\n$2\n\n"), (_WRAP, "$1 $2"), (_WRAP, "$1 $2")]


def unwrapped(text: Column) -> Column:
    """Paragraphs as lines: without comment marks, addresses apart, single line breaks as spaces."""
    for pattern, by in READING:
        text = F.regexp_replace(text, pattern, by)
    return text


def normal_sentence(c: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(c), r"[^a-z0-9]+", " "))


def _plain(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _spdx_id(name: str) -> str:
    return f"spdx-{name.lower()}"


def known_sentences(catalogue: dict[str, list[str]] = SENTENCES) -> dict[str, str]:
    """Normalised sentence to identifier: the catalogue and the tag line of each listed licence."""
    found = {f"{SPDX} {_plain(n).replace(' or later', OR_LATER)}": _spdx_id(n) for n in SPDX_IDS}
    for name, texts in catalogue.items():
        for text in texts:
            if not any(a in text.lower() for a in ANCHORS):
                raise ValueError(f"no anchor in: {text}")
            parts = [p for p in map(_plain, re.split(SENTENCE_END, text)) if p]
            if len(parts) != 1 or found.setdefault(parts[0], name) != name:
                raise ValueError(f"not one sentence of one identifier: {text}")
    return found


def all_rules(rules: list[tuple[str, list[str]]] = RULES) -> list[tuple[str, list[str]]]:
    """The ordered rules, and behind them one for the tag line of each listed licence."""
    return [*rules, *((n, [_spdx_id(n)]) for n in SPDX_IDS)]


def _catalogue(spark: SparkSession, catalogue: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame(list(known_sentences(catalogue).items()), "sentence string, sentence_id string")


def licence_sentences(docs: DataFrame, catalogue: dict[str, list[str]] = SENTENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text (hash), reading, pos, sentence_id of every known sentence."""
    anchored = docs.where(F.lower(text_col).rlike("|".join(a.replace(" ", r"\s+") for a in ANCHORS)))
    readings = F.array(F.struct(F.lit(0).alias("reading"), F.col(text_col).alias("body")), F.struct(F.lit(1).alias("reading"), unwrapped(F.col(text_col)).alias("body")))
    cut = (
        anchored.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.explode(readings).alias("r"))
        .select("_id", "_text", "r.reading", F.posexplode(F.split("r.body", SENTENCE_END)).alias("pos", "raw"))
        .select("_id", "_text", "reading", "pos", normal_sentence(F.col("raw")).alias("s"))
    )
    # each name of a tag line such as "MIT OR Apache-2.0" is a sentence of its own
    names = F.transform(F.split(F.replace(F.expr(f"substring(s, {len(SPDX) + 2})"), F.lit(" or later"), F.lit(OR_LATER)), SPDX_JOIN), lambda n: F.concat(F.lit(f"{SPDX} "), n))
    cut = cut.select("_id", "_text", "reading", "pos", F.explode(F.when(F.startswith("s", F.lit(f"{SPDX} ")), names).otherwise(F.array("s"))).alias("sentence"))
    known = _catalogue(docs.sparkSession, catalogue)
    small = sum(map(len, catalogue.values())) <= MOST_BROADCAST
    return cut.join(F.broadcast(known) if small else known, "sentence").select("_id", "_text", "reading", "pos", "sentence_id")


def rule_steps(spark: SparkSession, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """rule, step, steps (of the rule), sentence_id."""
    return spark.createDataFrame([(k, j, len(ids), i) for k, (_, ids) in enumerate(rules) for j, i in enumerate(ids)], "rule int, step int, steps int, sentence_id string")


def fitting_rules(found: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """_id, _text, fits: the rules (numbers, ascending) whose identifiers one reading holds in order.

    Only rules that share an identifier with a reading are looked at; the next step of a
    rule is taken at the first place behind the step before.
    """
    steps = rule_steps(found.sparkSession, rules)
    met = found.join(F.broadcast(steps) if len(rules) <= MOST_BROADCAST else steps, "sentence_id")
    places = met.groupBy("_id", "_text", "reading", "rule").agg(F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("at"), F.max("steps").alias("steps"))
    start = F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("n"))
    taken = F.aggregate("at", start, lambda a, x: F.when((x["step"] == a["n"]) & (x["pos"] > a["pos"]), F.struct(x["pos"].alias("pos"), (a["n"] + 1).alias("n"))).otherwise(a))
    return places.where(taken["n"] == F.col("steps")).groupBy("_id", "_text").agg(F.array_sort(F.collect_set("rule")).alias("fits"))


def scan_licences(
    docs: DataFrame, catalogue: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, licence, licences (all that fit, in rule order), n_sentences, sentence_ids."""
    require(docs, id_col, text_col)
    rules = all_rules(rules)
    found = written(licence_sentences(docs, catalogue, id_col, text_col).distinct(), "licence-sentences")  # texts are read once
    by_reading = found.groupBy("_id", "_text", "reading").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence_id"))).alias("at")).withColumn("ids", F.col("at.sentence_id"))
    told = by_reading.groupBy("_id", "_text").agg(F.max_by("ids", F.struct(F.size("ids"), -F.col("reading"))).alias("sentence_ids"))
    fits = fitting_rules(found, rules).select(F.col("_id").alias("f_id"), F.col("_text").alias("f_text"), "fits")
    same = F.col("_id").eqNullSafe(F.col("f_id")) & F.col("_text").eqNullSafe(F.col("f_text"))
    scored = told.join(fits, same, "left").withColumn("fits", F.coalesce("fits", F.array().cast("array<int>")))
    names = F.array(*[F.lit(n) for n, _ in rules])
    licences = F.array_distinct(F.transform("fits", lambda k: F.get(names, k)))
    return scored.select(F.col("_id").alias(id_col), F.get(licences, 0).alias("licence"), licences.alias("licences"),
                         F.size("sentence_ids").cast("long").alias("n_sentences"), "sentence_ids")
