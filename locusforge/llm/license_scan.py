"""License detection by ordered signature rules.

Rules are regular expressions over a text's words (lower case, joined by single spaces), in order of priority. A rule runs
only on texts that hold one of its keywords. Of detections that overlap, one inside another of at least its priority, or
of equal extent and lower priority, is suppressed. The base phrases are rules like the others, but never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.common import quoted, slices

#: Phrases whose every place counts, with the label that each gives.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Everything but ASCII letters and digits, and whatever is not ASCII, parts words.
_PARTS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A))
_TO_SPACE = bytes.maketrans(_PARTS, b" " * len(_PARTS))


_VERSION_ENDS = frozenset(bytes([b]) for b in b"0123456789v")


@dataclass(frozen=True)
class Rule:
    """``keywords``: words of which a text must hold one, or one with a version joined to it. ``confidence``: how sure a lone detection is, 0 to 1."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float


@dataclass(frozen=True)
class Detection:
    label: str
    start: int
    end: int
    priority: int
    confidence: float


# Names as they stand in notices, as patterns over words. Fixed texts of public licenses.
_FAMILIES = [
    # label, name pattern, keyword, versions that are told apart
    ("gpl", r"(?:gnu )?general public licen[cs]e|gnu gpl|gplv?", "gpl general", ("1", "2", "3")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl|lgplv?", "lgpl lesser library", ("2", "2 1", "3")),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e|gnu agpl|agplv?", "agpl affero", ("1", "3")),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e|gfdl", "gfdl documentation", ("1 1", "1 2", "1 3")),
    ("apache", r"apache(?: software)? licen[cs]e|asl", "apache asl", ("1", "1 1", "2", "2 0")),
    ("mpl", r"mozilla public licen[cs]e|mpl", "mozilla mpl", ("1", "1 1", "2", "2 0")),
    ("epl", r"eclipse public licen[cs]e|epl", "eclipse epl", ("1", "1 0", "2", "2 0")),
    ("cddl", r"common development and distribution licen[cs]e|cddl", "cddl development", ("1 0", "1 1")),
    ("cpl", r"common public licen[cs]e|cpl", "cpl common", ("1 0",)),
    ("eupl", r"european union public licen[cs]e|eupl", "eupl european", ("1 0", "1 1", "1 2")),
    ("cecill", r"cecill(?: [bc])?", "cecill", ("1", "2", "2 1")),
    ("osl", r"open software licen[cs]e|osl", "osl software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", r"academic free licen[cs]e|afl", "afl academic", ("1 1", "2 0", "2 1", "3 0")),
    ("artistic", r"artistic licen[cs]e", "artistic", ("1", "1 0", "2", "2 0")),
    ("bsl", r"boost software licen[cs]e", "boost", ("1", "1 0")),
    ("ofl", r"(?:sil )?open font licen[cs]e|ofl", "ofl font", ("1 0", "1 1")),
    ("odbl", r"open database licen[cs]e|odbl", "odbl database", ("1 0",)),
    ("zpl", r"zope public licen[cs]e|zpl", "zope zpl", ("2 0", "2 1")),
    ("ms-pl", r"microsoft public licen[cs]e|ms pl", "microsoft ms", ()),
    ("ms-rl", r"microsoft reciprocal licen[cs]e|ms rl", "microsoft ms", ()),
    ("sspl", r"server side public licen[cs]e|sspl", "sspl server", ("1",)),
    ("busl", r"business source licen[cs]e|busl", "busl business", ("1 1",)),
    ("python", r"(?:python software foundation|psf) licen[cs]e", "python psf", ("2",)),
    ("php", r"php licen[cs]e", "php", ("3 0", "3 01")),
    ("ruby", r"ruby licen[cs]e", "ruby", ()),
    ("perl", r"same terms as perl(?: itself)?", "perl", ()),
    ("openssl", r"openssl(?: toolkit)? licen[cs]e", "openssl", ()),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", ()),
    ("isc", r"isc licen[cs]e", "isc", ()),
    ("mit", r"mit(?: x11)? licen[cs]e|expat licen[cs]e", "mit expat", ()),
    ("x11", r"x11 licen[cs]e", "x11", ()),
    ("bsd-2-clause", r"(?:simplified|2 clause|two clause) bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?", "bsd", ()),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?", "bsd", ()),
    ("bsd", r"bsd(?: style)? licen[cs]e", "bsd", ()),
    ("unlicense", r"unlicense", "unlicense", ()),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[cs]e", "wtfpl fuck", ("2",)),
    ("cc0", r"cc0|creative commons zero", "cc0 zero", ("1", "1 0")),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?derivatives|no ?derivs)", "cc creative", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)", "cc creative", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)", "cc creative", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nd|no ?derivatives|no ?derivs)", "cc creative", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)", "cc creative", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", r"cc by|creative commons attribution", "cc creative", ("1 0", "2 0", "2 5", "3 0", "4 0")),
]

# Sentences of license texts and of notices that name no license.
_SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby", 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "substantial", 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee", 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions", 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", 0.9),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse", "contributors", 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising", 0.9),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute", 0.98),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "redistribute", 0.98),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", "redistribute", 0.98),
    ("gpl-or-later", r"either version \d(?: of the licen[cs]e)? or at your option any later version", "option", 0.9),
    ("apache", r"you may not use this file except in compliance with the licen[cs]e", "compliance", 0.8),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e", "applicable", 0.8),
    ("mpl", r"this source code form is subject to the terms of the mozilla public licen[cs]e", "mozilla", 0.98),
    ("bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "organization", 0.95),
    ("zlib", r"altered source versions must be plainly marked as such", "plainly", 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 0.98),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "verbatim", 0.9),
    ("public-domain", r"(?:released|placed|dedicated)(?: \w+)? (?:in|into|to) the public domain", "domain", 0.8),
    ("public-domain", r"no rights reserved", "reserved", 0.8),
    ("reserved", r"all rights reserved", "reserved", 0.6),
    ("reserved", r"some rights reserved", "reserved", 0.5),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "proprietary", 0.8),
    ("proprietary", r"unauthorized (?:copying|reproduction|distribution|use)(?: or \w+)? (?:of|is)", "unauthorized", 0.7),
    ("proprietary", r"may not be (?:copied|reproduced|distributed)(?: \w+){0,6} without (?:the )?(?:prior |express |written )+(?:consent|permission)", "without", 0.7),
    ("proprietary", r"for internal use only", "internal", 0.6),
    ("no-warranty", r"without (?:any )?warranty of any kind", "warranty", 0.4),
    ("no-warranty", r"provided as is without", "provided", 0.4),
    ("no-warranty", r"merchantability or fitness for a particular purpose", "merchantability", 0.4),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 0.4),
    ("copyright", r"copyright (?:c )?by", "copyright", 0.3),
    ("mit", r"to deal in the software without restriction including without limitation the rights", "restriction", 0.95),
    ("mit", r"subject to the following conditions the above copyright notice and this permission notice", "permission", 0.9),
    ("mit", r"mit licen[cs]ed", "licensed licenced", 0.8),
    ("mit-0", r"to deal in the software without restriction .{0,200}and to permit persons to whom the software is furnished to do so the software is provided", "furnished", 0.95),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used", "consortium", 0.95),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "fee", 0.9),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "fee", 0.95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 0.95),
    ("bsd-3-clause", r"the name of the author may not be used to endorse or promote products", "endorse", 0.85),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted", "patent", 0.95),
    ("bsd-4-clause", r"this product includes software developed by", "developed", 0.7),
    ("gpl", r"gnu general public licen[cs]e as published by the free software foundation", "foundation", 0.98),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e", "received", 0.98),
    ("gpl", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom", "freedom", 0.95),
    ("gpl", r"a copyleft licen[cs]e for software and other kinds of works", "copyleft", 0.8),
    ("gpl-2", r"version 2 june 1991", "june", 0.9),
    ("gpl-3", r"version 3 29 june 2007", "june", 0.9),
    ("gpl-2-only", r"version 2 (?:of the licen[cs]e )?only", "only", 0.6),
    ("gpl-or-later", r"gpl ?v?\d(?: \d)?(?: or later| plus)", "later plus", 0.85),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "received", 0.98),
    ("lgpl", r"this library is free software you can redistribute it", "library", 0.9),
    ("lgpl-2.1", r"version 2 1 february 1999", "february", 0.9),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[cs]e", "received", 0.98),
    ("agpl-3", r"version 3 19 november 2007", "november", 0.9),
    ("agpl", r"remote network interaction use with the gnu general public licen[cs]e", "network", 0.95),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "document", 0.98),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant", 0.95),
    ("gcc-exception", r"gcc runtime library exception", "runtime", 0.95),
    ("classpath-exception", r"classpath exception|linking this library statically or dynamically with other modules is making a combined work", "classpath statically", 0.9),
    ("llvm-exception", r"llvm exceptions? to the apache", "llvm", 0.95),
    ("apache-2.0", r"apache licen[cs]e version 2 0 january 2004", "january", 0.98),
    ("apache-2.0", r"www apache org licen[cs]es licen[cs]e 2 0", "apache", 0.95),
    ("apache", r"this product includes software developed (?:at|by) the apache software foundation", "apache", 0.85),
    ("apache", r"grants? to you a perpetual worldwide non ?exclusive no charge royalty free irrevocable", "irrevocable", 0.8),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "mozilla", 0.98),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", "obtain", 0.95),
    ("mpl-tri", r"alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e", "alternatively", 0.9),
    ("npl", r"netscape public licen[cs]e", "netscape", 0.9),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "accompanying", 0.98),
    ("edl", r"eclipse distribution licen[cs]e", "eclipse", 0.9),
    ("cpl", r"the accompanying program is provided under the terms of this common public licen[cs]e", "accompanying", 0.95),
    ("ipl", r"ibm public licen[cs]e", "ibm", 0.9),
    ("apsl", r"apple public source licen[cs]e", "apple", 0.9),
    ("cddl", r"you may not use this file except in compliance with the cddl", "cddl", 0.95),
    ("cpal", r"common public attribution licen[cs]e", "attribution", 0.9),
    ("eupl", r"licensed under the eupl", "eupl", 0.95),
    ("cecill", r"ce logiciel est r.{1,3}gi par la licence cecill", "logiciel", 0.95),
    ("osl", r"licensed under the open software licen[cs]e", "licensed", 0.95),
    ("afl", r"licensed under the academic free licen[cs]e", "licensed", 0.95),
    ("ecl", r"educational community licen[cs]e", "educational", 0.9),
    ("efl", r"eiffel forum licen[cs]e", "eiffel", 0.9),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "package", 0.95),
    ("perl", r"this (?:library|module|program) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl", "perl", 0.95),
    ("ruby", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", "either", 0.9),
    ("bsl", r"boost org licen[cs]e 1 0 txt|distributed under the boost software licen[cs]e", "boost", 0.95),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented", 0.95),
    ("zlib", r"this notice may not be removed or altered from any source distribution", "altered", 0.85),
    ("libpng", r"the png reference library is supplied as is", "png", 0.95),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg", 0.95),
    ("freetype", r"portions of this software are copyright .{0,40}the freetype project", "freetype", 0.95),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "fee", 0.85),
    ("icu", r"icu licen[cs]e", "icu", 0.9),
    ("unicode", r"unicode inc licen[cs]e agreement|unicode licen[cs]e agreement", "unicode", 0.95),
    ("ncsa", r"university of illinois(?: ncsa)? open source licen[cs]e", "illinois", 0.95),
    ("json", r"the software shall be used for good not evil", "evil", 0.98),
    ("beerware", r"beer ?ware licen[cs]e|if we meet some day and you think this stuff is worth it you can buy me a beer", "beer beerware", 0.95),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", 0.9),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct indirect special incidental", "california", 0.85),
    ("ntp", r"the university of delaware makes no representations about the suitability this software for any purpose", "delaware", 0.95),
    ("hpnd", r"historical permission notice and disclaimer", "historical", 0.95),
    ("w3c", r"w3c software (?:and document )?(?:notice and )?licen[cs]e", "w3c", 0.95),
    ("vim", r"vim licen[cs]e", "vim", 0.9),
    ("tcl", r"tcl tk licen[cs]e|the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation", "tcl authors", 0.9),
    ("sleepycat", r"sleepycat licen[cs]e|sleepycat software", "sleepycat", 0.9),
    ("qpl", r"q public licen[cs]e", "q", 0.9),
    ("lppl", r"latex project public licen[cs]e", "latex", 0.95),
    ("openldap", r"openldap public licen[cs]e", "openldap", 0.95),
    ("openssl", r"this product includes software developed by the openssl project", "openssl", 0.95),
    ("upl", r"universal permissive licen[cs]e", "universal", 0.95),
    ("mulan", r"mulan p(?:ermissive )?s(?:oftware )?l", "mulan", 0.9),
    ("blueoak", r"blue oak model licen[cs]e", "oak", 0.95),
    ("elastic", r"elastic licen[cs]e", "elastic", 0.9),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", "functionality", 0.95),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "licensor", 0.95),
    ("commons-clause", r"commons clause(?: licen[cs]e condition)?", "clause", 0.85),
    ("polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict)(?: licen[cs]e)?", "polyform", 0.95),
    ("prosperity", r"prosperity public licen[cs]e", "prosperity", 0.95),
    ("parity", r"parity public licen[cs]e", "parity", 0.95),
    ("ofl", r"this font software is licensed under the sil open font licen[cs]e", "font", 0.98),
    ("ofl", r"reserved font names?", "font", 0.7),
    ("ubuntu-font", r"ubuntu font licen[cs]e", "ubuntu", 0.95),
    ("odc-by", r"open data commons attribution licen[cs]e", "commons", 0.95),
    ("pddl", r"open data commons public domain dedication(?: and licen[cs]e)?", "commons", 0.95),
    ("odbl", r"made available under the open database licen[cs]e", "database", 0.95),
    ("cdla", r"community data licen[cs]e agreement (?:permissive|sharing)", "community", 0.95),
    ("ogl", r"open government licen[cs]e", "government", 0.95),
    ("etalab", r"licence ouverte", "ouverte", 0.9),
    ("dl-de", r"datenlizenz deutschland", "datenlizenz", 0.95),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?: m| s| plus plus)?(?: licen[cs]e)?", "openrail rail", 0.9),
    ("llama", r"llama \d(?: \d)? community licen[cs]e", "llama", 0.95),
    ("cc", r"creativecommons org licen[cs]es", "creativecommons", 0.8),
    ("cc0", r"creativecommons org publicdomain zero|the person who associated a work with this deed has dedicated the work to the public domain", "creativecommons deed", 0.95),
    ("cc", r"this work is licensed under a creative commons", "creative", 0.8),
    ("cc-by", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made", "credit", 0.9),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e", "remix", 0.95),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "commercial", 0.85),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", "remix", 0.95),
    ("cc-public-domain", r"public domain mark", "mark", 0.8),
    ("public-domain", r"this (?:work|file|code|software|document) is in the public domain", "domain", 0.9),
    ("public-domain", r"to the extent possible under law (?:.{0,80} )?waived all copyright", "waived", 0.95),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "compile", 0.98),
    ("free-use", r"free for (?:personal|private|non ?commercial|educational|academic)(?: and \w+)? use", "free", 0.6),
    ("non-commercial", r"(?:for )?non ?commercial (?:use|purposes) only", "commercial noncommercial", 0.7),
    ("academic", r"for (?:academic|research) (?:use|purposes) only", "academic research", 0.7),
    ("evaluation", r"for evaluation (?:use|purposes) only", "evaluation", 0.7),
    ("eula", r"end user licen[cs]e agreement", "agreement", 0.8),
    ("eula", r"by (?:installing|downloading|using|accessing)(?: or \w+)? (?:this|the) (?:software|product|service) you agree", "agree", 0.7),
    ("proprietary", r"(?:is|are|contains) (?:the )?(?:trade secrets?|confidential information)(?: and property)? of", "confidential secret secrets", 0.7),
    ("proprietary", r"no part of this (?:publication|document|work|book|site|website) may be reproduced", "reproduced", 0.85),
    ("proprietary", r"reproduction (?:in whole or in part )?without (?:written )?permission is prohibited", "prohibited", 0.85),
    ("proprietary", r"do not (?:copy|distribute|redistribute)(?: or \w+)? without permission", "permission", 0.7),
    ("proprietary", r"strictly (?:private|confidential)", "strictly", 0.5),
    ("proprietary", r"licensed material property of", "property", 0.8),
    ("proprietary", r"this software is the (?:confidential and )?proprietary (?:information|property) of", "proprietary", 0.9),
    ("reserved", r"alle rechte vorbehalten", "vorbehalten", 0.7),
    ("reserved", r"tous droits r.{1,3}serv.{1,3}s", "droits", 0.7),
    ("reserved", r"todos los derechos reservados", "derechos", 0.7),
    ("reserved", r"tutti i diritti riservati", "riservati", 0.7),
    ("reserved", r"todos os direitos reservados", "direitos", 0.7),
    ("no-warranty", r"in no event shall the (?:authors?|copyright holders?|regents|licensor)(?: or \w+)* be liable", "liable", 0.4),
    ("no-warranty", r"this program is distributed in the hope that it will be useful but without any warranty", "hope", 0.6),
    ("no-warranty", r"use at your own risk", "risk", 0.3),
    ("patent", r"this software is (?:protected|covered) by (?:one or more )?(?:u s |us )?patents", "patents", 0.5),
    ("dual", r"(?:dual|dually|multi) licensed under", "licensed", 0.7),
    ("see-license", r"see (?:the )?(?:licen[cs]e|copying)(?: file| txt| md)(?: in the (?:project )?root)? for", "licence license copying", 0.5),
    ("see-license", r"governed by a (?:bsd style|mit style) licen[cs]e that can be found in the licen[cs]e file", "governed", 0.8),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d (?:19|20)\d\d", "copyright", 0.5),
    ("copyright", r"copyright holders?", "copyright", 0.3),
    ("copyright", r"this (?:work|text|article|image|photo|material) is (?:protected by|under) copyright", "copyright", 0.7),
]

# Identifiers of a public license list, as they stand behind "SPDX-License-Identifier:" or before "license".
_IDENTIFIERS = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0
APSL-1.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear
BSD-4-Clause BSL-1.0 BUSL-1.1 CAL-1.0 CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0
CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0
CDDL-1.0 CDDL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1
EUPL-1.2 FSFAP FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0
GPL-3.0-only GPL-3.0-or-later HPND ICU IJG ImageMagick Intel IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.2 LPPL-1.3c MirOS MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0
MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 NTP ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 PDDL-1.0
PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11
Xnet Zend-2.0 Zlib ZPL-2.0 ZPL-2.1
""".split()

# Ways in which a notice brings up a license by name.
_MENTIONS = [
    ("licen[cs]ed under (?:the )?(?:terms of )?(?:the )?", 0.95),
    ("released under (?:the )?(?:terms of )?(?:the )?", 0.95),
    ("distributed under (?:the )?(?:terms of )?(?:the )?", 0.95),
    ("spdx licen[cs]e identifier ", 1.0),
    ("available under (?:the )?(?:terms of )?(?:the )?", 0.9),
    ("", 0.7),
]


@lru_cache(maxsize=1)
def standard_rules() -> tuple[Rule, ...]:
    """All rules, first priority first: identifiers, named versions, names, sentences; a fuller mention before a shorter."""
    rules: list[Rule] = []
    for label, name, keys, versions in _FAMILIES:
        words = tuple(keys.split())
        for lead, confidence in _MENTIONS:
            fuller = 100 * bool(lead)
            for version in versions:
                named = f"{label}-{version.replace(' ', '.')}"
                rules.append(Rule(named, rf"{lead}(?:{name})(?: licen[cs]e)?(?: version| v)? ?v?{version}(?! \d)", words, 500 + fuller + 10 * len(version), min(1.0, confidence + 0.03)))
            rules.append(Rule(label, rf"{lead}(?:{name})", words, 300 + fuller, confidence))
    for at, (label, pattern, key, confidence) in enumerate(_SENTENCES):
        rules.append(Rule(label, pattern, tuple(key.split()), 200 - at, confidence))
    for name in _IDENTIFIERS:
        words = re.sub("[^a-z0-9]+", " ", name.lower())
        rules.append(Rule(name.lower(), rf"spdx licen[cs]e identifier {words}(?! (?:\d|only|or later|clause|by|nc|nd|sa))", ("spdx",), 800 + len(words), 1.0))
        if any(c.isdigit() for c in words):  # a name with a version or number says enough before "license"
            rules.append(Rule(name.lower(), rf"{words} licen[cs]e", (words.split()[0],), 700 + len(words), 0.9))
    return tuple(sorted(rules, key=lambda r: (-r.priority, r.label, r.pattern)))


class Scanner:
    """Rules compiled once, found by keyword."""

    def __init__(self, rules: tuple[Rule, ...] | None = None, base: dict[str, str] | None = None):
        self.rules = standard_rules() if rules is None else rules
        self.base = BASE_PHRASES if base is None else base
        self._compiled = [re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])".encode()) for r in self.rules]
        self._by_word: dict[bytes, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for word in rule.keywords:
                self._by_word.setdefault(word.encode(), []).append(i)
        self._keys = frozenset(self._by_word)
        self._longest = max(map(len, self._keys), default=0)
        self._phrases = [(re.compile(rf"(?<![^ ]){re.escape(p)}(?![^ ])".encode()), frozenset(p.encode().split()), label) for p, label in self.base.items()]

    @staticmethod
    def words(text: str) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()

    def detections(self, words: list[bytes], held: frozenset | None = None, joined: bytes | None = None) -> list[Detection]:
        """Detections that are left after suppression, by place in the joined words."""
        held = frozenset(words) if held is None else held
        keys = self._keys & held
        # Names stand with versions joined to them too: gplv3, mpl2, cc01; words end so seldom.
        keys |= {w[:n] for w in held if w[-1:] in _VERSION_ENDS for n in range(1, min(len(w), self._longest + 1)) if w[:n] in self._keys}
        if not keys:
            return []
        joined = b" ".join(words) if joined is None else joined
        found = []
        for i in sorted({i for key in keys for i in self._by_word[key]}):
            rule = self.rules[i]
            found += [Detection(rule.label, m.start(), m.end(), rule.priority, rule.confidence) for m in self._compiled[i].finditer(joined)]
        return suppress(found)

    def scan(self, text: str) -> dict:
        """Counts and places of the base phrases, labels and score of a text."""
        words = self.words(text)
        held = frozenset(words)
        joined = None
        places: list[int] = []
        base: set[str] = set()
        for pattern, parts, label in self._phrases:
            if parts <= held:
                joined = b" ".join(words) if joined is None else joined
                own = [joined.count(b" ", 0, m.start()) for m in pattern.finditer(joined)] if len(joined) < 1 << 16 else _starts(pattern, joined)
                places += own
                if own:
                    base.add(label)
        found = self.detections(words, held, joined)
        doubt = float(np.prod([1 - c for c in _best_of_each(found).values()])) if found else 1.0
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {d.label for d in found})), "score": min(1.0, max(0.0, 1.0 - doubt)),
            "detections": [{"label": d.label, "start": d.start, "end": d.end, "confidence": d.confidence} for d in found],
        }


def _starts(pattern: re.Pattern, joined: bytes) -> list[int]:
    """Word numbers of all matches in one pass over a long text."""
    out, at, word = [], 0, 0
    for m in pattern.finditer(joined):
        word += joined.count(b" ", at, m.start())
        at = m.start()
        out.append(word)
    return out


def _best_of_each(found: list[Detection]) -> dict[str, float]:
    best: dict[str, float] = {}
    for d in found:
        best[d.label] = max(d.confidence, best.get(d.label, 0.0))
    return best


def suppress(found: list[Detection]) -> list[Detection]:
    """Drop each detection that lies inside one of at least its priority; of equal extents the first in order stays.

    One sweep: by start, longer first, higher priority first. What has been kept and reaches far enough contains it.
    """
    kept: list[Detection] = []
    active: list[Detection] = []
    for d in sorted(found, key=lambda d: (d.start, -d.end, -d.priority, d.label)):
        active = [a for a in active if a.end > d.start]
        if any(a.end >= d.end and a.priority >= d.priority for a in active):
            continue
        # Of equal extent a lower priority cannot follow a higher one; inside a wider one of lower priority both stand.
        kept.append(d)
        active.append(d)
    return kept


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:int,end:int,confidence:double>>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("detections", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))),
    ]
)


@lru_cache(maxsize=1)
def _standard_scanner() -> Scanner:
    return Scanner()


def scan_licenses(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of ``df``: word count, places of base phrases, labels, score, and the detections' spans.

    Spans are bytes of the words joined by single spaces. Null counts as empty; an empty text has no labels and score 0.
    Rows that repeat are scanned each for itself; further columns are ignored; an empty table gives an empty result.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _standard_scanner() if rules is None and base is None else Scanner(rules, base)
        for batch in slices(batches):
            rows = [scanner.scan(text.as_py() or "") for text in batch.column(1)]
            columns = [batch.column(0), *[pa.array([r[f.name] for r in rows], f.type) for f in list(_ARROW)[1:]]]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    return df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(over, _OUT)
