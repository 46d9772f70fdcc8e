"""Ordered signature rules for licence notices, written by hand.

Names: licence id, expression for its name, keyword that every match of the name contains in lower case, or several of
which it contains one.
Urls: licence id, expression for the address, keyword. Clauses: licence id, expression for wording of the licence text
or its notices, keyword. Tags come from the ids. Expressions ignore case; a blank stands for any white space.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: str
    license: str
    kind: str
    priority: int
    pattern: str
    keywords: tuple[str, ...]


V = r"(?:,? ?\(?(?:version|v\.?|ver\.?) ?|[- ]v?)"
_GNU = r"(?:gnu )?"
_LATER = r"(?: or (?:\(at your option\) )?(?:any )?later(?: version)?|\+)"

NAMES = [
    ("Apache-1.0", r"apache(?: software)? licen[sc]e" + V + r"1\.0\b", "apache"),
    ("Apache-1.1", r"apache(?: software)? licen[sc]e" + V + r"1\.1\b", "apache"),
    ("Apache-2.0", r"apache(?: software)? licen[sc]e" + V + r"2(?:\.0)?\b", "apache"),
    ("Apache-2.0", r"\bapache" + V + r"2\.0(?: licen[sc]e)?\b", "apache"),
    ("Apache-2.0", r"\bASL" + V + r"2\.0\b", "asl"),
    ("MIT", r"\bMIT licen[sc]e\b", "mit"),
    ("MIT", r"\bexpat licen[sc]e\b", "expat"),
    ("MIT", r"\bMIT/X11\b", "mit/x11"),
    ("MIT-0", r"\bMIT no attribution\b", "no attribution"),
    ("X11", r"\bX11 licen[sc]e\b", "x11"),
    ("ISC", r"\bISC licen[sc]e\b", "isc"),
    ("BSD-2-Clause", r"\b(?:2|two)[- ]clause BSD(?: licen[sc]e)?\b", "clause bsd"),
    ("BSD-2-Clause", r"\b(?:simplified|freebsd) BSD licen[sc]e\b", "bsd"),
    ("BSD-2-Clause", r"\bBSD 2[- ]clause\b", "bsd"),
    ("BSD-3-Clause", r"\b(?:3|three)[- ]clause BSD(?: licen[sc]e)?\b", "clause bsd"),
    ("BSD-3-Clause", r"\b(?:new|revised|modified) BSD licen[sc]e\b", "bsd"),
    ("BSD-3-Clause", r"\bBSD 3[- ]clause\b", "bsd"),
    ("BSD-4-Clause", r"\b(?:4|four)[- ]clause BSD(?: licen[sc]e)?\b", "clause bsd"),
    ("BSD-4-Clause", r"\b(?:original|old) BSD licen[sc]e\b", "bsd"),
    ("0BSD", r"\b(?:zero[- ]clause|0[- ]clause) BSD\b", "clause bsd"),
    ("BSD", r"\bBSD(?:-style)? licen[sc]e\b", "bsd"),
    ("GPL-1.0", _GNU + r"general public licen[sc]e" + V + r"1(?:\.0)?\b", "general public licen"),
    ("GPL-2.0", _GNU + r"general public licen[sc]e" + V + r"2(?:\.0)?\b", "general public licen"),
    ("GPL-2.0-or-later", _GNU + r"general public licen[sc]e" + V + r"2(?:\.0)?,?" + _LATER, "general public licen"),
    ("GPL-3.0", _GNU + r"general public licen[sc]e" + V + r"3(?:\.0)?\b", "general public licen"),
    ("GPL-3.0-or-later", _GNU + r"general public licen[sc]e" + V + r"3(?:\.0)?,?" + _LATER, "general public licen"),
    ("GPL", r"\b(?:gnu )?general public licen[sc]e\b", "general public licen"),
    ("GPL-2.0", r"\b(?:gnu )?GPL ?[-, ]?v?(?:ersion )?2(?:\.0)?\b", "gpl"),
    ("GPL-3.0", r"\b(?:gnu )?GPL ?[-, ]?v?(?:ersion )?3(?:\.0)?\b", "gpl"),
    ("GPL", r"\bGNU GPL\b", "gnu gpl"),
    ("LGPL-2.0", _GNU + r"library general public licen[sc]e(?:" + V + r"2(?:\.0)?)?\b", "library general public licen"),
    ("LGPL-2.1", _GNU + r"lesser general public licen[sc]e" + V + r"2\.1\b", "lesser general public licen"),
    ("LGPL-3.0", _GNU + r"lesser general public licen[sc]e" + V + r"3(?:\.0)?\b", "lesser general public licen"),
    ("LGPL", r"\b(?:gnu )?lesser general public licen[sc]e\b", "lesser general public licen"),
    ("LGPL-2.1", r"\bLGPL ?[-, ]?v?(?:ersion )?2\.1\b", "lgpl"),
    ("LGPL-3.0", r"\bLGPL ?[-, ]?v?(?:ersion )?3(?:\.0)?\b", "lgpl"),
    ("AGPL-1.0", r"\baffero general public licen[sc]e" + V + r"1(?:\.0)?\b", "affero"),
    ("AGPL-3.0", r"\b(?:gnu )?affero general public licen[sc]e" + V + r"3(?:\.0)?\b", "affero"),
    ("AGPL", r"\b(?:gnu )?affero general public licen[sc]e\b", "affero"),
    ("AGPL-3.0", r"\bAGPL ?[-, ]?v?(?:ersion )?3(?:\.0)?\b", "agpl"),
    ("GFDL-1.2", r"\b(?:gnu )?free documentation licen[sc]e" + V + r"1\.2\b", "free documentation"),
    ("GFDL-1.3", r"\b(?:gnu )?free documentation licen[sc]e" + V + r"1\.3\b", "free documentation"),
    ("GFDL", r"\b(?:gnu )?free documentation licen[sc]e\b", "free documentation"),
    ("MPL-1.0", r"\bmozilla public licen[sc]e" + V + r"1\.0\b", "mozilla public"),
    ("MPL-1.1", r"\bmozilla public licen[sc]e" + V + r"1\.1\b", "mozilla public"),
    ("MPL-2.0", r"\bmozilla public licen[sc]e" + V + r"2(?:\.0)?\b", "mozilla public"),
    ("MPL", r"\bmozilla public licen[sc]e\b", "mozilla public"),
    ("MPL-2.0", r"\bMPL ?[- ]?v?2(?:\.0)?\b", "mpl"),
    ("EPL-1.0", r"\beclipse public licen[sc]e" + V + r"1(?:\.0)?\b", "eclipse public"),
    ("EPL-2.0", r"\beclipse public licen[sc]e" + V + r"2(?:\.0)?\b", "eclipse public"),
    ("EPL", r"\beclipse public licen[sc]e\b", "eclipse public"),
    ("EDL-1.0", r"\beclipse distribution licen[sc]e(?:" + V + r"1\.0)?\b", "eclipse distribution"),
    ("CDDL-1.0", r"\bcommon development and distribution licen[sc]e(?:" + V + r"1\.0)?\b", "common development"),
    ("CDDL-1.1", r"\bcommon development and distribution licen[sc]e" + V + r"1\.1\b", "common development"),
    ("CPL-1.0", r"\bcommon public licen[sc]e(?:" + V + r"1\.0)?\b", "common public licen"),
    ("CPAL-1.0", r"\bcommon public attribution licen[sc]e\b", "common public attribution"),
    ("IPL-1.0", r"\bIBM public licen[sc]e\b", "ibm public"),
    ("EUPL-1.1", r"\beuropean union public licen[sc]e" + V + r"1\.1\b", "european union public"),
    ("EUPL-1.2", r"\beuropean union public licen[sc]e(?:" + V + r"1\.2)?\b", "european union public"),
    ("OSL-3.0", r"\bopen software licen[sc]e(?:" + V + r"3\.0)?\b", "open software licen"),
    ("AFL-3.0", r"\bacademic free licen[sc]e(?:" + V + r"3\.0)?\b", "academic free"),
    ("Artistic-1.0", r"\bartistic licen[sc]e" + V + r"1\.0\b", "artistic"),
    ("Artistic-2.0", r"\bartistic licen[sc]e" + V + r"2\.0\b", "artistic"),
    ("Artistic", r"\bartistic licen[sc]e\b", "artistic"),
    ("BSL-1.0", r"\bboost software licen[sc]e(?:" + V + r"1\.0)?\b", "boost software"),
    ("BUSL-1.1", r"\bbusiness source licen[sc]e(?: 1\.1)?\b", "business source"),
    ("SSPL-1.0", r"\bserver side public licen[sc]e\b", "server side public"),
    ("Elastic-2.0", r"\belastic licen[sc]e(?: 2\.0)?\b", "elastic licen"),
    ("Zlib", r"\bzlib(?:/libpng)? licen[sc]e\b", "zlib"),
    ("libpng", r"\blibpng licen[sc]e\b", "libpng"),
    ("Unlicense", r"\bthe unlicense\b", "unlicense"),
    ("WTFPL", r"\bdo what the f\S{1,4} you want to public licen[sc]e\b", "you want to public"),
    ("WTFPL", r"\bWTFPL\b", "wtfpl"),
    ("Beerware", r"\bbeer-?ware licen[sc]e\b", "ware licen"),
    ("JSON", r"\bJSON licen[sc]e\b", "json licen"),
    ("PSF-2.0", r"\bpython software foundation licen[sc]e\b", "python software foundation"),
    ("Python-2.0", r"\bPSF licen[sc]e agreement\b", "psf licen"),
    ("Ruby", r"\bruby licen[sc]e\b", "ruby licen"),
    ("PHP-3.01", r"\bPHP licen[sc]e(?:" + V + r"3\.01)?\b", "php licen"),
    ("OpenSSL", r"\bopenssl licen[sc]e\b", "openssl licen"),
    ("SSLeay", r"\bssleay licen[sc]e\b", "ssleay"),
    ("curl", r"\bcurl licen[sc]e\b", "curl licen"),
    ("NCSA", r"\b(?:university of illinois/?)?NCSA open source licen[sc]e\b", "ncsa"),
    ("UPL-1.0", r"\buniversal permissive licen[sc]e\b", "universal permissive"),
    ("MS-PL", r"\bmicrosoft public licen[sc]e\b", "microsoft public"),
    ("MS-RL", r"\bmicrosoft reciprocal licen[sc]e\b", "microsoft reciprocal"),
    ("APSL-2.0", r"\bapple public source licen[sc]e\b", "apple public"),
    ("QPL-1.0", r"\bQ public licen[sc]e\b", "q public"),
    ("ZPL-2.1", r"\bzope public licen[sc]e\b", "zope public"),
    ("W3C", r"\bW3C software (?:notice and )?licen[sc]e\b", "w3c software"),
    ("Vim", r"\bvim licen[sc]e\b", "vim licen"),
    ("FTL", r"\bfreetype (?:project )?licen[sc]e\b", "freetype"),
    ("IJG", r"\bindependent jpeg group'?s? licen[sc]e\b", "independent jpeg"),
    ("ICU", r"\bICU licen[sc]e\b", "icu licen"),
    ("Unicode", r"\bunicode(?:, inc\.)? licen[sc]e agreement\b", "unicode"),
    ("OFL-1.1", r"\b(?:SIL )?open font licen[sc]e(?:" + V + r"1\.1)?\b", "open font"),
    ("LPPL-1.3c", r"\blatex project public licen[sc]e\b", "latex project"),
    ("MulanPSL-2.0", r"\bmulan (?:permissive software licen[sc]e|PSL)\b", "mulan"),
    ("BlueOak-1.0.0", r"\bblue oak model licen[sc]e\b", "blue oak"),
    ("CECILL-2.1", r"\bcecill(?:-[BC])? (?:free software )?licen[sc]e\b", "cecill"),
    ("ODbL-1.0", r"\bopen (?:data commons )?(?:open )?database licen[sc]e\b", "database licen"),
    ("ODC-By-1.0", r"\bopen data commons attribution licen[sc]e\b", "open data commons attribution"),
    ("PDDL-1.0", r"\bpublic domain dedication and licen[sc]e\b", "public domain dedication"),
    ("CC0-1.0", r"\bCC0(?: 1\.0)?(?: universal)?\b", "cc0"),
    ("CC-BY-1.0", r"\bcreative commons attribution 1\.0\b", "creative commons"),
    ("CC-BY-2.0", r"\bcreative commons attribution 2\.0\b", "creative commons"),
    ("CC-BY-2.5", r"\bcreative commons attribution 2\.5\b", "creative commons"),
    ("CC-BY-3.0", r"\bcreative commons attribution 3\.0\b", "creative commons"),
    ("CC-BY-4.0", r"\bcreative commons attribution 4\.0\b", "creative commons"),
    ("CC-BY-SA", r"\bcreative commons attribution[- ]share-?alike(?: [1-4]\.\d)?\b", "creative commons"),
    ("CC-BY-NC", r"\bcreative commons attribution[- ]non-?commercial(?: [1-4]\.\d)?\b", "creative commons"),
    ("CC-BY-NC-SA", r"\bcreative commons attribution[- ]non-?commercial[- ]share-?alike(?: [1-4]\.\d)?\b", "creative commons"),
    ("CC-BY-NC-ND", r"\bcreative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?(?: [1-4]\.\d)?\b", "creative commons"),
    ("CC-BY-ND", r"\bcreative commons attribution[- ]no-?deriv(?:ative)?s?(?: [1-4]\.\d)?\b", "creative commons"),
    ("CC", r"\bcreative commons licen[sc]e\b", "creative commons"),
    ("CC-BY-4.0", r"\bCC[- ]BY[- ]4\.0\b", "cc"),
    ("CC-BY-3.0", r"\bCC[- ]BY[- ]3\.0\b", "cc"),
    ("CC-BY-SA-4.0", r"\bCC[- ]BY-SA[- ]4\.0\b", "by-sa"),
    ("CC-BY-SA-3.0", r"\bCC[- ]BY-SA[- ]3\.0\b", "by-sa"),
    ("CC-BY-NC-4.0", r"\bCC[- ]BY-NC[- ]4\.0\b", "by-nc"),
    ("CC-BY-NC-SA-4.0", r"\bCC[- ]BY-NC-SA[- ]4\.0\b", "by-nc-sa"),
    ("CC-BY-NC-ND-4.0", r"\bCC[- ]BY-NC-ND[- ]4\.0\b", "by-nc-nd"),
    ("CC-BY-ND-4.0", r"\bCC[- ]BY-ND[- ]4\.0\b", "by-nd"),
    ("OpenRAIL", r"\b(?:creativeml )?open ?rail(?:-[ms]+)?(?: licen[sc]e)?\b", "rail"),
    ("PolyForm-Noncommercial-1.0.0", r"\bpolyform noncommercial licen[sc]e\b", "polyform noncommercial"),
    ("PolyForm-Small-Business-1.0.0", r"\bpolyform small business licen[sc]e\b", "polyform small"),
    ("Parity-7.0.0", r"\bparity public licen[sc]e\b", "parity public"),
    ("Sleepycat", r"\bsleepycat licen[sc]e\b", "sleepycat"),
    ("NPL-1.1", r"\bnetscape public licen[sc]e\b", "netscape public"),
    ("SISSL", r"\bsun industry standards source licen[sc]e\b", "sun industry"),
    ("SPL-1.0", r"\bsun public licen[sc]e\b", "sun public"),
    ("Watcom-1.0", r"\bsybase open watcom public licen[sc]e\b", "watcom"),
    ("RPL-1.5", r"\breciprocal public licen[sc]e\b", "reciprocal public"),
    ("Nokia", r"\bnokia open source licen[sc]e\b", "nokia open"),
    ("Intel", r"\bintel open source licen[sc]e\b", "intel open"),
    ("NASA-1.3", r"\bNASA open source agreement\b", "nasa open"),
    ("PostgreSQL", r"\bpostgresql licen[sc]e\b", "postgresql licen"),
    ("HPND", r"\bhistorical permission notice and disclaimer\b", "historical permission"),
    ("NTP", r"\bNTP licen[sc]e\b", "ntp licen"),
    ("ECL-2.0", r"\beducational community licen[sc]e\b", "educational community"),
    ("Hippocratic-2.1", r"\bhippocratic licen[sc]e\b", "hippocratic"),
    ("CAL-1.0", r"\bcryptographic autonomy licen[sc]e\b", "cryptographic autonomy"),
    ("OGL-UK-3.0", r"\bopen government licen[sc]e\b", "open government"),
    ("TCL", r"\btcl/tk licen[sc]e\b", "tcl/tk"),
    ("Info-ZIP", r"\binfo-zip licen[sc]e\b", "info-zip"),
    ("bzip2-1.0.6", r"\bbzip2 licen[sc]e\b", "bzip2"),
    ("TU-Berlin-2.0", r"\btechnische universitaet berlin\b", "universitaet berlin"),
    ("Proprietary", r"\bproprietary (?:software )?licen[sc]e\b", "proprietary"),
]

URLS = [
    ("Apache-2.0", r"apache\.org/licenses/LICENSE-2\.0(?:\.txt|\.html)?", "apache.org/licenses"),
    ("Apache-1.1", r"apache\.org/licenses/LICENSE-1\.1", "apache.org/licenses"),
    ("MIT", r"opensource\.org/licenses?/MIT\b", "opensource.org/license"),
    ("ISC", r"opensource\.org/licenses?/ISC\b", "opensource.org/license"),
    ("BSD-2-Clause", r"opensource\.org/licenses?/BSD-2-Clause", "opensource.org/license"),
    ("BSD-3-Clause", r"opensource\.org/licenses?/BSD-3-Clause", "opensource.org/license"),
    ("GPL-2.0", r"opensource\.org/licenses?/GPL-2\.0", "opensource.org/license"),
    ("GPL-3.0", r"opensource\.org/licenses?/GPL-3\.0", "opensource.org/license"),
    ("LGPL-2.1", r"opensource\.org/licenses?/LGPL-2\.1", "opensource.org/license"),
    ("AGPL-3.0", r"opensource\.org/licenses?/AGPL-3\.0", "opensource.org/license"),
    ("MPL-2.0", r"opensource\.org/licenses?/MPL-2\.0", "opensource.org/license"),
    ("EPL-2.0", r"opensource\.org/licenses?/EPL-2\.0", "opensource.org/license"),
    ("GPL-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "gnu.org/licenses"),
    ("GPL-3.0", r"gnu\.org/licenses/gpl-3\.0", "gnu.org/licenses"),
    ("LGPL-2.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", "gnu.org/licenses"),
    ("LGPL-3.0", r"gnu\.org/licenses/lgpl-3\.0", "gnu.org/licenses"),
    ("AGPL-3.0", r"gnu\.org/licenses/agpl-3\.0", "gnu.org/licenses"),
    ("GFDL", r"gnu\.org/licenses/fdl(?:-1\.\d)?", "gnu.org/licenses"),
    ("GPL", r"gnu\.org/(?:licenses|copyleft)/gpl\.(?:html|txt)", "gnu.org/"),
    ("MPL-1.1", r"mozilla\.org/MPL/1\.1", "mozilla.org/mpl"),
    ("MPL-2.0", r"mozilla\.org/(?:en-US/)?MPL/2\.0", "mpl/2.0"),
    ("EPL-1.0", r"eclipse\.org/legal/epl-v10", "eclipse.org/legal"),
    ("EPL-2.0", r"eclipse\.org/legal/epl-(?:v20|2\.0)", "eclipse.org/legal"),
    ("CC0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0", "creativecommons.org"),
    ("CC-PDM-1.0", r"creativecommons\.org/publicdomain/mark/1\.0", "creativecommons.org"),
    ("CC-BY", r"creativecommons\.org/licenses/by/[1-4]\.\d", "creativecommons.org"),
    ("CC-BY-SA", r"creativecommons\.org/licenses/by-sa/[1-4]\.\d", "creativecommons.org"),
    ("CC-BY-NC", r"creativecommons\.org/licenses/by-nc/[1-4]\.\d", "creativecommons.org"),
    ("CC-BY-NC-SA", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.\d", "creativecommons.org"),
    ("CC-BY-NC-ND", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.\d", "creativecommons.org"),
    ("CC-BY-ND", r"creativecommons\.org/licenses/by-nd/[1-4]\.\d", "creativecommons.org"),
    ("BSL-1.0", r"boost\.org/LICENSE_1_0\.txt", "boost.org/"),
    ("Unlicense", r"unlicense\.org", "unlicense.org"),
    ("WTFPL", r"wtfpl\.net", "wtfpl.net"),
    ("OFL-1.1", r"scripts\.sil\.org/OFL", "sil.org/ofl"),
    ("ODbL-1.0", r"opendatacommons\.org/licenses/odbl", "opendatacommons.org"),
    ("PDDL-1.0", r"opendatacommons\.org/licenses/pddl", "opendatacommons.org"),
    ("EUPL", r"joinup\.ec\.europa\.eu/\S*eupl", "joinup.ec.europa.eu"),
    ("Elastic-2.0", r"elastic\.co/licensing/elastic-license", "elastic.co/licensing"),
    ("BUSL-1.1", r"mariadb\.com/bsl11", "mariadb.com/bsl"),
]

CLAUSES = [
    ("MIT", r"permission is hereby granted, free of charge, to any person obtaining a copy", "permission is hereby granted"),
    ("MIT", r"the above copyright notice and this permission notice shall be included in all copies", "permission notice shall be included"),
    ("ISC", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee", "for any purpose with or without fee"),
    ("BSD", r"redistribution and use in source and binary forms, with or without modification", "redistribution and use"),
    ("BSD-3-Clause", r"neither the name of .{1,120}? nor the names of its contributors", "neither the name"),
    ("BSD-4-Clause", r"all advertising materials mentioning features or use of this software", "advertising materials mentioning"),
    ("Apache-2.0", r"you may not use this file except in compliance with the license", "in compliance with the license"),
    ("Apache-2.0", r"unless required by applicable law or agreed to in writing, software", "unless required by applicable law"),
    ("Apache-2.0", r"terms and conditions for use, reproduction, and distribution", "use, reproduction, and distribution"),
    ("GPL", r"this program is free software[:;,] you can redistribute it and/or modify it", "this program is free software"),
    ("GPL", r"this program is distributed in the hope that it will be useful", "in the hope that it will be useful"),
    ("GPL", r"you should have received a copy of the gnu general public license", "received a copy of the gnu"),
    ("LGPL", r"this library is free software[:;,] you can redistribute it and/or modify it", "this library is free software"),
    ("LGPL", r"you should have received a copy of the gnu lesser general public license", "received a copy of the gnu lesser"),
    ("AGPL", r"you should have received a copy of the gnu affero general public license", "received a copy of the gnu affero"),
    ("MPL-2.0", r"this source code form is subject to the terms of the mozilla public license", "source code form is subject"),
    ("MPL-1.1", r"the contents of this file are subject to the mozilla public license", "contents of this file are subject"),
    ("CDDL-1.0", r"the contents of this file are subject to the terms of the common development", "contents of this file are subject"),
    ("EPL", r"this program and the accompanying materials are made available under the terms of the eclipse", "accompanying materials are made available"),
    ("Zlib", r"this software is provided 'as-is', without any express or implied warranty", "provided 'as-is'"),
    ("Zlib", r"altered source versions must be plainly marked as such", "altered source versions"),
    ("BSL-1.0", r"boost software license - version 1\.0 - august 17th, 2003", "boost software license"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain", "free and unencumbered"),
    ("CC0-1.0", r"to the extent possible under law, .{1,120}? has waived all copyright", "to the extent possible under law"),
    ("Public-Domain", r"\b(?:released|placed|dedicated|is) (?:in(?:to)?|to) the public domain\b", "public domain"),
    ("Beerware", r"if we meet some day, and you think this stuff is worth it", "if we meet some day"),
    ("OFL-1.1", r"this font software is licensed under the sil open font license", "font software is licensed"),
    ("Proprietary", r"\ball rights (?:are )?reserved\b", "reserved"),
    ("Proprietary", r"\b(?:confidential and proprietary|proprietary and confidential)\b", "proprietary"),
    ("Proprietary", r"\bunauthori[sz]ed (?:copying|reproduction|distribution)\b.{0,60}?\bprohibited\b", "prohibited"),
    ("Proprietary", r"\bmay not be (?:copied|reproduced|redistributed)\b.{0,80}?\bpermission\b", "may not be"),
    ("Non-Commercial", r"\bfor (?:non-?commercial|personal)(?: and non-?commercial)? use only\b", "use only"),
    ("Copyright", r"(?:\bcopyright(?: \(c\)| ©)?|©|\(c\)) ?(?:19|20)\d\d(?:[-–, ]+(?:19|20)?\d\d)*", ("copyright", "©", "(c)")),
    ("Copyright", r"(?:©|\(c\)) ?(?:19|20)\d\d(?:[-–, ]+(?:19|20)?\d\d)* \w+", ("©", "(c)")),
]

#: A licence named in a sentence that grants it.
GRANT = r"\b(?:(?:dual[- ])?licen[sc]ed|released|distributed|published|available|provided|covered|offered|redistributed)(?: \w+){0,3}? (?:under|by)(?: the terms(?: and conditions)? of)?(?: the| an?)? "
GERMAN = r"\b(?:lizenziert|veröffentlicht|freigegeben) unter (?:der |den )?(?:bedingungen der )?"
FRENCH = r"\b(?:sous|selon) (?:les termes de )?(?:la )?licence "
SPANISH = r"\b(?:bajo|con) (?:los términos de )?(?:la )?licencia "


def _blank(p: str) -> str:
    return p.replace(" ?", r"\s?").replace(" ", r"\s+")


def _keys(k: str | tuple[str, ...]) -> tuple[str, ...]:
    return (k,) if isinstance(k, str) else k


def build_rules() -> list[Rule]:
    """All rules; kinds from tag (most reliable) to title. Later rules of a kind give way to earlier ones."""
    out = []
    for i, x in enumerate(sorted({n for n, _, _ in NAMES} | {u for u, _, _ in URLS})):
        out.append(Rule(f"tag-{i:03}", x, "tag", 100, _blank(r"SPDX-License-Identifier: ?\(?" + re.escape(x).replace(r"\-", "-") + r"(?:-only|-or-later|\+)?(?![\w.-]*\w)"), ("spdx-license-identifier",)))
    out += [Rule(f"clause-{i:03}", n, "clause", 90, _blank(p), _keys(k)) for i, (n, p, k) in enumerate(CLAUSES)]
    out += [Rule(f"grant-{i:03}", n, "grant", 80, _blank(GRANT + p), _keys(k)) for i, (n, p, k) in enumerate(NAMES)]
    out += [Rule(f"url-{i:03}", n, "url", 70, _blank(r"(?:https?://)?(?:www\.)?" + p), _keys(k)) for i, (n, p, k) in enumerate(URLS)]
    for lang, lead in (("de", GERMAN), ("fr", FRENCH), ("es", SPANISH)):
        for i, (n, p, k) in enumerate((("Apache-2.0", r"apache(?:-lizenz)?,? ?(?:version )?2\.0", "apache"), ("MIT", r"MIT(?:-lizenz)?\b", "mit"), ("GPL-3.0", r"(?:gnu )?GPL ?v?3", "gpl"), ("GPL-2.0", r"(?:gnu )?GPL ?v?2", "gpl"), ("BSD", r"BSD(?:-lizenz)?\b", "bsd"), ("CC", r"creative commons", "creative commons"))):
            out.append(Rule(f"{lang}-{i:03}", n, "grant", 80, _blank(lead + p), _keys(k)))
    out += [Rule(f"title-{i:03}", n, "title", 60, _blank(p), _keys(k)) for i, (n, p, k) in enumerate(NAMES)]
    return out


RULES = build_rules()
