"""License detection by ordered signature rules.

A rule is a regular expression over the lower-cased text with a label, a priority and a
keyword. Rules are tried only on texts that hold their keyword, whatever white space stands
between its words. Detections that overlap are resolved in order: higher priority first, then the longer, then the earlier; a detection
whose interval lies inside one that is kept already is suppressed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import WORD, arrow_schema, lowered, rows_of

#: The phrases of the contract, as words, and their labels.
PHRASES = {
    ("gnu", "general", "public", "license"): "gpl",
    ("apache", "license"): "apache",
    ("cc", "by"): "cc-by",
    ("mit", "license"): "mit",
}

# Families: label | keyword of its name | name | versions ("-": none is written).
_FAMILIES = r"""
gpl | general public | (?:gnu )?general public licen[cs]e | 1 2 3
gpl | gpl | (?:gnu )?gpl | 1 2 3
lgpl | lesser general | (?:gnu )?lesser general public licen[cs]e | 2.1 3
lgpl | library general | (?:gnu )?library general public licen[cs]e | 2
lgpl | lgpl | (?:gnu )?lgpl | 2 2.1 3
agpl | affero | (?:gnu )?affero general public licen[cs]e | 1 3
agpl | agpl | (?:gnu )?agpl | 1 3
gfdl | free documentation | (?:gnu )?free documentation licen[cs]e | 1.1 1.2 1.3
apache | apache | apache (?:software )?licen[cs]e | 1 1.1 2
mpl | mozilla public | mozilla public licen[cs]e | 1 1.1 2
epl | eclipse public | eclipse public licen[cs]e | 1 2
edl | eclipse distribution | eclipse distribution licen[cs]e | 1
cddl | common development | common development and distribution licen[cs]e | 1 1.1
cpl | common public | common public licen[cs]e | 0.5 1
eupl | european union public | european union public licen[cs]e | 1 1.1 1.2
osl | open software licen | open software licen[cs]e | 1 1.1 2 2.1 3
afl | academic free | academic free licen[cs]e | 1.1 1.2 2 2.1 3
artistic | artistic licen | artistic licen[cs]e | 1 2
ms-pl | microsoft public | microsoft public licen[cs]e | -
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e | -
bsl | boost software | boost software licen[cs]e | 1
busl | business source | business source licen[cs]e | 1 1.1
elastic | elastic licen | elastic licen[cs]e | 1 2
sspl | server side public | server side public licen[cs]e | 1
mit | mit licen | mit licen[cs]e | -
mit | expat licen | expat licen[cs]e | -
x11 | x11 licen | x11 licen[cs]e | -
isc | isc licen | isc licen[cs]e | -
zlib | zlib | zlib(?:/libpng)? licen[cs]e | -
bsd | bsd | (?:simplified |modified |new |revised )?bsd licen[cs]e | -
bsd-2-clause | bsd | (?:bsd 2.clause|2.clause bsd|freebsd)(?: licen[cs]e)? | -
bsd-3-clause | bsd | (?:bsd 3.clause|3.clause bsd)(?: licen[cs]e)? | -
bsd-4-clause | bsd | (?:bsd 4.clause|4.clause bsd|original bsd)(?: licen[cs]e)? | -
0bsd | bsd | (?:zero.clause bsd|0bsd)(?: licen[cs]e)? | -
unlicense | unlicense | the unlicense | -
wtfpl | want to public | do what the fuck you want to public licen[cs]e | 1 2
wtfpl | wtfpl | wtfpl | 1 2
cc0 | cc0 | cc0 | 1
cc0 | public domain dedication | public domain dedication | 1
cc-by-nc-nd | cc by | cc.by.nc.nd | 2 2.5 3 4
cc-by-nc-sa | cc by | cc.by.nc.sa | 2 2.5 3 4
cc-by-nc | cc by | cc.by.nc | 2 2.5 3 4
cc-by-nd | cc by | cc.by.nd | 2 2.5 3 4
cc-by-sa | cc by | cc.by.sa | 1 2 2.5 3 4
cc-by | cc by | cc.by | 1 2 2.5 3 4
cc-by-nc-nd | deriv | (?:creative commons )?attribution.non.?commercial.no.?deriv(?:s|atives?|ative works) | 2 2.5 3 4
cc-by-nc-sa | sharealike | (?:creative commons )?attribution.non.?commercial.sharealike | 2 2.5 3 4
cc-by-nc-sa | share alike | (?:creative commons )?attribution.non.?commercial.share alike | 2 2.5 3 4
cc-by-nc | commercial | (?:creative commons )?attribution.non.?commercial | 2 2.5 3 4
cc-by-nd | deriv | (?:creative commons )?attribution.no.?deriv(?:s|atives?) | 2 2.5 3 4
cc-by-sa | share | (?:creative commons )?attribution.share.?alike | 1 2 2.5 3 4
cc-by | creative commons attribution | creative commons attribution | 1 2 2.5 3 4
odbl | open database | open (?:data commons open )?database licen[cs]e | 1
odc-by | open data commons | open data commons attribution licen[cs]e | 1
pddl | public domain dedication and | public domain dedication and licen[cs]e | 1
ogl-uk | open government | open government licen[cs]e | 1 2 3
etalab | licence ouverte | licence ouverte | 1 2
ofl | open font | (?:sil )?open font licen[cs]e | 1 1.1
psf | python software foundation | python software foundation licen[cs]e | 2
php | php licen | php licen[cs]e | 3 3.01
ruby | ruby licen | ruby licen[cs]e | -
perl | same terms as perl | same terms as perl(?: itself)? | -
openssl | openssl licen | openssl licen[cs]e | -
postgresql | postgresql licen | postgresql licen[cs]e | -
qpl | q public | q public licen[cs]e | 1
upl | universal permissive | universal permissive licen[cs]e | 1
ncsa | ncsa | (?:university of illinois/ncsa|ncsa) open source licen[cs]e | -
zpl | zope public | zope public licen[cs]e | 1.1 2 2.1
w3c | w3c | w3c software (?:notice and )?licen[cs]e | -
vim | vim licen | vim licen[cs]e | -
tcl | tcl/tk | tcl/tk licen[cs]e | -
unicode | unicode licen | unicode licen[cs]e | 3
json | json licen | json licen[cs]e | -
beerware | beer | beer.ware licen[cs]e | 42
llama | llama | llama 2? ?community licen[cs]e | 2 3
openrail | rail | (?:creativeml )?open ?rail(?:-m|\+\+-m)? licen[cs]e | -
commons-clause | commons clause | commons clause | 1
polyform | polyform | polyform (?:noncommercial|small business|strict|shield|perimeter) licen[cs]e | 1
cecill | cecill | cecill(?:-[abc])? | 1 2 2.1
mulan-psl | mulan | mulan permissive software licen[cs]e | 1 2
apsl | apple public source | apple public source licen[cs]e | 1 1.1 1.2 2
apl | adaptive public | adaptive public licen[cs]e | 1
aal | attribution assurance | attribution assurance licen[cs]e | -
blueoak | blue oak | blue oak model licen[cs]e | 1
cal | cryptographic autonomy | cryptographic autonomy licen[cs]e | 1
cc-devnations | developing nations | creative commons developing nations licen[cs]e | 2
cdla-permissive | community data licen | community data licen[cs]e agreement.{1,4}?permissive | 1 2
cdla-sharing | community data licen | community data licen[cs]e agreement.{1,4}?sharing | 1
cern-ohl | cern open hardware | cern open hardware licen[cs]e | 1.1 1.2 2
c-uda | computational use of data | computational use of data agreement | 1
cpal | common public attribution | common public attribution licen[cs]e | 1
dl-de | datenlizenz deutschland | datenlizenz deutschland | 1 2
dsl | design science | design science licen[cs]e | -
ecl | educational community | educational community licen[cs]e | 1 2
efl | eiffel forum | eiffel forum licen[cs]e | 1 2
entessa | entessa public | entessa public licen[cs]e | -
fair | fair licen | the fair licen[cs]e | -
frameworx | frameworx | frameworx (?:open )?licen[cs]e | 1
ftl | freetype | freetype (?:project )?licen[cs]e | -
gemma | gemma terms | gemma terms of use | -
hippocratic | hippocratic | hippocratic licen[cs]e | 1 2.1 3
ibm-pl | ibm public | ibm public licen[cs]e | 1
imagemagick | imagemagick licen | imagemagick licen[cs]e | -
intel | intel open source | intel open source licen[cs]e | -
lal | free art licen | free art licen[cs]e | 1.2 1.3
lal | licence art libre | licence art libre | 1.2 1.3
lppl | latex project public | latex project public licen[cs]e | 1 1.1 1.2 1.3
liliq | libre du québec | licence libre du québec | 1.1
lpl | lucent public | lucent public licen[cs]e | 1 1.02
ms-lpl | microsoft limited public | microsoft limited public licen[cs]e | -
nasa | nasa open source | nasa open source agreement | 1.3
naumen | naumen public | naumen public licen[cs]e | -
netcdf | netcdf licen | netcdf licen[cs]e | -
nokia | nokia open source | nokia open source licen[cs]e | 1
nposl | non-profit open software | non-profit open software licen[cs]e | 3
npl | netscape public | netscape public licen[cs]e | 1 1.1
oclc | oclc research | oclc research public licen[cs]e | 2
ogl-canada | government licen | open government licen[cs]e.{1,4}?canada | 2
oldap | openldap public | openldap public licen[cs]e | 2.7 2.8
opl | open publication | open publication licen[cs]e | 1
o-uda | open use of data | open use of data agreement | 1
parity | parity public | parity public licen[cs]e | 6 7
prosperity | prosperity public | prosperity public licen[cs]e | 2 3
ricoh | ricoh source code | ricoh source code public licen[cs]e | 1
rpl | reciprocal public | reciprocal public licen[cs]e | 1.1 1.5
rpsl | realnetworks public | realnetworks public source licen[cs]e | 1
simpl | simple public | simple public licen[cs]e | 2
solderpad | solderpad | solderpad hardware licen[cs]e | 0.5 2
spl | sun public | sun public licen[cs]e | 1
tapr-ohl | tapr open hardware | tapr open hardware licen[cs]e | 1
vsl | vovida software | vovida software licen[cs]e | 1
watcom | open watcom | (?:sybase )?open watcom public licen[cs]e | 1
xnet | x.net | x\.net licen[cs]e | -
"""

# Label | keyword | whole sentences of notices and license texts, or addresses.
_NOTICES = r"""
gpl | redistribute it and/or | free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public
lgpl | redistribute it and/or | redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public
agpl | redistribute it and/or | redistribute it and/or modify it under the terms of the gnu affero general public
apache-2.0 | except in compliance | you may not use this (?:file|software|work) except in compliance with the license
mit | to deal in the software without | to deal in the software without restriction, including without limitation the rights to use
mit | permission is hereby granted, free | permission is hereby granted, free of charge, to any person obtaining a copy
isc | with or without fee is hereby | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use in source | redistribution and use in source and binary forms, with or without modification, are permitted
bsd-3-clause | to endorse or promote | neither the name of .{1,80}? may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
zlib | misrepresented | altered source versions must be plainly marked as such, and must not be misrepresented
unlicense | released into the public | this is free and unencumbered software released into the public domain
mpl-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public license
bsl-1.0 | obtaining a copy of the software and | to any person or organization obtaining a copy of the software and accompanying documentation
public-domain | public domain | (?:is|are|released|placed|dedicated) (?:hereby )?(?:in(?:to)?|to) the public domain
proprietary | all rights reserved | all rights reserved
proprietary | proprietary and confidential | proprietary and confidential
proprietary | unauthorized copying | unauthorized copying of this (?:file|document|work).{0,40}? is (?:strictly )?prohibited
noncommercial | non-commercial use only | for (?:personal,? )?non-commercial use only
gpl | gnu.org/ | gnu\.org/licenses/(?:old-licenses/)?gpl
lgpl | gnu.org/ | gnu\.org/licenses/(?:old-licenses/)?lgpl
agpl | gnu.org/ | gnu\.org/licenses/agpl
gfdl | gnu.org/ | gnu\.org/(?:licenses|copyleft)/fdl
apache-2.0 | apache.org/ | apache\.org/licenses/license-2\.0
apache | apache.org/ | apache\.org/licenses
mpl-2.0 | mozilla.org/ | mozilla\.org/mpl/2\.0
mpl | mozilla.org/ | mozilla\.org/mpl
epl | eclipse.org/ | eclipse\.org/legal/epl
mit | opensource.org/ | opensource\.org/licenses?/mit
bsd-2-clause | opensource.org/ | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | opensource.org/ | opensource\.org/licenses?/bsd-3-clause
isc | opensource.org/ | opensource\.org/licenses?/isc
unlicense | unlicense.org | unlicense\.org
wtfpl | wtfpl.net | wtfpl\.net
cc0-1.0 | creativecommons.org/ | creativecommons\.org/publicdomain/zero/1\.0
public-domain | creativecommons.org/ | creativecommons\.org/publicdomain/mark
cc-by-nc-nd | creativecommons.org/ | creativecommons\.org/licenses/by-nc-nd
cc-by-nc-sa | creativecommons.org/ | creativecommons\.org/licenses/by-nc-sa
cc-by-nc | creativecommons.org/ | creativecommons\.org/licenses/by-nc(?!-)
cc-by-nd | creativecommons.org/ | creativecommons\.org/licenses/by-nd
cc-by-sa | creativecommons.org/ | creativecommons\.org/licenses/by-sa
cc-by | creativecommons.org/ | creativecommons\.org/licenses/by(?!-)
odbl | opendatacommons.org/ | opendatacommons\.org/licenses/odbl
odc-by | opendatacommons.org/ | opendatacommons\.org/licenses/by
pddl | opendatacommons.org/ | opendatacommons\.org/licenses/pddl
ofl | scripts.sil.org/ | scripts\.sil\.org/ofl
ogl-uk | nationalarchives.gov.uk/ | nationalarchives\.gov\.uk/doc/open-government-licence
eupl | joinup.ec.europa.eu/ | joinup\.ec\.europa\.eu/.{0,40}?eupl
boost | boost.org/ | boost\.org/license_1_0
gpl | see the gnu | without even the implied warranty of merchantability or fitness for a particular purpose[.;,] see the gnu general public
lgpl | see the gnu | without even the implied warranty of merchantability or fitness for a particular purpose[.;,] see the gnu (?:lesser|library) general public
agpl | see the gnu | without even the implied warranty of merchantability or fitness for a particular purpose[.;,] see the gnu affero general public
gpl | received a copy of the gnu | you should have received a copy of the gnu general public licen[cs]e
lgpl | received a copy of the gnu | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
agpl | received a copy of the gnu | you should have received a copy of the gnu affero general public licen[cs]e
gpl-2.0 | licenses for most software | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | licenses for most software | the licenses for most software and other practical works are designed to take away your freedom
gpl-3.0 | free, copyleft license | is a free, copyleft license for software and other kinds of works
agpl-3.0 | network server software | specifically designed to ensure cooperation with the community in the case of network server software
lgpl-2.1 | specially designated software | applies to some specially designated software packages
lgpl-3.0 | supplemented by the additional | of version 3 of the gnu general public license, supplemented by the additional permissions
gnu | verbatim copies of this license | everyone is permitted to copy and distribute verbatim copies of this license document
gfdl | gnu free documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation
gfdl | no invariant sections | with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts
classpath-exception | special exception | as a special exception, the copyright holders of this library give you permission to link
font-exception | special exception | as a special exception, if you create a document which uses this font
bison-exception | special exception | as a special exception, you may create a larger work that contains part or all of the bison parser
autoconf-exception | special exception | as a special exception.{1,90}? a configuration script generated by autoconf
gcc-exception | gcc runtime library | gcc runtime library exception
linux-syscall-note | by normal system calls | does (?:\*not\*|not) cover user programs that use kernel services by normal system calls
llvm-exception | llvm exception | (?:apache.2\.0 with )?llvm exceptions?(?: to the apache 2\.0 license)?
apache-2.0 | without warranties or conditions | on an .as is. basis,? without warranties or conditions of any kind
apache-2.0 | each contributor hereby grants | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable
apache-2.0 | contributor license agreements | under one or more contributor license agreements
apache-1.1 | software developed by the apache | this product includes software developed by the apache (?:software foundation|group)
mit | this permission notice shall be | the above copyright notice and this permission notice shall be included in all copies
mit | authors or copyright holders be | in no event shall the authors or copyright holders be liable for any claim
x11 | of the x consortium | the name of the x consortium shall not be used in advertising
hpnd | in supporting documentation | copyright notice and this permission notice appear in supporting documentation
hpnd | makes no representations about | makes no representations about the suitability of this software for any purpose
isc | with regard to this software | the author disclaims all warranties with regard to this software
bsd | redistributions of source code | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
bsd | copyright holders and contributors | this software is provided by the copyright holders and contributors
bsd | regents and contributors | this software is provided by the regents and contributors
bsd-3-clause-clear | party's patent rights | no express or implied licenses to any party's patent rights are granted by this license
bsd-4-clause-uc | university of california | this product includes software developed by the university of california
openssl | openssl project | this product includes software developed by the openssl project
ssleay | cryptographic software | this product includes cryptographic software written by eric young
zlib | origin of this software | the origin of this software must not be misrepresented
zlib | without any express or implied | this software is provided .as.is.,? without any express or implied warranty
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
ftl | freetype project | portions of this software are copyright .{1,40}? the freetype project
unlicense | copy, modify, publish, use | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
beerware | buy me a beer | you can buy me a beer in return
cc0-1.0 | related or neighboring rights | waived all copyright and related or neighboring rights
mpl | subject to the mozilla public | the contents of this file are subject to the mozilla public license
mpl-2.0 | copy of the mpl was not | if a copy of the mpl was not distributed with this file
mpl-2.0-no-copyleft | incompatible with secondary | incompatible with secondary licenses
npl | subject to the netscape public | the contents of this file are subject to the netscape public license
epl | terms of the eclipse public | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | terms of this eclipse public | the accompanying program is provided under the terms of this eclipse public license
edl | terms of the eclipse distribution | made available under the terms of the eclipse distribution license
cpl | terms of this common public | the accompanying program is provided under the terms of this common public license
cddl | common development and distribution | subject to the terms of the common development and distribution license
cddl | this cddl header | when distributing covered (?:code|software), include this cddl header
artistic-1.0 | which a package may be copied | the conditions under which a package may be copied
artistic-2.0 | given free software package | the terms under which a given free software package may be copied
perl | same terms as perl | you can redistribute it and/or modify it under the same terms as perl itself
psf | psf is making python | psf is making python available to licensee
php | includes php software | this product includes php software, freely available from
postgresql | without a written agreement | for any purpose, without fee, and without a written agreement is hereby granted
ncsa | to deal with the software | to deal with the software without restriction
ms-pl | you accept this license | if you use the software, you accept this license
sspl | available to third parties | make the functionality of the program or a modified version available to third parties as a service
busl | additional use grant | additional use grant
busl | not an open source license | the business source license.{1,60}? is not an open source license
elastic-2.0 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | the right to sell the software | does not (?:include, and the license does not )?grant to you,? the right to sell the software
ofl | this font software is licensed | this font software is licensed under the sil open font license
ofl | reserved font name | with (?:no )?reserved font names?
unicode | unicode data files | the unicode data files and any associated documentation
json | shall be used for good | the software shall be used for good, not evil
w3c | using and/or copying this work | by obtaining, using and/or copying this work, you .{1,30}? agree
lppl | latex project public | may be distributed and/or modified under the conditions of the latex project public license
sleepycat | obtain complete source code | redistributions in any form must be accompanied by information on how to obtain complete source code
cc-by | give appropriate credit | you must give appropriate credit, provide a link to the license
cc-by-nc | for commercial purposes | you may not use the material for commercial purposes
cc-by-nd | distribute the modified material | you may not distribute the modified material
cc-by-sa | under the same license as | you must distribute your contributions under the same license as the original
creative-commons | creative commons | (?:lizenziert unter|steht unter) (?:einer )?creative commons
creative-commons | creative commons | sous (?:une )?licence creative commons
creative-commons | creative commons | bajo (?:una )?licencia (?:de )?creative commons
gpl | publique générale | licence publique générale gnu
gpl | pública general | licencia pública general (?:de )?gnu
odbl | under the open database license | made available under the open database license
odbl | database contents license | licensed under the database contents license
ogl-uk | public sector information | contains public sector information licensed under the open government licen[cs]e
crown-copyright | crown copyright | crown copyright (?:is )?reserved
us-government | united states government | work of the united states government
us-government | copyright protection in the united | not subject to copyright protection in the united states
openrail | use-based restrictions | use-based restrictions
llama | built with | built with (?:meta )?llama
proprietary | proprietary | contains (?:confidential and )?proprietary (?:and confidential )?information
proprietary | may be reproduced | no part of this (?:publication|document|work|book) may be reproduced
proprietary | written permission of | without the (?:prior |express |prior express )?written permission of
proprietary | licensed, not sold | licensed, not sold
proprietary | end user licen | end user licen[cs]e agreement
proprietary | evaluation purposes only | for evaluation purposes only
proprietary | internal use only | for internal use only
noncommercial | academic and non-commercial | for academic and non-commercial (?:use|purposes|research)
noncommercial | research purposes only | for (?:non-commercial )?research purposes only
gpl | gnu.org/ | gnu\.org/copyleft/gpl
lgpl | gnu.org/ | gnu\.org/copyleft/(?:lesser|lgpl)
apache-2.0 | opensource.org/ | opensource\.org/licenses?/apache-2\.0
artistic | opensource.org/ | opensource\.org/licenses?/artistic
gpl | opensource.org/ | opensource\.org/licenses?/gpl
lgpl | opensource.org/ | opensource\.org/licenses?/lgpl
afl | opensource.org/ | opensource\.org/licenses?/afl
osl | opensource.org/ | opensource\.org/licenses?/osl
ecl | opensource.org/ | opensource\.org/licenses?/ecl
mpl-2.0 | opensource.org/ | opensource\.org/licenses?/mpl-2\.0
epl-2.0 | opensource.org/ | opensource\.org/licenses?/epl-2\.0
zlib | opensource.org/ | opensource\.org/licenses?/zlib
0bsd | opensource.org/ | opensource\.org/licenses?/0bsd
postgresql | opensource.org/ | opensource\.org/licenses?/postgresql
php | php.net/license | php\.net/license
polyform | polyformproject.org/ | polyformproject\.org/licenses
cecill | cecill.info/ | cecill\.info/licen[cs]es
psf | python.org/ | python\.org/psf/license
elastic | elastic.co/licensing | elastic\.co/licensing
sspl | server-side-public-license | mongodb\.com/licensing/server-side-public-license
lppl | latex-project.org/ | latex-project\.org/lppl
etalab | etalab.gouv.fr/ | etalab\.gouv\.fr/.{0,40}?licence
dl-de | govdata.de/ | govdata\.de/dl-de
spdx-other | spdx-license-identifier | spdx-license-identifier: ?[a-z0-9.+-]+
"""

# Priorities: a notice or address tells most, a bare name least.
_WEIGHT = {5: 0.95, 4: 0.9, 3: 0.8, 2: 0.6, 1: 0.3}
_GRANT = r"(?:(?:re-?)?licen[cs]ed|released|distributed|available|published|provided|covered) (?:under|by|with) (?:the )?(?:terms of (?:the )?)?"


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern


#: Escapes, classes and dots of a pattern; a dot stands for one character or white space of any length.
_DOTS = re.compile(r"\\.|\[[^]]*\]|\.")


def _compiled(pattern: str) -> re.Pattern:
    pattern = pattern.replace(" ", r"\s+").replace(r"\s+?", r"\s*")
    pattern = _DOTS.sub(lambda m: r"(?:\S|\s++)" if m.group() == "." else m.group(), pattern)
    return re.compile(r"(?<![a-z0-9])" + pattern + r"(?![a-z0-9])")


def _lines(block: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in block.strip().splitlines()]


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All rules in their order. Each family gives, per version, a grant, a name with its
    version and an identifier, and without version a grant and a bare name."""
    found: dict[tuple[str, str], Rule] = {}

    def add(label: str, priority: int, keyword: str, pattern: str) -> None:
        found.setdefault((label, pattern), Rule(label, priority, keyword, _compiled(pattern)))

    for label, keyword, notice in _lines(_NOTICES):
        add(label, 2 if label in ("proprietary", "spdx-other") else 5, keyword, notice)
    for label, keyword, name, versions in _lines(_FAMILIES):
        for version in versions.split() if versions != "-" else []:
            full = version if "." in version else f"{version}.0"
            number = re.escape(full) if "." in version else rf"{version}(?:\.0)?"
            tail = rf"(?:,|-)? ?(?:\(?(?:v|version)\.? ?)?{number}(?: or (?:\(at your option\) )?(?:any )?later)?\+?"
            add(f"{label}-{full}", 4, keyword, _GRANT + name + tail)
            add(f"{label}-{full}", 3, keyword, name + tail)
            add(f"{label}-{full}", 3, "spdx", rf"spdx-license-identifier: ?{re.escape(label)}-{re.escape(full)}(?:-only|-or-later)?")
        add(label, 3, keyword, _GRANT + name)
        add(label, 1, keyword, name)
        add(label, 3, "spdx", rf"spdx-license-identifier: ?{re.escape(label)}")
    return sorted(found.values(), key=lambda rule: -rule.priority)


@lru_cache(maxsize=1)
def _prefilter() -> tuple[ahocorasick.Automaton, dict[str, list[Rule]]]:
    gated = defaultdict(list)
    for rule in rules():
        gated[rule.keyword].append(rule)
    automaton = ahocorasick.Automaton()
    for keyword in gated:
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    return automaton, gated


#: Runs of ASCII white space other than one blank.
_BLANKS = re.compile(r"[\t-\r\x1c-\x20]{2,}|[\t-\r\x1c-\x1f]")


#: The keyword "cc by" takes any one sign or white space of any length between its words, as its rules do.
_CC_BY = re.compile(r"cc(?:\S|\s++)by")


def candidates(text: str) -> list[Rule]:
    """The rules to try on a lower-cased text. White space beyond ASCII, which is part of
    words in the contract, separates no words of a keyword."""
    text = _BLANKS.sub(" ", text)
    automaton, gated = _prefilter()
    keywords = {word for _, word in automaton.iter(text)}
    if "cc" in text and _CC_BY.search(text):
        keywords.add("cc by")
    return [rule for keyword in keywords for rule in gated[keyword]]


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """The kept detections of a lower-cased text, by start."""
    found = [(match.start(), match.end(), rule) for rule in candidates(text) for match in rule.pattern.finditer(text)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    longest = max((end - start for start, end, _ in found), default=0)
    kept: list[tuple[int, int, Rule]] = []
    intervals: list[tuple[int, int]] = []  # of those kept, by start
    for start, end, rule in found:
        near = slice(bisect_left(intervals, (end - longest, 0)), bisect_right(intervals, (start, math.inf)))
        if not any(end <= b for _, b in intervals[near]):
            kept.append((start, end, rule))
            insort(intervals, (start, end))
    return sorted(kept, key=lambda d: (d[0], d[1]))


def _base(words: list[str], text: str) -> tuple[int, int | None, int | None, set[str]]:
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        if not all(word in text for word in phrase):
            continue
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if tuple(words[at: at + len(phrase)]) == phrase:
                    places.append(at)
                    labels.add(label)
        except ValueError:
            pass
    return len(places), min(places, default=None), max(places, default=None), labels


RESULT = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_base", T.LongType(), False),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType(), False),
    T.StructField("labels", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("detections", T.StringType(), False),
])


def scan_text(text: str | None) -> tuple:
    text = lowered(text or "")
    words = WORD.findall(text)
    n_base, first, last, base = _base(words, text)
    found = detections(text)
    doubt = 1.0
    for priority in [rule.priority for _, _, rule in found] + [3] * n_base:
        doubt *= 1 - _WEIGHT[priority]
    labels = base | {rule.label for _, _, rule in found}
    spans = ",".join(f"{rule.label}:{start}:{end}" for start, end, rule in found)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, spans


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licenses named in each text; one row per row of ``docs``.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    detections (label:start:end of each kept rule, by start, in characters of the text).
    Null or empty text: no words, no labels, score 0. Whole texts are read, whatever their
    length. Repeated rows and null ids stay as they are; an empty table gives no rows.
    Equal intervals of equal priority: the label first in the alphabet is kept. Other
    columns are not read. One scan, no shuffle.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *RESULT.fields])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            columns = list(zip(*map(scan_text, batch.column(1).to_pylist()), strict=True)) or [()] * len(RESULT)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))],
                schema=arrow,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
