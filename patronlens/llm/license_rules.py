"""Signature rules for licences, written by hand over words in lower case, one blank between words.

A line of ``NAMES`` or ``CLAUSES`` is: label | keyword | regular expression. The keyword is a word, or part of one,
that every match holds; a text without it is not searched. Names are found alone, in a grant ("licensed under
..."), and as an identifier tag made of the label. The syntax is what Java and RE2 share.
"""

from __future__ import annotations

from typing import NamedTuple

# Phrases whose places are always counted, and their labels.
BASE = """
gpl | gnu | gnu general public license
apache | apache | apache license
cc-by | cc | cc by
mit | mit | mit license
"""

NAMES = """
gpl-1.0 | general public | (gnu )?general public licen[sc]e( version| v)? 1( 0)?
gpl-2.0 | general public | (gnu )?general public licen[sc]e( version| v)? 2( 0)?
gpl-3.0 | general public | (gnu )?general public licen[sc]e( version| v)? 3( 0)?
gpl-2.0 | gpl | (gnu )?gpl( v| version)? 2( 0)?
gpl-2.0 | gplv2 | (gnu )?gplv2
gpl-3.0 | gpl | (gnu )?gpl( v| version)? 3( 0)?
gpl-3.0 | gplv3 | (gnu )?gplv3
gpl | gpl | gnu gpl|gpl licen[sc]ed?
lgpl-2.0 | lesser | (gnu )?(lesser|library) general public licen[sc]e( version| v)? 2( 0)?
lgpl-2.0 | library general | (gnu )?library general public licen[sc]e( version| v)? 2( 0)?
lgpl-2.1 | lesser | (gnu )?lesser general public licen[sc]e( version| v)? 2 1
lgpl-3.0 | lesser | (gnu )?lesser general public licen[sc]e( version| v)? 3( 0)?
lgpl-2.1 | lgpl | (gnu )?lgpl( v| version)? 2 1|lgplv2 1
lgpl-3.0 | lgpl | (gnu )?lgpl( v| version)? 3( 0)?|lgplv3
lgpl | lesser | gnu lesser general public licen[sc]e
agpl-1.0 | affero | affero general public licen[sc]e( version| v)? 1( 0)?
agpl-3.0 | affero | (gnu )?affero general public licen[sc]e( version| v)? 3( 0)?
agpl-3.0 | agpl | (gnu )?agpl( v| version)? 3( 0)?|agplv3
agpl | affero | (gnu )?affero general public licen[sc]e
gfdl-1.1 | free documentation | (gnu )?free documentation licen[sc]e( version| v)? 1 1
gfdl-1.2 | free documentation | (gnu )?free documentation licen[sc]e( version| v)? 1 2
gfdl-1.3 | free documentation | (gnu )?free documentation licen[sc]e( version| v)? 1 3
gfdl | free documentation | (gnu )?free documentation licen[sc]e
apache-1.0 | apache | apache (software )?licen[sc]e( version| v)? 1( 0)?
apache-1.1 | apache | apache (software )?licen[sc]e( version| v)? 1 1
apache-2.0 | apache | apache (software )?licen[sc]e( version| v)? 2( 0)?
apache-2.0 | apache | apache 2( 0)? licen[sc]ed?
mit | mit | (the )?mit licen[sc]e
mit | mit | mit licen[sc]ed
mit | mit | mit x11 licen[sc]e
mit-0 | mit | mit (no attribution|0) licen[sc]e
x11 | x11 | x11 licen[sc]e
bsd-1-clause | bsd | bsd (1|one) clause( licen[sc]e)?|(1|one) clause bsd( licen[sc]e)?
bsd-2-clause | bsd | bsd (2|two) clause( licen[sc]e)?|(2|two) clause bsd( licen[sc]e)?
bsd-3-clause | bsd | bsd (3|three) clause( licen[sc]e)?|(3|three) clause bsd( licen[sc]e)?
bsd-4-clause | bsd | bsd (4|four) clause( licen[sc]e)?|(4|four) clause bsd( licen[sc]e)?
0bsd | bsd | zero clause bsd( licen[sc]e)?|bsd zero clause( licen[sc]e)?
bsd-2-clause | bsd | (simplified|freebsd) bsd licen[sc]e
bsd-3-clause | bsd | (new|revised|modified) bsd licen[sc]e
bsd-4-clause | bsd | original bsd licen[sc]e
bsd | bsd | bsd (style )?licen[sc]e
isc | isc | isc licen[sc]e
mpl-1.0 | mozilla | mozilla public licen[sc]e( version| v)? 1( 0)?
mpl-1.1 | mozilla | mozilla public licen[sc]e( version| v)? 1 1
mpl-2.0 | mozilla | mozilla public licen[sc]e( version| v)? 2( 0)?
mpl | mozilla | mozilla public licen[sc]e
mpl-2.0 | mpl | mpl( v| version)? 2( 0)?
mpl-2.0 | mplv2 | mplv2
epl-1.0 | eclipse | eclipse public licen[sc]e( version| v)? 1( 0)?
epl-2.0 | eclipse | eclipse public licen[sc]e( version| v)? 2( 0)?
epl | eclipse | eclipse public licen[sc]e
edl-1.0 | eclipse | eclipse distribution licen[sc]e
cddl-1.0 | common development | common development and distribution licen[sc]e( version| v)? 1( 0)?
cddl-1.1 | common development | common development and distribution licen[sc]e( version| v)? 1 1
cddl | cddl | cddl licen[sc]ed?
cpl-1.0 | common public | common public licen[sc]e( version| v)?( 1 0)?
cpal-1.0 | common public attribution | common public attribution licen[sc]e( version| v)?( 1 0)?
eupl-1.1 | european union | european union public licen[sc]e( version| v)? 1 1
eupl-1.2 | european union | european union public licen[sc]e( version| v)? 1 2
eupl | eupl | eupl( licen[sc]ed?)?
ms-pl | microsoft | microsoft public licen[sc]e
ms-rl | microsoft | microsoft reciprocal licen[sc]e
artistic-1.0 | artistic | artistic licen[sc]e( version| v)? 1( 0)?
artistic-2.0 | artistic | artistic licen[sc]e( version| v)? 2( 0)?
artistic | artistic | (perl )?artistic licen[sc]e
bsl-1.0 | boost | boost software licen[sc]e( version| v)?( 1 0)?
busl-1.1 | business source | business source licen[sc]e( version| v)?( 1 1)?
sspl-1.0 | server side | server side public licen[sc]e( version| v)?( 1)?
elastic-2.0 | elastic | elastic licen[sc]e( version| v)?( 2 0)?
unlicense | unlicense | (the )?unlicense
wtfpl | wtfpl | wtfpl( licen[sc]e)?
wtfpl | what the | do what the f[a-z]+ you want to public licen[sc]e
zlib | zlib | zlib licen[sc]e|zlib libpng licen[sc]e
libpng | libpng | libpng licen[sc]e
openssl | openssl | openssl licen[sc]e
ssleay | ssleay | (original )?ssleay licen[sc]e
python-2.0 | python | python software foundation licen[sc]e( version| v)?( 2)?
psf-2.0 | psf | psf licen[sc]e( agreement)?
php-3.01 | php | php licen[sc]e( version| v)?( 3 01)?
ruby | ruby | ruby licen[sc]e
w3c | w3c | w3c (software |document )?(notice and )?licen[sc]e
ofl-1.0 | open font | (sil )?open font licen[sc]e( version| v)? 1 0
ofl-1.1 | open font | (sil )?open font licen[sc]e( version| v)? 1 1
ofl | open font | (sil )?open font licen[sc]e
postgresql | postgresql | postgresql licen[sc]e
ncsa | ncsa | (university of illinois )?ncsa (open source )?licen[sc]e
afl-3.0 | academic free | academic free licen[sc]e( version| v)?( 3 0)?
osl-3.0 | open software | open software licen[sc]e( version| v)?( 3 0)?
ecl-2.0 | educational community | educational community licen[sc]e( version| v)?( 2 0)?
qpl-1.0 | q public | q public licen[sc]e
ipl-1.0 | ibm public | ibm public licen[sc]e
spl-1.0 | sun public | sun public licen[sc]e
npl-1.1 | netscape | netscape public licen[sc]e
apsl-2.0 | apple public | apple public source licen[sc]e
lppl-1.3c | latex project | latex project public licen[sc]e
vim | vim | vim licen[sc]e
curl | curl | curl licen[sc]e
icu | icu | icu licen[sc]e
unicode | unicode | unicode (inc )?licen[sc]e( agreement)?
upl-1.0 | universal permissive | universal permissive licen[sc]e( version| v)?( 1 0)?
blueoak-1.0.0 | blue oak | blue oak model licen[sc]e
cecill-2.1 | cecill | cecill( licen[sc]e)?( version| v)?( 2 1)?
mulan-psl-2.0 | mulan | mulan (psl|permissive software licen[sc]e)( version| v)?( 2)?
beerware | beerware | beerware( licen[sc]e)?|beer ware licen[sc]e
json | json | json licen[sc]e
odbl-1.0 | open database | open database licen[sc]e( version| v)?( 1 0)?
odc-by-1.0 | open data commons | open data commons attribution licen[sc]e
pddl-1.0 | public domain dedication | public domain dedication and licen[sc]e
ogl-3.0 | open government | open government licen[sc]e( version| v)?( 3( 0)?)?
cc0-1.0 | cc0 | cc0( 1 0)?( universal)?
cc-by-1.0 | cc | cc by 1 0
cc-by-2.0 | cc | cc by 2 0
cc-by-2.5 | cc | cc by 2 5
cc-by-3.0 | cc | cc by 3 0
cc-by-4.0 | cc | cc by 4 0
cc-by-sa-2.0 | cc | cc by sa 2 0
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-sa | cc | cc by sa
cc-by-nc-2.0 | cc | cc by nc 2 0
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc | cc | cc by nc
cc-by-nd-3.0 | cc | cc by nd 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nd | cc | cc by nd
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-nc-nd | cc | cc by nc nd
cc-by-4.0 | creative commons | creative commons attribution( international)?( licen[sc]e)? 4 0( international)?( licen[sc]e)?
cc-by-3.0 | creative commons | creative commons attribution( licen[sc]e)? 3 0( unported)?( licen[sc]e)?
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0( international)?( licen[sc]e)?
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0( unported)?( licen[sc]e)?
cc-by-sa | creative commons | creative commons attribution share ?alike( licen[sc]e)?
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial 4 0( international)?( licen[sc]e)?
cc-by-nc | creative commons | creative commons attribution non ?commercial( licen[sc]e)?
cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv(ative)?s( works)? 4 0( international)?( licen[sc]e)?
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0( international)?( licen[sc]e)?
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?( licen[sc]e)?
cc-by | creative commons | creative commons attribution( licen[sc]e)?
cc0-1.0 | creative commons | creative commons (cc0|zero)( 1 0)?( universal)?
cc | creative commons | creative commons licen[sc]e
llama-community | llama | llama( [0-9]+){0,2} community licen[sc]e( agreement)?
openrail | rail | (bigscience |creativeml |bigcode )?open ?rail( m)?( licen[sc]e)?
gemma | gemma | gemma (terms of use|licen[sc]e)
proprietary | all rights | all rights reserved
public-domain | public domain | (released into|dedicated to|in|placed in) the public domain
"""

CLAUSES = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | substantial portions | copies or substantial portions of the software
mit | above copyright notice | the above copyright notice and this permission notice shall be included
isc | permission to use | permission to use copy modify and or distribute this software for any purpose
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification
bsd | redistributions of source | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software
disclaimer | as is | (is )?provided (by( [a-z]+){1,6} )?as is without warranty of any kind
disclaimer | merchantability | warranties of merchantability fitness for a particular purpose
disclaimer | merchantability | implied warranty of merchantability or fitness for a particular purpose
disclaimer | in no event | in no event shall the (authors|copyright holders?|contributors)( or( [a-z]+){1,6})? be liable
disclaimer | any express | any express or implied warranties
gpl | free software | this (program|library|file) is free software
gpl | redistribute it | you can redistribute it and or modify it under the terms of
gpl | hope that it | in the hope that it will be useful but without any warranty
gpl | received a copy | you should have received a copy of the gnu general public licen[sc]e
lgpl | received a copy | you should have received a copy of the gnu lesser general public licen[sc]e
agpl | received a copy | you should have received a copy of the gnu affero general public licen[sc]e
gpl-or-later | any later version | or (at your option )?any later version
gpl-or-later | at your option | at your option any later version
apache-2.0 | in compliance with | you may not use this file except in compliance with the licen[sc]e
apache-2.0 | apache org licenses | apache org licenses licen[sc]e 2 0
apache-2.0 | agreed to in writing | unless required by applicable law or agreed to in writing
apache-2.0 | grant of patent | grant of patent licen[sc]e
apache-2.0 | grant of copyright | grant of copyright licen[sc]e
mpl-2.0 | source code form | this source code form is subject to the terms of
mpl-2.0 | mozilla org mpl | mozilla org mpl 2 0
epl-2.0 | eclipse org legal | eclipse org legal epl (v )?2(0| 0)?
cc-by | creativecommons org | creativecommons org licenses by [0-9] [0-9]
cc-by-sa | creativecommons org | creativecommons org licenses by sa [0-9] [0-9]
cc-by-nc | creativecommons org | creativecommons org licenses by nc [0-9] [0-9]
cc-by-nd | creativecommons org | creativecommons org licenses by nd [0-9] [0-9]
cc-by-nc-sa | creativecommons org | creativecommons org licenses by nc sa [0-9] [0-9]
cc-by-nc-nd | creativecommons org | creativecommons org licenses by nc nd [0-9] [0-9]
cc0-1.0 | creativecommons org | creativecommons org publicdomain zero 1 0
unlicense | unencumbered | free and unencumbered software released into the public domain
unlicense | unlicense org | unlicense org
zlib | altered source | altered source versions must be plainly marked as such
zlib | origin of this | the origin of this software must not be misrepresented
bsl-1.0 | object code | permission is hereby granted free of charge to any person or organization obtaining
ofl | reserved font | reserved font name
artistic | standard version | the standard version of the package
postgresql | without a written | without fee and without a written agreement is hereby granted
ncsa | with the software without | deal with the software without restriction
wtfpl | everyone is permitted | everyone is permitted to copy and distribute verbatim or modified copies
beerware | buy me a beer | you can buy me a beer in return
proprietary | confidential | proprietary and confidential
proprietary | unauthorized | unauthorized (copying|reproduction|distribution|use)( [a-z]+){0,4} is (strictly )?prohibited
proprietary | end user | end user licen[sc]e agreement
proprietary | without the prior | without the prior written (permission|consent) of
proprietary | may not be reproduced | may not be reproduced( [a-z]+){0,6} without( [a-z]+){0,2} permission
non-commercial | commercial | for non ?commercial (use|purposes)( only)?
non-commercial | commercial | not for commercial use
research-only | research | for (academic|research) (use|purposes) only
share-alike | same licen | (distribute|share|release)( [a-z]+){0,6} under the same licen[sc]e
attribution | appropriate credit | you must give appropriate credit
gfdl | invariant sections | with no invariant sections
odbl-1.0 | opendatacommons | opendatacommons org licenses odbl
ogl-3.0 | nationalarchives | nationalarchives gov uk doc open government licence
copyright-notice | copyright | copyright (c )?(19|20)[0-9]{2}
licence-reference | see licen | see (the )?licen[sc]e (file|txt|md)( for details)?
"""

GRANT = "(licen[sc]ed|released|distributed|published|available|issued) under (the )?(terms of )?(the )?"
PRIORITY = {"base": 0, "name": 1, "clause": 1, "grant": 2, "tag": 3}
WEIGHT = {"base": 60, "clause": 80, "name": 85, "grant": 95, "tag": 100}


class Rule(NamedTuple):
    kind: str
    label: str
    keyword: str
    regex: str

    @property
    def priority(self) -> int:
        return PRIORITY[self.kind]

    @property
    def weight(self) -> int:
        return WEIGHT[self.kind]


def _lines(kind: str, text: str) -> list[Rule]:
    return [Rule(kind, *(part.strip() for part in line.split(" | "))) for line in text.strip().splitlines()]


def _tag(label: str) -> Rule:
    return Rule("tag", label, "spdx", "spdx licen[sc]e identifier " + " ".join(label.replace(".", "-").split("-")))


def all_rules() -> list[Rule]:
    names = _lines("name", NAMES)
    grants = [Rule("grant", r.label, r.keyword, f"{GRANT}({r.regex})") for r in names]
    tags = [_tag(label) for label in dict.fromkeys(r.label for r in names)]
    return _lines("base", BASE) + names + grants + tags + _lines("clause", CLAUSES)
