"""The signature rules of the license scan, in order: label, priority, keyword, pattern.

Patterns run over lower-cased words with one space between them; `(?: ...)?` groups carry the
space of the words they hold. A rule is tried only in texts that contain its keyword. Among
detections of overlapping words, those inside another of the same or a higher priority go.
Priority 3: tags and full notices; 2: name with version; 1: name alone; 0: hints.
"""

from __future__ import annotations

# label | keyword | names, the longer first | versions
FAMILIES = """
apache | apache | apache (?:software )?licen[cs]e;asl | 1 0;1 1;2 0
gpl | general public licen | (?:gnu )?general public licen[cs]e | 1;2;3
lgpl | lesser general public | (?:gnu )?lesser general public licen[cs]e | 2;2 1;3
agpl | affero | (?:gnu )?affero general public licen[cs]e | 1;3
gfdl | free documentation | (?:gnu )?free documentation licen[cs]e | 1 1;1 2;1 3
mpl | mozilla public | mozilla public licen[cs]e | 1 0;1 1;2 0
epl | eclipse public | eclipse public licen[cs]e | 1 0;2 0
eupl | european union public | european union public licen[cs]e | 1 0;1 1;1 2
cddl | common development | common development and distribution licen[cs]e | 1 0;1 1
cpl | common public | common public licen[cs]e | 0 5;1 0
artistic | artistic | (?:the )?artistic licen[cs]e | 1 0;2 0
osl | open software | open software licen[cs]e | 1 0;2 0;2 1;3 0
afl | academic free | academic free licen[cs]e | 1 1;1 2;2 0;2 1;3 0
ofl | open font | (?:sil )?open font licen[cs]e | 1 0;1 1
bsl | boost software | boost software licen[cs]e | 1 0
busl | business source | business source licen[cs]e | 1 0;1 1
sspl | server side public | server side public licen[cs]e | 1
zpl | zope public | zope public licen[cs]e | 1 1;2 0;2 1
php | php licen | php licen[cs]e | 3 0;3 01
psf | python software | python software foundation licen[cs]e | 2
lppl | project public | latex project public licen[cs]e | 1 0;1 1;1 2;1 3;1 3a;1 3c
npl | netscape public | netscape public licen[cs]e | 1 0;1 1
qpl | q public | q public licen[cs]e | 1 0
rpl | reciprocal public | reciprocal public licen[cs]e | 1 1;1 5
cecill | cecill | (?:licence )?cecill(?: licen[cs]e)? | 1 0;1 1;2 0;2 1
odbl | open database | open (?:data commons )?(?:open )?database licen[cs]e | 1 0
odc-by | attribution licen | open data commons attribution licen[cs]e | 1 0
pddl | public domain dedication | (?:open data commons )?public domain dedication and licen[cs]e | 1 0
ecl | educational community | educational community licen[cs]e | 1 0;2 0
upl | universal permissive | universal permissive licen[cs]e | 1 0
mulan | mulan | mulan (?:permissive software|psl|pubL) licen[cs]e | 1;2
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e | 1
ms-pl | microsoft public | microsoft public licen[cs]e | 1
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e | 1
apsl | apple public | apple public source licen[cs]e | 1 0;1 1;1 2;2 0
sgi-b | sgi free | sgi free software licen[cs]e b | 1 0;1 1;2 0
w3c | w3c | w3c software (?:notice and )?licen[cs]e | 1
cal | cryptographic autonomy | cryptographic autonomy licen[cs]e | 1 0
polyform | polyform | polyform (?:noncommercial|small business|shield|strict) licen[cs]e | 1 0 0
elastic | elastic licen | elastic licen[cs]e | 1;2 0;2
openrail | openrail | (?:creativeml |bigscience |bigcode )?(?:open ?rail(?: m)?|openrail m) licen[cs]e | 1
llama | llama | llama (?:[0-9] )?community licen[cs]e | 1
"""

# label | priority | keyword | pattern
SINGLE = """
mit | 2 | mit licen | (?:released |licensed |available )?under (?:the )?(?:terms of the )?mit licen[cs]e
mit | 1 | mit licen | (?:the )?mit licen[cs]e
mit | 1 | expat | expat licen[cs]e
mit | 3 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | 2 | to deal in the | to deal in the software without restriction
mit | 2 | the above copyright | the above copyright notice and this permission notice shall be included in all copies
mit-0 | 3 | mit no attribution | mit no attribution(?: licen[cs]e)?
isc | 1 | isc licen | (?:the )?isc licen[cs]e
isc | 3 | permission to use copy | permission to use copy modify and or distribute this software for any purpose
bsd-2-clause | 2 | bsd | (?:simplified bsd|freebsd|2 clause bsd|bsd 2 clause|two clause bsd)(?: licen[cs]e)?
bsd-3-clause | 2 | bsd | (?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause|three clause bsd)(?: licen[cs]e)?
bsd-4-clause | 2 | bsd | (?:original bsd|old bsd|4 clause bsd|bsd 4 clause|four clause bsd)(?: licen[cs]e)?
0bsd | 2 | bsd | (?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)?
bsd | 1 | bsd licen | bsd (?:style )?licen[cs]e
bsd | 3 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 3 | neither the name | neither the name of .{1,80} nor the names of its contributors
bsd-4-clause | 3 | advertising materials | all advertising materials mentioning features or use of this software
bsd | 2 | this software is provided | this software is provided by the (?:copyright holders|regents|author) .{0,40}as is
zlib | 1 | zlib | zlib (?:libpng )?licen[cs]e
zlib | 3 | altered source versions | altered source versions must be plainly marked as such
unlicense | 1 | unlicense | (?:the )?unlicense
unlicense | 3 | free and unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 1 | wtfpl | wtfpl
wtfpl | 3 | do what the | do what the fuck you want to public licen[cs]e
cc0 | 2 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0 | 2 | public domain dedication | creative commons (?:zero|public domain dedication)
public-domain | 1 | public domain | (?:in|into|to|of) the public domain
public-domain | 2 | public domain | (?:dedicated|released|placed|belongs) (?:in|into|to) the public domain
public-domain | 0 | public domain | public domain
all-rights-reserved | 2 | all rights reserved | copyright .{1,60} all rights reserved
copyright | 0 | copyright | (?:c )?copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright | 0 | copyright | copyright (?:holder|owner|notice)s?
proprietary | 2 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 1 | unauthorized | unauthorized (?:copying|reproduction|distribution|use) .{0,60}(?:prohibited|forbidden)
proprietary | 1 | may not be reproduced | may not be reproduced .{0,60}without (?:the )?(?:prior )?(?:written )?permission
proprietary | 1 | trade secret | trade secrets? of
commercial | 1 | commercial licen | (?:under a |a )?commercial licen[cs]e
noncommercial | 1 | commercial | (?:for )?non ?commercial (?:use|purposes)(?: only)?
noncommercial | 1 | commercial | not (?:be used )?for commercial (?:use|purposes)
evaluation | 1 | evaluation | for evaluation purposes only
research-only | 1 | research | for research (?:use|purposes) only
eula | 1 | end user licen | end user licen[cs]e agreement
gpl | 1 | gnu gpl | gnu gpl
gpl-2.0 | 2 | gpl | gpl ?v ?2(?: 0)?
gpl-3.0 | 2 | gpl | gpl ?v ?3(?: 0)?
lgpl-2.1 | 2 | lgpl | lgpl ?v ?2(?: 1)?
lgpl-3.0 | 2 | lgpl | lgpl ?v ?3(?: 0)?
lgpl | 1 | library general public | (?:gnu )?library general public licen[cs]e
agpl-3.0 | 2 | agpl | agpl ?v ?3(?: 0)?
gpl-or-later | 2 | any later version | (?:either )?version [0-9](?: [0-9])? of the licen[cs]e or at your option any later version
gpl | 3 | free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl | 3 | free software | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e
gpl | 2 | without even the implied | without even the implied warranty of merchantability or fitness for a particular purpose
gpl-exception | 2 | linking exception | (?:classpath|gcc runtime library|linking) exception
apache-2.0 | 3 | apache licen | licensed under the apache licen[cs]e version 2 0(?: the licen[cs]e)?
apache-2.0 | 2 | apache org licenses | (?:http |https )?(?:www )?apache org licenses licen[cs]e 2 0
apache-2.0 | 2 | apache | apache 2(?: 0)?(?: licen[cs]e)?
mpl-2.0 | 3 | mozilla public | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0 | 2 | mpl | mpl 2 0
epl-2.0 | 2 | epl | epl v?2 0
warranty | 0 | warrant | without warrant(?:y|ies)(?: or conditions)? of any kind
warranty | 0 | as is | provided as is without
permissive | 0 | permission | used with (?:the )?permission
attribution | 0 | attribution | attribution (?:is )?required
spdx | 1 | spdx | spdx licen[cs]e identifier
cc | 0 | creative commons | creative commons(?: licen[cs]e)?
fair-use | 0 | fair use | (?:under )?fair use
crown | 2 | crown copyright | crown copyright
ogl | 2 | open government | open government licen[cs]e(?: v ?[0-9](?: 0)?)?
gfdl | 2 | copyleft | copyleft
arxiv | 2 | arxiv | arxiv (?:org )?(?:perpetual )?non exclusive licen[cs]e
beerware | 2 | beer | (?:the )?beer ?ware licen[cs]e
vim | 2 | vim licen | vim licen[cs]e
ruby | 2 | ruby licen | ruby licen[cs]e
openssl | 2 | openssl | (?:dual )?openssl(?: and ssleay)? licen[cs]e
curl | 2 | curl licen | curl licen[cs]e
imagemagick | 2 | imagemagick | imagemagick licen[cs]e
json | 2 | used for good | shall be used for good not evil
gemma | 2 | gemma | gemma terms of use
"""

SPDX = (
    "0bsd afl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause "
    "bsd-4-clause bsl-1.0 busl-1.1 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-4.0 "
    "cc0-1.0 cddl-1.0 cecill-2.1 ecl-2.0 epl-1.0 epl-2.0 eupl-1.2 gfdl-1.3-or-later gpl-2.0-only gpl-2.0-or-later "
    "gpl-3.0-only gpl-3.0-or-later isc lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later mit mit-0 "
    "mpl-1.1 mpl-2.0 ms-pl ms-rl ncsa odbl-1.0 ofl-1.1 osl-3.0 postgresql psf-2.0 unlicense upl-1.0 wtfpl zlib"
).split()

CC_PARTS = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: Every pattern holds one of these; a text without any is not looked at further.
STEMS = ["licen", "copy", "public", "rights", "bsd", "permi", "spdx", " cc", "gpl", "apache", "warrant", "as is"]
STEMS += ["proprietary", "confidential", "unauthorized", "trade secret", "commercial", "evaluation", "research"]
STEMS += ["unencumbered", "wtfpl", "do what the", "to deal in the", "source", "materials", "neither the name"]
STEMS += ["this software", "creative", "attribution", "fair use", "arxiv", "used for", "gemma", "mpl", "epl"]
STEMS += ["later version", "exception", "cecill", "mulan", "ncsa", "openrail", "llama", "w3c", "expat", "zlib"]


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) of every rule, in order."""
    out = []
    for line in SINGLE.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | "))
        out.append((label, int(priority), keyword, pattern))
    for line in FAMILIES.strip().splitlines():
        label, keyword, names, versions = (x.strip() for x in line.split(" | "))
        for name in names.split(";"):
            name = name.strip()
            for v in versions.split(";"):
                full = f"{label}-{v.replace(' ', '.')}"
                out.append((full, 2, keyword, rf"{name}(?: version| v)? (?:v)?{v}"))
            out.append((label, 1, keyword, name))
    for parts in CC_PARTS:
        label = "cc-" + parts.replace(" ", "-")
        spelled = " ".join(CC_WORDS[p] for p in parts.split())
        out.append((label, 1, "creative commons", f"creative commons {spelled}(?: international| unported)?"))
        for v in CC_VERSIONS:
            out.append((f"{label}-{v.replace(' ', '.')}", 2, "cc ", f"cc {parts} {v}"))
        out.append((label + "-4.0", 2, "creative commons", f"creative commons {spelled} 4 0 international"))
    for x in SPDX:
        words = x.replace("-", " ").replace(".", " ")
        out.append((x, 3, "spdx", f"spdx licen[cs]e identifier {words}"))
    return out
