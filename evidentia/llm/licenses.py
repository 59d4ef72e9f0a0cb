"""License scan by ordered signature rules.

A text is lower-cased (A-Z) and cut into words. Words that begin a rule's
pattern are the keyword gate: only there are the rules of that keyword tried, as
a regular expression anchored at the word. A detection is an interval of words
with a label and a priority. A detection that lies within an earlier or longer
one of the same or a higher priority is suppressed; between equal intervals the
rule that comes first wins. Base phrases are reported wherever they stand.

All of it is SQL expressions on one row. Nulls are empty texts, which have no
words, no labels and score 0. Repeated rows get equal results. Other columns
are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import let

#: The phrases that are always reported, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Names of licenses as words, by label. The first word of each is a literal keyword.
NAMES = {
    "gpl": ["gnu general public licen[cs]e", "gnu gpl", "gpl"],
    "lgpl": ["gnu (?:lesser|library) general public licen[cs]e", "gnu lgpl", "lgpl"],
    "agpl": ["gnu affero general public licen[cs]e", "affero general public licen[cs]e", "agpl"],
    "gfdl": ["gnu free documentation licen[cs]e", "gfdl"],
    "apache": ["apache (?:software )?licen[cs]e", "apache 2 0"],
    "mit": ["mit licen[cs]e", "mit style licen[cs]e", "expat licen[cs]e"],
    "x11": ["x11 licen[cs]e"],
    "bsd": ["bsd (?:style )?licen[cs]e", "berkeley software distribution licen[cs]e"],
    "bsd-2": ["bsd 2 clause", "simplified bsd", "freebsd licen[cs]e"],
    "bsd-3": ["bsd 3 clause", "revised bsd", "modified bsd"],
    "bsd-4": ["bsd 4 clause", "original bsd"],
    "mpl": ["mozilla public licen[cs]e", "mpl"],
    "epl": ["eclipse public licen[cs]e"],
    "edl": ["eclipse distribution licen[cs]e"],
    "cddl": ["common development and distribution licen[cs]e", "cddl"],
    "cpl": ["common public licen[cs]e"],
    "eupl": ["european union public licen[cs]e", "eupl"],
    "isc": ["isc licen[cs]e"],
    "zlib": ["zlib licen[cs]e", "zlib libpng licen[cs]e"],
    "boost": ["boost software licen[cs]e"],
    "unlicense": ["unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public licen[cs]e"],
    "artistic": ["artistic licen[cs]e"],
    "psf": ["python software foundation licen[cs]e", "psf licen[cs]e"],
    "ofl": ["sil open font licen[cs]e", "open font licen[cs]e"],
    "openssl": ["openssl licen[cs]e"],
    "ms-pl": ["microsoft public licen[cs]e"],
    "ms-rl": ["microsoft reciprocal licen[cs]e"],
    "ecl": ["educational community licen[cs]e"],
    "afl": ["academic free licen[cs]e"],
    "osl": ["open software licen[cs]e"],
    "postgresql": ["postgresql licen[cs]e"],
    "w3c": ["w3c software notice and licen[cs]e", "w3c licen[cs]e"],
    "php": ["php licen[cs]e"],
    "odbl": ["open database licen[cs]e", "odbl"],
    "odc-by": ["open data commons attribution licen[cs]e"],
    "pddl": ["public domain dedication and licen[cs]e"],
    "cc0": ["cc0", "creative commons zero", "cc zero"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-sa": ["cc by sa", "creative commons attribution share ?alike"],
    "cc-by-nd": ["cc by nd", "creative commons attribution no ?deriv\\w*"],
    "cc-by-nc": ["cc by nc", "creative commons attribution non ?commercial"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution non ?commercial share ?alike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution non ?commercial no ?deriv\\w*"],
    "public-domain": ["public domain"],
    "proprietary": ["all rights reserved"],
}

#: A version after a name: two numbers and their parts at most.
_VERSION = r"(?: version| v)? v?[0-9]+(?: [0-9]+){0,2}(?: only| or later| or any later version)?"

#: Signatures of bodies, notices, grants, warranties, addresses and tags, in order; the first word of each is its keyword.
SIGNATURES = r"""
mit 4: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 4: without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit 3: permission is hereby granted free of charge to any person obtaining a copy
mit 3: permission notice shall be included in all copies or substantial portions of the software
mit 3: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?
mit 2: opensource org licen[cs]es mit(?: licen[cs]e)?
mit 2: choosealicense com licenses mit
mit 2: mit licen[cs]ed
expat 3: (?:released|distributed) under (?:the )?expat licen[cs]e
mit-0 4: mit no attribution
mit-0 4: spdx licen[cs]e identifier mit 0
mit 4: spdx licen[cs]e identifier mit
bsd 4: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd 3: redistribution and use in source and binary forms with or without modification are permitted
bsd 3: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 3: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3 4: neither the name of (?:\w+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-3 3: neither the name of the copyright holder nor the names of its contributors
bsd-4 4: advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd 3: governed by a bsd style licen[cs]e
bsd 3: (?:licensed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)?(?: licen[cs]e)?
bsd-2 2: opensource org licen[cs]es bsd 2 clause
bsd-3 2: opensource org licen[cs]es bsd 3 clause
bsd 2: opensource org licen[cs]es bsd licen[cs]e(?: php)?
bsd-2 4: spdx licen[cs]e identifier bsd 2 clause
bsd-3 4: spdx licen[cs]e identifier bsd 3 clause
bsd-4 4: spdx licen[cs]e identifier bsd 4 clause
0bsd 4: spdx licen[cs]e identifier 0bsd
0bsd 2: zero clause bsd
bsd-2 1: two clause bsd
bsd-3 1: three clause bsd
bsd-4 1: four clause bsd
isc 4: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc 3: (?:licensed|released|distributed) under (?:the )?isc(?: licen[cs]e)?
isc 2: opensource org licen[cs]es isc(?: licen[cs]e)?
isc 4: spdx licen[cs]e identifier isc
hpnd 3: permission to use copy modify and distribute this software and its documentation for any purpose
ntp 3: permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
x11 3: except as contained in this notice the names? of (?:\w+ ){1,6}shall not be used in advertising
apache 4: licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache 3: licensed under the apache license
apache 3: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[cs]e)?
apache 3: licensed to the apache software foundation asf under one or more contributor license agreements
apache 4: asf licenses this file to you under the apache license
apache 2: apache org licen[cs]es licen[cs]e 2 0(?: txt| html)?
apache 2: apache org licen[cs]es licen[cs]e 1 1
apache 2: opensource org licen[cs]es apache 2 0
apache 4: spdx licen[cs]e identifier apache 2 0
apache 4: spdx licen[cs]e identifier apache 1 1
apache 1: apache licensed
apache 1: asl 2 0
apache 2: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl 4: free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl 3: program is free software you can redistribute it and or modify it
gpl 3: copy of the gnu general public licen[cs]e along with this program
gpl 3: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl 3: (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[cs]e)
gpl 2: gnu org licen[cs]es gpl(?: [0-9]+(?: [0-9])?)?(?: html| txt)?
gpl 2: gnu org copyleft gpl html
gpl 2: opensource org licen[cs]es gpl(?: [0-9] 0| licen[cs]e)?
gpl-2 4: spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-3 4: spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
gpl-1 4: spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
gpl-2 3: version 2 of the license or at your option any later version
gpl-3 3: version 3 of the license or at your option any later version
gpl-2 2: gplv2(?: or later)?
gpl-3 2: gplv3(?: or later)?
gpl-2 2: gnu gpl v2
gpl-3 2: gnu gpl v3
gpl 2: gnu general public licen[cs]e for more details
lgpl 4: free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl 3: library is free software you can redistribute it and or modify it
lgpl 3: copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:library|program)
lgpl 3: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)
lgpl 2: gnu org licen[cs]es lgpl(?: [0-9]+(?: [0-9])?)?(?: html| txt)?
lgpl-2 4: spdx licen[cs]e identifier lgpl 2 (?:0|1)(?: only| or later)?
lgpl-3 4: spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
lgpl 2: lgplv[23](?: or later)?
agpl 4: free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
agpl 3: copy of the gnu affero general public licen[cs]e along with this program
agpl 3: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:agpl|affero general public licen[cs]e)
agpl 2: gnu org licen[cs]es agpl(?: [0-9]+(?: [0-9])?)?(?: html| txt)?
agpl 4: spdx licen[cs]e identifier agpl [13] 0(?: only| or later)?
agpl 2: agplv3(?: or later)?
gfdl 3: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl 2: gnu org licen[cs]es fdl(?: [0-9] [0-9])?(?: html| txt)?
gfdl 3: with no invariant sections no front cover texts and no back cover texts
gfdl 4: spdx licen[cs]e identifier gfdl 1 [123](?: only| or later)?
mpl 4: source code form is subject to the terms of the mozilla public licen[cs]e
mpl 3: contents of this file are subject to the mozilla public licen[cs]e
mpl 3: (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:mpl|mozilla public licen[cs]e)
mpl 2: mozilla org mpl(?: [0-9] [0-9])?
mpl 4: spdx licen[cs]e identifier mpl [12] [01]
epl 3: accompanying materials are made available under the terms of the eclipse public licen[cs]e
epl 2: eclipse org (?:legal )?epl (?:v10|2 0|v20)(?: html)?
epl 4: spdx licen[cs]e identifier epl [12] 0
epl 3: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e
edl 2: eclipse org org documents edl v10(?: html| php)?
cddl 3: contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl 2: opensource org licen[cs]es cddl(?: 1 0| licen[cs]e)?
cddl 4: spdx licen[cs]e identifier cddl 1 [01]
cpl 2: opensource org licen[cs]es cpl(?: 1 0)?(?: php| txt)?
cpl 4: spdx licen[cs]e identifier cpl 1 0
eupl 3: licensed under the eupl
eupl 2: joinup ec europa eu (?:collection )?(?:software |community )?(?:page )?eupl
eupl 4: spdx licen[cs]e identifier eupl 1 [012]
zlib 4: software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib 3: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib 3: origin of this software must not be misrepresented
zlib 2: opensource org licen[cs]es zlib(?: licen[cs]e)?
zlib 4: spdx licen[cs]e identifier zlib
libpng 4: spdx licen[cs]e identifier libpng(?: 2 0)?
libpng 1: libpng licen[cs]e
boost 4: boost software licen[cs]e version 1 0 august 17th 2003
boost 3: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost 2: boost org licen[cs]e 1 0 txt
boost 4: spdx licen[cs]e identifier bsl 1 0
busl 4: spdx licen[cs]e identifier busl 1 1
busl 2: business source licen[cs]e 1 1
busl 1: business source licen[cs]e
unlicense 4: free and unencumbered software released into the public domain
unlicense 3: anyone is free to copy modify publish use compile sell or distribute this software
unlicense 2: unlicense org
unlicense 4: spdx licen[cs]e identifier unlicense
wtfpl 4: you just do what the fuck you want to
wtfpl 2: wtfpl net
wtfpl 4: spdx licen[cs]e identifier wtfpl
artistic 3: under the same terms as perl itself
artistic 3: distribute it and or modify it under the same terms as perl
artistic 2: opensource org licen[cs]es artistic licen[cs]e(?: 2 0| 1 0)?
artistic 4: spdx licen[cs]e identifier artistic [12] 0
artistic 2: artistic licen[cs]e 2 0
psf 3: psf hereby grants licensee a nonexclusive royalty free world ?wide licen[cs]e
psf 4: spdx licen[cs]e identifier (?:psf|python) 2 0(?: 1)?
psf 2: python software foundation licen[cs]e version 2
ofl 3: font software is licensed under the sil open font licen[cs]e
ofl 2: scripts sil org ofl
ofl 2: openfontlicense org
ofl 4: spdx licen[cs]e identifier ofl 1 [01]
openssl 3: product includes software developed by the openssl project for use in the openssl toolkit
openssl 4: spdx licen[cs]e identifier openssl
ssleay 3: product includes cryptographic software written by eric young
ms-pl 4: spdx licen[cs]e identifier ms pl
ms-rl 4: spdx licen[cs]e identifier ms rl
ms-pl 2: opensource org licen[cs]es ms pl(?: html)?
ecl 4: spdx licen[cs]e identifier ecl [12] 0
ecl 3: licensed under the educational community licen[cs]e
afl 3: licensed under the academic free licen[cs]e
afl 4: spdx licen[cs]e identifier afl [123] [01]
osl 3: licensed under the open software licen[cs]e
osl 4: spdx licen[cs]e identifier osl [123] [01]
postgresql 4: spdx licen[cs]e identifier postgresql
postgresql 3: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
w3c 3: w3c liability trademark and document use rules apply
w3c 2: w3 org consortium legal(?: \d{4})? copyright software(?: \d{8})?
w3c 4: spdx licen[cs]e identifier w3c
php 3: product includes php software freely available from
php 2: php net licen[cs]e(?: [0-9] 0[0-9])?(?: txt)?
php 4: spdx licen[cs]e identifier php 3 0(?: 1)?
ruby 3: same terms as ruby itself
ruby 1: ruby licen[cs]e
ruby 4: spdx licen[cs]e identifier ruby
vim 4: spdx licen[cs]e identifier vim
vim 1: vim licen[cs]e
curl 4: spdx licen[cs]e identifier curl
ncsa 2: university of illinois ncsa open source licen[cs]e
ncsa 4: spdx licen[cs]e identifier ncsa
upl 2: universal permissive licen[cs]e
upl 4: spdx licen[cs]e identifier upl 1 0
bsla 2: blue oak model licen[cs]e
bsla 4: spdx licen[cs]e identifier blueoak 1 0 0
mulan 2: mulan (?:psl|permissive software licen[cs]e)
mulan 4: spdx licen[cs]e identifier mulanpsl 2 0
sspl 2: server side public licen[cs]e
sspl 4: spdx licen[cs]e identifier sspl 1 0
elastic 2: elastic licen[cs]e(?: 2 0| v2)?
elastic 4: spdx licen[cs]e identifier elastic 2 0
commons-clause 2: commons clause(?: licen[cs]e)? condition
json 3: software shall be used for good not evil
beerware 3: beerware licen[cs]e revision 42
beerware 3: buy me a beer in return
fair 3: usage of the works is permitted provided that this instrument is retained with the works
qpl 2: q public licen[cs]e
sleepycat 2: sleepycat licen[cs]e
cecill 2: cecill (?:free software )?licen[cs]e(?: agreement)?
cecill 3: governed by the cecill licen[cs]e under french law
cecill 4: spdx licen[cs]e identifier cecill 2 [01]
ipl 2: ibm public licen[cs]e
apsl 2: apple public source licen[cs]e
apsl 4: spdx licen[cs]e identifier apsl 2 0
rpl 2: reciprocal public licen[cs]e
nasa 2: nasa open source agreement
lppl 3: work may be distributed and or modified under the conditions of the latex project public licen[cs]e
lppl 2: latex project public licen[cs]e
lppl 4: spdx licen[cs]e identifier lppl 1 3c?
odbl 3: made available under the open database licen[cs]e
odbl 2: opendatacommons org licen[cs]es odbl(?: 1 0)?
odbl 4: spdx licen[cs]e identifier odbl 1 0
odc-by 2: opendatacommons org licen[cs]es by(?: 1 0)?
odc-by 3: made available under the open data commons attribution licen[cs]e
pddl 2: opendatacommons org licen[cs]es pddl(?: 1 0)?
pddl 3: made available under the public domain dedication and licen[cs]e
cdla 2: community data licen[cs]e agreement (?:permissive|sharing)
ogl 2: open government licen[cs]e(?: v?[123](?: 0)?)?
ogl 3: contains public sector information licensed under the open government licen[cs]e
etalab 1: licence ouverte
dl-de 2: datenlizenz deutschland(?: namensnennung| zero)?(?: version)?(?: 2 0)?
cc0 4: creative commons has waived all copyright and related or neighboring rights
cc0 3: waived all copyright and related or neighbou?ring rights
cc0 2: creativecommons org publicdomain zero 1 0
cc0 4: spdx licen[cs]e identifier cc0 1 0
public-domain 2: creativecommons org publicdomain mark 1 0
public-domain 3: (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain 3: domaine public
public-domain 2: gemeinfrei
cc-by 2: creativecommons org licen[cs]es by [1234] [05](?: \w\w)?
cc-by-sa 2: creativecommons org licen[cs]es by sa [1234] [05](?: \w\w)?
cc-by-nd 2: creativecommons org licen[cs]es by nd [1234] [05](?: \w\w)?
cc-by-nc 2: creativecommons org licen[cs]es by nc [1234] [05](?: \w\w)?
cc-by-nc-sa 2: creativecommons org licen[cs]es by nc sa [1234] [05](?: \w\w)?
cc-by-nc-nd 2: creativecommons org licen[cs]es by nc nd [1234] [05](?: \w\w)?
cc-by 4: spdx licen[cs]e identifier cc by [1234] [05]
cc-by-sa 4: spdx licen[cs]e identifier cc by sa [1234] [05]
cc-by-nd 4: spdx licen[cs]e identifier cc by nd [1234] [05]
cc-by-nc 4: spdx licen[cs]e identifier cc by nc [1234] [05]
cc-by-nc-sa 4: spdx licen[cs]e identifier cc by nc sa [1234] [05]
cc-by-nc-nd 4: spdx licen[cs]e identifier cc by nc nd [1234] [05]
cc-by 3: (?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of (?:the )?)?(?:cc by|creative commons attribution)(?: [1234] [05])?(?: international)?
cc-by-sa 3: (?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of (?:the )?)?(?:cc by sa|creative commons attribution share ?alike)(?: [1234] [05])?(?: international)?
cc-by-nc 3: (?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of (?:the )?)?(?:cc by nc|creative commons attribution non ?commercial)(?: [1234] [05])?(?: international)?
cc 3: (?:licensed|released|distributed|available|published) under (?:a|the) creative commons licen[cs]e
cc 1: some rights reserved
cc-by 3: permits unrestricted use distribution and reproduction in any medium provided the original (?:work|author and source) (?:is|are) (?:properly )?(?:cited|credited)
proprietary 3: unauthorized copying of this file via any medium is strictly prohibited
proprietary 3: proprietary and confidential
proprietary 3: no part of this (?:publication|book|work) may be reproduced
proprietary 2: confidential and proprietary information
proprietary 2: alle rechte vorbehalten
proprietary 2: tous droits r[eé]serv[eé]s
proprietary 2: todos los derechos reservados
proprietary 2: end user licen[cs]e agreement
shareware 2: trial version for evaluation purposes only
freeware 2: freeware for personal use only
openrail 2: open ?rail(?: m| d| s)? licen[cs]e
openrail 2: responsible ai licen[cs]e
llama 2: llama (?:[23](?: [0-9])? )?community licen[cs]e(?: agreement)?
gemma 2: gemma terms of use
fsl 2: functional source licen[cs]e
polyform 2: polyform (?:noncommercial|shield|perimeter|small business) licen[cs]e
parity 2: parity public licen[cs]e
copyleft-next 2: copyleft next
hippocratic 2: hippocratic licen[cs]e
anti-996 2: anti 996 licen[cs]e
"""

#: A rule spans this many words at most; no pattern has an unbounded part.
REACH = 40


def _keywords(pattern: str) -> list[str]:
    """The literal first words of a pattern: one, or those that its leading group lists."""
    head = pattern[3 : pattern.index(")")].split("|") if pattern.startswith("(?:") else [pattern]
    return [re.match(r"[a-z0-9]+", h)[0] for h in head]


def rules() -> dict[str, list[tuple[str, str, int, bool]]]:
    """Keyword -> (pattern, label, priority, whether a base phrase), in order: base phrases, signatures, then names with and without a version."""
    listed = [(f"{phrase}", label, 0, True) for phrase, label in BASE.items()]
    for line in SIGNATURES.strip().splitlines():
        head, pattern = line.split(": ", 1)
        label, priority = head.split(" ")
        listed.append((pattern, label, int(priority), False))
    for form, priority in (("(?:{name})" + _VERSION, 2), ("{name}", 1)):
        for label, names in NAMES.items():
            listed += [(form.replace("{name}", name), label, priority, False) for name in names]
    out: dict[str, list[tuple[str, str, int, bool]]] = {}
    for pattern, *rest in listed:
        for keyword in _keywords(pattern):
            out.setdefault(keyword, []).append((f"^(?:{pattern})(?= |$)", *rest))
    return out


def words_of(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


_HIT = "start:int,end:int,priority:int,label:string,base:boolean"


def detections(w: Column) -> Column:
    """Every match of every rule in the array of words ``w``, as array<struct<start,end,priority,label,base>>."""
    table = rules()
    by_keyword = F.create_map(*(x for k, rs in table.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(name).alias("label"), F.lit(n).alias("priority"), F.lit(b).alias("base")) for p, name, n, b in rs)))))
    every = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    # Compiled once: rules are tried one by one only where one of them holds.
    some = "^(?:" + "|".join(sorted({p.removeprefix("^").removesuffix("(?= |$)") for rs in table.values() for p, *_ in rs})) + ")(?: |$)"
    context = lambda i: F.array_join(F.slice(w, i + 1, REACH), " ")
    gates = F.filter(every, lambda i: F.get(w, i).isin(list(table)) & F.rlike(context(i), F.lit(some)))

    def tried(i):
        def matched(ahead):
            found = F.transform(by_keyword[F.get(w, i)], lambda r: F.struct(F.call_function("regexp_extract", ahead, r["pattern"], F.lit(0)).alias("m"), r.alias("r")))
            found = F.filter(found, lambda x: x["m"] != "")
            return F.transform(found, lambda x: F.struct(i.alias("start"), (i + F.size(F.split(x["m"], " "))).alias("end"), x["r"]["priority"].alias("priority"), x["r"]["label"].alias("label"), x["r"]["base"].alias("base")))

        return let(context(i), matched)

    return F.flatten(F.transform(gates, tried)).cast(f"array<struct<{_HIT}>>")


def _surviving(hits: Column) -> Column:
    """Labels and score of the detections that no other suppresses, in one pass over them by start, longest first."""
    ordered = F.array_sort(F.transform(F.filter(hits, lambda h: ~h["base"]), lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("till"), (-h["priority"]).alias("rank"), h["label"].alias("label"))))
    levels = range(1, 5)
    zero = F.struct(*(F.lit(0).alias(f"e{k}") for k in levels), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def add(acc, h):
        end, priority = -h["till"], -h["rank"]
        # e{k}: the furthest end of a detection of priority k or more so far
        covered = F.lit(False)
        for k in levels:
            covered = covered | ((priority == k) & (acc[f"e{k}"] >= end))
        return F.struct(
            *(F.when(priority >= k, F.greatest(acc[f"e{k}"], end)).otherwise(acc[f"e{k}"]).alias(f"e{k}") for k in levels),
            F.when(covered, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(h["label"]))).alias("labels"),
            F.when(covered, acc["score"]).otherwise(F.greatest(acc["score"], F.lit(0.2) + 0.2 * priority)).alias("score"),
        )

    return F.aggregate(ordered, zero, add)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id``, word and base counts, ``base_labels``, ``labels`` and ``score``, a row per document."""

    def summed(w):
        def of_hits(hits):
            base = F.filter(hits, lambda h: h["base"])
            base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda h: h["label"])))
            starts = F.transform(base, lambda h: h["start"].cast("long"))
            return let(
                _surviving(hits),
                lambda s: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.size(base).cast("long").alias("n_base"),
                    F.array_min(starts).alias("first_word"),
                    F.array_max(starts).alias("last_word"),
                    F.array_join(base_labels, ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(base_labels, s["labels"])), ",").alias("labels"),
                    s["score"].alias("score"),
                ),
            )

        return let(detections(w), of_hits)

    found = let(words_of(F.coalesce("text", F.lit(""))), summed)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")).select("doc_id", "found.*")
