"""License signatures, written by hand.

A line is ``priority weight label keyword[/keyword] | pattern``. Patterns match whole words of
a text whose words are lower-cased and parted by single spaces, so ``v2.0`` reads ``v2 0``. Any
match holds one of the keywords. ``\\1`` in a label is the version that the pattern caught.
Priorities: 8 identifiers and full notices, 7 names with a version, 6 grants, 5 names,
4 short names, 3 hints.
"""

SIGNATURES = r"""
8 1.00 gpl-\1 spdx | spdx license identifier gpl ([123])(?: 0)?(?: only| or later)?
8 1.00 lgpl-\1 spdx | spdx license identifier lgpl (2 0|2 1|3 0)(?: only| or later)?
8 1.00 agpl-\1 spdx | spdx license identifier agpl ([13] 0)(?: only| or later)?
8 1.00 gfdl-\1 spdx | spdx license identifier gfdl (1 [123])(?: only| or later| invariants only| no invariants only)?
8 1.00 apache-\1 spdx | spdx license identifier apache ([12] [01])
8 1.00 mit spdx | spdx license identifier mit(?: 0)?
8 1.00 bsd-\1-clause spdx | spdx license identifier bsd ([1234]) clause(?: patent| clear| uc| views| lbnl)?
8 1.00 0bsd spdx | spdx license identifier 0bsd
8 1.00 mpl-\1 spdx | spdx license identifier mpl ([12] [01])(?: no copyleft exception)?
8 1.00 epl-\1 spdx | spdx license identifier epl ([12] 0)
8 1.00 cddl-\1 spdx | spdx license identifier cddl (1 [01])
8 1.00 cpl-1.0 spdx | spdx license identifier cpl 1 0
8 1.00 eupl-\1 spdx | spdx license identifier eupl (1 [012])
8 1.00 isc spdx | spdx license identifier isc
8 1.00 zlib spdx | spdx license identifier zlib(?: acknowledgement)?
8 1.00 artistic-\1 spdx | spdx license identifier artistic ([12] 0)(?: cl8| perl)?
8 1.00 unlicense spdx | spdx license identifier unlicense
8 1.00 wtfpl spdx | spdx license identifier wtfpl
8 1.00 bsl-1.0 spdx | spdx license identifier bsl 1 0
8 1.00 busl-1.1 spdx | spdx license identifier busl 1 1
8 1.00 psf-2.0 spdx | spdx license identifier (?:psf|python) 2 0
8 1.00 ofl-\1 spdx | spdx license identifier ofl (1 [01])(?: rfn| no rfn)?
8 1.00 openssl spdx | spdx license identifier openssl
8 1.00 ms-pl spdx | spdx license identifier ms pl
8 1.00 ms-rl spdx | spdx license identifier ms rl
8 1.00 afl-\1 spdx | spdx license identifier afl ([123] [012])
8 1.00 osl-\1 spdx | spdx license identifier osl ([123] [01])
8 1.00 odbl-1.0 spdx | spdx license identifier odbl 1 0
8 1.00 odc-by-1.0 spdx | spdx license identifier odc by 1 0
8 1.00 pddl-1.0 spdx | spdx license identifier pddl 1 0
8 1.00 cc0-1.0 spdx | spdx license identifier cc0 1 0
8 1.00 cc-by-\1 spdx | spdx license identifier cc by ([1234] [05])
8 1.00 cc-by-sa-\1 spdx | spdx license identifier cc by sa ([1234] [05])
8 1.00 cc-by-nd-\1 spdx | spdx license identifier cc by nd ([1234] [05])
8 1.00 cc-by-nc-\1 spdx | spdx license identifier cc by nc ([1234] [05])
8 1.00 cc-by-nc-sa-\1 spdx | spdx license identifier cc by nc sa ([1234] [05])
8 1.00 cc-by-nc-nd-\1 spdx | spdx license identifier cc by nc nd ([1234] [05])
8 1.00 ncsa spdx | spdx license identifier ncsa
8 1.00 postgresql spdx | spdx license identifier postgresql
8 1.00 mulanpsl-\1 spdx | spdx license identifier mulanpsl ([12] 0)
8 1.00 cecill-\1 spdx | spdx license identifier cecill (1 0|1 1|2 0|2 1|b|c)
8 1.00 upl-1.0 spdx | spdx license identifier upl 1 0
8 1.00 ecl-2.0 spdx | spdx license identifier ecl 2 0
8 0.95 mit hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
8 0.90 mit substantial | shall be included in all copies or substantial portions of the software
8 0.85 mit noninfringement | fitness for a particular purpose and noninfringement
8 0.95 bsd redistribution | redistribution and use in source and binary forms with or without modification are permitted
8 0.90 bsd redistributions | redistributions of source code must retain the above copyright notice
8 0.90 bsd redistributions | redistributions in binary form must reproduce the above copyright notice
8 0.90 bsd-3-clause endorse | may be used to endorse or promote products derived from this software without specific prior written permission
8 0.90 bsd-4-clause advertising | all advertising materials mentioning features or use of this software must display
8 0.95 apache-2.0 licenses | apache org licenses license 2 0
8 0.90 apache-2.0 compliance | you may not use this file except in compliance with the license
8 0.80 apache-2.0 basis | distributed on an as is basis without warranties or conditions of any kind
8 0.95 gpl redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
8 0.95 lgpl redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
8 0.95 agpl redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license
8 0.85 gpl merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
8 0.85 gpl foundation | published by the free software foundation either version
8 0.90 gfdl permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
8 0.90 mpl source | this source code form is subject to the terms of the mozilla public license
8 0.90 epl accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license
8 0.90 cddl subject | the contents of this file are subject to the terms of the common development and distribution license
8 0.90 isc permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
8 0.85 zlib misrepresented | the origin of this software must not be misrepresented
8 0.85 zlib altered | altered source versions must be plainly marked as such
8 0.90 unlicense unencumbered | this is free and unencumbered software released into the public domain
8 0.95 wtfpl fuck | you just do what the fuck you want to
8 0.90 bsl boost | distributed under the boost software license version 1 0
8 0.90 ofl font | this font software is licensed under the sil open font license
8 0.90 postgresql permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee
8 0.85 ncsa contributors | neither the names of [^ ]+(?: [^ ]+){0,12} nor the names of its contributors may be used to endorse
8 0.85 beerware beer | if we meet some day and you think this stuff is worth it you can buy me a beer
8 0.95 cc-by-\1 creativecommons | creativecommons org licenses by ([1234] [05])(?: legalcode| deed(?: [a-z]{2})?)?
8 0.95 cc-by-sa-\1 creativecommons | creativecommons org licenses by sa ([1234] [05])(?: legalcode| deed(?: [a-z]{2})?)?
8 0.95 cc-by-nd-\1 creativecommons | creativecommons org licenses by nd ([1234] [05])(?: legalcode| deed(?: [a-z]{2})?)?
8 0.95 cc-by-nc-\1 creativecommons | creativecommons org licenses by nc ([1234] [05])(?: legalcode| deed(?: [a-z]{2})?)?
8 0.95 cc-by-nc-sa-\1 creativecommons | creativecommons org licenses by nc sa ([1234] [05])(?: legalcode| deed(?: [a-z]{2})?)?
8 0.95 cc-by-nc-nd-\1 creativecommons | creativecommons org licenses by nc nd ([1234] [05])(?: legalcode| deed(?: [a-z]{2})?)?
8 0.95 cc0-1.0 creativecommons | creativecommons org publicdomain zero 1 0
8 0.90 public-domain creativecommons | creativecommons org publicdomain mark 1 0
7 0.98 gpl-\1 general | (?:the )?gnu general public license(?: as published by the free software foundation)?(?: version| v)? v?([123])(?: 0)?
7 0.98 lgpl-\1 lesser | (?:the )?gnu lesser general public license(?: version| v)? v?(2 1|3)(?: 0)?
7 0.98 lgpl-\1 library | (?:the )?gnu library general public license(?: version| v)? v?(2)(?: 0)?
7 0.98 agpl-\1 affero | (?:the )?gnu affero general public license(?: version| v)? v?([13])(?: 0)?
7 0.98 gfdl-\1 documentation | (?:the )?gnu free documentation license(?: version| v)? v?(1 [123])
7 0.98 apache-\1 apache | (?:the )?apache(?: software)? licen[sc]e(?: version| v)? v?(1 0|1 1|2 0|2)
7 0.98 mpl-\1 mozilla | (?:the )?mozilla public licen[sc]e(?: version| v)? v?(1 0|1 1|2 0)
7 0.98 epl-\1 eclipse | (?:the )?eclipse public licen[sc]e(?: version| v)? v?([12] 0)
7 0.98 cddl-\1 development | (?:the )?common development and distribution licen[sc]e(?: version| v)? v?(1 [01])
7 0.98 cpl-\1 common | (?:the )?common public licen[sc]e(?: version| v)? v?(1 0)
7 0.98 eupl-\1 european | (?:the )?european union public licen[sc]e(?: version| v)? v?(1 [012])
7 0.98 artistic-\1 artistic | (?:the )?artistic licen[sc]e(?: version| v)? v?([12] 0)
7 0.98 bsl-\1 boost | (?:the )?boost software licen[sc]e(?: version| v)? v?(1 0)
7 0.98 busl-\1 business | (?:the )?business source licen[sc]e(?: version| v)? v?(1 [01])
7 0.98 psf-\1 python | (?:the )?python software foundation licen[sc]e(?: version| v)? v?(2)
7 0.98 ofl-\1 font | (?:the )?(?:sil )?open font licen[sc]e(?: version| v)? v?(1 [01])
7 0.98 afl-\1 academic | (?:the )?academic free licen[sc]e(?: version| v)? v?([123] [012])
7 0.98 osl-\1 open | (?:the )?open software licen[sc]e(?: version| v)? v?([123] [01])
7 0.98 odbl-\1 database | (?:the )?open database licen[sc]e(?: version| v)? v?(1 0)
7 0.98 cecill-\1 cecill | (?:the )?cecill(?: free software)? licen[sc]e(?: agreement)?(?: version| v)? v?([12] [01])
7 0.98 mulanpsl-\1 mulan | (?:the )?mulan permissive software licen[sc]e(?: version| v)? v?([12])(?: 0)?
7 0.98 ecl-\1 educational | (?:the )?educational community licen[sc]e(?: version| v)? v?([12] 0)
7 0.98 upl-\1 universal | (?:the )?universal permissive licen[sc]e(?: version| v)? v?(1 0)
7 0.98 cc-by-\1 attribution | (?:creative commons )?attribution ([1234] [05])(?: international| generic| unported)?
7 0.98 cc-by-sa-\1 attribution | (?:creative commons )?attribution (?:share alike|sharealike) ([1234] [05])(?: international| generic| unported)?
7 0.98 cc-by-nd-\1 attribution | (?:creative commons )?attribution (?:no derivatives|noderivatives|noderivs) ([1234] [05])(?: international| generic| unported)?
7 0.98 cc-by-nc-\1 attribution | (?:creative commons )?attribution (?:non commercial|noncommercial) ([1234] [05])(?: international| generic| unported)?
7 0.98 cc-by-nc-sa-\1 attribution | (?:creative commons )?attribution (?:non commercial|noncommercial) (?:share alike|sharealike) ([1234] [05])(?: international| generic| unported)?
7 0.98 cc-by-nc-nd-\1 attribution | (?:creative commons )?attribution (?:non commercial|noncommercial) (?:no derivatives|noderivatives|noderivs) ([1234] [05])(?: international| generic| unported)?
7 0.98 cc0-1.0 zero | creative commons zero(?: version| v)? v?1 0(?: universal)?
7 0.95 bsd-\1-clause bsd | (?:the )?(?:new |modified |simplified |original )?bsd ([1234]) clause(?: licen[sc]e)?
7 0.95 bsd-\1-clause clause | (?:the )?([1234]) clause bsd(?: licen[sc]e)?
7 0.95 bsd-2-clause clause | (?:the )?two clause bsd(?: licen[sc]e)?
7 0.95 bsd-3-clause clause | (?:the )?three clause bsd(?: licen[sc]e)?
7 0.95 bsd-4-clause clause | (?:the )?four clause bsd(?: licen[sc]e)?
7 0.85 gpl-\1 gpl | (?:gnu )?gpl(?: version| v)? v?([123])(?: 0)?(?: only| or later)?
7 0.85 gpl-1 gplv1/gpl1 | gplv?1
7 0.85 gpl-2 gplv2/gpl2 | gplv?2(?: 0)?(?: only| or later)?
7 0.85 gpl-3 gplv3/gpl3 | gplv?3(?: 0)?(?: only| or later)?
7 0.85 lgpl-\1 lgpl | (?:gnu )?lgpl(?: version| v)? v?(2 1|2 0|3 0|3|2)(?: only| or later)?
7 0.85 lgpl-2 lgplv2/lgpl2 | lgplv?2(?: 0)?(?: only| or later)?
7 0.90 lgpl-2.1 lgplv2/lgpl2 | lgplv?2 1(?: only| or later)?
7 0.85 lgpl-3 lgplv3/lgpl3 | lgplv?3(?: 0)?(?: only| or later)?
7 0.85 agpl-\1 agpl | (?:gnu )?agpl(?: version| v)? v?([13])(?: 0)?(?: only| or later)?
7 0.85 agpl-3 agplv3/agpl3 | agplv?3(?: 0)?(?: only| or later)?
7 0.85 gfdl-\1 gfdl | gfdl(?: version| v)? v?(1 [123])
7 0.85 apache-\1 apache | apache(?: version| v)? v?(1 0|1 1|2 0)
7 0.85 apache-2.0 apache2/apachev2 | apachev?2(?: 0)?
7 0.85 mpl-\1 mpl | mpl(?: version| v)? v?(1 0|1 1|2 0)
7 0.85 mpl-2.0 mplv2/mpl2 | mplv?2(?: 0)?
7 0.85 epl-\1 epl | epl(?: version| v)? v?([12] 0)
7 0.85 cddl-\1 cddl | cddl(?: version| v)? v?(1 [01])
7 0.85 eupl-\1 eupl | eupl(?: version| v)? v?(1 [012])
7 0.85 artistic-\1 artistic | artistic(?: version| v)? v?([12] 0)
7 0.85 bsl-1.0 bsl | bsl(?: version| v)? v?1 0
7 0.85 busl-1.1 busl | busl(?: version| v)? v?1 1
7 0.85 ofl-\1 ofl | ofl(?: version| v)? v?(1 [01])
7 0.85 osl-\1 osl | osl(?: version| v)? v?([123] [01])
7 0.85 afl-\1 afl | afl(?: version| v)? v?([123] [012])
7 0.85 odbl-1.0 odbl | odbl(?: version| v)? v?1 0
7 0.85 pddl-1.0 pddl | pddl(?: version| v)? v?1 0
7 0.90 cc0-1.0 cc0 | cc0(?: version| v)? v?1 0
7 0.90 cc-by-\1 cc | cc by(?: version| v)? v?([1234] [05])
7 0.90 cc-by-sa-\1 cc | cc by sa(?: version| v)? v?([1234] [05])
7 0.90 cc-by-nd-\1 cc | cc by nd(?: version| v)? v?([1234] [05])
7 0.90 cc-by-nc-\1 cc | cc by nc(?: version| v)? v?([1234] [05])
7 0.90 cc-by-nc-sa-\1 cc | cc by nc sa(?: version| v)? v?([1234] [05])
7 0.90 cc-by-nc-nd-\1 cc | cc by nc nd(?: version| v)? v?([1234] [05])
6 0.95 gpl general | (?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of the )?gnu general public license
6 0.95 lgpl lesser | (?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of the )?gnu lesser general public license
6 0.95 agpl affero | (?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of the )?gnu affero general public license
6 0.95 gfdl documentation | (?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of the )?gnu free documentation license
6 0.95 apache apache | (?:licensed|released|distributed|available|published|covered) under (?:the |an )?(?:terms of the )?apache(?: software)? licen[sc]e
6 0.95 mit mit | (?:licensed|released|distributed|available|published|covered) under (?:the |an )?(?:terms of the )?mit(?: x11)? licen[sc]e
6 0.95 bsd bsd | (?:licensed|released|distributed|available|published|covered) under (?:the |a )?(?:terms of the )?(?:new |modified |simplified )?bsd(?: style)? licen[sc]e
6 0.95 mpl mozilla | (?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of the )?mozilla public licen[sc]e
6 0.95 epl eclipse | (?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of the )?eclipse public licen[sc]e
6 0.90 isc isc | (?:licensed|released|distributed|available|published|covered) under (?:the |an )?isc licen[sc]e
6 0.90 zlib zlib | (?:licensed|released|distributed|available|published|covered) under (?:the |a )?zlib(?: libpng)? licen[sc]e
6 0.90 unlicense unlicense | (?:licensed|released|distributed|available|published|covered) under the unlicense
6 0.90 wtfpl wtfpl | (?:licensed|released|distributed|available|published|covered) under (?:the )?wtfpl
6 0.90 gpl gpl | (?:licensed|released|distributed|available|published|covered) under (?:the |a )?(?:gnu )?gpl(?: licen[sc]e)?
6 0.90 lgpl lgpl | (?:licensed|released|distributed|available|published|covered) under (?:the |a )?(?:gnu )?lgpl(?: licen[sc]e)?
6 0.90 agpl agpl | (?:licensed|released|distributed|available|published|covered) under (?:the |an )?(?:gnu )?agpl(?: licen[sc]e)?
6 0.90 cc creative | (?:licensed|released|distributed|available|published|covered) under (?:a |the )?creative commons licen[sc]e
6 0.90 public-domain domain | (?:dedicated to|released into|placed in|placed into|donated to) the public domain
6 0.85 proprietary proprietary | (?:licensed|released|distributed|available|published) under (?:a |the )?proprietary licen[sc]e
5 0.80 gpl general | gnu general public licen[sc]e
5 0.80 lgpl lesser/library | gnu (?:lesser|library) general public licen[sc]e
5 0.80 agpl affero | (?:gnu )?affero general public licen[sc]e
5 0.80 gfdl documentation | (?:gnu )?free documentation licen[sc]e
5 0.80 apache apache | apache(?: software)? licen[sc]e
5 0.80 mit mit | mit(?: x11| expat)? licen[sc]e
5 0.80 mit expat | expat licen[sc]e
5 0.80 mit-0 attribution | mit no attribution(?: licen[sc]e)?
5 0.80 x11 x11 | x11 licen[sc]e
5 0.80 bsd berkeley | berkeley software distribution licen[sc]e
5 0.80 bsd bsd | (?:new |modified |simplified |original )?bsd(?: style)? licen[sc]e
5 0.80 0bsd 0bsd/clause | (?:0bsd|zero clause bsd)(?: licen[sc]e)?
5 0.80 mpl mozilla | mozilla public licen[sc]e
5 0.80 epl eclipse | eclipse public licen[sc]e
5 0.80 edl eclipse | eclipse distribution licen[sc]e
5 0.80 cddl development | common development and distribution licen[sc]e
5 0.80 cpl common | common public licen[sc]e
5 0.80 cpal attribution | common public attribution licen[sc]e
5 0.80 eupl european | european union public licen[sc]e
5 0.80 isc isc | isc licen[sc]e
5 0.80 zlib zlib | zlib(?: libpng)? licen[sc]e
5 0.80 libpng libpng/png | (?:png reference library|libpng) licen[sc]e
5 0.80 artistic artistic | (?:perl )?artistic licen[sc]e
5 0.80 unlicense unlicense | the unlicense
5 0.80 wtfpl fuck | do what the fuck you want to public licen[sc]e
5 0.80 bsl boost | boost(?: software)? licen[sc]e
5 0.80 busl business | business source licen[sc]e
5 0.80 sspl server | server side public licen[sc]e
5 0.80 elastic elastic | elastic licen[sc]e(?: 2 0| v2)?
5 0.80 commons-clause clause | commons clause(?: licen[sc]e condition)?
5 0.80 psf python | python(?: software foundation)? licen[sc]e
5 0.80 php php | php licen[sc]e(?: version)?(?: 3 0| 3 01)?
5 0.80 ruby ruby | ruby licen[sc]e
5 0.80 postgresql postgresql | postgresql licen[sc]e
5 0.80 openssl openssl | openssl licen[sc]e
5 0.80 openldap openldap | openldap public licen[sc]e
5 0.80 ms-pl microsoft | microsoft public licen[sc]e
5 0.80 ms-rl microsoft | microsoft reciprocal licen[sc]e
5 0.80 apsl apple | apple public source licen[sc]e
5 0.80 ibm-pl ibm | ibm public licen[sc]e
5 0.80 qpl public | q public licen[sc]e
5 0.80 ncsa ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
5 0.80 upl universal | universal permissive licen[sc]e
5 0.80 ecl educational | educational community licen[sc]e
5 0.80 mulanpsl mulan | mulan permissive software licen[sc]e
5 0.80 cecill cecill | cecill(?: free software)? licen[sc]e
5 0.80 beerware beer/beerware | beer ?ware licen[sc]e
5 0.80 ofl font | (?:sil )?open font licen[sc]e
5 0.80 afl academic | academic free licen[sc]e
5 0.80 osl open | open software licen[sc]e
5 0.80 odbl database | open database licen[sc]e
5 0.80 odc-by commons | open data commons attribution licen[sc]e
5 0.80 pddl dedication | public domain dedication and licen[sc]e
5 0.80 ogl government | open government licen[sc]e
5 0.80 openrail responsible/openrail | (?:responsible ai licen[sc]e|openrail(?: m| \+\+)?)
5 0.80 cc-by creative | creative commons attribution(?: licen[sc]e)?
5 0.80 cc-by-sa creative | creative commons attribution (?:share alike|sharealike)(?: licen[sc]e)?
5 0.80 cc-by-nd creative | creative commons attribution (?:no derivatives|noderivatives|noderivs)(?: licen[sc]e)?
5 0.80 cc-by-nc creative | creative commons attribution (?:non commercial|noncommercial)(?: licen[sc]e)?
5 0.80 cc-by-nc-sa creative | creative commons attribution (?:non commercial|noncommercial) (?:share alike|sharealike)(?: licen[sc]e)?
5 0.80 cc-by-nc-nd creative | creative commons attribution (?:non commercial|noncommercial) (?:no derivatives|noderivatives|noderivs)(?: licen[sc]e)?
5 0.80 cc0 creative | creative commons zero
5 0.75 cc creative | creative commons licen[sc]es?
4 0.70 gpl gpl | (?:gnu )?gpl licen[sc]ed?
4 0.70 lgpl lgpl | (?:gnu )?lgpl licen[sc]ed?
4 0.70 agpl agpl | (?:gnu )?agpl licen[sc]ed?
4 0.70 mpl mpl | mpl licen[sc]ed?
4 0.70 epl epl | epl licen[sc]ed?
4 0.70 cddl cddl | cddl licen[sc]ed?
4 0.70 bsd bsd | bsd licensed
4 0.70 mit mit | mit licensed
4 0.70 apache apache | apache licensed
4 0.70 unlicense unlicense | unlicense licen[sc]ed?
4 0.70 wtfpl wtfpl | wtfpl
4 0.70 cc0 cc0 | cc0(?: licen[sc]ed?)?
4 0.70 cc-by-sa cc | cc by sa
4 0.70 cc-by-nd cc | cc by nd
4 0.70 cc-by-nc cc | cc by nc
4 0.70 cc-by-nc-sa cc | cc by nc sa
4 0.70 cc-by-nc-nd cc | cc by nc nd
4 0.70 sspl sspl | sspl(?: licen[sc]ed?)?
4 0.70 dual-license dual | dual licen[sc]ed
3 0.70 gpl gnu | gnu org (?:licenses|copyleft)(?: gpl)?
3 0.70 osi opensource | opensource org licenses [0-9a-z]+
3 0.60 public-domain domain | (?:is|are) in the public domain
3 0.50 proprietary reserved | all rights reserved
3 0.80 proprietary proprietary | proprietary and confidential
3 0.80 proprietary unauthorized | unauthorized (?:copying|reproduction|distribution) of this file
3 0.60 proprietary confidential | confidential and proprietary
3 0.60 eula eula/agreement | end user licen[sc]e agreement|eula
3 0.40 copyright copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
3 0.40 copyright copr | copr (?:19|20)\d\d
3 0.50 disclaimer warranty | (?:provided|distributed) as is(?: and)? without (?:any )?(?:express or implied )?warranty
3 0.50 disclaimer liable | in no event shall the (?:authors?|copyright holders?|regents)(?: [^ ]+){0,6} be liable
3 0.50 license-file license | see (?:the )?license(?: txt| md| file)? for (?:details|more information|licensing information)
3 0.50 license-file copying | see (?:the )?(?:file )?copying for (?:details|more information)
"""
