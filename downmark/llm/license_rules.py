"""The signature rules of the license scan, written over lower-case words with one space between them.

A line is ``priority | keywords | pattern`` under the label it gives.  Punctuation has
gone before a pattern sees the text: ``GPL-3.0-or-later`` reads ``gpl 3 0 or later``.
All keywords of a rule (joined by ``+``) must be found somewhere in a text before its
pattern runs.  Priorities: 5 tag or address of one license, 4 its grant or header, 3 its
full name with version, 2 its name, 1 a hint.
"""

from __future__ import annotations

#: Phrases that are always reported, wherever they stand, and their labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

W = "[0-9a-z]+"

RULES = r"""
= mit
5 | spdx+mit | spdx license identifier mit
5 | opensource+mit | opensource org licenses? mit
4 | hereby+charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
4 | released+mit | released under (?:the )?(?:terms of the )?mit licen[sc]e
4 | licensed+mit | licensed under (?:the )?(?:terms of the )?mit licen[sc]e
4 | distributed+mit | distributed under (?:the )?(?:terms of the )?mit licen[sc]e
4 | available+mit | available under (?:the )?(?:terms of the )?mit licen[sc]e
3 | expat | (?:the )?expat licen[sc]e
3 | mit+x11 | mit x11 (?:style )?licen[sc]e
2 | mit | (?:the )?mit (?:style |like )?licen[sc]e
1 | mit | licen[sc]e mit
= mit-0
5 | spdx+mit | spdx license identifier mit 0
3 | attribution+mit | mit no attribution(?: licen[sc]e)?
= x11
5 | spdx+x11 | spdx license identifier x11
2 | x11 | (?:the )?x11 licen[sc]e
= isc
5 | spdx+isc | spdx license identifier isc
4 | permission+fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
4 | isc | (?:released|licensed|distributed) under (?:the )?isc licen[sc]e
2 | isc | (?:the )?isc licen[sc]e
= bsd-2-clause
5 | spdx+bsd | spdx license identifier bsd 2 clause(?: patent)?
5 | opensource+bsd | opensource org licenses? bsd 2 clause
3 | bsd+2 | bsd 2 clause(?: simplified)?(?: licen[sc]e)?
3 | bsd+two | two clause bsd(?: licen[sc]e)?
3 | bsd+simplified | simplified bsd licen[sc]e
3 | freebsd | freebsd licen[sc]e
= bsd-3-clause
5 | spdx+bsd | spdx license identifier bsd 3 clause(?: clear)?
5 | opensource+bsd | opensource org licenses? bsd 3 clause
4 | neither+endorse | neither the name of (?:W ){1,12}may be used to endorse or promote products derived from this software
3 | bsd+3 | bsd 3 clause(?: new| revised)?(?: licen[sc]e)?
3 | bsd+three | three clause bsd(?: licen[sc]e)?
3 | bsd+new | (?:new|revised|modified) bsd licen[sc]e
= bsd-4-clause
5 | spdx+bsd | spdx license identifier bsd 4 clause(?: uc)?
4 | advertising+acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
3 | bsd+4 | bsd 4 clause(?: original| old)?(?: licen[sc]e)?
3 | bsd+original | original bsd licen[sc]e
= bsd-0-clause
5 | spdx+0bsd | spdx license identifier 0bsd
3 | bsd+zero | (?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?
= bsd
4 | redistribution+binary | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
4 | bsd | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of the )?bsd(?: style| like)? licen[sc]e
2 | bsd | bsd(?: style| like)? licen[sc]e
1 | bsd | licen[sc]e bsd
= apache-1.0
5 | spdx+apache | spdx license identifier apache 1 0
3 | apache | apache (?:software )?licen[sc]e (?:version |v)?1 0
= apache-1.1
5 | spdx+apache | spdx license identifier apache 1 1
3 | apache | apache (?:software )?licen[sc]e (?:version |v)?1 1
= apache-2.0
5 | spdx+apache | spdx license identifier apache 2 0
5 | apache | (?:www )?apache org licenses license 2 0
4 | apache | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)?
4 | compliance+apache | you may not use this file except in compliance with the license(?: W){0,14} apache org licenses
3 | apache | apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)?
3 | asl | asl 2 0
3 | apache | apache 2 0(?: licen[sc]ed?)?
= apache
4 | apache | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache (?:software )?licen[sc]e
2 | apache | apache (?:software )?licen[sc]e
1 | apache | licen[sc]e apache
= gpl-1.0
5 | spdx+gpl | spdx license identifier gpl 1 0(?: only)?
3 | gnu | gnu (?:general public license|gpl) (?:version |v)1(?: 0)?
= gpl-2.0
5 | spdx+gpl | spdx license identifier gpl 2 0(?: only)?
5 | gnu+gpl | gnu org licenses (?:old licenses )?gpl 2 0(?: W)?
4 | gnu | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu (?:general public license|gpl) (?:as published by the free software foundation )?(?:version |v)2(?: 0)?
3 | gnu | gnu (?:general public license|gpl) (?:version |v)2(?: 0)?
3 | gpl | gpl ?(?:version |v)?2(?: 0)?(?: only)?
3 | gplv2 | gplv2(?: 0)?
= gpl-2.0-or-later
5 | spdx+gpl | spdx license identifier gpl 2 0 or later
4 | gnu+later | gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
3 | gpl+later | gpl ?(?:version |v)?2(?: 0)? or (?:any )?later(?: version)?
3 | gplv2+later | gplv2(?: 0)? or (?:any )?later(?: version)?
= gpl-3.0
5 | spdx+gpl | spdx license identifier gpl 3 0(?: only)?
5 | gnu+gpl | gnu org licenses gpl 3 0(?: W)?
4 | gnu | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu (?:general public license|gpl) (?:as published by the free software foundation )?(?:version |v)3(?: 0)?
3 | gnu | gnu (?:general public license|gpl) (?:version |v)3(?: 0)?
3 | gpl | gpl ?(?:version |v)?3(?: 0)?(?: only)?
3 | gplv3 | gplv3(?: 0)?
= gpl-3.0-or-later
5 | spdx+gpl | spdx license identifier gpl 3 0 or later
4 | gnu+later | gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
3 | gpl+later | gpl ?(?:version |v)?3(?: 0)? or (?:any )?later(?: version)?
3 | gplv3+later | gplv3(?: 0)? or (?:any )?later(?: version)?
= gpl
4 | gnu | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu (?:general public license|gpl)
4 | redistribute+gnu | you can redistribute it and or modify it under the terms of the gnu general public license
5 | gnu+gpl | gnu org licenses gpl(?: html| txt)?
2 | gnu | (?:the )?gnu (?:general public license|gpl)
2 | general+public | general public license
1 | gpl | gpl(?: licen[sc]ed?)?
1 | gpl | licen[sc]e gpl
= gpl-with-classpath-exception
5 | classpath | classpath exception 2 0
3 | classpath | with (?:the )?classpath exception
= gpl-with-linking-exception
3 | linking | (?:static )?linking exception
= lgpl-2.0
5 | spdx+lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
3 | library+gnu | gnu library general public license(?: (?:version |v)2(?: 0)?)?
= lgpl-2.1
5 | spdx+lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
5 | gnu+lgpl | gnu org licenses (?:old licenses )?lgpl 2 1(?: W)?
3 | lesser | gnu lesser general public license (?:version |v)2 1
3 | lgpl | lgpl ?(?:version |v)?2 1(?: or later| only)?
= lgpl-3.0
5 | spdx+lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
5 | gnu+lgpl | gnu org licenses lgpl 3 0(?: W)?
3 | lesser | gnu lesser general public license (?:version |v)3(?: 0)?
3 | lgpl | lgpl ?(?:version |v)?3(?: 0)?(?: or later| only)?
= lgpl
4 | lesser | under the terms of the gnu lesser general public license
2 | lesser | (?:gnu )?lesser general public license
1 | lgpl | lgpl
= agpl-3.0
5 | spdx+agpl | spdx license identifier agpl 3 0(?: only| or later)?
5 | gnu+agpl | gnu org licenses agpl 3 0(?: W)?
3 | affero | gnu affero general public license (?:version |v)3(?: 0)?
3 | agpl | agpl ?(?:version |v)?3(?: 0)?(?: or later| only)?
= agpl
4 | affero | under the terms of the gnu affero general public license
2 | affero | (?:gnu )?affero general public license
1 | agpl | agpl
= gfdl
5 | spdx+gfdl | spdx license identifier gfdl 1 [123](?: only| or later)?
4 | invariant+sections | with no invariant sections no front cover texts and no back cover texts
3 | documentation+gnu | gnu free documentation license (?:version |v)1 [123]
2 | documentation+gnu | (?:gnu )?free documentation license
1 | gfdl | gfdl
= cc0-1.0
5 | spdx+cc0 | spdx license identifier cc0 1 0
5 | publicdomain | creativecommons org publicdomain zero 1 0
3 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
3 | zero+creative | creative commons zero(?: 1 0)?
= cc-by-1.0
3 | cc | cc by 1 0
3 | creative | creative commons attribution 1 0(?: W)?
= cc-by-2.0
3 | cc | cc by 2 0
3 | creative | creative commons attribution 2 0(?: W)?
= cc-by-2.5
3 | cc | cc by 2 5
3 | creative | creative commons attribution 2 5(?: W)?
= cc-by-3.0
5 | creativecommons | creativecommons org licenses by 3 0
3 | cc | cc by 3 0
3 | creative | creative commons attribution 3 0(?: W)?
= cc-by-4.0
5 | creativecommons | creativecommons org licenses by 4 0
5 | spdx+cc | spdx license identifier cc by 4 0
3 | cc | cc by 4 0
3 | creative | creative commons attribution 4 0(?: international)?
= cc-by
4 | cc | (?:licensed|released|distributed|available) under (?:the |a )?cc by
2 | cc | cc by
2 | creative | creative commons attribution(?: licen[sc]e)?
= cc-by-sa-3.0
5 | creativecommons | creativecommons org licenses by sa 3 0
5 | spdx+cc | spdx license identifier cc by sa 3 0
3 | cc | cc by sa 3 0
3 | sharealike | (?:creative commons )?attribution share ?alike 3 0(?: unported)?
= cc-by-sa-4.0
5 | creativecommons | creativecommons org licenses by sa 4 0
5 | spdx+cc | spdx license identifier cc by sa 4 0
3 | cc | cc by sa 4 0
3 | sharealike | (?:creative commons )?attribution share ?alike 4 0(?: international)?
= cc-by-sa
4 | cc | (?:licensed|released|distributed|available) under (?:the |a )?cc by sa
2 | cc | cc by sa
2 | creative+alike | creative commons attribution share ?alike
= cc-by-nc-4.0
5 | creativecommons | creativecommons org licenses by nc 4 0
5 | spdx+cc | spdx license identifier cc by nc 4 0
4 | cc | (?:licensed|released|distributed|available) under (?:the |a )?cc by nc 4 0
3 | cc | cc by nc 4 0
3 | noncommercial | (?:creative commons )?attribution non ?commercial 4 0(?: international)?
= cc-by-nc-3.0
5 | creativecommons | creativecommons org licenses by nc 3 0
5 | spdx+cc | spdx license identifier cc by nc 3 0
3 | cc | cc by nc 3 0
= cc-by-nc
4 | cc | (?:licensed|released|distributed|available) under (?:the |a )?cc by nc
2 | cc | cc by nc
2 | creative+commercial | creative commons attribution non ?commercial
= cc-by-nd
5 | creativecommons | creativecommons org licenses by nd [234] [05]
5 | spdx+cc | spdx license identifier cc by nd [1234] [05]
3 | cc | cc by nd(?: [1234] [05])?
2 | creative+derivatives | creative commons attribution no ?deriv(?:ative)?s?
= cc-by-nc-sa
5 | creativecommons | creativecommons org licenses by nc sa [234] [05]
5 | spdx+cc | spdx license identifier cc by nc sa [1234] [05]
3 | cc | cc by nc sa(?: [1234] [05])?
2 | creative+alike | creative commons attribution non ?commercial share ?alike
= cc-by-nc-nd
5 | creativecommons | creativecommons org licenses by nc nd [234] [05]
5 | spdx+cc | spdx license identifier cc by nc nd [1234] [05]
3 | cc | cc by nc nd(?: [1234] [05])?
2 | creative+derivatives | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
= creative-commons
1 | creative | creative commons licen[sc]ed?
1 | creativecommons | creativecommons org
= public-domain
5 | creativecommons | creativecommons org licenses publicdomain
4 | public+domain | (?:released|dedicated|placed) (?:in|to|into) the public domain
4 | public+domain | this (?:work|file|code|software) is in the public domain
2 | public+domain | public domain dedication
1 | public+domain | public domain
= unlicense
5 | spdx+unlicense | spdx license identifier unlicense
5 | unlicense | unlicense org
4 | unencumbered | this is free and unencumbered software released into the public domain
2 | unlicense | (?:the )?unlicense
= mpl-1.0
5 | spdx+mpl | spdx license identifier mpl 1 0
3 | mozilla | mozilla public license (?:version |v)?1 0
= mpl-1.1
5 | spdx+mpl | spdx license identifier mpl 1 1
5 | mozilla | mozilla org mpl (?:1 1|mpl 1 1)(?: W)?
3 | mozilla | mozilla public license (?:version |v)?1 1
3 | mpl | mpl 1 1
= mpl-2.0
5 | spdx+mpl | spdx license identifier mpl 2 0(?: no copyleft exception)?
5 | mozilla | mozilla org mpl 2 0
4 | mozilla | subject to the terms of the mozilla public license v 2 0
3 | mozilla | mozilla public license (?:version |v )?2 0
3 | mpl | mpl 2 0
= mpl
2 | mozilla | mozilla public license
= epl-1.0
5 | spdx+epl | spdx license identifier epl 1 0
5 | eclipse | eclipse org legal epl v10(?: W)?
3 | eclipse | eclipse public license (?:version |v )?1 0
3 | epl | epl 1 0
= epl-2.0
5 | spdx+epl | spdx license identifier epl 2 0
5 | eclipse | eclipse org legal epl (?:2 0|v20)(?: W)?
3 | eclipse | eclipse public license (?:version |v )?2 0
3 | epl | epl 2 0
= epl
2 | eclipse | eclipse public license
= edl-1.0
3 | eclipse+distribution | eclipse distribution license(?: v? ?1 0)?
= cpl-1.0
5 | spdx+cpl | spdx license identifier cpl 1 0
2 | common | common public license(?: (?:version |v)?1 0)?
= cddl-1.0
5 | spdx+cddl | spdx license identifier cddl 1 0
3 | cddl | cddl (?:version |v)?1 0
2 | common+distribution | common development and distribution license(?: (?:version |v)?1 0)?
= cddl-1.1
5 | spdx+cddl | spdx license identifier cddl 1 1
3 | cddl | cddl (?:version |v)?1 1
= artistic-1.0
5 | spdx+artistic | spdx license identifier artistic 1 0(?: perl| cl8)?
3 | artistic | artistic license (?:version |v)?1 0
= artistic-2.0
5 | spdx+artistic | spdx license identifier artistic 2 0
3 | artistic | artistic license (?:version |v)?2 0
= artistic
2 | artistic | (?:the )?artistic license
4 | perl | under the same terms as perl(?: itself)?
= bsl-1.0
5 | spdx+bsl | spdx license identifier bsl 1 0
5 | boost | boost org license 1 0 txt
4 | boost | distributed under the boost software license(?: version 1 0)?
2 | boost | boost software license(?: (?:version )?1 0)?
= busl-1.1
5 | spdx+busl | spdx license identifier busl 1 1
2 | business | business source license(?: 1 1)?
= zlib
5 | spdx+zlib | spdx license identifier zlib
4 | damages+origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
3 | zlib+libpng | zlib libpng license
2 | zlib | zlib license
= libpng
5 | spdx+libpng | spdx license identifier libpng(?: 2 0)?
2 | libpng | libpng license
= wtfpl
5 | spdx+wtfpl | spdx license identifier wtfpl
2 | want | do what the f[a-z]* you want to public license
2 | wtfpl | wtfpl
= beerware
5 | spdx+beerware | spdx license identifier beerware
2 | beer | the beer ?ware license
= postgresql
5 | spdx+postgresql | spdx license identifier postgresql
2 | postgresql | (?:the )?postgresql license
= python-2.0
5 | spdx+python | spdx license identifier (?:python|psf) 2 0
2 | python | (?:python software foundation|psf) license(?: version 2)?
= ruby
5 | spdx+ruby | spdx license identifier ruby
2 | ruby | (?:the )?ruby license
= php-3.01
5 | spdx+php | spdx license identifier php 3 01
2 | php | (?:the )?php license(?: version 3 01)?
= openssl
5 | spdx+openssl | spdx license identifier openssl
2 | openssl | openssl license
= curl
5 | spdx+curl | spdx license identifier curl
= ncsa
5 | spdx+ncsa | spdx license identifier ncsa
3 | ncsa | university of illinois ncsa open source license
= llvm-exception
5 | llvm | with llvm exception
= ofl-1.1
5 | spdx+ofl | spdx license identifier ofl 1 1(?: rfn| no rfn)?
5 | scripts+ofl | scripts sil org ofl
3 | sil | sil open font license(?: version| v)?(?: 1 1)?
2 | font | open font license
= eupl-1.1
5 | spdx+eupl | spdx license identifier eupl 1 1
3 | eupl | eupl (?:v ?)?1 1
= eupl-1.2
5 | spdx+eupl | spdx license identifier eupl 1 2
3 | eupl | eupl (?:v ?)?1 2
= eupl
2 | european | european union public licen[sc]e
= odbl-1.0
5 | spdx+odbl | spdx license identifier odbl 1 0
2 | database | open (?:data commons open )?database license(?: odbl)?(?: v?1 0)?
= odc-by-1.0
5 | spdx+odc | spdx license identifier odc by 1 0
2 | commons+data | open data commons attribution license(?: v?1 0)?
= pddl-1.0
5 | spdx+pddl | spdx license identifier pddl 1 0
2 | dedication+data | (?:open data commons )?public domain dedication and license
= ogl-3.0
2 | government | open government licen[sc]e(?: v ?3 0)?
= ms-pl
5 | spdx+ms | spdx license identifier ms pl
2 | microsoft | microsoft public license(?: ms pl)?
= ms-rl
5 | spdx+ms | spdx license identifier ms rl
2 | microsoft | microsoft reciprocal license(?: ms rl)?
= osl-3.0
5 | spdx+osl | spdx license identifier osl 3 0
2 | open+software | open software license(?: (?:version |v )?3 0)?
= afl-3.0
5 | spdx+afl | spdx license identifier afl 3 0
2 | academic | academic free license(?: (?:version |v )?3 0)?
= upl-1.0
5 | spdx+upl | spdx license identifier upl 1 0
2 | universal | universal permissive license(?: v? ?1 0)?
= mulanpsl-2.0
5 | mulan | spdx license identifier mulanpsl 2 0
2 | mulan | mulan permissive software license(?: version 2)?
= sspl-1.0
5 | spdx+sspl | spdx license identifier sspl 1 0
2 | server | server side public license(?: (?:version |v)?1)?
= elastic-2.0
5 | spdx+elastic | spdx license identifier elastic 2 0
2 | elastic | elastic license(?: 2 0)?
= openrail
2 | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[sc]e)?
= ijg
3 | jpeg | independent jpeg group s? ?license
= unicode
5 | spdx+unicode | spdx license identifier unicode (?:dfs 201[56]|3 0|tou)
2 | unicode | unicode license agreement(?: data files and software)?
= w3c
5 | spdx+w3c | spdx license identifier w3c(?: 20150513)?
2 | w3c | w3c software (?:notice and )?license
= proprietary
4 | confidential | (?:proprietary and confidential|confidential and proprietary)
3 | unauthorized | unauthorized (?:copying|use|distribution)(?: or (?:copying|use|distribution))? of (?:W ){1,6}is (?:strictly )?prohibited
2 | reserved | all rights reserved
= reference-only
1 | license+details | see (?:the )?(?:accompanying )?license(?: file)?(?: txt| md)? for (?:more |further |full )?details
1 | license+governing | for the specific language governing permissions and limitations under the license
"""
