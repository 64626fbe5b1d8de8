"""License signatures, written by hand: (label, weight, priority, expression).

Expressions are over words of a-z, 0-9 and non-ASCII characters, joined by single spaces. They hold literals, classes,
groups with alternatives, optional groups and bounded gaps ``(?:\\S+ ){m,n}``; nothing in them is unbounded. Whole
sentences of license texts come first, then notices that name a license, then hints. Lower lines lose to higher ones
that cover them, by priority.
"""

#: Sentences of license texts.
TEXTS = (
    ("mit", 0.99, 96, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("mit", 0.98, 95, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 0.9, 88, r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", 0.7, 60, r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-0", 0.97, 97, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", 0.95, 90, r"except as contained in this notice the names? of (?:\S+ ){1,12}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("isc", 0.98, 95, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 0.95, 92, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", 0.97, 96, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", 0.95, 93, r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("bsd", 0.97, 90, r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 0.85, 84, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 0.85, 84, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3", 0.98, 92, r"neither the name of (?:\S+ ){1,12}nor the names of (?:its|the|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3", 0.95, 91, r"the names? of (?:\S+ ){1,8}may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-4", 0.98, 93, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-clear", 0.96, 93, r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-patent", 0.96, 93, r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual"),
    ("bsd-nuclear", 0.9, 91, r"you acknowledge that this software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("apache-2", 0.99, 96, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", 0.95, 92, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", 0.97, 95, r"apache license version 2 0 january 2004"),
    ("apache-2", 0.9, 88, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    ("apache-1.1", 0.97, 95, r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", 0.96, 94, r"this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl-2", 0.98, 95, r"gnu general public license version 2 june 1991"),
    ("gpl-3", 0.98, 95, r"gnu general public license version 3 29 june 2007"),
    ("gpl-1", 0.98, 95, r"gnu general public license version 1 february 1989"),
    ("lgpl-2", 0.98, 95, r"gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", 0.98, 95, r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", 0.98, 95, r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", 0.98, 95, r"gnu affero general public license version 3 19 november 2007"),
    ("gpl-2+", 0.97, 94, r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version"),
    ("gpl-3+", 0.97, 94, r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("gpl-2", 0.96, 93, r"under the terms of the gnu general public license(?: version 2)? as published by the free software foundation version 2"),
    ("gpl-2", 0.96, 93, r"under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation"),
    ("lgpl-2.1+", 0.97, 94, r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version"),
    ("lgpl-2+", 0.97, 94, r"under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version"),
    ("lgpl-3+", 0.97, 94, r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("agpl-3+", 0.97, 94, r"under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("gpl", 0.94, 89, r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 0.94, 89, r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", 0.94, 89, r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", 0.85, 80, r"you should have received a copy of the gnu general public license along with this (?:program|library|software|package|file)"),
    ("lgpl", 0.85, 80, r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|software|package|file)"),
    ("agpl", 0.85, 80, r"you should have received a copy of the gnu affero general public license along with this program"),
    ("gpl-classpath", 0.96, 96, r"as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable"),
    ("gpl-gcc-exception", 0.95, 96, r"gcc runtime library exception"),
    ("gpl-openssl-exception", 0.93, 95, r"permission to link the code of (?:\S+ ){1,8}with the openssl library"),
    ("gfdl", 0.97, 94, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-notice", 0.5, 35, r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2", 0.99, 96, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 0.98, 95, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", 0.98, 95, r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-1.1", 0.8, 70, r"software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights"),
    ("npl-1", 0.97, 95, r"the contents of this file are subject to the netscape public license"),
    ("cddl-1", 0.98, 95, r"the contents of this file are subject to the terms of (?:either )?(?:the )?common development and distribution license"),
    ("epl-1", 0.98, 95, r"made available under the terms of the eclipse public license v1 0 which accompanies this distribution"),
    ("epl-2", 0.98, 95, r"made available under the terms of the eclipse public license (?:2 0|v 2 0) which is available at"),
    ("epl-2", 0.9, 88, r"the accompanying program is provided under the terms of this eclipse public license"),
    ("edl-1", 0.96, 93, r"made available under the terms of the eclipse distribution license v(?: )?1 0"),
    ("cpl-1", 0.96, 93, r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1", 0.96, 93, r"the accompanying program is provided under the terms of this ibm public license"),
    ("osl-3", 0.96, 93, r"licensed under the open software license version 3 0"),
    ("afl-3", 0.96, 93, r"licensed under the academic free license version 3 0"),
    ("artistic-1", 0.95, 92, r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2", 0.96, 93, r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", 0.95, 92, r"under the same terms as perl itself"),
    ("ruby", 0.93, 90, r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("python", 0.95, 92, r"this license agreement is between the python software foundation"),
    ("php-3", 0.95, 92, r"this source file is subject to version 3 01 of the php license"),
    ("zlib", 0.97, 92, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 0.93, 90, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("libpng", 0.95, 93, r"this copy of the libpng notices is provided for your convenience"),
    ("ijg", 0.95, 92, r"this software is based in part on the work of the independent jpeg group"),
    ("openssl", 0.97, 94, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 0.96, 93, r"this product includes cryptographic software written by eric young"),
    ("curl", 0.9, 90, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is"),
    ("boost-1", 0.98, 95, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1", 0.98, 94, r"distributed under the boost software license version 1 0"),
    ("ncsa", 0.96, 94, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("unlicense", 0.99, 96, r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 0.98, 95, r"do what the fuck you want to public license terms and conditions for copying distribution and modification"),
    ("wtfpl", 0.97, 94, r"you just do what the fuck you want to"),
    ("beerware", 0.96, 93, r"as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("json", 0.95, 97, r"the software shall be used for good not evil"),
    ("postgresql", 0.95, 93, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("unicode", 0.95, 92, r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("w3c", 0.95, 92, r"permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("ofl-1.1", 0.98, 95, r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 0.9, 88, r"the fonts and derivatives however cannot be released under any other type of license"),
    ("ms-pl", 0.96, 93, r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("eupl-1.2", 0.97, 94, r"licensed under the eupl(?: version)?(?: v)? ?1 2"),
    ("eupl-1.1", 0.97, 94, r"licensed under the eupl(?: version)?(?: v)? ?1 1"),
    ("cecill", 0.96, 93, r"this software is governed by the cecill(?: \S)? license under french law"),
    ("upl-1", 0.96, 94, r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("cc0-1", 0.97, 94, r"to the extent possible under law (?:\S+ ){1,8}waived all copyright and related or neighboring rights"),
    ("cc-by", 0.96, 92, r"this work is licensed under (?:a|the) creative commons attribution (?:1|2|3|4) (?:0|5) (?:international|generic|unported) license"),
    ("cc-by-sa", 0.96, 93, r"this work is licensed under (?:a|the) creative commons attribution share ?alike (?:1|2|3|4) (?:0|5) (?:international|generic|unported) license"),
    ("cc-by-nd", 0.96, 93, r"this work is licensed under (?:a|the) creative commons attribution no ?derivatives (?:1|2|3|4) (?:0|5) (?:international|generic|unported) license"),
    ("cc-by-nc", 0.96, 93, r"this work is licensed under (?:a|the) creative commons attribution non ?commercial (?:1|2|3|4) (?:0|5) (?:international|generic|unported) license"),
    ("cc-by-nc-sa", 0.96, 94, r"this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike (?:1|2|3|4) (?:0|5) (?:international|generic|unported) license"),
    ("cc-by-nc-nd", 0.96, 94, r"this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:1|2|3|4) (?:0|5) (?:international|generic|unported) license"),
    ("odbl-1", 0.96, 93, r"made available under the open database license"),
    ("odc-by-1", 0.96, 93, r"made available under the open data commons attribution license"),
    ("pddl-1", 0.96, 93, r"made available under the public domain dedication and license"),
    ("sspl-1", 0.97, 94, r"under the terms of the server side public license version 1"),
    ("elastic-2", 0.96, 94, r"you may not provide the software to third parties as a hosted or managed service"),
    ("business-source", 0.96, 94, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", 0.96, 95, r"the license does not grant to you the right to sell the software"),
    ("polyform-nc", 0.96, 94, r"polyform noncommercial license"),
    ("polyform-sb", 0.96, 94, r"polyform small business license"),
    ("confluent", 0.95, 93, r"confluent community license(?: agreement)?"),
    ("rail", 0.95, 93, r"(?:creative ml|bigscience|open) ?(?:open)? ?rail(?: m| \+\+ m)?(?: license)"),
    ("llama", 0.95, 93, r"llama (?:2|3|3 1|3 2) community license agreement"),
    ("gemma", 0.93, 92, r"gemma terms of use"),
)
#: Notices that name a license shortly, and addresses of license texts.
NOTICES = (
    ("apache-2", 0.97, 91, r"www apache org licenses license 2 0(?: html| txt)?"),
    ("apache-2", 0.95, 90, r"apache org licenses license 2 0"),
    ("apache-2", 0.8, 66, r"(?:asl|al|apache) ?2 0 licen[cs]ed"),
    ("mit", 0.95, 90, r"opensource org licenses? mit(?: license)?(?: php| html)?"),
    ("mit", 0.8, 66, r"mit licen[cs]ed"),
    ("mit", 0.7, 58, r"licen[cs]e mit"),
    ("isc", 0.95, 90, r"opensource org licenses? isc(?: license)?"),
    ("isc", 0.7, 58, r"licen[cs]e isc"),
    ("bsd-2", 0.95, 90, r"opensource org licenses? bsd 2 clause"),
    ("bsd-3", 0.95, 90, r"opensource org licenses? bsd 3 clause"),
    ("bsd", 0.9, 86, r"opensource org licenses? bsd license(?: php)?"),
    ("bsd", 0.75, 62, r"(?:a |the )?bsd style license that can be found in the license file"),
    ("bsd", 0.7, 58, r"licen[cs]e bsd"),
    ("gpl-2", 0.95, 90, r"www gnu org licenses old licenses gpl 2 0"),
    ("gpl-3", 0.95, 90, r"www gnu org licenses gpl 3 0"),
    ("gpl", 0.93, 88, r"www gnu org (?:licenses|copyleft) gpl(?: html| txt)?"),
    ("lgpl-2.1", 0.95, 90, r"www gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3", 0.95, 90, r"www gnu org licenses lgpl 3 0"),
    ("lgpl", 0.93, 88, r"www gnu org (?:licenses|copyleft) lesser(?: html)?"),
    ("agpl-3", 0.95, 90, r"www gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", 0.93, 88, r"www gnu org (?:licenses|copyleft) fdl"),
    ("gpl-2", 0.85, 72, r"(?:gpl ?v ?2|gplv2)(?: only)?"),
    ("gpl-2+", 0.88, 73, r"(?:gpl ?v ?2|gplv2) or later"),
    ("gpl-3", 0.85, 72, r"(?:gpl ?v ?3|gplv3)(?: only)?"),
    ("gpl-3+", 0.88, 73, r"(?:gpl ?v ?3|gplv3) or later"),
    ("lgpl-2.1", 0.85, 74, r"(?:lgpl ?v ?2 1|lgplv2 1)"),
    ("lgpl-3", 0.85, 74, r"(?:lgpl ?v ?3|lgplv3)"),
    ("agpl-3", 0.85, 74, r"(?:agpl ?v ?3|agplv3)"),
    ("mpl-2", 0.95, 90, r"(?:www )?mozilla org (?:mpl|en us mpl) 2 0"),
    ("mpl-1.1", 0.93, 88, r"(?:www )?mozilla org mpl(?: mpl 1 1)?(?: html)?"),
    ("mpl-2", 0.8, 68, r"mpl 2 0"),
    ("epl-1", 0.93, 88, r"www eclipse org legal epl v10(?: html)?"),
    ("epl-2", 0.93, 88, r"www eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("edl-1", 0.93, 88, r"www eclipse org org documents edl v10"),
    ("cddl-1", 0.85, 74, r"cddl(?: version)? 1 0"),
    ("boost-1", 0.95, 90, r"www boost org license 1 0 txt"),
    ("unlicense", 0.95, 90, r"unlicense org"),
    ("wtfpl", 0.93, 88, r"(?:www )?wtfpl net"),
    ("ofl-1.1", 0.95, 90, r"scripts sil org ofl"),
    ("artistic-2", 0.93, 88, r"www perlfoundation org artistic license 2 0"),
    ("php-3", 0.93, 88, r"www php net license 3 01(?: txt)?"),
    ("zlib", 0.85, 72, r"(?:zlib|libpng) style license"),
    ("cc-by", 0.95, 82, r"creativecommons org licenses by (?:1|2|3|4) (?:0|5)"),
    ("cc-by-sa", 0.95, 83, r"creativecommons org licenses by sa (?:1|2|3|4) (?:0|5)"),
    ("cc-by-nd", 0.95, 83, r"creativecommons org licenses by nd (?:1|2|3|4) (?:0|5)"),
    ("cc-by-nc", 0.95, 83, r"creativecommons org licenses by nc (?:1|2|3|4) (?:0|5)"),
    ("cc-by-nc-sa", 0.95, 84, r"creativecommons org licenses by nc sa (?:1|2|3|4) (?:0|5)"),
    ("cc-by-nc-nd", 0.95, 84, r"creativecommons org licenses by nc nd (?:1|2|3|4) (?:0|5)"),
    ("cc0-1", 0.97, 92, r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", 0.95, 91, r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", 0.8, 62, r"cc by (?:1|2|3|4) (?:0|5)"),
    ("cc-by-sa", 0.85, 64, r"cc by sa(?: (?:1|2|3|4) (?:0|5))?"),
    ("cc-by-nd", 0.85, 64, r"cc by nd(?: (?:1|2|3|4) (?:0|5))?"),
    ("cc-by-nc-sa", 0.88, 65, r"cc by nc sa(?: (?:1|2|3|4) (?:0|5))?"),
    ("cc-by-nc-nd", 0.88, 65, r"cc by nc nd(?: (?:1|2|3|4) (?:0|5))?"),
    ("cc0-1", 0.85, 64, r"cc0(?: 1 0)?"),
    ("odbl-1", 0.93, 88, r"opendatacommons org licenses odbl"),
    ("odc-by-1", 0.93, 88, r"opendatacommons org licenses by"),
    ("pddl-1", 0.93, 88, r"opendatacommons org licenses pddl"),
    ("cdla-permissive", 0.93, 88, r"community data license agreement permissive"),
    ("cdla-sharing", 0.93, 88, r"community data license agreement sharing"),
    ("ogl-uk", 0.93, 88, r"open government licen[cs]e(?: v3 0)?"),
    ("etalab-2", 0.93, 88, r"licence ouverte"),
    ("mulan-psl-2", 0.95, 90, r"mulan (?:psl v2|permissive software license)"),
    ("elastic-2", 0.93, 88, r"elastic license 2 0"),
    ("sspl-1", 0.9, 80, r"server side public license"),
    ("business-source", 0.93, 88, r"business source license 1 1"),
    ("gpl-dual", 0.8, 67, r"dual licensed under (?:the )?(?:mit and gpl|gpl and mit|bsd and gpl|gpl and bsd)"),
    ("gpl-module", 0.85, 70, r"module license gpl(?: v2)?"),
)
#: Hints that say something about rights, but name no license.
HINTS = (
    ("public-domain", 0.8, 50, r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain"),
    ("public-domain", 0.6, 40, r"(?:is|are) in the public domain"),
    ("public-domain", 0.7, 45, r"the authors? disclaims? copyright to this source code"),
    ("public-domain", 0.6, 42, r"this file is not copyrighted"),
    ("proprietary", 0.4, 20, r"all rights reserved"),
    ("proprietary", 0.7, 45, r"proprietary and confidential"),
    ("proprietary", 0.7, 45, r"confidential and proprietary(?: information)?"),
    ("proprietary", 0.75, 46, r"unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or distribution)? of this (?:file|software|document|material)"),
    ("proprietary", 0.7, 45, r"no part of this (?:publication|document|book|work) may be reproduced"),
    ("proprietary", 0.6, 44, r"end user license agreement"),
    ("proprietary", 0.5, 38, r"for internal use only"),
    ("proprietary", 0.6, 43, r"may not be (?:copied|reproduced|distributed|published)(?: in any form)? without (?:the )?(?:prior |express )?(?:written )?permission"),
    ("non-commercial", 0.6, 44, r"for (?:non ?commercial|personal|academic|research|educational) use only"),
    ("non-commercial", 0.6, 43, r"not for commercial use"),
    ("non-commercial", 0.6, 43, r"commercial use is (?:prohibited|not permitted|forbidden)"),
    ("open-source", 0.4, 25, r"this is (?:free|open source) software"),
    ("warranty", 0.5, 15, r"(?:provided )?as is without warranty of any kind"),
    ("warranty", 0.4, 14, r"in no event shall the (?:authors|copyright holders|regents|contributors)(?: or copyright holders| or contributors)? be liable"),
    ("copyright", 0.5, 10, r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    ("copyright", 0.4, 9, r"(?:19|20)\d\d by the authors?"),
)
