"""License signatures: ordered rules over normalised words.

A rule is (label, keyword, expression, priority, score). Expressions are matched against the
words of a text, lower-cased and joined by single blanks, so line breaks, comment marks and
punctuation don't matter: "Apache License, Version 2.0" reads "apache license version 2 0".
The keyword is a literal that every match of the expression holds. Priorities: 1 sentences of
a license's own text and its identifier tag, 2 grants, 3 titles with a version, 4 addresses,
5 names, 6 and 7 mere hints.
"""

from __future__ import annotations

#: Sentences that stand in a license's own text.
BODIES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "without restriction", r"without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "shall not be used in advertising", r"except as contained in this notice the names? of (?:the )?(?:above copyright holders|x consortium) shall not be used in advertising"),
    ("mit", "noninfringement", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of (?:\S+ ){1,12}(?:nor the names of (?:its|their) contributors )?may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "permission", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "acknowledg", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd", "copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "regents", r"this software is provided by the regents and contributors as is"),
    ("bsd-2-clause", "copyright holders", r"the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies(?: either expressed or implied of the copyright holders)"),
    ("isc", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "author disclaims all", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties"),
    ("hpnd", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee|is hereby granted)"),
    ("hpnd-sell", "permission to use", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted"),
    ("zlib", "event will the authors", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", "permission is granted", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", "misrepresented", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "definitions license", r"terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-2.0", "copyright license", r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive"),
    ("apache-2.0", "patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-1.1", "may not be called apache", r"products derived from this software may not be called apache nor may apache appear in their name without prior written permission"),
    ("gpl", "general public license", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "general public license", r"gnu general public license as published by the free software foundation either version 2 of the license or(?: \S+){0,3} any later version"),
    ("gpl-3.0", "general public license", r"gnu general public license as published by the free software foundation either version 3 of the license or(?: \S+){0,3} any later version"),
    ("gpl-2.0-only", "general public license", r"terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0-only", "general public license", r"terms of the gnu general public license version 3 as published by the free software foundation"),
    ("gpl", "general public license", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "in the hope that", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "take away your freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", "june 1991", r"gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation"),
    ("gpl-3.0", "june 2007", r"gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation"),
    ("gpl-3.0", "free copyleft license", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-1.0", "february 1989", r"gnu general public license version 1 february 1989 copyright c 1989 free software foundation"),
    ("lgpl", "general public license", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "lesser general public license", r"you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("lgpl-2.1", "lesser general public license", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", "lesser general public license", r"gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.0", "library general public license", r"gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-2.1", "february 1999", r"gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation"),
    ("lgpl-3.0", "incorporates the terms", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3.0", "affero general public license", r"terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3.0", "affero general public license", r"you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl-3.0", "free copyleft license", r"the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation"),
    ("gfdl", "permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "manual textbook", r"the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("gpl-classpath", "special exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("mpl-2.0", "mozilla public license", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org"),
    ("mpl-1.1", "mozilla public license", r"the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance"),
    ("mpl-1.0", "mozilla public license", r"the contents of this file are subject to the mozilla public license version 1 0 the license"),
    ("epl-1.0", "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0 which accompanies"),
    ("epl-2.0", "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v(?:ersion)?)? ?2 0"),
    ("epl", "the accompanying program", r"the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("cpl-1.0", "the accompanying program", r"the accompanying program is provided under the terms of this common public license agreement"),
    ("ipl-1.0", "the accompanying program", r"the accompanying program is provided under the terms of this ibm public license agreement"),
    ("cddl-1.0", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("boost", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", "boost software license", r"distributed under the boost software license version 1 0 see accompanying file"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "license document", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("wtfpl", "do what the", r"do what the fuck you want to public license terms and conditions"),
    ("beerware", "beer ware", r"the beer ware license revision 42"),
    ("artistic-1.0", "artistic control", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "this license establishes", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("python-2.0", "python software foundation", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("cnri-python", "national research initiatives", r"this license agreement is between the corporation for national research initiatives"),
    ("openssl", "redistributions", r"redistributions of any form whatsoever must retain the following acknowledgment this product includes software developed by the openssl project"),
    ("ssleay", "ssl implementation", r"this package is an ssl implementation written by eric young"),
    ("php-3.01", "the name php", r"the name php must not be used to endorse or promote products derived from this software without prior written permission"),
    ("zpl-2.1", " zope ", r"this software is copyright (?:\S+ ){1,6}zope (?:corporation|foundation)"),
    ("w3c", "by obtaining using", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("ncsa", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("afl", "licensed under the academic", r"licensed under the academic free license version [123] [01]"),
    ("osl", "licensed under the open", r"licensed under the open software license version [123] [01]"),
    ("cecill", "governed by the cecill", r"this software is governed by the cecill(?: [bc])? license under french law"),
    ("eupl", "licensed under the eupl", r"licensed under the eupl (?:version )?1 [12](?: or as soon they will be approved)?"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font software", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("bitstream-vera", "fonts accompanying", r"permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license"),
    ("cc0-1.0", "public domain", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "copyright and related", r"to the extent possible under law (?:\S+ ){1,12}has waived all copyright and related or neighboring rights"),
    ("cc-by", "creative commons", r"creative commons corporation creative commons is not a law firm and does not provide legal services"),
    ("cc-by", "by exercising", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution"),
    ("cc-by-sa", "remix transform", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", "redistribution", r"this license allows for redistribution commercial and non commercial as long as it is passed along unchanged and in whole"),
    ("cc-by-nc", "license lets others", r"this license lets others remix tweak and build upon your work non commercially"),
    ("odbl", "open database license", r"the open database license odbl is a license agreement intended to allow users to freely share modify and use this database"),
    ("odbl", "open database license", r"is made available under the open database license"),
    ("busl-1.1", "business source license", r"the business source license this document or the license is not an open source license"),
    ("busl-1.1", "non production use", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", "grant of rights", r"without limiting other conditions in the license the grant of rights under the license will not include(?: and the license does not grant to you)? the right to sell the software"),
    ("ms-pl", "accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("qpl", "q public license", r"this license applies to any software containing a notice placed by the copyright holder saying that it may be distributed under the terms of the q public license"),
    ("json", "software shall be used for good", r"the software shall be used for good not evil"),
    ("curl", "hereby granted provided", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("libtiff", "permission to use", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("postgresql", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("tcl", "authors hereby grant", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained"),
    ("ijg", "thomas g lane", r"this software is copyright c (?:[0-9]+ )+thomas g lane"),
    ("llama", "community license", r"llama(?: [234](?: [0-9])?)? community license agreement"),
    ("proprietary", "no part of this", r"no part of this (?:publication|document|book|work) may be reproduced(?: \S+){0,20} without (?:the )?(?:prior )?(?:written )?permission(?: \S+){0,4} copyright"),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: \S+){0,12} prohibited(?: \S+){0,12} rights reserved"),
]

#: Identifiers that follow the SPDX tag.
SPDX = [
    "0bsd", "afl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "apache-1.1", "apache-2.0", "artistic-1.0", "artistic-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-3-clause-clear", "bsd-4-clause",
    "bsl-1.0", "busl-1.1", "cc-by-3.0", "cc-by-4.0", "cc-by-nc-4.0", "cc-by-nc-nd-4.0", "cc-by-nc-sa-4.0", "cc-by-nd-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc0-1.0", "cddl-1.0", "cecill-2.1",
    "ecl-2.0", "epl-1.0", "epl-2.0", "eupl-1.2", "gfdl-1.3-only", "gpl-1.0-only", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later", "isc", "lgpl-2.0-only", "lgpl-2.1-only", "lgpl-2.1-or-later",
    "lgpl-3.0-only", "lgpl-3.0-or-later", "mit", "mit-0", "mpl-1.1", "mpl-2.0", "ms-pl", "ncsa", "odbl-1.0", "ofl-1.1", "openssl", "osl-3.0", "php-3.01", "postgresql", "psf-2.0", "python-2.0", "sspl-1.0", "unlicense", "upl-1.0", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl-2.1",
]

#: How a text puts itself under a license: label and the words after "under" or "to".
GRANTS = [
    ("mit", " mit ", r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?mit(?: x11)?(?: style)? licen[sc]e"),
    ("apache-2.0", "apache", r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("apache", "apache", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("bsd", "bsd", r"(?:licensed|released|distributed|available|provided|published|governed) (?:under|by) (?:the )?(?:terms of )?(?:the |a )?(?:new |modified |simplified |revised |[234] clause )?bsd(?: [234] clause)?(?: style)? licen[sc]e"),
    ("gpl", "general public", r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e"),
    ("gpl-2.0", "general public", r"(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e (?:version |v )2"),
    ("gpl-3.0", "general public", r"(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e (?:version |v )3"),
    ("gpl", "gpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl"),
    ("gpl-2.0", "gpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl ?v?(?:ersion )?2"),
    ("gpl-3.0", "gpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl ?v?(?:ersion )?3"),
    ("lgpl", "lgpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl"),
    ("lgpl", "lesser general public", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public licen[sc]e"),
    ("agpl-3.0", "affero", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public licen[sc]e"),
    ("mpl-2.0", "mozilla", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[sc]e(?: version| v)? ?2"),
    ("epl-2.0", "eclipse", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?eclipse public licen[sc]e(?: version| v)? ?2"),
    ("isc", "isc", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc licen[sc]e"),
    ("zlib", "zlib", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("boost", "boost", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?boost software licen[sc]e"),
    ("artistic", "artistic", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?artistic licen[sc]e"),
    ("perl", "perl", r"you can redistribute it and or modify it under the same terms as perl(?: 5)? itself"),
    ("python-2.0", "python", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?python software foundation licen[sc]e"),
    ("ruby", "ruby", r"(?:licensed|released|distributed|available) under (?:the )?(?:same )?terms (?:of|as) ruby"),
    ("ofl-1.1", "open font", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:sil )?open font licen[sc]e"),
    ("unlicense", "unlicense", r"(?:licensed|released|distributed|available) under (?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?wtfpl"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"is (?:hereby )?(?:in|placed in|part of) the public domain"),
    ("public-domain", "public domain", r"the author disclaims copyright to this source code(?: \S+){0,12} public domain"),
    ("cc-by", "attribution", r"(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the |a )?creative commons attribution(?: [1234] [05])?(?: international| unported)? licen[sc]e"),
    ("cc-by-sa", "creative commons", r"(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the |a )?creative commons attribution share ?alike"),
    ("cc-by-nc", "creative commons", r"(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the |a )?creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative commons", r"(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the |a )?creative commons attribution no ?deriv"),
    ("cc-by", "cc by", r"(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the |a )?cc by(?: [1234] [05])?"),
    ("cc0-1.0", "cc0", r"(?:licensed|released|distributed|available|published|dedicated) (?:under|to|by|as) (?:the )?(?:terms of )?(?:the )?(?:creative commons )?cc0"),
    ("odbl", "open database", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?open database licen[sc]e"),
    ("odc-by", "open data commons", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?open data commons attribution licen[sc]e"),
    ("pddl", "public domain dedication", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:open data commons )?public domain dedication and licen[sc]e"),
    ("commercial", "commercial licen", r"(?:requires|purchase|obtain|buy|under) (?:a |the )?commercial licen[sc]e"),
    ("proprietary", "proprietary licen", r"(?:licensed|released|distributed|available) under (?:a |the )?proprietary licen[sc]e"),
    ("dual", "dual licensed", r"dual licensed under"),
    ("dual", "at your option", r"licensed under either of (?:\S+ ){1,12}at your option"),
]

#: Titles with a version, as they head a license or name it in full.
TITLES = [
    ("apache-1.0", "apache", r"apache licen[sc]e(?: version)? 1 0"), ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e(?: version)? 1 1"), ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e(?: version| v)? ?2(?: 0)?"), ("apache-2.0", "apache", r"apache 2 0(?: licen[sc]e)?"), ("apache-2.0", "apache", r"asl(?: v)? ?2 0 apache"),
    ("bsd-1-clause", "clause", r"bsd 1 clause(?: licen[sc]e)?"), ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?"), ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?"), ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?"), ("0bsd", "bsd", r"(?:0bsd|zero clause bsd)(?: licen[sc]e)?"), ("bsd-3-clause-clear", "bsd", r"clear bsd licen[sc]e"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version|v) ?1(?: 0)?"), ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version|v) ?2(?: 0)?"), ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version|v) ?3(?: 0)?"), ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?(?:ersion )?2(?: 0)?(?: only| or later)?"), ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2(?: 0)?"), ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?(?:ersion )?3(?: 0)?(?: only| or later)?"), ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3(?: 0)?"),
    ("lgpl-2.0", "library general public", r"(?:gnu )?library general public licen[sc]e(?: (?:version|v) ?2(?: 0)?)?"), ("lgpl-2.1", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e (?:version|v) ?2 1"), ("lgpl-3.0", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e (?:version|v) ?3(?: 0)?"), ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2 1"), ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2(?: 1)?"), ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?"), ("lgpl-3.0", "lgplv3", r"(?:gnu )?lgplv3(?: 0)?"),
    ("agpl-1.0", "affero", r"affero general public licen[sc]e (?:version|v) ?1"), ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e (?:version|v) ?3(?: 0)?"), ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?"), ("agpl-3.0", "agplv3", r"(?:gnu )?agplv3"),
    ("gfdl-1.1", "documentation licen", r"(?:gnu )?free documentation licen[sc]e version 1 1"), ("gfdl-1.2", "documentation licen", r"(?:gnu )?free documentation licen[sc]e version 1 2"), ("gfdl-1.3", "documentation licen", r"(?:gnu )?free documentation licen[sc]e version 1 3"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?1 0"), ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?1 1"), ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?"), 
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?"), ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?"), ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: version| v)? ?1(?: 0)?"), ("cddl-1.0", "common development", r"common development and distribution licen[sc]e(?: cddl)?(?: version| v)? ?1 0"), ("cddl-1.1", "common development", r"common development and distribution licen[sc]e(?: cddl)?(?: version| v)? ?1 1"),
    ("boost", "boost", r"boost software licen[sc]e(?: version)? 1 0"), ("busl-1.1", "business source", r"business source licen[sc]e(?: version)? 1 1"), ("sspl-1.0", "server side public", r"server side public licen[sc]e(?: version| v)? ?1"), ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: version| v)? ?2(?: 0)?"), ("artistic-1.0", "artistic", r"artistic licen[sc]e(?: version)? 1 0"), ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: version)? 2 0"),
    ("afl-2.1", "academic free", r"academic free licen[sc]e(?: version| v)? ?2 1"), ("afl-3.0", "academic free", r"academic free licen[sc]e(?: version| v)? ?3(?: 0)?"), ("osl-2.1", "open software licen", r"open software licen[sc]e(?: version| v)? ?2 1"), ("osl-3.0", "open software licen", r"open software licen[sc]e(?: version| v)? ?3(?: 0)?"), ("eupl-1.1", "european union public", r"european union public licen[sc]e(?: eupl)?(?: version| v)? ?1 1"), ("eupl-1.2", "european union public", r"european union public licen[sc]e(?: eupl)?(?: version| v)? ?1 2"),
    ("ofl-1.0", "open font", r"(?:sil )?open font licen[sc]e(?: version)? 1 0"), ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: version)? 1 1"), ("ecl-2.0", "educational community", r"educational community licen[sc]e(?: version)? 2 0"), ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: upl)?(?: version)? 1 0"), ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e(?: version| v)? ?1 0"), ("odbl-1.0", "open database", r"open database licen[sc]e(?: odbl)?(?: version| v)? ?1 0"),
    ("cc-by-1.0", "attribution", r"creative commons attribution 1 0"), ("cc-by-2.0", "attribution", r"creative commons attribution 2 0"), ("cc-by-2.5", "attribution", r"creative commons attribution 2 5"), ("cc-by-3.0", "attribution", r"creative commons attribution 3 0"), ("cc-by-4.0", "attribution", r"creative commons attribution 4 0"), ("cc-by-3.0", "cc by 3", r"cc by 3 0"), ("cc-by-4.0", "cc by 4", r"cc by 4 0"),
    ("cc-by-sa-2.0", "creative commons", r"creative commons attribution share ?alike 2 [05]"), ("cc-by-sa-3.0", "creative commons", r"creative commons attribution share ?alike 3 0"), ("cc-by-sa-4.0", "creative commons", r"creative commons attribution share ?alike 4 0"), ("cc-by-sa-3.0", "cc by sa", r"cc by sa 3 0"), ("cc-by-sa-4.0", "cc by sa", r"cc by sa 4 0"),
    ("cc-by-nc-3.0", "creative commons", r"creative commons attribution non ?commercial 3 0"), ("cc-by-nc-4.0", "creative commons", r"creative commons attribution non ?commercial 4 0"), ("cc-by-nc-4.0", "cc by nc", r"cc by nc 4 0"), ("cc-by-nc-sa-3.0", "creative commons", r"creative commons attribution non ?commercial share ?alike 3 0"), ("cc-by-nc-sa-4.0", "creative commons", r"creative commons attribution non ?commercial share ?alike 4 0"), ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0"), ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd 4 0"), ("cc-by-nd-4.0", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s? 4 0"), ("cc-by-nd-4.0", "cc by nd", r"cc by nd 4 0"), ("cc0-1.0", "cc0", r"cc0 1 0(?: universal)?"),
]

#: Where a license's text lies.
ADDRESSES = [
    ("apache-2.0", "apache org", r"(?:www )?apache org licenses license 2 0(?: txt| html)?"), ("apache-1.1", "apache org", r"(?:www )?apache org licenses license 1 1"), ("mit", "opensource org licenses", r"opensource org licenses mit(?: license)?(?: php)?"), ("mit", "mit license org", r"mit license org"), ("bsd-2-clause", "opensource org licenses", r"opensource org licenses bsd 2 clause"), ("bsd-3-clause", "opensource org licenses", r"opensource org licenses bsd 3 clause"), ("bsd", "opensource org licenses", r"opensource org licenses bsd license"),
    ("apache-2.0", "opensource org licenses", r"opensource org licenses apache 2 0"), ("isc", "opensource org licenses", r"opensource org licenses isc"), ("zlib", "opensource org licenses", r"opensource org licenses zlib"), ("gpl-2.0", "gnu org", r"gnu org licenses old licenses gpl 2 0"), ("gpl-3.0", "gnu org", r"gnu org licenses gpl 3 0"), ("gpl", "gnu org", r"gnu org (?:copyleft|licenses) gpl"), ("lgpl-2.1", "gnu org", r"gnu org licenses old licenses lgpl 2 1"), ("lgpl-3.0", "gnu org", r"gnu org licenses lgpl 3 0"), ("lgpl", "gnu org", r"gnu org (?:copyleft|licenses) (?:lgpl|lesser)"), ("agpl-3.0", "gnu org", r"gnu org licenses agpl(?: 3 0)?"), ("gfdl", "gnu org", r"gnu org (?:copyleft|licenses) fdl"), ("gpl", "gnu org", r"gnu org licenses"),
    ("mpl-2.0", "mozilla org", r"mozilla org mpl 2 0"), ("mpl-1.1", "mozilla org", r"mozilla org mpl mpl 1 1"), ("mpl", "mozilla org", r"mozilla org mpl"), ("epl-1.0", "eclipse org", r"eclipse org legal epl v10"), ("epl-2.0", "eclipse org", r"eclipse org legal epl (?:2 0|v20)"), ("edl-1.0", "eclipse org", r"eclipse org (?:org )?(?:legal|documents) edl v10"), ("boost", "boost org", r"boost org license 1 0 txt"), ("unlicense", "unlicense org", r"unlicense org"), ("wtfpl", "wtfpl net", r"wtfpl net"), ("openfont", "openfontlicense org", r"openfontlicense org"),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1234] [05]"), ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1234] [05]"), ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1234] [05]"), ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1234] [05]"), ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1234] [05]"), ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1234] [05]"), ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"), ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
    ("odbl", "opendatacommons org", r"opendatacommons org licenses odbl"), ("odc-by", "opendatacommons org", r"opendatacommons org licenses by"), ("pddl", "opendatacommons org", r"opendatacommons org licenses pddl"), ("artistic-2.0", "opensource org licenses", r"opensource org licenses artistic(?: license)? 2 0"), ("php", "php net license", r"php net license"), ("psf", "python org", r"python org (?:psf license|download releases \S+ license)"), ("cecill", "cecill info", r"cecill info licen(?:s|c)es?"), ("elastic-2.0", "elastic co licens", r"elastic co licensing elastic license"), ("sspl", "mongodb com licens", r"mongodb com licensing server side public license"), ("busl-1.1", "mariadb com bsl", r"mariadb com bsl11"), ("eupl", "joinup ec europa eu", r"joinup ec europa eu (?:\S+ ){1,6}eupl"), ("w3c", "w3 org consortium legal", r"w3 org consortium legal (?:\S+ ){0,2}copyright"),
]

#: A license's plain name.
NAMED = [
    ("mit", "mit licen", r"(?:the )?mit licen[sc]e"), ("mit", "mit style licen", r"mit style licen[sc]e"), ("mit", "expat licen", r"(?:the )?expat licen[sc]e"), ("x11", "x11 licen", r"x11 licen[sc]e"), ("apache", "apache licen", r"apache licen[sc]e"), ("apache", "apache software licen", r"apache software licen[sc]e"), ("bsd", "bsd licen", r"bsd licen[sc]e"), ("bsd", "bsd style licen", r"bsd style licen[sc]e"), ("berkeley", "berkeley software distribution", r"berkeley software distribution licen[sc]e"),
    ("gpl", "gnu gpl", r"gnu gpl"), ("gpl", "gnu public licen", r"gnu public licen[sc]e"), ("lgpl", "lesser general public licen", r"(?:gnu )?lesser general public licen[sc]e"), ("lgpl", "gnu lgpl", r"gnu lgpl"), ("lgpl", "library general public licen", r"(?:gnu )?library general public licen[sc]e"), ("agpl", "affero general public licen", r"(?:gnu )?affero general public licen[sc]e"), ("gfdl", "free documentation licen", r"(?:gnu )?free documentation licen[sc]e"), ("copyleft", "copyleft licen", r"copyleft licen[sc]e"),
    ("mpl", "mozilla public licen", r"mozilla public licen[sc]e"), ("npl", "netscape public licen", r"netscape public licen[sc]e"), ("epl", "eclipse public licen", r"eclipse public licen[sc]e"), ("edl", "eclipse distribution licen", r"eclipse distribution licen[sc]e"), ("cddl", "common development and distribution licen", r"common development and distribution licen[sc]e"), ("cpl", "common public licen", r"common public licen[sc]e"), ("cpal", "common public attribution licen", r"common public attribution licen[sc]e"), ("ipl", "ibm public licen", r"ibm public licen[sc]e"), ("apsl", "apple public source licen", r"apple public source licen[sc]e"), ("spl", "sun public licen", r"sun public licen[sc]e"), ("rpl", "reciprocal public licen", r"reciprocal public licen[sc]e"), ("qpl", "q public licen", r"q public licen[sc]e"),
    ("isc", "isc licen", r"isc licen[sc]e"), ("zlib", "zlib licen", r"zlib licen[sc]e"), ("zlib", "zlib libpng licen", r"zlib libpng licen[sc]e"), ("libpng", "libpng licen", r"libpng licen[sc]e"), ("boost", "boost software licen", r"boost software licen[sc]e"), ("busl", "business source licen", r"business source licen[sc]e"), ("sspl", "server side public licen", r"server side public licen[sc]e"), ("elastic", "elastic licen", r"elastic licen[sc]e"), ("artistic", "artistic licen", r"artistic licen[sc]e"), ("afl", "academic free licen", r"academic free licen[sc]e"), ("osl", "open software licen", r"open software licen[sc]e"), ("eupl", "european union public licen", r"european union public licen[sc]e"), ("ecl", "educational community licen", r"educational community licen[sc]e"), ("upl", "universal permissive licen", r"universal permissive licen[sc]e"), ("beerware", "beerware licen", r"beerware licen[sc]e"),
    ("cecill", "cecill licen", r"cecill licen[sc]e"), ("ofl", "open font licen", r"(?:sil )?open font licen[sc]e"), ("psf", "python software foundation licen", r"python software foundation licen[sc]e"), ("php", "php licen", r"php licen[sc]e"), ("ruby", "ruby licen", r"ruby licen[sc]e"), ("vim", "vim licen", r"vim licen[sc]e"), ("tcl", "tcl tk licen", r"tcl tk licen[sc]e"), ("ncsa", "ncsa open source licen", r"ncsa open source licen[sc]e"), ("openssl", "openssl licen", r"openssl licen[sc]e"), ("postgresql", "postgresql licen", r"postgresql licen[sc]e"), ("zpl", "zope public licen", r"zope public licen[sc]e"), ("w3c", "w3c software notice and licen", r"w3c software notice and licen[sc]e"), ("ms-pl", "microsoft public licen", r"microsoft public licen[sc]e"), ("ms-rl", "microsoft reciprocal licen", r"microsoft reciprocal licen[sc]e"), ("json", "json licen", r"json licen[sc]e"), ("curl", "curl licen", r"curl licen[sc]e"), ("unlicense", "the unlicense", r"the unlicense"), ("wtfpl", "wtfpl", r"wtfpl"),
    ("odbl", "open database licen", r"open database licen[sc]e"), ("odc-by", "open data commons attribution licen", r"open data commons attribution licen[sc]e"), ("pddl", "public domain dedication and licen", r"public domain dedication and licen[sc]e"), ("ogl", "open government licen", r"open government licen[sc]e"), ("cdla", "community data licen", r"community data licen[sc]e agreement"), ("openrail", "openrail licen", r"openrail licen[sc]e"), ("rail", "responsible ai licen", r"responsible ai licen[sc]e"),
    ("cc-by", "creative commons attribution licen", r"creative commons attribution licen[sc]e"), ("cc-by-sa", "creative commons attribution share", r"creative commons attribution share ?alike"), ("cc-by-nc", "creative commons attribution non", r"creative commons attribution non ?commercial"), ("cc-by-nd", "creative commons attribution no", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?"), ("cc-by-nc-sa", "creative commons attribution non", r"creative commons attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "creative commons attribution non", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?"), ("cc", "creative commons licen", r"creative commons licen[sc]e"), ("cc0-1.0", "cc0", r"cc0"),
    ("cc-by-sa", "cc by sa", r"cc by sa"), ("cc-by-nc", "cc by nc", r"cc by nc"), ("cc-by-nd", "cc by nd", r"cc by nd"), ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa"), ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd"), ("public-domain", "public domain", r"public domain"), ("shareware", "shareware licen", r"shareware licen[sc]e"), ("freeware", "freeware licen", r"freeware licen[sc]e"), ("eula", "end user licen", r"end user licen[sc]e agreement"),
]

#: Hints that rights are kept or a license is near, without a name.
HINTS = [
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 6, 0.4), ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]", 6, 0.4), ("copyright", "copyright", r"copyright c", 6, 0.4), ("proprietary", "proprietary and confidential", r"proprietary and confidential", 4, 0.8), ("proprietary", "confidential and proprietary", r"confidential and proprietary", 4, 0.8), 
    ("warranty", "without warrant", r"without warrant(?:y|ies)(?: of any kind)?", 7, 0.2), ("warranty", "without any warrant", r"without any warrant(?:y|ies)", 7, 0.2), ("license-text", "licence agreement", r"licence agreement", 7, 0.2), ("license-text", "license agreement", r"license agreement", 7, 0.2), ("license-text", "terms of the licen", r"terms of the licen[sc]e", 7, 0.2), ("license-text", "terms of this licen", r"terms of this licen[sc]e", 7, 0.2), ("license-text", "details", r"see (?:the )?licen[sc]e(?: file| txt| md)? for (?:more )?details", 7, 0.3), ("license-text", "file in the", r"licen[sc]e file in the (?:project )?root", 7, 0.3), ("no-license", "is granted", r"no licen[sc]e is granted", 6, 0.4),
]

#: Every match and every base phrase holds one of these inside a word; a lower-cased text without any has no detection.
CUES = [
    "licen", "copyright", "copyleft", "rights", "domain", "spdx", "creative", "warrant", "permission", "redistribut", "gpl", "cc", "cecill", "wtfpl", "bsd", "apache", "proprietary", "mozilla", "regents", "acknowledg",
    "evil", "misrepresent", "ssl", "unauthori", "ruby", "gnu", "opendatacommons", "mariadb", "joinup", "consortium", "eclipse",
]


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, expression, priority, score) in order."""
    out = [(label, k, e, 1, 1.0) for label, k, e in BODIES]
    out += [(i.removesuffix("-only").removesuffix("-or-later"), "spdx license identifier", "spdx license identifier (?:\\S+ (?:or|and|with) )*" + i.replace("-", " ").replace(".", " "), 1, 1.0) for i in SPDX]
    for table, priority, score in ((GRANTS, 2, 0.95), (TITLES, 3, 0.85), (ADDRESSES, 4, 0.8), (NAMED, 5, 0.6)):
        out += [(label, k, e, priority, score) for label, k, e in table]
    return out + list(HINTS)
