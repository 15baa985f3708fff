"""License detection by ordered signature rules, in DataFrame functions only.

Each rule is a regular expression over the words of a text (lower-cased, one blank between), with
a keyword that a text must contain before the expression is tried, a label and a priority. Where
detections overlap, one that lies inside another of the same or a better priority is suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases whose places are counted, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_V2, _V3 = r"(?:v|version |v )?2(?: 0)?", r"(?:v|version |v )?3(?: 0)?"
_GNU = r"(?:the )?gnu "
_GPL, _LGPL, _AGPL, _FDL = (_GNU + x for x in (r"general public licen[cs]e", r"(?:lesser|library) general public licen[cs]e", r"affero general public licen[cs]e", r"free documentation licen[cs]e"))
_CC = r"creative commons attribution"
#: (label, keyword, name as a text writes it, SPDX words, address words). Rules are made of the
#: name in the sentences of TEMPLATES, and of the other two where given.
NAMES = (
    ("mit", "mit", r"mit(?: x11)? licen[cs]e", r"mit", r"opensource org licen[cs]es mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", r"mit 0", ""),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e version 1 1", r"apache 1 1", r"apache org licen[cs]es license 1 1"),
    ("apache-2", "apache", r"apache (?:software |public )?licen[cs]e(?: version| v)? ?2(?: 0)?", r"apache 2 0", r"apache org licen[cs]es license 2 0"),
    ("gpl-1", "general", _GPL + r"(?: version| v)? 1(?: 0)?", r"gpl 1 0(?: only| or later)?", ""),
    ("gpl-2", "general", _GPL + r"(?: version| v)? ?2(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licen[cs]es (?:old licenses )?gpl 2 0"),
    ("gpl-3", "general", _GPL + r"(?: version| v)? ?3(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licen[cs]es gpl 3 0"),
    ("lgpl-2", "general", _LGPL + r"(?: version| v)? ?2(?: 0)?", r"lgpl 2 0(?: only| or later)?", ""),
    ("lgpl-2.1", "general", _LGPL + r"(?: version| v)? ?2 1", r"lgpl 2 1(?: only| or later)?", r"gnu org licen[cs]es (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "general", _LGPL + r"(?: version| v)? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licen[cs]es lgpl 3 0"),
    ("agpl-3", "affero", _AGPL + r"(?: version| v)? ?3(?: 0)?", r"agpl 3 0(?: only| or later)?", r"gnu org licen[cs]es agpl 3 0"),
    ("fdl-1.2", "documentation", _FDL + r"(?: version| v)? 1 2", r"gfdl 1 2(?: only| or later)?", ""),
    ("fdl-1.3", "documentation", _FDL + r"(?: version| v)? 1 3", r"gfdl 1 3(?: only| or later)?", r"gnu org licen[cs]es fdl 1 3"),
    ("bsd-2", "bsd", r"(?:simplified|2 clause|two clause|freebsd) bsd licen[cs]e|bsd 2 clause(?: simplified)? licen[cs]e", r"bsd 2 clause", r"opensource org licen[cs]es bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:new|revised|modified|3 clause|three clause) bsd licen[cs]e|bsd 3 clause(?: new| revised)? licen[cs]e", r"bsd 3 clause", r"opensource org licen[cs]es bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:original|old|4 clause) bsd licen[cs]e", r"bsd 4 clause", ""),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd) licen[cs]e", r"0bsd", ""),
    ("isc", "isc", r"isc licen[cs]e", r"isc", r"opensource org licen[cs]es isc"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e(?: version| v)? 1 0", r"mpl 1 0", ""),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version| v)? 1 1", r"mpl 1 1", r"mozilla org mpl mpl 1 1"),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?", r"mpl 2 0", r"mozilla org mpl 2 0"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e(?: version| v)? 1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?", r"epl 2 0", r"eclipse org legal epl 2 0"),
    ("edl-1", "eclipse", r"eclipse distribution licen[cs]e(?: version| v)? 1(?: 0)?", r"", r"eclipse org org documents edl v10"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[cs]e(?: cddl)?(?: version| v)? 1 0", r"cddl 1 0", ""),
    ("cddl-1.1", "distribution", r"common development and distribution licen[cs]e(?: cddl)?(?: version| v)? 1 1", r"cddl 1 1", ""),
    ("cpl-1", "common", r"common public licen[cs]e(?: version| v)? 1 0", r"cpl 1 0", ""),
    ("ipl-1", "ibm", r"ibm public licen[cs]e(?: version| v)? 1 0", r"ipl 1 0", ""),
    ("eupl-1.1", "european", r"european union public licen[cs]e(?: eupl)?(?: version| v)? 1 1", r"eupl 1 1", ""),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: eupl)?(?: version| v)? 1 2", r"eupl 1 2", ""),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?(?: version| v)? 2 1", r"cecill 2 1", ""),
    ("cecill-b", "cecill", r"cecill b(?: free software)? licen[cs]e", r"cecill b", ""),
    ("cecill-c", "cecill", r"cecill c(?: free software)? licen[cs]e", r"cecill c", ""),
    ("artistic-1", "artistic", r"artistic licen[cs]e(?: version| v)? 1(?: 0)?", r"artistic 1 0", ""),
    ("artistic-2", "artistic", r"artistic licen[cs]e(?: version| v)? ?2(?: 0)?", r"artistic 2 0", r"perlfoundation org artistic license 2 0"),
    ("perl", "perl", r"same terms as perl itself", r"", ""),
    ("psf-2", "python", r"python software foundation licen[cs]e(?: version| v)? ?2?", r"psf 2 0|python 2 0", ""),
    ("php-3.01", "php", r"php licen[cs]e(?: version| v)? 3 01", r"php 3 01", r"php net license 3 01"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby", ""),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib", r"opensource org licen[cs]es zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?", r"libpng(?: 2 0)?", ""),
    ("boost-1", "boost", r"boost software licen[cs]e(?: version| v)? ?(?:1 0)?", r"bsl 1 0", r"boost org license 1 0"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: version| v)? ?(?:1 1)?", r"busl 1 1", ""),
    ("sspl-1", "server", r"server side public licen[cs]e(?: version| v)? ?1?", r"sspl 1 0", ""),
    ("elastic-2", "elastic", r"elastic licen[cs]e(?: version| v)? ?(?:2 0)?", r"elastic 2 0", r"elastic co licensing elastic license"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", "want", r"do what the f\w* you want to public licen[cs]e", r"wtfpl", r"wtfpl net"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl", ""),
    ("curl", "curl", r"curl licen[cs]e", r"curl", ""),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql", ""),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[cs]e", r"ncsa", ""),
    ("upl-1", "universal", r"universal permissive licen[cs]e(?: version| v)? ?(?:1 0)?", r"upl 1 0", ""),
    ("afl-3", "academic", r"academic free licen[cs]e(?: version| v)? ?(?:3 0)?", r"afl 3 0", ""),
    ("osl-3", "open", r"open software licen[cs]e(?: version| v)? ?(?:3 0)?", r"osl 3 0", ""),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms pl", ""),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms rl", ""),
    ("ofl-1.1", "font", r"sil open font licen[cs]e(?: version| v)? ?(?:1 1)?", r"ofl 1 1", r"scripts sil org ofl"),
    ("odbl-1", "database", r"open(?: data commons open)? database licen[cs]e(?: odbl)?(?: version| v)? ?(?:1 0)?", r"odbl 1 0", r"opendatacommons org licen[cs]es odbl"),
    ("odc-by-1", "commons", r"open data commons attribution licen[cs]e", r"odc by 1 0", r"opendatacommons org licen[cs]es by"),
    ("pddl-1", "domain", r"public domain dedication and licen[cs]e", r"pddl 1 0", r"opendatacommons org licen[cs]es pddl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0", r"creativecommons org publicdomain zero"),
    ("cc-by", "cc", r"cc by(?: [234] [05])?(?: international)?", r"cc by(?: [1234] [05])?", r"creativecommons org licen[cs]es by [1234]"),
    ("cc-by-sa", "cc", r"cc by sa(?: [234] [05])?(?: international)?", r"cc by sa(?: [1234] [05])?", r"creativecommons org licen[cs]es by sa"),
    ("cc-by-nc", "cc", r"cc by nc(?: [234] [05])?(?: international)?", r"cc by nc(?: [1234] [05])?", r"creativecommons org licen[cs]es by nc [1234]"),
    ("cc-by-nd", "cc", r"cc by nd(?: [234] [05])?(?: international)?", r"cc by nd(?: [1234] [05])?", r"creativecommons org licen[cs]es by nd"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [234] [05])?(?: international)?", r"cc by nc sa(?: [1234] [05])?", r"creativecommons org licen[cs]es by nc sa"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [234] [05])?(?: international)?", r"cc by nc nd(?: [1234] [05])?", r"creativecommons org licen[cs]es by nc nd"),
    ("cc-by", "creative", _CC + r"(?: [234] [05])?(?: international)?(?: public)? licen[cs]e", r"", ""),
    ("cc-by-sa", "creative", _CC + r" share ?alike(?: [234] [05])?(?: international)?(?: public)?(?: licen[cs]e)?", r"", ""),
    ("cc-by-nc", "creative", _CC + r" non ?commercial(?: [234] [05])?(?: international)?(?: public)?(?: licen[cs]e)?", r"", ""),
    ("cc-by-nd", "creative", _CC + r" no ?deriv(?:s|atives)(?: [234] [05])?(?: international)?(?: public)?(?: licen[cs]e)?", r"", ""),
    ("cc-by-nc-sa", "creative", _CC + r" non ?commercial share ?alike(?: [234] [05])?(?: international)?(?: public)?(?: licen[cs]e)?", r"", ""),
    ("cc-by-nc-nd", "creative", _CC + r" non ?commercial no ?deriv(?:s|atives)(?: [234] [05])?(?: international)?(?: public)?(?: licen[cs]e)?", r"", ""),
    ("public-domain", "domain", r"(?:dedicated to|released into|placed in) the public domain", r"", ""),
    ("proprietary", "reserved", r"all rights reserved", r"", ""),
)
#: Sentences around a name: (priority, score, text before the name, text after it). Best first.
TEMPLATES = (
    (1, 0.95, r"(?:is |are )?(?:licen[cs]ed|released|distributed|available|published|provided|covered) (?:to you )?under (?:the )?(?:terms of )?(?:the )?", r"(?: the license)?"),
    (1, 0.9, r"(?:subject to|governed by|accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", r""),
    (2, 0.75, r"", r""),
)
#: Wordings of licenses themselves: (label, keyword, expression).
TEXTS = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "permission", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-advertising", "advertising", r"except as contained in this notice the name s? ?of the above copyright holders shall not be used in advertising or otherwise to promote"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "author", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("bsd-2", "redistribution", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2", "redistribution", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2", "copyright", r"this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties"),
    ("bsd-3", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg?ement"),
    ("apache-1.1", "acknowledg", r"the end user documentation included with the redistribution if any must include the following acknowledg?ment"),
    ("apache-2", "apache", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2", "license", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2", "license", r"terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-2", "license", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("gpl-1", "version", r"gnu general public license version 1 february 1989"),
    ("gpl-2", "redistribute", r"under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-2", "redistribute", r"under the terms of (?:the gnu general public license version 2|version 2 of the gnu general public license) (?:only )?as published by"),
    ("gpl-2", "version", r"gnu general public license version 2 june 1991"),
    ("gpl-2", "program", r"you may copy and distribute verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-2", "program", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl-2", "program", r"you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-2-classpath", "linking", r"linking this (?:library|program) statically or dynamically with other modules is making a combined work"),
    ("gpl-3", "redistribute", r"under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-3", "version", r"gnu general public license version 3 29 june 2007"),
    ("gpl-3", "convey", r"you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-3", "anti", r"no covered work shall be deemed part of an effective technological measure under any applicable law"),
    ("gpl-3", "tivo", r"user product is either 1 a consumer product which means any tangible personal property"),
    ("gcc-exception-3.1", "runtime", r"gcc runtime library exception version 3 1"),
    ("lgpl-2", "library", r"gnu library general public license version 2 june 1991"),
    ("lgpl-2", "redistribute", r"under the terms of the gnu library general public license as published by the free software foundation either version 2"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.1", "redistribute", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", "redistribute", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("lgpl-3", "lesser", r"gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-3", "application", r"a combined work is a work produced by combining or linking an application with the library"),
    ("agpl-3", "affero", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", "redistribute", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3", "remotely", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("fdl-1.3", "permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3"),
    ("fdl-1.2", "permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2"),
    ("fdl-1.1", "permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "secondary", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl-1", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl-2", "agreement", r"the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("cpl-1", "common", r"the accompanying program is provided under the terms of this common public license agreement"),
    ("ipl-1", "ibm", r"the accompanying program is provided under the terms of this ibm public license agreement"),
    ("cddl-1.0", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl-1.2", "european", r"licensed under the eupl version 1 2 or as soon they will be approved by the european commission"),
    ("cecill-2.1", "cecill", r"this software is governed by the cecill license under french law and abiding by the rules of distribution of free software"),
    ("cecill-b", "cecill", r"this software is governed by the cecill b license under french law"),
    ("cecill-c", "cecill", r"this software is governed by the cecill c license under french law"),
    ("artistic-1", "artistic", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2", "artistic", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "perl", r"this library is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("psf-2", "python", r"this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("python-cnri", "cnri", r"this license agreement is between the corporation for national research initiatives"),
    ("php-3.01", "php", r"this source file is subject to version 3 01 of the php license"),
    ("php-3", "php", r"this source file is subject to version 3 0 of the php license"),
    ("zend-2", "zend", r"this source file is subject to version 2 00 of the zend license"),
    ("ruby", "ruby", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl) or the conditions below"),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "png", r"the png reference library is supplied as is the contributing authors and group 42 inc disclaim all warranties"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "domain", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("boost-1", "machine", r"machine executable object code generated by a source language processor"),
    ("boost-1", "boost", r"distributed under the boost software license version 1 0"),
    ("wtfpl", "want", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("beerware", "beer", r"as long as you retain this notice you can do whatever you want with this stuff if we meet some day"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young"),
    ("curl", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("postgresql", "california", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ncsa", "illinois", r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("w3c", "w3c", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", "permission", r"provided that the above copyright notice s and this permission notice appear in all copies of the software and that both the above copyright notice"),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("sissl", "sun", r"the contents of this file are subject to the sun industry standards source license"),
    ("apsl-2", "apple", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("npl-1.1", "netscape", r"the contents of this file are subject to the netscape public license version 1 1"),
    ("qpl-1", "trolltech", r"this file may be distributed under the terms of the q public license as defined by trolltech"),
    ("ms-pl", "microsoft", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("odbl-1", "database", r"made available under the open database license any rights in individual contents of the database are licensed under"),
    ("odc-by-1", "attribution", r"made available under the open data commons attribution license"),
    ("pddl-1", "domain", r"made available under the public domain dedication and license v1 0"),
    ("cc0-1.0", "waive", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright"),
    ("cc0-1.0", "domain", r"has waived all copyright and related or neighboring rights"),
    ("cc-by", "attribution", r"this work is licensed under a creative commons attribution [1234] [05] (?:international|unported|generic|united states) license"),
    ("cc-by-sa", "sharealike", r"this work is licensed under a creative commons attribution sharealike [1234] [05] (?:international|unported|generic|united states) license"),
    ("cc-by-nc", "noncommercial", r"this work is licensed under a creative commons attribution noncommercial [1234] [05] (?:international|unported|generic|united states) license"),
    ("cc-by-nd", "noderivatives", r"this work is licensed under a creative commons attribution noderivatives [1234] [05] (?:international|unported|generic|united states) license"),
    ("cc-by-nc-sa", "noncommercial", r"this work is licensed under a creative commons attribution noncommercial sharealike [1234] [05] (?:international|unported|generic|united states) license"),
    ("cc-by-nc-nd", "noncommercial", r"this work is licensed under a creative commons attribution noncommercial noderivatives [1234] [05] (?:international|unported|generic|united states) license"),
    ("sspl-1", "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "business", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons", r"commons clause license condition v1 0"),
    ("polyform-noncommercial", "polyform", r"polyform noncommercial license 1 0 0"),
    ("polyform-shield", "polyform", r"polyform shield license 1 0 0"),
    ("blueoak-1", "blue", r"blue oak model license version 1 0 0"),
    ("mulan-2", "mulan", r"licensed under mulan psl v2 you can use this software according to the terms and conditions of the mulan psl v2"),
    ("openrail-m", "model", r"use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("llama-2", "llama", r"llama 2 (?:community license agreement|is licensed under the llama 2)"),
    ("llama-3", "llama", r"meta llama 3 community license agreement"),
)
#: Strings that most rules have; see GATE for those of all.
ANCHORS = (
    "licen", "spdx", "cc", "domain", "perl", "reserved", "permission", "redistribut", "endorse", "acknowledg", "executable",
    "warranty", "unencumbered", "commons", "mozilla", "eclipse", "wtfpl", "scripts",
)


def _branches(expression: str) -> list[str]:
    """The alternatives of an expression at its top level."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(expression):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and depth == 0:
            out.append(expression[begin:i])
            begin = i + 1
    return [*out, expression[begin:]]


def _groups(expression: str):
    """(text before, inside, whether optional) of the groups at the top level, then (text after, "", False)."""
    at, depth, begin = 0, 0, 0
    for i, c in enumerate(expression):
        if c == "(":
            begin = begin if depth else i
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                optional = expression[i + 1 : i + 2] == "?"
                yield expression[at:begin], expression[begin + 1 : i].removeprefix("?:"), optional
                at = i + 1 + optional
    yield expression[at:], "", False


def _anchors(expression: str) -> set[str]:
    """Strings of which every match of an expression has one: an anchor or else the longest word that
    no group makes optional, or such strings of each alternative."""
    if len(parts := _branches(expression)) > 1:
        return set().union(*map(_anchors, parts))
    plain, inner = " ".join(before for before, _, _ in _groups(expression)), [x for _, x, optional in _groups(expression) if x and not optional]
    plain = re.sub(r"\[[^\]]*\]\??|.\?|\\.\*?", "\n", plain)
    if found := [a for a in ANCHORS if a in plain]:
        return {found[0]}
    words = [w for w in re.findall(r"[a-z0-9]+", plain) if len(w) > 3]
    if words:
        return {max(words, key=len)}
    options = [_anchors(x) for x in inner]
    return min((o for o in options if o and "" not in o), key=len, default={max(re.findall(r"[a-z0-9]+", plain), key=len, default="")})


# A wording's keyword is one of its own words where the stated one is not.
TEXTS = tuple((label, word if word in x else max((w for w in x.split(" ") if w.isalnum()), key=len), x) for label, word, x in TEXTS)


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, score, keyword, expression), in the order of precedence."""
    made = [(label, 0, 1.0, word, text) for label, word, text in TEXTS]
    for label, word, name, spdx, address in NAMES:
        if spdx:
            made.append((label, 0, 1.0, "spdx", rf"spdx license identifier (?:{spdx})"))
        if address:
            made.append((label, 1, 0.9, address.split(" ")[0].split("\\")[0], address))
        for priority, score, before, after in TEMPLATES:
            made.append((label, priority, score, word, rf"{before}(?:{name}){after}"))
    return sorted(made, key=lambda r: r[1])


#: The anchors of all rules.
GATE = tuple(sorted(set().union(*(_anchors(x) for *_, x in rules()))))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ ]+"))


def _places(words: Column, rule: Column) -> Column:
    """Where a rule matches, from left to right without overlap: structs of start and end (in words),
    its label, priority and score."""
    pattern = F.concat(F.lit(" (?:"), rule["expression"], F.lit(")(?= )"))
    hits = F.regexp_extract_all(words, pattern, F.lit(0))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        place = F.struct(start.alias("start"), (-(start + x["size"])).alias("minus_end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score"))
        return F.struct((start + x["size"]).alias("at"), F.array_append(done["places"], place).alias("places"))

    none = F.expr("cast(array() as array<struct<start:int,minus_end:int,priority:int,label:string,score:double>>)")
    sizes = F.zip_with(hits, F.slice(F.split(words, pattern, -1), F.lit(1), F.size(hits)), lambda hit, gap: F.struct(_count(gap).alias("gap"), _count(hit).alias("size")))
    return F.when(F.size(hits) > 0, F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("places")), step)["places"]).otherwise(none)


def _resolved(places: Column) -> Column:
    """Labels and best score of the places that are not suppressed, in one pass over the sorted places."""
    levels = range(3)

    def step(done: Column, x: Column) -> Column:
        end = -x["minus_end"]
        inside = F.lit(False)
        for q in levels:
            inside = inside | ((F.lit(q) <= x["priority"]) & (done[f"e{q}"] >= end))
        return F.struct(
            *[F.when(x["priority"] == q, F.greatest(done[f"e{q}"], end)).otherwise(done[f"e{q}"]).alias(f"e{q}") for q in levels],
            F.when(inside, done["labels"]).otherwise(F.array_union(done["labels"], F.array(x["label"]))).alias("labels"),
            F.when(inside, done["score"]).otherwise(F.greatest(done["score"], x["score"])).alias("score"),
        )

    begun = F.struct(*[F.lit(-1).alias(f"e{q}") for q in levels], F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score"))
    return F.aggregate(F.array_sort(places), begun, step)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds to ``docs`` one struct column ``found``: n_words, n_base, first_word, last_word,
    base_labels, labels (arrays, sorted and distinct) and score.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Base phrases
    are counted at all their places; the rules add labels. A null text counts as empty: no words,
    nulls for the word places, no labels, score 0. Texts of any length are read whole; repeated rows
    are each answered; an empty table gives an empty result. Every row is read by itself, without a
    shuffle. Other columns travel in a struct, so their names cannot clash; only a column already
    named ``found`` is replaced.
    """
    table = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(score).alias("score"), F.lit(word).alias("word"), F.lit(x).alias("expression"))
        for label, priority, score, word, x in rules()
    ])
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Lower-cased once, in a projection of its own: the gate asks it many times.
    docs, columns = docs.select(row.alias("_row"), whole.alias("_whole"), F.lower(whole).alias("_lower")), docs.columns
    whole, lower, gate = F.col("_whole"), F.col("_lower"), F.lit(False)
    for x in GATE:
        gate = gate | F.contains(lower, F.lit(x))
    # Only texts that pass the gate are split into words; the others have no detection.
    words = F.when(gate, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(whole, _UPPER, _LOWER), _GAPS, " ")), F.lit(" ")))
    step = docs.select("_row", F.struct(F.regexp_count(whole, F.lit(_WORDS)).cast("long").alias("n"), words.alias("words")).alias("_scan"))
    n, words = F.col("_scan.n"), F.col("_scan.words")
    bases = []
    for phrase, label in BASE:
        parts = F.split(words, f" (?={phrase} )", -1)
        bases.append(F.struct((F.size(parts) - 1).alias("times"), _count(F.element_at(parts, 1)).alias("first"), (n - _count(F.element_at(parts, -1))).alias("last"), F.lit(label).alias("label")))
    places = F.flatten(F.transform(F.filter(table, lambda r: F.contains(words, r["word"])), lambda r: _places(words, r)))
    step = step.withColumn("_hits", F.when(words.isNotNull(), F.struct(F.filter(F.array(*bases), lambda b: b["times"] > 0).alias("base"), _resolved(places).alias("rules"))))
    base = F.col("_hits.base")
    none = F.expr("cast(array() as array<string>)")
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"]))), none)
    found = F.struct(
        n.alias("n_words"),
        F.coalesce(F.aggregate(base, F.lit(0).cast("long"), lambda a, b: a + b["times"]), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).cast("long").alias("last_word"),
        base_labels.alias("base_labels"),
        F.array_sort(F.array_union(base_labels, F.coalesce(F.col("_hits.rules.labels"), none))).alias("labels"),
        F.greatest(F.coalesce(F.col("_hits.rules.score"), F.lit(0.0)), F.when(F.size(base) > 0, 0.95).otherwise(0.0)).alias("score"),
    )
    return step.select(*[F.col("_row").getField(c).alias(c) for c in columns if c != "found"], found.alias("found"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    from lodestone.llm.common import spread, table

    f = scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    joined = [F.array_join(f"found.{x}", ",").alias(x) for x in ("base_labels", "labels")]
    return f.select("doc_id", "found.n_words", "found.n_base", "found.first_word", "found.last_word", *joined, "found.score")
