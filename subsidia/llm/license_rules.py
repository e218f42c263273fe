"""Signature rules of the license scan.

Rules run on normalised text: A-Z lower-cased, and each run of other
characters than letters and digits replaced by one blank, so a pattern need
not care about punctuation or line breaks.  Each rule has a keyword, a word
that every match of it contains; a rule runs only on texts with its keyword.

Priorities: 4 a passage of the license itself, 3 an SPDX tag, 2 a title with
version or a link, 1 a bare mention.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str
    weight: float


#: Passages of license texts: label, keyword, pattern.
_PASSAGES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("isc", "permission", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "licensed", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2.0", "license", "you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "license", "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "license", "gnu general public license as published by the free software foundation either version 3"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3.0", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 1 0"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("unlicense", "domain", "this is free and unencumbered software released into the public domain"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("wtfpl", "license", "do what the fuck you want to public license"),
    ("cc0-1.0", "domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "redistribute", "you are free to share copy and redistribute the material in any medium or format"),
    ("proprietary", "permission", "no part of this (?:publication|work|document) may be reproduced (?:[^ ]+ ){0,30}without (?:the )?(?:prior )?(?:written )?permission"),
    ("proprietary", "reserved", "all rights reserved"),
    ("public-domain", "domain", "(?:dedicated to|released into|placed in|in) the public domain"),
    ("ofl-1.1", "license", "this font software is licensed under the sil open font license version 1 1"),
    ("artistic-2.0", "license", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("odbl-1.0", "license", "made available under the open database license"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("python-2.0", "license", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("mit", "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("mit-0", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "advertising", "except as contained in this notice the name of (?:[^ ]+ ){1,8}shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("isc", "permission", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd-1-clause", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", "the names? of (?:its|the|any) contributors may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", "neither the name of the university nor the names of its contributors may be used to endorse"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd", "regents", "this software is provided by the regents and contributors as is"),
    ("bsd", "disclaimed", "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall"),
    ("bsd-4-clause-uc", "california", "this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd", "regents", "the regents of the university of california all rights reserved"),
    ("apache-2.0", "license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "licensed", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "licenses", "the asf licenses this file to you under the apache license version 2 0"),
    ("apache-2.0", "license", "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl", "warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "license", "you should have received a copy of the gnu general public license along with this (?:program|file|software|library)"),
    ("gpl-2.0", "temple", "write to the free software foundation inc 59 temple place"),
    ("gpl-2.0", "franklin", "write to the free software foundation inc 51 franklin st(?:reet)?"),
    ("gpl-2.0", "license", "terms and conditions for copying distribution and modification 0 this license applies to any program"),
    ("gpl-2.0", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the licenses for most software are designed to take away"),
    ("gpl-3.0", "preamble", "preamble the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "unmodified", "a covered work means either the unmodified program or a work based on the program"),
    ("gpl-3.0", "license", "this program is free software you can redistribute it and or modify it under the terms of version 3 of the gnu general public license"),
    ("gpl-2.0", "license", "(?:it )?under the terms of version 2 of the gnu general public license"),
    ("gpl-2.0", "license", "under the terms of the gnu general public license version 2 only"),
    ("gpl-3.0", "license", "under the terms of the gnu general public license version 3 only"),
    ("gpl-2.0-or-later", "license", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "license", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-1.0-or-later", "license", "gnu general public license as published by the free software foundation either version 1 or at your option any later version"),
    ("gpl-2.0-classpath", "exception", "linking this library statically or dynamically with other modules is making a combined work (?:[^ ]+ ){1,60}as a special exception"),
    ("gpl-2.0-classpath", "classpath", "(?:subject to the )?classpath exception as provided (?:by oracle )?in the license file"),
    ("gpl-gcc-exception", "exception", "gcc runtime library exception(?: version 3 1)?"),
    ("gpl-font-exception", "exception", "as a special exception if you create a document which uses this font"),
    ("gpl-autoconf-exception", "exception", "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("gpl-bison-exception", "exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-linking-exception", "exception", "as a special exception the copyright holders give permission to link the code of portions of this program with the openssl library"),
    ("gpl-linux-syscall-note", "copyright", "this copyright does not cover user programs that use kernel services by normal system calls"),
    ("lgpl", "license", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|software)"),
    ("lgpl-2.1", "license", "gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-2.0", "license", "gnu library general public license as published by the free software foundation either version 2"),
    ("lgpl-3.0", "license", "gnu lesser general public license as published by the free software foundation either version 3"),
    ("lgpl-3.0", "license", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl-2.1", "preamble", "preamble the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licenses are intended to guarantee"),
    ("agpl-3.0", "license", "you should have received a copy of the gnu affero general public license along with this (?:program|software)"),
    ("agpl-3.0", "license", "gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3.0", "gnu", "remote network interaction use with the gnu general public license"),
    ("gfdl", "permission", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "license", "the contents of this file are subject to the mozilla public license version 1 1 the license"),
    ("mpl-1.0", "license", "the contents of this file are subject to the mozilla public license version 1 0 the license"),
    ("mpl-1.1", "alternatively", "alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("npl-1.1", "license", "the contents of this file are subject to the netscape public license"),
    ("cddl-1.0", "license", "the contents of this file are subject to the terms of the common development and distribution license(?: the license)?"),
    ("cddl", "cddl", "the cddl header must be included"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution"),
    ("epl", "eclipse", "which is available at (?:https? )?www eclipse org legal epl"),
    ("cpl-1.0", "license", "made available under the terms of the common public license(?: v1 0| version 1 0)?"),
    ("ipl-1.0", "license", "the accompanying program is provided under the terms of this ibm public license"),
    ("unlicense", "compiled", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("unlicense", "unlicense", "for more information please refer to (?:https? )?unlicense org"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("libpng", "license", "this code is released under the libpng license"),
    ("bsl-1.0", "license", "distributed under the boost software license version 1 0"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("wtfpl", "modification", "terms and conditions for copying distribution and modification 0 you just do what the"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("hpnd", "permission", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
    ("ntp", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("curl", "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied"),
    ("ncsa", "illinois", "neither the names of the university of illinois nor the names of its contributors|developed by the university of illinois"),
    ("tcl", "license", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("ruby", "ruby", "ruby is copyrighted free software by yukihiro matsumoto"),
    ("python-2.0", "licensee", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("php-3.01", "license", "this source file is subject to version 3 01 of the php license"),
    ("postgresql", "california", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ofl-1.1", "font", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl-1.1", "font", "the font software may be modified altered or added to"),
    ("artistic-1.0", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "license", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("ms-pl", "license", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("eupl-1.2", "licence", "licensed under the eupl(?: version 1 2)?(?: or as soon they will be approved by the european commission)? (?:subsequent versions of the eupl )?the licence"),
    ("cecill-2.1", "cecill", "this software is governed by the cecill(?: [bc])? license under french law"),
    ("sspl-1.0", "service", "offering the program as a service if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "license", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("cc0-1.0", "waived", "to the extent possible under law (?:[^ ]+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", "licensed", "this work is licensed under (?:a|the) creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed", "this work is licensed under (?:a|the) creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "licensed", "this work is licensed under (?:a|the) creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-nd-4.0", "licensed", "this work is licensed under (?:a|the) creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by", "credit", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "transform", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "transform", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("ogl-3.0", "sector", "contains public sector information licensed under the open government licence"),
    ("odbl-1.0", "openstreetmap", "openstreetmap contributors (?:and )?(?:is )?(?:available|licensed|made available) under the open database licen[cs]e"),
    ("odbl-1.0", "licensed", "any rights in individual contents of the database are licensed under the database contents license"),
    ("openrail", "restrictions", "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("llama", "llama", "llama (?:2|3|3 1) is licensed under the llama (?:2|3|3 1) community license"),
    ("proprietary", "confidential", "(?:this (?:document|software|file) (?:is|contains) )?confidential and proprietary information of"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "licensed", "this software is licensed for evaluation purposes only"),
    ("proprietary", "reproduced", "may not be (?:copied )?reproduced (?:stored )?(?:or )?(?:transmitted )?(?:in any form )?without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
    ("proprietary", "redistributed", "this material may not be published broadcast rewritten or redistributed"),
    ("public-domain", "domain", "this (?:file|software|work|code) is (?:hereby )?(?:placed )?in the public domain"),
    ("public-domain", "disclaims", "the author (?:hereby )?disclaims copyright to this source code"),
    ("public-domain", "dedicates", "(?:hereby )?dedicates (?:any and )?all copyright interest in (?:the|this) (?:software|work)"),
    ("public-domain", "government", "(?:this|a) work of the (?:u s|us|united states) government (?:is|and is) not subject to copyright"),
]

#: Licenses by name: label, SPDX id in normalised words, keyword of the titles, titles with version, bare names; a title without that keyword brings its own.
_NAMED = [
    ("mit", "mit", "license", ["the mit license mit", ("opensource", "opensource org licenses? mit")], ["mit license", "expat license", "x11 license", "mit x11 license"]),
    ("apache-1.1", "apache 1 1", "license", ["apache (?:software )?license version 1 1", "apache license 1 1"], []),
    ("apache-2.0", "apache 2 0", "license", ["apache (?:software )?license version 2 0", "apache license v?2 0", "apache 2 0 license", "asl 2 0 license"], []),
    ("apache", "apache", "license", [], ["apache license", "apache software license"]),
    ("gpl-1.0", "gpl 1 0", "license", ["gnu general public license (?:version |v )?1(?: 0)?"], []),
    ("gpl-2.0", "gpl 2 0", "license", ["gnu general public license (?:version |v )?2(?: 0)?", "gnu gpl (?:version |v )?2(?: 0)? license"], []),
    ("gpl-3.0", "gpl 3 0", "license", ["gnu general public license (?:version |v )?3(?: 0)?", "gnu gpl (?:version |v )?3(?: 0)? license"], []),
    ("gpl", "gpl", "license", [], ["general public license", "gnu gpl license"]),
    ("lgpl-2.1", "lgpl 2 1", "license", ["gnu lesser general public license (?:version |v )?2 1"], []),
    ("lgpl-3.0", "lgpl 3 0", "license", ["gnu lesser general public license (?:version |v )?3(?: 0)?"], []),
    ("lgpl", "lgpl", "license", [], ["lesser general public license", "library general public license", "lgpl license"]),
    ("agpl-3.0", "agpl 3 0", "license", ["gnu affero general public license (?:version |v )?3(?: 0)?"], ["affero general public license", "agpl license"]),
    ("gfdl-1.3", "gfdl 1 3", "license", ["gnu free documentation license (?:version )?1 3"], ["free documentation license"]),
    ("bsd-2-clause", "bsd 2 clause", "license", ["(?:simplified|2 clause|two clause|freebsd) bsd license", "bsd 2 clause license"], []),
    ("bsd-3-clause", "bsd 3 clause", "license", ["(?:new|modified|revised|3 clause|three clause) bsd license", "bsd 3 clause license"], []),
    ("bsd-4-clause", "bsd 4 clause", "license", ["(?:original|4 clause|four clause) bsd license"], []),
    ("bsd", "bsd", "license", [], ["bsd license", "bsd style license"]),
    ("0bsd", "0bsd", "license", ["zero clause bsd license"], []),
    ("isc", "isc", "license", ["isc license isc"], ["isc license"]),
    ("mpl-1.1", "mpl 1 1", "license", ["mozilla public license (?:version |v )?1 1"], []),
    ("mpl-2.0", "mpl 2 0", "license", ["mozilla public license (?:version |v )?2 0"], []),
    ("mpl", "mpl", "license", [], ["mozilla public license"]),
    ("epl-1.0", "epl 1 0", "license", ["eclipse public license (?:version |v )?1 0"], []),
    ("epl-2.0", "epl 2 0", "license", ["eclipse public license (?:version |v )?2 0"], []),
    ("epl", "epl", "license", [], ["eclipse public license"]),
    ("cddl-1.0", "cddl 1 0", "license", ["common development and distribution license (?:version )?1 0"], ["common development and distribution license"]),
    ("eupl-1.2", "eupl 1 2", "licence", ["european union public licence (?:version |v )?1 2"], ["european union public licence"]),
    ("bsl-1.0", "bsl 1 0", "license", ["boost software license (?:version )?1 0"], ["boost software license"]),
    ("busl-1.1", "busl 1 1", "license", ["business source license (?:version )?1 1"], ["business source license"]),
    ("sspl-1.0", "sspl 1 0", "license", ["server side public license (?:version )?1"], ["server side public license"]),
    ("elastic-2.0", "elastic 2 0", "license", ["elastic license (?:version )?2 0"], ["elastic license"]),
    ("zlib", "zlib", "license", ["zlib libpng license"], ["zlib license"]),
    ("unlicense", "unlicense", "unlicense", ["unlicense org"], ["the unlicense"]),
    ("wtfpl", "wtfpl", "wtfpl", ["wtfpl version 2"], ["wtfpl"]),
    ("artistic-1.0", "artistic 1 0", "license", ["artistic license (?:version )?1 0"], []),
    ("artistic-2.0", "artistic 2 0", "license", ["artistic license (?:version )?2 0"], ["artistic license"]),
    ("ofl-1.1", "ofl 1 1", "license", ["sil open font license (?:version )?1 1"], ["open font license"]),
    ("ms-pl", "ms pl", "license", ["microsoft public license ms pl"], ["microsoft public license"]),
    ("ms-rl", "ms rl", "license", ["microsoft reciprocal license ms rl"], ["microsoft reciprocal license"]),
    ("postgresql", "postgresql", "license", [], ["postgresql license"]),
    ("python-2.0", "python 2 0", "license", ["python software foundation license version 2"], ["python software foundation license", "psf license"]),
    ("php-3.01", "php 3 01", "license", ["php license (?:version )?3 01"], ["php license"]),
    ("odbl-1.0", "odbl 1 0", "license", ["open database license (?:version |v )?1 0", "odc open database license"], ["open database license"]),
    ("odc-by-1.0", "odc by 1 0", "license", ["open data commons attribution license (?:version |v )?1 0"], ["open data commons attribution license"]),
    ("pddl-1.0", "pddl 1 0", "license", ["public domain dedication and license"], []),
    ("ogl-3.0", "ogl uk 3 0", "licence", ["open government licence (?:version |v ?)?3 0"], ["open government licence"]),
    ("etalab-2.0", "etalab 2 0", "licence", ["licence ouverte (?:version )?2 0"], ["licence ouverte"]),
    ("dl-de-by-2.0", "dl de by 2 0", "lizenz", ["datenlizenz deutschland namensnennung (?:version )?2 0 lizenz"], []),
    ("openrail", "openrail", "license", ["creativeml open rail m license"], ["openrail license", "open rail license"]),
    ("upl-1.0", "upl 1 0", "license", ["universal permissive license (?:version |v )?1 0"], ["universal permissive license"]),
    ("vim", "vim", "license", [], ["vim license"]),
    ("ncsa", "ncsa", "license", [], ["university of illinois ncsa open source license", "ncsa license"]),
    ("mit-0", "mit 0", "attribution", ["mit no attribution"], []),
    ("gpl-2.0-or-later", "gpl 2 0 or later", "license", ["gnu general public license v?2(?: 0)? or later", "gpl v?2(?: 0)? or later license"], []),
    ("gpl-3.0-or-later", "gpl 3 0 or later", "license", ["gnu general public license v?3(?: 0)? or later", "gpl v?3(?: 0)? or later license"], []),
    ("lgpl-2.0", "lgpl 2 0", "license", ["gnu library general public license (?:version |v )?2(?: 0)?"], []),
    ("gfdl-1.2", "gfdl 1 2", "license", ["gnu free documentation license (?:version )?1 2"], []),
    ("mpl-1.0", "mpl 1 0", "license", ["mozilla public license (?:version |v )?1 0"], []),
    ("cpl-1.0", "cpl 1 0", "license", ["common public license (?:version |v )?1 0"], ["common public license"]),
    ("ipl-1.0", "ipl 1 0", "license", ["ibm public license (?:version |v )?1 0"], ["ibm public license"]),
    ("afl-3.0", "afl 3 0", "license", ["academic free license (?:version |v )?3 0"], ["academic free license"]),
    ("osl-3.0", "osl 3 0", "license", ["open software license (?:version |v )?3 0"], ["open software license"]),
    ("cecill-2.1", "cecill 2 1", "cecill", ["cecill (?:free software license agreement )?(?:version )?2 1"], ["cecill"]),
    ("cern-ohl-p-2.0", "cern ohl p 2 0", "licence", ["cern open hardware licence version 2 permissive"], ["cern open hardware licence"]),
    ("eupl-1.1", "eupl 1 1", "licence", ["european union public licence (?:version |v )?1 1"], []),
    ("ecl-2.0", "ecl 2 0", "license", ["educational community license (?:version )?2 0"], ["educational community license"]),
    ("qpl-1.0", "qpl 1 0", "license", ["q public license (?:version )?1 0"], []),
    ("rpl-1.5", "rpl 1 5", "license", ["reciprocal public license (?:version )?1 5"], ["reciprocal public license"]),
    ("sleepycat", "sleepycat", "license", [], ["sleepycat license"]),
    ("hpnd", "hpnd", "disclaimer", [], ["historical permission notice and disclaimer"]),
    ("mulanpsl-2.0", "mulanpsl 2 0", "license", ["mulan permissive software license (?:version |v )?2"], ["mulan permissive software license"]),
    ("blueoak-1.0.0", "blueoak 1 0 0", "license", ["blue oak model license 1 0 0"], ["blue oak model license"]),
]

#: Creative Commons terms: label part, words, long name.
_COMMONS = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?deriv(?:s|atives)"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:s|atives)"),
]
_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def license_rules() -> list[Rule]:
    """All rules, in order: earlier ones win ties."""
    rules = [Rule(label, 4, keyword, pattern, 0.98) for label, keyword, pattern in _PASSAGES]
    for label, spdx, keyword, titles, names in _NAMED:
        rules.append(Rule(label, 3, "spdx", f"spdx license identifier {spdx}(?: only| or later)?", 0.95))
        rules += [Rule(label, 2, *((keyword, title) if isinstance(title, str) else title), 0.85) for title in titles]
        rules += [Rule(label, 1, keyword, pattern, 0.6) for pattern in names]
    for part, words, name in _COMMONS:
        for version in _VERSIONS:
            label = f"cc-{part}-{version.replace(' ', '.')}"
            rules.append(Rule(label, 3, "spdx", f"spdx license identifier cc {words} {version}", 0.95))
            rules.append(Rule(label, 2, "cc", f"cc {words} {version}", 0.85))
            rules.append(Rule(label, 2, "commons", f"creative commons {name}(?: license)? (?:version )?{version}", 0.85))
            rules.append(Rule(label, 2, "creativecommons", f"creativecommons org licenses {words} {version}", 0.9))
        rules.append(Rule(f"cc-{part}", 1, "cc", f"cc {words}", 0.6))
        rules.append(Rule(f"cc-{part}", 1, "commons", f"creative commons {name}", 0.6))
    rules.append(Rule("cc0-1.0", 3, "spdx", "spdx license identifier cc0 1 0", 0.95))
    rules.append(Rule("cc0-1.0", 2, "cc0", "cc0(?: 1 0)?", 0.85))
    rules.append(Rule("cc0-1.0", 2, "creativecommons", "creativecommons org publicdomain zero 1 0", 0.9))
    return rules
