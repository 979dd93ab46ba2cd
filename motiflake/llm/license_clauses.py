"""Hand-written license signatures: what notices and license texts say, one regular expression for each clause.

Patterns are over lower-cased (A-Z) text. A blank stands for any run of blanks, line ends and comment marks. The keyword
is one word that every match holds. Relevance says how surely the clause names the license.
"""

# label, clause, keyword, relevance
CLAUSES = (
    # MIT, X11 and their kin
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", "hereby", 1.0),
    ("mit", r"to deal in the software without restriction, including without limitation the rights", "restriction", 0.9),
    ("mit", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies", "permission", 0.9),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim", "holders", 0.7),
    ("mit", r"(?:under|see) the mit[- ]style licen[sc]e", "mit", 0.7),
    ("mit", r"use of this source code is governed by an mit-style", "governed", 0.9),
    ("mit-0", r"mit no attribution", "attribution", 0.9),
    ("mit", r"dual[- ]licensed under (?:the )?mit (?:and|or) (?:the )?(?:gpl|apache|bsd)", "dual", 0.8),
    ("x11", r"except as contained in this notice, the names? of .{1,80}? shall not be used in advertising", "advertising", 0.9),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose", "documentation", 0.8),
    ("hpnd", r"makes no representations about the suitability of this software for any purpose", "suitability", 0.7),
    ("ntp", r"makes no representations about the suitability this software for any purpose", "suitability", 0.9),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee", "permission", 1.0),
    ("isc", r"the software is provided \W{0,2}as is\W{0,2} and the author disclaims all warranties", "disclaims", 0.9),
    ("0bsd", r"bsd zero clause licen[sc]e|zero[- ]clause bsd", "zero", 0.9),
    ("curl", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "hereby", 0.6),
    # BSD
    ("bsd", r"redistribution and use in source and binary forms,? with or without modification", "redistribution", 0.9),
    ("bsd", r"redistributions of source code must retain the (?:above )?copyright notice", "redistributions", 0.8),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", 0.8),
    ("bsd-3-clause", r"neither the names? of .{1,120}? nor the names of (?:its|their|any) contributors may be used", "contributors", 0.9),
    ("bsd-3-clause", r"the names? of the authors? may not be used to endorse or promote products", "endorse", 0.8),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising", 1.0),
    ("bsd-4-clause", r"this product includes software developed by", "developed", 0.6),
    ("bsd-2-clause-views", r"the views and conclusions contained in the software and documentation are those of the authors", "conclusions", 0.9),
    ("bsd-2-clause-patent", r"bsd[ -]2[ -]clause plus patent", "patent", 0.9),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party's patent rights are granted by this licen[sc]e", "patent", 0.9),
    ("bsd", r"(?:governed by|under|see) a bsd[- ]style licen[sc]e", "bsd", 0.8),
    ("bsd-source-code", r"redistribution and use of this software in source and binary forms", "redistribution", 0.6),
    # Apache
    ("apache", r"you may not use this file except in compliance with the licen[sc]e", "compliance", 0.9),
    ("apache", r"unless required by applicable law or agreed to in writing,? software distributed under the licen[sc]e", "applicable", 0.9),
    ("apache", r"licensed to the apache software foundation \(asf\)", "asf", 1.0),
    ("apache", r"see the notice file distributed with this work for additional information", "notice", 0.8),
    ("apache", r"terms and conditions for use, reproduction, and distribution", "reproduction", 0.7),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache", 0.9),
    ("apache-1.0", r"this product includes software developed by the apache group", "apache", 0.9),
    ("apache-2.0", r"under the apache ?2(?:\.0)? licen[sc]e", "apache", 0.9),
    ("apache-2.0", r"\basl ?2\.0\b", "asl", 0.6),
    # GNU
    ("gpl", r"(?:you can|may be|to) redistribute[d]? (?:it )?and/or modif(?:y|ied) (?:it )?under the terms of the gnu general public licen[sc]e", "gnu", 1.0),
    ("lgpl", r"(?:you can|may be|to) redistribute[d]? (?:it )?and/or modif(?:y|ied) (?:it )?under the terms of the gnu (?:lesser|library) general public licen[sc]e", "gnu", 1.0),
    ("agpl", r"(?:you can|may be|to) redistribute[d]? (?:it )?and/or modif(?:y|ied) (?:it )?under the terms of the gnu affero general public licen[sc]e", "affero", 1.0),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e", "received", 0.9),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "received", 0.9),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[sc]e", "affero", 0.9),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public", "merchantability", 0.9),
    ("gpl", r"comes with absolutely no warranty; for details", "absolutely", 0.7),
    ("gpl", r"the gnu general public licen[sc]e does not permit incorporating", "incorporating", 0.9),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document", "verbatim", 0.6),
    ("gpl-2.0", r"\bgpl ?v?2(?:\.0)?(?: only|\+)?\b", "gpl", 0.7),
    ("gpl-3.0", r"\bgpl ?v?3(?:\.0)?(?: only|\+)?\b", "gpl", 0.7),
    ("lgpl-2.1", r"\blgpl ?v?2\.1\+?", "lgpl", 0.7),
    ("lgpl-3.0", r"\blgpl ?v?3(?:\.0)?\+?", "lgpl", 0.7),
    ("agpl-3.0", r"\bagpl ?v?3(?:\.0)?\+?", "agpl", 0.7),
    ("gpl-linking-exception", r"as a special exception,.{0,120}? (?:permission to link|linking)", "exception", 0.8),
    ("classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work", "statically", 1.0),
    ("bison-exception", r"as a special exception, you may create a larger work that contains part or all of the bison parser", "bison", 1.0),
    ("autoconf-exception", r"the configure script .{0,80}?(?:generated|output) by autoconf", "autoconf", 0.7),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation", "documentation", 1.0),
    ("gfdl", r"with no invariant sections, (?:with )?no front-cover texts", "invariant", 0.9),
    # Mozilla, Eclipse, CDDL and other file-based copyleft
    ("mpl", r"this source code form is subject to the terms of the mozilla public licen[sc]e", "mozilla", 1.0),
    ("mpl", r"the contents of this file are subject to the mozilla public licen[sc]e", "mozilla", 1.0),
    ("mpl", r"if a copy of the mpl was not distributed with this file", "mpl", 0.9),
    ("mpl", r"incompatible with secondary licenses", "secondary", 0.7),
    ("npl", r"the contents of this file are subject to the netscape public licen[sc]e", "netscape", 1.0),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "eclipse", 1.0),
    ("edl", r"eclipse distribution licen[sc]e", "eclipse", 0.9),
    ("cpl", r"common public licen[sc]e(?: version 1\.0|,? v ?1\.0)?", "common", 0.8),
    ("ipl", r"ibm public licen[sc]e", "ibm", 0.9),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "development", 1.0),
    ("cpal", r"common public attribution licen[sc]e", "attribution", 0.9),
    ("apsl", r"apple public source licen[sc]e", "apple", 0.9),
    ("spl", r"sun public licen[sc]e", "sun", 0.8),
    ("qpl", r"\bq public licen[sc]e", "public", 0.8),
    ("rpl", r"reciprocal public licen[sc]e", "reciprocal", 0.9),
    ("ms-pl", r"microsoft public licen[sc]e|\bms-pl\b", "ms-pl|microsoft", 0.9),
    ("ms-rl", r"microsoft reciprocal licen[sc]e|\bms-rl\b", "ms-rl|microsoft", 0.9),
    ("eupl", r"licensed under the eupl", "eupl", 1.0),
    ("cecill", r"this software is governed by the cecill(?:-[bc])? licen[sc]e", "cecill", 1.0),
    ("cecill", r"\bcecill(?:-[bc])?(?: licen[sc]e)?\b", "cecill", 0.7),
    ("osl", r"licensed under the open software licen[sc]e", "open", 0.9),
    ("afl", r"licensed under the academic free licen[sc]e", "academic", 0.9),
    ("watcom", r"sybase open watcom public licen[sc]e", "watcom", 0.9),
    # permissive ones with texts of their own
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty", "warranty", 0.9),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented", 1.0),
    ("zlib", r"altered source versions must be plainly marked as such", "plainly", 1.0),
    ("libpng", r"the contributing authors and group 42, inc\. disclaim", "contributing", 1.0),
    ("libpng", r"\blibpng licen[sc]e", "libpng", 0.8),
    ("bsl", r"distributed under the boost software licen[sc]e", "boost", 1.0),
    ("bsl", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy", "organization", 1.0),
    ("openssl", r"this product includes software developed by the openssl project", "openssl", 1.0),
    ("openssl", r"(?:openssl and ssleay|dual openssl) licen[sc]es?", "openssl", 0.8),
    ("ssleay", r"this package is an ssl implementation written by eric young", "implementation", 1.0),
    ("php", r"this source file is subject to version [\d.]{1,4} of the php licen[sc]e", "php", 1.0),
    ("php", r"includes php software, freely available from", "freely", 0.9),
    ("psf", r"psf licen[sc]e agreement for python", "psf", 1.0),
    ("psf", r"psf hereby grants licensee a nonexclusive, royalty-free, world-wide licen[sc]e", "psf", 1.0),
    ("cnri-python", r"cnri (?:open source )?licen[sc]e agreement", "cnri", 0.9),
    ("ruby", r"you can redistribute it and/or modify it under either the terms of the (?:gpl|2-clause bsdl)", "either", 0.8),
    ("ruby", r"(?:same terms|licensed under the same licen[sc]e) as ruby", "ruby", 0.8),
    ("artistic", r"(?:under )?the same terms as perl itself", "perl", 0.9),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "intent", 0.9),
    ("vim", r"\bvim licen[sc]e|distributed under the same terms as vim", "vim", 0.8),
    ("tcl", r"the authors hereby grant permission to use, copy, modify, distribute, and licen[sc]e this software", "hereby", 0.9),
    ("json", r"the software shall be used for good, not evil", "evil", 1.0),
    ("beerware", r"(?:the )?beer-?ware licen[sc]e", "beer", 1.0),
    ("beerware", r"you can buy me a beer in return", "beer", 0.9),
    ("wtfpl", r"you just do what the fuck you want to", "fuck", 1.0),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg", 1.0),
    ("freetype", r"portions of this software are copyright .{0,40}? the freetype project", "freetype", 1.0),
    ("freetype", r"the freetype project licen[sc]e", "freetype", 0.9),
    ("icu", r"\bicu licen[sc]e", "icu", 0.8),
    ("unicode", r"unicode,? inc\. licen[sc]e agreement", "unicode", 1.0),
    ("unicode", r"permission is hereby granted, free of charge, to any person obtaining a copy of (?:the unicode )?data files", "data", 0.9),
    ("w3c", r"w3c software (?:and document )?(?:notice and )?licen[sc]e", "w3c", 1.0),
    ("zpl", r"zope public licen[sc]e", "zope", 0.9),
    ("sleepycat", r"sleepycat licen[sc]e|redistributions in any form must be accompanied by information on how to obtain complete source", "sleepycat|accompanied", 0.9),
    ("ncsa", r"to deal with the software without restriction, including without limitation", "restriction", 0.9),
    ("ofl", r"this font software is licensed under the sil open font licen[sc]e", "font", 1.0),
    ("ofl", r"the fonts and derivatives, however, cannot be released under any other type of licen[sc]e", "derivatives", 1.0),
    ("bitstream-vera", r"bitstream vera is a trademark of bitstream", "bitstream", 1.0),
    ("lppl", r"distributed and/or modified under the conditions of the latex project public licen[sc]e", "latex", 1.0),
    ("lppl", r"\blatex project public licen[sc]e|\blppl\b", "latex|lppl", 0.8),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct, indirect", "california", 0.6),
    ("postgresql", r"\bpostgresql licen[sc]e", "postgresql", 0.9),
    ("upl", r"subject to the condition set forth below, permission is hereby granted to any person obtaining a copy", "subject", 0.8),
    ("blueoak", r"blue oak model licen[sc]e", "oak", 1.0),
    ("mulan", r"mulan (?:permissive|public) (?:software )?licen[sc]e|\bmulan ?psl\b", "mulan", 1.0),
    ("fair", r"usage of the works is permitted provided that this instrument is retained", "instrument", 1.0),
    ("naumen", r"naumen public licen[sc]e", "naumen", 0.9),
    ("xnet", r"\bx\.net licen[sc]e", "net", 0.7),
    ("imagemagick", r"\bimagemagick licen[sc]e", "imagemagick", 0.9),
    ("gnuplot", r"permission to use, copy, and distribute this software and its documentation for any purpose .{0,80}? gnuplot", "gnuplot", 0.9),
    ("netcdf", r"access and use of this software shall impose the following obligations", "obligations", 0.8),
    ("bzip2", r"bzip2 (?:and libbzip2 )?licen[sc]e", "bzip2", 0.8),
    ("openldap", r"openldap public licen[sc]e", "openldap", 1.0),
    ("sqlite", r"the author disclaims copyright to this source code\. in place of a legal notice, here is a blessing", "blessing", 1.0),
    # public domain
    ("public-domain", r"(?:released|placed|dedicated|donated|put) (?:in|to|into) the public domain", "domain", 0.8),
    ("public-domain", r"(?:is|are) (?:hereby )?(?:in )?(?:the )?public domain(?: software)?\b", "domain", 0.5),
    ("public-domain", r"(?:author|authors) (?:hereby )?disclaims? (?:all )?copyright", "disclaim", 0.8),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 1.0),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell,? or distribute this software", "anyone", 1.0),
    ("cc0", r"to the extent possible under law,.{0,160}? waived all copyright", "waived", 1.0),
    ("cc0", r"no copyright(?: -|\.) (?:cc0|public domain)", "copyright", 0.6),
    ("pddl", r"public domain dedication and licen[sc]e|\bpddl\b", "dedication|pddl", 0.9),
    # content
    ("cc", r"(?:this|the) (?:work|text|article|page|content|document|image|material)s? (?:is|are) (?:made available |released |distributed )?(?:licensed )?under (?:a|the) creative commons", "creative", 0.7),
    ("cc", r"some rights reserved", "rights", 0.5),
    ("odbl", r"made available under the open database licen[sc]e", "database", 1.0),
    ("odc-by", r"open data commons attribution licen[sc]e|\bodc-by\b", "commons|odc-by", 0.9),
    ("ogl", r"open government licen[sc]e", "government", 0.9),
    ("opl", r"open publication licen[sc]e", "publication", 0.9),
    ("freeart", r"free art licen[sc]e|licence art libre", "libre|free", 0.8),
    # source-available and commercial
    ("sspl", r"server side public licen[sc]e", "server", 1.0),
    ("busl", r"business source licen[sc]e", "business", 1.0),
    ("elastic", r"elastic licen[sc]e(?: 2\.0)?", "elastic", 0.9),
    ("commons-clause", r"\bcommons clause\b", "commons", 0.9),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) licen[sc]e", "polyform", 1.0),
    ("non-commercial", r"(?:for|free for) (?:personal and )?non-?commercial use only", "commercial", 0.6),
    ("evaluation", r"for (?:evaluation|testing) purposes only", "purposes", 0.3),
    ("proprietary", r"all rights (?:are )?reserved", "reserved", 0.4),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 0.6),
    ("proprietary", r"unauthorized (?:copying|reproduction|distribution|use)[^.]{0,80}? (?:is )?(?:strictly )?prohibited", "unauthorized", 0.6),
    ("proprietary", r"this software contains (?:the )?(?:valuable )?trade secrets", "secrets", 0.7),
    ("proprietary", r"no part of this (?:publication|document|work|book|page) may be (?:reproduced|copied|distributed)", "reproduced|copied|distributed", 0.6),
    ("proprietary", r"end[- ]user licen[sc]e agreement", "agreement", 0.5),
    ("proprietary", r"(?:you may not|shall not) (?:reverse engineer|decompile|disassemble)", "reverse|decompile|disassemble", 0.6),
    ("proprietary", r"licensed, not sold", "sold", 0.6),
    ("generic", r"(?:released|distributed|available) under (?:an? )?(?:permissive|free|open source|copyleft) licen[sc]e", "under", 0.3),
    ("generic", r"see (?:the )?(?:accompanying )?(?:file )?(?:licen[sc]e|copying)(?:\.txt|\.md)? (?:file )?for (?:more )?(?:details|licen[sc]e|information)", "see", 0.3),
    ("generic", r"licen[sc]ed under (?:the |an? )?(?!apache|mit|gnu|bsd|mozilla|eclipse|cc|creative)[\w.-]+(?: [\w.-]+){0,3} licen[sc]e", "under", 0.3),
)
