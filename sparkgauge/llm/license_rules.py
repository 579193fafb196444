"""Signatures of licences and notices, in order of priority.

Each rule is (label, keyword, signature).  A signature is a regular expression over a text's words, which are in lower case and
joined by single blanks; it must begin and end at a word.  The keyword is a word that every match contains: rules are tried only
around that word.  Earlier rules win over later ones of the same stretch; within a tier the order is the rule's rank.

Tiers, by how much a match says: 0 identifiers and addresses, 1 grants and titles with a version, 2 titles and names, 3 mentions.
"""

from __future__ import annotations

UNDER = r"(?:(?:is |are |be )?(?:made available|licen[cs]ed|released|distributed|provided|published|available|covered|governed|offered|redistributed)(?: to you)? )?(?:under|by|per|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?"

TIERS: list[list[tuple[str, str, str]]] = [
    # identifiers after a tag, and addresses of licence texts
    [
        ("mit", "spdx", r"spdx license identifier mit"),
        ("mit-0", "spdx", r"spdx license identifier mit 0"),
        ("apache-1.1", "spdx", r"spdx license identifier apache 1 1"),
        ("apache-2", "spdx", r"spdx license identifier apache 2 0"),
        ("bsd-2-clause", "spdx", r"spdx license identifier bsd 2 clause(?: patent| views)?"),
        ("bsd-3-clause", "spdx", r"spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?"),
        ("bsd-4-clause", "spdx", r"spdx license identifier bsd 4 clause(?: uc)?"),
        ("0bsd", "spdx", r"spdx license identifier 0bsd"),
        ("gpl-1", "spdx", r"spdx license identifier gpl 1 0(?: only| or later)?"),
        ("gpl-2", "spdx", r"spdx license identifier gpl 2 0(?: only| or later)?(?: with \w+ exception(?: 2 0)?)?"),
        ("gpl-3", "spdx", r"spdx license identifier gpl 3 0(?: only| or later)?(?: with \w+ exception(?: 3 1)?)?"),
        ("lgpl-2", "spdx", r"spdx license identifier lgpl 2 0(?: only| or later)?"),
        ("lgpl-2.1", "spdx", r"spdx license identifier lgpl 2 1(?: only| or later)?"),
        ("lgpl-3", "spdx", r"spdx license identifier lgpl 3 0(?: only| or later)?"),
        ("agpl-1", "spdx", r"spdx license identifier agpl 1 0(?: only| or later)?"),
        ("agpl-3", "spdx", r"spdx license identifier agpl 3 0(?: only| or later)?"),
        ("gfdl", "spdx", r"spdx license identifier gfdl 1 [123](?: only| or later| no invariants(?: only| or later))?"),
        ("mpl-1", "spdx", r"spdx license identifier mpl 1 [01]"),
        ("mpl-2", "spdx", r"spdx license identifier mpl 2 0(?: no copyleft exception)?"),
        ("epl-1", "spdx", r"spdx license identifier epl 1 0"),
        ("epl-2", "spdx", r"spdx license identifier epl 2 0"),
        ("edl-1", "spdx", r"spdx license identifier edl 1 0"),
        ("cddl-1", "spdx", r"spdx license identifier cddl 1 [01]"),
        ("cpl-1", "spdx", r"spdx license identifier cpl 1 0"),
        ("eupl", "spdx", r"spdx license identifier eupl 1 [012]"),
        ("cecill", "spdx", r"spdx license identifier cecill (?:1 [01]|2 [01]|b|c)"),
        ("isc", "spdx", r"spdx license identifier isc"),
        ("zlib", "spdx", r"spdx license identifier zlib(?: acknowledgement)?"),
        ("libpng", "spdx", r"spdx license identifier libpng(?: 2 0)?"),
        ("boost-1", "spdx", r"spdx license identifier bsl 1 0"),
        ("busl-1.1", "spdx", r"spdx license identifier busl 1 1"),
        ("elastic-2", "spdx", r"spdx license identifier elastic 2 0"),
        ("sspl-1", "spdx", r"spdx license identifier sspl 1 0"),
        ("unlicense", "spdx", r"spdx license identifier unlicense"),
        ("wtfpl", "spdx", r"spdx license identifier wtfpl"),
        ("cc0", "spdx", r"spdx license identifier cc0 1 0"),
        ("cc-by", "spdx", r"spdx license identifier cc by [1-4] [05](?: igo| \w\w)?"),
        ("cc-by-sa", "spdx", r"spdx license identifier cc by sa [1-4] [05](?: igo| \w\w)?"),
        ("cc-by-nc", "spdx", r"spdx license identifier cc by nc [1-4] [05](?: igo| \w\w)?"),
        ("cc-by-nd", "spdx", r"spdx license identifier cc by nd [1-4] [05](?: igo| \w\w)?"),
        ("cc-by-nc-sa", "spdx", r"spdx license identifier cc by nc sa [1-4] [05](?: igo| \w\w)?"),
        ("cc-by-nc-nd", "spdx", r"spdx license identifier cc by nc nd [1-4] [05](?: igo| \w\w)?"),
        ("artistic-1", "spdx", r"spdx license identifier artistic 1 0(?: perl| cl8)?"),
        ("artistic-2", "spdx", r"spdx license identifier artistic 2 0"),
        ("afl-3", "spdx", r"spdx license identifier afl 3 0"),
        ("osl-3", "spdx", r"spdx license identifier osl 3 0"),
        ("ofl-1.1", "spdx", r"spdx license identifier ofl 1 1(?: rfn| no rfn)?"),
        ("odbl-1", "spdx", r"spdx license identifier odbl 1 0"),
        ("odc-by", "spdx", r"spdx license identifier odc by 1 0"),
        ("pddl-1", "spdx", r"spdx license identifier pddl 1 0"),
        ("cdla-permissive", "spdx", r"spdx license identifier cdla permissive [12] 0"),
        ("cdla-sharing", "spdx", r"spdx license identifier cdla sharing 1 0"),
        ("postgresql", "spdx", r"spdx license identifier postgresql"),
        ("python-2", "spdx", r"spdx license identifier (?:python|psf) 2 0"),
        ("php-3", "spdx", r"spdx license identifier php 3 0(?:1)?"),
        ("ruby", "spdx", r"spdx license identifier ruby"),
        ("vim", "spdx", r"spdx license identifier vim"),
        ("ncsa", "spdx", r"spdx license identifier ncsa"),
        ("upl-1", "spdx", r"spdx license identifier upl 1 0"),
        ("mulan-psl", "spdx", r"spdx license identifier mulanpsl [12] 0"),
        ("openssl", "spdx", r"spdx license identifier openssl"),
        ("x11", "spdx", r"spdx license identifier x11"),
        ("ms-pl", "spdx", r"spdx license identifier ms pl"),
        ("ms-rl", "spdx", r"spdx license identifier ms rl"),
        ("apache-2", "apache", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
        ("apache-1.1", "apache", r"(?:https? )?(?:www )?apache org licenses license 1 1(?: txt| html)?"),
        ("cc0", "creativecommons", r"(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0"),
        ("public-domain", "creativecommons", r"(?:https? )?(?:www )?creativecommons org publicdomain mark 1 0"),
        ("cc-by-nc-nd", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nc nd [1-4] [05]"),
        ("cc-by-nc-sa", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nc sa [1-4] [05]"),
        ("cc-by-nc", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nc [1-4] [05]"),
        ("cc-by-nd", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nd [1-4] [05]"),
        ("cc-by-sa", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by sa [1-4] [05]"),
        ("cc-by", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by [1-4] [05]"),
        ("mit", "opensource", r"(?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php| html)?"),
        ("bsd-3-clause", "opensource", r"(?:https? )?(?:www )?opensource org licenses bsd 3 clause"),
        ("bsd-2-clause", "opensource", r"(?:https? )?(?:www )?opensource org licenses bsd (?:2 clause|license)(?: php| html)?"),
        ("isc", "opensource", r"(?:https? )?(?:www )?opensource org licenses isc(?: license)?(?: txt)?"),
        ("gpl-3", "gnu", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft) gpl 3 0(?: en)?(?: html| txt)?"),
        ("gpl-2", "gnu", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft)(?: old licenses)? gpl 2 0(?: en)?(?: html| txt)?"),
        ("lgpl-3", "gnu", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft) lgpl 3 0(?: en)?(?: html| txt)?"),
        ("lgpl-2.1", "gnu", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft)(?: old licenses)? lgpl 2 1(?: en)?(?: html| txt)?"),
        ("agpl-3", "gnu", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft) agpl 3 0(?: en)?(?: html| txt)?"),
        ("gpl", "gnu", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt)?"),
        ("gfdl", "gnu", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: en)?(?: html| txt)?"),
        ("mpl-2", "mozilla", r"(?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0"),
        ("mpl-1", "mozilla", r"(?:https? )?(?:www )?mozilla org mpl(?: mpl)? 1 [01](?: txt| html)?"),
        ("epl-1", "eclipse", r"(?:https? )?(?:www )?eclipse org legal epl v10(?: html)?"),
        ("epl-2", "eclipse", r"(?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?"),
        ("boost-1", "boost", r"(?:https? )?(?:www )?boost org license 1 0(?: txt)?"),
        ("unlicense", "unlicense", r"(?:https? )?(?:www )?unlicense org"),
        ("wtfpl", "wtfpl", r"(?:https? )?(?:www |sam zoy org )wtfpl(?: net)?"),
        ("ofl-1.1", "ofl", r"(?:https? )?scripts sil org ofl"),
        ("odbl-1", "opendatacommons", r"(?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?"),
        ("odc-by", "opendatacommons", r"(?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?"),
        ("pddl-1", "opendatacommons", r"(?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?"),
    ],
    # grants, and titles with a version
    [
        ("mit", "mit", UNDER + r" (?:mit|expat)(?: x11| style)? licen[cs]e"),
        ("mit", "charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
        ("isc", "purpose", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
        ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd-3-clause", "endorse", r"neither the names? of (?:\S+ ){1,8}nor the names of (?:its|their) contributors may be used to endorse or promote products"),
        ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
        ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
        ("wtfpl", "want", r"you just do what the fuck you want to"),
        ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
        ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
        ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
        ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
        ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? 2 0"),
        ("epl-2", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v|version )?2 0"),
        ("epl-1", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v|version )?1 0"),
        ("boost-1", "boost", r"distributed under the boost software licen[cs]e version 1 0"),
        ("apache-2", "apache", r"(?:" + UNDER + r" )?apache (?:software )?(?:foundation )?licen[cs]e(?: v| version)? ?2(?: 0)?"),
        ("apache-2", "apache", r"apache 2(?: 0)? licen[cs]ed?"),
        ("apache-1.1", "apache", r"(?:" + UNDER + r" )?apache (?:software )?licen[cs]e(?: v| version) 1 1"),
        ("apache-1", "apache", r"(?:" + UNDER + r" )?apache (?:software )?licen[cs]e(?: v| version) 1 0"),
        ("gpl-3", "gnu", r"(?:" + UNDER + r" )?gnu general public licen[cs]e(?: v| version)? ?3(?: 0)?(?: or(?: any)? later)?"),
        ("gpl-2", "gnu", r"(?:" + UNDER + r" )?gnu general public licen[cs]e(?: v| version)? ?2(?: 0)?(?: or(?: any)? later)?"),
        ("gpl-1", "gnu", r"(?:" + UNDER + r" )?gnu general public licen[cs]e(?: v| version) 1(?: 0)?"),
        ("lgpl-3", "gnu", r"(?:" + UNDER + r" )?gnu lesser general public licen[cs]e(?: v| version)? ?3(?: 0)?"),
        ("lgpl-2.1", "gnu", r"(?:" + UNDER + r" )?gnu lesser general public licen[cs]e(?: v| version)? ?2 1"),
        ("lgpl-2", "gnu", r"(?:" + UNDER + r" )?gnu library general public licen[cs]e(?: v| version)? ?2(?: 0)?"),
        ("agpl-3", "gnu", r"(?:" + UNDER + r" )?gnu affero general public licen[cs]e(?: v| version)? ?3(?: 0)?"),
        ("gfdl", "gnu", r"(?:" + UNDER + r" )?gnu free documentation licen[cs]e(?: v| version)? ?1 [123]"),
        ("gpl-3", "gpl", r"gpl ?v?(?:ersion )?3(?: 0)?(?: or(?: any)? later)?"),
        ("gpl-2", "gpl", r"gpl ?v?(?:ersion )?2(?: 0)?(?: or(?: any)? later)?"),
        ("gpl-3", "gplv3", r"(?:gnu )?gplv3(?: licen[cs]e)?"),
        ("gpl-2", "gplv2", r"(?:gnu )?gplv2(?: licen[cs]e)?"),
        ("lgpl-3", "lgpl", r"lgpl ?v?(?:ersion )?3(?: 0)?"),
        ("lgpl-2.1", "lgpl", r"lgpl ?v?(?:ersion )?2 1"),
        ("lgpl-3", "lgplv3", r"(?:gnu )?lgplv3(?: licen[cs]e)?"),
        ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2(?: 1)?(?: licen[cs]e)?"),
        ("agpl-3", "agpl", r"agpl ?v?(?:ersion )?3(?: 0)?"),
        ("agpl-3", "agplv3", r"(?:gnu )?agplv3(?: licen[cs]e)?"),
        ("mpl-2", "mozilla", r"(?:" + UNDER + r" )?mozilla public licen[cs]e(?: v| version)? ?2(?: 0)?"),
        ("mpl-1", "mozilla", r"(?:" + UNDER + r" )?mozilla public licen[cs]e(?: v| version)? ?1 [01]"),
        ("epl-2", "eclipse", r"(?:" + UNDER + r" )?eclipse public licen[cs]e(?: v| version)? ?2(?: 0)?"),
        ("epl-1", "eclipse", r"(?:" + UNDER + r" )?eclipse public licen[cs]e(?: v| version)? ?1(?: 0)?"),
        ("edl-1", "eclipse", r"eclipse distribution licen[cs]e(?: v| version)? ?1(?: 0)?"),
        ("cddl-1", "development", r"common development and distribution licen[cs]e(?: v| version)? ?1(?: [01])?"),
        ("cpl-1", "common", r"common public licen[cs]e(?: v| version)? ?1(?: 0)?"),
        ("eupl", "european", r"european union public licen[cs]e(?: v| version)?(?: ?1 [012])?"),
        ("cc-by-nc-nd", "cc", r"(?:" + UNDER + r" )?cc by nc nd [1-4](?: [05])?(?: licen[cs]e| igo)?"),
        ("cc-by-nc-sa", "cc", r"(?:" + UNDER + r" )?cc by nc sa [1-4](?: [05])?(?: licen[cs]e| igo)?"),
        ("cc-by-nc", "cc", r"(?:" + UNDER + r" )?cc by nc [1-4](?: [05])?(?: licen[cs]e| igo)?"),
        ("cc-by-nd", "cc", r"(?:" + UNDER + r" )?cc by nd [1-4](?: [05])?(?: licen[cs]e| igo)?"),
        ("cc-by-sa", "cc", r"(?:" + UNDER + r" )?cc by sa [1-4](?: [05])?(?: licen[cs]e| igo)?"),
        ("cc-by", "cc", r"(?:" + UNDER + r" )?cc by [1-4](?: [05])?(?: licen[cs]e| igo)?"),
        ("cc0", "cc0", r"(?:" + UNDER + r" )?cc0 1(?: 0)?(?: universal)?(?: public domain dedication)?"),
        ("cc-by-nc-nd", "commons", r"(?:" + UNDER + r" )?creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
        ("cc-by-nc-sa", "commons", r"(?:" + UNDER + r" )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
        ("cc-by-nc", "commons", r"(?:" + UNDER + r" )?creative commons attribution non ?commercial(?: [1-4] [05])?"),
        ("cc-by-nd", "commons", r"(?:" + UNDER + r" )?creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
        ("cc-by-sa", "commons", r"(?:" + UNDER + r" )?creative commons attribution share ?alike(?: [1-4] [05])?"),
        ("cc-by", "commons", r"(?:" + UNDER + r" )?creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
        ("cc0", "commons", r"creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?"),
        ("artistic-2", "artistic", r"artistic licen[cs]e(?: v| version)? ?2(?: 0)?"),
        ("artistic-1", "artistic", r"artistic licen[cs]e(?: v| version)? ?1(?: 0)?"),
        ("afl-3", "academic", r"academic free licen[cs]e(?: v| version)? ?3(?: 0)?"),
        ("osl-3", "open", r"open software licen[cs]e(?: v| version)? ?3(?: 0)?"),
        ("ofl-1.1", "sil", r"sil open font licen[cs]e(?: v| version)? ?1 1"),
        ("odbl-1", "database", r"open data ?(?:commons )?(?:open )?database licen[cs]e(?: v| version)?(?: ?1 0)?"),
        ("busl-1.1", "business", r"business source licen[cs]e(?: v| version)? ?1 1"),
        ("elastic-2", "elastic", r"elastic licen[cs]e(?: v| version)? ?2(?: 0)?"),
        ("sspl-1", "server", r"server side public licen[cs]e(?: v| version)? ?1"),
        ("polyform-noncommercial", "polyform", r"polyform non ?commercial licen[cs]e(?: 1 0 0)?"),
        ("polyform-small-business", "polyform", r"polyform small business licen[cs]e(?: 1 0 0)?"),
        ("openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[cs]e)?"),
        ("llama", "llama", r"llama [234](?: [0-9])? community licen[cs]e(?: agreement)?"),
        ("gemma", "gemma", r"gemma terms of use"),
        ("mulan-psl", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v| version)? ?[12]"),
        ("upl-1", "universal", r"universal permissive licen[cs]e(?: v| version)? ?1(?: 0)?"),
        ("php-3", "php", r"php licen[cs]e(?: v| version)? ?3(?: 01?)?"),
        ("python-2", "python", r"python (?:software foundation )?licen[cs]e(?: v| version)? ?2"),
        ("ogl-uk", "government", r"open government licen[cs]e(?: v| version)?(?: ?[123](?: 0)?)?"),
    ],
    # titles and names
    [
        ("mit", "mit", r"(?:the )?mit(?: x11| expat| style)? licen[cs]e"),
        ("mit-0", "attribution", r"mit no attribution"),
        ("mit", "expat", r"expat licen[cs]e"),
        ("x11", "x11", r"x11 licen[cs]e"),
        ("isc", "isc", r"isc licen[cs]e"),
        ("bsd-2-clause", "clause", r"(?:bsd 2|2) clause (?:bsd )?licen[cs]e"),
        ("bsd-3-clause", "clause", r"(?:bsd 3|3) clause (?:bsd )?licen[cs]e"),
        ("bsd-4-clause", "clause", r"(?:bsd 4|4) clause (?:bsd )?licen[cs]e"),
        ("bsd-2-clause", "simplified", r"simplified bsd licen[cs]e"),
        ("bsd-3-clause", "modified", r"(?:modified|new|revised) bsd licen[cs]e"),
        ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
        ("0bsd", "zero", r"(?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?"),
        ("apache", "apache", r"apache (?:software )?(?:foundation )?licen[cs]e"),
        ("gpl", "gnu", r"gnu general public licen[cs]e"),
        ("lgpl", "gnu", r"gnu (?:lesser|library) general public licen[cs]e"),
        ("agpl", "gnu", r"gnu affero general public licen[cs]e"),
        ("gfdl", "gnu", r"gnu free documentation licen[cs]e"),
        ("gpl", "gnu", r"gnu gpl"),
        ("lgpl", "gnu", r"gnu lgpl"),
        ("agpl", "gnu", r"gnu agpl"),
        ("gpl", "gpl", r"gpl licen[cs]ed?"),
        ("lgpl", "lgpl", r"lgpl licen[cs]ed?"),
        ("agpl", "agpl", r"agpl licen[cs]ed?"),
        ("agpl", "affero", r"affero (?:gpl|general public licen[cs]e)"),
        ("mpl", "mozilla", r"mozilla public licen[cs]e"),
        ("epl", "eclipse", r"eclipse public licen[cs]e"),
        ("cddl", "development", r"common development and distribution licen[cs]e"),
        ("cpl", "common", r"common public licen[cs]e"),
        ("ipl", "ibm", r"ibm public licen[cs]e(?: v| version)?(?: 1 0)?"),
        ("cecill", "cecill", r"cecill(?: [bc])?(?: licen[cs]e)?"),
        ("eupl", "eupl", r"eupl(?: v?1 [012])?"),
        ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
        ("libpng", "libpng", r"libpng licen[cs]e"),
        ("boost-1", "boost", r"boost software licen[cs]e"),
        ("unlicense", "unlicense", r"the unlicense"),
        ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?"),
        ("beerware", "beerware", r"(?:the )?beerware licen[cs]e"),
        ("beerware", "beer", r"beer ware licen[cs]e"),
        ("artistic", "artistic", r"artistic licen[cs]e"),
        ("perl", "perl", r"(?:under )?the same terms as perl(?: itself)?"),
        ("ruby", "ruby", r"ruby(?: s)? licen[cs]e"),
        ("vim", "vim", r"vim licen[cs]e"),
        ("php-3", "php", r"php licen[cs]e"),
        ("python-2", "python", r"python (?:software foundation )?licen[cs]e"),
        ("postgresql", "postgresql", r"postgresql licen[cs]e"),
        ("openssl", "openssl", r"openssl(?: ssleay)? licen[cs]e"),
        ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
        ("curl", "curl", r"curl licen[cs]e"),
        ("ftl", "freetype", r"freetype (?:project )?licen[cs]e"),
        ("ijg", "jpeg", r"independent jpeg group(?: s)? licen[cs]e"),
        ("w3c", "w3c", r"w3c software(?: notice)?(?: and)? licen[cs]e"),
        ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
        ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
        ("npl", "netscape", r"netscape public licen[cs]e"),
        ("spl", "sun", r"sun public licen[cs]e"),
        ("apsl", "apple", r"apple public source licen[cs]e"),
        ("osl", "open", r"open software licen[cs]e"),
        ("afl", "academic", r"academic free licen[cs]e"),
        ("ecl", "educational", r"educational community licen[cs]e"),
        ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e"),
        ("odbl-1", "odbl", r"(?:the )?odbl(?: licen[cs]e)?"),
        ("odc-by", "odc", r"odc by(?: licen[cs]e)?"),
        ("pddl-1", "dedication", r"public domain dedication and licen[cs]e"),
        ("cdla-permissive", "cdla", r"cdla permissive"),
        ("cdla-sharing", "cdla", r"cdla sharing"),
        ("busl-1.1", "business", r"business source licen[cs]e"),
        ("elastic", "elastic", r"elastic licen[cs]e"),
        ("sspl-1", "sspl", r"sspl(?: licen[cs]e)?"),
        ("commons-clause", "clause", r"commons clause(?: licen[cs]e)?"),
        ("cc-by-nc-nd", "cc", r"cc by nc nd"),
        ("cc-by-nc-sa", "cc", r"cc by nc sa"),
        ("cc-by-nc", "cc", r"cc by nc"),
        ("cc-by-nd", "cc", r"cc by nd"),
        ("cc-by-sa", "cc", r"cc by sa"),
        ("cc-by", "cc", r"cc by(?: licen[cs]e)"),
        ("cc0", "cc0", r"cc0(?: licen[cs]e| dedication)"),
        ("creative-commons", "commons", r"creative commons(?: public)? licen[cs]e"),
        ("public-domain", "domain", r"(?:released |placed |dedicated )(?:in|into|to) the public domain"),
        ("fair", "fair", r"fair licen[cs]e"),
        ("eula", "eula", r"end user licen[cs]e agreement"),
        ("eula", "user", r"end user licen[cs]e agreement"),
        ("noncommercial", "commercial", r"(?:for )?non commercial use only"),
        ("noncommercial", "noncommercial", r"(?:for )?noncommercial use only"),
        ("academic-only", "research", r"for (?:academic|research)(?: and (?:academic|research))? (?:purposes|use) only"),
        ("proprietary", "proprietary", r"proprietary and confidential"),
        ("proprietary", "proprietary", r"proprietary licen[cs]e"),
        ("commercial", "commercial", r"commercial licen[cs]e"),
        ("all-rights-reserved", "rights", r"all rights reserved"),
        ("some-rights-reserved", "rights", r"some rights reserved"),
        ("no-warranty", "warranty", r"without warranty of any kind"),
    ],
    # mentions
    [
        ("gpl", "gpl", r"(?:the )?gpl"),
        ("lgpl", "lgpl", r"(?:the )?lgpl"),
        ("agpl", "agpl", r"(?:the )?agpl"),
        ("public-domain", "domain", r"public domain"),
        ("creative-commons", "commons", r"creative commons"),
        ("copyleft", "copyleft", r"copyleft"),
        ("open-source", "source", r"open source licen[cs]ed?"),
        ("free-software", "software", r"free software licen[cs]e"),
        ("licence-notice", "license", r"(?:see|read) (?:the )?(?:accompanying |file )?license(?: file| txt| md)?(?: for)?(?: details| terms| information)?"),
        ("licence-notice", "licence", r"(?:see|read) (?:the )?(?:accompanying |file )?licence(?: file| txt| md)?(?: for)?(?: details| terms| information)?"),
        ("licence-notice", "licensed", r"licensed under"),
        ("licence-notice", "licenced", r"licenced under"),
        ("copyright-notice", "copyright", r"copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
        ("copyright-notice", "copyrighted", r"copyrighted (?:material|work)s?"),
    ],
]
