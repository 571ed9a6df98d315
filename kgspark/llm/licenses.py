"""License scan: ordered signature rules over whole texts, as DataFrame expressions alone.

A rule is a label, a priority, keywords and a regular expression over the normalised text (words joined by
single spaces). Every match of an expression holds one of its keywords, so it is tried only on texts that do; texts with no
keyword at all skip the rule table. Of the detections in a text, one whose span lies inside the span of
another of equal or higher priority is suppressed, and so is one inside a longer span of any priority
when that span's rule names the license in full. Equal spans keep the rule of higher priority, then the first rule.

Base labels are places where a fixed phrase's words stand consecutively; the rules never remove them.

Defined cases: null texts have no words; rules never match across a missing word; repeated rows give
repeated results; very long texts are scanned whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import words_col

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wordings that introduce a licence. A grant is tried with every name of a family; names that are too short to stand alone count after `UNDER` only.
GRANT = r"(?:licensed|released|distributed|available|published|provided|offered|dual licensed|relicensed) (?:\w+ ){0,3}?(?:under|with|by)"
UNDER = r"(?:licensed|relicensed|released|distributed|available|published|offered) (?:\w+ ){0,2}?under"
TERMS = r"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
VERSION = r"(?: (?:version|v|ver|release))?"
LATER = r"(?: or (?:\(?at your option\)? )?(?:any )?later(?: version)?| or newer| plus)?"

#: (label, keywords, full name, short name, name that counts after UNDER only): families of licences and what they go by; "" where there is none. The keywords cover every form of all three.
FAMILIES = (
    ("apache-1.0", "apache", r"apache (?:software )?licen[cs]e" + VERSION + r" 1 0", r"apache 1 0", ""),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e" + VERSION + r" 1 1", r"apache 1 1", ""),
    ("apache-2.0", "apache asl", r"apache (?:software )?licen[cs]e" + VERSION + r" 2(?: 0)?", r"(?:apache|asl) 2 0", r"apache v?2"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", "", r"apache"),
    ("mit", "mit expat", r"(?:mit|mit x11|mit expat|expat) licen[cs]e", "", r"(?:mit|expat)"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", r"mit 0 licen[cs]e", r"mit 0"),
    ("x11", "x11", r"x11 licen[cs]e", "", r"x11"),
    ("bsd-2-clause", "bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd)(?: licen[cs]e)?", "", ""),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd|three clause bsd)(?: licen[cs]e)?", "", ""),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd|four clause bsd)(?: licen[cs]e)?", "", ""),
    ("bsd", "bsd berkeley", r"(?:berkeley software distribution|bsd)(?: style)? licen[cs]e", "", r"bsd"),
    ("0bsd", "bsd 0bsd", r"(?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?", r"0bsd", ""),
    ("isc", "isc", r"isc licen[cs]e", "", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "", r"zlib"),
    ("gpl-1.0", "general gpl gpl1 gplv1 gplv", r"(?:gnu )?general public licen[cs]e" + VERSION + r" 1(?: 0)?" + LATER, r"gpl ?v? ?1(?: 0)?", ""),
    ("gpl-2.0", "general gpl gpl2 gplv2 gplv", r"(?:gnu )?general public licen[cs]e" + VERSION + r" 2(?: 0)?" + LATER, r"(?:gnu )?gpl ?v? ?2(?: 0)?", ""),
    ("gpl-3.0", "general gpl gpl3 gplv3 gplv", r"(?:gnu )?general public licen[cs]e" + VERSION + r" 3(?: 0)?" + LATER, r"(?:gnu )?gpl ?v? ?3(?: 0)?", ""),
    ("gpl", "general gpl", r"(?:gnu )?general public licen[cs]e", r"(?:gnu gpl|gpl licen[cs]e)", r"gpl"),
    ("lgpl-2.1", "lesser library lgpl lgpl2 lgplv2 lgplv", r"(?:gnu )?(?:lesser|library) general public licen[cs]e" + VERSION + r" 2(?: [01])?" + LATER, r"(?:gnu )?lgpl ?v? ?2(?: [01])?", ""),
    ("lgpl-3.0", "lesser lgpl lgpl3 lgplv3 lgplv", r"(?:gnu )?lesser general public licen[cs]e" + VERSION + r" 3(?: 0)?" + LATER, r"(?:gnu )?lgpl ?v? ?3(?: 0)?", ""),
    ("lgpl", "lesser lgpl", r"(?:gnu )?lesser general public licen[cs]e", r"(?:gnu lgpl|lgpl licen[cs]e)", r"lgpl"),
    ("agpl-3.0", "affero agpl agpl3 agplv3 agplv", r"(?:gnu )?affero general public licen[cs]e(?:" + VERSION + r" 3(?: 0)?)?" + LATER, r"(?:gnu )?agpl ?v? ?3(?: 0)?", ""),
    ("agpl", "agpl", r"agpl licen[cs]e", r"gnu agpl", r"agpl"),
    ("gfdl", "documentation fdl gfdl", r"(?:gnu )?free documentation licen[cs]e(?:" + VERSION + r" 1 [123])?", r"(?:gnu fdl|gfdl)(?: v?1 [123])?", ""),
    ("mpl-1.1", "mozilla mpl", r"mozilla public licen[cs]e" + VERSION + r" 1 1", r"mpl v?1 1", ""),
    ("mpl-2.0", "mozilla mpl", r"mozilla public licen[cs]e" + VERSION + r" 2(?: 0)?", r"mpl v?2 0", ""),
    ("mpl", "mozilla mpl", r"mozilla public licen[cs]e", "", r"mpl"),
    ("epl-1.0", "eclipse epl", r"eclipse public licen[cs]e" + VERSION + r" 1(?: 0)?", r"epl v?1 0", ""),
    ("epl-2.0", "eclipse epl", r"eclipse public licen[cs]e" + VERSION + r" 2(?: 0)?", r"epl v?2 0", ""),
    ("epl", "eclipse epl", r"eclipse public licen[cs]e", "", r"epl"),
    ("edl-1.0", "eclipse edl", r"eclipse distribution licen[cs]e(?: v?1 0)?", r"edl v?1 0", ""),
    ("cddl-1.0", "cddl development", r"common development and distribution licen[cs]e(?:" + VERSION + r" 1(?: [01])?)?", r"cddl(?: v?1(?: [01])?)?", ""),
    ("cpl-1.0", "common cpl", r"common public licen[cs]e(?:" + VERSION + r" 1 0)?", r"cpl v?1 0", ""),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e(?:" + VERSION + r" 1 0)?", "", ""),
    ("eupl", "european eupl", r"european union public licen[cs]e(?:" + VERSION + r" 1 [012])?", r"eupl(?: v?1 [012])?", ""),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e" + VERSION + r" 2(?: 0)?", r"artistic 2 0", ""),
    ("artistic-1.0", "artistic", r"(?:perl|clarified|original) artistic licen[cs]e(?:" + VERSION + r" 1 0)?", r"artistic licen[cs]e" + VERSION + r" 1 0", r"artistic licen[cs]e"),
    ("boost-1.0", "boost bsl", r"boost software licen[cs]e(?:" + VERSION + r" 1 0)?", r"bsl v?1 0", r"boost"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense org", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl" + VERSION + r" 2", r"wtfpl", ""),
    ("cc0-1.0", "cc0 commons", r"cc0 1 0(?: universal)?|creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?", r"cc0", ""),
    ("cc-by-4.0", "cc", r"cc by (?:v ?)?4(?: 0)?", "", ""),
    ("cc-by-3.0", "cc", r"cc by (?:v ?)?3(?: 0)?", "", ""),
    ("cc-by-2.0", "cc", r"cc by (?:v ?)?2 [05]", "", ""),
    ("cc-by-sa-4.0", "cc", r"cc by sa (?:v ?)?4(?: 0)?", "", ""),
    ("cc-by-sa-3.0", "cc", r"cc by sa (?:v ?)?3(?: 0)?", "", ""),
    ("cc-by-sa", "cc", r"cc by sa", "", ""),
    ("cc-by-nc-4.0", "cc", r"cc by nc (?:v ?)?4(?: 0)?", "", ""),
    ("cc-by-nc-3.0", "cc", r"cc by nc (?:v ?)?3(?: 0)?", "", ""),
    ("cc-by-nc", "cc", r"cc by nc", "", ""),
    ("cc-by-nd-4.0", "cc", r"cc by nd (?:v ?)?4(?: 0)?", "", ""),
    ("cc-by-nd", "cc", r"cc by nd", "", ""),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa (?:v ?)?4(?: 0)?", "", ""),
    ("cc-by-nc-sa", "cc", r"cc by nc sa", "", ""),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd (?:v ?)?4(?: 0)?", "", ""),
    ("cc-by-nc-nd", "cc", r"cc by nc nd", "", ""),
    ("cc-by", "commons", r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?", "", ""),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?", "", ""),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?", "", ""),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?", "", ""),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?", "", ""),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?", "", ""),
    ("odbl-1.0", "database odbl", r"open (?:data commons )?database licen[cs]e(?: odbl)?", r"odbl(?: v?1 0)?", ""),
    ("odc-by-1.0", "commons odc", r"open data commons attribution licen[cs]e", r"odc by(?: v?1 0)?", ""),
    ("pddl-1.0", "domain pddl", r"public domain dedication and licen[cs]e", r"pddl(?: v?1 0)?", ""),
    ("public-domain", "domain", r"(?:dedicated to|placed in|released into) the public domain", r"(?:in|into) the public domain", r"public domain"),
    ("ofl-1.1", "font ofl", r"(?:sil )?open font licen[cs]e(?:" + VERSION + r" 1 1)?", r"(?:sil )?ofl(?: v?1 1)?", ""),
    ("psf-2.0", "python psf", r"python software foundation licen[cs]e(?:" + VERSION + r" 2)?", r"psf licen[cs]e(?: v?2)?", ""),
    ("php-3.0", "php", r"php licen[cs]e(?:" + VERSION + r" 3 0?1?)?", "", ""),
    ("ruby", "ruby", r"ruby licen[cs]e", "", r"ruby s licen[cs]e"),
    ("ms-pl", "microsoft ms", r"microsoft public licen[cs]e", r"ms pl licen[cs]e", r"ms pl"),
    ("ms-rl", "microsoft ms", r"microsoft reciprocal licen[cs]e", r"ms rl licen[cs]e", r"ms rl"),
    ("bsl-1.1", "business busl", r"business source licen[cs]e(?: 1 1)?", r"busl v?1 1", ""),
    ("sspl-1.0", "server sspl", r"server side public licen[cs]e(?:" + VERSION + r" 1)?", r"sspl(?: v?1)?", ""),
    ("elastic-2.0", "elastic elv2", r"elastic licen[cs]e(?: v?2(?: 0)?)?", r"elv2", ""),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[cs]e", "", ""),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", "", ""),
    ("osl-3.0", "open osl", r"open software licen[cs]e(?:" + VERSION + r" 3 0)?", r"osl v?3 0", ""),
    ("afl-3.0", "academic afl", r"academic free licen[cs]e(?:" + VERSION + r" 3 0)?", r"afl v?3 0", ""),
    ("nasa-1.3", "nasa nosa", r"nasa open source agreement(?: 1 3)?", r"nosa v?1 3", ""),
    ("ncsa", "ncsa uiuc", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", r"uiuc licen[cs]e", ""),
    ("cecill-2.1", "cecill", r"cecill (?:free software )?licen[cs]e(?:" + VERSION + r" 2(?: 1)?)?", r"cecill 2 1", r"cecill"),
    ("lppl-1.3c", "latex lppl", r"latex project public licen[cs]e(?:" + VERSION + r" 1 3c?)?", r"lppl v?1 3c?", r"lppl"),
    ("vim", "vim", r"vim licen[cs]e", "", ""),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "", ""),
    ("mulan-2.0", "mulan mulanpsl", r"mulan (?:permissive software|psl) licen[cs]e(?: v?2)?", r"mulanpsl 2 0", ""),
    ("upl-1.0", "universal upl", r"universal permissive licen[cs]e(?: v?1 0)?", r"upl 1 0", ""),
    ("blueoak-1.0.0", "oak blueoak", r"blue oak model licen[cs]e(?: 1 0 0)?", r"blueoak 1 0 0", ""),
    ("llama", "llama", r"llama (?:2|3|3 1) community licen[cs]e(?: agreement)?", "", ""),
)
#: (label, identifier in words): what may follow the tag of a machine-readable licence line.
IDENTIFIERS = (
    ("0bsd", "0bsd"), ("afl-3.0", "afl 3 0"), ("agpl-3.0", "agpl 3 0"), ("agpl-3.0", "agpl 3 0 only"), ("agpl-3.0", "agpl 3 0 or later"), ("apache-1.1", "apache 1 1"), ("apache-2.0", "apache 2 0"),
    ("artistic-1.0", "artistic 1 0"), ("artistic-2.0", "artistic 2 0"), ("blueoak-1.0.0", "blueoak 1 0 0"), ("boost-1.0", "bsl 1 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause"), ("bsl-1.1", "busl 1 1"), ("cc-by-3.0", "cc by 3 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"), ("cc-by-nd-4.0", "cc by nd 4 0"), ("cc-by-sa-3.0", "cc by sa 3 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("cc0-1.0", "cc0 1 0"), ("cddl-1.0", "cddl 1 0"),
    ("cecill-2.1", "cecill 2 1"), ("cpl-1.0", "cpl 1 0"), ("elastic-2.0", "elastic 2 0"), ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"), ("eupl", "eupl 1 1"), ("eupl", "eupl 1 2"),
    ("gfdl", "gfdl 1 3"), ("gpl-1.0", "gpl 1 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-2.0", "gpl 2 0 only"), ("gpl-2.0", "gpl 2 0 or later"), ("gpl-3.0", "gpl 3 0"), ("gpl-3.0", "gpl 3 0 only"),
    ("gpl-3.0", "gpl 3 0 or later"), ("isc", "isc"), ("lgpl-2.1", "lgpl 2 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-2.1", "lgpl 2 1 or later"), ("lgpl-3.0", "lgpl 3 0"), ("lgpl-3.0", "lgpl 3 0 or later"),
    ("lppl-1.3c", "lppl 1 3c"), ("mit", "mit"), ("mit-0", "mit 0"), ("mpl-1.1", "mpl 1 1"), ("mpl-2.0", "mpl 2 0"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("mulan-2.0", "mulanpsl 2 0"), ("ncsa", "ncsa"),
    ("odbl-1.0", "odbl 1 0"), ("odc-by-1.0", "odc by 1 0"), ("ofl-1.1", "ofl 1 1"), ("openssl", "openssl"), ("osl-3.0", "osl 3 0"), ("pddl-1.0", "pddl 1 0"), ("php-3.0", "php 3 01"), ("postgresql", "postgresql"),
    ("psf-2.0", "psf 2 0"), ("ruby", "ruby"), ("sspl-1.0", "sspl 1 0"), ("unlicense", "unlicense"), ("upl-1.0", "upl 1 0"), ("vim", "vim"), ("wtfpl", "wtfpl"), ("x11", "x11"), ("zlib", "zlib"),
)
#: (label, priority, keywords, expression): sentences of licence texts, notices and restrictions.
NOTICES = (
    ("reserved", 2, "reserved", r"all rights (?:are )?(?:strictly )?reserved(?: worldwide)?"),
    ("reserved", 1, "reserved", r"(?:some|no) rights reserved"),
    ("reserved", 1, "written", r"without (?:the )?(?:express |prior )?written (?:permission|consent)"),
    ("reserved", 1, "reproduction", r"reproduction in whole or in part"),
    ("cc-by", 2, "cc", r"cc by"),
    ("copyright", 1, "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)?\d\d)*"),
    ("copyright", 1, "copyright", r"(?:protected|covered) by (?:international )?copyright(?: law)?"),
    ("copyright", 1, "copyrighted", r"copyrighted (?:material|work|content)"),
    ("apache-2.0", 2, "contributor", r"licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-2.0", 2, "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", 1, "applicable", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("mit", 2, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 2, "substantial", r"shall be included in all copies or substantial portions of the software"),
    ("isc", 2, "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 2, "permission", r"permission to use copy modify and distribute this software(?: and its documentation)? for any purpose"),
    ("bsd", 2, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 2, "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd-3-clause", 2, "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 2, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", 2, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 2, "altered", r"altered source versions must be plainly marked as such"),
    ("no-warranty", 1, "warranty", r"this software is provided as is without any express or implied warranty"),
    ("no-warranty", 1, "warranty", r"without (?:any )?warranty of any kind"),
    ("no-warranty", 1, "merchantability", r"(?:implied )?warrant(?:y|ies) of merchantability"),
    ("gpl", 2, "redistribute", r"you can redistribute it and or modify it under the terms of"),
    ("gpl", 2, "gnu", r"see the gnu general public licen[cs]e for more details"),
    ("gpl", 2, "gnu", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", 2, "gnu", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl-3.0", 2, "gnu", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl-2.0", 2, "either", r"either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3.0", 2, "either", r"either version 3 of the licen[cs]e or at your option any later version"),
    ("lgpl-2.1", 2, "either", r"either version 2 1 of the licen[cs]e or at your option any later version"),
    ("mpl-2.0", 2, "source", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-2.0", 2, "mpl", r"if a copy of the mpl was not distributed with this file"),
    ("unlicense", 2, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", 2, "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", 2, "commons", r"this work is licensed under a creative commons"),
    ("ofl-1.1", 2, "font", r"this font software is licensed under the sil open font licen[cs]e"),
    ("openssl", 2, "openssl", r"this product includes software developed by the openssl project"),
    ("proprietary", 2, "proprietary", r"proprietary and confidential"),
    ("proprietary", 1, "confidential", r"(?:strictly|company) confidential"),
    ("proprietary", 1, "trade", r"(?:contains|constitutes) trade secrets"),
    ("proprietary", 2, "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)(?: \w+){0,6} prohibited"),
    ("non-commercial", 1, "commercial", r"(?:for )?non commercial use only|not for commercial use"),
    ("personal-use", 1, "personal", r"for personal use only"),
    ("research-only", 1, "research", r"for (?:academic )?research (?:purposes|use) only"),
    ("no-training", 2, "train training", r"(?:may|must|shall) not be used (?:to train|for training)"),
    ("evaluation", 1, "evaluation", r"for evaluation (?:purposes )?only"),
    ("reference", 1, "spdx", r"spdx licen[cs]e identifier(?: \w+){1,4}"),
    ("reference", 1, "license licence", r"see (?:the )?licen[cs]e(?: file| txt| md)?(?: for (?:more )?(?:details|information))?"),
    ("reference", 1, "license licence", r"licen[cs]e (?:agreement|file|terms|text)"),
    ("trademark", 1, "trademark trademarks", r"(?:a )?registered trademarks? of"),
)


def rules() -> list[tuple[str, int, str, str, str]]:
    """(label, priority, keywords, expression, kind), in order: of each family the names in a grant (4), the full name (3) and the short one (2); then identifiers after their tag (4), then notices."""
    out = []
    for label, key, full, short, bare in FAMILIES:
        any_name = "|".join(f"(?:{n})" for n in (full, short) if n)
        grant = rf"{GRANT} {TERMS}(?:{any_name})" + (rf"|{UNDER} {TERMS}(?:{bare})(?: licen[cs]e)?" if bare else "")
        out.append((label, 4, key, grant, "grant"))
        out += [(label, p, key, name, kind) for p, name, kind in ((3, full, "name"), (2, short, "short")) if name]
    out += [(label, 4, "spdx", rf"spdx licen[cs]e identifier {words}", "identifier") for label, words in IDENTIFIERS]
    return out + [(*n, "notice") for n in NOTICES]


#: How sure a detection of each priority is.
SURE = {4: 0.99, 3: 0.9, 2: 0.75, 1: 0.5}


def _rule_table() -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("n"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.array(*[F.lit(k) for k in key.split(" ")]).alias("keys"), F.lit(rf"(?<= )(?:{rx})(?= )").alias("rx"))
        for i, (label, p, key, rx, _) in enumerate(rules())
    ])


def _found(norm: Column, rule: Column) -> Column:
    """array<struct(start, stop, priority, n, label)>: every match of one rule, placed by the lengths of matches and of what lies between."""
    hits = F.regexp_extract_all(norm, rule["rx"], F.lit(0))
    gaps = F.split(norm, rule["rx"], F.lit(-1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,priority:int,n:int,label:string>>").alias("got"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.char_length(pair["gap"])
        to = at + F.char_length(pair["hit"])
        one = F.struct(at.alias("start"), to.alias("stop"), rule["priority"].alias("priority"), rule["n"].alias("n"), rule["label"].alias("label"))
        return F.struct(to.alias("at"), F.concat(acc["got"], F.array(one)).alias("got"))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["got"])


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, _words, and found: the detections that stay, as array<struct(start, stop, priority, n, label)> over the normalised text."""
    keys = sorted({k for _, _, ks, _, _ in rules() for k in ks.split(" ")})
    rows = docs.select("doc_id", words_col(F.col("text")).alias("_words"))
    rows = rows.withColumn("_keys", F.array_intersect("_words", F.array(*map(F.lit, keys))))  # found in one pass over the words
    rows = rows.withColumn("_norm", F.when(F.size("_keys") > 0, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))))
    tried = F.filter(_rule_table(), lambda r: F.arrays_overlap(r["keys"], F.col("_keys")))
    every = F.flatten(F.transform(tried, lambda r: _found(F.col("_norm"), r)))
    none = F.array().cast("array<struct<start:int,stop:int,priority:int,n:int,label:string>>")
    rows = rows.withColumn("_all", F.when(F.col("_norm").isNotNull(), every).otherwise(none))
    # In order of start, longest and strongest first, a span lies inside an earlier one if that one's end reaches its own.
    rank = F.array_sort(F.transform("_all", lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), (-d["priority"]).alias("weak"), d["n"].alias("n"), d["label"].alias("label"))))
    begin = F.struct(*[F.lit(-1).alias(f"e{p}") for p in (1, 2, 3, 4)], none.alias("kept"))

    def keep(acc: Column, d: Column) -> Column:
        stop, priority = -d["back"], -d["weak"]
        inside = F.lit(False)
        for p in (1, 2, 3, 4):  # reached by an equal or higher priority, or by a name or grant in full
            inside = inside | ((acc[f"e{p}"] >= stop) & ((F.lit(p) >= priority) | F.lit(p >= 3)))
        one = F.array(F.struct(d["start"].alias("start"), stop.alias("stop"), priority.alias("priority"), d["n"].alias("n"), d["label"].alias("label")))
        ends = [F.when(~inside & (priority == p), F.greatest(acc[f"e{p}"], stop)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3, 4)]
        return F.struct(*ends, F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], one)).alias("kept"))

    return rows.withColumn("found", F.aggregate(rank, begin, keep, lambda acc: acc["kept"])).drop("_all", "_keys")


def _places(words: list[str], label: str) -> Column:
    """array<struct(i, label)>: the word places where a phrase starts; texts that don't hold it are not walked."""
    none = F.array().cast("array<struct<i:int,label:string>>")

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, w in enumerate(words):
            same = same & (F.coalesce(F.get("_words", i + k), F.lit("")) == w)
        return same

    def place(i: Column) -> Column:
        return F.struct(i.alias("i"), F.lit(label).alias("label"))

    at = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), here)
    return F.when(F.contains("_norm", F.lit(" " + " ".join(words) + " ")), F.transform(at, place)).otherwise(none)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each document: words, base phrase places, base and all labels, score (the surest detection, base phrases counting 0.75)."""
    rows = detections(docs)
    rows = rows.withColumn("_base", F.concat(*[_places(phrase.split(" "), label) for phrase, label in PHRASES]))
    base = F.transform("_base", lambda b: b["label"])
    sure = F.array(*[F.lit(SURE[p]) for p in (1, 2, 3, 4)])
    weights = F.concat(F.transform("found", lambda d: F.get(sure, d["priority"] - 1)), F.when(F.size("_base") > 0, F.array(F.lit(SURE[2]))).otherwise(F.array().cast("array<double>")))
    return rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda b: b["i"])).cast("long").alias("first_word"), F.array_max(F.transform("_base", lambda b: b["i"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("found", lambda d: d["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"), F.size("found").cast("long").alias("n_found"),
    )
