"""Signature rules for licences, written for words in lower case joined by single blanks.

``LICENSES`` names a licence: label, a word of every title, the title as an expression, and its SPDX
identifier in words. ``BODIES`` are sentences of licence texts. Each licence gives three rules, in
falling priority: identifier tag, grant ("released under ...") and title; bodies stand between tag and
grant. Optional trailing parts (versions) make the longest reading the one that is found.
"""

from __future__ import annotations

from dataclasses import dataclass

TAG, BODY, GRANT, TITLE, HINT = range(5)
CONFIDENCE = (1.0, 0.95, 0.9, 0.8, 0.4)

_V1, _V2, _V3 = r"(?: version| v)? ?v?1(?: 0)?", r"(?: version| v)? ?v?2(?: 0)?", r"(?: version| v)? ?v?3(?: 0)?"
_LATER = r"(?: or (?:\(?at your option\)? )?(?:any )?later(?: version)?)?"

LICENSES = (
    ("mit", "mit", r"(?:the )?mit license", "mit"),
    ("mit-0", "mit", r"mit no attribution(?: license)?", "mit 0"),
    ("x11", "x11", r"(?:the )?x11 license", "x11"),
    ("expat", "expat", r"(?:the )?expat license", "expat"),
    ("apache", "apache", r"(?:the )?apache(?: software)? license", "apache"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)? license(?: version| v)? 1 1", "apache 1 1"),
    ("apache-2.0", "apache", rf"(?:the )?apache(?: software)? license{_V2}", "apache 2 0"),
    ("gpl", "general public", r"(?:the )?(?:gnu )?general public license", "gpl"),
    ("gpl-1.0", "general public", rf"(?:the )?(?:gnu )?general public license{_V1}{_LATER}", "gpl 1 0"),
    ("gpl-2.0", "general public", rf"(?:the )?(?:gnu )?general public license{_V2}{_LATER}", "gpl 2 0"),
    ("gpl-3.0", "general public", rf"(?:the )?(?:gnu )?general public license{_V3}{_LATER}", "gpl 3 0"),
    ("lgpl", "lesser general", r"(?:the )?(?:gnu )?lesser general public license", "lgpl"),
    ("lgpl-2.0", "library general", rf"(?:the )?(?:gnu )?library general public license(?:{_V2})?{_LATER}", "lgpl 2 0"),
    ("lgpl-2.1", "lesser general", rf"(?:the )?(?:gnu )?lesser general public license(?: version| v)? 2 1{_LATER}", "lgpl 2 1"),
    ("lgpl-3.0", "lesser general", rf"(?:the )?(?:gnu )?lesser general public license{_V3}{_LATER}", "lgpl 3 0"),
    ("agpl", "affero", r"(?:the )?(?:gnu )?affero general public license", "agpl"),
    ("agpl-3.0", "affero", rf"(?:the )?(?:gnu )?affero general public license{_V3}{_LATER}", "agpl 3 0"),
    ("gfdl", "free documentation", r"(?:the )?(?:gnu )?free documentation license(?:(?: version| v)? 1 [123])?", "gfdl 1 3"),
    ("bsd", "bsd", r"(?:the )?bsd license", "bsd"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: license)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)(?: license)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:4 clause bsd|bsd 4 clause|original bsd)(?: license)?", "bsd 4 clause"),
    ("0bsd", "bsd", r"(?:the )?(?:0bsd|zero clause bsd|bsd zero clause)(?: license)?", "0bsd"),
    ("isc", "isc", r"(?:the )?isc license", "isc"),
    ("mpl", "mozilla", r"(?:the )?mozilla public license", "mpl"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public license(?: version| v)? 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", rf"(?:the )?mozilla public license{_V2}", "mpl 2 0"),
    ("epl-1.0", "eclipse", rf"(?:the )?eclipse public license{_V1}", "epl 1 0"),
    ("epl-2.0", "eclipse", rf"(?:the )?eclipse public license(?:{_V2})?", "epl 2 0"),
    ("edl-1.0", "eclipse", rf"(?:the )?eclipse distribution license(?:{_V1})?", "edl 1 0"),
    ("cddl-1.0", "common development", rf"(?:the )?common development and distribution license(?:{_V1})?", "cddl 1 0"),
    ("cpl-1.0", "common public", rf"(?:the )?common public license(?:{_V1})?", "cpl 1 0"),
    ("ipl-1.0", "ibm", rf"(?:the )?ibm public license(?:{_V1})?", "ipl 1 0"),
    ("apsl-2.0", "apple", rf"(?:the )?apple public source license(?:{_V2})?", "apsl 2 0"),
    ("artistic-1.0", "artistic", rf"(?:the )?artistic license{_V1}", "artistic 1 0"),
    ("artistic-2.0", "artistic", rf"(?:the )?artistic license(?:{_V2})?", "artistic 2 0"),
    ("bsl-1.0", "boost", rf"(?:the )?boost software license(?:{_V1})?", "bsl 1 0"),
    ("busl-1.1", "business source", r"(?:the )?business source license(?:(?: version| v)? 1 1)?", "busl 1 1"),
    ("sspl-1.0", "server side", rf"(?:the )?server side public license(?:{_V1})?", "sspl 1 0"),
    ("elastic-2.0", "elastic", rf"(?:the )?elastic license(?:{_V2})?", "elastic 2 0"),
    ("polyform-nc", "polyform", r"(?:the )?polyform noncommercial license(?: 1 0 0)?", "polyform noncommercial 1 0 0"),
    ("commons-clause", "commons clause", r"(?:the )?commons clause(?: license)?", "commons clause"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl(?: license)?", "wtfpl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? license", "zlib"),
    ("libpng", "libpng", r"(?:the )?libpng license", "libpng"),
    ("postgresql", "postgresql", r"(?:the )?postgresql license", "postgresql"),
    ("psf-2.0", "python", rf"(?:the )?python software foundation license(?:{_V2})?", "psf 2 0"),
    ("python-2.0", "python", rf"(?:the )?python license(?:{_V2})?", "python 2 0"),
    ("php-3.01", "php", r"(?:the )?php license(?:(?: version| v)? 3 01)?", "php 3 01"),
    ("ruby", "ruby", r"(?:the )?ruby license", "ruby"),
    ("openssl", "openssl", r"(?:the )?openssl license", "openssl"),
    ("curl", "curl", r"(?:the )?curl license", "curl"),
    ("vim", "vim", r"(?:the )?vim license", "vim"),
    ("tcl", "tcl", r"(?:the )?tcl(?: tk)? license", "tcl"),
    ("qpl-1.0", "q public", rf"(?:the )?q public license(?:{_V1})?", "qpl 1 0"),
    ("lppl-1.3c", "latex", r"(?:the )?latex project public license(?:(?: version| v)? 1 3c?)?", "lppl 1 3c"),
    ("ofl-1.1", "open font", r"(?:the )?(?:sil )?open font license(?:(?: version| v)? 1 1)?", "ofl 1 1"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)? license", "ncsa"),
    ("upl-1.0", "universal permissive", rf"(?:the )?universal permissive license(?:{_V1})?", "upl 1 0"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal license", "ms rl"),
    ("eupl-1.2", "european union", r"(?:the )?european union public licen[cs]e(?:(?: version| v)? 1 [12])?", "eupl 1 2"),
    ("cecill-2.1", "cecill", r"(?:the )?cecill(?: free software)?(?: license)?(?: agreement)?(?: 2 1)?", "cecill 2 1"),
    ("afl-3.0", "academic free", rf"(?:the )?academic free license(?:{_V3})?", "afl 3 0"),
    ("osl-3.0", "open software", rf"(?:the )?open software license(?:{_V3})?", "osl 3 0"),
    ("odbl-1.0", "open database", rf"(?:the )?open (?:data commons open )?database license(?:{_V1})?", "odbl 1 0"),
    ("odc-by-1.0", "open data commons", rf"(?:the )?open data commons attribution license(?:{_V1})?", "odc by 1 0"),
    ("pddl-1.0", "public domain", rf"(?:the )?public domain dedication and license(?:{_V1})?", "pddl 1 0"),
    ("mulan-psl-2.0", "mulan", rf"(?:the )?mulan (?:psl|permissive software license)(?:{_V2})?", "mulanpsl 2 0"),
    ("blueoak-1.0.0", "blue oak", r"(?:the )?blue oak model license(?: 1 0 0)?", "blueoak 1 0 0"),
    ("openrail", "rail", r"(?:the )?(?:creativeml )?open ?rail(?: m| d| s)?(?: license)?", "openrail"),
    ("jrl", "java research", r"(?:the )?java research license", "jrl"),
    ("w3c", "w3c", r"(?:the )?w3c (?:software )?(?:notice and )?license", "w3c"),
    ("cc0-1.0", "cc0", rf"cc0(?: license)?(?:{_V1})?", "cc0 1 0"),
    ("cc-zero", "creative commons zero", rf"(?:the )?creative commons zero(?: license)?(?:{_V1})?", "cc0"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?", "cc by 4 0"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?", "cc by sa 4 0"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?", "cc by nc 4 0"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?", "cc by nd 4 0"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?", "cc by nc nd 4 0"),
    ("cc-by", "creative commons", r"(?:the )?creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: license)?", "cc by 3 0"),
    ("cc-by-sa", "creative commons", r"(?:the )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?", "cc by sa 3 0"),
    ("cc-by-nc", "creative commons", r"(?:the )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: license)?", "cc by nc 3 0"),
    ("cc-by-nd", "creative commons", r"(?:the )?creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: license)?", "cc by nd 3 0"),
    ("cc-by-nc-sa", "creative commons", r"(?:the )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?", "cc by nc sa 3 0"),
    ("cc-by-nc-nd", "creative commons", r"(?:the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: license)?", "cc by nc nd 3 0"),
)

BODIES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache org licenses", r"apache org licenses license 2 0"),
    ("apache-2.0", "without warranties or conditions", r"without warranties or conditions of any kind either express or implied"),
    ("gpl", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "gnu org licenses", r"gnu org licenses gpl(?: [123] 0)?"),
    ("lgpl", "gnu org licenses", r"gnu org licenses lgpl(?: [23] [01])?"),
    ("agpl", "gnu org licenses", r"gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", "gnu org licenses", r"gnu org licenses fdl(?: 1 [123])?"),
    ("mpl-2.0", "source code form is subject", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla org mpl", r"mozilla org mpl 2 0"),
    ("epl-2.0", "eclipse org legal", r"eclipse org legal epl 2 0"),
    ("epl-1.0", "eclipse org legal", r"eclipse org legal epl v10"),
    ("bsl-1.0", "boost org license", r"boost org license 1 0"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to public license"),
    ("zlib", "provided as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license"),
    ("cc-by", "creativecommons org licenses", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org licenses", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons org licenses", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons org licenses", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org licenses", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0-1.0", "creativecommons org publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|in|to|into) the public domain"),
    ("proprietary", "all rights reserved", r"proprietary and confidential(?: all rights reserved)?"),
)

HINTS = (
    ("unknown-license", "license", r"licensed under"),
    ("unknown-license", "license", r"see (?:the )?license (?:file )?for (?:the )?(?:details|terms|conditions)"),
    ("unknown-license", "licence", r"licen[cs]ed under (?:the )?(?:terms of )?(?:a|an|the)? ?licen[cs]e"),
)

# the phrases of the contract: label, words
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

_GRANT = r"(?:licen[cs]ed|released|distributed|available|provided|published|covered|used) (?:only )?under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?(?:gnu )?"
_TAG = r"spdx license identifier "

# every document with a match of any rule has one of these
GATES = ("licen", "public domain", "cc by", "cc0", "creative commons", "creativecommons", "permission", "redistribut", "endorse or promote", "gnu org", "mozilla org mpl", "eclipse org", "wtfpl", "bsd", "cecill", "mulan", "rail", "commons clause", "mit no attribution", "warrant", "public license", "proprietary and confidential")


@dataclass(frozen=True)
class Rule:
    priority: int
    keyword: str
    pattern: str
    label: str
    base: bool = False


def rules() -> list[Rule]:
    """All rules, the phrases of the contract first, then by falling priority."""
    found = [Rule(TITLE, words, words, label, True) for label, words in BASE]
    found += [Rule(TAG, "spdx license identifier " + spdx, _TAG + spdx, label) for label, _, _, spdx in LICENSES]
    found += [Rule(BODY, keyword, pattern, label) for label, keyword, pattern in BODIES]
    found += [Rule(GRANT, keyword, _GRANT + title, label) for label, keyword, title, _ in LICENSES]
    found += [Rule(TITLE, keyword, title, label) for label, keyword, title, _ in LICENSES]
    found += [Rule(HINT, keyword, pattern, label) for label, keyword, pattern in HINTS]
    return found
