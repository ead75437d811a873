"""Signature rules for licenses, over texts of lower-case words with one space between them.

Each license is written down once: an id, keywords of which a text with it has one, and patterns of its name, its
SPDX tag and its addresses. The rules are made of these, four kinds for a license, in order of priority.
"""

from __future__ import annotations

import re

#: Id | keywords | name | SPDX tag | address. Separators of the source are spaces here: 2.0 is "2 0".
LICENSES = r"""
gpl-1.0 | general public license/gpl | (gnu )?(general public license|gpl) (version |v )?v?1( 0)? | gpl 1 0( only| or later)? | gnu org licenses (old licenses )?gpl 1 0
gpl-2.0 | general public license/gpl | (gnu )?general public license,? (as published by the free software foundation (either )?)?(version |v )v?2( 0)? | gpl 2 0( only| or later)? | gnu org licenses (old licenses )?gpl 2 0
gpl-3.0 | general public license/gpl | (gnu )?general public license (as published by the free software foundation (either )?)?(version |v )v?3( 0)? | gpl 3 0( only| or later)? | gnu org licenses gpl 3 0
gpl-2.0-short | gpl | gpl ?(version |v )?v?2( 0)? licen[sc]ed? | gpl 2 | opensource org licenses gpl 2 0
gpl-3.0-short | gpl | gpl ?(version |v )?v?3( 0)? licen[sc]ed? | gpl 3 | opensource org licenses gpl 3 0
lgpl-2.0 | general public license | (gnu )?(library|lesser) general public license (version |v )v?2( 0)? | lgpl 2 0( only| or later)? | gnu org licenses (old licenses )?lgpl 2 0
lgpl-2.1 | lesser general public license | (gnu )?lesser general public license (version |v )v?2 1 | lgpl 2 1( only| or later)? | gnu org licenses (old licenses )?lgpl 2 1
lgpl-3.0 | lesser general public license | (gnu )?lesser general public license (version |v )v?3( 0)? | lgpl 3 0( only| or later)? | gnu org licenses lgpl 3 0
lgpl | lesser general public license | (gnu )?lesser general public license | lgpl | gnu org (copyleft|licenses) lesser
agpl-3.0 | affero general public license | (gnu )?affero general public license (version |v )v?3( 0)? | agpl 3 0( only| or later)? | gnu org licenses agpl 3 0
agpl | affero general public license | (gnu )?affero general public license | agpl | gnu org licenses agpl
gfdl-1.1 | free documentation license | (gnu )?free documentation license (version |v )v?1 1 | gfdl 1 1( only| or later)? | gnu org licenses (old licenses )?fdl 1 1
gfdl-1.2 | free documentation license | (gnu )?free documentation license (version |v )v?1 2 | gfdl 1 2( only| or later)? | gnu org licenses (old licenses )?fdl 1 2
gfdl-1.3 | free documentation license | (gnu )?free documentation license (version |v )v?1 3 | gfdl 1 3( only| or later)? | gnu org licenses fdl 1 3
apache-1.0 | apache | apache (software )?license (version |v )?v?1 0 | apache 1 0 | apache org licenses license 1 0
apache-1.1 | apache | apache (software )?license (version |v )?v?1 1 | apache 1 1 | apache org licenses license 1 1
apache-2.0 | apache | apache (software )?license (version |v )?v?2( 0)? | apache 2 0 | apache org licenses license 2 0
mit | mit | (the )?mit license( mit)? | mit | opensource org licenses mit
mit-0 | mit | mit no attribution( license)? | mit 0 | opensource org licenses mit 0
mit-text | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software | mit text | mit license org
x11 | x11 | x11 license | x11 | x org license
isc | isc | isc license( isc)? | isc | opensource org licenses isc
isc-text | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose | isc text | isc org licenses
bsd-2-clause | clause | (simplified )?bsd 2 clause( simplified)?( license)? | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | clause | (new |revised )?bsd 3 clause( new| revised)?( license)? | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | clause | (original )?bsd 4 clause( original)?( license)? | bsd 4 clause | directory fsf org wiki license bsd 4clause
bsd-0-clause | clause | (zero clause bsd|bsd zero clause|0 clause bsd)( license)? | 0bsd | opensource org licenses 0bsd
bsd-text | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted | bsd text | opensource org licenses bsd license
bsd | bsd | (modified |simplified |new |revised |original )?bsd (style )?license | bsd | linfo org bsdlicense
mpl-1.0 | mozilla public license | mozilla public license (version |v )?v?1 0 | mpl 1 0 | mozilla org mpl 1 0
mpl-1.1 | mozilla public license | mozilla public license (version |v )?v?1 1 | mpl 1 1 | mozilla org mpl 1 1
mpl-2.0 | mozilla public license | mozilla public license (version |v )?v?2 0 | mpl 2 0 | mozilla org mpl 2 0
epl-1.0 | eclipse public license | eclipse public license (version |v )?v?1( 0)? | epl 1 0 | eclipse org legal epl v10
epl-2.0 | eclipse public license | eclipse public license (version |v )?v?2( 0)? | epl 2 0 | eclipse org legal epl 2 0
edl-1.0 | eclipse distribution license | eclipse distribution license (version |v )?v?1( 0)? | edl 1 0 | eclipse org org documents edl v10
cddl-1.0 | common development and distribution license | common development and distribution license (version |v )?v?1 0 | cddl 1 0 | opensource org licenses cddl 1 0
cddl-1.1 | common development and distribution license | common development and distribution license (version |v )?v?1 1 | cddl 1 1 | glassfish java net public cddl
cpl-1.0 | common public license | common public license (version |v )?v?1( 0)? | cpl 1 0 | opensource org licenses cpl1 0
cpal-1.0 | common public attribution license | common public attribution license (version |v )?v?1( 0)? | cpal 1 0 | opensource org licenses cpal 1 0
eupl-1.1 | european union public licen | european union public licen[cs]e (version |v )?v?1 1 | eupl 1 1 | joinup ec europa eu eupl 1 1
eupl-1.2 | european union public licen | european union public licen[cs]e (version |v )?v?1 2 | eupl 1 2 | joinup ec europa eu eupl 1 2
artistic-1.0 | artistic license | artistic license (version |v )?v?1( 0)? | artistic 1 0 | opensource org licenses artistic license 1 0
artistic-2.0 | artistic license | artistic license (version |v )?v?2( 0)? | artistic 2 0 | opensource org licenses artistic license 2 0
bsl-1.0 | boost software license | boost software license (version |v )?v?1 0 | bsl 1 0 | boost org license 1 0
busl-1.1 | business source license | business source license (version |v )?v?1 1 | busl 1 1 | mariadb com bsl11
zlib | zlib | zlib( libpng)? license | zlib | zlib net zlib license
libpng | libpng/png reference library | (png reference library|libpng) license | libpng 2 0 | libpng org pub png src libpng license
unlicense | unlicense | (the )?unlicense( license)? | unlicense | unlicense org
unlicense-text | free and unencumbered software | free and unencumbered software released into the public domain | unlicense text | choosealicense com licenses unlicense
wtfpl | what the | do what the \w+ you want to public license | wtfpl | wtfpl net
cc0-1.0 | cc0 | (creative commons )?cc0( 1 0)?( universal)?( public domain dedication)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
public-domain | public domain | (released into|in|dedicated to|placed in) the public domain | pddl 1 0 | creativecommons org licenses publicdomain
cc-by-1.0 | cc by/creative commons attribution | (creative commons attribution|cc by) 1 0( generic)?( license)? | cc by 1 0 | creativecommons org licenses by 1 0
cc-by-2.0 | cc by/creative commons attribution | (creative commons attribution|cc by) 2 0( generic)?( license)? | cc by 2 0 | creativecommons org licenses by 2 0
cc-by-2.5 | cc by/creative commons attribution | (creative commons attribution|cc by) 2 5( generic)?( license)? | cc by 2 5 | creativecommons org licenses by 2 5
cc-by-3.0 | cc by/creative commons attribution | (creative commons attribution|cc by) 3 0( unported)?( license)? | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-4.0 | cc by/creative commons attribution | (creative commons attribution|cc by) 4 0( international)?( public license| license)? | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-sa-2.0 | cc by sa/creative commons attribution | (creative commons attribution share ?alike|cc by sa) 2 0 | cc by sa 2 0 | creativecommons org licenses by sa 2 0
cc-by-sa-3.0 | cc by sa/creative commons attribution | (creative commons attribution share ?alike|cc by sa) 3 0 | cc by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | cc by sa/creative commons attribution | (creative commons attribution share ?alike|cc by sa) 4 0 | cc by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-nc-3.0 | cc by nc/creative commons attribution | (creative commons attribution non ?commercial|cc by nc) 3 0 | cc by nc 3 0 | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | cc by nc/creative commons attribution | (creative commons attribution non ?commercial|cc by nc) 4 0 | cc by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nd-3.0 | cc by nd/creative commons attribution | (creative commons attribution no ?deriv(ative)?s|cc by nd) 3 0 | cc by nd 3 0 | creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | cc by nd/creative commons attribution | (creative commons attribution no ?deriv(ative)?s|cc by nd) 4 0 | cc by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0 | cc by nc sa/creative commons attribution | (creative commons attribution non ?commercial share ?alike|cc by nc sa) 3 0 | cc by nc sa 3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | cc by nc sa/creative commons attribution | (creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0 | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | cc by nc nd/creative commons attribution | (creative commons attribution non ?commercial no ?deriv(ative)?s|cc by nc nd) 4 0 | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
odbl-1.0 | open database license | (odc |open data commons )?open database license( odbl)?( v1 0| 1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1.0 | open data commons attribution | open data commons attribution license( v1 0| 1 0)? | odc by 1 0 | opendatacommons org licenses by
ofl-1.1 | open font license | (sil )?open font license (version |v )?v?1 1 | ofl 1 1 | scripts sil org ofl
psf-2.0 | python software foundation license | python software foundation license (version |v )?v?2 | psf 2 0 | docs python org license
postgresql | postgresql licen | postgresql licen[cs]e | postgresql | opensource org licenses postgresql
php-3.01 | php license | php license (version |v )?v?3 01 | php 3 01 | php net license 3 01
ruby | ruby license | ruby license | ruby | ruby lang org license
openssl | openssl license | openssl license | openssl | openssl org source license
ncsa | illinois | university of illinois ncsa open source license | ncsa | otm illinois edu uiuc openotm
ms-pl | microsoft public license | microsoft public license( ms pl)? | ms pl | opensource org licenses ms pl
ms-rl | microsoft reciprocal license | microsoft reciprocal license( ms rl)? | ms rl | opensource org licenses ms rl
sspl-1.0 | server side public license | server side public license (version |v )?v?1( 0)? | sspl 1 0 | mongodb com licensing server side public license
elastic-2.0 | elastic license | elastic license (version |v )?v?2( 0)? | elastic 2 0 | elastic co licensing elastic license
all-rights-reserved | all rights reserved | copyright .{0,80} all rights reserved | all rights reserved | copyright gov title17
"""

#: (priority, weight) by kind of rule: SPDX tag, a grant that names the license, its name, its address.
KINDS = {"tag": (1, 0.99), "grant": (2, 0.95), "name": (3, 0.8), "address": (4, 0.6)}

_GRANT = r"(licen[sc]ed|released|distributed|available|provided|published|redistribute it( and or modify it)?) (under|by) (the terms of )?(either )?(the )?"

#: Every text that a rule's pattern matches has one of these, in the source's letters; [S] is a separator. A test goes
#: through all alternatives of all patterns.
ANCHORS = (
    "licen[sc]", "spdx", "creative[S]*commons", "cc[S]+by", "cc0", "public[S]+domain", "copyright", "gpl", r"permission[S]+", "redistribution[S]+", "unencumbered", "bsd[S]+[0-9]", "[0-9][S]+clause",
    "zero[S]+clause", "mit[S]+no[S]+attribution", "gnu[S]+org", "mozilla[S]+org", "eclipse[S]+org", "glassfish[S]+java", "joinup[S]+ec", "mariadb[S]+com", "wtfpl", "scripts[S]+sil", "otm[S]+illinois",
)


def rules() -> list[tuple[int, str, list[str], str, float]]:
    """(priority, label, keywords, pattern, weight) in order: each text that the pattern is tried on has one of the keywords."""
    out = []
    for line in LICENSES.strip().splitlines():
        label, keywords, name, tag, address = (x.strip() for x in line.split(" | "))
        label, words = label.removesuffix("-short").removesuffix("-text"), keywords.split("/")
        kinds = {
            "tag": (["spdx license identifier"], f"spdx license identifier ({tag})"),
            "grant": (words, f"{_GRANT}({name})"),
            "name": (words, f"({name})"),
            "address": ([re.split(r"[(?]", address)[0].rsplit(" ", 1)[0]], f"({address})"),
        }
        out += [(KINDS[k][0], label, w, f"(?<= ){pattern}(?= )", KINDS[k][1]) for k, (w, pattern) in kinds.items()]
    return sorted(out, key=lambda r: r[0])
