"""Signature rules of licence texts, notices, tags and names, in order of priority.

A signature is written word by word. Words are regular expressions without spaces; ``word?`` may be missing,
``..3`` stands for up to three words of any kind. ``compiled`` makes a regular expression of it that both Java
and RE2 read the same way, for texts whose words are put down with a blank on either side.
"""

from __future__ import annotations

from typing import NamedTuple

TEXT, TAG, NOTICE, NAME, MENTION, BASE = range(6)  # classes; a lower one wins
WEIGHT = (1.0, 0.95, 0.9, 0.75, 0.5, 0.5)          # how sure a detection of the class is


class Rule(NamedTuple):
    level: int
    label: str
    keyword: str  # a word that every match holds
    pattern: str


#: the three phrases of the base and their labels
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_GNU, _CC, _V = "gnu? ", "creative commons ", "version|v? "
#: label; identifiers, as words; names; places on the net
FAMILIES = [
    ("apache-2.0", ["apache 2 0"], ["apache software? license|licence version|v? 2(?:0)? 0?", "apache 2 0? license|licence?", "asl 2 0"], ["apache org licenses license 2 0"]),
    ("apache-1.1", ["apache 1 1"], ["apache software? license|licence version|v? 1 1"], ["apache org licenses license 1 1"]),
    ("apache", [], ["apache software? license|licence"], ["apache org licenses"]),
    ("mit", ["mit", "mit 0"], ["mit license|licence", "mit expat license|licence", "expat license|licence"], ["opensource org licenses? mit", "mit license org"]),
    ("x11", ["x11"], ["x11 license|licence", "mit x11 license|licence?"], []),
    ("isc", ["isc"], ["isc license|licence"], ["opensource org licenses? isc"]),
    ("bsd-2-clause", ["bsd 2 clause", "bsd 2 clause patent"], ["bsd 2|two clause license|licence?", "2|two clause bsd license|licence?", "simplified bsd license|licence", "freebsd license|licence"], ["opensource org licenses? bsd 2 clause"]),
    ("bsd-3-clause", ["bsd 3 clause", "bsd 3 clause clear"], ["bsd 3|three clause license|licence?", "3|three clause bsd license|licence?", "new|modified|revised bsd license|licence"], ["opensource org licenses? bsd 3 clause"]),
    ("bsd-4-clause", ["bsd 4 clause"], ["bsd 4|four clause license|licence?", "4|four clause bsd license|licence?", "original bsd license|licence"], []),
    ("0bsd", ["0bsd"], ["zero clause bsd license|licence?", "0bsd license|licence"], []),
    ("bsd", [], ["bsd license|licence", "bsd style license|licence"], []),
    ("gpl-1.0", ["gpl 1 0 only?", "gpl 1 0 or later"], [_GNU + "general public license|licence " + _V + "1 0?"], ["gnu org licenses gpl 1 0"]),
    ("gpl-2.0", ["gpl 2 0 only?", "gpl 2 0 or later"], [_GNU + "general public license|licence " + _V + "2 0?", _GNU + "gpl " + _V + "2 0?", "gnu? gplv2"], ["gnu org licenses old licenses gpl 2 0"]),
    ("gpl-3.0", ["gpl 3 0 only?", "gpl 3 0 or later"], [_GNU + "general public license|licence " + _V + "3 0?", _GNU + "gpl " + _V + "3 0?", "gnu? gplv3"], ["gnu org licenses gpl 3 0"]),
    ("gpl", [], ["gnu general public license|licence", "gnu gpl"], ["gnu org licenses gpl", "gnu org copyleft gpl"]),
    ("lgpl-2.0", ["lgpl 2 0 only?", "lgpl 2 0 or later"], [_GNU + "library general public license|licence " + _V + "2? 0?"], ["gnu org licenses old licenses lgpl 2 0"]),
    ("lgpl-2.1", ["lgpl 2 1 only?", "lgpl 2 1 or later"], [_GNU + "lesser general public license|licence " + _V + "2 1", _GNU + "lgpl " + _V + "2 1", "gnu? lgplv2 1?"], ["gnu org licenses old licenses lgpl 2 1"]),
    ("lgpl-3.0", ["lgpl 3 0 only?", "lgpl 3 0 or later"], [_GNU + "lesser general public license|licence " + _V + "3 0?", _GNU + "lgpl " + _V + "3 0?", "gnu? lgplv3"], ["gnu org licenses lgpl 3 0"]),
    ("lgpl", [], [_GNU + "lesser general public license|licence", "gnu lgpl"], ["gnu org licenses lgpl", "gnu org copyleft lesser"]),
    ("agpl-3.0", ["agpl 3 0 only?", "agpl 3 0 or later"], [_GNU + "affero general public license|licence " + _V + "3 0?", _GNU + "agpl " + _V + "3 0?", "gnu? agplv3"], ["gnu org licenses agpl 3 0"]),
    ("agpl", [], [_GNU + "affero general public license|licence", "gnu agpl"], ["gnu org licenses agpl"]),
    ("gfdl", ["gfdl 1 [123] only?", "gfdl 1 [123] or later"], [_GNU + "free documentation license|licence"], ["gnu org licenses fdl"]),
    ("mpl-1.1", ["mpl 1 1"], ["mozilla public license|licence " + _V + "1 1"], ["mozilla org mpl mpl 1 1"]),
    ("mpl-2.0", ["mpl 2 0"], ["mozilla public license|licence " + _V + "2 0", "mpl " + _V + "2 0"], ["mozilla org mpl 2 0", "mozilla org en us mpl 2 0"]),
    ("mpl", [], ["mozilla public license|licence"], ["mozilla org mpl"]),
    ("epl-1.0", ["epl 1 0"], ["eclipse public license|licence " + _V + "1 0"], ["eclipse org legal epl v10"]),
    ("epl-2.0", ["epl 2 0"], ["eclipse public license|licence " + _V + "2 0"], ["eclipse org legal epl 2 0"]),
    ("epl", [], ["eclipse public license|licence"], ["eclipse org legal"]),
    ("edl-1.0", [], ["eclipse distribution license|licence"], []),
    ("cddl", ["cddl 1 [01]"], ["common development and distribution license|licence"], ["opensource org licenses? cddl"]),
    ("cpl-1.0", ["cpl 1 0"], ["common public license|licence " + _V + "1? 0?"], []),
    ("ipl-1.0", ["ipl 1 0"], ["ibm public license|licence"], []),
    ("eupl", ["eupl 1 [012]"], ["european union public license|licence", "eupl " + _V + "1 [012]"], []),
    ("cecill", ["cecill 2 [01]"], ["cecill (?:free)? software? license|licence"], ["cecill info licences"]),
    ("artistic-2.0", ["artistic 2 0"], ["artistic license|licence 2 0", "perl artistic license|licence"], ["opensource org licenses? artistic license 2 0"]),
    ("zlib", ["zlib"], ["zlib license|licence", "zlib libpng license|licence"], []),
    ("libpng", ["libpng", "libpng 2 0"], ["libpng license|licence"], []),
    ("bsl-1.0", ["bsl 1 0"], ["boost software license|licence"], ["boost org license 1 0"]),
    ("busl-1.1", ["busl 1 1"], ["business source license|licence"], []),
    ("sspl-1.0", ["sspl 1 0"], ["server side public license|licence"], []),
    ("elastic-2.0", ["elastic 2 0"], ["elastic license|licence " + _V + "2? 0?"], ["elastic co licensing elastic license"]),
    ("commons-clause", [], ["commons clause license|licence? condition?"], ["commonsclause com"]),
    ("python-2.0", ["python 2 0", "psf 2 0"], ["python software foundation license|licence", "psf license|licence"], ["docs python org license"]),
    ("php-3.01", ["php 3 0(?:1)?"], ["php license|licence"], ["php net license"]),
    ("ruby", ["ruby"], ["ruby license|licence", "ruby s license|licence"], []),
    ("postgresql", ["postgresql"], ["postgresql license|licence"], []),
    ("openssl", ["openssl"], ["openssl license|licence", "ssleay license|licence"], []),
    ("ncsa", ["ncsa"], ["university of illinois ncsa open source license|licence", "ncsa open source license|licence"], []),
    ("ms-pl", ["ms pl"], ["microsoft public license|licence"], []),
    ("ms-rl", ["ms rl"], ["microsoft reciprocal license|licence"], []),
    ("ofl-1.1", ["ofl 1 [01]"], ["sil open font license|licence", "open font license|licence"], ["scripts sil org ofl"]),
    ("unlicense", ["unlicense"], ["the unlicense"], ["unlicense org"]),
    ("wtfpl", ["wtfpl"], ["do what the fuck you want to public license|licence", "wtfpl license|licence"], ["wtfpl net"]),
    ("w3c", ["w3c"], ["w3c software ..3 license|licence"], []),
    ("upl-1.0", ["upl 1 0"], ["universal permissive license|licence"], []),
    ("osl-3.0", ["osl 3 0"], ["open software license|licence " + _V + "3? 0?"], []),
    ("afl-3.0", ["afl 3 0"], ["academic free license|licence"], []),
    ("vim", ["vim"], ["vim license|licence"], []),
    ("json", ["json"], ["json license|licence"], []),
    ("odbl-1.0", ["odbl 1 0"], ["open database license|licence"], ["opendatacommons org licenses odbl"]),
    ("odc-by-1.0", ["odc by 1 0"], ["open data commons attribution license|licence"], ["opendatacommons org licenses by"]),
    ("pddl-1.0", ["pddl 1 0"], ["public domain dedication and license|licence"], ["opendatacommons org licenses pddl"]),
    ("cdla", ["cdla permissive [12] 0", "cdla sharing 1 0"], ["community data license|licence agreement"], ["cdla dev"]),
    ("cc0-1.0", ["cc0 1 0"], ["cc0 1? 0? universal?", _CC + "zero"], ["creativecommons org publicdomain zero"]),
    ("cc-by-nc-nd", ["cc by nc nd [1234] 0"], ["cc by nc nd", _CC + "attribution non? commercial|noncommercial no? derivatives|noderivatives|noderivs|derivs"], ["creativecommons org licenses by nc nd"]),
    ("cc-by-nc-sa", ["cc by nc sa [1234] 0"], ["cc by nc sa", _CC + "attribution non? commercial|noncommercial share|sharealike alike?"], ["creativecommons org licenses by nc sa"]),
    ("cc-by-nc", ["cc by nc [1234] 0"], ["cc by nc", _CC + "attribution non? commercial|noncommercial"], ["creativecommons org licenses by nc"]),
    ("cc-by-nd", ["cc by nd [1234] 0"], ["cc by nd", _CC + "attribution no? derivatives|noderivatives|noderivs|derivs"], ["creativecommons org licenses by nd"]),
    ("cc-by-sa", ["cc by sa [1234] 0"], ["cc by sa", _CC + "attribution share|sharealike alike?"], ["creativecommons org licenses by sa"]),
    ("cc-by", ["cc by [1234] 0"], ["cc by", _CC + "attribution"], ["creativecommons org licenses by"]),
    ("creative-commons", [], [_CC + "license|licence"], ["creativecommons org"]),
    ("ogl-uk", ["ogl uk [123] 0"], ["open government license|licence"], ["nationalarchives gov uk doc open government licence"]),
    ("openrail", [], ["(?:creativeml)? open rail m?", "creativeml openrail m?", "responsible ai license|licence"], []),
]

#: sentences of licence texts and of their notices
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of ..8 nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2.0", "you may obtain a copy of the license at ..3 apache org licenses license 2 0"),
    ("apache-2.0", "grant of patent license subject to the terms and conditions of this license each contributor"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution"),
    ("apache", "this product includes software developed (?:by|at) the apache (?:software|group) foundation?"),
    ("gpl-2.0", "terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this"),
    ("gpl", "either version [123] of the license or at your option any later version"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser|library general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser|library general public license along with this"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "made available under the terms of the eclipse public license v|version? 2 0"),
    ("epl-1.0", "made available under the terms of the eclipse public license v|version? 1 0"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("cc0-1.0", "to the extent possible under law ..6 waived all copyright and related or neighboring rights"),
    ("cc-by", "this work|article|document|book is licensed under a creative commons attribution ..2 international? license|licence"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 [01]"),
    ("ogl-uk", "contains public sector information licensed under the open government licence"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", "this product includes php software freely available from"),
    ("json", "the software shall be used for good not evil"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "may not be reproduced ..6 without ..2 prior written permission|consent"),
    ("public-domain", "this work|file|image|text is in the public domain"),
    ("public-domain", "released|dedicated|placed ..2 in|into|to the public domain"),
]

#: what tells of a licence without naming one
MENTIONS = [
    ("reserved", "all rights reserved"), ("reserved", "some rights reserved"), ("reserved", "alle rechte vorbehalten"), ("reserved", "tous droits réservés"),
    ("reserved", "todos los derechos reservados"), ("reserved", "todos os direitos reservados"), ("gpl", "general public license|licence"),
    ("public-domain", "public domain"), ("proprietary", "proprietary and confidential"), ("proprietary", "commercial license|licence agreement"),
    ("copyright", "copyright c? (?:19|20)[0-9][0-9]"), ("copyright", "copyright by|holders|holder|owner"), ("unknown-license", "licensed under the? terms of"),
    ("unknown-license", "see the? license|licence file"), ("unknown-license", "open source license|licence"), ("unknown-license", "spdx license identifier"),
    ("unknown-license", "end user license|licence agreement"), ("unknown-license", "lizenziert unter"), ("unknown-license", "sous licence"), ("unknown-license", "bajo la? licencia"),
]

_ISSUED = "licensed|licenced|released|distributed|available|published|provided|covered|lizenziert ..2 under|by|unter the|a|an? terms? of? the? "
_DULL = {"license", "licence", "version", "public", "general", "software", "the", "this", "of", "and", "or", "to", "in", "is", "a", "by", "under", "terms", "source", "open",
         "copy", "for", "any", "with", "you", "new", "free", "use", "are", "be", "not", "from", "file", "as", "may", "if", "all", "at", "org", "licenses"}


def compiled(signature: str) -> str:
    out = []
    for word in signature.split():
        if word.startswith(".."):
            out.append("(?: [^ ]+ ){0,%s}" % word[2:])
            continue
        missing = word.endswith("?") and not word.endswith(")?")
        body = word[:-1] if missing else word
        body = f"(?:{body})" if "|" in body else body
        out.append(f"(?: {body} )?" if missing else f" {body} ")
    return "".join(out)


def keyword(signature: str) -> str:
    """A plain word of the signature that no match can lack, a telling one if there is any."""
    plain = [w for w in signature.split() if w.isalnum()]
    return max(plain, key=lambda w: (w not in _DULL, len(w) > 1, len(w)))


def rules() -> list[Rule]:
    """All rules, by class and then in the order of the lists above."""
    made = [(TEXT, label, s) for label, s in SENTENCES]
    for label, ids, names, places in FAMILIES:
        made += [(TAG, label, f"spdx license identifier {i}") for i in ids] + [(TAG, label, p) for p in places]
        made += [(NOTICE, label, _ISSUED + n) for n in names] + [(NAME, label, n) for n in names]
    made += [(MENTION, label, s) for label, s in MENTIONS] + [(BASE, label, s) for s, label in PHRASES]
    made.sort(key=lambda r: r[0])  # stable
    return [Rule(level, label, keyword(s), compiled(s)) for level, label, s in made]
