"""Signature rules of the license scan: hand-written patterns over lower-cased text (A-Z only).

A rule: label, priority, keyword, pattern. A text is searched for a pattern only if it holds the
keyword, which every match of the pattern holds: one word without white space. Names with nothing in
common are rules of their own. Priority 3: identifiers and addresses, 2: names and wordings, 1: general notices without a name.
"""

from __future__ import annotations

#: White space or punctuation between words of a name.
G = r"[\s,;:()\"'*/#-]+"


def words(text: str) -> str:
    """A pattern for the words with anything light between them."""
    return G.join(text.split())


V = r"[\s,(]*(?:version|ver\.?|v\.?)?[\s]*"

#: Label, SPDX identifier pattern, keyword of the name, name pattern, address pattern (None: none).
LICENSES = [
    ("0bsd", "0bsd", "clause", r"(?:zero" + G + r"clause|0-clause)" + G + "bsd", r"opensource\.org/licenses?/0bsd"),
    ("afl-3.0", r"afl-3\.0", "academic", words("academic free license") + V + r"3\.0", r"opensource\.org/licenses?/afl-3\.0"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", "affero", r"(?:gnu\s+)?affero" + G + words("general public licen[sc]e") + V + r"3(?:\.0)?", r"gnu\.org/licenses/agpl(?:-3\.0)?"),
    ("apache-1.1", r"apache-1\.1", "apache", r"apache\s+(?:software\s+)?licen[sc]e" + V + r"1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", r"apache-2(?:\.0)?", "apache", r"apache\s+(?:software\s+)?licen[sc]e" + V + r"2(?:\.0)?|apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("artistic-1.0", r"artistic-1\.0", "artistic", r"artistic\s+licen[sc]e" + V + r"1\.0", r"opensource\.org/licenses?/artistic-license-1\.0"),
    ("artistic-2.0", r"artistic-2\.0", "artistic", r"artistic\s+licen[sc]e" + V + r"2(?:\.0)?", r"opensource\.org/licenses?/artistic-license-2\.0"),
    ("blueoak-1.0.0", r"blueoak-1\.0\.0", "oak", words("blue oak model license") + V + r"1\.0(?:\.0)?", r"blueoakcouncil\.org/license/1\.0\.0"),
    ("bsd-1-clause", "bsd-1-clause", "clause", r"(?:bsd\s+1|1|one)" + G + r"clause\s+(?:bsd\s+)?licen[sc]e", r"opensource\.org/licenses?/bsd-1-clause"),
    ("bsd-2-clause", "bsd-2-clause(?:-patent|-views)?", "bsd", r"(?:simplified|freebsd|2-clause|two-clause|2\s+clause)" + G + "bsd|bsd" + G + r"(?:2|two)" + G + "clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd-3-clause(?:-clear|-lbnl)?", "bsd", r"(?:new|modified|revised|3-clause|three-clause|3\s+clause)" + G + "bsd|bsd" + G + r"(?:3|three)" + G + "clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd-4-clause", "bsd", r"(?:original|old|4-clause|four-clause)" + G + "bsd|bsd" + G + r"(?:4|four)" + G + "clause", None),
    ("bsl-1.0", r"bsl-1\.0", "boost", words("boost software license") + V + r"1\.0", r"boost\.org/license_1_0\.txt"),
    ("busl-1.1", r"busl-1\.1", "business", words("business source license") + V + r"1\.1", r"mariadb\.com/bsl11"),
    ("cc0-1.0", r"cc0-1\.0", "cc0", r"cc0(?:\s+1\.0)?(?:\s+universal)?", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by-1.0", r"cc-by-1\.0", "1.0", r"cc[\s-]by[\s-]1\.0", r"creativecommons\.org/licenses/by/1\.0"),
    ("cc-by-2.0", r"cc-by-2\.0", "2.0", r"cc[\s-]by[\s-]2\.0|creative\s+commons\s+attribution\s+2\.0", r"creativecommons\.org/licenses/by/2\.0"),
    ("cc-by-2.5", r"cc-by-2\.5", "2.5", r"cc[\s-]by[\s-]2\.5|creative\s+commons\s+attribution\s+2\.5", r"creativecommons\.org/licenses/by/2\.5"),
    ("cc-by-3.0", r"cc-by-3\.0", "3.0", r"cc[\s-]by[\s-]3\.0|creative\s+commons\s+attribution\s+3\.0", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-4.0", r"cc-by-4\.0", "4.0", r"cc[\s-]by[\s-]4\.0|creative\s+commons\s+attribution\s+4\.0", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-sa-2.0", r"cc-by-sa-2\.0", "2.0", r"cc[\s-]by[\s-]sa[\s-]2\.0|attribution[\s-]+share\s?alike\s+2\.0", r"creativecommons\.org/licenses/by-sa/2\.0"),
    ("cc-by-sa-3.0", r"cc-by-sa-3\.0", "3.0", r"cc[\s-]by[\s-]sa[\s-]3\.0|attribution[\s-]+share\s?alike\s+3\.0", r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-sa-4.0", r"cc-by-sa-4\.0", "4.0", r"cc[\s-]by[\s-]sa[\s-]4\.0|attribution[\s-]+share\s?alike\s+4\.0", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-nc-2.0", r"cc-by-nc-2\.0", "2.0", r"cc[\s-]by[\s-]nc[\s-]2\.0|attribution[\s-]+non\s?commercial\s+2\.0", r"creativecommons\.org/licenses/by-nc/2\.0"),
    ("cc-by-nc-3.0", r"cc-by-nc-3\.0", "3.0", r"cc[\s-]by[\s-]nc[\s-]3\.0|attribution[\s-]+non\s?commercial\s+3\.0", r"creativecommons\.org/licenses/by-nc/3\.0"),
    ("cc-by-nc-4.0", r"cc-by-nc-4\.0", "4.0", r"cc[\s-]by[\s-]nc[\s-]4\.0|attribution[\s-]+non\s?commercial\s+4\.0", r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nd-4.0", r"cc-by-nd-4\.0", "4.0", r"cc[\s-]by[\s-]nd[\s-]4\.0|attribution[\s-]+no\s?deriv(?:ative)?s\s+4\.0", r"creativecommons\.org/licenses/by-nd/4\.0"),
    ("cc-by-nc-sa-3.0", r"cc-by-nc-sa-3\.0", "3.0", r"cc[\s-]by[\s-]nc[\s-]sa[\s-]3\.0|non\s?commercial[\s-]+share\s?alike\s+3\.0", r"creativecommons\.org/licenses/by-nc-sa/3\.0"),
    ("cc-by-nc-sa-4.0", r"cc-by-nc-sa-4\.0", "4.0", r"cc[\s-]by[\s-]nc[\s-]sa[\s-]4\.0|non\s?commercial[\s-]+share\s?alike\s+4\.0", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-nd-4.0", r"cc-by-nc-nd-4\.0", "4.0", r"cc[\s-]by[\s-]nc[\s-]nd[\s-]4\.0|non\s?commercial[\s-]+no\s?deriv(?:ative)?s\s+4\.0", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("cddl-1.0", r"cddl-1\.0", "development", words("common development and distribution license") + V + r"1\.0", r"opensource\.org/licenses?/cddl-1\.0"),
    ("cddl-1.1", r"cddl-1\.1", "development", words("common development and distribution license") + V + r"1\.1", None),
    ("cecill-2.1", r"cecill-2\.1", "cecill", r"cecill" + V + r"2\.1", r"cecill\.info/licences/licence_cecill_v2\.1"),
    ("cecill-b", "cecill-b", "cecill", r"cecill-b", r"cecill\.info/licences/licence_cecill-b"),
    ("cecill-c", "cecill-c", "cecill", r"cecill-c", r"cecill\.info/licences/licence_cecill-c"),
    ("cpal-1.0", r"cpal-1\.0", "attribution", words("common public attribution license") + V + r"1\.0", None),
    ("cpl-1.0", r"cpl-1\.0", "public", words("common public license") + V + r"1\.0", r"opensource\.org/licenses?/cpl1\.0"),
    ("curl", "curl", "curl", r"curl\s+licen[sc]e", r"curl\.(?:se|haxx\.se)/docs/copyright"),
    ("ecl-2.0", r"ecl-2\.0", "educational", words("educational community license") + V + r"2\.0", r"opensource\.org/licenses?/ecl-2\.0"),
    ("efl-2.0", r"efl-2\.0", "eiffel", words("eiffel forum license") + V + r"2(?:\.0)?", None),
    ("elastic-2.0", r"elastic-2\.0", "elastic", words("elastic license") + V + r"2\.0", r"elastic\.co/licensing/elastic-license"),
    ("epl-1.0", r"epl-1\.0", "eclipse", words("eclipse public license") + r"(?:\s*-)?" + V + r"1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", r"epl-2\.0", "eclipse", words("eclipse public license") + r"(?:\s*-)?" + V + r"2\.0", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("eupl-1.1", r"eupl-1\.1", "european", words("european union public licen[sc]e") + V + r"1\.1", r"joinup\.ec\.europa\.eu/software/page/eupl"),
    ("eupl-1.2", r"eupl-1\.2", "european", words("european union public licen[sc]e") + V + r"1\.2", r"eupl\.eu/1\.2"),
    ("gfdl-1.2", r"gfdl-1\.2(?:-only|-or-later)?", "documentation", words("free documentation licen[sc]e") + V + r"1\.2", None),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", "documentation", words("free documentation licen[sc]e") + V + r"1\.3", r"gnu\.org/licenses/fdl-1\.3"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", "gnu", r"gnu\s+" + words("general public licen[sc]e") + V + r"1(?:\.0)?", r"gnu\.org/licenses/old-licenses/gpl-1\.0"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", "gnu", r"gnu\s+" + words("general public licen[sc]e") + V + r"2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", "gnu", r"gnu\s+" + words("general public licen[sc]e") + V + r"3(?:\.0)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("hpnd", "hpnd", "historical", words("historical permission notice and disclaimer"), r"opensource\.org/licenses?/hpnd"),
    ("ijg", "ijg", "jpeg", words("independent jpeg group(?:'s)? licen[sc]e"), None),
    ("imatix", "imatix", "imatix", words("imatix standard function library agreement"), None),
    ("ipl-1.0", r"ipl-1\.0", "ibm", words("ibm public license") + V + r"1\.0", r"opensource\.org/licenses?/ipl-1\.0"),
    ("isc", "isc", "isc", r"isc\s+licen[sc]e", r"opensource\.org/licenses?/isc"),
    ("jquery", "jquery", "jquery", r"jquery\s+licen[sc]e", r"jquery\.org/license"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", "library", r"(?:gnu\s+)?" + words("library general public licen[sc]e") + V + r"2(?:\.0)?", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", "lesser", r"(?:gnu\s+)?" + words("lesser general public licen[sc]e") + V + r"2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", "lesser", r"(?:gnu\s+)?" + words("lesser general public licen[sc]e") + V + r"3(?:\.0)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("libpng", "libpng(?:-2\\.0)?", "libpng", r"libpng\s+licen[sc]e", r"libpng\.org/pub/png/src/libpng-license"),
    ("llama2", "llama2", "llama", words("llama 2 community license"), r"ai\.meta\.com/llama/license"),
    ("lppl-1.3c", r"lppl-1\.3c", "latex", words("latex project public license") + V + r"1\.3c?", r"latex-project\.org/lppl"),
    ("mit", "mit", "mit", r"(?:the\s+)?mit\s+licen[sc]e", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit-0", "mit", words("mit no attribution"), r"opensource\.org/licenses?/mit-0"),
    ("mpl-1.1", r"mpl-1\.1", "mozilla", words("mozilla public license") + V + r"1\.1", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("mpl-2.0", r"mpl-2\.0(?:-no-copyleft-exception)?", "mozilla", words("mozilla public license") + V + r"2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("ms-pl", "ms-pl", "microsoft", words("microsoft public license"), r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "ms-rl", "microsoft", words("microsoft reciprocal license"), r"opensource\.org/licenses?/ms-rl"),
    ("mulanpsl-2.0", r"mulanpsl-2\.0", "mulan", words("mulan psl") + V + "2|" + words("mulan permissive software license") + V + "2", r"license\.coscl\.org\.cn/mulanpsl2"),
    ("ncsa", "ncsa", "ncsa", r"(?:university\s+of\s+illinois[\s/]+)?ncsa\s+open\s+source\s+licen[sc]e", r"opensource\.org/licenses?/ncsa"),
    ("odbl-1.0", r"odbl-1\.0", "database", words("open database licen[sc]e"), r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", r"odc-by-1\.0", "attribution", words("open data commons attribution licen[sc]e"), r"opendatacommons\.org/licenses/by"),
    ("ofl-1.1", r"ofl-1\.1(?:-rfn|-no-rfn)?", "font", r"(?:sil\s+)?" + words("open font licen[sc]e") + V + r"1\.1", r"scripts\.sil\.org/ofl"),
    ("ogl-uk-3.0", r"ogl-uk-3\.0", "government", words("open government licen[sc]e") + V + r"3\.0", r"nationalarchives\.gov\.uk/doc/open-government-licence/version/3"),
    ("openssl", "openssl", "openssl", r"openssl\s+licen[sc]e", r"openssl\.org/source/license"),
    ("osl-3.0", r"osl-3\.0", "software", words("open software license") + V + r"3\.0", r"opensource\.org/licenses?/osl-3\.0"),
    ("php-3.01", r"php-3\.01", "php", r"php\s+licen[sc]e" + V + r"3\.01", r"php\.net/license/3_01"),
    ("postgresql", "postgresql", "postgresql", r"postgresql\s+licen[sc]e", r"opensource\.org/licenses?/postgresql"),
    ("psf-2.0", r"psf-2\.0|python-2\.0", "python", words("python software foundation licen[sc]e(?: agreement)?"), r"python\.org/psf/license|docs\.python\.org/3/license"),
    ("qpl-1.0", r"qpl-1\.0", "public", words("q public license") + V + r"1\.0", None),
    ("ruby", "ruby", "ruby", r"ruby(?:'s)?\s+licen[sc]e", r"ruby-lang\.org/en/about/license"),
    ("sleepycat", "sleepycat", "sleepycat", r"sleepycat\s+licen[sc]e", r"opensource\.org/licenses?/sleepycat"),
    ("sspl-1.0", r"sspl-1\.0", "server", words("server side public license") + V + r"1(?:\.0)?", r"mongodb\.com/licensing/server-side-public-license"),
    ("unicode-dfs-2016", "unicode-dfs-2016", "unicode", r"unicode,?\s+inc\.?\s+license\s+agreement", r"unicode\.org/(?:copyright|license)"),
    ("unlicense", "unlicense", "unlicense", r"(?:the\s+)?unlicense", r"unlicense\.org"),
    ("upl-1.0", r"upl-1\.0", "universal", words("universal permissive license") + V + r"1\.0", r"oss\.oracle\.com/licenses/upl"),
    ("vim", "vim", "vim", r"vim\s+licen[sc]e", r"vimhelp\.org/uganda"),
    ("w3c", "w3c", "w3c", r"w3c\s+software(?:\s+notice\s+and)?\s+licen[sc]e", r"w3\.org/consortium/legal/\d{4}/copyright-software"),
    ("wtfpl", "wtfpl", "public", r"do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public\s+license", r"wtfpl\.net"),
    ("x11", "x11", "x11", r"x11\s+licen[sc]e", r"xfree86\.org/3\.3\.6/copyright2"),
    ("zlib", "zlib", "zlib", r"zlib(?:/libpng)?\s+licen[sc]e", r"opensource\.org/licenses?/zlib"),
    ("zpl-2.1", r"zpl-2\.1", "zope", words("zope public license") + V + r"2\.1", r"old\.zope\.dev/resources/license/zpl-2\.1"),
]

#: Other names: label, keyword, pattern.
SHORT = [
    ("agpl-3.0", "agpl", r"agpl\s?v?3"),
    ("gpl-2.0", "gpl", r"gpl\s?v?2(?![.0-9])"),
    ("gpl-3.0", "gpl", r"gpl\s?v?3(?![.0-9])"),
    ("mit", "expat", r"expat\s+licen[sc]e"),
]

#: Wordings of license texts: label, keyword, pattern.
WORDINGS = [
    ("mit", "hereby", words("permission is hereby granted free of charge to any person obtaining a copy")),
    ("isc", "purpose", words("permission to use copy modify and(?:/or)? distribute this software for any purpose with or without fee")),
    ("bsd-3-clause", "endorse", words("may be used to endorse or promote products derived from this software without specific prior written permission")),
    ("bsd-2-clause", "binary", words("redistributions in binary form must reproduce the above copyright notice")),
    ("bsd-4-clause", "advertising", words("all advertising materials mentioning features or use of this software must display")),
    ("apache-2.0", "distributed", words("distributed under the license is distributed on an as is basis")),
    ("gpl-3.0", "option", words("either version 3 of the license or at your option any later version")),
    ("gpl-2.0", "option", words("either version 2 of the license or at your option any later version")),
    ("lgpl-2.1", "option", words("either version 2.1 of the license or at your option any later version")),
    ("agpl-3.0", "interaction", words("remote network interaction use with the gnu general public license")),
    ("mpl-2.0", "mozilla", words("this source code form is subject to the terms of the mozilla public license")),
    ("zlib", "as-is", words("this software is provided as-is without any express or implied warranty in no event will the authors")),
    ("bsl-1.0", "organization", words("to any person or organization obtaining a copy of the software and accompanying documentation covered by this license")),
    ("unlicense", "unencumbered", words("this is free and unencumbered software released into the public domain")),
    ("cc0-1.0", "neighboring", words("waived all copyright and related or neighboring rights")),
    ("public-domain", "domain", r"(?:released|placed|dedicated)\s+(?:in|into|to)\s+the\s+public\s+domain"),
    ("proprietary", "reserved", words("all rights reserved")),
    ("proprietary", "confidential", words("proprietary and confidential")),
    ("proprietary", "prohibited", words("unauthorized copying of this file via any medium is strictly prohibited")),
    ("no-redistribution", "redistribut", words("(?:may not|must not|no) (?:be )?redistribut(?:e|ed|ion)")),
    ("non-commercial", "commercial", words("for non-?commercial (?:use|purposes) only")),
    ("eula", "agreement", words("end user licen[sc]e agreement")),
    ("openrail", "rail", r"(?:creativeml\s+)?open\s?rail(?:\+\+)?(?:-m)?"),
    ("font-embedding", "embedding", words("font embedding (?:is )?(?:allowed|permitted)")),
]

#: Keywords (or parts of them) that may stand inside a word.
INSIDE = ["licen", "copyright", "©", "commercial", "rail"]

#: General notices that name no license.
GENERAL = [
    ("unnamed-license", "licen", r"licen[sc]ed\s+under\s+(?:the\s+)?(?:terms|conditions|following|same|a|an)\b"),
    ("unnamed-license", "licen", r"see\s+(?:the\s+)?(?:file\s+)?licen[sc]e(?:\.txt|\.md)?\s+for"),
    ("unnamed-license", "licen", r"subject\s+to\s+(?:the\s+)?(?:terms\s+of\s+)?(?:this|the)\s+licen[sc]e"),
    ("copyright-notice", "copyright", r"copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d"),
    ("copyright-notice", "©", r"©\s*(?:19|20)\d\d"),
]


#: What stands before identifiers, on their line.
TAG = "spdx-license-identifier"


def identifier(spdx: str) -> str:
    """A pattern for an identifier inside a tag's line."""
    return rf"(?<![a-z0-9.+-])(?:{spdx})(?![.+-]*[a-z0-9])"


def rules() -> list[tuple[str, int, str, str]]:
    """All rules, in a fixed order: identifiers, addresses, names, wordings, general notices. An identifier counts
    anywhere after the tag on its line; Java has no such look behind, so the scan looks inside the lines instead."""
    out = [(label, 3, TAG, rf"(?<={TAG}:[^\n]*){identifier(spdx)}") for label, spdx, *_ in LICENSES]
    out += [(label, 3, address.split("/")[0].replace("\\", "").split("(")[0].split("|")[0], address) for label, *_, address in LICENSES if address]
    out += [(label, 2, keyword, rf"(?<![a-z0-9])(?:{name})(?![a-z0-9])") for label, _, keyword, name, _ in LICENSES]
    out += [(label, 2, keyword, rf"(?<![a-z0-9])(?:{name})(?![a-z0-9])") for label, keyword, name in SHORT]
    out += [(label, 2, keyword, pattern) for label, keyword, pattern in WORDINGS]
    return out + [(label, 1, keyword, pattern) for label, keyword, pattern in GENERAL]


def gate_words() -> tuple[set[str], set[str]]:
    """Words of which a text that any rule finds something in holds one: those that begin a word there, and those
    that may stand inside one, since their patterns don't ask what is before them (``INSIDE``; of addresses, the end of the host)."""
    keywords = {(p, w) for _, p, w, _ in rules()}
    hosts = {w if w.endswith(".") else w[w.rindex("."):] for p, w in keywords if p == 3 and "." in w}
    begin = {w for p, w in keywords if p < 3 and not any(x in w for x in INSIDE)}
    return begin, hosts | set(INSIDE)
