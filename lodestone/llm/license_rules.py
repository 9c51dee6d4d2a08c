"""Signature rules for licence notices: data for lodestone.llm.licenses.

FAMILIES are written by hand, one a licence: how its name is written, its SPDX
identifiers and where its text is published.  With the sentences of
lodestone.llm.license_phrases, `rules` turns them into ordered rules (a regex, the
keywords of which one must occur before the regex is tried, a priority and a label).
"""

from __future__ import annotations

from typing import NamedTuple

from lodestone.llm.license_phrases import keyword, phrases


class Family(NamedTuple):
    label: str
    name: str  # regex of the name
    keyword: str  # lower-case literals, parted by |; every form of the name holds one
    spdx: tuple[str, ...] = ()
    urls: tuple[str, ...] = ()


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    keywords: tuple[str, ...]  # in lower case, with single blanks
    regex: str


_V = r"(?:,?\s*(?:v|ver\.?|version)?\s*)"
#: Their notices name a version in the words of the GPL's.
_NOT_OTHER_GPL = r"(?<!(?:lesser|library|affero)\s{1,9}general\s{1,9}public\s{1,9}licen[cs]e.{0,90})"

FAMILIES = (
    Family("mit", r"(?:the\s+)?(?:expat/)?mit[\s/-]+licen[cs]e", "mit", ("MIT",), ("opensource.org/licenses/mit", "opensource.org/license/mit", "mit-license.org")),
    Family("mit-0", r"mit\s+no[\s-]+attribution", "attribution", ("MIT-0",)),
    Family("x11", r"x11\s+licen[cs]e", "x11", ("X11",)),
    Family("isc", r"isc\s+licen[cs]e", "isc", ("ISC",), ("opensource.org/licenses/isc",)),
    Family("apache-1.1", r"apache\s+(?:software\s+)?licen[cs]e" + _V + r"1\.1", "apache", ("Apache-1.1",)),
    Family("apache-2.0", r"apache\s+(?:software\s+)?(?:licen[cs]e" + _V + r"|)2(?:\.0)?(?![\d.]*\d)", "apache", ("Apache-2.0",), ("apache.org/licenses/license-2.0", "opensource.org/licenses/apache-2.0")),
    Family("bsd-2-clause", r"(?:(?:simplified|freebsd|2[\s-]clause|two[\s-]clause)\s+bsd(?:\s+licen[cs]e)?|bsd[\s-]+(?:2|two)[\s-]clause(?:\s+licen[cs]e)?)", "bsd", ("BSD-2-Clause", "BSD-2-Clause-Views"), ("opensource.org/licenses/bsd-2-clause",)),
    Family("bsd-3-clause", r"(?:(?:new|modified|revised|3[\s-]clause|three[\s-]clause)\s+bsd(?:\s+licen[cs]e)?|bsd[\s-]+(?:3|three)[\s-]clause(?:\s+licen[cs]e)?)", "bsd", ("BSD-3-Clause", "BSD-3-Clause-Clear"), ("opensource.org/licenses/bsd-3-clause",)),
    Family("bsd-4-clause", r"(?:original|4[\s-]clause|four[\s-]clause)\s+bsd(?:\s+licen[cs]e)?", "bsd", ("BSD-4-Clause",)),
    Family("0bsd", r"(?:zero[\s-]clause\s+bsd|bsd\s+zero\s+clause|0bsd)(?:\s+licen[cs]e)?", "bsd", ("0BSD",)),
    Family("gpl-1.0", r"gnu\s+(?:general\s+public\s+licen[cs]e|gpl)" + _V + r"1(?:\.0)?(?!\d)", "gnu", ("GPL-1.0", "GPL-1.0-only", "GPL-1.0-or-later")),
    Family("gpl-2.0", r"(?:gnu\s+)?(?:general\s+public\s+licen[cs]e|gpl)" + _V + r"2(?:\.0)?(?!\d)", "gpl|general", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), ("gnu.org/licenses/old-licenses/gpl-2.0", "gnu.org/licenses/gpl-2.0")),
    Family("gpl-3.0", r"(?:gnu\s+)?(?:general\s+public\s+licen[cs]e|gpl)" + _V + r"3(?:\.0)?(?!\d)", "gpl|general", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), ("gnu.org/licenses/gpl-3.0", "gnu.org/licenses/gpl.html")),
    Family("gpl", r"gnu\s+(?:general\s+public\s+licen[cs]e|gpl)", "gnu", ("GPL",), ("gnu.org/copyleft/gpl", "gnu.org/licenses/gpl")),
    Family("lgpl-2.1", r"(?:gnu\s+)?(?:lesser\s+general\s+public\s+licen[cs]e|lgpl)" + _V + r"2\.1", "2.1", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"), ("gnu.org/licenses/old-licenses/lgpl-2.1",)),
    Family("lgpl-2.0", r"(?:gnu\s+)?(?:library\s+general\s+public\s+licen[cs]e|lgpl" + _V + r"2(?:\.0)?(?![\d.]))", "lgpl|library", ("LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later")),
    Family("lgpl-3.0", r"(?:gnu\s+)?(?:lesser\s+general\s+public\s+licen[cs]e|lgpl)" + _V + r"3(?:\.0)?(?!\d)", "lgpl|lesser", ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"), ("gnu.org/licenses/lgpl-3.0",)),
    Family("lgpl", r"(?:gnu\s+)?(?:lesser\s+general\s+public\s+licen[cs]e|\blgpl\b)", "lgpl|lesser", ("LGPL",), ("gnu.org/licenses/lgpl", "gnu.org/copyleft/lesser")),
    Family("agpl-3.0", r"(?:gnu\s+)?(?:affero\s+general\s+public\s+licen[cs]e|agpl)(?:" + _V + r"3(?:\.0)?(?!\d))?", "agpl|affero", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), ("gnu.org/licenses/agpl",)),
    Family("gfdl", r"gnu\s+free\s+documentation\s+licen[cs]e", "free documentation", ("GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "GFDL-1.3-or-later"), ("gnu.org/licenses/fdl", "gnu.org/copyleft/fdl")),
    Family("mpl-1.1", r"mozilla\s+public\s+licen[cs]e" + _V + r"1\.1", "mozilla", ("MPL-1.1",), ("mozilla.org/mpl/1.1",)),
    Family("mpl-2.0", r"(?:mozilla\s+public\s+licen[cs]e|\bmpl)(?:" + _V + r"2(?:\.0)?(?!\d))", "mpl|mozilla", ("MPL-2.0",), ("mozilla.org/mpl/2.0", "mozilla.org/en-us/mpl")),
    Family("epl-1.0", r"eclipse\s+public\s+licen[cs]e" + _V + r"1(?:\.0)?(?!\d)", "eclipse", ("EPL-1.0",), ("eclipse.org/legal/epl-v10",)),
    Family("epl-2.0", r"eclipse\s+public\s+licen[cs]e" + _V + r"2(?:\.0)?(?!\d)", "eclipse", ("EPL-2.0",), ("eclipse.org/legal/epl-2.0", "eclipse.org/legal/epl-v20")),
    Family("edl-1.0", r"eclipse\s+distribution\s+licen[cs]e", "eclipse", (), ("eclipse.org/org/documents/edl",)),
    Family("cddl-1.0", r"common\s+development\s+and\s+distribution\s+licen[cs]e", "common development", ("CDDL-1.0", "CDDL-1.1"), ("opensource.org/licenses/cddl",)),
    Family("cpl-1.0", r"common\s+public\s+licen[cs]e", "common public", ("CPL-1.0",), ("opensource.org/licenses/cpl",)),
    Family("eupl", r"european\s+union\s+public\s+licen[cs]e|\beupl\b", "eupl|european", ("EUPL-1.1", "EUPL-1.2"), ("joinup.ec.europa.eu/collection/eupl",)),
    Family("artistic-1.0", r"(?:perl\s+)?artistic\s+licen[cs]e" + _V + r"1(?:\.0)?(?!\d)", "artistic", ("Artistic-1.0", "Artistic-1.0-Perl")),
    Family("artistic-2.0", r"artistic\s+licen[cs]e" + _V + r"2(?:\.0)?(?!\d)", "artistic", ("Artistic-2.0",), ("opensource.org/licenses/artistic-license-2.0",)),
    Family("perl", r"same\s+terms\s+as\s+perl\s+itself", "perl"),
    Family("boost-1.0", r"boost\s+software\s+licen[cs]e(?:" + _V + r"1(?:\.0)?)?", "boost", ("BSL-1.0",), ("boost.org/license_1_0",)),
    Family("zlib", r"zlib(?:/libpng)?\s+licen[cs]e", "zlib", ("Zlib", "zlib-acknowledgement"), ("zlib.net/zlib_license",)),
    Family("libpng", r"libpng\s+licen[cs]e", "libpng", ("Libpng", "libpng-2.0")),
    Family("unlicense", r"\bthe\s+unlicense\b|\bunlicense\b", "unlicense", ("Unlicense",), ("unlicense.org",)),
    Family("wtfpl", r"do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[cs]e|\bwtfpl\b", "wtfpl|want", ("WTFPL",), ("wtfpl.net",)),
    Family("postgresql", r"postgresql\s+licen[cs]e", "postgresql", ("PostgreSQL",), ("opensource.org/licenses/postgresql",)),
    Family("python-2.0", r"(?:python\s+software\s+foundation|\bpsf)\s+licen[cs]e", "python|psf", ("Python-2.0", "PSF-2.0"), ("docs.python.org/3/license",)),
    Family("ruby", r"ruby(?:'s)?\s+licen[cs]e", "ruby", ("Ruby",), ("ruby-lang.org/en/about/license",)),
    Family("php-3.01", r"php\s+licen[cs]e" + _V + r"3\.0?1?", "php", ("PHP-3.0", "PHP-3.01"), ("php.net/license",)),
    Family("openssl", r"openssl\s+licen[cs]e", "openssl", ("OpenSSL",), ("openssl.org/source/license",)),
    Family("ncsa", r"university\s+of\s+illinois/?\s*ncsa\s+open\s+source\s+licen[cs]e|ncsa\s+licen[cs]e", "ncsa", ("NCSA",), ("opensource.org/licenses/ncsa",)),
    Family("afl-3.0", r"academic\s+free\s+licen[cs]e", "academic free", ("AFL-2.1", "AFL-3.0"), ("opensource.org/licenses/afl",)),
    Family("osl-3.0", r"open\s+software\s+licen[cs]e", "open software", ("OSL-2.1", "OSL-3.0"), ("opensource.org/licenses/osl",)),
    Family("ofl-1.1", r"sil\s+open\s+font\s+licen[cs]e", "open font", ("OFL-1.0", "OFL-1.1"), ("scripts.sil.org/ofl", "openfontlicense.org")),
    Family("ms-pl", r"microsoft\s+public\s+licen[cs]e|\bms-pl\b", "ms-pl|microsoft", ("MS-PL",), ("opensource.org/licenses/ms-pl",)),
    Family("ms-rl", r"microsoft\s+reciprocal\s+licen[cs]e|\bms-rl\b", "ms-rl|microsoft", ("MS-RL",)),
    Family("bsl-1.1", r"business\s+source\s+licen[cs]e", "business source", ("BUSL-1.1",), ("mariadb.com/bsl11",)),
    Family("sspl-1.0", r"server\s+side\s+public\s+licen[cs]e|\bsspl\b", "sspl|server", ("SSPL-1.0",), ("mongodb.com/licensing/server-side-public-license",)),
    Family("elastic-2.0", r"elastic\s+licen[cs]e", "elastic", ("Elastic-2.0",), ("elastic.co/licensing/elastic-license",)),
    Family("blueoak-1.0.0", r"blue\s+oak\s+model\s+licen[cs]e", "blue oak", ("BlueOak-1.0.0",), ("blueoakcouncil.org/license",)),
    Family("upl-1.0", r"universal\s+permissive\s+licen[cs]e", "universal permissive", ("UPL-1.0",), ("oss.oracle.com/licenses/upl",)),
    Family("cecill", r"\bcecill(?:-[bc])?\b(?:\s+licen[cs]e)?", "cecill", ("CECILL-2.0", "CECILL-2.1", "CECILL-B", "CECILL-C"), ("cecill.info",)),
    Family("mulan-2.0", r"mulan\s+permissive\s+software\s+licen[cs]e", "mulan", ("MulanPSL-1.0", "MulanPSL-2.0"), ("license.coscl.org.cn/mulan",)),
    Family("json", r"json\s+licen[cs]e", "json", ("JSON",), ("json.org/license",)),
    Family("beerware", r"beer-?ware\s+licen[cs]e", "beer", ("Beerware",)),
    Family("cc0-1.0", r"(?:creative\s+commons\s+zero|\bcc0\b|\bcc\s+zero\b)(?:\s+1\.0)?(?:\s+universal)?", "cc0|creative|cc", ("CC0-1.0",), ("creativecommons.org/publicdomain/zero",)),
    Family("cc-by-nc-nd", r"(?:creative\s+commons\s+attribution[\s-]+non-?commercial[\s-]+no-?deriv\w*|\bcc[\s-]+by-nc-nd)(?:[\s-]+[1-4]\.\d)?", "cc|creative", ("CC-BY-NC-ND-3.0", "CC-BY-NC-ND-4.0"), ("creativecommons.org/licenses/by-nc-nd",)),
    Family("cc-by-nc-sa", r"(?:creative\s+commons\s+attribution[\s-]+non-?commercial[\s-]+share-?alike|\bcc[\s-]+by-nc-sa)(?:[\s-]+[1-4]\.\d)?", "cc|creative", ("CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0"), ("creativecommons.org/licenses/by-nc-sa",)),
    Family("cc-by-nc", r"(?:creative\s+commons\s+attribution[\s-]+non-?commercial|\bcc[\s-]+by-nc)(?:[\s-]+[1-4]\.\d)?", "cc|creative", ("CC-BY-NC-3.0", "CC-BY-NC-4.0"), ("creativecommons.org/licenses/by-nc/",)),
    Family("cc-by-nd", r"(?:creative\s+commons\s+attribution[\s-]+no-?deriv\w*|\bcc[\s-]+by-nd)(?:[\s-]+[1-4]\.\d)?", "cc|creative", ("CC-BY-ND-3.0", "CC-BY-ND-4.0"), ("creativecommons.org/licenses/by-nd",)),
    Family("cc-by-sa", r"(?:creative\s+commons\s+attribution[\s-]+share-?alike|\bcc[\s-]+by-sa)(?:[\s-]+[1-4]\.\d)?", "cc|creative", ("CC-BY-SA-3.0", "CC-BY-SA-4.0"), ("creativecommons.org/licenses/by-sa",)),
    Family("cc-by", r"(?:creative\s+commons\s+attribution|\bcc[\s-]+by)(?:[\s-]+[1-4]\.\d)?(?![\w-])", "cc|creative", ("CC-BY-3.0", "CC-BY-4.0"), ("creativecommons.org/licenses/by/",)),
    Family("odbl-1.0", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e|\bodbl\b", "odbl|database", ("ODbL-1.0",), ("opendatacommons.org/licenses/odbl",)),
    Family("odc-by-1.0", r"open\s+data\s+commons\s+attribution\s+licen[cs]e", "open data commons", ("ODC-By-1.0",), ("opendatacommons.org/licenses/by",)),
    Family("pddl-1.0", r"public\s+domain\s+dedication\s+and\s+licen[cs]e", "public domain", ("PDDL-1.0",), ("opendatacommons.org/licenses/pddl",)),
    Family("openrail", r"(?:creativeml\s+)?open\s*rail(?:-?[ms]+)?(?:\s+licen[cs]e)?", "rail", ("OpenRAIL", "OpenRAIL-M", "CreativeML-OpenRAIL-M")),
    Family("vim", r"vim\s+licen[cs]e", "vim", ("Vim",)),
    Family("w3c", r"w3c\s+(?:software\s+(?:notice\s+and\s+)?)?licen[cs]e", "w3c", ("W3C",), ("w3.org/consortium/legal",)),
    Family("unicode", r"unicode\s+(?:data\s+files\s+and\s+software\s+)?licen[cs]e", "unicode", ("Unicode-DFS-2016", "Unicode-3.0"), ("unicode.org/copyright", "unicode.org/license")),
    Family("public-domain", r"(?:placed|released|dedicated)\s+(?:in|into|to)\s+the\s+public\s+domain", "public domain"),
    Family("proprietary", r"(?:proprietary\s+and\s+confidential|unauthori[sz]ed\s+(?:copying|use)\s+(?:of\s+this\s+\w+\s+)?is\s+(?:strictly\s+)?prohibited)", "proprietary|prohibited", ()),
    Family("curl", r"curl\s+licen[cs]e", "curl", ("curl",), ("curl.se/docs/copyright",)),
    Family("hpnd", r"historical\s+permission\s+notice\s+and\s+disclaimer", "historical permission", ("HPND",)),
    Family("zend-2.0", r"zend\s+(?:engine\s+)?licen[cs]e", "zend", ("Zend-2.0",)),
    Family("tcl", r"tcl(?:/tk)?\s+licen[cs]e", "tcl", ("TCL",)),
    Family("sleepycat", r"sleepycat\s+(?:public\s+)?licen[cs]e", "sleepycat", ("Sleepycat",)),
    Family("freetype", r"freetype\s+(?:project\s+)?licen[cs]e", "freetype", ("FTL",)),
    Family("ijg", r"independent\s+jpeg\s+group\s+licen[cs]e", "independent jpeg", ("IJG",)),
    Family("imagemagick", r"imagemagick\s+licen[cs]e", "imagemagick", ("ImageMagick",), ("imagemagick.org/script/license",)),
    Family("apsl-2.0", r"apple\s+public\s+source\s+licen[cs]e", "apple public", ("APSL-1.2", "APSL-2.0"), ("opensource.apple.com/license/apsl",)),
    Family("ipl-1.0", r"ibm\s+public\s+licen[cs]e", "ibm public", ("IPL-1.0",)),
    Family("lppl-1.3c", r"latex\s+project\s+public\s+licen[cs]e|\blppl\b", "latex project|lppl", ("LPPL-1.3a", "LPPL-1.3c"), ("latex-project.org/lppl",)),
    Family("qpl-1.0", r"\bq\s+public\s+licen[cs]e", "q public", ("QPL-1.0",)),
    Family("ecl-2.0", r"educational\s+community\s+licen[cs]e", "educational community", ("ECL-1.0", "ECL-2.0")),
    Family("cpal-1.0", r"common\s+public\s+attribution\s+licen[cs]e", "common public", ("CPAL-1.0",)),
    Family("rpl-1.5", r"reciprocal\s+public\s+licen[cs]e", "reciprocal public", ("RPL-1.1", "RPL-1.5")),
    Family("sissl", r"sun\s+industry\s+standards\s+source\s+licen[cs]e", "sun industry", ("SISSL",)),
    Family("nasa-1.3", r"nasa\s+open\s+source\s+agreement", "nasa", ("NASA-1.3",)),
    Family("nposl-3.0", r"non-profit\s+open\s+software\s+licen[cs]e", "non-profit open", ("NPOSL-3.0",)),
    Family("hippocratic", r"hippocratic\s+licen[cs]e", "hippocratic", ("Hippocratic-2.1",), ("firstdonoharm.dev",)),
    Family("fal-1.3", r"free\s+art\s+licen[cs]e|licence\s+art\s+libre", "free art|art libre", ("LAL-1.3",), ("artlibre.org/licence",)),
    Family("ogl-uk", r"(?:uk\s+)?open\s+government\s+licen[cs]e", "open government", ("OGL-UK-2.0", "OGL-UK-3.0"), ("nationalarchives.gov.uk/doc/open-government-licence",)),
    Family("etalab-2.0", r"etalab\s+(?:open\s+)?licen[cs]e", "etalab", ("etalab-2.0",), ("etalab.gouv.fr/licence-ouverte",)),
    Family("cdla", r"community\s+data\s+licen[cs]e\s+agreement", "community data", ("CDLA-Permissive-2.0", "CDLA-Sharing-1.0"), ("cdla.dev",)),
    Family("polyform", r"polyform\s+(?:noncommercial|small\s+business|shield|strict|perimeter)(?:\s+licen[cs]e)?", "polyform", ("PolyForm-Noncommercial-1.0.0", "PolyForm-Small-Business-1.0.0"), ("polyformproject.org/licenses",)),
    Family("commons-clause", r"commons\s+clause", "commons clause", (), ("commonsclause.com",)),
    Family("llama", r"llama\s+(?:[0-9.]+\s+)?community\s+licen[cs]e", "llama", (), ("llama.com/license", "ai.meta.com/llama/license")),
    Family("gemma", r"gemma\s+terms\s+of\s+use", "gemma", (), ("ai.google.dev/gemma/terms",)),
)

#: The sentences that look behind themselves: (label, regex).
GPL_VERSIONS = (
    ("gpl-2.0", _NOT_OTHER_GPL + r"either version 2 of the licen[cs]e, or \(?at your option\)? any later version"),
    ("gpl-3.0", _NOT_OTHER_GPL + r"either version 3 of the licen[cs]e, or \(?at your option\)? any later version"),
)

#: Whole texts, identifiers, addresses, tags, grants and bare names, in this order.
PRIORITIES = {"body": 95, "spdx": 100, "url": 90, "tag": 85, "grant": 80, "name": 50}
_GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed|redistribut\w+)\s+(?:\w+\s+){0,3}?under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?)?"


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " _" else c for c in text)


def rules(families: tuple[Family, ...] = FAMILIES) -> list[Rule]:
    """All rules in order; regexes ignore ASCII case and let the dot pass newlines."""
    out: list[Rule] = []

    def add(kind: str, label: str, keywords: tuple[str, ...], regex: str) -> None:
        out.append(Rule(len(out), label, PRIORITIES[kind], tuple(k.lower() for k in keywords), f"(?is){regex}"))

    for label, regex in phrases():
        add("body", label, (keyword(regex),), regex.replace(" ", r"\s+"))
    for label, regex in GPL_VERSIONS:
        add("body", label, (f"either version {label[4]} of the",), regex.replace(" ", r"\s+"))
    for f in families:
        for i in f.spdx:
            add("spdx", f.label, ("spdx",), rf"spdx-license-identifier:\s*(?:\(?[\w.+-]+\s+(?:or|and|with)\s+)?{_literal(i)}(?![\w.-]*\w)")
            add("tag", f.label, (i,), rf"\blicen[cs]e[\"']?\s*[:=]\s*[\"']?{_literal(i)}(?![\w.-]*\w)")
        for url in f.urls:
            add("url", f.label, (url,), _literal(url))
        keywords = tuple(f.keyword.split("|"))
        add("grant", f.label, keywords, rf"{_GRANT}(?:{f.name})")
        add("name", f.label, keywords, rf"(?<![\w-])(?:{f.name})")
    return out
