"""Licence scans by sentence rules.

A text is cut into sentences (line wraps inside a sentence are undone, comment
marks go) and each sentence is normalised to lower-case words. Known licence
sentences are kept as a trie of words; from each word of a normalised sentence
on, the longest known one is looked up and mapped to its identifier, with the
version or licence that it names. The document's sequence of identifiers is then
matched, from left to right, against an ordered list of licence rules; the first
rule that matches at a place wins and its sentences are used up. Up to GAP
unknown sentences may lie between two sentences of a rule; a list mark alone is
no sentence. Known sentences that no rule uses are reported as ``UNMATCHED``; a
bare "all rights reserved" stands in free licences' notices as well and counts as
unknown where one follows within GAP. "Not licensed under ..." names no licence.

An SPDX tag is read as an expression (or, and, with, parentheses); identifiers that
are not known keep their spelling, and parentheses stay where they are needed.

A licence has one name, the SPDX identifier, however it is named in the text;
what SPDX has no identifier for is named in words (Proprietary, Public-Domain).

One pass over whole texts without a shuffle. Each known sentence's longest word
is derived from the table. A word is never wrapped, so texts without any of
these words hold no known sentence and are not cut.

Defined results: null and empty texts and texts without known sentences give
no rows; repeated rows give repeated findings; texts of any length are scanned
whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 2
#: Sentences of public licences in normal form. (a|b) is a choice, [x] may be missing, ... is any words;
#: {v} is a version, {n} a number of clauses, {cc} Creative Commons elements in letters or words, {id} a short Creative Commons name, {gnu} a GNU licence's
#: short name with a version, {spdx} an SPDX expression, {known} a known identifier; ^ and $ are the ends of a sentence.
UNDER = "(licensed|licenced|released|distributed|available|published|provided|covered) (under|by) [the terms of] [the]"
MODIFY = "redistribute it and/or modify it under the terms of"
FSF = "as published by the free software foundation"
SENTENCES = [
    ("spdx:{v}", "spdx-license-identifier {spdx}"),
    ("spdx:{v}", "^ license [is] {known} $"),
    ("gpl-version:{v}", f"{UNDER} gnu (general public license|gpl) [version|v] {{v}}"),
    ("gpl-version:{v}", f"{UNDER} version {{v}} of the gnu (general public license|gpl)"),
    ("lgpl-version:{v}", f"{UNDER} gnu (lesser general public license|library general public license|lgpl) [version|v] {{v}}"),
    ("lgpl-version:{v}", f"{UNDER} version {{v}} of the gnu (lesser general public license|library general public license|lgpl)"),
    ("agpl-version:{v}", f"{UNDER} gnu (affero general public license|agpl) [version|v] {{v}}"),
    ("agpl-version:{v}", f"{UNDER} version {{v}} of the gnu (affero general public license|agpl)"),
    ("gnu-short:{v}", f"{UNDER} [gnu] {{gnu}}"),
    *((f"{x}-modify:{{v}}", phrase.format(name)) for x, name in (("gpl", ""), ("lgpl", "(lesser|library)"), ("agpl", "affero")) for phrase in (
        f"{MODIFY} the gnu {{}} general public license {FSF} [either] version {{{{v}}}}",
        f"{MODIFY} the gnu {{}} general public license [either] (version|v) {{{{v}}}} [{FSF}]",
        f"{MODIFY} [either] version {{{{v}}}} of the gnu {{}} general public license [{FSF}]",
    )),
    ("fsf-useful", "distributed in the hope that it will be useful but without any warranty"),
    ("fsf-details", "see the gnu [lesser|library|affero] general public license for more details"),
    ("fsf-copy", "you should have received a copy of the gnu [lesser|library|affero] general public license"),
    ("apache-or-mit:{v}", "either of [the] apache license [version] {v} or [the] mit license"),
    ("apache-or-mit:{v}", f"{UNDER} [either] [of] [the] apache license [version] {{v}} or [the] mit license"),
    ("apache-or-mit:{v}", "under [either] [the] apache license [version] {v} or [the] mit license"),
    ("apache-license:{v}", f"{UNDER} apache [software] license [version|v] {{v}}"),
    ("apache-license:{v}", f"{UNDER} apache [version|v] {{v}} license"),
    ("apache-compliance", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-limits", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-name", f"{UNDER} [expat] mit [expat] license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including"),
    ("mit-liable", "in no event shall the authors or copyright holders be liable for any claim"),
    ("bsd-name:{v}", f"{UNDER} (bsd {{n}}|{{n}} bsd) license"),
    ("boost-name:{v}", f"{UNDER} boost software license [version|v] {{v}}"),
    ("boost-name:{v}", "^ boost software license [version|v] {v}"),
    ("boost-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-warranty", "this software is provided by ... as is and any express or implied warranties"),
    ("bsd-liable", "in no event shall ... be liable for any direct indirect incidental special"),
    ("isc-grant", "permission to use copy modify (and|and/or) distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-warranty", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc-liable", "in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("mpl-subject:{v}", "subject to the terms of the mozilla public license [version|v] {v}"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file"),
    ("epl-terms:{v}", "made available under the terms of the eclipse public license [version|v] {v}"),
    ("cc-name:{v}", f"{UNDER} [a] {{id}}"),
    ("cc-name:{v}", f"{UNDER} [a] (creative commons|cc) {{cc}} {{v}}"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "(released|placed|dedicated|is) (into|in|to) the public domain"),
    ("unlicense-anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib-as-is", "this software is provided (as-is|as is) without any express or implied warranty"),
    ("zlib-liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib-origin", "the origin of this software must not be misrepresented"),
    ("zlib-altered", "altered source versions must be plainly marked as such"),
    ("proprietary", "all rights reserved (no part|unauthorized|unauthorised) ... (permission|prohibited)"),
    ("rights-reserved", "all rights reserved"),
    ("no-part", "no part ... (permission|prohibited)"),
    ("unauthorised", "(unauthorized|unauthorised) ... (permission|prohibited)"),
]

#: Public SPDX identifiers of licences, and of exceptions.
NAMES = """
0BSD AAL AFL-2.1 AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0
Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL
BSD-4-Clause BSD-4-Clause-UC BSD-Protection BSL-1.0 BUSL-1.1 bzip2-1.0.6 CAL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0
CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C
CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FSFUL FTL GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later
GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ICU IJG ImageMagick Info-ZIP Intel IPA ISC JSON
LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later Libpng libtiff LPL-1.02 LPPL-1.3c MirOS MIT
MIT-0 MIT-CMU MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NASA-1.3 NCSA Net-SNMP NPL-1.1 OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-2.1
OSL-3.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SMLNJ SSPL-1.0 TCL Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0
Vim W3C WTFPL X11 Xnet zlib-acknowledgement Zlib ZPL-2.0 ZPL-2.1 blessing
""".split()
EXCEPTIONS = """
Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 Font-exception-2.0 GCC-exception-2.0 GCC-exception-3.1
GPL-CC-1.0 Libtool-exception Linux-syscall-note LLVM-exception OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 Qt-GPL-exception-1.0
Qt-LGPL-exception-1.1 Swift-exception u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1
""".split()
#: What makes a sentence that names a licence say the contrary.
NEGATIONS = {"not", "never", "isn", "aren", "wasn", "neither", "nor", "cannot", "longer"}
FAMILIES = ("gpl", "lgpl", "agpl")
CC_WORDS = {"attribution": "BY", "noncommercial": "NC", "non-commercial": "NC", "sharealike": "SA", "share-alike": "SA", "noderivs": "ND", "noderivatives": "ND", "by": "BY", "nc": "NC", "sa": "SA", "nd": "ND"}

#: Ordered rules: longer and more special ones first. Sequences of sentence
#: identifiers; "x?" may be missing, {v} binds the version of a sentence.
RULES = [
    ("unlicense-free unlicense-anyone?", "Unlicense"),
    ("spdx:{v}", "{v}"),
    ("agpl-modify:{v}-later fsf-useful? fsf-details? fsf-copy?", "AGPL-{v}-or-later"),
    ("agpl-modify:{v} fsf-useful? fsf-details? fsf-copy?", "AGPL-{v}-only"),
    ("lgpl-modify:{v}-later fsf-useful? fsf-details? fsf-copy?", "LGPL-{v}-or-later"),
    ("lgpl-modify:{v} fsf-useful? fsf-details? fsf-copy?", "LGPL-{v}-only"),
    ("gpl-modify:{v}-later fsf-useful? fsf-details? fsf-copy?", "GPL-{v}-or-later"),
    ("gpl-modify:{v} fsf-useful? fsf-details? fsf-copy?", "GPL-{v}-only"),
    ("agpl-version:{v}-later", "AGPL-{v}-or-later"),
    ("agpl-version:{v}", "AGPL-{v}-only"),
    ("lgpl-version:{v}-later", "LGPL-{v}-or-later"),
    ("lgpl-version:{v}", "LGPL-{v}-only"),
    ("gpl-version:{v}-later", "GPL-{v}-or-later"),
    ("gpl-version:{v}", "GPL-{v}-only"),
    ("apache-license:{v} apache-compliance? apache-copy? apache-as-is? apache-limits?", "Apache-{v}"),
    ("mit-name? mit-grant mit-notice? mit-warranty? mit-liable?", "MIT"),
    ("mit-name", "MIT"),
    ("bsd-name:{v}? bsd-grant bsd-source bsd-binary bsd-advertising bsd-endorse? bsd-warranty? bsd-liable?", "BSD-4-Clause"),
    ("bsd-name:{v}? bsd-grant bsd-source bsd-binary bsd-endorse bsd-warranty? bsd-liable?", "BSD-3-Clause"),
    ("bsd-name:{v}? bsd-grant bsd-source bsd-binary bsd-warranty? bsd-liable?", "BSD-2-Clause"),
    ("bsd-name:{v}", "BSD-{v}-Clause"),
    ("boost-name:{v} boost-grant?", "BSL-{v}"),
    ("boost-grant", "BSL-1.0"),
    ("gnu-short:{v}-later", "{v}-or-later"),
    ("gnu-short:{v}", "{v}-only"),
    ("isc-grant isc-warranty? isc-liable?", "ISC"),
    ("mpl-subject:{v} mpl-copy?", "MPL-{v}"),
    ("epl-terms:{v}", "EPL-{v}"),
    ("cc-name:{v}", "{v}"),
    ("zlib-as-is? zlib-liable? zlib-grant zlib-origin? zlib-altered?", "Zlib"),
    ("public-domain", "Public-Domain"),
    ("apache-or-mit:{v}", "Apache-{v} OR MIT"),
    ("proprietary", "Proprietary"),
    ("rights-reserved no-part unauthorised?", "Proprietary"),
    ("rights-reserved unauthorised no-part?", "Proprietary"),
]



_VERSION = re.compile(r"v?(\d+(?:\.\d+)*)")
_CLAUSES = re.compile(r"([234])-clause")
_SHORT = re.compile(r"cc0(?:-1\.0)?|cc-(?:by|by-nc|by-sa|by-nd|by-nc-sa|by-nc-nd)-\d\.\d")
_GNU = re.compile(r"(a|l)?gpl-?v?(\d(?:\.\d)?)(\+)?")
_KEEPS = {x.lower(): x for x in [*NAMES, *EXCEPTIONS]}
_TAG = re.compile(r"SPDX-License-Identifier:\s*([^\n]*)", re.I)
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.:+-]+)")


def expanded(phrase: str) -> list[list[str]]:
    """All word sequences that a known sentence stands for."""
    m = re.search(r"[(\[]([^()\[\]]*)[)\]]", phrase)
    if not m:
        return [phrase.split()]
    choices = m[1].split("|") + [""] * (phrase[m.start()] == "[")
    return [x for c in choices for x in expanded(phrase[: m.start()] + c + phrase[m.end() :])]


def _trie() -> dict:
    root: dict = {}
    for name, phrase in SENTENCES:
        for words in expanded(phrase):
            node = root
            for w in words:
                node = node.setdefault(w, {})
            node.setdefault(None, name)
    return root


_known = _trie()
_WORDS = sorted({max((w for w in words if w[0] != "{"), key=len) for _, phrase in SENTENCES for words in expanded(phrase)})
_COMMENT = re.compile(r"(?m)^[ \t]*(?://+|/\*+|\*+/|\*+|#+|--+|;+|<!--+|%+)[ \t]?")
_END = re.compile(r"(?!(?<=\b[vV])\.\s+\d)[.!?][\"')*]*(?=\s|$)|\n[ \t]*\n")
_NOT_WORD = re.compile(r"[^a-z0-9./+,-]+")
_MARK = re.compile(r"\d{1,2}|[a-z]|[ivx]{1,4}")


def version(number: str) -> str:
    return number if "." in number else f"{number}.0"


def spdx(name: str) -> str:
    """The usual spelling of an SPDX name; older names of the GNU licences become today's."""
    low = name.lower()
    m = re.fullmatch(rf"({'|'.join(FAMILIES)})-?v?(\d(?:\.\d)?)(\+|-only|-or-later)?", low)
    if m:
        return f"{m[1].upper()}-{version(m[2])}{'-or-later' if m[3] in ('+', '-or-later') else '-only'}"
    return _KEEPS.get(low, name)


def expression(text: str) -> str:
    """The SPDX expression that a text starts with, in usual spelling with the parentheses it needs; "" if there is none.

    Operators in small letters count before a known identifier only, so that prose behind a tag is none.
    """
    tokens = []
    at = 0
    while m := _TOKEN.match(text, at):
        tokens.append(m[1].rstrip(".:-") if len(m[1]) > 1 else m[1])
        at = m.end()

    def operator(i: int, word: str) -> bool:
        return i + 1 < len(tokens) and tokens[i].upper() == word and (tokens[i].isupper() or spdx(tokens[i + 1]).lower() in _KEEPS or tokens[i + 1] == "(")

    def one(i: int) -> tuple[str, int, int] | None:
        """(spelling, strength, tokens up to its end); strength 0: its outermost operator is OR."""
        if i >= len(tokens) or tokens[i] == ")":
            return None
        if tokens[i] == "(":
            inner = joined(i + 1, 0)
            return (*inner[:2], inner[2] + 1) if inner and inner[2] < len(tokens) and tokens[inner[2]] == ")" else None
        if not re.match(r"[A-Za-z0-9]", tokens[i]):
            return None
        if operator(i + 1, "WITH") and re.match(r"[A-Za-z0-9]", tokens[i + 2]):
            return f"{spdx(tokens[i])} WITH {spdx(tokens[i + 2])}", 2, i + 3
        return spdx(tokens[i]), 2, i + 1

    def joined(i: int, strength: int) -> tuple[str, int, int] | None:
        part = (lambda k: joined(k, 1)) if strength == 0 else one
        word = "AND" if strength else "OR"
        found = part(i)
        parts = [found] if found else []
        while parts and operator(parts[-1][2], word) and (more := part(parts[-1][2] + 1)):
            parts.append(more)
        if len(parts) < 2:
            return parts[0] if parts else None
        return f" {word} ".join(f"({x})" if s < strength else x for x, s, _ in parts), strength, parts[-1][2]

    found = joined(0, 0)
    return found[0] if found else ""


def elements(words: list[str], at: int) -> list[tuple[int, str]]:
    """Ends and names of Creative Commons elements that start at a word, longest first."""
    if words[at] in ("zero", "0", "cc0"):
        return [(at + 1, "CC0")]
    out, parts = [], []
    for i in range(at, min(at + 4, len(words))):
        word = words[i]
        some = [CC_WORDS[word]] if word in CC_WORDS else [CC_WORDS.get(x) for x in word.replace("non-commercial", "noncommercial").replace("share-alike", "sharealike").split("-")]
        if None in some:
            break
        parts += some
        out.append((i + 1, "CC-" + "-".join(x for x in ("BY", "NC", "SA", "ND") if x in parts)))
    return out[::-1]


def lookup(words: list[str], at: int, node: dict, named: str) -> tuple[int, str, str] | None:
    """(end, identifier, what it names) of the longest known sentence that starts at a word."""
    best = (at, node[None], named) if None in node else None
    for token, below in node.items():
        ends: list[tuple[int, str]] = []
        if token is None or at == len(words):
            continue
        word = words[at]
        if token[0] != "{" and token != "...":
            if token == word:
                ends = [(at + 1, named)]
        elif token == "...":  # up to the first place from where the rest goes on, wherever in the sentence that is
            for i in range(at, len(words)) if not below.keys().isdisjoint(words[at:]) else ():
                if words[i] in below and (found := lookup(words, i, below, named)):
                    best = found if best is None or found[0] > best[0] else best
                    break
        elif token == "{v}" and (m := _VERSION.fullmatch(word.rstrip("+"))):
            ends = [(at + 1, f"{named}-{version(m[1])}" if named else version(m[1]))]
        elif token == "{n}" and (m := _CLAUSES.fullmatch(word)):
            ends = [(at + 1, m[1])]
        elif token == "{id}" and _SHORT.fullmatch(word):
            ends = [(at + 1, spdx("cc0-1.0" if word == "cc0" else word))]
        elif token == "{cc}":
            ends = elements(words, at)
        elif token == "{gnu}" and (m := _GNU.fullmatch(word)):
            ends = [(at + 1, f"{(m[1] or '').upper()}GPL-{version(m[2])}" + ("-later" if m[3] else ""))]
        elif token == "{spdx}" and word[0] == "=":
            ends = [(at + 1, word[1:])]
        elif token == "{known}" and spdx(word).lower() in _KEEPS:
            ends = [(at + 1, spdx(word))]
        for end, what in ends:
            found = lookup(words, end, below, what)
            if found and (best is None or found[0] > best[0]):
                best = found
    return best


def normal_words(text: str) -> list[str]:
    return [x for w in _NOT_WORD.sub(" ", text.lower()).split() if (x := w.strip(".,/-").lstrip("+"))]


def sentences(text: str) -> list[tuple[int, str]]:
    """(start, normalised sentence) in order; comment marks, list marks and wraps are gone.

    An SPDX tag is a sentence of its own, whose expression is one word: "=" and its parts by "_".
    """
    text = _COMMENT.sub("", text)
    out, at = [], 0
    for tag in _TAG.finditer(text):
        if found := expression(tag[1]):
            out += plain_sentences(text, at, tag.start())
            out.append((tag.start(), "spdx-license-identifier =" + found.replace(" ", "_")))
            at = tag.end()
    return out + plain_sentences(text, at, len(text))


def plain_sentences(text: str, at: int, stop: int) -> list[tuple[int, str]]:
    out = []
    for m in [*_END.finditer(text, at, stop), None]:
        end = m.start() if m else stop
        words = normal_words(text[at:end])
        if words and not (len(words) == 1 and _MARK.fullmatch(words[0])):
            out.append((at, " ".join(words)))
        at = m.end() if m else end
    return out


def identify(sentence: str) -> list[str]:
    """The identifiers of the known sentences in a normalised one, in order.

    Notices often lack the full stop before them, so a known sentence may start
    at any word; the next one starts after its end.
    """
    out, words, at = [], ["^", *sentence.split(), "$"], 0
    while at < len(words):
        node = _known.get(words[at])
        found = lookup(words, at + 1, node, "") if node else None
        if not found:
            at += 1
            continue
        begin = at
        at, name, what = found
        if name.split(":")[0] in _NAMING and NEGATIONS.intersection(words[max(0, begin - 4) : begin]):
            continue
        if what == "CC0":
            what = "CC0-1.0"
        if name.startswith(("gpl", "lgpl", "agpl", "gnu")) and not what.endswith("-later") and re.search(r"\b(?:any later version|or later)\b", " ".join(words[at:])):
            what += "-later"
        out.append(name.replace("{v}", what))
    return out


#: Sentences that name a licence behind a verb, which a "not" before it turns round.
_NAMING = {name.split(":")[0] for name, phrase in SENTENCES if phrase.startswith(UNDER) or phrase.startswith("either")}


def _compiled():
    out = []
    for sequence, licence in RULES:
        steps = []
        for token in sequence.split():
            optional = token.endswith("?")
            body = re.escape(token.rstrip("?")).replace(r"\{v\}", r"(?P<v>[A-Za-z0-9.+:()_-]+?)" if not optional else r"[A-Za-z0-9.+:()_-]+")
            steps.append(rf"(?:(?:\?\ ){{0,{GAP}}}{body}\ )" + "?" * optional)
        out.append((re.compile("".join(steps)), licence))
    return out


_rules = _compiled()
_PROHIBITING = ("rights-reserved", "no-part", "unauthorised", "proprietary")


def scan(text: str | None) -> list[tuple[str, list[str], int]]:
    """(licence, sentence identifiers, start of the first) in text order."""
    if not text:
        return []
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return []
    ids: list[str | None] = []
    starts: list[int] = []
    for start, sentence in sentences(text):
        some = identify(sentence) or [None]
        ids += some
        starts += [start] * len(some)
    for i, name in enumerate(ids):
        if name == "rights-reserved" and next((x for x in ids[i + 1 : i + GAP + 2] if x), name) not in _PROHIBITING:
            ids[i] = None
    out: list[tuple[str, list[str], int]] = []
    at = 0
    while at < len(ids):
        if ids[at] is None:
            at += 1
            continue
        rest = "".join((x or "?") + " " for x in ids[at : at + 40])  # a rule has at most 8 sentences, each with GAP unknown ones before it
        for pattern, licence in _rules:
            m = pattern.match(rest)
            if m and m.end():
                used = m[0].split()
                out.append((licence.replace("{v}", m.groupdict().get("v") or "").replace("_", " "), [u for u in used if u != "?"], starts[at]))
                at += len(used)
                break
        else:
            out.append(("UNMATCHED", [ids[at]], starts[at]))
            at += 1
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per finding: doc_id, nth, licence, sentence_ids, n_sentences."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(i, k, licence, used, len(used)) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, (licence, used, _) in enumerate(scan(text))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "nth", "licence", "sentence_ids", "n_sentences"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, nth int, licence string, sentence_ids array<string>, n_sentences int")
