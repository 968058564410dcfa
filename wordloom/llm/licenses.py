"""License scan: ordered signature rules behind a keyword gate.

Sentences of license texts, short forms with versions and name patterns are signatures.
Templates give them their priority (tag, grant, body of a license, address, title with
version, bare name); all operands of a tag's expression count. A rule runs only where its keyword
occurs. A detection inside another of the same or a higher priority is dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.columns import replacing

# Phrases of the base search and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, words that any name must contain, name, part of an address (or none).
# In names a space stands for any white space.
LICENSES = (
    ("mit", "mit", r"mit(?:/expat)?(?: license)", r"opensource\.org/licenses?/mit\b"),
    ("mit-0", "mit", r"mit no attribution(?: license)?", r"opensource\.org/licenses?/mit-0"),
    ("apache-1.0", "apache", r"apache(?: software)? license,? (?:version |v\.? ?)?1\.0", r"apache\.org/licenses/license-1\.0"),
    ("apache-1.1", "apache", r"apache(?: software)? license,? (?:version |v\.? ?)?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", r"apache(?: software)? license,? (?:version |v\.? ?)?2(?:\.0)?\b", r"apache\.org/licenses/license-2\.0"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license,?(?: \(gpl\))? (?:version |v\.? ?)1(?:\.0)?\b", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license,?(?: \(gpl\))? (?:version |v\.? ?)2(?:\.0)?\b", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license,?(?: \(gpl\))? (?:version |v\.? ?)3(?:\.0)?\b", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "general public", r"gnu general public license", r"gnu\.org/licenses/gpl\b"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public license,? (?:version |v\.? ?)2(?:\.0)?\b", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license,? (?:version |v\.? ?)2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license,? (?:version |v\.? ?)3(?:\.0)?\b", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public license", r"gnu\.org/licenses/lgpl\b"),
    ("agpl-1.0", "affero", r"affero general public license,? (?:version |v\.? ?)1(?:\.0)?\b", r"affero\.org/oagpl"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license,? (?:version |v\.? ?)3(?:\.0)?\b", r"gnu\.org/licenses/agpl-3\.0"),
    ("agpl", "affero", r"(?:gnu )?affero general public license", r"gnu\.org/licenses/agpl\b"),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation license,? (?:version |v\.? ?)1\.2", r"gnu\.org/licenses/fdl-1\.2"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation license,? (?:version |v\.? ?)1\.3", r"gnu\.org/licenses/fdl-1\.3"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation license", r"gnu\.org/licenses/fdl\b"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd[ -]2[ -]clause|2[ -]clause bsd)(?: license)", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|bsd[ -]3[ -]clause|3[ -]clause bsd)(?: license)", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd[ -]4[ -]clause|4[ -]clause bsd)(?: license)", None),
    ("bsd-0-clause", "bsd", r"(?:zero[ -]clause bsd|bsd[ -](?:0|zero)[ -]clause|0bsd)(?: license)?", r"opensource\.org/licenses?/0bsd"),
    ("bsd", "bsd", r"bsd(?:[ -]style)? license", r"opensource\.org/licenses?/bsd-license"),
    ("isc", "isc", r"isc license", r"opensource\.org/licenses?/isc\b"),
    ("mpl-1.0", "mozilla public", r"mozilla public license,? (?:version |v\.? ?)1\.0", r"mozilla\.org/mpl/1\.0"),
    ("mpl-1.1", "mozilla public", r"mozilla public license,? (?:version |v\.? ?)1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla public", r"mozilla public license,? (?:version |v\.? ?)2(?:\.0)?\b", r"mozilla\.org/mpl/2\.0"),
    ("mpl", "mozilla public", r"mozilla public license", r"mozilla\.org/mpl\b"),
    ("epl-1.0", "eclipse public", r"eclipse public license,?(?: -)? (?:version |v\.? ?)1(?:\.0)?\b", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse public", r"eclipse public license,?(?: -)? (?:version |v\.? ?)2(?:\.0)?\b", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cddl-1.0", "common development", r"common development and distribution license,? (?:version |v\.? ?)?1\.0", r"opensource\.org/licenses?/cddl-1\.0"),
    ("cddl-1.1", "common development", r"common development and distribution license,? (?:version |v\.? ?)?1\.1", None),
    ("eupl-1.1", "european union public", r"european union public licen[cs]e,? (?:version |v\.? ?)?1\.1", None),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e,? (?:version |v\.? ?)?1\.2", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("artistic-1.0", "artistic", r"artistic license,? (?:version )?1\.0", r"opensource\.org/licenses?/artistic-1\.0"),
    ("artistic-2.0", "artistic", r"artistic license,? (?:version )?2(?:\.0)?\b", r"opensource\.org/licenses?/artistic-2\.0"),
    ("bsl-1.0", "boost", r"boost software license(?:,? (?:version )?1\.0)?", r"boost\.org/license_1_0"),
    ("zlib", "zlib", r"zlib(?:/libpng)? license", r"opensource\.org/licenses?/zlib"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense\.org"),
    ("wtfpl", "public license", r"do what the f\S+ you want to public license", r"wtfpl\.net"),
    ("openssl", "openssl", r"openssl license", r"openssl\.org/source/license"),
    ("python-2.0", "python", r"python software foundation license(?: version 2)?", r"python\.org/\S*/license"),
    ("php-3.01", "php", r"php license,? (?:version )?3\.01", r"php\.net/license/3_01"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql\.org/about/licen[cs]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?:,? (?:version )?1\.1)?", r"scripts\.sil\.org/ofl"),
    ("ms-pl", "microsoft public", r"microsoft public license", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license", r"opensource\.org/licenses?/ms-rl"),
    ("upl-1.0", "universal permissive", r"universal permissive license(?:,? (?:version |v\.? ?)?1\.0)?", r"opensource\.org/licenses?/upl"),
    ("odbl-1.0", "open database", r"open database license(?:,? (?:version |v\.? ?)?1\.0)?", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution license(?:,? (?:version |v\.? ?)?1\.0)?", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and license", r"opendatacommons\.org/licenses/pddl"),
    ("cc0-1.0", "cc0", r"cc0(?:[ -]1\.0)?(?: universal)?", r"creativecommons\.org/publicdomain/zero"),
)

# Creative Commons terms; each in four versions and without one, by name, code and address.
CC_TERMS = (
    ("by", "attribution"),
    ("by-sa", "attribution[ -]share[ -]?alike"),
    ("by-nd", "attribution[ -]no[ -]?deriv(?:ative)?s"),
    ("by-nc", "attribution[ -]non[ -]?commercial"),
    ("by-nc-sa", "attribution[ -]non[ -]?commercial[ -]share[ -]?alike"),
    ("by-nc-nd", "attribution[ -]non[ -]?commercial[ -]no[ -]?deriv(?:ative)?s"),
)
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0", None)

# Sentences that license texts hold: label, words that any match must contain, signature. A
# work may be under a text that never says its name.
BODIES = (
    ("mit", "hereby granted free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "for any purpose with or without fee", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("bsd-0-clause", "for any purpose with or without fee", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\."),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "used to endorse or promote", r"neither the name of [^\n]{1,120}?(?: [^\n]{1,120}?)?nor the names of (?:its|other)(?: [a-z]+)? ?contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "used to endorse or promote", r"the names? of the (?:author|copyright holder|contributors?)s? may not be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile sell or distribute", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "authors be held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "person or organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("apache-2.0", "use reproduction and distribution", r"terms and conditions for use, reproduction, and distribution"),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \S?as is\S? basis"),
    ("gpl-2.0", "take away your freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft license", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("agpl-3.0", "copyleft license", r"the gnu affero general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl-2.0", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation[;,] either version 2 of the license"),
    ("gpl-3.0", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license"),
    ("lgpl-2.1", "free software foundation", r"under the terms of the gnu lesser general public license as published by the free software foundation; either version 2\.1 of the license"),
    ("lgpl-3.0", "free software foundation", r"under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license"),
    ("agpl-3.0", "free software foundation", r"under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license"),
    ("gfdl", "cover texts", r"with no invariant sections, (?:with )?no front[ -]cover texts,? and (?:with )?no back[ -]cover texts"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("cddl-1.0", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1.0", "accompanying program", r"the accompanying program is provided under the terms of this eclipse public license \(.agreement.\)"),
    ("ms-pl", "bring a patent claim", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("postgresql", "without a written agreement", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("python-2.0", "psf is making", r"psf is making python available to licensee on an \S?as is\S? basis"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "reserved font name", r"no modified version of the font software may use the reserved font name"),
    ("wtfpl", "you just do what", r"you just do what the f\S+ you want to"),
    ("cc0-1.0", "a work with this deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("artistic-2.0", "standard version", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("beerware", "buy me a beer", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer"),
)

# Short forms with a version; they stand for themselves wherever they are.
ACRONYMS = (
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl[ -]?(?:version |v\.? ?)?1(?:\.0)?\+?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl[ -]?(?:version |v\.? ?)?2(?:\.0)?\+?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl[ -]?(?:version |v\.? ?)?3(?:\.0)?\+?"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl[ -]?(?:version |v\.? ?)?2(?:\.0)?\+?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl[ -]?(?:version |v\.? ?)?2\.1\+?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl[ -]?(?:version |v\.? ?)?3(?:\.0)?\+?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl[ -]?(?:version |v\.? ?)?3(?:\.0)?\+?"),
    ("gfdl-1.3", "gfdl", r"(?:gnu )?gfdl[ -]?(?:version |v\.? ?)?1\.3"),
    ("mpl-1.1", "mpl", r"mpl[ -]?(?:version |v\.? ?)?1\.1"),
    ("mpl-2.0", "mpl", r"mpl[ -]?(?:version |v\.? ?)?2(?:\.0)?"),
    ("apache-2.0", "apache", r"apache[ -](?:version |v\.? ?)?2(?:\.0)?"),
    ("apache-2.0", "asl", r"asl[ -]?(?:version |v\.? ?)?2(?:\.0)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd[ -]2[ -]clause|2[ -]clause[ -]bsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd[ -]3[ -]clause|3[ -]clause[ -]bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd[ -]4[ -]clause|4[ -]clause[ -]bsd)"),
    ("epl-1.0", "epl", r"epl[ -]?(?:version |v\.? ?)?1(?:\.0)?"),
    ("epl-2.0", "epl", r"epl[ -]?(?:version |v\.? ?)?2(?:\.0)?"),
    ("cddl-1.0", "cddl", r"cddl[ -]?(?:version |v\.? ?)?1(?:\.0)?"),
    ("eupl-1.2", "eupl", r"eupl[ -]?(?:version |v\.? ?)?1\.2"),
    ("bsl-1.0", "bsl", r"bsl[ -]1\.0"),
)

# Names that are words of their own: they count after a grant or a title only.
BARE_NAMES = ("mit", "isc", "zlib", "bsd", "apache", "gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "unlicense", "wtfpl", "postgresql")

# Template names, by falling priority, with the score of a detection.
TEMPLATES = (("tag", 1.0), ("grant", 0.95), ("body", 0.9), ("address", 0.85), ("titled", 0.75), ("name", 0.6))
BASE_SCORE = 0.5
GRANT = r"(?:licen[cs]ed|released|distributed|made available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?"

LOWER_ONLY = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

DETECTION = "array<struct<label:string, rule:string, start:long, end:long, score:double>>"
RESULT = f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, detections {DETECTION}, score double"


@dataclass(frozen=True)
class Rule:
    label: str
    template: str
    priority: int
    score: float
    keyword: bytes
    pattern: re.Pattern


def signature(label: str, template: str, keyword: str, pattern: str) -> Rule:
    priority = [name for name, _ in TEMPLATES].index(template)
    for form, gap in (("[ -]?", r"[\s*#/;|-]*"), ("[ -]", r"[\s*#/;|-]+"), (" ?", r"[\s*#/;|]*"), (" ", r"[\s*#/;|]+")):
        pattern = pattern.replace(form, gap)
    edge = "" if template == "address" else r"(?<![a-z0-9])"
    return Rule(label, template, len(TEMPLATES) - priority, TEMPLATES[priority][1], keyword.encode(), re.compile((edge + pattern).encode()))


def host_words(address: str) -> str:
    """The words of an address's host: what its gate looks for."""
    return re.match(r"[a-z]+(?:\\\.[a-z]+)+", address)[0].replace("\\.", " ")


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in the order in which they are tried: by falling priority, then as listed."""
    rows = list(LICENSES)
    for code, words in CC_TERMS:
        for version in CC_VERSIONS:
            address = rf"creativecommons\.org/licenses/{code}/"
            named = f"creative commons {words}(?: license)?"
            coded = f"cc[ -]{code.replace('-', '[ -]')}"
            if version:
                number = re.escape(version)
                rows.append((f"cc-{code}-{version}", "cc by", rf"{coded}[ -]{number}", address + number))
                rows.append((f"cc-{code}-{version}", "creative commons", rf"{named},?(?: version)? {number}", None))
            else:
                rows.append((f"cc-{code}", "cc by", rf"{coded}(?![ -]?(?:[0-9]|nc|nd|sa))", address + "(?![0-9])"))
                rows.append((f"cc-{code}", "creative commons", rf"{named}(?![ -]?(?:[0-9]|version|non|no|share))", None))
    made = []
    for label, keyword, name, address in rows:
        if address or not keyword.startswith("creative"):
            tag = rf"spdx-license-identifier: ?\(?{re.escape(label)}(?:-only|-or-later)?(?![a-z0-9.-])"
            made.append(signature(label, "tag", "spdx license identifier", tag))
        if address:
            made.append(signature(label, "address", host_words(address), rf"https?://(?:www\.)?{address}"))
        made.append(signature(label, "grant", keyword, GRANT + name))
        made.append(signature(label, "titled", keyword, rf"(?:licen[cs]e|licen[cs]ing)[:=] ?{name}"))
        made.append(signature(label, "name", keyword, name + "(?![a-z0-9])"))
    made += [signature(label, "body", keyword, pattern) for label, keyword, pattern in BODIES]
    ends = r"(?![a-z0-9]|\.[0-9])"
    for label, keyword, name in (*ACRONYMS, *[(name, name, name) for name in BARE_NAMES]):
        made.append(signature(label, "grant", keyword, GRANT + name + ends))
        made.append(signature(label, "titled", keyword, rf"(?:licen[cs]e|licen[cs]ing)[:=] ?{name}{ends}"))
        if name not in BARE_NAMES:
            made.append(signature(label, "name", keyword, name + ends))
    return tuple(sorted(made, key=lambda rule: -rule.priority))


#: The words of every match hold one of these, so a text without them is not looked at again.
STEMS = (
    b"licen", b"spdx", b"http", b"cc by", b"cc0", b"creative commons", b"bsd", b"mit no", b" under ", b"hereby granted", b"permission notice",
    b"redistribution and use", b"to endorse or", b"all advertising", b"unencumbered", b"compile sell", b"misrepresented", b"held liable",
    b"reproduction and distribution", b"your freedom", b"cover texts", b"patent claim", b"psf is", b"font software", b"you just do",
    b"with this deed", b"without fee", b"person or organization", b"written agreement", b"font name", b"standard version", b"me a beer", b"gpl", b"gfdl", b"mpl", b"apache", b" asl", b"epl", b"cddl", b"eupl", b"bsl",
)

EXPRESSION = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
OPERAND = re.compile(rb"[a-z0-9][a-z0-9.+-]*")


def expression_operands(low: bytes) -> list[tuple[int, int, int, Rule]]:
    """Licenses in a tag's expression after the first one, each in its own place; exceptions after WITH are none."""
    tags = {rule.label: rule for rule in rules() if rule.template == "tag"}
    found = []
    for expression in EXPRESSION.finditer(low):
        joint = None
        for number, operand in enumerate(OPERAND.finditer(expression[1])):
            name = operand[0].decode()
            if number % 2:
                joint = name
                if joint not in ("and", "or", "with"):
                    break
            label = re.sub(r"(?:-only|-or-later|\+)$", "", name)
            if number % 2 == 0 and joint in ("and", "or") and label in tags:
                at = expression.start(1)
                found.append((at + operand.start(), -(at + operand.end()), -tags[label].priority, tags[label]))
    return found


def suppressed(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, int, Rule]]:
    """Detections not inside another of the same or a higher priority; rows are start, -end, -priority, rule."""
    furthest: dict[int, int] = {}
    kept = []
    for item in sorted(found, key=lambda x: x[:3] + (x[3].label,)):
        _, end, priority, _ = item
        if any(level >= -priority and reach >= -end for level, reach in furthest.items()):
            continue
        furthest[-priority] = max(furthest.get(-priority, 0), -end)
        kept.append(item)
    return kept


def scan_text(text: str | None) -> tuple:
    """Values of ``RESULT`` for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_BYTES).split()
    starts: list[int] = []
    base: set[str] = set()
    line = b" " + b" ".join(words) + b" "
    if b"license" in line:
        for phrase, label in BASE_PHRASES:
            wanted, at, counted, upto = b" " + phrase.encode() + b" ", -1, 0, 0
            while (at := line.find(wanted, at + 1)) >= 0:
                counted, upto = counted + line.count(b" ", upto, at), at
                starts.append(counted)
                base.add(label)
    found = []
    if any(stem in line for stem in STEMS):
        low = raw.translate(LOWER_ONLY)
        gates: dict[bytes, bool] = {}
        for rule in rules():
            if rule.keyword not in gates:
                gates[rule.keyword] = rule.keyword in line
            if gates[rule.keyword]:
                found += [(m.start(), -m.end(), -rule.priority, rule) for m in rule.pattern.finditer(low)]
        if b"spdx" in line:
            found += expression_operands(low)
    kept = suppressed(found)
    score = max([rule.score for *_, rule in kept] + [BASE_SCORE if base else 0.0])
    place = lambda at: len(raw[:at].decode("utf-8", "surrogatepass"))
    detections = [(rule.label, rule.template, place(start), place(-end), rule.score) for start, end, _, rule in kept]
    return (
        len(words),
        len(starts),
        min(starts) if starts else None,
        max(starts) if starts else None,
        sorted(base),
        detections,
        score,
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with ``license``, a struct of ``RESULT``.

    Words and base phrases are counted in the whole text; places of detections are code
    points, ends exclusive, in order. A null or empty text has no words, empty lists and
    score 0. Rows, repeated ones included, and their columns stay; a column named
    ``license`` is replaced. Nothing is shuffled.
    """

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "score"]
        rows = pd.DataFrame([scan_text(text) for text in texts], columns=names)
        whole = {"first_word": "Int64", "last_word": "Int64"}
        rows["detections"] = [[dict(zip(("label", "rule", "start", "end", "score"), d, strict=True)) for d in found] for found in rows["detections"]]
        return rows.astype(whole)

    return replacing(docs, license=scan("text"))


def license_digest(docs: DataFrame) -> DataFrame:
    """Word counts, base phrases and labels of every document."""
    scanned = scan_licenses(docs.select("doc_id", "text"))
    found = F.transform("license.detections", lambda d: d["label"])
    labels = F.array_sort(F.array_union(F.col("license.base_labels"), found))
    return scanned.select(
        "doc_id",
        "license.n_words",
        "license.n_base",
        "license.first_word",
        "license.last_word",
        F.array_join("license.base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        "license.score",
    )
