"""License detection by ordered signature rules, in built-in expressions only.

A text is reduced to its words, each with a space of its own on both sides, so a phrase cannot match
inside a word and neighbouring matches share no character. Cheap substring tests decide which rules
run at all: first one for the whole set, then the keyword of each rule. The matches of all rules are
then resolved in one sweep from left to right: a match inside another one of the same or a higher
priority is suppressed. Running states go over blocks of an array, so time grows with the matches of
a text and not with their square.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of the contract and their labels.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Label, keyword that any text with the license must hold, and a regex for its name in words.
LICENSES = (
    ("agpl-1.0", "affero", "affero general public license(?: version| v)? 1"),
    ("agpl-3.0", "affero", "(?:gnu )?affero (?:general public license|gpl)(?: version| v)? 3"),
    ("agpl-3.0-short", "agpl", "(?:gnu )?agpl ?(?:v)?3"),
    ("gpl-1.0", " general ", "(?:gnu )?general public license(?: version| v)? 1"),
    ("gpl-2.0", " general ", "(?:gnu )?general public license(?: version| v)? 2"),
    ("gpl-3.0", " general ", "(?:gnu )?general public license(?: version| v)? 3"),
    ("gpl-any", " general ", "(?:gnu )?general public license"),
    ("gpl-2.0-short", "gpl", "(?:gnu )?gpl ?(?:v)?2"),
    ("gpl-3.0-short", "gpl", "(?:gnu )?gpl ?(?:v)?3"),
    ("lgpl-2.0", " general ", "(?:gnu )?library general public license(?: version| v)? 2"),
    ("lgpl-2.1", " lesser ", "(?:gnu )?lesser general public license(?: version| v)? 2 1"),
    ("lgpl-3.0", " lesser ", "(?:gnu )?lesser general public license(?: version| v)? 3"),
    ("lgpl-any", " lesser ", "(?:gnu )?lesser general public license"),
    ("gfdl", "documentation", "(?:gnu )?free documentation license"),
    ("apache-1.1", " apache ", "apache (?:software )?license(?: version| v)? 1 1"),
    ("apache-2.0", " apache ", "apache (?:software )?license(?: version| v)? 2(?: 0)?"),
    ("apache-any", " apache ", "apache (?:software )?license"),
    ("mit", " mit ", "mit license"),
    ("mit", "expat", "expat license"),
    ("mit", " x11 ", "x11 license"),
    ("mit-0", " mit ", "mit no attribution(?: license)?"),
    ("isc", " isc ", "isc license"),
    ("bsd-2-clause", " bsd ", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) license"),
    ("bsd-3-clause", " bsd ", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd) license"),
    ("bsd-4-clause", " bsd ", "(?:original bsd|bsd 4 clause|4 clause bsd) license"),
    ("bsd-any", " bsd ", "bsd(?: style)? license"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? 2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?"),
    ("eupl", "european", "european union public licen[cs]e"),
    ("cddl", "distribution", "common development and distribution license"),
    ("cpl", " common ", "common public license"),
    ("artistic", " artistic ", "artistic license"),
    ("zlib", " zlib ", "zlib(?: libpng)? license"),
    ("boost", " boost ", "boost software license"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("python", " python ", "python (?:software foundation )?license"),
    ("openssl", "openssl", "openssl license"),
    ("ofl", " font ", "(?:sil )?open font license"),
    ("odbl", "database", "open (?:data commons open )?database license"),
    ("cc0", "cc0", "(?:creative commons )?cc0"),
    ("cc-by", " commons ", "creative commons attribution"),
    ("cc-by-sa", " commons ", "creative commons attribution share ?alike"),
    ("cc-by-nc", " commons ", "creative commons attribution non ?commercial"),
    ("cc-by-nd", " commons ", "creative commons attribution no ?deriv(?:atives|s)"),
    ("cc-by-short", " cc ", "cc by(?: [1-4] [0-9])?"),
    ("cc-by-sa-short", " cc ", "cc by sa(?: [1-4] [0-9])?"),
    ("public-domain", " domain ", "public domain"),
    ("proprietary", "proprietary", "proprietary(?: software)? license"),
)

#: Priority and frame of a rule; ``{name}`` is the license's name. Every license takes every frame.
FRAMES = (
    (90, "spdx license identifier {name}"),
    (80, "(?:licen[cs]ed|released|distributed|published|provided|available) under (?:the )?"
         "(?:terms of (?:the )?|conditions of (?:the )?)?{name}"),
    (80, "(?:redistribute|modify|use)(?: it)? under (?:the )?(?:terms of (?:the )?)?{name}"),
    (70, "(?:subject to|governed by|covered by|terms of|copy of) (?:the )?(?:terms of (?:the )?)?{name}"),
    (60, "licen[cs]e (?:is )?(?:the )?{name}"),
    (50, "{name}"),
)

#: Rules that belong to no single license.
NOTICES = (
    (40, "copyright-notice", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
    (40, "all-rights-reserved", "reserved", "all rights reserved"),
    (30, "as-is-clause", "warranty", "as is without warranty of any kind"),
    (30, "permission-grant", "permission", "permission is hereby granted free of charge"),
    (30, "redistribution-clause", "redistribution", "redistribution and use in source and binary forms"),
    (20, "license-mention", "licens", "licensed under"),
)

#: Wordings of license texts, headers and notices themselves. Priority, label, keyword, words.
#: 85: a grant or header that names one license; 65: a passage of one license's text; 35: a clause of many.
WORDINGS = (
    (85, "mit", "obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (65, "mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (65, "mit", "sublicense", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    (65, "x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    (85, "isc", " fee ", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    (65, "isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    (85, "hpnd", " fee ", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    (65, "hpnd", "representations", "makes no representations about the suitability of this software for any purpose"),
    (65, "bsd-any", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (65, "bsd-any", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    (65, "bsd-3-clause", "endorse", "(?:nor the names of its contributors|nor the names of other contributors) may be used to endorse or promote products derived from this software"),
    (65, "bsd-4-clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (65, "bsd-any", "regents", "the regents of the university of california"),
    (35, "bsd-disclaimer", "contributors", "this software is provided by the copyright holders and contributors as is"),
    (85, "apache-2.0", " apache ", "licensed under the apache license version 2 0 the license"),
    (85, "apache-2.0", " apache ", "you may not use this file except in compliance with the license you may obtain a copy of the license at http(?:s)? www apache org licenses license 2 0"),
    (65, "apache-2.0", "agreements", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    (65, "apache-2.0", " apache ", "apache org licenses license 2 0"),
    (65, "apache-2.0", "irrevocable", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"),
    (65, "apache-2.0", "irrevocable", "perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    (65, "apache-1.1", " apache ", "this product includes software developed by the apache software foundation"),
    (35, "apache-header", "compliance", "you may not use this file except in compliance with the license"),
    (35, "apache-header", "governing", "see the license for the specific language governing permissions and limitations under the license"),
    (85, "gpl-2.0", " general ", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or"),
    (85, "gpl-3.0", " general ", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or"),
    (85, "gpl-2.0", " general ", "under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation"),
    (85, "gpl-3.0", " general ", "under the terms of the gnu general public license version 3(?: only)? as published by the free software foundation"),
    (85, "lgpl-2.0", " library ", "under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or"),
    (85, "lgpl-2.1", " lesser ", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or"),
    (85, "lgpl-3.0", " lesser ", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or"),
    (85, "agpl-3.0", "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or"),
    (65, "gpl-any", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    (65, "lgpl-any", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    (65, "gpl-any", "received", "you should have received a copy of the gnu general public license along with this (?:program|software|library)"),
    (65, "lgpl-any", "received", "you should have received a copy of the gnu lesser general public license along with this (?:program|software|library)"),
    (65, "agpl-3.0", "received", "you should have received a copy of the gnu affero general public license along with this (?:program|software|library)"),
    (65, "gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    (65, "gpl-2.0", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    (65, "gpl-any", "everyone", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    (65, "agpl-3.0", "interacting", "all users interacting with it remotely through a computer network"),
    (65, "gpl-exception", "exception", "(?:classpath|gcc runtime library|linking|font) exception"),
    (65, "gpl-exception", "exception", "as a special exception the copyright holders of this (?:library|program|font) give you permission"),
    (85, "gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (65, "gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    (85, "mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (85, "mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    (65, "mpl-2.0", "mozilla", "mozilla org mpl 2 0"),
    (65, "mpl-2.0", "secondary", "incompatible with secondary licenses as defined by the mozilla public license"),
    (85, "epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    (85, "epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0"),
    (65, "epl-2.0", "eclipse", "eclipse org legal epl 2 0"),
    (65, "epl-1.0", "eclipse", "eclipse org legal epl v10"),
    (85, "eupl", "eupl", "licensed under the eupl version 1 [12]"),
    (85, "cddl", "development", "the contents of this file are subject to the terms of the common development and distribution license"),
    (65, "cpl", "recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    (65, "artistic", " package ", "the intent of this document is to state the conditions under which a package may be copied"),
    (65, "artistic", "perl", "(?:under|on) the same terms as perl itself"),
    (85, "zlib", "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    (65, "zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (65, "zlib", "plainly", "altered source versions must be plainly marked as such"),
    (85, "boost", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (65, "boost", " boost ", "distributed under the boost software license version 1 0"),
    (85, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (65, "unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    (85, "wtfpl", " fuck ", "do what the fuck you want to public license"),
    (65, "python", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    (65, "python", "python", "psf is making python available to licensee on an as is basis"),
    (65, "openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    (65, "openssl", "cryptographic", "this product includes cryptographic software written by eric young"),
    (85, "ofl", " font ", "this font software is licensed under the sil open font license"),
    (65, "ofl", " font ", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself"),
    (65, "odbl", "database", "made available under the open database license"),
    (65, "odbl", "database", "any rights in individual contents of the database are licensed under the database contents license"),
    (85, "cc0", "dedicated", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    (65, "cc0", "publicdomain", "creativecommons org publicdomain zero 1 0"),
    (65, "cc-by", "creativecommons", "creativecommons org licenses by [1-4] [0-9]"),
    (65, "cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] [0-9]"),
    (65, "cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] [0-9]"),
    (65, "cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] [0-9]"),
    (65, "cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] [0-9]"),
    (65, "cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] [0-9]"),
    (65, "cc-any", "commons", "(?:this work is|except where otherwise noted content on this site is) licensed under a creative commons"),
    (65, "beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    (65, "ncsa", "ncsa", "university of illinois ncsa open source license"),
    (65, "postgresql", "paragraphs", "provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    (65, "curl", "holder", "except as contained in this notice the name of a copyright holder shall not be used"),
    (65, "unicode", "unicode", "unicode data files and any associated documentation"),
    (65, "vim", " vim ", "vim is charityware"),
    (65, "ms-pl", "microsoft", "microsoft public license"),
    (65, "ms-rl", "microsoft", "microsoft reciprocal license"),
    (65, "sspl", "server", "server side public license"),
    (65, "busl", "business", "business source license"),
    (65, "elastic", "elastic", "elastic license(?: 2 0)?"),
    (65, "commons-clause", "commons", "commons clause license condition"),
    (65, "polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict) license"),
    (65, "rail", " rail ", "(?:creativeml )?open rail(?: m)? license"),
    (65, "llama", "llama", "llama(?: [23])? community license(?: agreement)?"),
    (35, "public-domain-dedication", " domain ", "(?:released|placed|dedicated)(?: in| to| into) the public domain"),
    (35, "confidential", "confidential", "confidential and proprietary"),
    (35, "confidential", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    (35, "no-reproduction", "reproduced", "no part of this (?:publication|book|work|document) may be reproduced"),
    (35, "non-commercial", "commercial", "for non ?commercial use only"),
    (35, "research-only", "research", "for research purposes only"),
    (35, "no-derivatives", "derivative", "no derivative works"),
    (35, "liability-clause", "liable", "in no event shall the (?:authors or copyright holders|copyright holders?|author) be liable"),
    (35, "merchantability-clause", "merchantability", "the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (35, "merchantability-clause", "merchantability", "implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    (35, "patent-grant", "patent", "grants you a (?:perpetual )?worldwide (?:royalty free )?non exclusive (?:royalty free )?patent license"),
    (35, "trademark-clause", "trademarks", "does not grant permission to use the trade names trademarks service marks or product names"),
    (35, "end-user-agreement", "agreement", "end user licen[cs]e agreement"),
    (35, "dual-license", " dual ", "dual licen[cs]ed"),
    (35, "spdx-tag", "spdx", "spdx license identifier"),
    (35, "license-file", "license", "see (?:the )?license(?: file)? (?:for details|for more information|in the project root)"),
)

#: A text without any of these substrings matches no rule.
GATE = ("licen", "copyright", "reserved", "warrant", "permission", "redistribution", "gpl", "cc0", " cc ",
        "wtfpl", "commons ", " domain ", "affero", " attribution ", "software", "exception", "confidential",
        "unauthorized", "reproduced", "commercial", "research", "derivative", "liable", "interacting", "perl",
        "beer", "invariant", "eclipse", "mozilla", "altered", "regents", "charityware", "unicode", "agreement",
        " package ", "psf", "apache")

#: Items over which a running state is carried in one go; its outputs are copied once per item of a block.
BLOCK = 256

_MATCHES = "array<struct<start:int,neg_end:int,neg_priority:int,label:string>>"

_WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    pattern: str


def _spaced(pattern: str) -> str:
    """A pattern of words as a regex over :func:`spaced_words`, where a gap is two spaces."""
    return " " + pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + " "


def signature_rules() -> list[Rule]:
    """All rules, highest priority first: names in their frames, wordings of the texts, notices."""
    framed = [
        Rule(priority, label.removesuffix("-short"), keyword, _spaced(frame.replace("{name}", name)))
        for priority, frame in FRAMES
        for label, keyword, name in LICENSES
    ]
    notices = [Rule(priority, label, keyword, _spaced(p)) for priority, label, keyword, p in WORDINGS + NOTICES]
    return sorted(framed + notices, key=lambda r: -r.priority)


def spaced_words(text: Column) -> Column:
    """The words of a text in lower case, each as ``" word "``; empty for null or no words.

    The Kelvin sign is the one character beyond ASCII whose lower case is an ASCII letter; it is
    swapped first, so that only A-Z turn into a-z.
    """
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ķ")))
    words = F.trim(F.regexp_replace(lowered, _WORD_GAP, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def word_count(spaced: Column) -> Column:
    gaps = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))
    return (gaps / 2).cast("long")


def _places(spaced: Column, phrase: str) -> Column:
    """Number of places, first and last start of a phrase; its words have spaces of their own, so
    occurrences cannot share a character and removing them counts them."""
    needle = _spaced(phrase)
    n = (F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(needle), F.lit("")))) / F.lit(len(needle))
    before = word_count(F.substring_index(spaced, needle, 1))
    after = word_count(F.substring_index(spaced, needle, -1))
    last = word_count(spaced) - after - F.lit(len(phrase.split()))
    found = F.contains(spaced, F.lit(needle))
    return F.struct(
        F.when(found, n.cast("long")).otherwise(F.lit(0).cast("long")).alias("n"),
        F.when(found, before).alias("first"),
        F.when(found, last).alias("last"),
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _scanned(items: Column, start: Column, advance, emit, none: Column) -> Column:
    """The arrays ``emit(state, item)`` in a row, where ``advance(state, item)`` is the next state.

    A state that carried all its outputs would copy them for every item. So blocks are passed twice: for
    the state before each block, and from there for the outputs of that block alone.
    """

    def cut(whole: Column) -> Column:
        last = F.floor(F.greatest(F.size(whole) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(whole, b * BLOCK + 1, F.lit(BLOCK)))

    def opened(blocks: Column) -> Column:
        before = F.aggregate(
            blocks,
            F.struct(start.alias("now"), F.slice(F.array(start), 1, 0).alias("seen")),
            lambda acc, block: F.struct(
                F.aggregate(block, acc["now"], advance).alias("now"),
                F.concat(acc["seen"], F.array(acc["now"])).alias("seen"),
            ),
            lambda acc: acc["seen"],
        )
        return F.flatten(
            F.zip_with(
                blocks,
                before,
                lambda block, state: F.aggregate(
                    block,
                    F.struct(state.alias("now"), none.alias("out")),
                    lambda acc, item: F.struct(
                        advance(acc["now"], item).alias("now"), F.concat(acc["out"], emit(acc["now"], item)).alias("out")
                    ),
                    lambda acc: acc["out"],
                ),
            )
        )

    return _let(items, lambda whole: _let(cut(whole), opened))


def _matches(spaced: Column, rule: Column) -> Column:
    """Every match of one rule as (start, -end, -priority, label), from the lengths between matches."""
    none = F.array().cast(_MATCHES)

    def located(found: Column) -> Column:
        between = F.split(spaced, rule["pattern"], F.lit(-1))
        step = F.zip_with(found, between, lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len")))
        # zip_with pads the shorter list: the piece after the last match has no match.
        step = F.filter(step, lambda s: s["len"].isNotNull())

        def match(at: Column, s: Column) -> Column:
            begin, end = at + s["gap"], at + s["gap"] + s["len"]
            return F.array(
                F.struct(
                    begin.alias("start"), (-end).alias("neg_end"), (-rule["priority"]).alias("neg_priority"), rule["label"].alias("label")
                )
            )

        scanned = _scanned(step, F.lit(0), lambda at, s: at + s["gap"] + s["len"], match, none)
        return F.when(F.size(found) > 0, scanned).otherwise(none)

    return _let(F.regexp_extract_all(spaced, rule["pattern"], F.lit(0)), located)


def _kept(ordered: Column, priorities: Sequence[int]) -> Column:
    """The matches that lie inside no other match of the same or a higher priority; of equal ones the first.

    In order of start, longer and stronger first, whatever contains a match comes before it. So one
    running maximum of the ends for each priority decides.
    """
    none = F.array().cast(_MATCHES)

    def advance(ends: Column, m: Column) -> Column:
        end, priority = -m["neg_end"], -m["neg_priority"]
        return F.struct(
            *[F.when(priority == p, F.greatest(ends[f"p{p}"], end)).otherwise(ends[f"p{p}"]).alias(f"p{p}") for p in priorities]
        )

    def emit(ends: Column, m: Column) -> Column:
        inside = F.lit(False)
        for p in priorities:
            inside = inside | ((-m["neg_priority"] <= p) & (ends[f"p{p}"] >= -m["neg_end"]))
        return F.when(inside, none).otherwise(F.array(m))

    return _scanned(ordered, F.struct(*[F.lit(-1).alias(f"p{p}") for p in priorities]), advance, emit, none)


def scan_licenses(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """License phrases and signature matches of every text; one row per input row, no shuffle.

    Output: ``keys``, n_words, ``base`` (per base phrase its count, first and last start in words),
    ``detections`` (start and end in the spaced words, priority, label). Null and empty texts have no
    words and no detections; repeated rows are scanned each; other input columns are left out, so
    their names cannot clash.
    """
    rules = signature_rules()
    priorities = sorted({r.priority for r in rules})
    # One literal in place of a tree of thousands; the optimizer reads it once.
    table = F.from_json(
        F.lit(json.dumps([r._asdict() for r in rules])), "array<struct<priority:int,label:string,keyword:string,pattern:string>>"
    )
    spaced = F.col("_spaced")
    gate = F.lit(False)
    for part in GATE:
        gate = gate | F.contains(spaced, F.lit(part))
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules})])
    matches = _let(
        F.filter(keywords, lambda k: F.contains(spaced, k)),
        lambda found: F.flatten(
            F.transform(F.filter(table, lambda r: F.array_contains(found, r["keyword"])), lambda r: _matches(spaced, r))
        ),
    )
    detections = F.transform(
        _kept(F.col("_ordered"), priorities),
        lambda m: F.struct(m["start"].alias("start"), (-m["neg_end"]).alias("end"), (-m["neg_priority"]).alias("priority"), m["label"].alias("label")),
    )
    return (
        docs.select(*keys, spaced_words(F.col(text)).alias("_spaced"))
        .select(
            *keys,
            word_count(spaced).alias("n_words"),
            F.array(*[_places(spaced, phrase) for phrase, _ in BASE_PHRASES]).alias("base"),
            F.when(gate, F.sort_array(matches)).otherwise(F.array().cast(_MATCHES)).alias("_ordered"),
        )
        .select(*keys, "n_words", "base", detections.alias("detections"))
    )


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document with counts, positions and labels; ``score`` is the strongest evidence.

    Base phrases always give their label. ``score`` is the highest priority among the detections as
    a share of 100, at least 0.5 with a base phrase, and 0 without any match.
    """
    base, detections = F.col("base"), F.col("detections")
    base_labels = F.filter(
        F.array(*[F.when(base[i]["n"] > 0, F.lit(label)) for i, (_, label) in enumerate(BASE_PHRASES)]),
        lambda x: x.isNotNull(),
    )
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    strongest = F.coalesce(F.array_max(F.transform(detections, lambda d: d["priority"])), F.lit(0)) / 100
    n_base = base[0]["n"]
    for i in range(1, len(BASE_PHRASES)):
        n_base = n_base + base[i]["n"]
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform(detections, lambda d: d["label"]))).alias("labels"),
        F.when(n_base > 0, F.greatest(strongest, F.lit(0.5))).otherwise(strongest).cast("double").alias("score"),
        F.size(detections).alias("n_detections"),
    )
