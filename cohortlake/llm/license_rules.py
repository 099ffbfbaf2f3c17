"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame functions.

A text becomes its words (runs of a-z, 0-9 and non-ASCII after lower-casing A-Z), one blank
apart. A rule is a regex over words with a label, a keyword (or several, by ``|``) and a score; its place in the
list is its priority. Each form of a rule holds one of its keywords. Only texts that hold a keyword meet rules, and only the rules of the
keywords they hold. Detections are word intervals. Sorted by start, longest and first rule
first, a detection inside an earlier one is suppressed, so "gpl 3" within a longer notice
does not count on its own.

Phrases are separate: each place where their words stand in a row counts, and their labels
always stay.

Rows: a null text is empty and has no label and score 0. Repeated rows get equal results; texts
are read whole; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.words import bind, fold_ascii

BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    score: float


# Licence families. (label, keyword, name pattern, identifiers)
NAMED = [
    ("mit", "mit", "mit", "mit"),
    ("mit-0", "mit", "mit no attribution|mit 0", "mit 0"),
    ("apache-1", "apache", "apache (?:software )?license (?:version )?1 0", "apache 1 0"),
    ("apache-1.1", "apache", "apache (?:software )?license (?:version )?1 1", "apache 1 1"),
    ("apache-2", "apache|apl 2", "apache (?:software )?license (?:version |v )?2(?: 0)?|apache 2(?: 0)?|apl 2(?: 0)?", "apache 2 0"),
    ("bsd-0", "bsd", "zero clause bsd|bsd zero clause|0 clause bsd", "0bsd"),
    ("bsd-1", "bsd", "bsd 1 clause|one clause bsd|1 clause bsd", "bsd 1 clause"),
    ("bsd-2", "bsd|freebsd", "bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd", "bsd 2 clause"),
    ("bsd-3", "bsd", "bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd", "bsd 3 clause"),
    ("bsd-4", "bsd", "bsd 4 clause|4 clause bsd|four clause bsd|original bsd", "bsd 4 clause"),
    ("isc", "isc", "isc", "isc"),
    ("mpl-1.0", "mozilla", "mozilla public license (?:version |v )?1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public license (?:version |v )?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license (?:version |v )?2(?: 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license (?:version |v )?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public license (?:version |v )?2(?: 0)?", "epl 2 0"),
    ("cddl-1.0", "common development", "common development and distribution license(?: version)?(?: 1 0)?", "cddl 1 0"),
    ("cddl-1.1", "common development", "common development and distribution license(?: version)? 1 1", "cddl 1 1"),
    ("cpl-1.0", "common public", "common public license(?: version)?(?: 1 0)?", "cpl 1 0"),
    ("eupl-1.1", "european union", "european union public licen[cs]e (?:version |v )?1 1", "eupl 1 1"),
    ("eupl-1.2", "european union", "european union public licen[cs]e (?:version |v )?1 2", "eupl 1 2"),
    ("artistic-1.0", "artistic", "artistic license (?:version )?1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic license (?:version )?2(?: 0)?", "artistic 2 0"),
    ("boost-1.0", "boost", "boost software license(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl|do what the fuck", "wtfpl|do what the fuck you want to public license", "wtfpl"),
    ("python-2.0", "python|psf license", "python software foundation license(?: version 2)?|psf license", "python 2 0"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("ofl-1.1", "open font", "sil open font license(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("odbl-1.0", "open database|odbl", "open database license|odbl", "odbl 1 0"),
    ("odc-by-1.0", "open data commons", "open data commons attribution license", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication", "public domain dedication and license", "pddl 1 0"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("ncsa", "illinois|ncsa open", "university of illinois ncsa open source license|ncsa open source license", "ncsa"),
    ("upl-1.0", "universal permissive", "universal permissive license(?: version)?(?: 1 0)?", "upl 1 0"),
    ("sspl-1.0", "server side", "server side public license(?: version)?(?: 1)?", "sspl 1 0"),
    ("busl-1.1", "business source", "business source license(?: version)?(?: 1 1)?", "busl 1 1"),
    ("elastic-2.0", "elastic", "elastic license (?:version )?2(?: 0)?", "elastic 2 0"),
    ("llama-2", "llama", "llama 2 community license(?: agreement)?", "llama2"),
    ("openrail-m", "openrail|open rail", "(?:creativeml |bigscience )?(?:open rail m|openrail m)", "openrail m"),
]
# Wordings of a notice. {name} stands for a licence's name pattern.
WORDINGS = [
    ("(?:released|licensed|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)?(?: version)?", 1.0),
    ("(?:subject to|governed by|in accordance with) (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)?", 0.9),
    ("(?:the )?(?:{name}) licen[cs]e", 0.8),
    ("licen[cs]e (?:{name})", 0.8),
]
# A name that says it is a licence needs no wording around it: the title of a licence file.
TITLE = re.compile("licen|do what the fuck")
# Identifiers that are more than one common word stand alone, too.
PLAIN_IDENTIFIER = re.compile("[0-9]|ms pl|ms rl|odbl")
GNU = [("gpl", "(?:gnu )?general public licen[cs]e|gnu gpl|gpl"), ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e|lgpl"), ("agpl", "(?:gnu )?affero general public licen[cs]e|agpl"), ("fdl", "gnu free documentation licen[cs]e|gfdl")]
GNU_VERSIONS = {"gpl": "1 2 3", "lgpl": "2 2.1 3", "agpl": "1 3", "fdl": "1.1 1.2 1.3"}
CC_PARTS = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s", "nc": "non ?commercial"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
# Notices without a family. (label, keyword, pattern, score)
NOTICES = [
    ("bsd-3", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("bsd-4", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.9),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-1.1", "contents of this file", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl-2.0", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0", 1.0),
    ("epl-1.0", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1 0", 1.0),
    ("apache-2", "may not use this file", "you may not use this file except in compliance with the license", 0.7),
    ("gpl-2-or-later", "version 2 of the license", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 1.0),
    ("gpl-3-or-later", "version 3 of the license", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 1.0),
    ("lgpl-2.1-or-later", "version 2 1 of the license", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", 1.0),
    ("lgpl-3-or-later", "version 3 of the license", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", 1.0),
    ("agpl-3-or-later", "version 3 of the license", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", 1.0),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.9),
    ("boost-1.0", "boost software license", "distributed under the boost software license version 1 0", 1.0),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "do what the fuck", "you just do what the fuck you want to", 0.9),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee", 1.0),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification", 0.9),
    ("public-domain", "public domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain", 0.9),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0-1.0", "creative commons", "creative commons zero(?: v?1 0)?(?: universal)?", 0.9),
    ("proprietary", "all rights reserved", "all rights reserved", 0.5),
    ("proprietary", "proprietary", "proprietary and confidential", 0.7),
    ("proprietary", "not for", "not for (?:redistribution|resale|commercial use)", 0.5),
    ("unknown-license", "licensed under", "licensed under", 0.2),
    ("unknown-license", "released under", "released under", 0.2),
    ("unknown-license", "spdx license identifier", "spdx license identifier", 0.2),
]


def rules() -> list[Rule]:
    """The rules in order; several hundred, spelled out from families and wordings."""
    out = []

    def words(version: str) -> str:
        return version.replace(".", " ").replace("-", " ")

    def forms(label: str, keyword: str, name: str, spdx: str) -> None:
        out.append(Rule(label, "spdx license identifier", f"spdx license identifier {spdx}", 1.0))
        for wording, score in WORDINGS:
            out.append(Rule(label, keyword, wording.replace("{name}", name), score))
        # Alternatives of the name, not those inside its groups.
        titles = "|".join(part for part in re.split(r"[|](?![^(]*[)])", name) if TITLE.search(part))
        if titles:
            out.append(Rule(label, keyword, f"(?:the )?(?:{titles})", 0.7))
        if PLAIN_IDENTIFIER.search(spdx):
            out.append(Rule(label, spdx, spdx, 0.7))

    for family, name in GNU:
        key = {"gpl": "general public", "lgpl": "general public", "agpl": "affero", "fdl": "documentation"}[family]
        keys = f"{key}|" + ("fdl|gfdl" if family == "fdl" else family)
        for version in GNU_VERSIONS[family].split():
            number = words(version) + ("(?: 0)?" if "." not in version else "")
            label = f"{family}-{version}"
            full = f"(?:{name}) (?:version |v ?)?{number}"
            for suffix, tail in (("-or-later", " or (?:any )?later(?: version)?| or at your option any later version"), ("-only", " only")):
                out.append(Rule(label + suffix, "spdx license identifier", f"spdx license identifier {family} {words(version)}(?: 0)?{suffix.replace('-', ' ')}", 1.0))
                out.append(Rule(label + suffix, keys, f"(?:under (?:the )?)?(?:terms of (?:the )?)?{full}(?:{tail})", 1.0))
            # A bare identifier, and one whose plus sign is no word.
            out.append(Rule(label, "spdx license identifier", f"spdx license identifier {family} {words(version)}(?: 0)?", 1.0))
            out.append(Rule(label, keys, f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{full}", 1.0))
            out.append(Rule(label, keys, full, 0.8))
            out.append(Rule(label, f"{family}v{version[0]}", f"(?:licensed under (?:the )?)?{family}v{words(version)}(?: 0)?", 0.8))
            out.append(Rule(label, "gnu org", f"gnu org licenses (?:old licenses )?{family} {words(version)}(?: 0)?", 0.9))
    for parts in CC_PARTS:
        long_name = " ?".join(CC_WORDS[p] for p in parts.split("-"))
        for version in CC_VERSIONS:
            label = f"cc-{parts}-{version}"
            out.append(Rule(label, "cc by", f"(?:licensed under )?(?:the )?cc {words(parts)} {words(version)}", 1.0))
            out.append(Rule(label, "creative commons", f"creative commons {long_name} {words(version)}(?: international| unported| generic)?", 1.0))
            out.append(Rule(label, "creativecommons", f"creativecommons org licenses {words(parts)} {words(version)}", 0.9))
        out.append(Rule(f"cc-{parts}", "cc by", f"cc {words(parts)}", 0.6))
        out.append(Rule(f"cc-{parts}", "creative commons", f"creative commons {long_name}", 0.6))
    for label, keyword, name, spdx in NAMED:
        forms(label, keyword, name, spdx)
    out += [Rule(*notice) for notice in NOTICES]
    return out


def as_words(text: Column) -> Column:
    """The words with one blank before, between and after; a single blank without words."""
    bare = F.regexp_replace(fold_ascii(F.coalesce(text, F.lit(""))), BREAKS, " ")
    inside = F.btrim(bare)
    return F.when(inside == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inside, F.lit(" ")))


def _blanks(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(padded: Column, phrases: dict[str, str]) -> Column:
    """``n, first, last, labels`` of the places where a phrase's words stand in a row."""
    doubled = F.replace(padded, F.lit(" "), F.lit("  "))

    def look(text: Column) -> Column:
        found = []
        for phrase, label in phrases.items():
            needle = " " + phrase.replace(" ", "  ") + " "
            width = phrase.count(" ") + 1
            n = (F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)
            head, tail = (F.substring_index(text, needle, k) for k in (1, -1))
            # Two blanks stand before each word of the head; two after each word of the tail.
            found.append(
                F.when(
                    F.contains(text, F.lit(needle)),
                    F.struct(
                        n.cast("long").alias("n"),
                        ((_blanks(head) - 1) / 2).cast("long").alias("first"),
                        ((_blanks(text) / 2 - 1) - (_blanks(tail) - 1) / 2 - width).cast("long").alias("last"),
                        F.lit(label).alias("label"),
                    ),
                )
            )
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return bind(
        bind(doubled, look),
        lambda hits: F.struct(
            F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"),
            F.array_min(F.transform(hits, lambda x: x["first"])).alias("first"),
            F.array_max(F.transform(hits, lambda x: x["last"])).alias("last"),
            F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))).alias("labels"),
        ),
    )


def detections(padded: Column, signature: list[Rule]) -> Column:
    """``start, end, place, label, score`` of the rules' matches in one text, as an array."""
    keywords = sorted({r.keyword for r in signature})
    families = F.array(
        *[
            F.struct(
                F.array(*[F.lit(" " + x) for x in k.split("|")]).alias("keywords"),
                F.array(
                    *[
                        F.struct(
                            F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"),
                            F.lit(i).alias("place"),
                            F.lit(r.label).alias("label"),
                            F.lit(r.score).alias("score"),
                        )
                        for i, r in enumerate(signature)
                        if r.keyword == k
                    ]
                ).alias("rules"),
            )
            for k in keywords
        ]
    )
    spans = "array<struct<start:int,end:int>>"

    def matches(text: Column, pattern: Column) -> Column:
        """Word intervals: the words before a match are those of the gaps and matches before it."""
        return bind(
            F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")),
            lambda m: F.aggregate(
                m["hits"],
                F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.array().cast(spans).alias("spans")),
                lambda acc, hit: bind(
                    acc["at"] + _blanks(F.element_at(m["gaps"], acc["k"] + 1)) - 1,
                    lambda start: F.struct(
                        (acc["k"] + 1).alias("k"),
                        (start + _blanks(hit) + 1).alias("at"),
                        F.concat(
                            acc["spans"], F.array(F.struct(start.alias("start"), (start + _blanks(hit) + 1).alias("end")))
                        ).alias("spans"),
                    ),
                ),
                lambda acc: acc["spans"],
            ),
        )

    def of_rule(text: Column, rule: Column) -> Column:
        return F.transform(
            matches(text, rule["pattern"]),
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), rule["place"].alias("place"),
                rule["label"].alias("label"), rule["score"].alias("score"),
            ),
        )

    present = F.filter(families, lambda f: F.exists(f["keywords"], lambda k: F.contains(padded, k)))
    active = F.flatten(F.transform(present, lambda f: f["rules"]))
    return F.flatten(F.transform(active, lambda r: of_rule(padded, r)))


def kept_labels(found: Column) -> Column:
    """``labels, score`` after suppression: one pass over the detections by start, longest, first rule."""
    ordered = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(
                d["start"].alias("start"), (-d["end"]).alias("minus_end"), d["place"].alias("place"),
                d["label"].alias("label"), d["score"].alias("score"),
            ),
        )
    )
    start = F.struct(
        F.lit(-1).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score")
    )
    return F.aggregate(
        ordered,
        start,
        lambda acc, d: F.when(-d["minus_end"] <= acc["reach"], acc).otherwise(
            F.struct(
                (-d["minus_end"]).alias("reach"),
                F.array_union(acc["labels"], F.array(d["label"])).alias("labels"),
                F.greatest(acc["score"], d["score"]).alias("score"),
            )
        ),
        lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")),
    )


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] | None = None,
    signature: list[Rule] | None = None,
) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row."""
    phrases = PHRASES if phrases is None else phrases
    signature = rules() if signature is None else signature
    # Every keyword is a word start, so the prefilter is one search for any of them.
    gate = "(?: )(?:" + "|".join(sorted({r.keyword for r in signature})) + ")"
    none = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def whole(padded: Column) -> Column:
        rules_found = F.when(padded.rlike(gate), kept_labels(detections(padded, signature))).otherwise(none)
        return F.struct(
            (_blanks(padded) - 1).cast("long").alias("n_words"),
            phrase_places(padded, phrases).alias("base"),
            rules_found.alias("more"),
        )

    rows = df.select(F.col(id_col).alias("id"), bind(as_words(F.col(text)), whole).alias("s"))
    labels = F.array_sort(F.array_union("s.base.labels", "s.more.labels"))
    score = F.when(F.col("s.base.n") > 0, F.lit(1.0)).otherwise(F.col("s.more.score"))
    return rows.select(
        "id",
        F.col("s.n_words").alias("n_words"),
        F.col("s.base.n").alias("n_base"),
        F.col("s.base.first").alias("first_word"),
        F.col("s.base.last").alias("last_word"),
        F.array_join("s.base.labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
