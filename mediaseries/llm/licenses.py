"""License detection by ordered signature rules, in DataFrame operations only.

A rule is a regular expression over a text's words, a keyword without which it cannot match, a tier (lower wins), a
label and a weight. Texts that hold none of the gate words are only counted. In the others, the rules whose keyword is
there run, every match is an interval, and a match inside the interval of a match of a better tier (or of an equal one
that began earlier or reaches further) is suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .words import WORD_PATTERN

# The phrases that always count, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Without one of these no rule and no base phrase matches (the words ``cc by`` apart).
GATES = (
    "licen", "copyright", "copyleft", "spdx", "gpl", "commons", "domain", "reserved", "permission", "redistribution", "warrant", "cc0",
    "bsd", "wtfpl", "mulan", "attribution", "variant", "proprietary",
)

_OR_LATER = "(?: or (?:any |at your option any )?(?:later|newer)(?: version)?)?"
# Each license: label, keyword, how its title is written (words, lower case), its identifier as words.
TITLES = [
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v )?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)?" + _OR_LATER, r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)?" + _OR_LATER, r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "library general public", r"(?:gnu )?library general public licen[cs]e (?:version |v )?2(?: 0)?" + _OR_LATER, r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e (?:version |v )?2 1" + _OR_LATER, r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e (?:version |v )?3(?: 0)?" + _OR_LATER, r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e", r"lgpl"),
    ("agpl-3.0", "affero general public", r"(?:gnu )?affero general public licen[cs]e (?:version |v )?3(?: 0)?" + _OR_LATER, r"agpl 3 0(?: only| or later)?"),
    ("agpl", "affero general public", r"(?:gnu )?affero general public licen[cs]e", r"agpl"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licen[cs]e (?:version |v )?1 3" + _OR_LATER, r"gfdl 1 3(?: only| or later)?"),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation licen[cs]e (?:version |v )?1 2" + _OR_LATER, r"gfdl 1 2(?: only| or later)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", r"gfdl"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 0", r"apache 1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 1", r"apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?", r"apache 2 0"),
    ("mit", "mit", r"mit licen[cs]e", r"mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", r"mit 0"),
    ("mit-modern", "mit", r"modern mit(?: licen[cs]e| variant)", r"mit modern variant"),
    ("x11", "x11", r"x11 licen[cs]e", r"x11"),
    ("bsd-1-clause", "bsd", r"(?:1|one) clause bsd(?: licen[cs]e)?|bsd (?:1|one) clause(?: licen[cs]e)?", r"bsd 1 clause"),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?|(?:simplified|freebsd) bsd licen[cs]e", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?|original bsd licen[cs]e", r"bsd 4 clause"),
    ("0bsd", "bsd", r"(?:0|zero) clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?", r"0bsd"),
    ("bsd", "bsd", r"bsd licen[cs]e", r"bsd"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 0", r"mpl 1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?", r"mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?", r"epl 2 0"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: (?:version |v )?1(?: 0)?)?", r"edl 1 0"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e (?:version |v )?1 1", r"eupl 1 1"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e (?:version |v )?1 2", r"eupl 1 2"),
    ("eupl", "european union", r"european union public licen[cs]e", r"eupl"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: (?:version |v )?1 0)?", r"cddl 1 0"),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e (?:version |v )?1 1", r"cddl 1 1"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: (?:version |v )?1 0)?", r"cpl 1 0"),
    ("isc", "isc", r"isc licen[cs]e", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:version |v )?1 0)?", r"bsl 1 0"),
    ("bsl-1.1", "business source", r"business source licen[cs]e(?: (?:version |v )?1 1)?", r"busl 1 1"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e (?:version |v )?1 0", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:version |v )?2 0", r"artistic 2 0"),
    ("artistic", "artistic", r"artistic licen[cs]e", r"artistic"),
    ("psf-2.0", "licen", r"python software foundation licen[cs]e(?: (?:version |v )?2)?|psf licen[cs]e", r"psf 2 0"),
    ("php-3.01", "php", r"php licen[cs]e(?: (?:version |v )?3 0?1)?", r"php 3 01"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: (?:version |v )?1 1)?", r"ofl 1 1"),
    ("odbl-1.0", "open database", r"open database licen[cs]e(?: (?:version |v )?1 0)?|open data commons open database licen[cs]e", r"odbl 1 0"),
    ("odc-by-1.0", "attribution", r"open data commons attribution licen[cs]e(?: (?:version |v )?1 0)?", r"odc by 1 0"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e", r"pddl 1 0"),
    ("unlicense", "unlicense", r"the unlicense|unlicense licen[cs]e", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?", r"wtfpl"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?: (?:version |v )?1)?", r"sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?", r"elastic 2 0"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", r"ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: (?:version |v )?3 0)?", r"afl 3 0"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: (?:version |v )?3 0)?", r"osl 3 0"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: (?:version |v )?1 0)?", r"upl 1 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", r"ncsa"),
    ("mulan-2.0", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: (?:version |v )?2)?", r"mulanpsl 2 0"),
    ("llama", "llama", r"llama (?:2 |3 |3 1 )?community licen[cs]e", r"llama"),
    ("openrail", "licen", r"(?:creativeml )?open ?rail(?: m)? licen[cs]e|responsible ai licen[cs]e", r"openrail"),
]
# The parts of a Creative Commons license: label, short words, long words.
COMMONS = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nd", "by nd", "attribution no ?deriv(?:atives|ative works|s)"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:atives|ative works|s)"),
]
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Passages of license texts and notices: label, keyword, tier, weight, words.
NOTICES = [
    ("mit", "permission is hereby granted", 1, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", 1, 0.95, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", 1, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2.0", "apache", 1, 0.95, r"(?:https? )?www apache org licenses license 2 0"),
    ("mit", "opensource", 1, 0.9, r"(?:https? )?opensource org licenses mit"),
    ("gpl-3.0", "gnu", 1, 0.9, r"(?:https? )?www gnu org licenses gpl 3 0"),
    ("gpl", "gnu", 2, 0.9, r"(?:https? )?www gnu org licenses(?: gpl)?"),
    ("gpl", "general public", 1, 0.9, r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "gnu", 3, 0.85, r"gnu (?:general public licen[cs]e|gpl)"),
    ("apache", "apache", 3, 0.8, r"apache (?:software )?licen[cs]e"),
    ("cc0-1.0", "cc0", 2, 0.9, r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc", "commons", 4, 0.6, r"creative commons(?: licen[cs]e)?"),
    ("unlicense", "public domain", 1, 0.95, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", 3, 0.7, r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", 4, 0.5, r"public domain"),
    ("all-rights-reserved", "reserved", 3, 0.8, r"all rights reserved"),
    ("copyright", "copyright", 4, 0.4, r"copyright(?: c)?(?: [12][0-9]{3}(?: [12][0-9]{3})?)?"),
    ("proprietary", "proprietary", 2, 0.8, r"proprietary (?:and confidential|licen[cs]e)"),
    ("commercial", "commercial", 3, 0.6, r"commercial licen[cs]e"),
    ("copyleft", "copyleft", 4, 0.4, r"copyleft"),
    ("as-is", "warrant", 4, 0.3, r"without warranty of any kind|provided as is without warrant(?:y|ies)"),
    ("unknown", "licen", 5, 0.2, r"(?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?[a-z0-9]+ licen[cs]e"),
]

_GRANT = r"(?:licensed|released|distributed|available|provided|published|covered|shared) (?:freely )?(?:under|by) (?:the )?(?:terms of )?(?:the )?"
_BLANK = "  "
#: Matches that are folded together.
BLOCK = 128


def rules() -> list[dict]:
    """All rules in order. Patterns are over words with one blank on either side of each, so two between neighbours."""
    made: list[tuple[str, str, int, float, str]] = []
    for label, keyword, title, identifier in TITLES:
        made.append((label, "spdx", 0, 1.0, rf"spdx licen[cs]e identifier {identifier}"))
        made.append((label, keyword, 1, 0.95, rf"{_GRANT}(?:{title})"))
        made.append((label, keyword, 2, 0.85, title))
    for label, short, long in COMMONS:
        made += [
            (f"cc-{label}-{v.replace(' ', '.')}", "cc", 1, 0.95, rf"(?:{_GRANT})?cc {short} (?:version |v )?{v}") for v in COMMONS_VERSIONS
        ]
        made += [
            (f"cc-{label}-{v.replace(' ', '.')}", "commons", 1, 0.95, rf"(?:{_GRANT})?creative commons {long}(?: international| unported)? (?:licen[cs]e )?{v}")
            for v in COMMONS_VERSIONS
        ]
        made.append((f"cc-{label}", "cc", 2, 0.85, rf"cc {short}"))
        made.append((f"cc-{label}", "commons", 2, 0.85, rf"creative commons {long}(?: licen[cs]e)?"))
    made += NOTICES
    return [
        {
            "keyword": f" {keyword}".replace(" ", _BLANK)[1:],
            "tier": tier,
            "label": label,
            "weight": weight,
            "pattern": f" (?:{pattern.replace(' ?', '(?:  )?').replace(' ', _BLANK).replace('(?:    )?', '(?:  )?')}) ",
        }
        for label, keyword, tier, weight, pattern in made
    ]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DETECTION = "array<struct<low:int,high:int,tier:int,label:string,weight:double>>"
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
_CC_BY = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(values: Column) -> Column:
    """An array in arrays of ``BLOCK``. What is folded to a new array is folded within these, so that many matches
    are not copied once for each of them."""
    count = F.greatest(F.ceil(F.size(values) / BLOCK).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))


def _before(numbers: Column) -> Column:
    """For each of an array of ints the sum of those before it."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))

    def add(state, n):
        return F.struct((state["sum"] + n).alias("sum"), F.concat(state["before"], F.array(state["sum"])).alias("before"))

    def joined(parts):
        shifts = F.aggregate(parts, start, lambda state, part: add(state, part["sum"]), lambda state: state["before"])
        return F.flatten(F.zip_with(parts, shifts, lambda part, shift: F.transform(part["before"], lambda n: n + shift)))

    return _let(F.transform(_blocks(numbers), lambda block: F.aggregate(block, start, add)), joined)


def _matches(text: Column, pattern: Column) -> Column:
    """What stands before each match, and the match."""
    steps = F.zip_with(
        F.split(text, pattern), F.regexp_extract_all(text, pattern, F.lit(0)), lambda b, m: F.struct(b.alias("between"), m.alias("match"))
    )
    return F.filter(steps, lambda s: s["match"].isNotNull())


def _intervals(text: Column, pattern: Column) -> Column:
    """[low, high) of every match, in characters, from what stands between the matches."""

    def placed(sizes):
        def interval(size, before):
            low = before + size["gap"]
            return F.struct(low.alias("low"), (low + size["size"]).alias("high"))

        return F.zip_with(sizes, _before(F.transform(sizes, lambda s: s["gap"] + s["size"])), interval)

    sizes = F.transform(_matches(text, pattern), lambda s: F.struct(F.length(s["between"]).alias("gap"), F.length(s["match"]).alias("size")))
    return _let(sizes, placed)


def _detections(text: Column) -> Column:
    """All matches of the rules whose keyword is in the text, in the order of their beginnings, the longest first."""
    table = F.array(
        *[F.struct(*[F.lit(rule[k]).alias(k) for k in ("keyword", "tier", "label", "weight", "pattern")]) for rule in rules()]
    )

    def of(rule):
        return F.transform(
            _intervals(text, rule["pattern"]),
            lambda s: F.struct(
                s["low"].alias("low"), (-s["high"]).alias("back"), rule["tier"].alias("tier"), rule["label"].alias("label"),
                rule["weight"].alias("weight"),
            ),
        )

    found = F.array_sort(F.flatten(F.transform(F.filter(table, lambda rule: F.contains(text, rule["keyword"])), of)))
    return F.transform(
        found,
        lambda d: F.struct(d["low"].alias("low"), (-d["back"]).alias("high"), d["tier"].alias("tier"), d["label"].alias("label"), d["weight"].alias("weight")),
    ).cast(_DETECTION)


def _suppressed(found: Column) -> Column:
    """The detections that no other of an equal or better tier contains.

    They come ordered by beginning, the longest first and of equal ones the better tier first, so whatever contains a
    detection stands before it, and only the furthest end so far of each tier has to be known.
    """
    tiers = 6
    nowhere = F.array(*[F.lit(-1)] * tiers)

    def further(ends, d):
        return F.transform(ends, lambda e, k: F.when(k == d["tier"], F.greatest(e, d["high"])).otherwise(e))

    def add(state, d):
        reach = F.array_max(F.slice(state["ends"], 1, d["tier"] + 1))
        kept = F.when(reach >= d["high"], state["kept"]).otherwise(F.concat(state["kept"], F.array(d)))
        return F.struct(further(state["ends"], d).alias("ends"), kept.alias("kept"))

    def follow(state, block):
        """The ends that a block begins with, from those of the blocks before it."""
        ends = F.aggregate(block, state["ends"], further)
        return F.struct(ends.alias("ends"), F.concat(state["begins"], F.array(state["ends"])).alias("begins"))

    def left(block, ends):
        start = F.struct(ends.alias("ends"), F.array().cast(_DETECTION).alias("kept"))
        return F.aggregate(block, start, add, lambda state: state["kept"])

    def joined(blocks):
        start = F.struct(nowhere.alias("ends"), F.array().cast("array<array<int>>").alias("begins"))
        return F.flatten(F.zip_with(blocks, F.aggregate(blocks, start, follow, lambda state: state["begins"]), left))

    return _let(found, lambda f: _let(_blocks(f), joined))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the license phrases and detections of each text.

    Adds n_words (long), license_base: array of (low, label) with the word where each base phrase stands, in order;
    license_found: array of (low, high, tier, label, weight), the detections left after suppression, in characters of
    the spaced words. NULL and empty texts have no words and nothing found; repeated rows each give a row; an empty
    table gives none; columns of the same names are replaced. No shuffle, no join; one text is one row's work.
    """
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    gate = F.lit(False)
    lowered = F.lower(source)
    for word in GATES:
        gate = gate | F.contains(lowered, F.lit(word))
    gate = gate | F.contains(lowered, F.lit("cc")) & lowered.rlike(_CC_BY)
    words = F.regexp_extract_all(F.translate(source, _UPPER, _LOWER), F.lit(WORD_PATTERN), F.lit(0))
    spaced = F.concat(F.lit(" "), F.array_join(words, _BLANK), F.lit(" "))
    names = ("n_words", "license_base", "license_found")
    kept = docs.drop(*names)
    columns = [F.col(f"`{c}`") for c in kept.columns]
    counted = kept.withColumn("n_words", F.size(F.regexp_extract_all(source, F.lit(_ANY_CASE_WORD), F.lit(0))).cast("long")).withColumn(
        "__spaced", F.when(gate, spaced)
    )

    def phrase(words_: str, label: str) -> Column:
        pattern, own = F.lit(f" {words_.replace(' ', _BLANK)} "), 2 * (words_.count(" ") + 1)

        def placed(gaps):
            """The word a match begins with has one blank before it and two before each earlier word."""
            before = _before(F.transform(gaps, lambda g: g + own))
            low = F.zip_with(gaps, before, lambda gap, b: F.floor((b + gap + 1) / 2).cast("long"))
            return F.transform(low, lambda n: F.struct(n.alias("low"), F.lit(label).alias("label")))

        blanks = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
        return _let(F.transform(_matches(F.col("__spaced"), pattern), lambda s: blanks(s["between"])), placed)

    base = F.array_sort(F.concat(*[phrase(words_, label) for words_, label in BASE.items()]))
    none = F.array()
    found = _suppressed(_detections(F.col("__spaced")))
    kind = "array<struct<low:bigint,label:string>>"
    return counted.select(
        *columns,
        "n_words",
        F.when(F.col("__spaced").isNotNull(), base.cast(kind)).otherwise(none.cast(kind)).alias("license_base"),
        F.when(F.col("__spaced").isNotNull(), found).otherwise(none.cast(_DETECTION)).alias("license_found"),
    )


def license_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_base, first_word, last_word, base_labels, labels, score (the heaviest detection, base ones 0.6)."""
    found = scan_licenses(docs.select(key, "text"))
    base, all_found = F.col("license_base"), F.col("license_found")
    names = F.transform(base, lambda b: b["label"])
    heaviest = F.aggregate(all_found, F.when(F.size(base) > 0, 0.6).otherwise(0.0), lambda most, d: F.greatest(most, d["weight"]))
    return found.select(
        key,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.when(F.size(base) > 0, F.element_at(base, 1)["low"]).alias("first_word"),
        F.when(F.size(base) > 0, F.element_at(base, -1)["low"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, F.transform(all_found, lambda d: d["label"]))), ",").alias("labels"),
        heaviest.alias("score"),
    )
