"""Licence scanning by ordered signature rules, in DataFrame functions only.

A text becomes its words in one normal form. Each rule is a regular expression over that form with a
priority, a label and a keyword; a rule runs only on texts that have its keyword, and no rule on texts
without any. A detection inside a longer or equally long one of the same or a better priority is
suppressed, of equal ones that of the later rule; the labels of the others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that are always looked for, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Licences: identifier, keyword, and the name as words; v stands for the version, its parts apart.
FAMILIES = (
    ("gpl-{v}", "gnu", "gnu general public license", ("1.0", "2.0", "3.0")),
    ("lgpl-{v}", "lesser", "gnu lesser general public license", ("2.0", "2.1", "3.0")),
    ("lgpl-{v}", "library", "gnu library general public license", ("2.0", "2.1", "3.0")),
    ("agpl-{v}", "affero", "gnu affero general public license", ("1.0", "3.0")),
    ("gfdl-{v}", "documentation", "gnu free documentation license", ("1.1", "1.2", "1.3")),
    ("apache-{v}", "apache", "apache (?:software )?license", ("1.0", "1.1", "2.0")),
    ("mpl-{v}", "mozilla", "mozilla public license", ("1.0", "1.1", "2.0")),
    ("epl-{v}", "eclipse", "eclipse public license", ("1.0", "2.0")),
    ("cpl-{v}", "common", "common public license", ("1.0",)),
    ("cddl-{v}", "development", "common development and distribution license", ("1.0", "1.1")),
    ("eupl-{v}", "european", "european union public licen[cs]e", ("1.0", "1.1", "1.2")),
    ("artistic-{v}", "artistic", "artistic license", ("1.0", "2.0")),
    ("afl-{v}", "academic", "academic free license", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl-{v}", "open", "open software license", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("ofl-{v}", "font", "(?:sil )?open font license", ("1.0", "1.1")),
    ("apsl-{v}", "apple", "apple public source license", ("1.0", "1.1", "1.2", "2.0")),
    ("odbl-{v}", "database", "open database license", ("1.0",)),
    ("php-{v}", "php", "php license", ("3.0", "3.01")),
    ("zpl-{v}", "zope", "zope public license", ("1.1", "2.0", "2.1")),
    ("cecill-{v}", "cecill", "cecill(?: free software)?(?: license)?", ("1.0", "1.1", "2.0", "2.1")),
    ("lppl-{v}", "latex", "latex project public license", ("1.0", "1.1", "1.2", "1.3")),
    ("bsl-{v}", "boost", "boost software license", ("1.0",)),
    ("python-{v}", "python", "python (?:software foundation )?license", ("2.0",)),
)
#: Creative Commons terms, as words and as identifier.
TERMS = (("by", "by"), ("by sa", "by-sa"), ("by nc", "by-nc"), ("by nd", "by-nd"), ("by nc sa", "by-nc-sa"), ("by nc nd", "by-nc-nd"))
TERM_NAMES = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ative works|s)"}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Licences without versions: identifier, keyword, name.
SINGLE = (
    ("mit", "mit", "mit license"), ("mit-0", "mit", "mit no attribution(?: license)?"), ("isc", "isc", "isc license"), ("zlib", "zlib", "zlib(?: libpng)? license"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?"), ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|(?:new|revised|modified) bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?"), ("0bsd", "bsd", "(?:zero clause bsd|0 clause bsd|bsd zero clause)(?: license)?"), ("bsd", "bsd", "bsd license"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"), ("x11", "x11", "x11 license"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? license"),
    ("postgresql", "postgresql", "postgresql license"), ("openssl", "openssl", "openssl license"), ("ruby", "ruby", "ruby license"), ("vim", "vim", "vim license"), ("beerware", "beer", "beer ware license"), ("beerware", "beerware", "beerware license"), ("json", "json", "json license"),
    ("gpl", "gnu", "gnu general public license"), ("lgpl", "lesser", "gnu lesser general public license"), ("agpl", "affero", "gnu affero general public license"), ("apache", "apache", "apache (?:software )?license"), ("mpl", "mozilla", "mozilla public license"),
)
#: What stands before a name, by priority: a grant, an SPDX tag, a bare mention. Confidence by priority.
GRANT = "(?:licensed|released|distributed|available|published|provided|covered|redistributed|used) under(?: the)?(?: terms of)?(?: the)? "
CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.6}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    regex: str


def build_rules() -> tuple[Rule, ...]:
    """The hundreds of rules: grants, SPDX tags and mentions of each licence and version; further single signatures."""
    rules: list[Rule] = []

    def add(label: str, keyword: str, name: str) -> None:
        spdx = label.replace("-", " ").replace(".", " ")
        rules.append(Rule(label, 1, keyword, f" {GRANT}{name}(?= )"))
        rules.append(Rule(label, 2, "spdx", f" spdx license identifier {spdx}(?: only| or later)?(?= )"))
        rules.append(Rule(label, 2, keyword, f" {name}(?= )"))

    for label, keyword, name, versions in FAMILIES:
        for v in versions:
            # a whole version is written with and without its zero
            parts = v.split(".")
            number = parts[0] + (r"(?: 0)?" if parts[1] == "0" else f" {parts[1]}")
            add(label.format(v=v), keyword, f"{name}(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?{number}")
    for words, term in TERMS:
        long_name = " ".join(TERM_NAMES[t] for t in words.split())
        for v in VERSIONS:
            number = v.replace(".", " ")
            add(f"cc-{term}-{v}", "cc", f"cc {words} {number}")
            add(f"cc-{term}-{v}", "commons", f"creative commons {long_name} (?:international )?{number}")
        rules.append(Rule(f"cc-{term}", 3, "cc", f" cc {words}(?= )"))
        rules.append(Rule(f"cc-{term}", 3, "commons", f" creative commons {long_name}(?= )"))
    for label, keyword, name in SINGLE:
        add(label, keyword, name)
    rules += [
        Rule("public-domain", 2, "domain", " (?:released|placed|dedicated|is|are) (?:in|into|to) the public domain(?= )"),
        Rule("public-domain", 3, "domain", " public domain(?= )"),
        Rule("reserved", 2, "reserved", " all rights reserved(?= )"),
        Rule("reserved", 2, "reserved", " copyright (?:c )?(?:[0-9]{4} )?[^ ]+(?: [^ ]+){0,5} all rights reserved(?= )"),
        Rule("proprietary", 2, "proprietary", " proprietary and confidential(?= )"),
        Rule("copyright", 3, "copyright", " copyright (?:c )?[0-9]{4}(?= )"),
        Rule("mit", 2, "permission", " permission is hereby granted free of charge to any person obtaining a copy(?= )"),
        Rule("isc", 2, "permission", " permission to use copy modify and or distribute this software for any purpose(?= )"),
        Rule("bsd", 2, "redistribution", " redistribution and use in source and binary forms(?= )"),
    ]
    return tuple(dict.fromkeys(rules))


RULES = build_rules()


def _count(c: Column, part: str) -> Column:
    """How often part stands in c, without overlaps; both lengths in characters."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _detections(rules: tuple[Rule, ...]) -> str:
    """SQL: sorted array of struct start, neg_end, priority, rule (its number), label of all matches in `one`, rules gated by their keywords."""
    kept = "filter(_rules, r -> contains(one, concat(' ', r.keyword, ' ')))"
    hits = "regexp_extract_all(one, r.regex, 0)"
    gaps = "split(one, r.regex, -1)"
    # places from the lengths of gaps and hits; slices keep it linear in the number of matches of a rule
    places = f"""transform(array(named_struct('h', {hits}, 'g', {gaps})), p -> aggregate(zip_with(p.g, p.h, (g, h) -> named_struct('g', length(g), 'h', length(h))),
        named_struct('at', 0, 'out', cast(array() as array<struct<start: int, neg_end: int>>)),
        (s, x) -> if(x.h is null, s, named_struct('at', s.at + x.g + x.h, 'out', array_append(s.out, named_struct('start', s.at + x.g, 'neg_end', -(s.at + x.g + x.h))))),
        s -> s.out))[0]"""
    return f"array_sort(flatten(transform({kept}, r -> transform({places}, m -> named_struct('start', m.start, 'neg_end', m.neg_end, 'priority', r.priority, 'rule', r.rule, 'label', r.label)))))"


def license_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; places count words from 0.
    Null and empty texts have no words and no labels (empty strings), null places and score 0. Repeated rows
    are scanned alike; other columns are ignored; an empty table gives no rows.
    """
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    # each word has a space of its own on either side, so places next to each other don't share one
    rows = docs.select("doc_id", F.concat(F.lit(" "), spaced, F.lit(" ")).alias("s"))
    found = [(f" {p.replace(' ', '  ')} ", label) for p, label in phrases]
    words_in = lambda c: ((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("long")
    s = F.col("s")
    first = [F.when(s.contains(p), words_in(F.substring("s", F.lit(1), F.instr(s, p) - 1))) for p, _ in found]
    tail = lambda p: F.length(s) - F.instr(F.reverse("s"), p[::-1]) + 1 - len(p)
    last = [F.when(s.contains(p), words_in(F.substring("s", F.lit(1), tail(p)))) for p, _ in found]
    n_base = sum((F.when(s.contains(p), _count(s, p)).otherwise(0) for p, _ in found), F.lit(0).cast("long"))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(s.contains(p), label) for p, label in found)))))
    rows = rows.select(
        "doc_id", F.when(s == "  ", 0).otherwise(words_in(s)).cast("long").alias("n_words"), n_base.alias("n_base"),
        F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), base.alias("base"),
        F.when(s.rlike(r" (?:" + "|".join(sorted({r.keyword for r in rules})) + r") "), F.replace(s, F.lit("  "), F.lit(" "))).alias("one"),
    )
    literal = F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex"), F.lit(i).alias("rule")) for i, r in enumerate(rules)))
    rows = rows.withColumn("_rules", F.when(F.col("one").isNotNull(), literal))
    rows = rows.withColumn("hits", F.expr(f"if(one is null, null, {_detections(rules)})")).drop("_rules")
    # in order of begin, the longer first: a detection is inside an earlier one if that reaches as far
    kept = F.expr("""if(hits is null, cast(array() as array<struct<label: string, priority: int>>), aggregate(hits,
        named_struct('e1', -1, 'e2', -1, 'e3', -1, 'out', cast(array() as array<struct<label: string, priority: int>>)),
        (s, h) -> if(if(h.priority = 1, s.e1, if(h.priority = 2, s.e2, s.e3)) >= -h.neg_end, s,
            named_struct('e1', if(h.priority <= 1, greatest(s.e1, -h.neg_end), s.e1), 'e2', if(h.priority <= 2, greatest(s.e2, -h.neg_end), s.e2), 'e3', greatest(s.e3, -h.neg_end),
                'out', array_union(s.out, array(named_struct('label', h.label, 'priority', h.priority))))),
        s -> s.out))""")
    rows = rows.withColumn("kept", kept)
    labels = F.array_sort(F.array_union("base", F.expr("transform(kept, k -> k.label)")))
    best = F.array_min(F.expr("transform(kept, k -> k.priority)"))
    score = F.coalesce(F.when(best == 1, CONFIDENCE[1]).when(best == 2, CONFIDENCE[2]).when(best == 3, CONFIDENCE[3]), F.when(F.size("base") > 0, CONFIDENCE[3]), F.lit(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), score.alias("score"))
