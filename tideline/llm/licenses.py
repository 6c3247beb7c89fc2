"""Licence statements by ordered signature rules, with DataFrame functions only.

Texts are scanned as words: A-Z lower-cased, every run of other ASCII characters a blank. A
text goes to a rule only if the rule's keyword occurs in it, and one of the words that every
statement of the rule's form has: so the prefilter never changes a result. A rule is a pattern of words
with a priority. A detection inside another one of higher priority, or of the same and a longer or
earlier one, is suppressed. Places and suppression take one pass over the matches in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Licences as label, words of which each statement has at least one, pattern of their name in words.
LICENSES = [
    ("mit-license", "mit|expat", "(?:mit|expat)(?: x11)?"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version)?(?: v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("gpl-3.0-or-later", "gnu", "gnu(?: general public license| gpl)(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?(?: of the license)? or(?: at your option)? any later(?: version)?"),
    ("gpl-3.0", "gnu", "gnu(?: general public license| gpl)(?: gpl)?(?: version)? v?3(?: 0)?"),
    ("gpl-2.0-or-later", "gnu", "gnu(?: general public license| gpl)(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?(?: of the license)? or(?: at your option)? any later(?: version)?"),
    ("gpl-2.0", "gnu", "gnu(?: general public license| gpl)(?: gpl)?(?: version)? v?2(?: 0)?"),
    ("gpl", "gnu", "gnu(?: general public license| gpl)"),
    ("lgpl-3.0", "lesser", "gnu lesser general public license(?: lgpl)?(?: version)? v?3(?: 0)?"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license(?: lgpl)?(?: version)? v?2 1"),
    ("lgpl", "lesser", "gnu lesser general public license"),
    ("agpl-3.0", "affero", "gnu affero general public license(?: agpl)?(?: version)? v?3(?: 0)?"),
    ("agpl", "affero", "gnu affero general public license"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-2-clause", "bsd|freebsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("isc", "isc", "isc"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: mpl)?(?: version)? v?2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: mpl)?(?: version)? v?1 1"),
    ("epl-2.0", "eclipse", "eclipse public license(?: epl)?(?: version)? v?2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public license(?: epl)?(?: version)? v?1(?: 0)?"),
    ("cddl-1.0", "cddl", "cddl(?: version)?(?: 1(?: 0)?)?"),
    ("artistic-2.0", "artistic", "artistic license(?: version)? 2(?: 0)?"),
    ("boost-1.0", "boost", "boost software license(?: version)?(?: 1(?: 0)?)?"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2.0", "python|psf", "(?:python software foundation|psf)(?: license)?(?: version)?(?: 2(?: 0)?)?"),
    ("ofl-1.1", "sil", "sil open font license(?: version)?(?: 1 1)?"),
    ("cc-by-nc-nd-4.0", "nd|derivatives|noderivatives", "(?:cc|creative commons)(?: attribution| by) ?(?:nc|non ?commercial) (?:nd|no ?derivatives)(?: 4 0)?(?: international)?"),
    ("cc-by-nc-sa-4.0", "sa|alike|sharealike", "(?:cc|creative commons)(?: attribution| by) ?(?:nc|non ?commercial) (?:sa|share ?alike)(?: 4 0)?(?: international)?"),
    ("cc-by-nc-4.0", "nc|commercial|noncommercial", "(?:cc|creative commons)(?: attribution| by) ?(?:nc|non ?commercial) 4 0(?: international)?"),
    ("cc-by-nc-3.0", "nc|commercial|noncommercial", "(?:cc|creative commons)(?: attribution| by) ?(?:nc|non ?commercial) 3 0(?: unported)?"),
    ("cc-by-nd-4.0", "nd|derivatives|noderivatives", "(?:cc|creative commons)(?: attribution| by) ?(?:nd|no ?derivatives)(?: 4 0)?(?: international)?"),
    ("cc-by-sa-4.0", "sa|alike|sharealike", "(?:cc|creative commons)(?: attribution| by) ?(?:sa|share ?alike) 4 0(?: international)?"),
    ("cc-by-sa-3.0", "sa|alike|sharealike", "(?:cc|creative commons)(?: attribution| by) ?(?:sa|share ?alike) 3 0(?: unported)?"),
    ("cc-by-4.0", "by", "cc by 4 0(?: international)?"),
    ("cc-by-3.0", "by", "cc by 3 0(?: unported)?"),
    ("cc-by", "commons", "creative commons attribution(?: 4 0)?(?: international)?"),
    ("cc0-1.0", "cc0|zero", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?"),
]

# Stretches of words of which each statement of a form has at least one.
NEEDS = {
    "grant": [" hereby granted "], "work": [" by ", " under "], "licensed": [" under "], "tag": [" spdx "],
    "field": [" licen"], "terms": [" terms of ", " conditions of ", " provisions of "], "under": [" under "],
    "copy": [" licen"], "name": [" licen"],
}

# Forms of statements as name, priority, words before, words after the licence's name.
FORMS = [
    ("grant", 70, "permission is hereby granted(?: free of charge)? under(?: the)?(?: terms of)?(?: the)?", "(?: licen[cs]e)?"),
    ("work", 60, "(?:this|the) (?:work|software|program|project|file|code|document|text|article|library|package|page|site|content)s? (?:is|are) (?:(?:dual |re)?licen[cs]ed|released|distributed|made available|available|published|provided|covered)(?: by| under)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?", "(?: licen[cs]e)?"),
    ("licensed", 50, "(?:(?:dual |re)?licen[cs]ed|released|distributed|redistributed|made available|available|published|provided) under(?: the)?(?: terms(?: and conditions)? of)?(?: the)?", "(?: licen[cs]e)?"),
    ("tag", 50, "spdx licen[cs]e identifier", "(?: only| or later)?"),
    ("field", 40, "licen[cs]e(?:s|d)?(?: type| name| is| info)?", "(?: licen[cs]e)?"),
    ("terms", 40, "(?:terms|conditions|provisions) of(?: the)?", "(?: licen[cs]e)?"),
    ("under", 30, "under(?: the| a| an)?", "(?: licen[cs]e)?"),
    ("copy", 30, "(?:copy|text|version) of(?: the)?", " licen[cs]e"),
    ("name", 20, "", " licen[cs]e"),
]

OTHER_THAN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is over words with single blanks, from the blank before the first to the last character.

    Every match of it has at least one of the words of ``keyword`` (with | between them), and at least one of the
    stretches of ``needs``. Without any, nothing is needed.
    """

    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    needs: tuple[str, ...] = ()


def rules() -> list[Rule]:
    """All forms of all licences, the specific ones first, and a few statements without a licence's name."""
    made = [
        Rule(f"{form}/{label}", label, keyword, f" {before}{' ' if before else ''}{name}{after}(?= )", priority, tuple(NEEDS[form]))
        for form, priority, before, after in FORMS
        for label, keyword, name in LICENSES
    ]
    return [
        *made,
        Rule("domain", "public-domain", "domain", r" (?:in|into|to) the public domain(?= )", 40),
        Rule("reserved", "all-rights-reserved", "reserved", r" all rights reserved(?= )", 10),
        Rule("redistribution", "bsd-like", "redistribution", r" redistribution and use in source and binary forms(?= )", 60),
        Rule("granted", "mit-like", "hereby", r" permission is hereby granted free of charge to any person(?= )", 60),
    ]


def _keywords(rule: Rule) -> list[str]:
    return [f" {word} " for word in rule.keyword.split("|") if word]


def _literal(found: list[Rule]) -> Column:
    rows = [asdict(r) | {"keyword": _keywords(r), "place": k} for k, r in enumerate(found)]
    shape = "array<struct<keyword:array<string>,needs:array<string>,pattern:string,label:string,name:string,priority:int,place:int>>"
    return F.from_json(F.lit(json.dumps(rows)), shape)


def _words_in(text: Column) -> Column:
    """Words of a stretch of normal text that starts with a blank: as many as there are blanks."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often the expression has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _applicable(normal: Column, own: list[Rule]) -> Column:
    """The rules whose keyword and one of whose needed stretches occur."""
    words = sorted({w for r in own for w in (*_keywords(r), *r.needs)})
    there = F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(normal, w))

    def met(known: Column, wanted: Column) -> Column:
        return (F.size(wanted) == 0) | F.arrays_overlap(known, wanted)

    return _once(
        there, lambda known: F.filter(_literal(own), lambda r: met(known, r["keyword"]) & met(known, r["needs"]))
    )


def _detections(normal: Column, rules_of_text: Column) -> Column:
    """All matches of the rules: first and last word of each, counted from 0."""

    # First the matches of each rule and the words of matches and of the gaps between them, then running sums of both.
    def matches(r: Column) -> Column:
        return F.struct(
            r.alias("rule"),
            F.transform(F.regexp_extract_all(normal, r["pattern"], F.lit(0)), _words_in).alias("sizes"),
            F.transform(F.split(normal, r["pattern"], -1), _words_in).alias("gaps"),
        )

    matched = F.filter(F.transform(rules_of_text, matches), lambda m: F.size(m["sizes"]) > 0)

    def of(m: Column) -> Column:
        rule = m["rule"]
        steps = F.arrays_zip(F.slice(m["gaps"], F.lit(1), F.size(m["sizes"])).alias("gap"), m["sizes"].alias("size"))
        start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<first:int,size:int>>").alias("places"))

        def step(state: Column, s: Column) -> Column:
            first = state["upto"] + s["gap"]
            place = F.struct(first.alias("first"), s["size"].alias("size"))
            return F.struct(
                (first + s["size"]).alias("upto"), F.concat(state["places"], F.array(place)).alias("places")
            )

        return F.transform(
            F.aggregate(steps, start, step, lambda state: state["places"]),
            lambda p: F.struct(
                p["first"].cast("bigint").alias("first"), p["size"].cast("bigint").alias("words"),
                rule["label"].alias("label"), rule["name"].alias("rule"),
                rule["priority"].alias("priority"), rule["place"].alias("place"),
            ),
        )

    return F.flatten(F.transform(matched, of))


def _unsuppressed(found: Column, priorities: list[int]) -> Column:
    """Without those that lie inside one of higher priority, or of the same that is longer or of an earlier rule.

    In the order of first words, longer before shorter, whatever can hold a detection stands before it. So it is
    enough to know, for each priority, how far the detections so far reach.
    """
    levels = F.array(*[F.lit(p) for p in priorities])
    shape = "array<struct<first:bigint,words:bigint,label:string,rule:string,priority:int,place:int>>"
    ordered = F.transform(
        F.array_sort(
            F.transform(
                found,
                lambda d: F.struct(
                    d["first"].alias("a"), (-d["words"]).alias("b"), (-d["priority"]).alias("c"), d["place"].alias("e"), d.alias("d")
                ),
            )
        ),
        lambda s: s["d"],
    )
    start = F.struct(
        F.transform(levels, lambda p: F.lit(-1).cast("bigint")).alias("reach"), F.array().cast(shape).alias("left")
    )

    def step(state: Column, d: Column) -> Column:
        end = d["first"] + d["words"]
        beaten = F.exists(
            F.arrays_zip(levels.alias("level"), state["reach"].alias("reach")),
            lambda x: (x["level"] >= d["priority"]) & (x["reach"] >= end),
        )
        reach = F.zip_with(
            levels, state["reach"], lambda p, x: F.when(p == d["priority"], F.greatest(x, end)).otherwise(x)
        )
        return F.struct(
            reach.alias("reach"), F.when(beaten, state["left"]).otherwise(F.concat(state["left"], F.array(d))).alias("left")
        )

    return F.aggregate(ordered, start, step, lambda state: state["left"])


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", own: list[Rule] | None = None) -> DataFrame:
    """``key``, ``n_words``, ``base``, ``detections`` of every whole text.

    ``base`` has the places, first and last start of each base phrase that occurs; ``detections`` label, rule,
    priority, first word and number of words of what the rules found. Both are empty arrays in null and empty texts.
    Repeated rows are scanned alike; other columns are not read. A text is held as its normal form, that reversed,
    and the gaps between the matches of one rule after the other.
    """
    found = own if own is not None else rules()
    whole = F.coalesce(F.col("_text"), F.lit(""))
    upper = "".join(chr(c) for c in range(65, 91))
    normal = F.regexp_replace(F.translate(whole, upper, upper.lower()), OTHER_THAN_WORDS, " ")
    rows = (
        docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        .select(
            "_key",
            F.regexp_count(whole, F.lit(WORD)).cast("bigint").alias("n_words"),
            F.concat(F.lit(" "), F.trim(normal), F.lit(" ")).alias("_normal"),
        )
        .withColumn("_back", F.reverse("_normal"))
    )
    normal, back = F.col("_normal"), F.col("_back")

    def phrase(words: str, label: str) -> Column:
        at = F.instr(normal, f" {words} ")
        behind = F.instr(back, f" {words} "[::-1])
        size = len(words.split(" "))
        return F.when(
            at > 0,
            F.struct(
                F.lit(label).alias("label"),
                F.regexp_count(normal, F.lit(f" {words}(?= )")).cast("bigint").alias("places"),
                (_words_in(F.substring(normal, F.lit(1), at)) - 1).cast("bigint").alias("first"),
                (F.col("n_words") - size - (_words_in(F.substring(back, F.lit(1), behind)) - 1)).cast("bigint").alias("last"),
            ),
        )

    base = F.filter(F.array(*[phrase(w, label) for w, label in PHRASES.items()]), lambda p: p.isNotNull())
    priorities = sorted({r.priority for r in found})
    detections = _once(
        _applicable(normal, found),
        lambda own_rules: _once(_detections(normal, own_rules), lambda d: _unsuppressed(d, priorities)),
    )
    return rows.select(F.col("_key").alias(key), "n_words", base.alias("base"), detections.alias("detections"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels, and a score.

    The score is the highest priority of what was found over 70, at least 0.5 for a base phrase, 0 for nothing.
    """
    base, found = F.col("base"), F.col("detections")
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform(found, lambda d: d["label"])))
    best = F.coalesce(F.array_max(F.transform(found, lambda d: d["priority"])), F.lit(0)) / F.lit(70.0)
    return scanned(docs, key, text).select(
        key, "n_words",
        F.aggregate(base, F.lit(0).cast("bigint"), lambda n, p: n + p["places"]).alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(best, F.when(F.size(base) > 0, 0.5).otherwise(0.0))).alias("score"),
    )
