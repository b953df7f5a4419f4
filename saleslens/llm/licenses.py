"""Licence recognition by sentences: known sentences become identifiers, rules name their sequences."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from .words import unused_name

# Identifier, and a pattern of the normalised sentence (lower case, single spaces, no
# other signs). The first pattern that fits gives the identifier; longer statements stand first.
SENTENCES = (
    ("apache-2", r"(licensed under|or|and) (the )?apache license version 2 0( |$)"),
    ("apache-2-use", r"you may not use this file except in compliance with the license"),
    ("apache-2-copy", r"you may obtain a copy of the license at http"),
    ("apache-2-basis", r"distributed under the license is distributed on an as is basis"),
    ("apache-2-limits", r"see the license for the specific language governing permissions and limitations"),
    ("mit-line", r"((released|licensed|distributed|available) under|or|and) (the )?(terms of the )?mit license( |$)"),
    ("mit-title", r"^(the )?mit license( mit)?$"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit-warranty", r"the software is provided as is without warranty of any kind"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc-warranty", r"the software is provided as is and the author disclaims all warranties"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-names", r"neither the name of .*(may|nor the names of its contributors)"),
    ("bsd-warranty", r"this software is provided by the .*as is and any express or implied warranties"),
    ("bsd-liability", r"in no event shall the (copyright|regents).* be liable"),
    ("bsd-2-line", r"licensed under the (bsd 2 clause|simplified bsd) license( |$)"),
    ("bsd-3-line", r"licensed under the (bsd 3 clause|new bsd) license( |$)"),
    ("agpl-3-line", r"licensed under the gnu affero general public license version 3( 0)?( |$)"),
    ("lgpl-2.1-line", r"licensed under the gnu lesser general public license version 2 1( |$)"),
    ("lgpl-3-line", r"licensed under the gnu lesser general public license version 3( 0)?( |$)"),
    ("gpl-2-line", r"licensed under the gnu general public license version 2( 0)?( |$)"),
    ("gpl-3-line", r"licensed under the gnu general public license version 3( 0)?( |$)"),
    ("gpl-2-later", r"under the terms of the gnu general public license .*either version 2 of the license or"),
    ("gpl-3-later", r"under the terms of the gnu general public license .*either version 3 of the license or"),
    ("gpl-hope", r"(is )?distributed in the hope that it will be useful but without any warranty"),
    ("gpl-details", r"see the gnu (lesser |affero )?general public license for more details"),
    ("gpl-copy", r"you should have received a copy of the gnu (lesser |affero )?general public license"),
    ("mpl-2-line", r"subject to the terms of the mozilla public license v(ersion)? ?2 0( |$)"),
    ("mpl-2-copy", r"if a copy of the mpl was not distributed with this file"),
    ("cc-by-nc-sa", r"licensed under (a )?(cc by nc sa|creative commons attribution noncommercial sharealike) 4 0"),
    ("cc-by-nc", r"licensed under (a )?(cc by nc|creative commons attribution noncommercial) 4 0( |$)"),
    ("cc-by-sa", r"licensed under (a )?(cc by sa|creative commons attribution sharealike) 4 0( |$)"),
    ("cc-by", r"licensed under (a )?(cc by|creative commons attribution) 4 0( |$)"),
    ("cc0", r"(licensed|released|dedicated) ([a-z0-9]+ ){0,6}(cc0 1 0|creative commons zero)"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(released|placed|dedicated) (in|into|to) the public domain"),
    ("rights-reserved", r"^(copyright .*)?all rights reserved$"),
)

# Licence, and the sentence identifiers that state it in this order. The first rule that
# fits takes its sentences, so longer sequences stand first.
RULES = (
    ("Apache-2.0", "apache-2 apache-2-use apache-2-copy apache-2-basis apache-2-limits"),
    ("MIT", "mit-title mit-grant mit-notice mit-warranty mit-liability"),
    ("MIT", "mit-grant mit-notice mit-warranty mit-liability"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names bsd-warranty bsd-liability"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-warranty bsd-liability"),
    ("GPL-2.0-or-later", "gpl-2-later gpl-hope gpl-details gpl-copy"),
    ("GPL-3.0-or-later", "gpl-3-later gpl-hope gpl-details gpl-copy"),
    ("GPL-2.0-or-later", "gpl-2-later"),
    ("GPL-3.0-or-later", "gpl-3-later"),
    ("MPL-2.0", "mpl-2-line mpl-2-copy"),
    ("ISC", "isc-grant isc-warranty"),
    ("Apache-2.0", "apache-2"),
    ("MIT", "mit-line"),
    ("MIT", "mit-grant mit-notice"),
    ("MIT", "mit-title"),
    ("BSD-2-Clause", "bsd-2-line"),
    ("BSD-3-Clause", "bsd-3-line"),
    ("AGPL-3.0", "agpl-3-line"),
    ("LGPL-2.1", "lgpl-2.1-line"),
    ("LGPL-3.0", "lgpl-3-line"),
    ("GPL-2.0", "gpl-2-line"),
    ("GPL-3.0", "gpl-3-line"),
    ("MPL-2.0", "mpl-2-line"),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa"),
    ("CC-BY-NC-4.0", "cc-by-nc"),
    ("CC-BY-SA-4.0", "cc-by-sa"),
    ("CC-BY-4.0", "cc-by"),
    ("CC0-1.0", "cc0"),
    ("Unlicense", "unlicense"),
    ("LicenseRef-Public-Domain", "public-domain"),
    ("LicenseRef-All-Rights-Reserved", "rights-reserved"),
)

#: Sentences that state a licence by themselves; one sentence may hold several of them.
STATED = tuple(
    name for name, _ in SENTENCES if name.endswith("-line") or name in ("apache-2", "cc-by-nc-sa", "cc-by-nc", "cc-by-sa", "cc-by", "cc0", "public-domain")
)

# Names of licences as SPDX spells them; the families that come as -only and -or-later, too.
SPDX_NAMES = (
    "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 "
    "CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 ISC MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 PostgreSQL PSF-2.0 Python-2.0 "
    "Unlicense UPL-1.0 W3C WTFPL X11 Zlib"
).split()
SPDX_FAMILIES = "AGPL-1.0 AGPL-3.0 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0".split()
_KNOWN = [*SPDX_NAMES, *(family + end for family in SPDX_FAMILIES for end in ("", "-only", "-or-later"))]
_NAME = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
_TERM = rf"(?:\(\s*)*{_NAME}(?:\s+WITH\s+{_NAME})?(?:\s*\))*"
#: A line with the tag, and the expression after it: names joined by AND, OR, WITH and brackets.
SPDX_TAG = r"(?i)spdx-license-identifier\s*:"
SPDX_EXPRESSION = rf"(?i:spdx-license-identifier)\s*:\s*({_TERM}(?:\s+(?:AND|OR)\s+{_TERM})*)"

# Every known sentence holds one of these words, so texts and sentences without them need no look.
HINT = (
    "licen[cs]e|permission|redistribution|copyright|software|warrant|domain|distributed|reserved|mozilla|mpl|cc0|"
    "creative|neither|event"
)

# A paragraph ends at a blank line, comment signs aside, unless a URL follows; a passage at that or after a full
# stop, semicolon or mark followed by white space. Its lines are sentences, and so are statements that run over breaks.
_BLANK = r"[^\S\n]*+[*#/%;-]*+[^\S\n]*+"
PASSAGE_END = rf"[.;!?]+\s+|\n{_BLANK}(?=\n(?!{_BLANK}https?:))"
LINE_END = r"\s*\n\s*"


def normalised(sentence: Column) -> Column:
    """Lower-case ASCII letters and digits, all else as single spaces."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_id(sentence: Column) -> Column:
    """Identifier of the first known pattern in a normalised sentence, else null."""
    found = F.lit(None).cast("string")
    for identifier, pattern in reversed(SENTENCES):
        found = F.when(sentence.rlike(pattern), F.lit(identifier)).otherwise(found)
    return found


def spdx_ids(line: Column) -> Column:
    """`spdx:` and the name of each licence of an SPDX expression, in its order; `spdx-unknown` for a name that isn't known.

    `+` means or-later. An exception after WITH stays with its licence.
    """
    terms = F.regexp_extract_all(F.regexp_extract(line, SPDX_EXPRESSION, 1), F.lit(rf"({_NAME}(?:\s+WITH\s+{_NAME})?)"), F.lit(1))
    names = F.create_map(*(F.lit(x) for name in _KNOWN for x in (name.lower(), name)))

    def identifier(term: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(term, rf"^{_NAME}", 0), r"\+$", "-or-later")
        known = F.coalesce(names[F.lower(name)], F.when(name.startswith("LicenseRef-"), name))
        exception = F.regexp_replace(F.regexp_extract(term, r"(\s+WITH\s+\S+)$", 1), r"\s+", " ")
        return F.coalesce(F.concat(F.lit("spdx:"), known, exception), F.lit("spdx-unknown"))

    return F.transform(F.filter(terms, lambda t: ~t.isin("AND", "OR")), identifier)


def sentence_ids(raw: Column, sentence: Column) -> Column:
    """`at` and `id` of what a sentence, as it is and normalised, says: names of an SPDX tag, all licences that
    it states, or else its first known pattern."""
    place = "array<struct<at:int,id:string>>"
    none = F.array().cast(place)
    patterns = dict(SENTENCES)

    def ending(pattern: str) -> Column:
        return F.regexp_instr(sentence, F.lit(pattern)) + F.length(F.regexp_extract(sentence, f"({pattern})", 1))

    def stated() -> Column:
        found = [F.when(sentence.rlike(patterns[name]), F.struct(ending(patterns[name]).alias("at"), F.lit(name).alias("id"))) for name in STATED]
        return F.array_sort(F.filter(F.array(*found), lambda f: f.isNotNull())).cast(place)

    def one(first: Column) -> Column:
        alone = F.array(F.struct(F.lit(1).alias("at"), first.alias("id"))).cast(place)
        return F.when(first.isNull(), none).when(first.isin(*STATED), stated()).otherwise(alone)

    known = F.flatten(F.transform(F.array(F.when(sentence.rlike(HINT), sentence_id(sentence))), one))  # binds the first pattern
    tagged = F.transform(spdx_ids(raw), lambda name, i: F.struct((i + 1).alias("at"), name.alias("id"))).cast(place)
    return F.when(raw.rlike(SPDX_TAG), tagged).otherwise(known)


def _line_ids(lines: Column) -> Column:
    """`at` and `id` of all that the lines (`raw`, `words`) say; `at` counts the signs of the lines before it."""
    none = F.array().cast("array<struct<at:int,id:string>>")

    def add(seen: Column, line: Column) -> Column:
        own = F.transform(
            sentence_ids(line["raw"], line["words"]),
            lambda found: F.struct((seen["at"] + found["at"]).alias("at"), found["id"].alias("id")),
        )
        after = seen["at"] + F.when(line["words"] == "", 0).otherwise(F.length(line["words"]) + 1)
        return F.struct(after.cast("int").alias("at"), F.concat(seen["found"], own).alias("found"))

    return F.aggregate(lines, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda seen: seen["found"])


def _wrapped_ids(joined: Column, lines: Column) -> Column:
    """`at` and `id` of the known sentences that only the joined lines hold; of overlapping ones the first pattern's."""
    found = []
    for rank, (identifier, pattern) in enumerate(SENTENCES):
        expression = F.lit(pattern)
        within = F.aggregate(lines, F.lit(0), lambda n, line: n + F.regexp_count(line, expression))  # noqa: B023
        at = F.regexp_instr(joined, expression)
        end = at + F.length(F.regexp_extract(joined, f"({pattern})", 1))
        span = F.struct(at.alias("at"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(identifier).alias("id"))
        found.append(F.when(joined.rlike(pattern) & (F.regexp_count(joined, expression) > within), span))
    spans = F.filter(F.array(*found), lambda span: span.isNotNull())

    def first(kept: Column, span: Column) -> Column:
        taken = F.exists(kept, lambda other: (span["at"] >= other["at"]) & (span["at"] < other["end"]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(span)))

    none = F.array().cast("array<struct<at:int,end:int,rank:int,id:string>>")
    pick = lambda span: F.struct(span["at"].alias("at"), span["id"].alias("id"))
    return F.aggregate(spans, none, first, lambda kept: F.transform(kept, pick))


def passage_ids(passage: Column) -> Column:
    """Identifiers of what a passage says, in order: of each line, and of what runs over its breaks."""
    joined = normalised(passage)
    lines = F.transform(F.split(passage, LINE_END, -1), lambda line: F.struct(line.alias("raw"), normalised(line).alias("words")))
    words = F.transform(lines, lambda line: line["words"])
    # A text of one line is its own sentence; else most passages hold no statement and need one look.
    silent = (
        sentence_id(joined).isNull()
        & ~passage.rlike(SPDX_TAG)
        & ~F.exists(words, lambda line: line.rlike(HINT) & sentence_id(line).isNotNull())
    )
    several = F.when(silent, F.array().cast("array<string>")).otherwise(
        F.transform(F.array_sort(F.concat(_line_ids(lines), _wrapped_ids(joined, words))), lambda found: found["id"])
    )
    single = F.transform(sentence_ids(passage, joined), lambda found: found["id"])
    return F.when(passage.contains("\n"), several).otherwise(single)


def _sequence(identifiers: str) -> str:
    return "".join(f"<{identifier}>" for identifier in identifiers.split())


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `sentence_ids`, `licences` and `unmatched_ids`, three arrays of strings.

    `sentence_ids` holds the known sentences of the whole text in their order,
    wrapped over lines or not, and `spdx:` names of SPDX tags; a sentence that
    states several licences has an identifier for each;
    `licences` the distinct licences that rules find in it, in order of name;
    `unmatched_ids` what no rule took. A null or empty text, or one without a
    known sentence, has three empty arrays. All is computed within the row: no
    shuffle, so neither a hot source nor groups of copies matter. Columns of
    the three names are replaced, others stay.
    """
    hinted = F.col(text).rlike("(?i)" + HINT)
    parts = F.filter(F.split(F.col(text), PASSAGE_END, -1), lambda part: part.rlike("(?i)" + HINT))
    identifiers = F.flatten(F.transform(parts, passage_ids))
    none = F.array().cast("array<string>")
    named = docs.withColumn("sentence_ids", F.when(hinted, identifiers).otherwise(none))
    wrapped = F.concat(F.lit("<"), F.array_join("sentence_ids", "><"), F.lit(">"))
    steps = [F.when(F.size("sentence_ids") > 0, wrapped).otherwise("")] + list(RULES)
    matched = functools.reduce(
        lambda seen, rule: F.replace(seen, F.lit(_sequence(rule[1])), F.lit(f"[{rule[0]}]")), steps
    )
    tagged = F.regexp_replace(matched, "<spdx:([^>]*)>", r"[$1]")
    own = unused_name(docs.columns, "marked")
    marked = named.withColumn(own, F.when(F.size("sentence_ids") > 0, tagged).otherwise(""))
    return marked.withColumns(
        {
            "licences": F.array_sort(F.array_distinct(F.regexp_extract_all(own, F.lit(r"\[([^\]]*)\]"), F.lit(1)))),
            "unmatched_ids": F.regexp_extract_all(own, F.lit("<([^>]*)>"), F.lit(1)),
        }
    ).drop(own)
