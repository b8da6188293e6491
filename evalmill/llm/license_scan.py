"""Licence scan by ordered signature rules.

Rules are regular expressions: sentences of licence texts and notices, written by hand, and names, tags, grants and addresses, which
are made from a table of licences and a few forms.
A rule is tried only on texts that hold its keywords, and no rule at all on texts without any anchor word. A rule has a
priority, that of its form; a detection inside the span of one of the same or a higher priority is suppressed, the longer
and then the earlier rule first among equals. All of it is DataFrame functions: match places come from the lengths of the
pieces that a pattern leaves and of its matches, as running sums over rows of small numbers, never over text.

Base phrases are found word by word, whatever the rules say, and their labels stay.

Cases: a null text has no words and no labels; a text without base phrases has null first_word and last_word; score is the
highest confidence of the forms that remain (0.5 for a base phrase alone, 0 for none). Words are split after lower-casing A-Z.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.llm.common import ascii_lower, cut_lineage, let, table

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Creative Commons kinds and their long names, the most specific ones first.
CC_KINDS = {
    "by-nc-nd": "attribution-?non-?commercial-?no-?deriv(?:ative)?s",
    "by-nc-sa": "attribution-?non-?commercial-?share-?alike",
    "by-nc": "attribution-?non-?commercial",
    "by-nd": "attribution-?no-?deriv(?:ative)?s",
    "by-sa": "attribution-?share-?alike",
    "by": "attribution",
}

#: Licences: label, SPDX identifier stem, full name, keyword (one word, in every form of the name), addresses. A space is a GAP.
LICENSES = (
    ("agpl", "agpl", r"(?:gnu )?affero general public licen[cs]e", "affero", r"gnu\.org/licenses/agpl"),
    ("lgpl", "lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "general", r"gnu\.org/licenses/lgpl"),
    ("gpl", "gpl", r"gnu general public licen[cs]e", "general", r"gnu\.org/licenses/gpl"),
    ("gfdl", "gfdl", r"gnu free documentation licen[cs]e", "documentation", r"gnu\.org/licenses/fdl"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", "apache", r"apache\.org/licenses"),
    ("mit", "mit", r"mit licen[cs]e|licen[cs]e: mit\b", "mit", r"opensource\.org/licenses/mit"),
    ("bsd", "bsd", r"(?:[234]-clause )?bsd licen[cs]e", "bsd", r"opensource\.org/licenses/bsd"),
    ("isc", "isc", r"isc licen[cs]e", "isc", r"opensource\.org/licenses/isc"),
    ("mpl", "mpl", r"mozilla public licen[cs]e", "mozilla", r"mozilla\.org/mpl"),
    ("epl", "epl", r"eclipse public licen[cs]e", "eclipse", r"eclipse\.org/legal/epl"),
    ("eupl", "eupl", r"european union public licen[cs]e", "european", r"joinup\.ec\.europa\.eu/[a-z/]*eupl"),
    ("cddl", "cddl", r"common development and distribution licen[cs]e", "development", r"opensource\.org/licenses/cddl"),
    ("cpl", "cpl", r"common public licen[cs]e", "common", r"opensource\.org/licenses/cpl"),
    ("artistic", "artistic", r"artistic licen[cs]e", "artistic", r"opensource\.org/licenses/artistic"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", "zlib", r"opensource\.org/licenses/zlib"),
    ("unlicense", "unlicense", r"the unlicense\b", "unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public licen[cs]e", "what", r"wtfpl\.net"),
    ("bsl", "bsl", r"boost software licen[cs]e", "boost", r"boost\.org/license"),
    ("busl", "busl", r"business source licen[cs]e", "business", r"mariadb\.com/bsl"),
    ("sspl", "sspl", r"server side public licen[cs]e", "server", r"mongodb\.com/licensing/server-side"),
    ("elastic", "elastic", r"elastic licen[cs]e", "elastic", r"elastic\.co/licensing"),
    ("ofl", "ofl", r"(?:sil )?open font licen[cs]e", "font", r"scripts\.sil\.org/ofl"),
    ("psf", "psf", r"python software foundation licen[cs]e", "python", r"docs\.python\.org/[0-9a-z./]*license"),
    ("php", "php", r"php licen[cs]e", "php", r"php\.net/license"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("ms-pl", "ms-pl", r"microsoft public licen[cs]e", "microsoft", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft", r"opensource\.org/licenses/ms-rl"),
    ("odbl", "odbl", r"open database licen[cs]e", "database", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "odc-by", r"open data commons attribution licen[cs]e", "commons", r"opendatacommons\.org/licenses/by"),
    ("pddl", "pddl", r"public domain dedication and licen[cs]e", "domain", r"opendatacommons\.org/licenses/pddl"),
    ("ogl", "ogl-uk", r"open government licen[cs]e", "government", r"nationalarchives\.gov\.uk/doc/open-government"),
    ("cc0", "cc0", r"cc0\b", "cc0", r"creativecommons\.org/publicdomain/zero"),
    ("cc0", "cc-zero", r"creative commons zero", "creative", r"creativecommons\.org/publicdomain/zero/legal"),
    *((f"cc-{kind}", f"cc-{kind}", rf"cc(?:-| ){kind.replace('-', '(?:-| )')}\b", "cc", rf"creativecommons\.org/licenses/{kind}/") for kind in CC_KINDS),
    *((f"cc-{kind}", f"cc-{kind}-int", rf"creative commons {CC_KINDS[kind]}", "creative", rf"creativecommons\.org/licenses/{kind}/legal") for kind in CC_KINDS),
    ("bsd", "0bsd", r"berkeley software distribution", "berkeley", r"spdx\.org/licenses/[0-9a-z-]*bsd"),
    ("proprietary", "licenseref-proprietary", r"proprietary and confidential", "proprietary", r"[a-z0-9.]+/terms-of-use"),
    ("proprietary", "licenseref-reserved", r"all rights reserved", "reserved", r"[a-z0-9.]+/terms-and-conditions"),
)

#: Signatures: label, keyword (in every match), sentence. A space is a GAP, a comma may be left out.
SENTENCES = (
    ("mit", "hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "sublicense", r"to use, copy, modify, merge, publish, distribute, sublicense,? and/or sell copies of the software"),
    ("mit", "mit-style", r"mit-style licen[cs]e"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "endorse", r"neither the names? of .{1,80}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products"),
    ("bsd", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "bsd-style", r"bsd-style licen[cs]e"),
    ("isc", "hereby", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "removed", r"this notice may not be removed or altered from any source distribution"),
    ("apache", "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache", "applicable law", r"unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e is distributed"),
    ("apache", "asf", r"licen[cs]ed to the apache software foundation \(asf\)"),
    ("apache", "contributor", r"under one or more contributor license agreements"),
    ("apache", "derivative works thereof", r"you may reproduce and distribute copies of the work or derivative works thereof in any medium"),
    ("gpl", "redistribute it", r"this program is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("gpl", "copyleft", r"the gnu general public licen[cs]e is a free,? copyleft licen[cs]e"),
    ("gpl", "absolutely no warranty", r"this program comes with absolutely no warranty"),
    ("gpl", "welcome", r"this is free software, and you are welcome to redistribute it under certain conditions"),
    ("gpl", "statically", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("lgpl", "redistribute it", r"this library is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library)"),
    ("lgpl", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("agpl", "interacting with it remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant sections", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gfdl", "gnu", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl", "incompatible with secondary", r"this source code form is .?incompatible with secondary licen[cs]es"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse"),
    ("epl", "eclipse.org/legal", r"available at https?://www\.eclipse\.org/legal/epl"),
    ("eupl", "eupl", r"licen[cs]ed under the eupl"),
    ("cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl", "alter", r"do not alter or remove copyright notices or this (?:file header|cddl header)"),
    ("cpl", "accompanying", r"the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("artistic", "perl", r"under the same terms as perl itself"),
    ("artistic", "artistic", r"the terms of the artistic licen[cs]e"),
    ("artistic", "verbatim", r"you may copy and give away verbatim copies of the source form of the standard version"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("wtfpl", "fuck", r"0\. you just do what the fuck you want to"),
    ("bsl", "boost", r"distributed under the boost software licen[cs]e"),
    ("bsl", "organization obtaining", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("busl", "additional use grant", r"additional use grant:"),
    ("busl", "non-production use", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use"),
    ("sspl", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("ofl", "font", r"this font software is licen[cs]ed under the sil open font licen[cs]e"),
    ("ofl", "font", r"with reserved font names?"),
    ("psf", "psf", r"psf is making python available to licensee on an .?as is.? basis"),
    ("php", "php", r"this product includes php software, freely available from"),
    ("postgresql", "written agreement", r"for any purpose, without fee, and without a written agreement is hereby granted"),
    ("ms-pl", "accompanying software", r"this licen[cs]e governs use of the accompanying software\. if you use the software, you accept this licen[cs]e"),
    ("ms-rl", "reciprocal grants", r"reciprocal grants- for any file you distribute that contains code from the software"),
    ("odbl", "database", r"contains information from .{1,80}? which is made available (?:here )?under the open database licen[cs]e"),
    ("pddl", "dedicat", r"the rightsholder .{0,40}?dedicates? .{0,40}?to the public domain"),
    ("ogl", "open government", r"contains public sector information licen[cs]ed under the open government licen[cs]e"),
    ("cc0", "extent", r"to the extent possible under law,? .{1,80}? (?:has|have) (?:waived|dedicated) all copyright"),
    ("cc0", "waiving all", r"has dedicated the work to the public domain by waiving all of (?:his or her|their) rights"),
    ("cc-by", "creative", r"this work is licen[cs]ed under (?:a|the) creative commons attribution (?:[0-9.]+ )?(?:international |unported )?licen[cs]e"),
    ("cc-by-sa", "creative", r"this work is licen[cs]ed under (?:a|the) creative commons attribution-share-?alike"),
    ("cc-by-nc", "creative", r"this work is licen[cs]ed under (?:a|the) creative commons attribution-non-?commercial (?:[0-9.]+ )?(?:international |unported )?licen[cs]e"),
    ("cc-by-sa", "remix", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same licen[cs]e"),
    ("cc-by", "appropriate credit", r"you must give appropriate credit, provide a link to the licen[cs]e"),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file, via any medium,? is strictly prohibited"),
    ("proprietary", "reproduced", r"no part of this (?:publication|document|work|book) may be reproduced"),
    ("proprietary", "trade secret", r"contains (?:proprietary|confidential) information and trade secrets"),
    ("proprietary", "written", r"without the (?:express |prior )+written (?:permission|consent) of"),
)

#: What may stand between the words of a name or form: white space, line breaks and the marks of comment lines.
GAP = r"[\x09-\x0D\x20*#/]+"

#: What an SPDX identifier may carry after its stem: a version with further parts (-3-clause, -2.0-or-later), -only, -or-later, a plus.
SUFFIX = r"(?:-[0-9][0-9.]*(?:-[a-z0-9]+)*|-only|-or-later)?\+?"

#: Form: priority, confidence, pattern around the name {n}, the identifier {s} or the address {u}, keyword or None for the name's.
#: Every alternative of a pattern holds its keyword. A space is a GAP.
FORMS = {
    "tag": (5, 1.0, r"spdx-license-identifier:[\x09\x20(]*{s}" + SUFFIX + r"(?![a-z0-9-])", "spdx-license-identifier"),
    "address": (4, 0.95, r"https?://(?:www\.)?(?:{u})[a-z0-9./_-]*", "http"),
    **{f"grant {word}": (3, 0.9, r"(?:licen[cs]ed|released|distributed|available|published|provided) " + how + r" (?:the )?(?:terms of )?(?:the )?(?:{n})(?:,? version [0-9.]+| v?[0-9.]+)?", word) for how, word in (("under", "under"), ("according to", "according"))},
    **{f"see {word}": (3, 0.85, how + r" (?:the )?(?:{n}) (?:for|file|text|terms)", word) for how, word in (("see", "see"), ("read", "read"), ("refer to", "refer"))},
    "version": (2, 0.8, r"(?:{n}),? (?:version |v)[0-9.]+", None),
    "name": (1, 0.7, r"(?:{n})", None),
}

#: Texts without any of these, without a sentence's keyword and without BASE_ANCHOR hold nothing that a rule could match.
ANCHORS = (
    "licen", "cc-by", "cc0", "spdx", "commons", "berkeley", "reserved", "proprietary",
    "mozilla.org/mpl", "wtfpl", "eclipse.org/legal", "eupl", "mariadb.com/bsl", "sil.org/ofl", "open-government", "/terms-",
)

#: Texts without this hold no base phrase.
BASE_ANCHOR = r"license|cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"


def _spaced(pattern: str) -> str:
    """A sentence as a pattern: spaces are gaps, commas may be missing."""
    return pattern.replace(", ", ",? ").replace(",??", ",?").replace(" ", GAP)


def _keyword(words: str) -> str:
    return max(words.split(" "), key=len)


def rules() -> list[tuple[str, tuple[str, str], str, int, float]]:
    """(label, keywords, pattern, priority, confidence): the sentences, then every licence in every form that fits it.

    Both keywords are needed for a match. A keyword of several words would miss one that is broken over lines, so its longest word
    is taken. References to a file of the licence need a name that says "licence"; placeholders of SPDX have no tag.
    """
    made = [(label, (_keyword(words), ""), _spaced(sentence), 4, 0.95) for label, words, sentence in SENTENCES]
    for label, stem, name, word, address in LICENSES:
        for form, (priority, confidence, pattern, keyword) in FORMS.items():
            if (form.startswith("see ") and "licen" not in name) or (form == "tag" and stem.startswith("licenseref-")):
                continue
            keywords = (keyword or word, "" if keyword in ("spdx-license-identifier", "http") else word)
            made.append((label, keywords, pattern.replace("{n}", name).replace(" ", GAP).replace("{s}", stem).replace("{u}", address), priority, confidence))
    return made


WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _rule_table() -> Column:
    """The rules as one constant array; an element's place is the rule's number."""
    names = ("label", "keyword", "word", "pattern", "priority", "confidence")
    listed = [dict(zip(names, (label, *words, rf"(?<![a-z0-9])(?:{pattern})", priority, confidence))) for label, words, pattern, priority, confidence in rules()]
    kinds = "label string, keyword string, word string, pattern string, priority int, confidence double"
    return F.from_json(F.lit(json.dumps(listed)), f"array<struct<{kinds.replace(' ', ': ').replace(',: ', ', ')}>>")


def _base_places(words: Column) -> Column:
    """(start word, label) of each place where a base phrase's words stand one after the other."""
    found = []
    for phrase, label in BASE.items():
        first, *rest = phrase.split(" ")

        def here(w, i, first=first, rest=rest):
            cond = w == first
            for k, other in enumerate(rest, 1):
                cond = cond & (F.coalesce(F.get(words, i + k), F.lit("")) == other)
            return cond

        found.append((here, label))
    hit = lambda w, i: F.coalesce(*[F.when(h(w, i), F.lit(label)) for h, label in found])
    return F.filter(F.transform(words, lambda w, i: F.struct(i.alias("start"), hit(w, i).alias("label"))), lambda x: x["label"].isNotNull())


def detections(gated: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule, start, end) of every match of every rule, in code points of the lower-cased text."""
    trial = F.filter(F.transform(_rule_table(), lambda r, i: r.withField("rule", i)), lambda r: F.contains(F.col(text), r["keyword"]) & F.contains(F.col(text), r["word"]) & F.regexp_like(F.col(text), r["pattern"]))
    lengths = lambda r: F.arrays_zip(
        F.transform(F.split(F.col(text), r["pattern"], -1), lambda p: F.length(p)).alias("gap"),
        F.transform(F.regexp_extract_all(F.col(text), r["pattern"], F.lit(0)), lambda m: F.length(m)).alias("size"),
    )
    cells = F.transform(trial, lambda r: F.struct(r["rule"].alias("rule"), lengths(r).alias("cells")))
    rows = gated.select(key, F.explode(cells).alias("c")).select(key, "c.rule", F.posexplode("c.cells").alias("n", "cell"))
    rows = rows.select(key, "rule", "n", F.col("cell.gap").alias("gap"), F.col("cell.size").alias("size")).filter("size IS NOT NULL")
    upto = Window.partitionBy(key, "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, "rule", (F.sum(F.col("gap") + F.col("size")).over(upto) - F.col("size")).alias("start"), F.sum(F.col("gap") + F.col("size")).over(upto).alias("end"))


#: An SPDX expression after its tag: identifiers joined by operators.
SPDX_ID = r"[a-z0-9]+(?:[.:+-][a-z0-9]+)*\+?"
EXPRESSION = rf"spdx-license-identifier:([\x09\x20(]*{SPDX_ID}(?:[\x09\x20)]+(?:or|and|with)[\x09\x20(]+{SPDX_ID})*)"


def expression_labels(text: Column) -> Column:
    """Labels of every licence in the text's SPDX expressions; the tag rules find the first one only. What follows "with" is an exception."""
    stems = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(f"^{stem}{SUFFIX}$").alias("pattern")) for label, stem in dict.fromkeys(x[:2] for x in LICENSES)])
    bare = lambda e: F.regexp_replace(e, rf"[\x09\x20)]with[\x09\x20(]+{SPDX_ID}", "")
    operands = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(1)), lambda e: F.split(bare(e), r"[\x09\x20()]+", -1))))
    found = let(operands, lambda ids: F.transform(F.filter(stems, lambda s: F.exists(ids, lambda o: F.regexp_like(o, s["pattern"]))), lambda s: s["label"]))
    return F.when(F.contains(text, F.lit("spdx-license-identifier")), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def resolve(found: DataFrame, key: str) -> DataFrame:
    """``found`` without detections inside another one of the same or a higher priority, with label and confidence."""
    named = found.withColumn("r", F.get(_rule_table(), F.col("rule"))).select(*found.columns, "r.label", "r.priority", "r.confidence")
    order = Window.partitionBy(key).orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({form[0] for form in FORMS.values()})
    ends = {p: F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order) for p in levels}
    covered = F.coalesce(*[F.when(F.col("priority") == p, F.coalesce(ends[p] >= F.col("end"), F.lit(False))) for p in levels])
    return named.withColumn("covered", covered).filter("NOT covered").drop("covered")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs``."""
    text = ascii_lower(F.coalesce("text", F.lit("")))
    anchored = reduce(Column.__or__, [*(F.contains(F.col("low"), F.lit(a)) for a in dict.fromkeys((*ANCHORS, *(_keyword(x[1]) for x in SENTENCES)))), F.col("low").rlike(BASE_ANCHOR)])
    # Rows get an arbitrary number, fixed by the checkpoint, so that repeated ids stay apart. Only anchored texts are kept there.
    lowered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("low"))
    lowered = lowered.select("*", anchored.alias("anchored"))
    words = lambda c: F.array_remove(F.split(c, WORD_GAP, -1), "")
    counted = lowered.select(
        "doc_id",
        "row",
        let(words(F.col("low")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.col("low").rlike(BASE_ANCHOR), _base_places(w)).alias("base"))).alias("w"),
        F.when(F.col("anchored"), F.col("low")).alias("low"),
    )
    counted = cut_lineage(counted.select("doc_id", "row", "w.n_words", "w.base", "low"))
    kept = resolve(detections(counted.filter("low IS NOT NULL").select("row", "low"), "row", "low"), "row")
    per_row = kept.groupBy("row").agg(F.collect_set("label").alias("added"), F.max("confidence").alias("best"))
    tagged = F.when(F.col("low").isNotNull(), expression_labels(F.col("low"))).otherwise(F.array().cast("array<string>"))
    joined = counted.withColumn("tagged", tagged).drop("low").join(per_row, "row", "left")
    starts = F.transform("base", lambda x: x["start"])
    names = F.coalesce(F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"]))), F.array().cast("array<string>"))
    alone = F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("base").isNotNull(), F.size("base")).otherwise(0).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.array_union(names, "tagged"), F.coalesce("added", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("tagged") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), alone).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
