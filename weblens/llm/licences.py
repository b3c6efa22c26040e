"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

1. Units. The sentences of a file that speak of licensing are units, as are whole
   licence files (by name). Sentences are cut twice: in single lines, and in paragraphs
   of joined lines without comment marks, as notices wrap. Files without such a sentence
   end here, after one regular-expression test.
2. Vectors. A unit's terms weigh (1 + ln tf) * idf; idf counts units and templates that
   hold the term, by grouped aggregation over the whole table. The cosine joins units
   and templates on terms only, so it costs what their common terms cost.
3. Decision. A file's own licence is that of its best unit, if its cosine is at least
   ``least`` (ties: the licence first in order). A licence with a version needs a unit
   that states this version; a family without one (GPL) counts where none is found. "All rights reserved" also stands above open licences, so
   Proprietary counts where no other licence is found. The BSD conditions without the
   clause on endorsement are BSD-2-Clause. SPDX-License-Identifier lines are read as they
   stand, with cosine 1: an identifier without its suffix -only or -or-later, or a whole
   expression of several.
4. Inheritance. Licence files speak for their directory. The directories of all files
   are joined, by their ancestor paths, with those that have a licence; the deepest
   one gives the licence of files that have none of their own.

Everything is DataFrame operations. A null text has no units; a null path counts as a
file without a name at the root, a null repository as one of its own. Repeated rows give
repeated results; an empty table gives an empty one. Of several licence files in one
directory the best cosine counts, then the licence first in order.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weblens.llm.common import workspace

#: What licence notices say, by SPDX name: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0, the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "Copyright. All rights reserved. No part may be reproduced without permission.",
}
#: Short forms of the notices that stand alone in a header: fixed values.
SHORT_TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Proprietary": "All rights reserved.",
}
_FSF = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_FSF_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of version {2} of the GNU {0} as published by the Free Software Foundation."
_GNU = [
    _FSF, _FSF_ONLY, "This work is licensed under the GNU {0}, version {2}.", "GNU {0} Version {2}",
    "Licensed under the {1} version {2}.", "Licensed under the GNU {1} v{2}.", "Licensed under {1}v{2}.", "Licensed under the {1}-{2} license.",
]
_GNU_ANY = ["This work is licensed under the GNU {0}.", "You should have received a copy of the GNU {0} along with this program.", "Licensed under the {1}.", "Licensed under the GNU {1}."]
_CC = [
    "This work is licensed under the Creative Commons {0} {2} International License, CC {1} {2}.", "Licensed under CC {1} {2}.",
    "This work is licensed under a Creative Commons {0} {2} {3} License.", "Creative Commons {0} {2} {3} Public License",
    "Licensed under CC-{1}-{2}.",
]
_CC_ANY = ["This work is licensed under a Creative Commons {0} License.", "Licensed under CC {1}.", "Licensed under CC-{1}."]
_NAMED = ["Licensed under the {0}, Version {2}.", "{0} Version {2}", "Licensed under the {1} {2}.", "Licensed under {1}-{2}."]
_NAMED_ANY = ["Licensed under the {0}."]
_CC_NAMES = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
_CC_KINDS = {code: "-".join(_CC_NAMES[part] for part in code.split("-")) for code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")}

#: Families of versions: SPDX name, full name, abbreviation, versions, notices with and without a version.
FAMILIES = [
    ("GPL", "General Public License", "GPL", ("1.0", "2.0", "3.0"), _GNU, _GNU_ANY),
    ("LGPL", "Lesser General Public License", "LGPL", ("2.1", "3.0"), _GNU, _GNU_ANY),
    ("LGPL", "Library General Public License", "LGPL", ("2.0",), _GNU, _GNU_ANY),
    ("AGPL", "Affero General Public License", "AGPL", ("1.0", "3.0"), _GNU, _GNU_ANY),
    ("Apache", "Apache License", "Apache", ("1.0", "1.1", "2.0"), _NAMED, _NAMED_ANY),
    ("MPL", "Mozilla Public License", "MPL", ("1.0", "1.1", "2.0"), [*_NAMED, "This Source Code Form is subject to the terms of the Mozilla Public License, v. {2}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/{2}/.", "The contents of this file are subject to the Mozilla Public License Version {2} (the License); you may not use this file except in compliance with the License."], _NAMED_ANY),
    ("EPL", "Eclipse Public License", "EPL", ("1.0", "2.0"), [*_NAMED, "This program and the accompanying materials are made available under the terms of the Eclipse Public License v{2} which accompanies this distribution."], _NAMED_ANY),
    *((f"CC-{code}", name, code, ("1.0", "2.0", "2.5", "3.0", "4.0"), _CC, _CC_ANY) for code, name in _CC_KINDS.items()),
]
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_DISCLAIMED = " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
#: Standard headers and whole texts of licences without versions.
STANDARD = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License);"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"), ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"), ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MIT", "The MIT License (MIT)"), ("MIT", "Licensed under the MIT License."), ("MIT", "Licensed under MIT."), ("MIT", _MIT), ("MIT", _MIT + _MIT_REST),
    ("ISC", "Licensed under the ISC License."), ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _DISCLAIMED),
    ("0BSD", _GRANT + "."), ("0BSD", _GRANT + "." + _DISCLAIMED),
    ("BSD-3-Clause", _BSD), ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."), ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."), ("Unlicense", "Licensed under the Unlicense."),
]

#: Between the words of a wrapped notice: blanks, line ends and comment marks.
_GAP = r"[\s/*#;%-]+"
NOTICE = r"(?i)licen[cs]e|all rights reserved|permission is hereby|permission to use|redistribution and use|unencumbered software".replace(" ", _GAP)
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([(]?[a-z0-9][a-z0-9.+ ()-]*)"
VERSION = r"-([0-9]+(?:[.][0-9]+)?)$"
#: The BSD conditions, and the clause that only three of them hold.
_CONDITIONS, _THIRD = "(?i)" + r"binary form must reproduce".replace(" ", _GAP), "(?i)" + r"endorse or promote".replace(" ", _GAP)
LEAST_COSINE = 0.6


def terms(text: Column) -> Column:
    """Lower-case terms; a version's v and final .0 are left out."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9.-]+|[.-]+(?=\s|$)"), lambda t: t != "")
    return F.transform(words, lambda t: F.regexp_replace(F.regexp_replace(t, r"^v(?=[0-9])", ""), r"^([0-9]+)[.]0[.]?$", "$1"))


def paragraphs(text: Column) -> Column:
    """The text without comment marks, one line per paragraph.

    Blank lines, the marks around block comments, the step between lines with and
    without a line comment, and copyright lines end a paragraph.
    """
    steps = (
        (r"\r\n?", "\n"),
        (r"(?m)^[ \t]*(?:/\*+|<!--+|[\x22]{3}|'{3}|\(\*|\{-)", "\n\n"),
        (r"[ \t]*(?:\*+/|--+>|[\x22]{3}|'{3}|\*\)|-\})", "\n\n"),
        (r"(?m)^[ \t]*(?://+!?|#+|--+|;+|%+|(?i:rem|dnl)\b)", "\u0001"),
        (r"(?m)^([^\u0001\n].*)\n(?=\u0001)", "$1\n\n"),
        (r"(?m)^(\u0001.*)\n(?=[^\u0001\n])", "$1\n\n"),
        (r"(?m)^[ \t\u0001]*\**[ \t]*", ""),
        (r"(?mi)^((?:copyright )?(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9]{4}).*)$", "\n$1\n"),
        (r"(?<!\n)\n(?!\n)", " "),
    )
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def sentences(text: Column) -> Column:
    """Sentences and lines that speak of licensing."""
    return F.filter(F.split(text, r"\n|(?<=[.!?])(?<![\s(][vV]\.)\s+"), lambda s: s.rlike(NOTICE))


def wrapped(text: Column) -> Column:
    """Sentences that speak of licensing, of single lines and of joined ones."""
    blanks = lambda parts: F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.array_union(sentences(text), blanks(sentences(paragraphs(text))))


def template_rows() -> list[tuple[str, int, str]]:
    """(licence, form, text), each text once."""
    rows = [*TEMPLATES.items(), *SHORT_TEMPLATES.items(), *STANDARD]
    for family, name, short, versions, dated, undated in FAMILIES:
        for version in versions:
            for number in dict.fromkeys((version, version.removesuffix(".0"))):
                port = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
                rows += [(f"{family}-{version}", form.format(name, short, number, port)) for form in dated]
        rows += [(family, form.format(name, short)) for form in undated]
    return [(licence, n, text) for n, (licence, text) in enumerate(dict.fromkeys(rows))]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "licence string, form int, text string")


def identifiers(text: Column) -> Column:
    """What a text's SPDX lines declare."""
    names = {licence.lower(): licence for licence, _, _ in template_rows()}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def one(found: Column) -> Column:
        found = F.trim(F.regexp_replace(found, r"^[( ]+(?=[^()]*[)]?\s*$)|(?<=[^)])[) ]+$|\s+$", ""))
        bare = F.regexp_replace(found, r"(?i)(-only|-or-later|[+])$", "")
        found = F.when(found.contains(" "), found).otherwise(bare)
        return F.coalesce(F.try_element_at(known, F.lower(found)), found)

    return F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), one)


def _weights(counted: DataFrame, idf: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, term, w) and (keys, norm) of rows (keys, term, tf)."""
    w = counted.join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf")).select(*keys, "term", "w")
    return w, w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def own_licences(files: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(text_key, is_file, licence, cosine) of the texts of ``files`` (text_key, text, is_file) that have one."""
    spark = files.sparkSession
    space = workspace(spark, "licences")
    noticed = files.where(F.col("text").rlike(NOTICE) | F.col("is_file"))
    parts = wrapped(F.col("text"))
    parts = F.when(F.col("is_file"), F.concat(parts, F.array("text"))).otherwise(parts)
    two = F.col("text").rlike(_CONDITIONS) & ~F.col("text").rlike(_THIRD)
    noticed = noticed.select("text_key", "is_file", F.array_distinct(parts).alias("parts"), two.alias("two"), identifiers(F.col("text")).alias("spdx"))
    noticed = space.table("noticed", noticed.dropDuplicates(["text_key", "is_file"]))
    units = noticed.select("text_key", "is_file", "two", F.explode("parts").alias("unit"))
    # Notices repeat: each distinct unit is compared once.
    units = space.table("units", units.withColumn("unit_key", F.sha2("unit", 256)))
    counted = units.groupBy("unit_key").agg(F.first("unit").alias("unit"), F.count("*").alias("times"))
    counted = counted.withColumn("term", F.explode(terms(F.col("unit")))).groupBy("unit_key", "times", "term").agg(F.count("*").alias("tf"))
    counted = space.table("unit-terms", counted)
    given = templates(spark).withColumn("term", F.explode(terms(F.col("text")))).groupBy("licence", "form", "term").agg(F.count("*").alias("tf"))
    version = F.regexp_replace(F.regexp_extract("licence", VERSION, 1), "[.]0$", "")
    states = (version == "") | F.rlike("term", F.concat(F.lit("(^|[a-z-])"), F.regexp_replace(version, "[.]", "[.]"), F.lit("([.]0)?$")))
    given = space.table("template-terms", given.withColumn("states", states))
    n = F.lit(len(template_rows())) + F.col("total")
    held = counted.select("term", "times").union(given.select("term", F.lit(1).cast("long")))
    total = units.agg(F.count("*").alias("total"))
    held = held.groupBy("term").agg(F.sum("times").alias("df")).join(F.broadcast(total))  # one row
    idf = space.table("idf", held.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    w, norms = _weights(counted, idf, ["unit_key"])
    v, lengths = _weights(given, idf, ["licence", "form"])
    v = v.withColumnRenamed("w", "v").join(given.select("licence", "form", "term", "states"), ["licence", "form", "term"])
    dots = w.join(v, "term").groupBy("unit_key", "licence", "form").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.max("states").alias("stated"))
    dots = dots.where("stated").drop("stated")
    cosines = dots.join(norms.withColumnRenamed("norm", "a"), "unit_key").join(lengths.withColumnRenamed("norm", "b"), ["licence", "form"])
    cosines = cosines.withColumn("cosine", F.round(F.col("dot") / (F.col("a") * F.col("b")), 9)).where(F.col("cosine") >= least)
    families = [family for family, *_ in FAMILIES]
    weak = F.when(F.col("licence") == "Proprietary", 2).when(F.col("licence").isin(families), 1).otherwise(0)
    best = F.min(F.struct(weak.alias("weak"), (-F.col("cosine")).alias("c"), "licence")).alias("best")
    by_unit = cosines.groupBy("unit_key").agg(best).select("unit_key", "best.licence", (-F.col("best.c")).alias("cosine"))
    said = F.when(F.col("two") & (F.col("licence") == "BSD-3-Clause"), "BSD-2-Clause").otherwise(F.col("licence"))
    compared = units.join(by_unit, "unit_key").select("text_key", "is_file", said.alias("licence"), "cosine")
    declared = noticed.select("text_key", "is_file", F.explode("spdx").alias("licence"), F.lit(1.0).alias("cosine"))
    by_text = compared.union(declared).groupBy("text_key", "is_file").agg(best)
    return space.table("own", by_text.select("text_key", "is_file", "best.licence", (-F.col("best.c")).alias("cosine")))


def directory(path: Column) -> Column:
    """The directory of a path, without slashes at its ends; the root is empty."""
    return F.regexp_extract(F.regexp_replace(path, "^/+", ""), "^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The folder and all above it, deepest first; the last is the root."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    depths = F.sequence(F.size(parts), F.lit(0), F.lit(-1))
    return F.transform(depths, lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))


def scan(files: DataFrame, id_column: str = "doc_id", least: float = LEAST_COSINE) -> DataFrame:
    """One row per row of ``files`` (id, repo, path, text).

    id, repo, path, licence (null if none), cosine (of the own or inherited notice),
    basis ('own', 'inherited', 'none') and licence_dir (where it was inherited from).
    """
    space = workspace(files.sparkSession, "inherit")
    path = F.coalesce("path", F.lit(""))
    rows = files.select(
        F.col(id_column), "repo", "path", F.col("text"),
        F.xxhash64("text", F.lit("licence")).alias("text_key"),
        path.rlike(LICENCE_FILE).alias("is_file"),
        directory(path).alias("folder"),
    )
    own = own_licences(rows.where("text is not null").select("text_key", "text", "is_file"), least)
    named = rows.select(id_column, "repo", "path", "text_key", "is_file", "folder").join(own, ["text_key", "is_file"], "left")
    named = space.table("named", named)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best")
    speaking = named.where("is_file and licence is not null").groupBy("repo", "folder").agg(best)
    speaking = space.table("speaking", speaking.select(F.col("repo").alias("r"), F.col("folder").alias("above"), F.col("best.licence").alias("given"), (-F.col("best.c")).alias("given_cosine")))
    folders = named.select("repo", "folder").distinct().withColumn("up", F.explode(ancestors(F.col("folder"))))
    met = folders.join(speaking, F.col("repo").eqNullSafe(F.col("r")) & (F.col("up") == F.col("above")))
    nearest = met.groupBy("repo", "folder").agg(F.max(F.struct(F.length("above").alias("deep"), "above", "given", "given_cosine")).alias("n"))
    nearest = space.table("nearest", nearest.select(F.col("repo").alias("r"), F.col("folder").alias("f"), "n.above", "n.given", "n.given_cosine"))
    joined = named.join(nearest, F.col("repo").eqNullSafe(F.col("r")) & (F.col("folder") == F.col("f")), "left")
    has, inherits = F.col("licence").isNotNull(), F.col("licence").isNull() & F.col("given").isNotNull()
    return joined.select(
        id_column, "repo", "path",
        F.coalesce("licence", "given").alias("licence"),
        F.when(has, F.col("cosine")).otherwise(F.col("given_cosine")).alias("cosine"),
        F.when(has, "own").when(inherits, "inherited").otherwise("none").alias("basis"),
        F.when(inherits, F.col("above")).alias("licence_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: the source is the repository, ids by 1,000 and by 20 are its folders.

    A document that is little more than a notice (its licence sentences make half of
    its characters) takes the name of a licence file.
    """
    said = F.aggregate(sentences(F.col("text")), F.lit(0), lambda n, s: n + F.length(s))
    mostly = F.when(F.col("text").rlike(NOTICE), said * 2 >= F.length("text")).otherwise(F.lit(False))
    number = F.col("doc_id").cast("string")
    name = F.when(mostly, F.lit("LICENSE")).otherwise(F.concat(number, F.lit(".txt")))
    folders = (F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 20).cast("string"))
    return docs.select("doc_id", F.col("source").alias("repo"), F.concat_ws("/", *folders, name).alias("path"), "text")
