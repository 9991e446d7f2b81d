"""License scans, in DataFrame and SQL functions only.

The segments of a file are its lines, pairs of lines that follow each other, and sentences, which may run over the
lines of a paragraph; marks of comments at the beginning of lines don't break them.  A segment's sparse TF-IDF
vector is compared by cosine to those of notice templates, which have short, header and full-text forms; a file's
own license is that of its best segment.  A license file (LICENSE, COPYING and the like) speaks
for its directory, and a file without a license of its own takes that of its nearest ancestor directory, found
by an equality join of its ancestors' paths with the directories that have one.

Weights: idf = ln((1 + files) / (1 + files that hold the term)) + 1, counted over all files for every term of a
line that is compared, so a word's weight depends on its share of the files and not on their number.  (For the
templates' own terms the files where the term stands alone count.)  Terms are runs of letters, or digits with
points; STOP terms count nowhere.

A line can reach the threshold only if it holds one of the telling terms (see ``telling``), so lines without one
are passed over before they are taken apart: that changes no license, but scores below the threshold are null.

Defined results: null or empty texts have no license; texts are read whole, however long; ties of score go to the
smaller license name; a null path has no ancestors; repeated rows and equal paths are files of their own; an empty table
gives no rows; other columns are returned as they are, whatever their names, but for those named like a result, which the
result replaces.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, partitions_for

THRESHOLD = 0.7
#: Rows (a term or a directory each) of tables that are broadcast, at most; larger ones are shuffled.
BROADCAST_ROWS = 100_000
#: Segments that one task scores.
SEGMENTS = 200

# Notices of public licenses by SPDX identifier, and terms too common to tell them apart.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This project is licensed under the Apache License 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License Version 2.0, January 2004.", "Apache-2.0 License"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "Released under the BSD 3-Clause License.", "This project is licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "Dedicated to the public domain under CC0."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2.", "GNU General Public License Version 2, June 1991.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", "GPL-2.0 License"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0 License"),
    "ISC": ("Released under the ISC License.", "This project is licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "Released under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "LGPL-3.0 License"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0", "MPL-2.0 License"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
STOP = frozenset("a an and any are as at be by for from in is it of on or out that the this to under was with without you spdx identifier".split())

TERM = re.compile(r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*")
#: Marks of comments and space at the beginning of a line.
MARKS = r"[ \t#*/;%>|-]*"
LICENSE_FILE = r"(?i)^(licen[sc]e|licen[sc]es|copying|unlicense|notice)([.-].*)?$"
#: Characters of a heading's line, at most; longer lines are none.
LINE = 200
#: First lines of license texts, the headings that these licenses publish.
HEADINGS = ("Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "BSD 3-Clause License", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International", "CC0 1.0 Universal", "GNU General Public License", "GNU General Public License Version 2, June 1991", "GNU General Public License Version 3, 29 June 2007", "GNU Lesser General Public License", "GNU Lesser General Public License Version 3, 29 June 2007", "ISC License", "MIT License", "The MIT License (MIT)", "Mozilla Public License Version 2.0")


def terms_of(text: str) -> Counter:
    return Counter(t for t in TERM.findall(text.lower()) if t not in STOP)


_TEXTS = [(name, terms_of(text)) for name, texts in sorted(TEMPLATES.items()) for text in texts]
VOCABULARY = sorted({t for _, terms in _TEXTS for t in terms})


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM.pattern), F.lit(0))


def alone(terms: list[str]) -> str:
    """A pattern for any of the terms standing alone, alternatives parted by their first character."""
    by_first: dict[str, list[str]] = {}
    for term in terms:
        by_first.setdefault(term[0], []).append(re.escape(term[1:]))
    inner = "|".join(f"{re.escape(c)}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in sorted(by_first.items()))
    return rf"(?<![a-z0-9.])(?:{inner})(?![a-z0-9])"


def telling(weights: dict[str, float], threshold: float) -> list[str]:
    """Terms of which any line that reaches the threshold holds one.

    A line that shares only other terms with a template has at most the length that those have in its unit
    vector as cosine; the lightest terms are left out as long as that stays below the threshold.
    """
    vectors = [{t: c * weights[t] for t, c in own.items()} for _, own in _TEXTS]
    norms = [sum(v * v for v in vector.values()) for vector in vectors]
    left = [0.0] * len(vectors)
    needed = []
    for term in sorted(VOCABULARY, key=lambda t: (not t[0].isdigit(), weights[t], t)):
        more = [x + v.get(term, 0.0) ** 2 / n for x, v, n in zip(left, vectors, norms)]
        if all(x < threshold**2 * 0.99 for x in more):
            left = more
        else:
            needed.append(term)
    return needed


def _lines(text: Column, needed: list[str]) -> Column:
    """Segments that hold a needed term, as different arrays of terms."""
    lower, some = F.lower(F.coalesce(text, F.lit(""))), F.lit(alone(needed))
    holds = lambda x: x.rlike(alone(needed))
    paragraphs = F.filter(F.split(lower, rf"\r?\n{MARKS}(?:\r?\n{MARKS})+"), holds)

    def segments(paragraph):
        lines = F.split(paragraph, r"\r?\n")
        pairs = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.concat_ws(" ", F.get(lines, i - 1), F.get(lines, i)))
        sentences = F.split(F.regexp_replace(paragraph, rf"\r?\n{MARKS}", " "), r"(?<=[.!?])\s+")
        return F.transform(F.filter(F.concat(lines, pairs, sentences), holds), _terms)

    found = F.array_distinct(F.flatten(F.transform(paragraphs, segments)))
    # texts without a needed term are passed over whole
    return F.when(F.regexp_instr(lower, some) > 0, found).otherwise(F.array().cast("array<array<string>>"))


def idf(files: DataFrame, text: str) -> tuple[dict[str, float], int]:
    """Weights of the templates' terms, and how many files there are."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(alone(VOCABULARY)), F.lit(0)))
    counted = files.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("t")).groupBy("t").count()
    n = {r.t: r["count"] for r in counted.collect()}  # a row a term of the templates
    total = n.pop("", 0)
    return {t: math.log((1 + total) / (1 + n.get(t, 0))) + 1 for t in VOCABULARY}, total


def _others(terms: Column) -> Column:
    """Terms that no template has and that count."""
    return F.array_except(terms, F.array(*map(F.lit, sorted({*VOCABULARY, *STOP}))))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def other_weights(files: DataFrame, text: str, lines: DataFrame, total: int) -> DataFrame:
    """term, weight of the lines' other terms, counted over all files."""
    wanted = _small(checkpointed(lines.select(F.explode(_others(F.col("line"))).alias("term")).distinct()))
    held = files.select(F.explode(F.array_distinct(_terms(F.col(text)))).alias("term"))
    counted = held.join(wanted, "term", "left_semi").groupBy("term").count()
    return counted.select("term", (F.log((1 + F.lit(total)) / (1 + F.col("count"))) + 1).alias("weight"))


def _scores(weights: dict[str, float], terms: Column, others: Column) -> Column:
    """The best template of a line: struct score, minus the template's place; others is the sum of squares of its other terms."""
    vectors = [{t: c * weights[t] for t, c in own.items()} for _, own in _TEXTS]
    norms = [math.sqrt(sum(v * v for v in vector.values())) for vector in vectors]
    table = F.create_map(*(x for t in VOCABULARY for x in (F.lit(t), F.array(*(F.lit(weights[t] * v.get(t, 0.0) / n) for v, n in zip(vectors, norms))))))
    idfs = F.create_map(*(x for t in VOCABULARY for x in (F.lit(t), F.lit(weights[t]))))
    known = F.filter(terms, lambda t: F.map_contains_key(idfs, t))
    dots = F.aggregate(known, F.array_repeat(F.lit(0.0), len(vectors)), lambda a, t: F.zip_with(a, F.element_at(table, t), lambda x, y: x + y))
    squares = F.aggregate(F.array_distinct(known), F.lit(0.0), lambda a, t: a + F.pow(F.size(F.filter(known, lambda u: u == t)) * F.element_at(idfs, t), 2.0))
    norm = F.sqrt(squares + others)
    return F.array_max(F.transform(dots, lambda d, i: F.struct(F.round(d / norm, 6).alias("score"), (-i).alias("place"))))


def own_licenses(files: DataFrame, text: str, path: str, threshold: float = THRESHOLD) -> DataFrame:
    """file (all columns but the text), path, own_license and own_score, that of the best segment; null where none reaches the threshold."""
    weights, total = idf(files, text)
    names = F.array(*(F.lit(name) for name, _ in _TEXTS))
    kept = F.struct(*(F.col(f"`{c}`") for c in files.columns if c != text))
    scanned = files.select(kept.alias("file"), F.col(path).alias("path"), _lines(F.col(text), telling(weights, threshold)).alias("lines"), F.monotonically_increasing_id().alias("row"))
    scanned = checkpointed(scanned)  # rows keep their numbers
    lines = scanned.select("row", F.posexplode("lines").alias("at", "line"))
    placed = lines.select("row", "at", F.explode("line").alias("term")).groupBy("row", "at", "term").count()
    squares = placed.join(other_weights(files, text, lines, total), "term").groupBy("row", "at").agg(F.sum(F.pow(F.col("count") * F.col("weight"), 2.0)).alias("others"))
    # few bytes and much work: dealt out by number of segments, which their size wouldn't do
    compared = lines.join(squares, ["row", "at"], "left").repartition(partitions_for(lines.count(), SEGMENTS))
    scored = compared.select("row", _scores(weights, F.col("line"), F.coalesce("others", F.lit(0.0))).alias("score"))
    best = scored.groupBy("row").agg(F.max("score").alias("best"))
    scored = scanned.drop("lines").join(best.filter(F.col("best.score") >= threshold), "row", "left")
    name = F.when(F.col("best").isNotNull(), F.element_at(names, (1 - F.col("best.place")).cast("int")))
    return scored.select("file", "path", name.alias("own_license"), F.col("best.score").alias("own_score"))


def inherited(files: DataFrame) -> DataFrame:
    """Of rows (file, path, own_license, own_score): adds license, via and inherited_from.

    Directories with a license file are joined to the ancestors of the other files by path; a row a directory
    on one side, so a crowded directory meets one row, and the nearest ancestor is kept by an aggregate.
    """
    parts = F.split("path", "/")
    placed = files.withColumn("directory", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    speaks = F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE) & F.col("own_license").isNotNull()
    notices = placed.filter(speaks).groupBy("directory").agg(F.min_by("own_license", F.struct((-F.col("own_score")).alias("s"), "own_license", "path")).alias("notice"))
    without = placed.filter("own_license IS NULL AND path IS NOT NULL")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, k), "/")).alias("ancestor")))
    # files of one directory have the same ancestors: they are joined once for each directory
    directories = without.select("directory", F.array_distinct(levels).alias("levels")).dropDuplicates(["directory"])
    near = directories.select("directory", F.explode("levels").alias("l")).join(notices.withColumnRenamed("directory", "at"), F.col("l.ancestor") == F.col("at"))
    near = near.groupBy(F.col("directory").alias("dir")).agg(F.max_by(F.struct("at", "notice"), "l.depth").alias("near"))
    # written first: then few directories are broadcast, and a join of many can split a crowded one
    joined = placed.join(_small(checkpointed(near)), (F.col("directory") == F.col("dir")) & F.col("own_license").isNull(), "left")
    license = F.coalesce("own_license", "near.notice")
    via = F.when(F.col("own_license").isNotNull(), "own").when(F.col("near.notice").isNotNull(), "inherited").otherwise("none")
    return joined.select("file", "own_license", "own_score", license.alias("license"), via.alias("via"), F.when(via == "inherited", F.col("near.at")).alias("inherited_from"))


RESULTS = ("own_license", "own_score", "license", "via", "inherited_from")


def license_scan(files: DataFrame, text: str = "text", path: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """Of files (their path, their text and other columns): all columns but the text, and RESULTS."""
    found = inherited(checkpointed(own_licenses(files, text, path, threshold)))
    return found.select(*(F.col(f"file.`{c}`") for c in files.columns if c != text and c not in RESULTS), *RESULTS)


def headed(text: Column) -> Column:
    """Whether the first line that isn't blank is the heading of a license text, and nothing else."""
    ordered = lambda line: [*dict.fromkeys(t for t in TERM.findall(line.lower()) if t not in STOP)]
    line = F.regexp_extract(text, r"^[\s#*/;%>|-]*+([^\r\n]*)", 1)
    first = F.substring(line, 1, LINE)
    terms = F.array_except(F.array_distinct(_terms(first)), F.array(*map(F.lit, sorted(STOP))))
    return F.coalesce((F.length(line) <= LINE) & F.array_join(terms, " ").isin(sorted({" ".join(ordered(h)) for h in HEADINGS})), F.lit(False))


def document_licenses(documents: DataFrame) -> DataFrame:
    """Documents as files: the path is source/lang/doc_id.txt, and source/LICENSE.doc_id of a license text.

    A license text is known by its heading, for documents have no names; it speaks for its source, in whatever language,
    and a notice in other text speaks for its document alone.  Rows without a source (null or empty) have no path; slashes in names are written %2F, so
    that no source lies within another.
    """
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("_"))
    name = lambda c: F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    inside = F.when(headed(F.col("text")), F.concat(F.lit("LICENSE."), number)).otherwise(F.concat(F.coalesce(name("lang"), F.lit("_")), F.lit("/"), number, F.lit(".txt")))
    path = F.concat(F.nullif(name("source"), F.lit("")), F.lit("/"), inside)
    files = documents.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text")
    return license_scan(files)
