"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Lines, their sentences, and whole texts are compared with templates: short notices and file headers,
SPDX tags, and the opening lines of licence texts. Terms weigh by their document frequency over all
documents, whether a template has them or not, so a score does not depend on the size
of the table but on the shares of documents. A part with the cosine `least` to a template shares one of that template's
heavy terms (those without which its remaining length falls below `least`), so one
pattern over the whole text finds every candidate.

A file has the licence of its best part. A file that matches a template as a whole, or that has the opening
line of a licence's own text, is a licence file and gives its licence to its directory. A file without a
notice has that of the nearest directory above it that has one, found by joining the
directories, not the files, with their ancestors.

All of it is DataFrame expressions; only the templates and one count per term of theirs
come to the driver.

Defined results: NULL and empty texts have no notice and inherit; a row without an id is counted, has no notice of its own and
inherits; a NULL part of a path is an empty name; equal cosines go by the licence's name, equal licence files by the smaller
id; repeated rows are reported each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.registry import given, query
from ratingloom.llm.scratch import Scratch

#: Cosine from which a part counts as a template's.
LEAST = 0.6
#: Short notices and file headers of common licences.
NOTICES = (
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "licensed under the BSD 3-Clause License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0"),
    ("EPL-2.0", "licensed under the Eclipse Public License, version 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "released into the public domain under the Unlicense"),
)

#: Opening lines of the licences' own texts.
OPENINGS = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: (licence, text, whether it opens the licence's own text)
TEMPLATES = (
    *((name, text, False) for name, text in NOTICES), *((name, f"SPDX-License-Identifier: {name}", False) for name, _ in NOTICES),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3", False),
    *((name, text, True) for name, text in OPENINGS),
)
#: What ends a sentence within a line.
SENTENCE_END = r"[.;!?][ \t]+"


def _terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def terms(text: Column) -> Column:
    """The lower-cased runs of a-z and 0-9 of a text."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, k: how many rows have it. Terms are counted in each task before they are shuffled."""
    return docs.select(F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term")).groupBy("term").agg(F.count("*").alias("k"))


def heavy_terms(templates: list[dict[str, float]], least: float) -> set[str]:
    """Terms of which a text must have one to reach the cosine `least` with any of the templates."""
    out: set[str] = set()
    for weights in templates:
        rest = sum(w * w for w in weights.values())
        bound = least * least * rest
        for term, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
            if rest < bound * (1 - 1e-9):
                break
            out.add(term)
            rest -= w * w
    return out


def notices(docs: DataFrame, templates: tuple[tuple[str, str, bool], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, licence, score, whole of the best match of every document that has one; whole: it is a licence file."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licences")
    held, n = scratch.write(document_frequencies(docs), "frequencies"), docs.count()
    vocabulary = sorted({t for _, text, _ in templates for t in _terms(text)})
    known = {r["term"]: r["k"] for r in held.where(F.col("term").isin(vocabulary)).toLocalIterator()}  # one row per term of the templates
    weight = {t: math.log((1 + n) / (1 + known.get(t, 0))) + 1 for t in vocabulary}
    vectors = [{t: c * weight[t] for t, c in Counter(_terms(text)).items()} for _, text, _ in templates]
    rows = [
        (t, k, name, opens, w * weight[t] / math.sqrt(sum(x * x for x in v.values())))
        for k, ((name, _, opens), v) in enumerate(zip(templates, vectors, strict=True)) for t, w in v.items()
    ]
    table = spark.createDataFrame(rows, "term string, template int, licence string, opens boolean, share double")

    pattern = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(heavy_terms(vectors, least))) + r")(?![a-z0-9])"
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(pattern))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(pattern))
    sentences = F.flatten(F.transform(lines, lambda line: F.split(line, SENTENCE_END)))
    parts = texts.select("doc_id", F.xxhash64("text").alias("content"), F.posexplode(F.concat(F.array("text"), lines, F.filter(sentences, lambda x: x.rlike(pattern)))).alias("part", "line"))
    counts = parts.select("doc_id", "content", "part", F.explode(terms(F.col("line"))).alias("term")).groupBy("doc_id", "content", "part", "term").agg(F.count("*").alias("n"))
    key = ["doc_id", "content", "part"]
    counts = scratch.write(counts, "counts")  # read for the lengths and for the products
    weighed = counts.join(held, "term").withColumn("w", F.col("n") * (F.log((1 + n) / (1 + F.col("k"))) + 1))
    length = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    product = counts.join(F.broadcast(table), "term").groupBy(*key, "template", "licence", "opens").agg(F.sum(F.col("n") * F.col("share")).alias("product"))
    scored = product.join(length, key).withColumn("score", F.round(F.least(F.lit(1.0), F.col("product") / F.col("length")), 6)).where(F.col("score") >= least)
    best = scored.groupBy("doc_id").agg(
        F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence", "part")).alias("best"), F.max((F.col("part") == 0) | F.col("opens")).alias("whole")
    )
    return best.select("doc_id", "best.licence", "best.score", "whole")


def inherited(files: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, path, licence, score, origin, directory for every row of files (doc_id, directory, path).

    origin is `file` for a licence file, `header` for a notice, `inherited` for a
    licence of `directory` or of one above it, and NULL without any.
    """
    own = files.join(found, "doc_id", "left")
    givers = own.where("whole").groupBy("directory").agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "doc_id")).alias("given"))
    directories = files.select("directory").distinct()
    names = F.split("directory", "/")
    above = directories.select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, F.lit(1), k), "/").alias("ancestor")))).alias("a"))
    nearest = (
        above.select("directory", "a.depth", "a.ancestor").join(givers.withColumnRenamed("directory", "ancestor"), "ancestor")
        .groupBy("directory").agg(F.max_by(F.struct("ancestor", "given"), "depth").alias("near"))
    )
    all_ = own.join(nearest, "directory", "left")
    mine = F.col("licence").isNotNull()
    return all_.select(
        "doc_id", "path", F.coalesce("licence", "near.given.licence").alias("licence"), F.coalesce("score", "near.given.score").alias("score"),
        F.when(mine & F.col("whole"), "file").when(mine, "header").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(mine, F.col("directory")).otherwise(F.col("near.ancestor")).alias("directory"),
    )


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files: the source is the top directory, the language the one below."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    directory = F.concat_ws("/", name("source"), name("lang"))
    return docs.select("doc_id", directory.alias("directory"), F.concat_ws("/", directory, name("doc_id")).alias("path"))


def _oracle() -> str:
    rows = ", ".join(f"({k}, '{name}', {str(opens).lower()}, '{t}', {c})" for k, (name, text, opens) in enumerate(TEMPLATES) for t, c in sorted(Counter(_terms(text)).items()))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') || '/' || coalesce(lang, '') AS directory FROM documents),
templates(template, licence, opens, term, c) AS (VALUES {rows}),
size AS (SELECT count(*) AS n FROM d),
numbered AS (SELECT row_number() OVER () AS r, t FROM d),
held AS (SELECT term, count(DISTINCT r) AS k FROM (SELECT r, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM numbered) GROUP BY 1),
weight AS (SELECT term, ln((1 + n) / (1 + k)::DOUBLE) + 1 AS weight FROM (SELECT term, k FROM held UNION ALL SELECT DISTINCT term, 0 FROM templates WHERE term NOT IN (SELECT term FROM held)) CROSS JOIN size),
vec AS (SELECT template, licence, opens, t.term, c * weight * weight AS share, sqrt(sum(c * weight * c * weight) OVER (PARTITION BY template)) AS length FROM templates t JOIN weight USING (term)),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
parts AS (SELECT row_number() OVER () AS part, * FROM (SELECT doc_id, true AS entire, t AS line FROM d UNION ALL SELECT doc_id, false, line FROM lines UNION ALL SELECT doc_id, false, unnest(string_split_regex(line, '{SENTENCE_END}')) FROM lines)),
terms AS MATERIALIZED (SELECT part, any_value(doc_id) AS doc_id, any_value(entire) AS entire, term, count(*) AS n FROM (SELECT doc_id, part, entire, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM parts) GROUP BY part, term),
norm AS (SELECT part, sqrt(sum(t.n * weight * t.n * weight)) AS length FROM terms t JOIN weight w USING (term) GROUP BY 1),
scored AS (SELECT any_value(t.doc_id) AS doc_id, t.part, any_value(v.licence) AS licence, any_value(t.entire OR v.opens) AS whole, round(least(1.0, sum(t.n * v.share) / any_value(v.length) / any_value(m.length)), 6) AS score
  FROM terms t JOIN vec v USING (term) JOIN norm m USING (part) GROUP BY t.part, v.template HAVING score >= {LEAST}),
own AS (SELECT doc_id, first(licence ORDER BY score DESC, licence) AS licence, max(score) AS score, bool_or(whole) AS whole FROM scored GROUP BY 1),
files AS (SELECT d.doc_id, d.directory, o.licence, o.score, o.whole FROM d LEFT JOIN own o USING (doc_id)),
givers AS (SELECT directory, first(licence ORDER BY score DESC, doc_id) AS licence, max(score) AS score FROM files WHERE whole GROUP BY 1),
near AS (SELECT f.directory, arg_max(struct_pack(a := g.directory, licence := g.licence, score := g.score), length(g.directory)) AS near
  FROM (SELECT DISTINCT directory FROM files) f JOIN givers g ON f.directory = g.directory OR starts_with(f.directory, g.directory || '/') GROUP BY 1)
SELECT doc_id, f.directory || '/' || doc_id AS path, coalesce(licence, near.licence) AS licence, coalesce(score, near.score) AS score,
  CASE WHEN licence IS NOT NULL AND whole THEN 'file' WHEN licence IS NOT NULL THEN 'header' WHEN near IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN licence IS NOT NULL THEN f.directory ELSE near.a END AS directory
FROM files f LEFT JOIN near USING (directory)"""


@query("op10_license_inheritance", _oracle())
def op10_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    return inherited(files_of(docs), notices(docs))
