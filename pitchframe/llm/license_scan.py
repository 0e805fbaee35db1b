"""Licences of files: TF-IDF cosine of notices to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import LOWER, UPPER, lower_ascii, table
from pitchframe.plans.session import staged, tune

TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
# Stop words: they say nothing about a licence and are no terms.
EVERYDAY = "the of and to in a is it by you for that this with as be or are not from may can any use under out".split()
MAX_TEMPLATES = 5000
THRESHOLD = 0.6
# A notice that makes up this share of a file makes it a licence file of its directory, as does its name.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$"

# Common wordings of notices; other sets of (licence, text) can be passed.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]


def weigh(templates: list[tuple[str, str]], threshold: float) -> tuple[dict[str, float], float, list[tuple[str, int, str, float]], list[str]]:
    """idf of each template term, idf of any other term, unit weights (licence, template, term, weight), anchor terms.

    A text whose shared terms hold less than `threshold` of a template's norm can't reach that cosine. So terms may be
    passed over as long as together they hold less, and the template's other terms are its anchors: a text without any
    anchor matches nothing. Light terms are passed over first; no choice can lose a match.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    counts = [Counter(re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER)))) for _, text in templates]
    counts = [Counter({t: n for t, n in c.items() if t not in EVERYDAY}) for c in counts]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in sorted(df.items())}
    weights, anchors = [], set()
    for i, ((name, _), c) in enumerate(zip(templates, counts)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        unit = sorted(((n * idf[t] / norm, t) for t, n in c.items()), reverse=True)
        weights += [(name, i, t, w) for w, t in unit]
        passed = 0.0
        for w, t in sorted(unit):
            passed += w * w
            if math.sqrt(passed) >= threshold - 1e-9:
                anchors.add(t)
                passed -= w * w
    return idf, math.log(1 + len(templates)) + 1, weights, sorted(anchors)


def _has(text: Column, anchors: list[str]) -> Column:
    return text.rlike("(?<![a-z0-9])(?:" + "|".join(map(re.escape, anchors)) + ")(?![a-z0-9])")


def own_licenses(files: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """path, license, score, share: the best notice of each file that has one.

    Every line, every block between blank lines and the whole text of each file are compared. Equal notices are merged
    before they are scored, so a notice that a third of all files carry is scored once.
    """
    spark = files.sparkSession
    idf, rare, weights, anchors = weigh(templates, threshold)
    low = files.select("path", lower_ascii(F.coalesce("text", F.lit(""))).alias("low")).where(_has(F.col("low"), anchors))
    pieces = F.array_distinct(F.concat(F.array("low"), F.split("low", r"\n\s*\n"), F.split("low", r"\n")))
    units = low.select("path", F.length("low").alias("size"), F.explode(F.filter(pieces, lambda p: _has(p, anchors))).alias("unit"))
    units = staged(units.withColumn("digest", F.unhex(F.sha2(F.col("unit").cast("binary"), 256))))
    words = F.expr(f"regexp_extract_all(unit, '{TERM}', 0)")
    bags = units.groupBy("digest", "unit").agg(F.lit(1)).select("digest", words.alias("terms"))
    # Terms of no template only matter to the norm: the squares of their counts are summed inside the row, along the
    # sorted terms (a run of n adds 1 + 3 + ... = n * n). Only terms of templates leave the row.
    inside = ", ".join(f"'{t}'" for t in [*idf, *EVERYDAY])
    others = f"array_sort(filter(terms, t -> t NOT IN ({inside})))"
    run = "if(x = a.p, a.r + 1L, 1L)"
    squares = f"aggregate({others}, named_struct('p', '', 'r', 0L, 't', 0L), (a, x) -> named_struct('p', x, 'r', {run}, 't', a.t + 2L * {run} - 1L), a -> a.t)"
    shared = "filter(terms, t -> t IN ({}))".format(", ".join(f"'{t}'" for t in idf))
    bags = staged(bags.select("digest", F.expr(squares).alias("squares"), F.expr(shared).alias("shared")))
    idfs = spark.createDataFrame(list(idf.items()), "term string, idf double")
    known = spark.createDataFrame([(n, i, t, w) for n, i, t, w in weights], "license string, template int, term string, weight double")
    tf = bags.select("digest", F.explode("shared").alias("term")).groupBy("digest", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(F.broadcast(idfs), "term").select("digest", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = tf.groupBy("digest").agg(F.sum(F.col("w") * F.col("w")).alias("known")).join(bags.select("digest", "squares"), "digest")
    norms = norms.select("digest", F.sqrt(F.col("known") + F.col("squares") * (rare * rare)).alias("norm"))
    dots = tf.join(F.broadcast(known), "term").groupBy("digest", "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "digest").select("digest", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    scored = scored.where(F.col("score") >= threshold)
    # The highest score wins, then the licence first by name.
    best = scored.groupBy("digest").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    found = units.select("path", "digest", (F.length("unit") / F.col("size")).alias("share")).join(best, "digest")
    picked = found.groupBy("path").agg(F.min(F.struct("b.s", "b.license", (-F.col("share")).alias("share"))).alias("b"))
    return picked.select("path", "b.license", (-F.col("b.s")).alias("score"), F.round(-F.col("b.share"), 6).alias("share"))


def scan_licenses(
    files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """path, license, score, origin and from_dir of every row: its own notice, else that of the nearest directory above.

    A licence file (by name, or if its notice is at least half of it) gives its licence to its directory; of several
    the best score holds, then the first by name. origin is own, inherited or NULL; score and from_dir belong to the
    notice used. NULL and empty texts have no notice of their own, a NULL path neither gives nor inherits. Rows that
    repeat a path share its best notice. Other columns are left out. An empty table gives an empty table.
    """
    files = files.select(F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text"))
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit(""))
    own = staged(own_licenses(files.where("path IS NOT NULL"), templates, threshold))
    given = own.where((F.col("share") >= FILE_SHARE) | F.col("path").rlike(FILE_NAME)).withColumn("dir", folder)
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("g"))
    given = given.select("dir", F.col("g.license").alias("d_license"), (-F.col("g.s")).alias("d_score"))
    # Paths are joined by directory, so each directory looks up its ancestors once, however many files it holds.
    here = files.select(folder.alias("here")).where("here IS NOT NULL").distinct()
    steps = F.when(F.col("here") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.expr("transform(sequence(1, size(split(here, '/'))), i -> array_join(slice(split(here, '/'), 1, i), '/'))"))
    )
    above = here.select("here", F.posexplode(F.array_distinct(steps)).alias("depth", "dir")).join(given, "dir")
    nearest = above.groupBy("here").agg(F.max(F.struct("depth", "dir", "d_license", "d_score")).alias("n"))
    nearest = nearest.select("here", F.col("n.dir").alias("from_dir"), F.col("n.d_license").alias("d_license"), F.col("n.d_score").alias("d_score"))
    rows = files.select("path", folder.alias("here")).join(own.drop("share"), "path", "left").join(nearest, "here", "left")
    mine = F.col("license").isNotNull()
    return rows.select(
        "path",
        F.coalesce("license", "d_license").alias("license"),
        F.coalesce("score", "d_score").alias("score"),
        F.when(mine, "own").when(F.col("d_license").isNotNull(), "inherited").alias("origin"),
        F.when(~mine, F.col("from_dir")).alias("from_dir"),
    )


_PATH = """concat(coalesce(source, ''), '/', coalesce(lang, ''), '/',
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat(CAST(floor(doc_id / 1000) AS STRING), '/') END, CAST(doc_id AS STRING))"""


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents have no paths: they are laid out as source/language/thousand/id, every tenth one level up."""
    tune(spark)
    files = table(spark, folder, "documents").select(F.expr(_PATH).alias("path"), "text")
    scanned = scan_licenses(files)
    return scanned.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).cast("bigint"))


def _sql() -> str:
    idf, rare, weights, anchors = weigh(TEMPLATES, THRESHOLD)
    known = ", ".join(f"('{n}', {i}, '{t}', {w!r}::DOUBLE, {idf[t]!r}::DOUBLE)" for n, i, t, w in weights)
    has = "regexp_matches({}, '(^|[^a-z0-9])(" + "|".join(map(re.escape, anchors)) + ")([^a-z0-9]|$)')"
    return f"""
WITH known(license, template, term, weight, idf) AS (VALUES {known}),
files AS (SELECT doc_id, {_PATH.replace("STRING", "VARCHAR").replace("floor(doc_id / 1000)", "doc_id // 1000")} AS path,
  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
dirs AS (SELECT doc_id, path, low, regexp_extract(path, '^(.*)/[^/]*$', 1, 's') AS here FROM files),
marked AS (SELECT * FROM dirs WHERE {has.format("low")}),
units AS (SELECT path, length(low) AS size, unnest(list_distinct([low] || regexp_split_to_array(low, '\\n\\s*\\n') || string_split(low, chr(10)))) AS unit
  FROM marked),
kept AS (SELECT * FROM units WHERE {has.format("unit")}),
terms AS (SELECT unit, unnest(regexp_extract_all(unit, '{TERM}')) AS term FROM (SELECT DISTINCT unit FROM kept)),
tf AS (SELECT unit, term, count(*) AS n FROM terms WHERE term NOT IN {tuple(EVERYDAY)} GROUP BY ALL),
w AS (SELECT unit, term, n * coalesce((SELECT any_value(idf) FROM known k WHERE k.term = tf.term), {rare!r}::DOUBLE) AS w FROM tf),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY unit),
scored AS (SELECT unit, license, round(sum(w * weight) / any_value(norm), 6) AS score
  FROM w JOIN known USING (term) JOIN norms USING (unit) GROUP BY unit, license, template),
own AS (SELECT path, first(license ORDER BY score DESC, license, share DESC) AS license, max(score) AS score,
    first(share ORDER BY score DESC, license, share DESC) AS share
  FROM (SELECT path, license, score, length(unit) / size AS share FROM kept JOIN scored USING (unit) WHERE score >= {THRESHOLD}) GROUP BY path),
given AS (SELECT here AS dir, first(license ORDER BY score DESC, license) AS d_license, max(score) AS d_score
  FROM own JOIN dirs USING (path) WHERE share >= {FILE_SHARE} GROUP BY here),
nearest AS (SELECT h.here, first(g.dir ORDER BY length(g.dir) DESC) AS from_dir, first(g.d_license ORDER BY length(g.dir) DESC) AS d_license,
    first(g.d_score ORDER BY length(g.dir) DESC) AS d_score
  FROM (SELECT DISTINCT here FROM dirs) h JOIN given g ON g.dir = '' OR h.here = g.dir OR starts_with(h.here, g.dir || '/') GROUP BY h.here)
SELECT doc_id, path, coalesce(license, d_license) AS license, coalesce(score, d_score) AS score,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN d_license IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN license IS NULL THEN from_dir END AS from_dir
FROM dirs LEFT JOIN own USING (path) LEFT JOIN nearest USING (here)"""


OP1_SQL = _sql()
