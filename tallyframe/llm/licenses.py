"""Licences of files: TF-IDF cosine to notices, then inheritance from the nearest directory above.

DataFrame operations only. A file's lines that speak of a licence, and all lines of licence files, are
compared with templates as sparse vectors: joins on terms, so only terms that a
template has are ever multiplied. Each distinct line is compared once, however many files have it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored

LEAST = 0.6  # cosine
#: Notices as licences word them; fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "Copyright. All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
LINE_ENDS = r"[\n\r<>]"
SPEAKS = r"(?i)licen[sc]e|copyright|spdx|public domain|creative commons|rights reserved|permission|redistribution"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"


def file_path(url: str | Column) -> Column:
    """Host and path of a URL, or a plain path, without scheme, query, fragment and end slashes."""
    bare = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")
    return F.regexp_replace(bare, "^/+|/+$", "")


def terms(lines: DataFrame, key: str, text: str) -> DataFrame:
    """Term counts: ``key, term, tf``."""
    found = lines.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)).alias("term"))
    return found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def matches(lines: DataFrame, templates: Sequence[tuple[str, str]], least: float) -> DataFrame:
    """``line, licence, cosine`` of the best template of every line that has one; ties go to the first name.

    Document frequencies count the distinct lines and the templates.
    """
    spark = lines.sparkSession
    notices = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "notice int, licence string, text string")
    line_terms = stored(terms(lines, "line", "line"), "line-terms")
    notice_terms = terms(notices, "notice", "text")
    all_terms = line_terms.select("term").union(notice_terms.select("term"))
    frequency = all_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = lines.count() + len(templates)
    weight = (1 + F.log("tf")) * F.log((1.0 + n) / F.col("df"))
    line_weights = line_terms.join(frequency, "term").select("line", "term", weight.alias("w"))
    notice_weights = notice_terms.join(frequency, "term").select("notice", "term", weight.alias("v"))
    line_norms = line_weights.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("line_norm"))
    notice_norms = notice_weights.groupBy("notice").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("notice_norm"))
    # the templates are an argument: their terms are as many whatever the files
    dots = line_weights.join(F.broadcast(notice_weights), "term").groupBy("line", "notice").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    named = F.broadcast(notice_norms.join(notices, "notice").select("notice", "licence", "notice_norm"))
    cosine = F.round(F.col("dot") / (F.col("line_norm") * F.col("notice_norm")), 6)
    scored = dots.join(line_norms, "line").join(named, "notice").select("line", "licence", cosine.alias("cosine"))
    best = scored.where(F.col("cosine") >= least).groupBy("line").agg(F.min(F.struct(-F.col("cosine"), "licence")).alias("b"))
    return best.select("line", F.col("b.licence").alias("licence"), (-F.col("b.col1")).alias("cosine"))


def scan_licences(
    files: DataFrame, id_col: str = "page_id", path_col: str = "url", text_col: str = "html",
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), least: float = LEAST,
) -> DataFrame:
    """``id, path, licence, cosine, origin`` per row of ``files``.

    A file's own licence is the one its lines are nearest to. A file without inherits from the
    nearest directory above it that has one: a licence file gives its licence to its directory, any other
    file to the directory of its own path. ``origin`` is that path, the file's own for its own licence, null
    for none. Null texts have no lines, null paths no directory; rows that repeat are looked at each for
    itself, other columns are ignored. With several licences for a place, the highest cosine counts, then the first name.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = stored(
        files.select(F.col(id_col).alias("id"), file_path(path_col).alias("path"), F.col(text_col).alias("text"))
        .withColumn("is_licence", F.coalesce(name.rlike(LICENCE_FILE), F.lit(False)))
        .withColumn("lines", F.array_distinct(F.transform(F.split("text", LINE_ENDS), F.trim)))
        .select("id", "path", "is_licence", F.filter("lines", lambda x: (x != "") & (x.rlike(SPEAKS) | F.col("is_licence"))).alias("lines"))
        .select("id", "path", "is_licence", F.coalesce("lines", F.array().cast("array<string>")).alias("lines")),
        "licence-lines",
    )
    lines = rows.select(F.explode("lines").alias("line")).distinct()
    best = stored(matches(lines, templates, least), "licences")
    # a row is named by its id and path; rows equal in both have equal lines or share the best
    found = rows.select("id", "path", F.explode("lines").alias("line")).join(best, "line")
    smallest = F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")
    own = found.groupBy("id", "path").agg(smallest).select(F.col("id").alias("_id"), F.col("path").alias("_path"), "b")
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path"))
    labelled = stored(rows.drop("lines").join(own, same, "left").drop("_id", "_path"), "own-licences")
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    place = F.when(F.col("is_licence"), parent).otherwise(F.col("path"))
    given = labelled.where("b is not null").select(place.alias("dir"), "b").groupBy("dir").agg(F.min("b").alias("given"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    lacking = labelled.where("b is null and path is not null").select("path").distinct()
    asked = lacking.select("path", F.explode(above).alias("dir"))
    nearest = asked.join(given, "dir").groupBy("path").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "given")).alias("g"))
    inherited = nearest.select(F.col("path").alias("_path"), "g")
    done = labelled.join(inherited, F.col("b").isNull() & (F.col("path") == F.col("_path")), "left")
    chosen = F.coalesce("b", "g.given")
    origin = F.when(F.col("b").isNotNull(), F.col("path")).otherwise(F.col("g.dir"))
    return done.select("id", "path", chosen["licence"].alias("licence"), (-chosen["c"]).alias("cosine"), origin.alias("origin"))


def _values() -> str:
    return ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))


SQL = rf"""
WITH files AS (
  SELECT page_id AS id, regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$', '', 'g'), '^/+|/+$', '', 'g') AS path, html
  FROM pages),
split AS (
  SELECT id, path, regexp_matches(string_split(path, '/')[-1], '{LICENCE_FILE}') AS is_licence, unnest(string_split_regex(html, '{LINE_ENDS}')) AS raw
  FROM files),
lines AS (SELECT DISTINCT id, path, trim(raw) AS line FROM split WHERE trim(raw) <> '' AND (is_licence OR regexp_matches(trim(raw), '{SPEAKS}'))),
notices(notice, licence, text) AS (VALUES {_values()}),
units AS (SELECT DISTINCT 'l' AS kind, line AS text FROM lines),
words AS (
  SELECT 'l' || text AS unit, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM units
  UNION ALL SELECT 'n' || notice, unnest(regexp_extract_all(lower(text), '{TERM}')) FROM notices),
tfs AS (SELECT unit, term, count(*) AS tf FROM words GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
total AS (SELECT (SELECT count(*) FROM units) + (SELECT count(*) FROM notices) AS n),
weights AS (SELECT unit, term, (1 + ln(tf)) * ln((1.0::DOUBLE + n) / df) AS w FROM tfs JOIN dfs USING (term), total),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM weights GROUP BY unit),
dots AS (
  SELECT a.unit AS line, b.unit AS notice, sum(a.w * b.w) AS dot FROM weights a JOIN weights b USING (term)
  WHERE a.unit[1] = 'l' AND b.unit[1] = 'n' GROUP BY ALL),
scored AS (
  SELECT d.line[2:] AS line, n.licence, round(dot / (x.norm * y.norm), 6) AS cosine
  FROM dots d JOIN norms x ON x.unit = d.line JOIN norms y ON y.unit = d.notice JOIN notices n ON 'n' || n.notice = d.notice),
own AS (
  SELECT id, path, licence, cosine FROM lines JOIN scored USING (line) WHERE cosine >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY id, path ORDER BY cosine DESC, licence) = 1),
labelled AS (
  SELECT f.id, f.path, o.licence, o.cosine, regexp_matches(string_split(f.path, '/')[-1], '{LICENCE_FILE}') AS is_licence
  FROM files f LEFT JOIN own o USING (id, path)),
given AS (
  SELECT CASE WHEN is_licence THEN regexp_replace(path, '/?[^/]*$', '') ELSE path END AS dir, licence, cosine FROM labelled WHERE licence IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) = 1),
inherited AS (
  SELECT l.path, g.dir, g.licence, g.cosine FROM (SELECT DISTINCT path FROM labelled WHERE licence IS NULL) l
  JOIN given g ON g.dir = '' OR starts_with(l.path, g.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY l.path ORDER BY length(g.dir) DESC) = 1)
SELECT l.id AS page_id, l.path, coalesce(l.licence, i.licence) AS licence, coalesce(l.cosine, i.cosine) AS cosine,
       CASE WHEN l.licence IS NOT NULL THEN l.path ELSE i.dir END AS origin
FROM labelled l LEFT JOIN inherited i ON l.licence IS NULL AND i.path = l.path
"""
