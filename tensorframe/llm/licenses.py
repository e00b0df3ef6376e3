"""License scans.

Units of a file are its whole text, its paragraphs, its runs of comment lines
and its lines.  A unit's terms and those of license templates (notices, and whole
licence texts) get TF-IDF weights, (1 + ln tf)(ln((1 + n) / (1 + df)) + 1) with
document frequencies of all terms over all files; the sparse cosine of a unit to
each template decides: a part of a text that reaches the bar is a header, a whole
text that does makes the file a license file.  A file with neither inherits from
the license file of its nearest ancestor directory, by joins of path prefixes.

A text is scored only if, by the Cauchy-Schwarz bound, it can reach the bar: the
squared weights of the terms that it shares with some template must add up to the
bar's square, of which a template's lightest terms may give LIGHT at most.  What
the driver holds is bounded by the templates' vocabulary.

Defined cases: a null text has no terms; a null path has no directory and
inherits nothing; of equal scores the license first by name wins, of several
license files in a directory the best score, then license, then path; repeated
rows are separate files; an empty table gives an empty result; other columns
pass through, whatever their names, but for those named like the result's.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorframe.llm.common import materialize, spread_join

TERM = r"[A-Za-z0-9]+(?:\.[0-9]+)*"
BAR = 0.6
PARAGRAPH = r"\n(?:[ \t\r]*\n)+"
COMMENTS = r"(?:\n[ \t]*(?:#|//|/\*|\*|--|;|%)[^\n]*)+"
#: Templates with more telling terms than this are whole texts.
NOTICE_TERMS = 200
#: Share of a template's squared weights that its lightest terms may have to be left out of the search.
LIGHT = 0.1
#: Notices by license (public texts, shortened to what tells them apart).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved. Confidential and proprietary."),
)
#: Whole texts by license: public licence texts as their authors publish them.
TEXTS = tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
TEMPLATES = NOTICES + TEXTS


def terms_of(text: str) -> list[str]:
    return [t.lower() for t in re.findall(TERM, text)]


def idf(df: Column | float, n: Column | float):
    """Smoothed, so that no term weighs nothing: ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + n) / (1 + df)) + 1 if isinstance(df, Column) else math.log((1 + n) / (1 + df)) + 1


def _terms(text: Column) -> Column:
    # Terms are ASCII, and lower case is quick to make of those alone.
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _constant(terms: set[str]) -> Column:
    """The terms as one literal, which the optimizer makes of it; terms have no blanks."""
    return F.split(F.lit(" ".join(sorted(terms))), " ")


def weights(df: dict[str, int], n: int, templates=TEMPLATES) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    out = []
    for _, text in templates:
        v = {t: (1 + math.log(c)) * idf(df.get(t, 0), n) for t, c in Counter(terms_of(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def search_terms(vectors: list[dict[str, float]], bar: float) -> tuple[list[dict[str, float]], float, list[int]]:
    """For each template its squared weights by term, without its lightest terms, the sum that a text needs, and the fewest terms that give it."""
    out, fewest, need = [], [], bar * bar - LIGHT - 1e-9
    for v in vectors:
        by_weight, light = sorted(v.items(), key=lambda p: (p[1], p[0])), 0.0
        while light + by_weight[0][1] ** 2 <= LIGHT:
            light += by_weight.pop(0)[1] ** 2
        out.append({t: x * x for t, x in by_weight})
        have = terms = 0
        while by_weight and have < need:
            have += by_weight.pop()[1] ** 2
            terms += 1
        fewest.append(terms)
    return out, need, fewest


def can_reach(terms: Column, telling: list[dict[str, float]], fewest: list[int]) -> Column:
    """Whether the terms have as many of some template's telling ones as the heaviest of those need; whole texts count as one."""
    texts = [i for i, v in enumerate(telling) if len(v) > NOTICE_TERMS]
    notices = [i for i in range(len(telling)) if i not in texts]
    some = lambda x, which: F.array_intersect(x, _constant({t for i in which for t in telling[i]}))
    enough = lambda x: reduce(operator.or_, [F.size(some(x, [i])) >= fewest[i] for i in notices], F.lit(False))
    # By way of lambdas, whose variables are evaluated once.
    able = lambda x: F.exists(F.array(some(x, notices)), enough) if notices else F.lit(False)
    least = min((fewest[i] for i in texts), default=0)
    return F.exists(F.array(terms), lambda x: able(x) | ((F.size(x) >= least) & (F.size(some(x, texts)) >= least)) if texts else able(x))


def own_licenses(files: DataFrame, text: str = "text", templates=TEMPLATES, bar: float = BAR) -> DataFrame:
    """files (with a key of the text) to key, kind (header or file), license and score, where a unit reaches the bar."""
    spark = files.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    vocabulary = sorted({x for _, y in templates for x in terms_of(y)})
    df = materialize(files.select(F.explode(F.array_distinct(_terms(t))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    n = files.count()
    # As many rows as the templates have terms.
    known = spark.createDataFrame([(x,) for x in vocabulary], "term string")
    vectors = weights({r.term: r.df for r in df.join(F.broadcast(known), "term").collect()}, n, templates)
    telling, need, fewest = search_terms(vectors, bar)

    # Texts with enough telling terms; of equal ones one is enough.  Then those whose terms can reach the bar with one template.
    able = materialize(files.select("key", t.alias("t")).filter(can_reach(_terms(F.col("t")), telling, fewest)).dropDuplicates(["key"]), "texts")
    # Broadcast: a row for each term of each template, whatever the files.
    squares = F.broadcast(spark.createDataFrame([(x, i, w) for i, v in enumerate(telling) for x, w in v.items()], "term string, template int, square double"))
    near = able.select("key", F.explode(F.array_distinct(_terms(F.col("t")))).alias("term")).join(squares, "term").groupBy("key", "template").agg(F.sum("square").alias("square")).filter(F.col("square") >= need).select("key").distinct()
    found = able.join(near, "key", "left_semi")
    parts = F.array_distinct(F.concat(F.split("t", "\n", -1), F.split("t", PARAGRAPH, -1), F.regexp_extract_all(F.concat(F.lit("\n"), F.col("t")), F.lit(COMMENTS), F.lit(0))))
    units = found.select("key", F.posexplode(F.concat(F.array("t"), parts)).alias("unit", "part")).select("key", "unit", _terms(F.col("part")).alias("terms")).filter(can_reach(F.col("terms"), telling, fewest))
    term = materialize(units.select("key", "unit", F.explode("terms").alias("term")).groupBy("key", "unit", "term").agg(F.count(F.lit(1)).alias("tf")), "units")
    # A common word is in nearly every unit: its rows are dealt over many tasks, with the frequencies of the units' terms only.
    wanted = df.join(term.select("term").distinct(), "term", "left_semi")
    weighted = materialize(spread_join(term, wanted, "term").select("key", "unit", "term", ((1 + F.log("tf")) * idf(F.col("df"), F.lit(n))).alias("x")), "weights")
    table = F.broadcast(spark.createDataFrame([(x, i, templates[i][0], w) for i, v in enumerate(vectors) for x, w in v.items()], "term string, template int, license string, w double"))
    norms = weighted.groupBy("key", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighted.join(table, "term").groupBy("key", "unit", "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norms, ["key", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= bar)
    # A whole text before a part, then the best score, then the license's name.
    best = scored.groupBy("key").agg(F.min(F.struct((F.col("unit") > 0).alias("part"), (-F.col("score")).alias("minus"), "license")).alias("x"))
    return best.select("key", F.when(F.col("x.part"), "header").otherwise("file").alias("kind"), F.col("x.license").alias("license"), (-F.col("x.minus")).alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, bar: float = BAR) -> DataFrame:
    """files, less the text and columns named like these, with license, license_kind (header, file, inherited or none), license_score and license_from (a path)."""
    keep = [F.col(f"`{c}`") for c in files.columns if c != text and c not in ("license", "license_kind", "license_score", "license_from")]
    # A text decides its own license, so copies are scored once.  The caller's columns stay in a struct, where no name can clash.
    d = files.select(F.struct(*keep).alias("_row"), F.col(path).cast("string").alias("_path"), F.col(text).alias("_text"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"))
    own = materialize(own_licenses(d.select("key", "_text"), "_text", templates, bar), "licenses")
    placed = materialize(d.drop("_text").withColumn("_dir", directory(F.col("_path"))), "files")
    # Copies of a text, and files of a directory, may be very many.
    placed = spread_join(placed, own, "key", "left", by=["_path"])
    holders = placed.filter("kind = 'file' and _dir is not null").groupBy(F.col("_dir").alias("_holder")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "license", F.col("_path").alias("from"))).alias("_best"))
    # Each directory once, however many files it has; then its prefixes, as many as it is deep.
    parts = F.split("_dir", "/", -1)
    dirs = placed.filter("kind is null and _dir is not null").select("_dir").distinct()
    prefixes = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("_holder")))).alias("p")).select("_dir", "p.*")
    nearest = prefixes.join(holders, "_holder").groupBy("_dir").agg(F.max_by("_best", "depth").alias("_near"))
    out = spread_join(placed, nearest, "_dir", "left", by=["_path"]).withColumn("_near", F.when(F.col("kind").isNull(), F.col("_near")))
    return out.select(
        "_row.*", F.coalesce("license", "_near.license").alias("license"),
        F.coalesce("kind", F.when(F.col("_near").isNotNull(), "inherited"), F.lit("none")).alias("license_kind"),
        F.coalesce("score", -F.col("_near.minus")).alias("license_score"),
        F.when(F.col("kind").isNotNull(), F.col("_path")).otherwise(F.col("_near.from")).alias("license_from"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """Documents as files of their source: <source>/<language>/<doc_id>."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return scan(docs.select("doc_id", "text", F.concat_ws("/", name("source"), name("lang"), name("doc_id")).alias("path")))


def oracle_sql(templates=TEMPLATES, bar: float = BAR) -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(templates))
    terms = lambda text: f"list_transform(regexp_extract_all({text}, '{TERM}'), lambda t: lower(t))"
    return f"""
WITH f AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || coalesce(doc_id::VARCHAR, '') AS path FROM documents),
tpl AS (SELECT * FROM (VALUES {values}) v(template, license, text)),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({terms("text")}) AS term FROM tpl) GROUP BY ALL),
docterm AS (SELECT DISTINCT rid, term FROM (SELECT rid, unnest({terms("text")}) AS term FROM f)),
df AS (SELECT term, count(*) AS df FROM docterm GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM f))::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) FULL JOIN df USING (term)),
tw AS (SELECT template, license, term, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ^ 2) OVER (PARTITION BY template)) AS w FROM tt JOIN idf USING (term)),
parts AS (SELECT rid, unnest(list_distinct(string_split(text, chr(10)) || regexp_split_to_array(text, '{PARAGRAPH}') || regexp_extract_all(chr(10) || text, '{COMMENTS}'))) AS text FROM f),
units AS (SELECT rid, row_number() OVER () AS unit, text FROM parts UNION ALL SELECT rid, 0, text FROM f),
ut AS (SELECT rid, unit, term, count(*) AS tf FROM (SELECT rid, unit, unnest({terms("text")}) AS term FROM units) GROUP BY ALL),
uw AS (SELECT rid, unit, term, (1 + ln(tf)) * idf AS x, sqrt(sum(((1 + ln(tf)) * idf) ^ 2) OVER (PARTITION BY rid, unit)) AS norm FROM ut JOIN idf USING (term)),
scored AS (SELECT rid, unit, license, round(sum(x * w) / any_value(norm), 6) AS score FROM uw JOIN tw USING (term) GROUP BY rid, unit, template, license HAVING round(sum(x * w) / any_value(norm), 6) >= {bar}),
own AS (SELECT rid, unit, license, score FROM scored QUALIFY row_number() OVER (PARTITION BY rid ORDER BY unit > 0, score DESC, license) = 1),
p AS (SELECT f.rid, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, score, CASE WHEN unit > 0 THEN 'header' WHEN unit = 0 THEN 'file' END AS kind FROM f LEFT JOIN own USING (rid)),
held AS (SELECT dir, license, score, path FROM p WHERE kind = 'file' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license, path) = 1),
near AS (SELECT d.dir, h.license, h.score, h.path FROM (SELECT DISTINCT dir FROM p) d JOIN held h ON d.dir = h.dir OR h.dir = '' OR starts_with(d.dir, h.dir || '/') QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(h.dir) DESC) = 1)
SELECT doc_id, p.path, coalesce(p.license, n.license) AS license, coalesce(kind, CASE WHEN n.dir IS NOT NULL THEN 'inherited' END, 'none') AS license_kind,
  coalesce(p.score, n.score) AS license_score, CASE WHEN kind IS NOT NULL THEN p.path ELSE n.path END AS license_from
FROM p LEFT JOIN near n ON p.dir = n.dir AND kind IS NULL
"""
