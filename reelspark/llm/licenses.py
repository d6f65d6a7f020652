"""Licence scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

Templates are notices of one sentence, headers, passages of licence files, and SPDX lines.  A text that speaks of licensing
has notices of four sizes: the whole text, its paragraphs (without comment marks), their sentences, and the clauses of these
that say how a work is licensed; those that speak of licensing are bags of words, weighed by TF-IDF over all different notices and templates.  Only words of templates can add to
a cosine, so notices are joined to templates on words and normalised by their full length.  The best notice and template of
enough likeness give the text its own licence, provided the notice has all words of the licence's name that the template has
("3" of GPL-3.0, say: likeness alone can't tell a version or a name).  A notice that says it is *not* so licensed is none.

A file of a licence file's name, or whose text is little but its notice, gives its licence to its directory.  A document
without one of its own takes that of its nearest ancestor directory: directories, not documents, are joined with their
ancestors.

DataFrame operations only.  Texts and notices are joined by their 128-bit digests.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Short notices of common licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, the Creative Commons Attribution License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "EPL-2.0": "This program is made available under the terms of the Eclipse Public License, version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Zlib": "Released under the zlib License.",
}
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."""
_GNU_FILE = "GNU {0} Version {1} Copyright (C) {2} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
# Headers and passages of licence files.
PASSAGES = [
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("AGPL-3.0", _GNU_FILE.format("AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", 2007)),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + "\nmay be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("GPL-3.0", _GNU_FILE.format("GENERAL PUBLIC LICENSE", "3, 29 June 2007", 2007)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", 2.1)),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("LGPL-3.0", _GNU_FILE.format("LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", 2007)),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("MIT", "licensed under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
]
#: What speaks of licensing, and what denies it.
HINT = "(?i)licen[sc]e|copyright|spdx|public domain|redistribution and use|permission is|free software"
DENIED = r"(?i)\b(not|never|no longer)\s+(\w+\s+)?(licen[sc]ed|released|offered|made available)\b"
#: Where the clause begins that says how a work is licensed.
CLAUSE = r"(?is)\b(licen[sc]ed|released|made available|redistribution and use|permission is|spdx-license-identifier)\b.*"
#: Marks of comments at the start of a line; what parts paragraphs, and sentences.
MARKS, PARAGRAPH, SENTENCE = r"\n[ \t#/*;!%<>-]+", r"\n\n+", r"([.!?])[ \t\n]+"
EDGES = r"^[ \t\r\n]+|[ \t\r\n]+$"
WORD = "[a-z0-9]+"
LICENCE_FILE = "(?i)^(licen[sc]e|copying|notice)([.-].*)?$"
LEAST = 0.6


def given_templates(templates: dict[str, str] | None = None) -> list[tuple[str, str, list[str]]]:
    """(licence, text, words of the licence's name that the text has) of the templates: those given, or all there are here
    with an SPDX line for each licence."""
    if templates is None:
        pairs = [*TEMPLATES.items(), *PASSAGES]
        pairs += [(x, f"SPDX-License-Identifier: {x}") for x in sorted({licence for licence, _ in pairs})]
    else:
        pairs = list(templates.items())
    words = lambda x: set(re.findall(WORD, x.lower()))
    return [(licence, text, sorted(words(licence) & words(text))) for licence, text in sorted(pairs)]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))


def _notices(text: Column) -> Column:
    """The different notices of a text: itself, its paragraphs, their sentences and the clauses of these that say how a work
    is licensed, as far as they speak of licensing and the sentence doesn't deny it."""
    plain = F.regexp_replace(F.concat(F.lit("\n"), F.replace(text, F.lit("\r\n"), F.lit("\n"))), MARKS, "\n")
    paragraphs = F.split(plain, PARAGRAPH)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(F.regexp_replace(p, SENTENCE, "$1\u0001"), "\u0001")))
    good = lambda notices: F.filter(notices, lambda x: x.rlike(HINT) & ~x.rlike(DENIED))
    clauses = F.transform(good(sentences), lambda x: F.regexp_extract(x, CLAUSE, 0))
    return F.array_distinct(F.transform(good(F.concat(F.array(text), paragraphs, sentences, clauses)), lambda x: F.regexp_replace(x, EDGES, "")))


def cosines(spark: SparkSession, notices: DataFrame, templates: list[tuple[str, str, list[str]]], least: float) -> DataFrame:
    """u, licence, cosine of each different notice (u, notice) and each template of a cosine of ``least`` or more, of which
    the notice has the words of the licence's name.

    Every weight is at least 1, so a notice with r different words that no template has is further than ``least`` from all
    templates if the squared weights of its other words are less than r * least**2 / (1 - least**2).  Those are weighed
    first; only notices that are left, few of the long ones, are bags of all their words."""
    given = spark.createDataFrame([(i, *x) for i, x in enumerate(templates)], "template int, licence string, text string, needs array<string>")
    bag = lambda df, key: df.select(key, F.explode("words").alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))
    wanted = bag(given.select("template", _words(F.col("text")).alias("words")), "template")
    known = sorted({w for _, text, _ in templates for w in re.findall(WORD, text.lower())})  # a few hundred words
    total = notices.count() + len(templates)
    idf = lambda df: (F.log((1.0 + total) / (1.0 + df)) + 1.0).alias("idf")
    heavy = (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    worded = notices.select("u", _words(F.col("notice")).alias("words"))
    named = common.table(bag(worded.select("u", F.filter("words", lambda w: w.isin(known)).alias("words")), "u"), "named")
    df = named.select("word").unionByName(wanted.select("word")).groupBy("word").agg(F.count("*").alias("df"))
    known_idf = common.table(df.select("word", idf(F.col("df"))), "known")  # a row for each word of a template
    theirs = common.table(wanted.join(F.broadcast(known_idf), "word").withColumn("weight", heavy), "templates")
    own = named.join(F.broadcast(known_idf), "word").withColumn("weight", heavy)
    shares = own.groupBy("u").agg(F.sum(F.col("weight") * F.col("weight")).alias("s"), F.count("*").alias("n"))
    sizes = worded.select("u", F.size(F.array_distinct("words")).alias("d"))
    near = shares.join(sizes, "u").where(F.col("s") * (1 - least * least) >= (F.col("d") - F.col("n")) * (least * least) - 1e-6)
    near = common.table(near.select("u", "s"), "near")

    # the other words of those, whose weights are only in the length of the notice
    others = lambda words: F.filter(words, lambda w: ~w.isin(known))
    rest = common.table(bag(worded.join(near.select("u"), "u", "left_semi").select("u", others(F.col("words")).alias("words")), "u"), "rest")
    rare = rest.select("word").distinct()
    each = worded.select(F.explode(F.array_distinct(others(F.col("words")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    rest = rest.join(each.join(rare, "word", "left_semi").select("word", idf(F.col("df"))), "word").withColumn("weight", heavy)
    length = rest.groupBy("u").agg(F.sum(F.col("weight") * F.col("weight")).alias("more"))
    length = near.join(length, "u", "left").select("u", F.sqrt(F.col("s") + F.coalesce("more", F.lit(0.0))).alias("norm_u"))
    facts = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm_template")).join(given.select("template", "licence", "needs"), "template")
    dots = own.join(near.select("u"), "u", "left_semi").join(F.broadcast(theirs.select("template", "word", F.col("weight").alias("w_t"))), "word")
    dots = dots.groupBy("u", "template").agg(F.sum(F.col("weight") * F.col("w_t")).alias("dot"), F.collect_set("word").alias("shared"))
    cos = dots.join(length, "u").join(F.broadcast(facts), "template").where(F.size(F.array_except("needs", "shared")) == 0)
    cos = cos.select("u", "licence", F.round(F.col("dot") / (F.col("norm_u") * F.col("norm_template")), 6).alias("cosine"))
    return cos.where(F.col("cosine") >= least)


def ancestors(directory: Column) -> Column:
    """A directory and those above it, nearest first, the root ("") last."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    )


def license_scan(
    docs: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    least: float = LEAST,
) -> DataFrame:
    """Per row of ``docs``: doc_id, path, licence (null: none found), cosine (of its own notice and its template, else null), origin ("own",
    "inherited", "none"), licence_dir (where an inherited one comes from).

    ``path`` has "/" between names.  Cosines are rounded to 6 places and ties go to the first template by name; of several
    licence files in a directory the first by path, then licence, counts.  A null text has no notice, a null path is a
    file of the root; repeated rows get the same result each; other columns are ignored; an empty table gives no rows."""
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), docs[text_col].cast("string").alias("text")
    )
    hints = F.col("text").rlike(HINT)
    seen = rows.select("doc_id", "path", F.when(hints, F.unhex(F.md5("text"))).alias("t"), F.when(hints, F.regexp_count("text", F.lit(r"\S+"))).alias("n_words"), F.when(hints, F.col("text")).alias("text"))
    seen = common.table(seen, "seen")
    found = seen.where("t is not null")
    each = found.select("t", F.explode(_notices(F.col("text"))).alias("notice")).select("t", F.unhex(F.md5("notice")).alias("u"), "notice")
    each = common.table(each, "each")
    different = common.table(each.groupBy("u").agg(F.first("notice").alias("notice")), "notices")
    cos = cosines(docs.sparkSession, different, given_templates(templates), least)
    best = cos.groupBy("u").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("b"))
    best = best.join(different.select("u", F.regexp_count("notice", F.lit(r"\S+")).alias("n")), "u")
    best = common.table(best.select("u", "b.less", "b.licence", (-F.col("n")).alias("short")), "best")
    # a text's best notice; as a table, so that Spark can split the join where a text is in a great many documents
    own = each.select("t", "u").distinct().join(best, "u").groupBy("t").agg(F.min(F.struct("less", "licence", "short")).alias("b"))
    own = common.table(own.select("t", F.col("b.licence").alias("own_licence"), (-F.col("b.less")).alias("cosine"), (-F.col("b.short")).alias("notice_words")), "texts")
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    # texts that don't speak of licensing, most of them, are not joined
    own = common.table(found.drop("text").join(own, "t", "left").withColumn("dir", directory), "licensed")
    file = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE) | (2 * F.col("notice_words") >= F.col("n_words"))
    holders = own.where(file & F.col("own_licence").isNotNull()).groupBy("dir").agg(F.min(F.struct("path", "own_licence")).alias("h"))
    holders = holders.select(F.col("dir").alias("licence_dir"), F.col("h.own_licence").alias("dir_licence"))
    columns = ["doc_id", "path", "dir", "own_licence", "cosine"]
    bare = seen.where("t is null").select("doc_id", "path", directory.alias("dir"), F.lit(None).cast("string").alias("own_licence"), F.lit(None).cast("double").alias("cosine"))
    placed = own.select(*columns).unionByName(bare)
    above = placed.select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("up", "licence_dir"))
    near = above.join(holders, "licence_dir").groupBy("dir").agg(F.min(F.struct("up", "licence_dir", "dir_licence")).alias("n"))
    out = placed.join(near.select("dir", "n.licence_dir", "n.dir_licence"), "dir", "left")
    has, inherits = F.col("own_licence").isNotNull(), F.col("dir_licence").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own_licence", "dir_licence").alias("licence"),
        "cosine",
        F.when(has, "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("licence_dir")).alias("licence_dir"),
    )


def oracle(templates: dict[str, str] | None = None, least: float = LEAST) -> str:
    """The same over ``documents`` in DuckDB's SQL, with the paths of the query."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(k)}, {quote(v)}, [{', '.join(map(quote, needs))}]::VARCHAR[])" for i, (k, v, needs) in enumerate(given_templates(templates)))
    return f"""
WITH given(template, licence, text, needs) AS (VALUES {values}),
rows AS (SELECT doc_id, concat_ws('/', source, lang, doc_id // 500, doc_id // 50, CASE WHEN length(text) < 400 THEN 'NOTICE-' || doc_id ELSE doc_id || '.txt' END) AS path, text FROM documents),
found AS (SELECT doc_id, path, text, len(regexp_extract_all(text, '\\S+')) AS n_words FROM rows WHERE regexp_matches(text, '{HINT}')),
para AS (SELECT DISTINCT text, unnest(string_split_regex(regexp_replace(chr(10) || replace(text, chr(13) || chr(10), chr(10)), '{MARKS}', chr(10), 'g'), '{PARAGRAPH}')) AS p FROM found),
sentence AS (SELECT DISTINCT text, unnest(string_split(regexp_replace(p, '{SENTENCE}', '\\1' || chr(1), 'g'), chr(1))) AS s FROM para),
each AS (SELECT DISTINCT text, regexp_replace(notice, '{EDGES}', '', 'g') AS notice FROM (SELECT text, text AS notice FROM found UNION ALL SELECT text, p FROM para UNION ALL SELECT text, s FROM sentence
  UNION ALL SELECT text, regexp_extract(s, '{CLAUSE}') FROM sentence WHERE regexp_matches(s, '{HINT}') AND NOT regexp_matches(s, '{DENIED}')) WHERE regexp_matches(notice, '{HINT}') AND NOT regexp_matches(notice, '{DENIED}')),
texts AS (SELECT DISTINCT notice FROM each),
bags AS (SELECT notice, word, count(*) AS tf FROM (SELECT notice, unnest(regexp_extract_all(lower(notice), '{WORD}')) AS word FROM texts) GROUP BY ALL),
wanted AS (SELECT template, word, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM given) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM (SELECT word FROM bags UNION ALL SELECT word FROM wanted) GROUP BY word),
idf AS (SELECT word, ln((1.0::DOUBLE + (SELECT count(*) FROM texts) + (SELECT count(*) FROM given)) / (1.0::DOUBLE + df)) + 1 AS idf FROM df),
own AS (SELECT notice, word, (1 + ln(tf::DOUBLE)) * idf AS w FROM bags JOIN idf USING (word)),
theirs AS (SELECT template, word, (1 + ln(tf::DOUBLE)) * idf AS w FROM wanted JOIN idf USING (word)),
cos AS (SELECT notice, licence, round(dot / (a * b), 6) AS cosine FROM
  (SELECT o.notice, t.template, sum(o.w * t.w) AS dot, list(word) AS shared FROM own o JOIN theirs t USING (word) GROUP BY ALL)
  JOIN (SELECT notice, sqrt(sum(w * w)) AS a FROM own GROUP BY notice) USING (notice)
  JOIN (SELECT template, sqrt(sum(w * w)) AS b FROM theirs GROUP BY template) USING (template) JOIN given USING (template) WHERE list_has_all(shared, needs)),
best AS (SELECT notice, licence, cosine FROM cos WHERE cosine >= {least} QUALIFY row_number() OVER (PARTITION BY notice ORDER BY cosine DESC, licence) = 1),
top AS (SELECT text, licence, cosine, len(regexp_extract_all(notice, '\\S+')) AS notice_words FROM each JOIN best USING (notice) QUALIFY row_number() OVER (PARTITION BY text ORDER BY cosine DESC, licence, notice_words DESC) = 1),
own_l AS (SELECT f.doc_id, f.path, f.n_words, t.licence, t.cosine, t.notice_words, regexp_replace(path, '/?[^/]*$', '') AS dir FROM found f JOIN top t USING (text)),
holders AS (SELECT dir AS licence_dir, licence AS dir_licence FROM own_l
  WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}') OR 2 * notice_words >= n_words
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path, licence) = 1),
placed AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM rows),
near AS (SELECT d.dir, h.licence_dir, h.dir_licence FROM (SELECT DISTINCT dir FROM placed) d
  JOIN holders h ON h.licence_dir = '' OR d.dir = h.licence_dir OR starts_with(d.dir, h.licence_dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(h.licence_dir) DESC) = 1)
SELECT p.doc_id, p.path, coalesce(o.licence, n.dir_licence) AS licence, o.cosine,
  CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN n.dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.licence IS NULL THEN n.licence_dir END AS licence_dir
FROM placed p LEFT JOIN own_l o ON o.doc_id = p.doc_id LEFT JOIN near n ON n.dir = p.dir"""
