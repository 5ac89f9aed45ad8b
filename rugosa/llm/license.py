"""Licence scans: lines, sentences and runs of them compared with licence templates by Dice coefficient over word bigrams, in DataFrame expressions alone."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 0.8
# Licence notices by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: What ends a piece within a line, and what a line's words are made of.
SENTENCE_END, NO_WORD = r"[.!?][ \t]+", r"[^\p{L}\p{N}\n\r]+"


def plain(text: Column) -> Column:
    """Lower case; sentences of a line are parted by a carriage return, and what else is neither a letter, a digit nor a line end is one space."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\r", " ")
    return F.regexp_replace(F.regexp_replace(t, SENTENCE_END, "\r"), NO_WORD, " ")


def template_bigrams(text: str) -> list[str]:
    """Word bigrams, each with its number among equal ones, so that intersections of lists are those of multisets."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    seen: Counter = Counter()
    out = []
    for b in map(" ".join, zip(words, words[1:])):
        seen[b] += 1
        out.append(f"{b}#{seen[b]}")
    return out


def pairs_of(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({b.rpartition("#")[0] for _, t in templates for b in template_bigrams(t)})


def longest_unit(templates: list[tuple[str, str]], least: float = LEAST) -> int:
    """Words of the longest unit that can match."""
    return int(max((len(template_bigrams(t)) for _, t in templates), default=0) * (2 - least) / least + 1e-9) + 1


def vocabulary_of(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, t in templates for b in template_bigrams(t) for w in b.rpartition("#")[0].split(" ")})


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template, dice, line, pieces, n_lines) of every row.

    A text's pieces are its lines, cut further after sentences; blank ones don't count. Units are each piece, each
    run of consecutive pieces (so a notice may be wrapped over lines, or stand within a line of prose) whose first and
    last piece have, alone or with their neighbour in the run, a bigram of some template (without such an end piece a
    run's coefficients are higher), and the text as a whole (line 0, pieces 0).
    A unit's Dice coefficient with a template is 2 c / (m + n): c common bigrams, m and n those of both, repeats
    counted. A unit can reach `least` only if least / (2 - least) <= m / n <= (2 - least) / least, so other templates,
    and units out of reach of all, are never compared; nor are units of which more than the share 1 - least /
    (2 - least) of bigrams is in no template, as the rest can't make a match. Nothing else is left out. The best match of a document is the highest; ties go to the earlier piece, then the shorter run,
    then the earlier template. n_lines counts the lines in which a matching piece or run begins. No match, null or
    empty text: null, null, null, null, null, 0.
    """
    grams = [(i, name, b) for i, (name, t) in enumerate(templates) if (b := template_bigrams(t))]
    low, high = least / (2 - least), (2 - least) / least
    shortest, longest = (min(len(b) for _, _, b in grams) * low, max(len(b) for _, _, b in grams) * high) if grams else (1.0, 0.0)
    known = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n")) for i, n, b in grams]) if grams else F.expr("cast(array() as array<struct<i:int,name:string,b:array<string>,n:int>>)")
    words, pairs = vocabulary_of(templates), pairs_of(templates)
    most = longest_unit(templates, least)

    def let(value: Column, then) -> Column:
        """then(value), the value worked out once: inside a lambda an expression is evaluated at each use."""
        return F.element_at(F.transform(F.array(value), then), 1)

    def foreign(a: Column, b: Column) -> Column:
        """No template has this bigram."""
        return ~(a.isin(words) & b.isin(words) & F.concat_ws(" ", a, b).isin(pairs))

    def piece(line: Column, t: Column) -> Column:
        """w: words; f: bigrams that no template has."""
        places = lambda w: F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(none)
        strange = lambda w: F.filter(places(w), lambda i: foreign(F.element_at(w, i), F.element_at(w, i + 1)))
        return let(F.split(t, " ", -1), lambda w: F.struct(line.alias("line"), t.alias("t"), F.size(w).alias("w"), F.size(strange(w)).alias("f"), w[0].alias("head"), F.element_at(w, -1).alias("tail")))

    def inside(x: Column) -> Column:
        """Some bigram of the piece is in a template."""
        return x["f"] < x["w"] - 1

    none = F.expr("cast(array() as array<int>)")
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("f"), F.lit(0).alias("k"), F.lit("").alias("tail"), none.alias("hits"))

    def grown(s: Column, x: Column) -> Column:
        """A run with one piece more; hits: its lengths so far that are in reach."""
        w, k = s["w"] + x["w"], s["k"] + 1
        apart = (s["k"] == 0) | foreign(s["tail"], x["head"])
        f = s["f"] + x["f"] + F.when((s["k"] > 0) & apart, 1).otherwise(0)
        reach = in_reach(F.struct((w - 1).alias("m"), f.alias("f")))
        return F.struct(w.alias("w"), f.alias("f"), k.alias("k"), x["tail"].alias("tail"), F.when((k > 1) & reach & (inside(x) | ~apart), F.concat(s["hits"], F.array(k))).otherwise(s["hits"]).alias("hits"))

    def unit(p: Column, k: Column, of: Column) -> Column:
        return F.struct(p.alias("p"), k.alias("k"), F.when(p > 0, of["line"][0]).otherwise(0).alias("line"), of["t"].alias("t"), (F.aggregate(of["w"], F.lit(0), lambda a, x: a + x) - 1).alias("m"))

    def runs(i: Column) -> Column:
        """Each piece has a word, so a run of more pieces than `most` is out of reach."""
        hits = F.aggregate(F.slice("all", i, F.lit(most)), start, grown, lambda s: s["hits"])
        return F.transform(hits, lambda k: unit(i, k, F.slice("all", i, k)))

    def numbered(b: Column) -> Column:
        return F.transform(b, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(b, F.lit(1), i + 1), lambda y: y == x)).cast("string")))

    def bigrams(t: Column) -> Column:
        pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
        return let(F.split(t, " ", -1), lambda w: let(pairs(w), numbered))

    def compared(u: Column) -> Column:
        fit = F.filter(known, lambda k: (u["m"] >= k["n"] * low - 1e-9) & (u["m"] <= k["n"] * high + 1e-9))
        dice = F.transform(fit, lambda k: F.struct((F.size(F.array_intersect(u["b"], k["b"])) * 2.0 / (u["m"] + k["n"])).alias("dice"), (-u["p"]).alias("p"), (-u["k"]).alias("k"), (-k["i"]).alias("i"), k["name"].alias("name"), u["line"].alias("line")))
        return F.filter(dice, lambda d: d["dice"] >= least)

    def in_reach(u: Column) -> Column:
        # A match shares low * m of its bigrams at least, none of them among the f that no template has.
        return (u["m"] >= shortest - 1e-9) & (u["m"] <= longest + 1e-9) & (u["m"] > 0) & (u["f"] <= u["m"] * (1 - low) + 1e-9)

    rows = docs.select(F.col(id_col).alias("doc_id"), plain(F.col(text_col)).alias("t"))
    cut = F.flatten(F.transform(F.split("t", "\n", -1), lambda x, i: F.transform(F.split(x, "\r", -1), lambda y: F.struct((i + 1).alias("line"), F.trim(y).alias("t")))))
    rows = rows.select("doc_id", F.transform(F.filter(cut, lambda x: x["t"] != ""), lambda x: piece(x["line"], x["t"])).alias("all"))
    rows = rows.withColumn("n", F.size("all"))
    starts = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(none)
    starts = F.filter(starts, lambda i: let(F.element_at("all", i), lambda x: inside(x) | ~foreign(x["tail"], F.element_at("all", i + 1)["head"])))
    singles = F.transform(F.filter(F.transform("all", lambda x, i: F.struct((i + 1).alias("p"), x.alias("x"))), lambda y: in_reach(F.struct((y["x"]["w"] - 1).alias("m"), y["x"]["f"].alias("f")))), lambda y: unit(y["p"], F.lit(1), F.array(y["x"])))
    total = F.aggregate("all", start, lambda s, x: F.struct((s["w"] + x["w"]).alias("w"), s["f"], s["k"], s["tail"], s["hits"]), lambda s: s["w"])
    whole = F.when((F.col("n") > 1) & (total <= most), F.array(unit(F.lit(0), F.lit(0), F.col("all"))))
    rows = rows.select("doc_id", F.concat(singles, F.coalesce(whole, F.slice(singles, 1, 0)), F.flatten(F.transform(starts, runs))).alias("near"))
    named = lambda u: F.struct(*[u[c].alias(c) for c in ("p", "k", "line", "m")], bigrams(F.concat_ws(" ", u["t"])).alias("b"))
    hits = F.flatten(F.transform(F.transform("near", named), compared))
    rows = rows.select("doc_id", hits.alias("hits"))
    best = rows.withColumn("best", F.array_max("hits")).withColumn("n_lines", F.size(F.array_distinct(F.filter("hits", lambda h: h["p"] < 0)["line"])))
    return best.select("doc_id", F.col("best.name").alias("license"), (-F.col("best.i")).alias("template"), F.col("best.dice").alias("dice"), F.col("best.line").alias("line"), (-F.col("best.k")).alias("pieces"), "n_lines")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.read_table(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({i}, '{n}', {_sql(t)})" for i, (n, t) in enumerate(TEMPLATES))
_MOST = longest_unit(TEMPLATES)
ORACLE_SQL = {
    "op9_license_scan": f"""
WITH t(i, name, text) AS (VALUES {_VALUES}
), tk AS (
  SELECT i, name, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t
), kb AS (
  SELECT i, g, count(*) AS c FROM (SELECT i, unnest(list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1])) AS g FROM tk) GROUP BY i, g
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), chr(13), ' '), {_sql(SENTENCE_END)}, chr(13), 'g'), {_sql(NO_WORD)}, ' ', 'g') AS t FROM documents
), l AS (
  SELECT r, unnest(string_split(t, chr(10))) AS s, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line FROM d
), x AS (
  SELECT r, line, unnest(string_split(s, chr(13))) AS s, unnest(range(1, len(string_split(s, chr(13))) + 1)) AS part FROM l
), p AS (
  SELECT r, line, string_split(trim(s), ' ') AS w, row_number() OVER (PARTITION BY r ORDER BY line, part) AS p FROM x WHERE trim(s) <> ''
), v AS (
  SELECT list(DISTINCT g) AS grams FROM kb
), a AS (
  SELECT *, len(list_filter(range(1, len(w)), lambda x: list_contains(grams, w[x] || ' ' || w[x + 1]))) > 0 AS inside,
         list_contains(grams, w[-1] || ' ' || (lead(w) OVER (PARTITION BY r ORDER BY p))[1]) AS joint FROM p, v
), g AS (
  SELECT r, list(line ORDER BY p) AS lines, list(w ORDER BY p) AS ws, list(inside ORDER BY p) AS ins, list(joint ORDER BY p) AS js FROM a GROUP BY r
), i AS (
  SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM g
), k1 AS (
  SELECT *, unnest(range(1, least(len(ws) - p, {_MOST}) + 2)) AS k FROM i
), u0 AS (
  SELECT r, p, k, lines[p] AS line, flatten(ws[p:p + k - 1]) AS w FROM k1 WHERE p + k - 1 <= len(ws) AND (k = 1 OR ((ins[p] OR js[p]) AND (ins[p + k - 1] OR js[p + k - 2]))) AND list_sum(list_transform(ws[p:p + k - 1], lambda y: len(y))) <= {_MOST}
  UNION ALL
  SELECT r, 0, 0, 0, flatten(ws) FROM g WHERE len(ws) > 1
), u AS (
  SELECT r, p, k, line, w, len(w) - 1 AS m FROM u0 WHERE len(w) BETWEEN 2 AND {_MOST}
), ub AS (
  SELECT r, p, k, line, m, g, count(*) AS c
  FROM (SELECT r, p, k, line, m, unnest(list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1])) AS g FROM u)
  GROUP BY ALL
), s AS (
  SELECT r, p, k, line, kb.i, sum(least(ub.c, kb.c)) AS c, any_value(m) AS m FROM ub JOIN kb USING (g) GROUP BY r, p, k, line, kb.i
), h AS (
  SELECT s.*, tk.name, CAST(s.c AS DOUBLE) * 2 / (s.m + len(tk.w) - 1) AS dice
  FROM s JOIN tk USING (i) WHERE CAST(s.c AS DOUBLE) * 2 / (s.m + len(tk.w) - 1) >= {LEAST}::DOUBLE
), b AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, p, k, i) AS o,
         count(DISTINCT CASE WHEN p > 0 THEN line END) OVER (PARTITION BY r) AS n_lines FROM h
)
SELECT d.doc_id, b.name AS license, CAST(b.i AS INTEGER) AS template, b.dice, CAST(b.line AS INTEGER) AS line, CAST(b.k AS INTEGER) AS pieces, CAST(coalesce(b.n_lines, 0) AS INTEGER) AS n_lines
FROM d LEFT JOIN b ON b.r = d.r AND b.o = 1
"""
}
QUERIES = {"op9_license_scan": op9_license_scan}
