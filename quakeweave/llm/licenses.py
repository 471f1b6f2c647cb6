"""Licence scans: Dice coefficient over word bigrams against licence templates.

A unit is a line of a text, or the whole text if it has several lines (unit 0).  Its
normalised words (letters and digits, in lower case) give a set of word bigrams;
Dice is twice the common bigrams over the sum of both sets' sizes.  A template whose
set is so much smaller or larger than the unit's that the coefficient could not reach
the threshold is not compared, and a unit without any of the words that every likely
match must share is not normalised at all.  Only DataFrame functions are used.

A null, empty or one-word unit has no bigrams and no result.  Equal lines are reported
by line, equal rows by row.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.llm._common import let, table

PERCENT = 80
#: Public licences' names and their usual short notices or grants.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "This project is licensed under the terms of the MIT license."),
    ("MIT-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT-disclaimer", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-disclaimer", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


#: Words that are in most texts.
COMMON = ("a", "and", "at", "be", "by", "for", "in", "is", "of", "or", "that", "the", "this", "to", "with")


def template_bigrams(text: str) -> list[str]:
    w = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def needed_words(bigrams: list[str], percent: int) -> set[str]:
    """Words of which a unit that reaches the threshold has at least one, the longest that will do, common ones last.

    Such a unit has percent / (200 - percent) of the template's bigrams at least, so it misses so few that it has
    one of any larger number of them; words are added until that many bigrams hold one of them.
    """
    spare = len(bigrams) - -(-len(bigrams) * percent // (200 - percent))
    out, left = set(), set(bigrams)
    for word in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (w in COMMON, -len(w), w)):
        if len(bigrams) - len(left) > spare:
            break
        if any(word in b.split() for b in left):
            out.add(word)
            left = {b for b in left if word not in b.split()}
    return out


def _bigrams(unit: Column) -> Column:
    w = F.filter(F.split(F.lower(unit), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return let(w, lambda a: F.array_distinct(F.transform(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(a, i + 1)))))


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, unit (line from 1, or 0 for the whole text), n_bigrams, license, dice: the likest template of each unit that has one."""
    known = [(name, template_bigrams(text)) for name, text in templates]
    least = min(len(b) for _, b in known) * percent // (200 - percent)
    most = max(len(b) for _, b in known) * (200 - percent) // percent + 1
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split("text", "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(F.concat(F.array(F.lit("")), lines))
    words = sorted(set().union(*(needed_words(b, percent) for _, b in known)))
    words = [w for w in words if not any(v in w for v in words if v != w)]  # a part of a word is found wherever the word is

    def may_have(column: str) -> Column:
        return let(F.lower(F.col(column)), lambda low: reduce(lambda a, w: a | F.contains(low, F.lit(w)), words[1:], F.contains(low, F.lit(words[0]))))

    rows = docs.select("doc_id", text.alias("text")).filter(may_have("text")).select("doc_id", F.posexplode(units).alias("unit", "_text")).filter(may_have("_text"))
    rows = rows.select("doc_id", F.col("unit").cast("long").alias("unit"), _bigrams(F.col("_text")).alias("_b")).withColumn("n_bigrams", F.size("_b").cast("long"))
    rows = rows.filter(F.col("n_bigrams").between(least, most))
    n = F.col("n_bigrams")
    tried = []
    for name, bigrams in known:
        m = len(bigrams)
        possible = 200 * F.least(n, F.lit(m)) >= percent * (n + m)
        common = F.size(F.array_intersect("_b", F.array(*[F.lit(b) for b in bigrams])))
        dice = 2.0 * common / (n + m)
        tried.append(F.when(possible, F.struct(dice.alias("dice"), F.lit(name).alias("license"))))
    best = F.aggregate(F.array(*tried), F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license")), lambda a, x: F.when(x.isNotNull() & (x["dice"] > a["dice"]), x).otherwise(a))
    out = rows.withColumn("_best", best).filter(F.col("_best.dice") * 100 >= percent)
    return out.select("doc_id", "unit", "n_bigrams", F.col("_best.license").alias("license"), F.col("_best.dice").alias("dice"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join("({}, '{}', [{}])".format(k, name, ", ".join(f"'{b}'" for b in template_bigrams(text))) for k, (name, text) in enumerate(TEMPLATES))
    return rf"""
WITH t(k, license, b) AS (VALUES {rows}),
l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS unit, unnest(ls) AS x FROM l
      UNION ALL SELECT doc_id, 0, text FROM l WHERE len(ls) > 1),
w AS (SELECT doc_id, unit, list_filter(regexp_split_to_array(lower(x), '[^\p{{L}}\p{{N}}]+'), lambda y: y <> '') AS w FROM u),
b AS (SELECT doc_id, unit, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, unit, len(b.b) AS n_bigrams, license, k, 2.0::DOUBLE * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice
      FROM b JOIN t ON 200 * least(len(b.b), len(t.b)) >= {PERCENT} * (len(b.b) + len(t.b)))
SELECT doc_id, unit, n_bigrams, license, dice FROM d WHERE dice * 100 >= {PERCENT}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, k) = 1
"""


QUERIES = {"op9_licenses": op9_licenses}
SQL = {"op9_licenses": _sql()}
