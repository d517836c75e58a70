"""Licence scans: normalised text against templates by Dice's coefficient over word bigrams, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (licence id, text) of notices that public licences ask or are commonly given by.  Any table of
#: (licence, template) can take their place, full licence texts included.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "Copyright. All rights reserved."),
]


def default_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("licence"), F.lit(b).alias("template")) for a, b in TEMPLATES])
    return spark.range(1).select(F.inline(rows))


def _with_bigrams(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with the distinct word bigrams of normalised text: lower case, words of letters and digits, "licence" spelt one way.

    One word is a unit by itself; no words give an empty array; null counts as empty.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "licence", "license")
    words = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("__w", i - 1), F.get("__w", i)))
    pairs = F.when(F.size("__w") > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))
    return df.withColumn("__w", words).withColumn(name, pairs).drop("__w")


def scan(docs: DataFrame, templates: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """Matches (id_col, line int, licence, dice double): document lines like a template, the best licence of each line.

    Every line of every whole text is compared, and so is the text as a whole (line -1) if it has several lines, with
    each template whose size allows it: Dice 2 |A & B| / (|A| + |B|) can only reach `least` if the smaller set has at least
    least / (2 - least) of the larger's bigrams.  Sizes allow few templates for a line, and candidates are further
    bounded by sharing a bigram: lines meet templates in a join on it, by broadcast up to `broadcast_rows` template
    bigrams; no line is shuffled that meets none.  Ties go to the first licence by name.  Null and empty texts match nothing; repeated rows with equal ids are one; equal
    lines are all reported; an empty template table matches nothing.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    t = _with_bigrams(templates.where(F.col("template").isNotNull()).dropDuplicates(), F.col("template"), "__b").where(F.size("__b") > 0)
    t = t.select("licence", F.xxhash64("licence", "template").alias("__tid"), F.size("__b").alias("__tn"), F.explode("__b").alias("__g"))
    bounds = t.agg(F.min("__tn"), F.max("__tn")).first()
    low, high = (bounds[0] or 1) * least / (2 - least) - 1e-6, (bounds[1] or 0) * (2 - least) / least + 1e-6
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n")
    units = F.concat(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("x"))), F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("line"), F.col(text_col).alias("x")))).otherwise(F.array().cast("array<struct<line:int,x:string>>")))
    # explode_outer, and no filter on the bigrams: a filter would be pushed below them and compute them again for each word
    rows = docs.select(F.col(id_col), F.explode_outer(units).alias("u")).select(id_col, "u.line", "u.x")
    # no text of more code points than the largest template's bigrams could fill is compared with any: a word takes two at least
    rows = rows.where(F.char_length("x") >= 2 * low - 1)
    rows = _with_bigrams(rows, F.col("x"), "__b").select(id_col, "line", F.size("__b").alias("__n"), F.when(F.size("__b").between(low, high), F.col("__b")).alias("__b"))
    rows = rows.select(id_col, "line", "__n", F.explode_outer("__b").alias("__g"))
    if t.count() <= broadcast_rows:
        t = F.broadcast(t)
    met = rows.join(t, "__g").where(2.0 * F.least("__n", "__tn") / (F.col("__n") + F.col("__tn")) >= least)
    scored = met.groupBy(id_col, "line", "licence", "__tid", "__n", "__tn").agg(F.size(F.collect_set("__g")).alias("both"))
    scored = scored.select(id_col, "line", "licence", (2.0 * F.col("both") / (F.col("__n") + F.col("__tn"))).alias("dice")).where(F.col("dice") >= least)
    best = scored.groupBy(id_col, "line").agg(F.min(F.struct((-F.col("dice")).alias("d"), "licence")).alias("m"))
    return best.select(id_col, "line", F.col("m.licence").alias("licence"), (-F.col("m.d")).alias("dice"))
