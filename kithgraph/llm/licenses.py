"""License scans by diagonal voting.

Every text is cut into words and its rolling word k-gram hashes are joined to the places of the same grams in license
templates. A match of document word d with template word t votes for the diagonal d - t: a copy of a template puts all its
votes on one diagonal, and words inserted or left out move the rest to diagonals near by, which are merged. A span counts
when enough of its template's grams stand on it. All work is DataFrame expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words of a gram; a template of fewer words is one gram.
GRAM = 3
#: A span counts when this share of its template's grams votes for it.
LEAST = 0.5
#: Distinct grams of all templates, which go to every task in the plan.
MOST_GRAMS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: all ASCII that is no digit and no letter.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """base: a phrase whose every place is reported, word for word."""

    label: str
    text: str
    base: bool = False

    @cached_property
    def words(self) -> list[str]:
        return [w for w in re.split(PARTS, self.text.translate(str.maketrans(UPPER, LOWER))) if w]

    @property
    def k(self) -> int:
        return min(GRAM, len(self.words))

    @property
    def grams(self) -> list[str]:
        w, k = self.words, self.k
        return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]

    @property
    def near(self) -> int:
        """Diagonals at most so far apart belong together: none of a short template, so that its copies stay apart."""
        return min(3, len(self.words) // 8)


#: Fixed phrases.
BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
#: Fixed texts: the notices that the licenses' own texts ask for, and common short forms.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("mit", "Released under the MIT License."),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("apache", "Licensed under the Apache License, Version 2.0."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)
TEMPLATES = BASE + NOTICES
SPANS = "array<struct<start:bigint,label:string,stop:bigint,base:boolean,share:double>>"


def words(text: Column) -> Column:
    """The text's words, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), PARTS, -1), "")


def gram_hash(parts: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(parts)), *parts)


def template_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """A row for each gram of each template: its hash, its words and its place. As large as the templates, which are a parameter of checked size."""
    rows = [(t, x.label, x.base, x.k, len(x.grams), x.near, at, gram) for t, x in enumerate(templates) if x.words for at, gram in enumerate(x.grams)]
    if len({r[7] for r in rows}) > MOST_GRAMS:
        raise ValueError(f"templates of more than {MOST_GRAMS} grams: scan with parts of them")
    sizes = sorted({r[3] for r in rows})
    made = spark.createDataFrame(rows, "t int, label string, base boolean, k int, grams int, near int, place int, gram string")
    parts = F.split("gram", " ")
    h = F.when(F.lit(False), F.lit(0).cast("long"))
    for k in sizes:
        h = h.when(F.col("k") == k, gram_hash([F.get(parts, F.lit(i)) for i in range(k)]))
    return made.withColumn("h", h)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """For every row of docs: n_words and `spans`, an array of (start, label, stop, base, share) by start in words, stop exclusive.

    Spans with base true are the places of base phrases, word for word (share 1). The others are diagonals, alone or merged
    with their neighbours, with at least `least` of their template's grams. `best` is the largest share of any template's
    grams on a diagonal or its merged neighbours, whether it counts or not, 0 without a vote.

    A null or wordless text has no words and no spans. Repeated rows each give one; an empty table gives none. Templates
    without words find nothing. Only the id and the text are read, so other columns may have any name. Texts are read once,
    into a table of the words' number and the grams found; equal texts vote once, under their hash. Rows without a gram of
    any template are in no shuffle.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    found: dict[int, list[int]] = {}
    for r in known.select("k", "h").distinct().collect():  # the templates' own grams
        found.setdefault(r.k, []).append(r.h)

    def hits(w: Column, k: int) -> Column:
        """Places and hashes of the text's grams of k words that some template has, with their words."""
        rolling = F.transform(w, lambda x, i: F.struct(i.alias("d"), gram_hash([x, *[F.get(w, i + j) for j in range(1, k)]]).alias("h")))
        mine = F.filter(rolling, lambda g: g["h"].isin(found[k]) & (g["d"] <= F.size(w) - k))
        return F.transform(mine, lambda g: F.struct(g["d"].alias("d"), g["h"].alias("h"), F.array_join(F.slice(w, g["d"] + 1, k), " ").alias("gram")))

    none = F.array().cast("array<struct<d:int,h:bigint,gram:string>>")
    # a lambda's variable holds the words, so that they are cut once and not for every gram
    cut = F.transform(F.array(words(F.col(text_col))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.concat(none, *[hits(w, k) for k in sorted(found)]).alias("hits")))
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = common.kept(docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.inline_outer(cut)), "grams")
    votes = rows.where(F.size("hits") > 0).select("key", F.inline("hits")).withColumnRenamed("gram", "words").join(F.broadcast(known), "h").where("words = gram")
    # one vote for each gram of a template on a diagonal, however many rows have the text
    votes = votes.select("key", "t", (F.col("d") - F.col("place")).alias("diagonal"), "place", "label", "base", "k", "grams", "near").distinct()
    by = Window.partitionBy("key", "t")
    votes = votes.withColumn("n", F.count("*").over(Window.partitionBy("key", "t", "diagonal")))
    step = F.col("diagonal") - F.lag("diagonal").over(by.orderBy("diagonal", "place"))
    votes = votes.where((F.col("n") > 1) | (F.col("near") == 0)).withColumn("new", (F.coalesce(step, F.col("near") + 1) > F.col("near")).cast("int"))
    votes = votes.withColumn("merged", F.sum("new").over(by.orderBy("diagonal", "place").rowsBetween(Window.unboundedPreceding, 0)))
    told = [F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"), (F.countDistinct("place") / F.first("grams")).alias("share"), F.min(F.col("diagonal") + F.col("place")).cast("long").alias("start"), F.max(F.col("diagonal") + F.col("place") + F.col("k")).cast("long").alias("stop")]
    alone = votes.groupBy("key", "t", "merged", "diagonal").agg(*told)
    both = votes.groupBy("key", "t", "merged").agg(F.countDistinct("diagonal").alias("diagonals"), F.count("*").alias("votes"), *told).where("diagonals > 1 AND NOT base")
    # a merged span of which most words vote for nothing is a chain of chance; its diagonals stand alone
    one = alone.select("key", "label", "base", "share", "start", "stop").unionByName(both.where("2 * votes >= stop - start").select("key", "label", "base", "share", "start", "stop"))
    counts = (F.col("base") & (F.col("share") == 1)) | (~F.col("base") & (F.col("share") >= least))
    span = F.struct("start", "label", "stop", "base", "share")
    got = one.groupBy("key").agg(F.array_sort(F.collect_set(F.when(counts, span))).alias("spans"), F.max("share").alias("best"))
    empty = F.array().cast(SPANS)
    plain = rows.where(F.size("hits") == 0).select("doc_id", "n_words", empty.alias("spans"), F.lit(0.0).alias("best"))
    return plain.unionByName(rows.where(F.size("hits") > 0).select("doc_id", "n_words", "key").join(got, "key", "left").select("doc_id", "n_words", F.coalesce(F.col("spans").cast(SPANS), empty).alias("spans"), F.coalesce("best", F.lit(0.0)).alias("best")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. score: the largest share of a template found; 1 with a base phrase."""
    out = scan(common.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return out.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels("spans").alias("labels"), F.col("best").alias("score"))
