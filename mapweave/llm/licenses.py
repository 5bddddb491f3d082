"""License scans as an exact set-similarity join, with DataFrame functions only.

Base labels: places where the words of a fixed phrase stand consecutively. The method adds
labels of license templates: a text block gets a template's label if it holds at least
``CONTAINMENT`` of the template's distinct words. Blocks are the runs of ``RUN`` times as many
words as the template has, wherever lines and paragraphs end, so that wrapped headers, and
lines and paragraphs up to that length, are found with some words put in.

The templates' rare words, by global frequency, form an inverted index (the prefixes of the
templates); the words of all texts are joined with it. A joined word leads to the runs in which
it is the rarest of its template: these can hold no more than the template has from its place
on (positional filter) and no more than stands around it (length filter). What is left is
counted in full, so the join is exact.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Phrases and their labels (fixed values of the contract).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: License statements whose words form the templates; a block that holds most of them gets the label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl": "GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-release": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
TEMPLATES |= {
    "apache-2.0-notice": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "gpl-notice": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.

        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    "isc": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:

        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.""",
}
CONTAINMENT, RUN = 0.8, 1.5
#: What stands between words, before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands before a text's words, so that a text without any joined word stays in the join.
FIRST = "\x00"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: str) -> list[str]:
    """The words of a template, by the rule for texts."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted(set(words_of(v))) for k, v in templates.items()}


def run_length(template: str) -> int:
    """Words of the runs that are compared with a template."""
    return math.ceil(RUN * len(words_of(template)))


def needed(n: int, threshold: float) -> int:
    """The least number of ``n`` words that reaches the threshold."""
    return max(1, math.ceil(threshold * n - 1e-9))


def spaced(c: Column) -> Column:
    """Each word between two spaces of its own: `` a  b  c ``; without words, two spaces or none."""
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(c, GAP, "  "), r"^  |  $", ""), F.lit(" "))


def _words_in(spaced_text: Column) -> Column:
    return F.when(F.length(F.trim(spaced_text)) == 0, 0).otherwise((F.length(F.trim(spaced_text)) - F.length(F.replace(F.trim(spaced_text), F.lit("  "), F.lit(" ")))) + 1)


def word_frequencies(words: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How often each of ``wanted`` stands in ``words`` (word); one row for each reaches the driver."""
    if not wanted:
        return {}
    known = words.sparkSession.createDataFrame([(w,) for w in wanted], "word string")
    return {r["word"]: r["count"] for r in words.join(F.broadcast(known), "word").groupBy("word").count().collect()}


def index_rows(templates: dict[str, str], order: dict[str, int], threshold: float) -> list[tuple]:
    """(word, label, place, n, need, width, words) of each prefix word: its place among the template's distinct words, rare ones first."""
    rows = [(FIRST, None, None, None, None, None, None)]
    for label, mine in template_words(templates).items():
        mine = sorted(mine, key=lambda w: (order.get(w, 0), w))
        need = needed(len(mine), threshold)
        rows += [(w, label, i, len(mine), need, run_length(templates[label]), mine) for i, w in enumerate(mine[: len(mine) - need + 1])]
    return rows


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = CONTAINMENT) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Null texts count as empty: no words, no labels, score 0. Columns of these names are
    replaced, others stay whatever their names. Repeated rows give repeated results; an empty
    table none; without templates there are base labels only. ``score`` is 1 where a base phrase
    stands, else the largest share of a template that a block holds if that reaches the
    threshold, else 0. Long texts and lines are scanned whole.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    outs = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [c for c in docs.columns if c not in outs]
    mine = [f"__c{i}" for i in range(len(kept))]
    low = lowered(spaced(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    spread = docs.select(*[F.col(f"`{c}`").alias(m) for c, m in zip(kept, mine)], low.alias("__low"))
    order = word_frequencies(spread.select(F.explode(F.split(F.trim("__low"), "  ")).alias("word")), sorted({w for v in templates.values() for w in words_of(v)}))
    schema = "word string, label string, place int, n int, need int, width int, words array<string>"
    rows = index_rows(templates, order, threshold)
    index = spark.createDataFrame(rows, schema)

    n_words = _words_in(F.col("__low")).cast("long")
    base = F.when(F.col("__low").rlike(" (" + "|".join(p.replace(" ", "  ") for p in PHRASES) + ") "), F.col("__low"))
    found = spread.select("*", n_words.alias("n_words"), base.alias("__base"), F.monotonically_increasing_id().alias("__row"))
    firsts, lasts, counts, names = [], [], [], []
    for phrase, label in PHRASES.items():
        p = " " + phrase.replace(" ", "  ") + " "
        n = (F.length("__base") - F.length(F.replace(F.col("__base"), F.lit(p), F.lit("")))) / len(p)
        n = F.coalesce(n.cast("long"), F.lit(0).cast("long"))
        counts.append(n)
        firsts.append(F.when(n > 0, _words_in(F.substring_index("__base", p, 1))))
        lasts.append(F.when(n > 0, F.col("n_words") - _words_in(F.substring_index("__base", p, -1)) - len(phrase.split())))
        names.append(F.when(n > 0, F.lit(label)))
    total = counts[0]
    for n in counts[1:]:
        total = total + n
    about = {"n_base": total.cast("long"), "first_word": F.array_min(F.array_compact(F.array(*firsts))).cast("long"), "last_word": F.array_max(F.array_compact(F.array(*lasts))).cast("long"), "__names": F.array_compact(F.array(*names))}
    found = found.select(*mine, "__row", "n_words", *[c.alias(k) for k, c in about.items()], F.split(F.trim("__low"), "  ").alias("__words"))

    # the words that are in the index, with their places; a join of all words would carry each text as often as it has words
    indexed = sorted({r[0] for r in rows} - {FIRST})
    spot = lambda at, w: F.struct(at.cast("int").alias("at"), w.alias("word"))
    seen = F.array_compact(F.transform("__words", lambda w, i: F.when(w.isin(indexed), spot(i, w)))) if indexed else F.array().cast("array<struct<at: int, word: string>>")
    spots = found.withColumn("__spots", F.concat(F.array(spot(F.lit(-1), F.lit(FIRST))), seen)).withColumn("__spot", F.explode("__spots")).drop("__spots")
    met = spots.select("*", F.col("__spot.at").alias("__at"), F.col("__spot.word").alias("word")).join(F.broadcast(index), "word")
    # runs that hold the word, all inside this stretch of the text
    start = F.greatest(F.col("__at") - F.col("width") + 1, F.lit(0))
    around = F.slice("__words", start + 1, 2 * F.col("width") - 1)
    behind = F.slice("words", F.col("place") + 1, F.col("n"))
    may = (F.size("__words") >= F.col("need")) & (F.size(F.array_intersect(around, behind)) >= F.col("need"))
    last = F.greatest(F.least(F.col("__at"), F.size("__words") - F.col("width")), start)
    shares = F.transform(F.sequence(start, last), lambda i: F.size(F.array_intersect(F.slice("__words", i + 1, F.col("width")), F.col("words"))))
    held = F.when(F.col("label").isNotNull() & may, F.array_max(shares))
    hits = met.select(*mine, "__row", "n_words", *about, F.col("label").isNull().alias("__first"), "label", (held / F.col("n")).alias("__share"), (held >= F.col("need")).alias("__good"))
    hits = hits.where("__first or __good")
    once = lambda c: F.first(F.when(F.col("__first"), F.col(c)), ignorenulls=True)
    done = hits.groupBy("__row").agg(*[once(c).alias(c) for c in [*mine, "n_words", *about]], F.collect_set("label").alias("__labels"), F.max("__share").alias("__share"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.when(F.size("__names") > 0, F.lit(1.0)).otherwise(F.coalesce("__share", F.lit(0.0)))
    return done.select(*[F.col(m).alias(c) for c, m in zip(kept, mine)], "n_words", "n_base", "first_word", "last_word", joined(F.col("__names")).alias("base_labels"), joined(F.concat("__names", "__labels")).alias("labels"), score.alias("score"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
