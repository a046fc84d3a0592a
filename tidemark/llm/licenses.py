"""License scan by diagonal voting, with DataFrame functions only.

Every rolling word k-gram of a text is hashed and joined to the positions at which license templates
hold the same k-gram.  A hit at word ``p`` of the text and ``q`` of the template votes for the diagonal
``p - q``; votes are bit sets over q, 64 to a row, so a repeated row or hit votes once.  Diagonals that lie
within a few words of each other (a word added or left out) are merged, and a merged span is accepted when
enough of the template's k-grams are found on it; the words themselves are compared at each hit.

Defined cases: a null text counts as empty (no words, empty labels, score 0); equal rows give equal
results and all stay; ties don't arise, labels are sorted and places are numbers; the work grows in proportion to
the words of a text, whose list of words one task holds; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, text_key

K = 2
BAND = 3
ENOUGH = 0.7
TOKEN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Base phrases: a place is a full match.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Openings and whole texts of well-known license notices, of which ``ENOUGH`` must be found.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "bsd-3-clause": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "licensed under the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0-1.0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "bsl-1.0": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
}
#: Names that tell versions and relatives apart; they must be whole.
NAMES = {
    "gpl-2.0": ["gnu general public license version 2", "gnu general public license v2", "either version 2 of the license"],
    "gpl-3.0": ["gnu general public license version 3", "gnu general public license v3", "either version 3 of the license"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "agpl": ["gnu affero general public license"],
    "epl-2.0": ["eclipse public license v2 0", "eclipse public license 2 0"],
    "cc0-1.0": ["cc0 1 0 universal", "creative commons zero"],
    "artistic-2.0": ["artistic license 2 0", "the artistic license"],
    "bsd-2-clause": ["bsd 2 clause"], "bsd-3-clause": ["bsd 3 clause"], "bsl-1.0": ["boost software license"], "isc": ["isc license"], "zlib": ["zlib license"],
    "cc-by-nc": ["attribution noncommercial 4 0"], "cc-by-nd": ["attribution noderivatives 4 0"], "ofl-1.1": ["sil open font license"],
}


def templates() -> list[tuple[int, str, bool, bool, list[str]]]:
    """number, label, whether it is a base phrase, whether it must be whole, and the words."""
    kinds = [(v, p, True, True) for p, v in BASE.items()] + [(label, t, False, False) for label, texts in TEMPLATES.items() for t in texts] + [(label, t, False, True) for label, texts in NAMES.items() for t in texts]
    return [(n + 1, label, base, whole, text.split()) for n, (label, text, base, whole) in enumerate(kinds)]


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """One row a template k-gram: h, gram, template, label, base, whole, length (k-grams), q. At most some thousand rows."""
    rows = [(words[q : q + k], t, label, base, whole, len(words) - k + 1, q) for t, label, base, whole, words in templates() for q in range(len(words) - k + 1)]
    # Each text also holds one marker, so that texts without any hit stay in the result.
    rows.append(([""] * k, 0, "", False, False, 0, 0))
    df = spark.createDataFrame(rows, "gram array<string>, template int, label string, base boolean, whole boolean, length int, q int")
    return df.withColumn("h", gram_hash([F.col("gram")[i] for i in range(k)]))


def gram_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, band: int = BAND, enough: float = ENOUGH) -> DataFrame:
    """One row a record: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("__x"), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TOKEN), F.lit(0)).alias("__w"))
    # The number of words is a column of its own, or the list would go along with every k-gram.
    rows = rows.withColumn("n_words", F.size("__w").cast("long"))
    last = F.size("__w") - k
    # A k-gram travels with its own words; the text's list of words stays behind.
    word = lambda i, j: F.get(F.col("__w"), i + j)
    gram = lambda i: F.struct(i.alias("p"), gram_hash([word(i, j) for j in range(k)]).alias("h"), *[word(i, j).alias(f"w{j}") for j in range(k)])
    kind = "array<struct<p:int,h:bigint," + ",".join(f"w{j}:string" for j in range(k)) + ">>"
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), gram)).otherwise(F.array().cast(kind))
    marker = F.struct(F.lit(-1).alias("p"), gram_hash([F.lit("")] * k).alias("h"), *[F.lit("").alias(f"w{j}") for j in range(k)])
    hits = rows.select("doc_id", "__x", "n_words", F.inline(F.concat(F.array(marker).cast(kind), grams)))
    found = hits.join(F.broadcast(template_grams(docs.sparkSession, k)), "h")
    same = F.lit(True)
    for j in range(k):
        same = same & (F.col(f"w{j}") == F.col("gram")[j])
    found = found.filter(((F.col("template") == 0) == (F.col("p") < 0)) & same)
    votes = found.select("doc_id", "__x", "n_words", "template", "label", "base", "whole", "length", (F.col("p") - F.col("q")).cast("long").alias("d"), F.expr("q div 64").alias("block"), F.expr("shiftleft(1L, cast(q % 64 as int))").alias("bit"))
    keys = ["doc_id", "__x", "n_words", "template", "label", "base", "whole", "length"]
    diagonals = votes.groupBy(*keys, "d", "block").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    line = Window.partitionBy("doc_id", "__x", "template").orderBy("d")
    before = F.col("d") - F.lag("d").over(line)
    # The rows of one diagonal stay together; those of templates that must be whole are never merged.
    step = F.when(before.isNull() | (before > F.when(F.col("whole"), 0).otherwise(band)), 1).otherwise(0)
    merged = diagonals.withColumn("__s", step).withColumn("__g", F.sum("__s").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*keys, "__g", "block").agg(F.bit_or("bits").alias("bits"), F.min("d").alias("low"), F.max("d").alias("high"), F.max("n").alias("n"))
    spans = spans.groupBy(*keys, "__g").agg(F.sum(F.bit_count("bits")).alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("n"))
    part = F.col("votes") / F.col("length")
    spans = spans.withColumn("part", F.when(F.col("template") > 0, part).otherwise(0.0))
    spans = spans.filter((F.col("template") == 0) | (F.col("part") >= F.when(F.col("whole"), 1.0).otherwise(enough)))
    span = F.struct((F.col("low")).alias("start"), (F.col("high") + F.col("length") + k - 1).alias("end"), "label", "part")
    base = F.col("base")
    out = spans.groupBy("doc_id", "__x", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("low"))).alias("first_word"), F.max(F.when(base, F.col("low"))).alias("last_word"),
        _labels(F.when(base, F.col("label"))).alias("base_labels"), _labels(F.when(F.col("template") > 0, F.col("label"))).alias("labels"),
        F.coalesce(F.max("part"), F.lit(0.0)).cast("double").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("template") > 0, span))).alias("spans"),
        F.max(F.when(F.col("template") == 0, F.col("n"))).cast("int").alias("__n"),
    )
    out = out.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def _labels(label: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(label)), ",")
