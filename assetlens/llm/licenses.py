"""License scan by diagonal voting.

Every text's rolling hashes of three words are joined to the places where the templates have the same
words. A hit at text word p and template word t votes for the diagonal p - t. Votes are gathered by
diagonal; neighbouring diagonals of a notice (a word put in or left out moves the rest by one) are
merged to spans; a span counts when enough of its template's places are covered within a stretch not
much longer than the template. A phrase has to stand word for word: all its places on one diagonal.

The join's small side is the template table, of fixed size. Words are compared by 64-bit hashes: the
chance that any of n text places falsely equals any of t template places is n * t / 2**64.

Null and empty texts have no words and no labels. Equal rows give equal rows, each its own: rows are told
apart by their place, so ``df`` has to be a table or a staged result, which reads alike when a task is
run again. Only the id
and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.llm.blocks import ALNUM, lists, row_of, span_hashes, text_blocks, words

GRAM = 3
START = 0  # a gram that every row has

# The phrases of the contract, and wording of public licenses.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "released under the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd license",
    ],
    "gpl-2": ["gnu general public license version 2"],
    "gpl-3": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "agpl-3": ["licensed under the gnu affero general public license version 3"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-sa": ["licensed under a creative commons attribution sharealike 4 0 international license", "licensed under cc by sa 4 0"],
    "cc-by-nc": ["licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"],
    "all-rights-reserved": ["no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"],
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool


TEMPLATES = [Template(label, text, True) for text, label in PHRASES.items()] + [Template(label, text, False) for label, texts in NOTICES.items() for text in texts]


def gram_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word counts of the texts of a block, the rolling hashes of their word grams, and each text's first one."""
    _, _, first, h = words(data, offsets, ALNUM)
    n = np.diff(first)
    count = np.maximum(n - GRAM + 1, 0)
    at = np.r_[0, np.cumsum(count)]
    row = row_of(at)
    start = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    return n, span_hashes(h, start, start + GRAM).view(np.int64), at


def template_places(templates: list[Template]) -> list[tuple]:
    """(gram, template, label, phrase, grams, place) of every gram of every template, and the one every row has."""
    rows = [(START, -1, None, False, 1, 0)]
    for i, t in enumerate(templates):
        data = np.frombuffer(re.sub(r"[^a-z0-9 ]", " ", t.text).encode(), np.uint8)
        _, grams, _ = gram_hashes(data, np.array([0, len(data)]))
        rows += [(int(g), i, t.label, t.phrase, len(grams), k) for k, g in enumerate(grams)]
    return rows


def votes(df: DataFrame, templates: list[Template], id_col: str, text_col: str) -> DataFrame:
    """A row for every place of a text that a template shares, and one of template -1 for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, text=2):
            n, grams, at = gram_hashes(data, offsets)
            every = np.insert(grams, at[:-1], START)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n.astype(np.int64)), lists(every, at + np.arange(len(at)))], ["row", id_col, "n_words", "grams"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    grams = df.select(F.monotonically_increasing_id().alias("row"), id_col, text_col).mapInArrow(run, schema)
    places = df.sparkSession.createDataFrame(template_places(templates), "gram long, template int, label string, phrase boolean, grams_needed int, place int")
    spread = grams.select("row", id_col, "n_words", F.posexplode("grams").alias("at", "gram"))
    return spread.join(F.broadcast(places), "gram").select("row", id_col, "n_words", "template", "label", "phrase", "grams_needed", "place", (F.col("at") - 1 - F.col("place")).alias("diagonal"))


def spans(df: DataFrame, templates: list[Template] = TEMPLATES, slack: int = 2, coverage: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, template, label, phrase, start, end, share) of every verified span, and a row of template -1 for every text."""
    dealt = votes(df, templates, id_col, text_col).repartition("row")
    key = ["row", id_col, "n_words", "template", "label", "phrase", "grams_needed"]
    lines = dealt.groupBy(*key, "diagonal").agg(F.collect_set("place").alias("places"))  # at most a template's places
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    lines = lines.withColumn("fresh", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int"), F.lit(1)))
    lines = lines.withColumn("part", F.when(F.col("phrase"), F.col("diagonal")).otherwise(F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    found = lines.groupBy(*key, "part").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("places") + GRAM).alias("end"),
    )
    share = F.col("covered") / F.col("grams_needed")
    fits = F.col("end") - F.col("start") <= 2 * (F.col("grams_needed") + GRAM)
    exact = F.col("phrase") | (F.col("grams_needed") <= 8)  # in few words one other word is another license
    verified = F.when(exact, share == 1).otherwise((share >= coverage) & fits)
    return found.where((F.col("template") < 0) | verified).select(*key[:-1], "start", "end", share.alias("share"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: places of the phrases, labels and score."""
    found = spans(df, id_col=id_col, text_col=text_col)
    real = F.col("template") >= 0
    base = real & F.col("phrase")
    out = found.groupBy("row", id_col, "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(real, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
