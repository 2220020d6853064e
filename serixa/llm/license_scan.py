"""License scans by diagonal voting, in DataFrame operations only.

Every run of `k` words of a text is a gram.  Grams are joined to the positions
they have in license templates; a hit votes for its diagonal, the text position
less the template position.  Neighbouring diagonals of one template are merged
(gaps come from inserted or dropped words), and a span is verified by the share
of the template's distinct grams that it holds.  Templates of phrases must be met
whole on one diagonal: those are the exact places.

The join is on the gram's hash and its text, so a hit is never a mere collision.
A sentinel gram keeps every document through the join; so the texts are read
once and only hits are shuffled.

Defined results: a null or empty text has no words, no places, empty labels and
score 0; a null id stays null; repeated rows get a row each; very long texts are
scanned whole; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Phrases that count wherever their words stand, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Opening or permission sentences of licenses, matched with gaps.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial license",
    "proprietary": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}


def template_grams(spark, phrases: dict[str, str], notices: dict[str, str], k: int) -> DataFrame:
    """(h, gram, template, label, exact, at, grams): a fixed table, one row per gram of a template, and the sentinel."""
    rows = [("", -1, "", False, -1, 0)]
    for name, (words, label, exact) in enumerate([(p.split(), x, True) for p, x in phrases.items()] + [(n.split(), x, False) for x, n in notices.items()]):
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        rows += [(g, name, label, exact, i, len(grams)) for i, g in enumerate(grams)]
    schema = T.StructType([T.StructField(n, t) for n, t in (("t_gram", T.StringType()), ("template", T.IntegerType()), ("label", T.StringType()), ("exact", T.BooleanType()), ("at", T.IntegerType()), ("grams", T.IntegerType()))])
    return spark.createDataFrame(rows, schema).withColumn("t_hash", F.xxhash64("t_gram"))


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
    k: int = GRAM,
    slack: int = 3,
    share: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A notice's label is given where merged diagonals (at most `slack` apart) hold
    `share` of its grams; score is the largest share met, 1 for an exact place.
    spans lists (label, first word, last word, share) of the accepted places.
    """
    if any(len(p.split()) < k for p in [*phrases, *notices.values()]):
        raise ValueError(f"templates need {k} words at least")
    spark = docs.sparkSession
    # lower() lower-cases more than A-Z; it never moves a word's bounds, and phrases are plain ASCII
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), SPLIT), "")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words.alias("w"))
    gram = lambda x, i: F.concat_ws(" ", x, *(F.get("w", i + F.lit(j)) for j in range(1, k)))
    grams = texts.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), F.transform("w", gram))).alias("place", "gram"))
    known = F.broadcast(template_grams(spark, phrases, notices, k))  # fixed: a few hundred rows
    hits = grams.withColumn("h", F.xxhash64("gram")).join(known, (F.col("h") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    hits = hits.select("row", "doc_id", "n_words", "template", "label", "exact", "grams", "at", (F.col("place") - 1 - F.col("at")).alias("diagonal"), (F.col("place") - 1).alias("place"))
    voted = hits.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "grams", "diagonal").agg(
        F.count_distinct("at").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("at").alias("held")
    )
    # neighbouring diagonals of one template and document run together
    along = W.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.col("exact") | F.lag("diagonal").over(along).isNull() | (F.col("diagonal") - F.lag("diagonal").over(along) > slack)
    runs = voted.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(along))
    spans = runs.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "grams", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"), F.min("first").alias("first"), (F.max("last") + (k - 1)).alias("last")
    )
    met = F.when(F.col("template") >= 0, F.col("held") / F.col("grams")).otherwise(F.lit(0.0))
    spans = spans.withColumn("share", met)
    base = F.col("exact") & (F.col("held") == F.col("grams"))
    other = ~F.col("exact") & (F.col("template") >= 0) & (F.col("share") >= share)
    near = F.when(~F.col("exact"), F.col("share")).otherwise(F.lit(0.0))
    per_doc = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("b"),
        F.collect_set(F.when(base | other, F.col("label"))).alias("l"),
        F.greatest(F.max(F.when(base, F.lit(1.0)).otherwise(F.lit(0.0))), F.max(near)).alias("score"),
        F.collect_list(F.when(base | other, F.struct("label", "first", "last", "share"))).alias("spans"),
    )
    names = lambda c: F.array_join(F.array_sort(F.col(c)), ",")
    return per_doc.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", names("b").alias("base_labels"), names("l").alias("labels"), "score", "spans")


def listed(spans: Column) -> Column:
    """Verified spans as text: label:first-last by place, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"], s["last"], s["label"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat(s["label"], F.lit(":"), s["first"].cast("string"), F.lit("-"), s["last"].cast("string"))), ",")


def reference_scan(text: str | None, phrases: dict[str, str] = PHRASES) -> tuple:
    """(n_words, n_base, first, last, labels) of one text, word by word; for tests."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))
