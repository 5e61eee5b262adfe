"""License scans by diagonal voting, with DataFrame operations only.

Every rolling word 2-gram of every text is joined with the places of the same 2-gram in the templates. A match votes for its diagonal, the word of the
text at which the template would start. Votes are summed by text, template and diagonal; a whole phrase stands where one diagonal has all votes of a
phrase. For longer templates neighbouring diagonals (a few words put in or left out) are merged, and each merged span is verified: it counts if enough of the
template's 2-grams stand in it as one chain, in which place and text position both rise, each place counts once, the diagonal moves by at most NEIGHBOURS
from one to the next, and none of the 2-grams is missing that tell the template from those of other licenses (MUST). The templates are a constant table of some hundred rows, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walflow.llm.common import lower_az

#: Phrases and labels of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The method's own templates, by label: sentences of public license notices.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license",
}
#: 2-grams without which a template does not stand, as they tell it from other licenses' notices in the same words. The BSD sentence has no name in it.
MUST = {
    "apache-notice": ["apache license"],
    "cc-by-nc-notice": ["by nc"],
    "gpl-notice": ["gnu general"],
    "gpl-text": ["gnu general"],
    "mit-notice": ["mit license"],
    "mit-text": ["associated documentation"],
    "mpl-notice": ["mozilla public"],
}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NEIGHBOURS = 3  # diagonals up to this far apart are merged
ENOUGH = 0.6  # of a template's 2-grams
HEAVY = 1000  # what a 2-gram of MUST adds to a chain's weight, more than any template has 2-grams; a template has fewer than 63


def templates(spark: SparkSession) -> DataFrame:
    """label, base, grams (how many), must (bits of the places in MUST), place, w1, w2: a row for each 2-gram."""
    rows = []
    for base, table in ((True, {v: k for k, v in PHRASES.items()}), (False, TEMPLATES)):
        for label, text in table.items():
            w = text.split()
            must = sum(1 << i for i in range(len(w) - 1) if f"{w[i]} {w[i + 1]}" in MUST.get(label, []))
            rows += [(label, base, len(w) - 1, must, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    return spark.createDataFrame(rows, "label string, base boolean, grams int, must long, place int, w1 string, w2 string")


def heaviest_chain() -> Column:
    """The weight of the best chain of matches in a span with the columns grams, must, found (array of diagonal, places as bits): 1 a match, HEAVY more in MUST.

    Matches are gone through by text position. Only those are held that the next can follow, some 25 positions, so the work is linear in the span.
    """
    of_diagonal = lambda d: F.transform(F.filter(F.sequence(F.lit(0), F.col("grams") - 1), lambda p: F.getbit(d["places"], p) == 1), lambda p: F.struct((d["diagonal"] + p).alias("at"), (-p).alias("down")))
    matches = F.array_sort(F.flatten(F.transform("found", of_diagonal)))  # of one position the later place first, so that neither follows the other

    def step(held: Column, m: Column) -> Column:
        near = F.filter(held["near"], lambda a: a["at"] >= m["at"] - F.col("grams") - NEIGHBOURS)
        before = F.filter(near, lambda a: (a["at"] < m["at"]) & (a["down"] > m["down"]) & (F.abs(a["at"] + a["down"] - m["at"] - m["down"]) <= NEIGHBOURS))
        weight = (F.coalesce(F.array_max(F.transform(before, lambda a: a["weight"])), F.lit(0)) + 1 + HEAVY * F.getbit("must", -m["down"]).cast("int")).cast("int")
        last = F.struct(m["at"].alias("at"), m["down"].alias("down"), weight.alias("weight"))
        return F.struct(F.greatest(held["best"], last["weight"]).alias("best"), F.concat(near, F.array(last)).alias("near"))

    start = F.struct(F.lit(0).alias("best"), F.array().cast("array<struct<at:int,down:int,weight:int>>").alias("near"))
    return F.aggregate(matches, start, step, lambda held: held["best"])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text is empty. score is the best share of a template's 2-grams verified in one merged span, 1 where a base phrase stands. Repeated rows get a row
    each. Empty tables give empty results; other columns are not read.
    """
    words = F.filter(F.split(lower_az(F.col("text")), NOT_WORD, -1), lambda w: w != "")
    # rows are known by their content, which is the same however often they are read; rows alike in both have the same result
    key = [F.xxhash64(F.lit(k), F.col("doc_id").cast("long"), F.col("text")).alias(f"k{k}") for k in (1, 2)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, words.alias("words"))
    uid = ["k1", "k2"]
    grams = rows.select(*uid, F.posexplode(F.arrays_zip(F.col("words").alias("a"), F.slice(F.col("words"), F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))).alias("b"))).alias("at", "g"))
    grams = grams.select(*uid, "at", F.col("g.a").alias("w1"), F.col("g.b").alias("w2"))
    votes = grams.join(F.broadcast(templates(docs.sparkSession)), ["w1", "w2"]).groupBy(*uid, "label", "base", "grams", "must", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("places"))
    whole = votes.filter("base and bit_count(places) = grams").groupBy(*uid).agg(F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set"))
    w = Window.partitionBy(*uid, "label").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > NEIGHBOURS, F.lit(True)).cast("int")
    spans = votes.filter("not base").withColumn("apart", apart).withColumn("span", F.sum("apart").over(w))
    spans = spans.groupBy(*uid, "label", "grams", "must", "span").agg(F.bit_or("places").alias("places"), F.collect_list(F.struct("diagonal", "places")).alias("found"))
    likely = spans.filter((F.bit_count("places") >= ENOUGH * F.col("grams")) & (F.col("places").bitwiseAND(F.col("must")) == F.col("must")))
    chains = likely.withColumn("weight", heaviest_chain()).withColumn("share", (F.col("weight") % HEAVY) / F.col("grams"))
    spans = chains.filter((F.floor(F.col("weight") / HEAVY) >= F.bit_count("must")) & (F.col("share") >= ENOUGH))
    own = spans.groupBy(*uid).agg(F.collect_set("label").alias("own_set"), F.max("share").alias("share"))
    found = whole.join(own, uid, "full_outer")
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base_set", none), F.coalesce("own_set", none)
    return (
        rows.select("doc_id", *uid, F.size("words").cast("long").alias("n_words")).join(found, uid, "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
            F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
            F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        )
    )
