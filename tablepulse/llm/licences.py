"""Licence scans by a positional index of rare words, in DataFrame operations only.

Templates are licence notices.  The index lists the places of their words, function words
left out.  A file looks up, for each template, its ``RARE_WORDS`` words of the highest inverse
document frequency, counted over all documents, words of mandatory key phrases first.  Every
posting votes for a template at a relative position (place in the file less place in the
template); where ``MIN_VOTES`` different words agree, the template is laid over the file there.
It is accepted if all words of its mandatory key phrases stand in place and at least
``MIN_SCORE`` of its weight (inverse document frequency) does.  Function words are not looked up, but a
mandatory phrase that has some is found as a whole, and must begin where the template has it.
Each template has two or more different mandatory words and all of them stand where it is accepted, so no place is missed.

Phrases of the base rules are found independently and always label a file.

Rows: NULL texts are empty.  Rows that repeat an id are judged by their own text, repeated
rows alike.  Only licence words and their places leave the scan of the texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepulse.llm.storage import landed

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE_WORDS = 8
MIN_VOTES = 2
MIN_SCORE = 0.6
# Phrases of the base rules and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices, their labels and the phrases that must be there.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["file except in compliance", "obtain a copy of the license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", ["hereby granted free of charge", "without restriction"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license",
     ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", ["source and binary forms", "permitted provided"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["purpose with or without fee", "hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]
FUNCTION_WORDS = set("a and any are as at by can for in is it may met not of or or that the this to under with you".split())


#: Mandatory phrases with function words; the index holds them as one word of no weight.
WHOLE = sorted({p for _, _, phrases in TEMPLATES for p in phrases if set(p.split()) & FUNCTION_WORDS})


def template_rows() -> list[tuple[int, str, int, str, bool]]:
    """(template, label, place, word, mandatory) of every indexed word and whole phrase."""
    rows = []
    for number, (label, text, phrases) in enumerate(TEMPLATES):
        words, must = text.split(), set()
        for phrase in phrases:
            start = len(text[: re.search(rf"\b{phrase}\b", text).start()].split())
            must |= set(range(start, start + len(phrase.split())))
            if phrase in WHOLE:
                rows.append((number, label, start, phrase, True))
        rows += [(number, label, i, w, i in must) for i, w in enumerate(words) if w not in FUNCTION_WORDS]
    return rows


ROWS = [row for row in template_rows() if row[3] not in WHOLE]
#: The same of whole mandatory phrases.
WHOLE_ROWS = [row for row in template_rows() if row[3] in WHOLE]
#: Words that are looked for: those of the index and the first ones of the base phrases.
WORDS = sorted({r[3] for r in ROWS} | {p.split()[0] for p in PHRASES})


def index(spark: SparkSession) -> DataFrame:
    """The template index; a constant of some two hundred rows."""
    return spark.createDataFrame(ROWS + WHOLE_ROWS, "template int, label string, place int, word string, mandatory boolean")


def _starts(words: Column, places: Column, phrase: str) -> Column:
    """Places of ``places`` at which the words of a phrase stand one after the other."""
    def here(i: Column) -> Column:
        found = [F.get(words, i + n) == word for n, word in enumerate(phrase.split())]
        out = found[0]
        for one in found[1:]:
            out = out & one
        return F.coalesce(out, F.lit(False))

    return F.filter(places, here)


def _hits(starts: Column, phrase: str) -> Column:
    """Places of a whole phrase in the form of those of words."""
    return F.transform(starts, lambda i: F.struct(F.lit(phrase).alias("word"), i.alias("at")))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Row key, word count, base results and licence words with their places; no text."""
    rows = docs.select(docs[id_col], F.coalesce(docs[text], F.lit("")).alias("__text"))
    rows = rows.withColumn("__mark", F.xxhash64("__text"))
    rows = rows.withColumn("__words", F.regexp_extract_all(F.translate("__text", UPPER, LOWER), F.lit(WORD)))
    n = F.size("__words")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__places", F.filter(every, lambda i: F.get("__words", i).isin(WORDS)))
    for number, phrase in enumerate(PHRASES):
        rows = rows.withColumn(f"__starts{number}", _starts(F.col("__words"), F.col("__places"), phrase))
    starts = [F.col(f"__starts{number}") for number in range(len(PHRASES))]
    rows = rows.withColumn("__all", F.concat(*starts))
    labels = F.array_compact(F.array(*[F.when(F.size(s) > 0, label) for s, label in zip(starts, PHRASES.values())]))
    return rows.select(
        id_col,
        "__mark",
        n.cast("bigint").alias("n_words"),
        F.size("__all").cast("bigint").alias("n_base"),
        F.array_min("__all").cast("bigint").alias("first_word"),
        F.array_max("__all").cast("bigint").alias("last_word"),
        labels.alias("base"),
        F.concat(
            F.transform("__places", lambda i: F.struct(F.get("__words", i).alias("word"), i.alias("at"))),
            *[_hits(_starts(F.col("__words"), F.col("__places"), phrase), phrase) for phrase in WHOLE],
        ).alias("hits"),
    )


def match(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(key, labels, score)`` of the rows in which some template was verified."""
    spark = scanned.sparkSession
    key = [F.col(id_col).alias("__key"), "__mark"]
    hits = scanned.where(F.size("hits") > 0).select(*key, F.explode("hits").alias("h")).select("__key", "__mark", "h.word", "h.at")
    hits = hits.distinct()
    # One row per licence word: as bounded as the templates.
    frequency = landed(hits.select("__key", "__mark", "word").distinct().groupBy("word").agg(F.count("*").alias("df")), "licence_words")
    n = scanned.select("__mark", id_col).distinct().count()
    rarity = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.coalesce("df", F.lit(0))))
    weight = F.when(F.col("word").isin(WHOLE), 0.0).otherwise(rarity)
    templates = index(spark)
    own = templates.where(~F.col("word").isin(WHOLE)).groupBy("template", "word").agg(F.max("mandatory").alias("must"))
    known = hits.select("__key", "__mark", "word").distinct().join(frequency, "word").join(own, "word")
    first = Window.partitionBy("__key", "__mark", "template").orderBy(F.desc("must"), "df", "word")
    rare = known.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= RARE_WORDS)
    rare = rare.select(F.col("__key").alias("k"), F.col("__mark").alias("m"), F.col("word").alias("w"), F.col("template").alias("t"))
    same = hits["__key"].eqNullSafe(rare["k"]) & (hits["__mark"] == rare["m"]) & (hits["word"] == rare["w"])
    looked_up = hits.join(rare, same).withColumn("template", F.col("t")).drop("k", "m", "w", "t").join(templates, ["template", "word"])
    votes = looked_up.groupBy("__key", "__mark", "template", (F.col("at") - F.col("place")).alias("offset")).agg(
        F.countDistinct("word").alias("votes")
    ).where(F.col("votes") >= MIN_VOTES)
    laid = votes.join(templates, "template").withColumn("at", F.col("offset") + F.col("place")).join(frequency, "word", "left")
    there = hits.select(F.col("__key").alias("k"), F.col("__mark").alias("m"), F.col("word").alias("w"), F.col("at").alias("p"))
    on = laid["__key"].eqNullSafe(there["k"]) & (laid["__mark"] == there["m"]) & (laid["word"] == there["w"]) & (laid["at"] == there["p"])
    checked = laid.join(there, on, "left").withColumn("weight", weight)
    verdict = checked.groupBy("__key", "__mark", "template", "label", "offset").agg(
        F.sum(F.when(F.col("p").isNotNull(), F.col("weight")).otherwise(F.lit(0.0))).alias("found"),
        F.sum("weight").alias("all"),
        F.bool_and(F.col("p").isNotNull() | ~F.col("mandatory")).alias("complete"),
    )
    share = F.when(F.col("all") > 0, F.round(F.col("found") / F.col("all"), 6)).otherwise(F.lit(1.0))
    good = verdict.withColumn("score", share).where(F.col("complete") & (F.col("score") >= MIN_SCORE))
    return good.groupBy("__key", "__mark").agg(F.collect_set("label").alias("found_labels"), F.max("score").alias("score"))


def licences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per document.

    Labels are distinct, sorted and joined by commas (empty without any).  The score is the
    best verified template's share of weight in place, 1 with a base label, else 0.
    """
    scanned = landed(scan(docs, id_col, text), "licence_hits")
    found = match(scanned, id_col)
    on = F.col(id_col).eqNullSafe(F.col("__key")) & (F.col("__mark") == F.col("__found"))
    rows = scanned.drop("hits").join(found.withColumnRenamed("__mark", "__found"), on, "left")
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    own = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return rows.select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("found_labels", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(own, F.coalesce("score", F.lit(0.0))).alias("score"),
    )
