"""License scan by diagonal voting over word k-grams.

Every k-gram of a text is hashed in place and joined with the k-gram positions of a fixed set of licence
templates. A hit votes for the diagonal (place in the text minus place in the template), so an unbroken
copy of a template puts all its votes on one diagonal; diagonals that differ by a few words (an insertion
or a deletion) are merged, lone votes included. A merged run becomes a span when the template's words it covers reach the
template's share; short templates need all their words, phrases need them in a row. Each vote is verified
by comparing the words themselves.

All of it is DataFrame functions. The template table is fixed text of known size, so it is broadcast; only
hits are shuffled, by document, template and diagonal, and are added up before that.

Defined cases: a null or empty text has no words, no labels, score 0 and null places; null ids stay null;
repeated rows get equal results each (votes are counted by row, not by id); ties don't arise, for every label
and place counts; texts of any length are scanned whole; an empty table gives an empty
result; only the id and text columns are read, so further columns can have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionframe.llm._common import table, written

K = 2
#: Diagonals up to so many words apart belong to one run; a run ends at a gap of more than REACH words.
DRIFT, REACH = 4, 24
SHARE = 0.6
#: Templates of fewer words need all of them.
SHORT = 10

#: Phrases that name a licence wherever their words stand in a row.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Fixed wording of licence notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("boost", "distributed under the boost software license version 1 0"),
)


def words_of(text: Column) -> Column:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text: ASCII letters and digits and all beyond ASCII.

    ``lower`` also changes letters beyond ASCII. All of them are word characters before and after, so
    words keep their number and places, and none turns into a letter of a phrase.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _template_rows() -> list[tuple[int, str, int, list[str], bool]]:
    """(template, label, words a span must cover, words, whether it is a phrase)."""
    rows = [(label, text.split(), True) for text, label in PHRASES] + [(label, text.split(), False) for label, text in TEMPLATES]
    return [(i, label, len(w) if len(w) < SHORT else round(SHARE * len(w)), w, phrase) for i, (label, w, phrase) in enumerate(rows)]


def _grams(words: Column) -> Column:
    """xxhash64 of every two words in a row."""
    pairs = F.zip_with(words, F.slice(words, K, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.slice(pairs, 1, F.greatest(F.size(words) - (K - 1), F.lit(0)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans): (row, doc_id, n_words) and (row, template, label, phrase, first_word, last_word, covered, size).

    ``first_word`` and ``last_word`` of a span are its first and last word, counted from 0.
    """
    spark = docs.sparkSession
    templates = spark.createDataFrame(_template_rows(), "template int, label string, need int, words array<string>, phrase boolean").withColumn("size", F.size("words"))
    grams = templates.select("template", "size", "phrase", "words", F.posexplode(_grams(F.col("words"))).alias("t_pos", "gram"))
    grams = grams.withColumn("t_words", F.slice("words", F.col("t_pos") + 1, K)).drop("words")
    wanted = [r["gram"] for r in grams.select("gram").distinct().orderBy("gram").collect()]  # of the fixed templates
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), words_of(F.col(f"`{text_col}`")).alias("w"))
    hashed = named.select("row", "doc_id", "w", F.size("w").cast("long").alias("n_words"), _grams(F.col("w")).alias("g"))
    # Grams of no template would find no partner in the join; they are left inside the row.
    hits = F.filter(F.transform("g", lambda x, i: F.when(x.isin(wanted), F.struct(i.alias("at"), x.alias("gram"), F.slice("w", i + 1, K).alias("pair")))), lambda x: x.isNotNull())
    some = F.when(F.arrays_overlap("g", F.array(*map(F.lit, wanted))), hits)
    kept = written(hashed.select("row", "doc_id", "n_words", some.alias("hits")), "license-hits")
    votes = kept.select("row", F.inline("hits")).join(F.broadcast(grams), "gram").where(F.col("pair") == F.col("t_words"))
    # A diagonal holds one vote for each place of its template, so its set is bounded.
    lines = votes.groupBy("row", "template", "size", "phrase", (F.col("at") - F.col("t_pos")).alias("diagonal")).agg(F.sort_array(F.collect_set("t_pos")).alias("t"))
    lines = lines.withColumns({"first": F.col("diagonal") + F.get("t", F.lit(0)), "last": F.col("diagonal") + F.element_at("t", -1) + (K - 1)})
    whole = lines.where(F.col("phrase") & (F.size("t") == F.col("size") - (K - 1))).select("row", "template", F.col("first").alias("first_word"), F.col("last").alias("last_word"), F.col("size").alias("covered"))
    # Neighbouring diagonals of a longer template are one band; in a band, a run lasts while the gaps stay small. A gram
    # that the template repeats votes for a far diagonal as well, which is then a band of its own and parts no run.
    across = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(across) > DRIFT, F.lit(True)).cast("int")
    banded = lines.where(~F.col("phrase")).withColumn("far", far).withColumn("band", F.sum("far").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("row", "template", "band").orderBy("first", "diagonal")
    gap = F.col("first") - F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = banded.withColumn("fresh", F.coalesce(gap > REACH, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("row", "template", "band", "run").agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.flatten(F.collect_list("t")).alias("t"))
    merged = merged.withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform("t", lambda x: F.sequence(x, x + (K - 1)))))))
    merged = merged.join(F.broadcast(templates.select("template", "need")), "template").where("covered >= need").select("row", "template", "first_word", "last_word", "covered")
    spans = whole.unionByName(merged).join(F.broadcast(templates.select("template", "label", "phrase", "size")), "template")
    return kept.select("row", "doc_id", "n_words"), spans


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places, labels and score (the best share of a template that stands in the text) of every row of ``documents``."""
    rows, spans = scan(table(spark, sf_dir, "documents"))
    base = F.when(F.col("phrase"), F.col("first_word")).cast("long")
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    found = spans.groupBy("row").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        names(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"), F.max(F.col("covered") / F.col("size")).alias("score"),
    )
    out = rows.join(found, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")), F.coalesce("score", F.lit(0.0)).alias("score"))


QUERIES = {"op10_license_scan": op10_license_scan}


def _oracle() -> str:
    """The scan in SQL; words are compared themselves, so no hash is needed."""
    rows = ", ".join(f"({i}, '{label}', {need}, [{', '.join(f"'{x}'" for x in w)}], {str(phrase).lower()})" for i, label, need, w, phrase in _template_rows())
    return rf"""
        WITH t(template, label, need, words, phrase) AS (VALUES {rows}),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        di AS (SELECT r, w, unnest(range(1, len(w))) AS i FROM d),
        ti AS (SELECT *, unnest(range(1, len(words))) AS j FROM t),
        v AS (SELECT DISTINCT r, template, len(words) AS size, phrase, i - j AS diagonal, j - 1 AS p FROM di JOIN ti ON w[i] = words[j] AND w[i + 1] = words[j + 1]),
        l AS (SELECT r, template, size, phrase, diagonal, diagonal + min(p) AS a, diagonal + max(p) + 1 AS b, list(p) AS ps FROM v GROUP BY r, template, size, phrase, diagonal),
        whole AS (SELECT r, template, a, size AS covered FROM l WHERE phrase AND len(ps) = size - 1),
        f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER x <= {DRIFT} THEN 0 ELSE 1 END AS far FROM l WHERE NOT phrase WINDOW x AS (PARTITION BY r, template ORDER BY diagonal)),
        g AS (SELECT *, sum(far) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS band FROM f),
        h AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY r, template, band ORDER BY a, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {REACH} THEN 0 ELSE 1 END AS fresh FROM g),
        k AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template, band ORDER BY a, diagonal ROWS UNBOUNDED PRECEDING) AS run FROM h),
        o AS (SELECT r, template, band, run, list_concat(ps, list_transform(ps, lambda q: q + 1)) AS qs FROM k),
        m AS (SELECT r, template, band, run, len(list_distinct(flatten(list(qs)))) AS covered FROM o GROUP BY r, template, band, run),
        spans AS (SELECT r, label, phrase, a, covered / len(words) AS share FROM whole JOIN t USING (template)
                  UNION ALL SELECT r, label, phrase, NULL, covered / len(words) FROM m JOIN t USING (template) WHERE covered >= need),
        s AS (SELECT r, count(a) AS n, min(a) AS a, max(a) AS b, array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE phrase))), ',') AS base,
                     array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score FROM spans GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
               coalesce(base, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN s USING (r)"""


ORACLE = {"op10_license_scan": _oracle()}
