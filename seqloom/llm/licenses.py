"""License notices by diagonal voting, in DataFrame operations alone.

Every run of three words of a text is hashed and joined to the places where known notices have
it. A hit at word p of the text and word o of a notice votes for the diagonal p - o; the votes of
a diagonal are one place where the notice may stand, neighbouring diagonals are one place with
words put in or left out, and a place counts if the notice's own words that it covers, compared
as words, are enough of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a gram.
K = 3
#: How far apart diagonals may lie that are one place, and by how much a place may be longer than what
#: it covers of the notice.
SLACK, DRIFT = 2, 6
#: What a place must cover of a notice: this share, or so many words of a long one.
SHARE, ENOUGH = 0.8, 24

# Phrases that count wherever their words stand in a row.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# Published notices, as words. The three words from a word marked ! on tell a notice
# from its kin: a place must have them.
NOTICES = [
    ("mit", "released under !the mit license"),
    ("mit", "licensed under !the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the !apache !license version 2 0"),
    ("apache-2", "licensed under the !apache !license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the !gnu general public !license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the !gnu general public license as published by the free software foundation either !version 3 of the license or at your option any later version"),
    ("gpl-2", "licensed under the !gnu general public !license version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the !gnu general public license as published by the free software foundation either !version 2 of the license or at your option any later version"),
    ("lgpl-3", "licensed under the !gnu lesser general public !license version 3"),
    ("lgpl-2.1", "licensed under the !gnu lesser general public license !version 2 1"),
    ("agpl-3", "licensed under the !gnu affero general public !license version 3"),
    ("bsd", "licensed under !the bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the !mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under !cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons !attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under !cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons !attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under !cc by 4 0"),
    ("cc-by", "licensed under a creative commons !attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

GRAM = "name int, label string, base boolean, at int, size int, must boolean, g0 string, g1 string, g2 string, more string"


def gram_rows(notices: list[tuple[str, str]] = NOTICES) -> list[tuple]:
    """A row for each gram of each notice, and one for each base phrase: some hundreds, by the lists above."""
    rows = [(-1 - n, label, True, 0, len(p.split()), True, *p.split()[:K], " ".join(p.split()[K:])) for n, (label, p) in enumerate(BASE)]
    for n, (label, text) in enumerate(notices):
        words = text.replace("!", "").split()
        marks = [w.startswith("!") for w in text.split()]
        rows += [(n, label, False, i, len(words), marks[i], *words[i : i + K], "") for i in range(len(words) - K + 1)]
    return rows


def words(text: Column) -> Column:
    """A-Z lower-cased; runs of digits, letters a to z and all that isn't ASCII."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def scanned(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each input row.

    n_base counts the places of base phrases, first_word and last_word are their smallest and
    largest start (null without one); labels adds what the voting finds; both lists are distinct,
    sorted and joined by commas, empty without any. score is the largest share of a notice that a place
    covers, 1 for a base phrase, 0 without either. A null text is empty and has no words; repeated
    rows and null ids are rows like others; other columns are ignored; an empty table gives an
    empty result. A text's hits stay with its row: equal texts never meet.
    """
    return summed(spans(docs, id_column=id_column, text_column=text_column, notices=notices))


def spans(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(row, doc_id, n_words, name, label, base, start, stop, covered, size): the places found; a row of docs
    without any has rows without a name."""
    spark = docs.sparkSession
    grams = spark.createDataFrame(gram_rows(notices), GRAM).withColumn("hash", F.xxhash64("g0", "g1", "g2"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), words(F.col(text_column)).alias("w"))
    n = F.size("w")
    after = lambda k: F.slice("w", k + 1, n)
    # Side by side: each word with those behind it, null beyond the end.
    beside = F.arrays_zip(F.col("w").alias("w0"), *[after(k).alias(f"w{k}") for k in (1, 2, 3)])
    each = rows.select("row", "doc_id", n.cast("long").alias("n_words"), F.posexplode_outer(beside).alias("pos", "z"))
    each = each.select("row", "doc_id", "n_words", "pos", F.xxhash64("z.w0", "z.w1", "z.w2").alias("hash"), *[F.col(f"z.w{k}") for k in range(4)])
    same = (each.hash == grams.hash) & (each.w0 == grams.g0) & (each.w1 == grams.g1) & (each.w2 == grams.g2) & ((grams.more == "") | (each.w3 == grams.more))
    # The grams of fixed notices, some tens of kilobytes whatever the input.
    hits = each.join(F.broadcast(grams.drop("must")), same, "left").where(F.coalesce(F.col("pos"), F.lit(0)).eqNullSafe(0) | F.col("name").isNotNull())
    # All that follows goes by row: one shuffle of the hits.
    hits = hits.select("row", "doc_id", "n_words", "name", "label", "base", "size", "at", "pos").repartition("row")
    key = ["row", "doc_id", "n_words", "name", "label", "base", "size"]
    votes = hits.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.min("pos").alias("start"), (F.max("pos") + K).alias("stop"), F.collect_set("at").alias("ats"))
    by = Window.partitionBy("row", "name").orderBy("diagonal")
    fresh = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by) > SLACK), F.lit(True))
    merged = votes.withColumn("place", F.sum(fresh.cast("int")).over(by))
    places = merged.groupBy(*key, "place").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    # Words of the notice that some hit gram holds: each gram's words were compared as words above.
    reach = F.array_distinct(F.flatten(F.transform("ats", lambda o: F.sequence(o, o + K - 1))))
    covered = F.when(F.col("base"), F.col("size")).otherwise(F.size(reach))
    needs = spark.createDataFrame([(n, [r[3] for r in gram_rows(notices) if r[0] == n and r[5]]) for n in range(len(notices))], "needed int, musts array<int>")
    verified = places.withColumn("covered", covered).join(F.broadcast(needs), F.col("name") == F.col("needed"), "left")
    whole = F.size(F.array_except("musts", "ats")) == 0
    straight = F.col("stop") - F.col("start") <= F.array_max("ats") + K - F.array_min("ats") + DRIFT
    fine = F.col("base") | (whole & straight & ((F.col("covered") >= F.ceil(F.col("size") * SHARE)) | (F.col("covered") >= ENOUGH)))
    # A row of docs stays, without a name, also where none of its places is one.
    stop = F.when(F.col("base"), F.col("start") + F.col("size")).otherwise(F.col("stop"))
    columns = {"name": F.col("name"), "label": F.col("label"), "base": F.col("base"), "start": F.col("start").cast("long"), "stop": stop.cast("long"), "covered": F.col("covered"), "size": F.col("size")}
    return verified.select("row", "doc_id", "n_words", *[F.when(fine, c).alias(n) for n, c in columns.items()])


def summed(found: DataFrame) -> DataFrame:
    """A row for each row of the documents out of its places."""
    base = F.coalesce(F.col("base"), F.lit(False))
    joined = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    per = found.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.coalesce(F.max(F.col("covered") / F.col("size")), F.lit(0.0)).alias("score"),
    )
    return per.drop("row")


def _values(rows: list[tuple]) -> str:
    say = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + ")"


#: The same rows in DuckDB, by the words themselves instead of their hashes.
ORACLE_SQL = f"""
WITH grams AS (SELECT * FROM {_values(gram_rows())} t(name, label, base, "at", size, must, g0, g1, g2, more)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT r, unnest(w) AS w0, unnest(w[2:] || ['']) AS w1, unnest(w[3:] || ['', '']) AS w2, unnest(w[4:] || ['', '', '']) AS w3, unnest(range(len(w))) AS pos FROM d),
hits AS (SELECT r, name, label, base, size, "at", pos, pos - "at" AS diagonal FROM e JOIN grams ON w0 = g0 AND w1 = g1 AND w2 = g2 AND (more = '' OR more = w3)),
votes AS (SELECT r, name, label, base, size, diagonal, min(pos) AS start, max(pos) + {K} AS stop, list(DISTINCT "at") AS ats FROM hits GROUP BY ALL),
marked AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER w > {SLACK} OR lag(diagonal) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM votes WINDOW w AS (PARTITION BY r, name ORDER BY diagonal)),
merged AS (SELECT *, sum(fresh) OVER (PARTITION BY r, name ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS place FROM marked),
places AS (SELECT r, name, label, base, size, place, min(start) AS start, max(stop) AS stop, list_distinct(flatten(list(ats))) AS ats FROM merged GROUP BY ALL),
checked AS (
  SELECT *, CASE WHEN base THEN size ELSE len(list_distinct(flatten(list_transform(ats, lambda o: [{", ".join(f"o + {k}" for k in range(K))}])))) END AS covered,
         (SELECT count(*) FROM grams g WHERE g.name = places.name AND g.must AND NOT list_contains(places.ats, g."at")) AS lacking
  FROM places),
fine AS (SELECT * FROM checked WHERE base OR (lacking = 0 AND stop - start <= list_max(ats) + {K} - list_min(ats) + {DRIFT} AND (covered >= ceil(size * {SHARE}) OR covered >= {ENOUGH})))
SELECT doc_id, len(w)::BIGINT AS n_words, count(CASE WHEN base THEN 1 END) AS n_base,
       min(CASE WHEN base THEN start END)::BIGINT AS first_word, max(CASE WHEN base THEN start END)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(covered::DOUBLE / size), 0.0) AS score
FROM d LEFT JOIN fine USING (r) GROUP BY r, doc_id, w
"""
