"""License scan with a positional rare-token index, in DataFrame functions only.

Licence notices are templates: sequences of words with mandatory phrases. An index holds, for every word
of a template, the templates and positions where it stands. Of every template the mandatory word of highest
inverse document frequency, counted over all files, is looked up wherever it stands in a file; its place gives that of the template,
where all licence words are compared and mandatory phrases checked.
"""

from __future__ import annotations

from pyspark.sql import Column

from ._common import DataFrame, F, SparkSession, Window, let, stored, tables

#: Phrases that count by themselves, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Fixed values: (label, notice, mandatory phrases).
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "binary forms"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0", "this work is dedicated to the public domain under cc0", ["public domain", "cc0"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ["permission is hereby granted", "free of charge"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ["mozilla public license"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
]
#: Share of a notice's weight that must be in place.
LEAST_SHARE = 0.75

_CUT = r"[\x00-/:-@\[-`{-\x7f]+"
_WORD_TEXT = {w for _, n, _ in NOTICES for w in n.split()} | {w for p, _ in PHRASES for w in p.split()}
#: A file without any of these (any case) can't hold a phrase or a notice: each has one in a mandatory or base phrase.
_HINTS = ("license", "redistribution", "cc", "public", "hereby", "mozilla", "rights", "unencumbered")
_HINT = "(?i)(?<![a-z0-9])(?:" + "|".join(_HINTS) + ")(?![a-z0-9])"


def _words(t: Column) -> Column:
    return F.filter(F.split(t, _CUT), lambda x: x != "")


def _lower(w: Column) -> Column:
    return F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _phrase_places(w: Column) -> Column:
    """(label, start) of every place of a base phrase. ``w``: lower-cased words."""

    def places(p: list[str], label: str) -> Column:
        def at(x: Column, i: Column) -> Column:
            same = x == p[0]
            for k, word in enumerate(p[1:], 1):
                same = same & F.coalesce(F.get(w, i + k) == word, F.lit(False))
            return F.when(same, F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))

        return F.filter(F.transform(w, at), lambda x: x.isNotNull())

    return F.flatten(F.array(*(places(phrase.split(), label) for phrase, label in PHRASES)))


def _index(spark: SparkSession) -> DataFrame:
    """template, label, word, tpos, needed: postings of the fixed notices, so of a fixed size."""
    rows = []
    for t, (label, notice, phrases) in enumerate(NOTICES):
        words = notice.split()
        needed = set()
        for p in phrases:
            p = p.split()
            s = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            needed.update(range(s, s + len(p)))
        rows += [(t, label, w, i, i in needed, len(needed)) for i, w in enumerate(words)]
    values = ", ".join(f"({t}, '{label}', '{w}', {i}, {str(n).lower()}, {k})" for t, label, w, i, n, k in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS v(template, label, word, tpos, needed, n_needed)")


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per input row.

    Words are lower-cased (A-Z) runs of ASCII letters, digits and other than ASCII characters. ``labels`` has
    those of the notices found besides the base ones, sorted; ``score`` is the best weighted share of a notice
    in place, 1 if a base phrase is there, 0 without either. A null text is empty..
    """
    spark = documents.sparkSession
    t = F.coalesce(F.col("t"), F.lit(""))
    rows = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    vocabulary = sorted(_WORD_TEXT)

    def deep(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(vocabulary), F.struct(x.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
        return F.struct(_phrase_places(w).alias("places"), hits.alias("hits"))

    hinted = t.rlike(_HINT)
    listed = F.array(*(F.lit(w) for w in vocabulary))
    seen = rows.withColumn("w", _words(_lower(t))).select(
        "k",
        F.monotonically_increasing_id().alias("row"),
        F.size("w").cast("long").alias("n_words"),
        F.array_intersect("w", listed).alias("holds"),
        F.when(hinted, let(F.col("w"), deep)).alias("d"),
    )
    seen, _ = stored(seen.select("k", "row", "n_words", "holds", "d.places", "d.hits"), "scanned")
    index = F.broadcast(_index(spark))  # the fixed notices
    hits = seen.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.word", "h.at")
    hits, _ = stored(hits, "licence-words")
    # frequencies count all files, those without a hint too
    files = seen.count()
    df = seen.select(F.explode("holds").alias("word")).groupBy("word").agg(F.count("*").alias("df"))  # at most the words of the notices
    idf, _ = stored(df.select("word", F.log((F.lit(files) + 1) / F.col("df")).alias("idf")), "idf")
    weight = F.broadcast(idf)
    # the rarest mandatory word of each template stands in every file that holds the template
    rarest = Window.partitionBy("template").orderBy(F.desc("idf"), "tpos")
    anchors = index.where("needed").join(weight, "word").withColumn("r", F.row_number().over(rarest)).where("r = 1").select("template", "word", "tpos")
    places = hits.join(F.broadcast(anchors), "word").select("row", "template", (F.col("at") - F.col("tpos")).alias("start")).distinct()
    weights, _ = stored(_index(spark).join(weight, "word", "left").fillna(0.0, ["idf"]).withColumn("idf", F.col("idf") + 0.01), "weights")
    whole = weights.groupBy("template").agg(F.sum("idf").alias("whole"))
    expected = places.join(F.broadcast(weights), "template").select("row", "template", "label", "start", "word", (F.col("start") + F.col("tpos")).alias("at"), "needed", "n_needed", "idf")
    matched = expected.join(hits, ["row", "at", "word"])
    scored = matched.groupBy("row", "template", "start", "label", "n_needed").agg(F.sum("idf").alias("got"), F.count_if("needed").alias("needed"))
    scored = scored.join(F.broadcast(whole), "template").withColumn("share", F.col("got") / F.col("whole"))
    found = scored.where((F.col("needed") == F.col("n_needed")) & (F.col("share") >= LEAST_SHARE))
    by_row = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    out = seen.join(by_row, "row", "left").withColumns({"base": F.coalesce(base, F.array().cast("array<string>")), "more": F.coalesce("more", F.array().cast("array<string>"))})
    at = F.transform("places", lambda x: x["at"])
    return out.select(
        F.col("k").alias(key),
        "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tables(spark, sf_dir, "documents"))
