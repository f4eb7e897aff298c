r"""Find licences by a positional index of rare licence words, with DataFrame functions only.

Templates are short licence texts. Their words, without glue words, form the vocabulary. One pass over the texts
stores the positional index: a row (document, position, word) for each vocabulary word, and one row for the
start of each document. The index gives each word's document frequency over all documents, hence its IDF.

A file is looked up by its rarest licence words: a word names the templates of which it is among the rarest words, so many of
them that together they hold more than the mass a template may lack. A place that fits holds at least one of these, so no
template is missed, whichever of its words is altered; a base phrase needs all its words, so its rarest one is enough. Only
postings of the templates named are intersected. A posting at position p of a word that stands at offset o of a template votes for the template starting at p - o; votes are counted per
(document, template, start), which intersects the postings by relative position. A template fits with all of its
words (base phrases, where the words must be consecutive) or with MASS of its IDF mass, and then only if its
mandatory key phrases fit too. The score is the largest share of a template's mass in one place.

Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased, counted from 0. Null and empty texts
have no words, no places and score 0. Repeated rows and repeated ids are judged row by row. Columns of the
input other than key and text are not looked at. Texts are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.llm.common import Scratch, ascii_lower

#: A run of characters that do not belong to words, before lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GLUE = frozenset("a an and any are as at be but for from in is it of on or that the this to was with you your".split())
MASS = 0.8


@dataclass(frozen=True)
class Template:
    """`base` templates count as places; `keys` name templates that must fit in the same document."""

    name: str
    label: str
    text: str
    base: bool = False
    keys: tuple[str, ...] = ()

    def postings(self) -> list[tuple[int, str]]:
        words = self.text.split()
        return [(i, w) for i, w in enumerate(words) if self.base or w not in GLUE]


TEMPLATES = (
    Template("gpl phrase", "gpl", "gnu general public license", base=True),
    Template("apache phrase", "apache", "apache license", base=True),
    Template("cc by phrase", "cc-by", "cc by", base=True),
    Template("mit phrase", "mit", "mit license", base=True),
    Template("gpl version 3", "gpl-3", "gnu general public license version 3", keys=("gpl phrase",)),
    Template("gpl version 2", "gpl-2", "gnu general public license version 2", keys=("gpl phrase",)),
    Template("lesser gpl", "lgpl", "gnu lesser general public license"),
    Template("affero gpl", "agpl", "gnu affero general public license"),
    Template("apache version 2", "apache-2", "apache license version 2 0", keys=("apache phrase",)),
    Template("cc by nc", "cc-by-nc", "cc by nc", keys=("cc by phrase",)),
    Template("cc by sa", "cc-by-sa", "cc by sa", keys=("cc by phrase",)),
    Template("cc by nd", "cc-by-nd", "cc by nd", keys=("cc by phrase",)),
    Template("cc zero", "cc0", "cc0 1 0 universal"),
    Template("mit grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("isc grant", "isc", "permission to use copy modify and or distribute this software for any purpose"),
    Template("bsd grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mozilla", "mpl", "mozilla public license"),
    Template("public domain", "unlicense", "free and unencumbered software released into the public domain"),
)


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for _, w in t.postings()})


def positional_index(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, key, n_words, pos, word) of vocabulary words; pos -1 marks the start of a document."""
    cut = docs.select(
        F.col(key).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
        F.split(F.coalesce(F.col(text), F.lit("")), GAPS).alias("cut"),
    )
    ahead = F.when(F.col("cut")[0] == "", 1).otherwise(0)
    behind = F.when((F.size("cut") > 1) & (F.element_at("cut", -1) == ""), 1).otherwise(0)
    placed = cut.select("_key", "_row", (F.size("cut") - ahead - behind).cast("bigint").alias("n_words"), ahead.alias("ahead"), F.posexplode("cut").alias("at", "raw"))
    known = F.lower("raw").isin(words) & ascii_lower("raw").isin(words)
    return placed.filter((F.col("at") == 0) | known).select(
        "_key", "_row", "n_words", "at", (F.col("at") - F.col("ahead")).cast("bigint").alias("pos"), F.when(known, ascii_lower("raw")).alias("word")
    )


def idf_of(index: DataFrame, words: list[str]) -> dict[str, float]:
    """IDF of each vocabulary word over all documents. One row per word comes back."""
    n = index.filter("at = 0").count()
    seen = index.filter("word is not null").select("_row", "word").distinct().groupBy("word").count()
    df = {r["word"]: r["count"] for r in seen.collect()}
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in words}


def template_postings(idf: dict[str, float], templates: tuple[Template, ...]) -> list[tuple]:
    """(word, template, offset, mass, names, need): the small side of the lookup; `names` marks words that name the template."""
    rows = []
    for t in templates:
        posts = t.postings()
        whole = sum(idf[w] for _, w in posts)
        before, naming = 0.0, set()
        for word in sorted({w for _, w in posts}, key=lambda w: (idf[w], w), reverse=True):
            if not naming or (not t.base and round(before, 9) <= round(1 - MASS, 9)):
                naming.add(word)
            before += sum(idf[w] / whole for _, w in posts if w == word)
        rows += [(w, t.name, o, idf[w] / whole, w in naming, len(posts)) for o, w in posts]
    return rows


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "licences")
    words = vocabulary(templates)
    index = scratch(positional_index(docs, words, key, text), "index")
    lookup = spark.createDataFrame(
        template_postings(idf_of(index, words), templates),
        "word string, template string, offset bigint, mass double, names boolean, need bigint",
    )
    known = index.filter("word is not null").select("_row", "pos", "word")
    naming = lookup.filter("names").select("word", "template").distinct()
    # The files' rarest licence words name the templates to look at.
    wanted = known.select("_row", "word").join(F.broadcast(naming), "word").select("_row", "template").distinct()
    votes = (
        known.join(F.broadcast(lookup.drop("names")), "word")
        .join(wanted, ["_row", "template"], "left_semi")
        .groupBy("_row", "template", (F.col("pos") - F.col("offset")).alias("start"))
        .agg(F.count(F.lit(1)).alias("found"), F.sum("mass").alias("share"), F.first("need").alias("need"))
    )
    about = spark.createDataFrame(
        [(t.name, t.label, t.base, list(t.keys)) for t in templates],
        "template string, label string, base boolean, keys array<string>",
    )
    best = (
        votes.join(F.broadcast(about), "template")
        .withColumn("fits", F.when(F.col("base"), F.col("found") == F.col("need")).otherwise(F.col("share") >= MASS))
        .groupBy("_row")
        .agg(
            F.count(F.when(F.col("fits") & F.col("base"), 1)).alias("n_base"),
            F.min(F.when(F.col("fits") & F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("fits") & F.col("base"), F.col("start"))).alias("last_word"),
            F.collect_set(F.when(F.col("fits"), F.struct("template", "label", "base", "keys"))).alias("fitted"),
            F.max(F.least(F.round("share", 6), F.lit(1.0))).alias("score"),
        )
    )
    names = F.transform("fitted", lambda t: t["template"])
    sound = F.filter("fitted", lambda t: F.size(F.array_except(t["keys"], F.col("names"))) == 0)
    label_list = lambda fitted: F.array_join(F.array_sort(F.array_distinct(F.transform(fitted, lambda t: t["label"]))), ",")
    best = best.withColumn("names", names).select(
        "_row",
        "n_base",
        "first_word",
        "last_word",
        label_list(F.filter("fitted", lambda t: t["base"])).alias("base_labels"),
        label_list(sound).alias("labels"),
        "score",
    )
    return scratch.finish(
        index.filter("at = 0")
        .select(F.col("_key").alias(key), "_row", "n_words")
        .join(best, "_row", "left")
        .select(
            key,
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
            "first_word",
            "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
