"""Searches answered from an index over the distinct statement texts.

The index holds each distinct text once, in lower case, with the number of its statements, and the places of its grams:
runs of one, two and three characters. Texts are numbered in shards of at most SHARD; postings are one list of places for each
gram and shard. A search of up to three characters is a gram itself, and its counts are stored. A longer one looks up its
grams' counts, takes the few rarest, intersects their lists, and looks only at the texts left.

No list is longer than a shard, so a common gram's postings stay spread. Postings and texts are small on disk for what they
are in memory, so their joins are never left to broadcasts by size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.plans.materialize import materialize

#: Longest gram, and grams of a search whose postings are intersected.
GRAM, RAREST = 3, 3
#: Texts of a shard, as a power of two.
SHARD_BITS = 12
#: Bytes of wanted grams that may be sent to every task; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


@dataclass(frozen=True)
class SearchIndex:
    """Stored tables: texts (text_id, text, n), postings (gram, shard, places), sizes (gram, texts, matched)."""

    texts: DataFrame
    postings: DataFrame
    sizes: DataFrame


def grams(text: Column, width: int) -> Column:
    """Distinct runs of `width` characters."""
    last = F.char_length(text) - width + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(width))))


def build_index(events: DataFrame, text: str = "query") -> SearchIndex:
    """Index the statements of a log; null texts cannot be found."""
    counted = events.filter(F.col(text).isNotNull()).groupBy(F.lower(text).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    # The number is stored with its text, so it stays what it is.
    texts = materialize(counted.withColumn("text_id", F.monotonically_increasing_id()), "search-texts")
    every = F.concat(*[grams(F.col("text"), width) for width in range(1, GRAM + 1)])
    shard, place = F.shiftright("text_id", SHARD_BITS), F.col("text_id").bitwiseAND(F.lit((1 << SHARD_BITS) - 1)).cast("int")
    found = texts.select(F.explode(every).alias("gram"), shard.alias("shard"), place.alias("place"), "n")
    lists = found.groupBy("gram", "shard").agg(F.collect_list("place").alias("places"), F.sum("n").alias("n"))
    stored = materialize(lists, "search-postings")
    sums = stored.groupBy("gram").agg(F.sum(F.size("places")).alias("texts"), F.sum("n").alias("matched"))
    return SearchIndex(texts, stored.drop("n"), materialize(sums, "search-sizes"))


def search_index(index: SearchIndex, searches: DataFrame, column: str = "search") -> DataFrame:
    """(search, texts, matched): for each distinct search the texts and the statements that hold it, in any case, spaces kept.

    An empty search is held by every text. Null searches take no part.
    """
    asked = searches.filter(F.col(column).isNotNull()).select(F.col(column).alias("search")).distinct().withColumn("word", F.lower("search"))
    asked = materialize(asked, "search-asked")
    words, sizes = asked.select("word").filter("word <> ''").distinct(), index.sizes.hint("merge")
    length = F.char_length("word")
    short = words.filter(length <= GRAM).join(sizes, F.col("word") == F.col("gram")).select("word", "texts", "matched")
    looked = words.filter(length > GRAM).select("word", F.explode(grams(F.col("word"), GRAM)).alias("gram"))
    sized = looked.join(sizes, "gram", "left").select("word", "gram", F.coalesce("texts", F.lit(0)).alias("size"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("size", "gram"))
    rarest = sized.withColumn("_rank", rank).filter(F.col("_rank") <= RAREST)
    own = Window.partitionBy("word")
    # A search with a gram that no text has is held by none.
    chosen = rarest.withColumns({"_needs": F.count(F.lit(1)).over(own), "_least": F.min("size").over(own)}).filter("_least > 0")
    chosen = materialize(chosen.select("word", "gram", "_needs"), "search-grams")
    size = chosen.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0
    side = F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen.hint("merge")
    met = index.postings.join(side, "gram").groupBy("word", "shard").agg(F.collect_list("places").alias("_lists"), F.first("_needs").alias("_needs"))
    both = F.aggregate(F.slice("_lists", 2, RAREST), F.get("_lists", F.lit(0)), lambda left, more: F.array_intersect(left, more))
    candidates = met.filter(F.size("_lists") == F.col("_needs")).select("word", "shard", F.explode(both).alias("place"))
    candidates = candidates.select("word", (F.shiftleft("shard", SHARD_BITS) + F.col("place")).alias("text_id"))
    held = candidates.join(index.texts.hint("merge"), "text_id").filter(F.contains("text", F.col("word")))
    found = held.groupBy("word").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("matched")).unionByName(short)
    whole = index.texts.agg(F.count(F.lit(1)).alias("_texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    zero = F.lit(0).cast("bigint")
    empty = F.col("word") == ""
    return asked.join(found.hint("merge"), "word", "left").crossJoin(F.broadcast(whole)).select(
        "search",
        F.when(empty, F.col("_texts")).otherwise(F.coalesce("texts", zero)).alias("texts"),
        F.when(empty, F.col("_all")).otherwise(F.coalesce("matched", zero)).alias("matched"),
    )
