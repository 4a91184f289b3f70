"""Brand selection: the brand's own messages, mentions of it, and their direct neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.functions.arrays import explode_computed
from threadwise.functions.text import clean_key, key_list, lower_string


def is_brand_author(author: Column, brand: str) -> Column:
    return lower_string(author) == F.lit(brand.lower())


def mentions_brand(text: Column, brand: str) -> Column:
    """Literal, case-insensitive ``@brand`` mention."""
    return F.contains(lower_string(text), F.lit("@" + brand.lower()))


def _is_seed(brand: str) -> Column:
    return F.coalesce(
        is_brand_author(F.col("author_id"), brand) | mentions_brand(F.col("text"), brand),
        F.lit(False),
    )


def seed_ids(tweets: DataFrame, brand: str) -> DataFrame:
    """Ids written by the brand or mentioning it."""
    return tweets.where(_is_seed(brand)).select(F.col("tweet_id").cast("string")).distinct()


def seed_rows(tweets: DataFrame, brand: str) -> DataFrame:
    """Every row whose id is a seed id, copies of a seed id included."""
    keyed = tweets.withColumn("tweet_id", F.col("tweet_id").cast("string"))
    return keyed.join(seed_ids(tweets, brand), "tweet_id", "left_semi")


def parent_ids(seeds: DataFrame) -> DataFrame:
    """Ids the seed rows reply to."""
    return (
        seeds.where(F.col("in_response_to_tweet_id").isNotNull())
        .select(clean_key(F.col("in_response_to_tweet_id")).alias("tweet_id"))
        .distinct()
    )


def child_ids(seeds: DataFrame) -> DataFrame:
    """Ids listed as replies to the seed rows."""
    return explode_computed(
        seeds, key_list(F.col("response_tweet_id")), "tweet_id"
    ).distinct()


def relevant_ids(tweets: DataFrame, brand: str) -> DataFrame:
    """Seed ids plus one hop up and one hop down, collected in one pass over the seed rows."""
    parent = clean_key(F.col("in_response_to_tweet_id"))
    children = F.coalesce(key_list(F.col("response_tweet_id")), F.array())
    ids = F.concat(F.array_compact(F.array("tweet_id", parent)), children)
    return explode_computed(seed_rows(tweets, brand), ids, "tweet_id").distinct()


def keep_ids(tweets: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in ``ids``."""
    keyed = tweets.withColumn("tweet_id", F.col("tweet_id").cast("string"))
    return keyed.join(ids, "tweet_id", "left_semi")


def select_brand(tweets: DataFrame, brand: str) -> DataFrame:
    """The brand's messages with the direct context needed to rebuild threads."""
    return keep_ids(tweets, relevant_ids(tweets, brand))


def dataset_profile(tweets: DataFrame, brand: str) -> DataFrame:
    """One row: size, columns and how much of the export concerns the brand."""
    by_brand = F.coalesce(is_brand_author(F.col("author_id"), brand), F.lit(False))
    mention = F.coalesce(mentions_brand(F.col("text"), brand), F.lit(False))
    return tweets.agg(
        F.count("*").alias("total_tweets"),
        F.lit(",".join(tweets.columns)).alias("column_names"),
        F.count_if(by_brand).alias("brand_outbound"),
        F.count_if(mention).alias("brand_mentions"),
        F.count_distinct(F.when(by_brand | mention, F.col("tweet_id"))).alias("brand_tweets"),
    )
