"""Raw export to conversations: select a brand, rebuild its threads, write the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadwise.operators.selection import select_brand
from threadwise.operators.threads import (
    conversation_records,
    dialogue_parts,
    flat_conversations,
    prep_summary,
    turn_parts,
    unique_tweets,
    walk_threads,
)
from threadwise.session import cut_lineage
from threadwise.sources.tables import in_file_order, read_tweets, write_flat, write_nested


def brand_turns(tweets: DataFrame, brand: str, entities: str = "html5") -> DataFrame:
    """The brand's threads, one row per turn."""
    return walk_threads(unique_tweets(select_brand(tweets, brand), entities), brand)


def prepare(
    spark: SparkSession, source: str, output: str, brand: str, entities: str = "html5",
    fmt: str = "parquet",
) -> DataFrame:
    """Read the export at ``source``, write conversations below ``output``, return the summary.

    ``conversations`` has one row per conversation with its whole dialogue,
    ``dialogues`` the text of every dialogue in parts, ``conversations_nested`` the turns in parts;
    the files of the last two are in the order of threads and parts.
    """
    # Selection reads the export several times; its files are parsed once.
    tweets = cut_lineage(read_tweets(spark, source))
    turns = cut_lineage(brand_turns(tweets, brand, entities))
    write_flat(flat_conversations(turns, brand, entities), f"{output}/conversations", fmt)
    parts = cut_lineage(dialogue_parts(turns, brand))
    write_flat(in_file_order(parts, "root_tweet_id", "dialogue_part"), f"{output}/dialogues", fmt)
    nested = cut_lineage(turn_parts(turns))
    write_nested(in_file_order(nested, "root_tweet_id", "part"), f"{output}/conversations_nested")
    return prep_summary(conversation_records(turns, brand, entities))
