"""Thread reconstruction from reply links.

The reply links form a forest. Keeping one next hop per message leaves disjoint paths, and each
message finds the head of its path by pointer doubling: the number of rounds grows with the
logarithm of the longest thread, and no round joins on a repeated key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.functions.arrays import settle
from threadwise.functions.text import clean_key, clean_text, strip_handles
from threadwise.operators.selection import is_brand_author
from threadwise.session import cut_lineage

# Turns of a part; a longer thread is a table of such parts.
TURNS_PER_PART = 128
LINE_SEPARATOR = " | "
# The beginning of a dialogue that travels with its record. A line and its separator have five
# characters at least, so a head of this length never needs more turns than these.
HEAD_CHARS, HEAD_TURNS = 1000, 256


def unique_tweets(tweets: DataFrame, entities: str = "common") -> DataFrame:
    """One cleaned row per id: the last row's values at the first row's position.

    ``ord`` gives file order; a source without one can pass ``struct(created_at, tweet_id)``.
    """
    values = ["author_id", "inbound", "created_at", "text", "parent_id"]
    keyed = tweets.select(
        clean_key(F.col("tweet_id")).alias("tweet_id"),
        F.col("author_id").cast("string").alias("author_id"),
        F.coalesce(F.col("inbound").cast("boolean"), F.lit(False)).alias("inbound"),
        F.col("created_at").cast("string").alias("created_at"),
        F.col("text"),
        F.nullif(clean_key(F.col("in_response_to_tweet_id")), F.lit("")).alias("parent_id"),
        F.col("ord"),
    )
    # max_by keeps one candidate per id and task, so copies of one id never meet in one place.
    last = keyed.groupBy("tweet_id").agg(
        F.max_by(F.struct(*values), F.col("ord")).alias("last"), F.min("ord").alias("ord")
    )
    return last.select(
        "tweet_id",
        "last.author_id",
        "last.inbound",
        "last.created_at",
        clean_text(F.col("last.text"), entities).alias("text"),
        "last.parent_id",
        "ord",
    )


def reply_edges(unique: DataFrame) -> DataFrame:
    """(parent_id, tweet_id, author_id, ord) for every reply whose parent is present."""
    parents = unique.select(F.col("tweet_id").alias("parent_id"))
    return (
        unique.where(F.col("parent_id").isNotNull())
        .select("parent_id", "tweet_id", "author_id", "ord")
        .join(parents, "parent_id", "left_semi")
    )


def thread_roots(unique: DataFrame) -> DataFrame:
    """Inbound messages that reply to nothing in the table."""
    parents = unique.select(F.col("tweet_id").alias("parent_id"))
    return unique.where("inbound").join(parents, "parent_id", "left_anti").select("tweet_id")


def next_hops(unique: DataFrame, brand: str) -> DataFrame:
    """(tweet_id, next_id): the first brand reply in file order, else the first reply."""
    order = F.struct(
        (~F.coalesce(is_brand_author(F.col("author_id"), brand), F.lit(False))).alias("other"),
        "ord",
    )
    return (
        reply_edges(unique)
        .groupBy(F.col("parent_id").alias("tweet_id"))
        .agg(F.min_by("tweet_id", order).alias("next_id"))
    )


def path_positions(nodes: DataFrame, hops: DataFrame) -> DataFrame:
    """(head_id, tweet_id, turn_index) for every node on a path that has a beginning.

    ``hops`` gives each node at most one successor and at most one predecessor. Nodes on closed
    loops have no head and are left out.
    """
    before = hops.select(
        F.col("next_id").alias("tweet_id"), F.col("tweet_id").alias("jump_id")
    )
    # jump_id is the node `steps` places ahead of tweet_id; null means tweet_id heads its path.
    state = nodes.select("tweet_id").join(before, "tweet_id", "left").select(
        "tweet_id",
        F.coalesce("jump_id", "tweet_id").alias("head_id"),
        F.when(F.col("jump_id").isNull(), 0).otherwise(1).cast("long").alias("steps"),
        F.col("jump_id").isNull().alias("done"),
    )
    state = cut_lineage(state)
    finished = [state.where("done")]
    open_nodes = cut_lineage(state.where("NOT done"))
    left = open_nodes.count()
    while left:
        ahead = open_nodes
        for part in finished:
            ahead = ahead.unionByName(part)
        ahead = ahead.select(
            F.col("tweet_id").alias("head_id"),
            F.col("head_id").alias("next_head"),
            F.col("steps").alias("more"),
            F.col("done").alias("next_done"),
        )
        # Open nodes are all the same distance from their target, so targets never repeat.
        moved = cut_lineage(
            open_nodes.join(ahead, "head_id").select(
                "tweet_id",
                F.col("next_head").alias("head_id"),
                (F.col("steps") + F.col("more")).alias("steps"),
                F.col("next_done").alias("done"),
            )
        )
        # A round writes only the nodes that moved; finished ones are kept where they are.
        finished.append(moved.where("done"))
        open_nodes = moved.where("NOT done")
        before_round, left = left, open_nodes.count()
        if left == before_round:  # only closed loops remain
            break
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    return result.select("head_id", "tweet_id", F.col("steps").alias("turn_index"))


def walk_threads(unique: DataFrame, brand: str) -> DataFrame:
    """One row per turn: root_tweet_id, turn_index and the message's own columns."""
    unique = cut_lineage(unique)
    positions = path_positions(unique, next_hops(unique, brand))
    roots = thread_roots(unique).withColumnRenamed("tweet_id", "root_tweet_id")
    return (
        positions.withColumnRenamed("head_id", "root_tweet_id")
        .join(roots, "root_tweet_id", "left_semi")
        .join(unique, "tweet_id")
        .select(
            "root_tweet_id",
            F.col("turn_index").cast("int").alias("turn_index"),
            "tweet_id",
            "author_id",
            "inbound",
            "text",
            "created_at",
        )
    )


def first_brand_reply(brand: str) -> Column:
    """Aggregate: text of the first brand-authored turn after the root."""
    is_reply = (F.col("turn_index") > 0) & is_brand_author(F.col("author_id"), brand)
    return F.min_by(F.when(is_reply, F.col("text")), F.when(is_reply, F.col("turn_index")))


def conversation_records(turns: DataFrame, brand: str, entities: str = "common") -> DataFrame:
    """One row per conversation; every aggregate keeps bounded state."""
    is_root = F.col("turn_index") == 0
    records = turns.groupBy("root_tweet_id").agg(
        F.max(F.when(is_root, F.col("author_id"))).alias("customer_id"),
        F.count("*").cast("int").alias("num_turns"),
        F.max(F.when(is_root, F.col("text"))).alias("root_text"),
        first_brand_reply(brand).alias("first_support_reply"),
    )
    queried = records.withColumn("initial_query", strip_handles(F.col("root_text"), entities))
    return settle(queried, "initial_query").select(
        F.concat(F.lit("conv_"), "root_tweet_id").alias("conversation_id"),
        "root_tweet_id",
        "customer_id",
        "num_turns",
        "initial_query",
        "first_support_reply",
        F.col("first_support_reply").isNotNull().alias("has_support_reply"),
    )


def dialogue_line(brand_label: str) -> Column:
    """``"Role: text"`` of a turn."""
    role = F.when(F.col("inbound"), F.lit("Customer")).otherwise(F.lit(brand_label))
    return F.concat(role, F.lit(": "), F.coalesce("text", F.lit("")))


def part_of(turns_per_part: int) -> Column:
    """The part of its thread that a turn belongs to, from 0."""
    return F.floor(F.col("turn_index") / turns_per_part).cast("int")


def dialogue_parts(
    turns: DataFrame, brand_label: str, turns_per_part: int = TURNS_PER_PART
) -> DataFrame:
    """(root_tweet_id, dialogue_part, dialogue): the lines of a part's turns joined by `` | ``.

    The parts of a thread in their order, joined in the same way, are the whole dialogue. No value
    holds more than ``turns_per_part`` turns, however long a thread is.
    """
    line = F.struct("turn_index", dialogue_line(brand_label).alias("line"))
    return (
        turns.groupBy("root_tweet_id", part_of(turns_per_part).alias("dialogue_part"))
        .agg(F.sort_array(F.collect_list(line)).alias("lines"))
        .select(
            "root_tweet_id",
            "dialogue_part",
            F.array_join(F.col("lines.line"), LINE_SEPARATOR).alias("dialogue"),
        )
    )


def dialogues(
    turns: DataFrame, brand_label: str, turns_per_part: int = TURNS_PER_PART
) -> DataFrame:
    """(root_tweet_id, full_dialogue): the lines of all turns joined by `` | ``, one row per thread.

    Turns are sorted in parts first, so only finished parts of a long thread meet.
    """
    parts = F.sort_array(F.collect_list(F.struct("dialogue_part", "dialogue")))
    return (
        dialogue_parts(turns, brand_label, turns_per_part)
        .groupBy("root_tweet_id")
        .agg(parts.alias("parts"))
        .select(
            "root_tweet_id",
            F.array_join(F.col("parts.dialogue"), LINE_SEPARATOR).alias("full_dialogue"),
        )
    )


def turn_parts(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conversation_id, root_tweet_id, part, turns): the turns of each part as an array, in order."""
    turn = F.struct("turn_index", "tweet_id", "author_id", "inbound", "text", "created_at")
    return (
        turns.groupBy("root_tweet_id", part_of(turns_per_part).alias("part"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select(
            F.concat(F.lit("conv_"), "root_tweet_id").alias("conversation_id"),
            "root_tweet_id",
            "part",
            "turns",
        )
    )


def dialogue_heads(turns: DataFrame, brand_label: str) -> DataFrame:
    """(root_tweet_id, dialogue_head, dialogue_chars): how a dialogue begins, and its whole length.

    Only the first turns of a thread are held together, each cut to the length of a head, so the
    state per thread is bounded.
    """
    line = dialogue_line(brand_label)
    early = F.col("turn_index") < HEAD_TURNS
    head = F.struct("turn_index", F.substring(line, 1, HEAD_CHARS).alias("line"))
    return (
        turns.groupBy("root_tweet_id")
        .agg(
            F.sort_array(F.collect_list(F.when(early, head))).alias("first"),
            F.sum(F.length(line).cast("long") + len(LINE_SEPARATOR)).alias("chars"),
        )
        .select(
            "root_tweet_id",
            F.substring(F.array_join("first.line", LINE_SEPARATOR), 1, HEAD_CHARS).alias(
                "dialogue_head"
            ),
            (F.col("chars") - len(LINE_SEPARATOR)).alias("dialogue_chars"),
        )
    )


def flat_conversations(turns: DataFrame, brand: str, entities: str = "common") -> DataFrame:
    """Conversation records with their whole dialogue, its beginning and its length."""
    records = conversation_records(turns, brand, entities)
    whole = F.col("full_dialogue")
    return records.join(dialogues(turns, brand), "root_tweet_id").select(
        *records.columns,
        "full_dialogue",
        F.substring(whole, 1, HEAD_CHARS).alias("dialogue_head"),
        F.length(whole).cast("long").alias("dialogue_chars"),
    )


def prep_summary(conversations: DataFrame) -> DataFrame:
    """Conversation count, count with a reply, mean number of turns."""
    return conversations.agg(
        F.count("*").alias("conversations"),
        F.count_if("has_support_reply").alias("with_reply"),
        F.coalesce(F.avg("num_turns"), F.lit(0.0)).alias("mean_turns"),
    )
