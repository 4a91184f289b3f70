import random

import pytest
from pyspark.sql import functions as F

from threadwise.operators import selection, threads
from threadwise.sources import tables

BRAND = "Desk"
SCHEMA = (
    "tweet_id string, author_id string, inbound boolean, created_at string, text string, "
    "response_tweet_id string, in_response_to_tweet_id string, ord long"
)


def tweets(spark, rows):
    full = [
        (i, author, inbound, "t", text, children, parent, n)
        for n, (i, author, inbound, text, parent, children) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    return tweets(
        spark,
        [
            ("1", "ann", True, "@Desk help &amp;amp; hurry", None, "2,3"),
            ("2", "bob", True, "me too", "1.0", None),
            ("3", "DESK", False, "try this", "1.0", "4"),
            ("4", "ann", True, "thanks", "3.0", None),
            ("5", "cy", True, "orphan", "99.0", None),
            ("6", "desk", False, "outbound first", None, "7"),
            ("7", "dan", True, "reply to outbound", "6", None),
            ("8", "eve", True, "old text", None, "9"),
            ("9", "fay", True, "first child", "8", None),
            ("10", "gus", True, "second child", "8", None),
            ("8", "eve", True, "new text", None, "9"),
        ],
    )


def test_last_row_wins_at_first_position(spark, sample):
    row = threads.unique_tweets(sample).where("tweet_id = '8'").first()
    assert (row.text, row.ord) == ("new text", 7)


def test_conversations(spark, sample):
    turns = threads.walk_threads(threads.unique_tweets(sample), BRAND)
    flat = {r.root_tweet_id: r for r in threads.flat_conversations(turns, BRAND).collect()}
    assert sorted(flat) == ["1", "5", "8"]
    first = flat["1"]
    assert (first.num_turns, first.customer_id) == (3, "ann")
    assert first.initial_query == "help & hurry"
    assert first.dialogue_head == (
        "Customer: @Desk help &amp; hurry | Desk: try this | Customer: thanks"
    )
    assert first.dialogue_chars == len(first.dialogue_head)
    assert first.first_support_reply == "try this" and first.has_support_reply
    assert flat["5"].num_turns == 1 and not flat["5"].has_support_reply
    assert flat["8"].dialogue_head == "Customer: new text | Customer: first child"


def test_summary(spark, sample):
    turns = threads.walk_threads(threads.unique_tweets(sample), BRAND)
    row = threads.prep_summary(threads.conversation_records(turns, BRAND)).first()
    assert (row.conversations, row.with_reply, row.mean_turns) == (3, 1, 2.0)
    empty = threads.conversation_records(turns.where("false"), BRAND)
    assert threads.prep_summary(empty).first().mean_turns == 0.0


def test_long_paths_and_loops(spark):
    """One path holds most of the rows; a closed loop must neither hang nor appear."""
    length = 700
    nodes = [(str(i),) for i in range(length)] + [("x",), ("y",), ("z",)]
    hops = [(str(i), str(i + 1)) for i in range(length - 1)]
    hops += [("x", "y"), ("y", "z"), ("z", "x")]
    random.Random(7).shuffle(hops)
    found = threads.path_positions(
        spark.createDataFrame(nodes, "tweet_id string"),
        spark.createDataFrame(hops, "tweet_id string, next_id string"),
    ).collect()
    assert sorted((r.tweet_id, r.turn_index) for r in found) == sorted(
        (str(i), i) for i in range(length)
    )
    assert {r.head_id for r in found} == {"0"}


TURNS = (
    "root_tweet_id string, turn_index int, tweet_id string, author_id string, inbound boolean, "
    "text string, created_at string"
)


def test_long_dialogues_lose_no_turn(spark):
    rows = [("r", i, str(i), "a", True, f"t{i}", "") for i in range(10)]
    turns = spark.createDataFrame(rows, TURNS)
    parts = sorted(tuple(p) for p in threads.dialogue_parts(turns, BRAND, turns_per_part=4).collect())
    assert [number for _, number, _ in parts] == [0, 1, 2]
    whole = " | ".join(f"Customer: t{i}" for i in range(10))
    assert " | ".join(text for *_, text in parts) == whole
    nested = sorted(threads.turn_parts(turns, turns_per_part=4).collect(), key=lambda r: r.part)
    assert [turn.turn_index for part in nested for turn in part.turns] == list(range(10))
    (flat,) = threads.flat_conversations(turns, BRAND).collect()
    assert (flat.dialogue_head, flat.dialogue_chars) == (whole, len(whole))


def test_whole_dialogues_travel_with_their_records(spark, tmp_path):
    rows = [("r", i, str(i), "a", i % 2 == 0, f"t{i} " + "x" * 20, "") for i in range(300)]
    turns = spark.createDataFrame(rows, TURNS)
    whole = " | ".join(f"{'Customer' if r[4] else BRAND}: {r[5]}" for r in rows)
    assert [tuple(r) for r in threads.dialogues(turns, BRAND).collect()] == [("r", whole)]
    flat = threads.flat_conversations(turns, BRAND)
    assert flat.first().full_dialogue == whole and len(whole) > 7000
    tables.write_flat(flat, str(tmp_path / "flat"), "csv")
    read = tables.read_conversations(spark, str(tmp_path / "flat"), "csv").first()
    assert (read.full_dialogue, read.dialogue_chars) == (whole, len(whole))


def test_heads_are_cut_and_lengths_are_not(spark):
    """Empty and null texts, one turn longer than a head, and more turns than a head may need."""
    rows = [("long", 0, "l", "a", True, "x" * 5000, ""), ("long", 1, "m", "a", False, None, "")]
    rows += [("many", i, f"n{i}", "a", False, "", "") for i in range(400)]
    found = {r.root_tweet_id: r for r in threads.dialogue_heads(spark.createDataFrame(rows, TURNS), "").collect()}
    assert found["long"].dialogue_head == ("Customer: " + "x" * 5000)[:1000]
    assert found["long"].dialogue_chars == 5010 + 3 + 2
    assert found["many"].dialogue_head == (" | ".join([": "] * 400))[:1000]
    assert found["many"].dialogue_chars == 400 * 5 - 3


def test_one_thread_with_a_third_of_all_turns(spark, tmp_path):
    """No value grows with the thread, and its files hold its parts in order."""
    count = 30_000
    turns = spark.range(count).selectExpr(
        f"IF(id < {count // 3}, 'hot', concat('r', id % 5000)) AS root_tweet_id",
        f"cast(IF(id < {count // 3}, id, (id - {count // 3}) div 5000) AS int) AS turn_index",
        "cast(id AS string) AS tweet_id", "'a' AS author_id", "id % 2 = 0 AS inbound",
        "concat('turn ', id, repeat(' word', 40)) AS text", "'t' AS created_at",
    )
    parts = threads.dialogue_parts(turns, BRAND)
    nested = threads.turn_parts(turns)
    largest = parts.agg(F.max(F.octet_length("dialogue"))).first()[0]
    assert largest < 100_000 and nested.agg(F.max(F.size("turns"))).first()[0] == 128
    assert parts.agg(F.max(F.size(F.split("dialogue", " [|] ")))).first()[0] == 128
    written = tables.in_file_order(parts, "root_tweet_id", "dialogue_part")
    tables.write_flat(written, str(tmp_path / "parts"), "csv")
    files = sorted(f for f in (tmp_path / "parts").iterdir() if f.suffix == ".csv")
    read = []
    for file in files:
        read += tables.read_dialogue_parts(spark, str(file), "csv").collect()
    hot = [r for r in read if r.root_tweet_id == "hot"]
    assert [r.dialogue_part for r in hot] == list(range(len(hot))) and len(hot) == 79
    lines = " | ".join(r.dialogue for r in hot).split(" | ")
    assert [int(line.split()[2]) for line in lines] == list(range(count // 3))
    assert sum(len(r.dialogue.split(" | ")) for r in read) == count


def test_tables_with_whole_dialogues_are_read(spark, tmp_path):
    (tmp_path / "old.csv").write_text("conversation_id,full_dialogue\nc1," + "x" * 1500 + "\n")
    row = tables.read_conversations(spark, str(tmp_path / "old.csv"), "csv").first()
    assert (row.conversation_id, len(row.dialogue_head), row.dialogue_chars) == ("c1", 1000, 1500)


def test_selection_is_one_hop(spark):
    rows = [
        ("1", "ann", True, "root", None, "2"),
        ("2", "bob", True, "ask @desk", "1.0", "3.0"),
        ("3", "cy", True, "child", "2.0", "4"),
        ("4", "dan", True, "grandchild", "3.0", None),
        ("5", "Desk", False, "hello", None, " 6 ,"),
        ("6", "eve", True, "answer", "5.0", None),
        ("7", None, True, None, None, None),
    ]
    kept = selection.select_brand(tweets(spark, rows), BRAND)
    assert sorted(r.tweet_id for r in kept.collect()) == ["1", "2", "3", "5", "6"]
    assert kept.columns.count("tweet_id") == 1 and len(kept.columns) == 8


def test_profile(spark, sample):
    row = selection.dataset_profile(sample, BRAND).first()
    assert (row.total_tweets, row.brand_outbound, row.brand_mentions, row.brand_tweets) == (
        11, 2, 1, 3,
    )


def test_hot_parent(spark):
    """A third of the rows reply to one message; one hop is still chosen for it."""
    rows = [("0", "ann", True, "root", None, None)]
    rows += [(str(i), "u", True, "me too", "0.0", None) for i in range(1, 300)]
    rows += [("300", "Desk", False, "answer", "0.0", None)]
    hops = threads.next_hops(threads.unique_tweets(tweets(spark, rows)), BRAND)
    assert [tuple(r) for r in hops.collect()] == [("0", "300")]
    assert hops.select(F.count("*")).first()[0] == 1
