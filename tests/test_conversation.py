"""Conversation operators against a message-by-message walk."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import conversation as C
from waymark.operators import intent as I
from waymark.operators import ordered, preferences, prompts

TEXTS = ["find me tacos", "I like it", "GREAT", "another", "not a fan", "next", "I don't know", "coffee?"]


def random_log(seed, conversations=25):
    """Conversation 0 holds a third of all messages; turns have gaps."""
    rng = random.Random(seed)
    log, results = [], []
    for conv in range(conversations):
        turn = 0
        for _ in range(60 if conv == 0 else rng.randint(1, 6)):
            turn += rng.randint(1, 3)
            log.append((conv, turn, "user", f"u{conv % 4}", rng.choice(TEXTS)))
            if rng.random() < 0.3:
                log.append((conv, turn + 100_000, "assistant", f"u{conv % 4}", "great next"))
            for rank in range(1, rng.choice([0, 0, 1, 2, 4]) + 1):
                results.append((conv, turn, rank, f"b{rng.randint(0, 9)}"))
    return log, results


def walk(log, results):
    """What a live session does, one message at a time."""
    listed = {}
    for conv, turn, rank, item in results:
        listed.setdefault((conv, turn), []).append((rank, item))
    out = {}
    state = {}
    for conv, turn, role, _, text in sorted(log, key=lambda r: (r[0], r[1])):
        if role != "user":
            continue
        low = text.lower()
        current, place, start = state.get(conv, ([], 0, None))
        found = [item for _, item in sorted(listed.get((conv, turn), []))]
        positive = any(p in low for p in C.POSITIVE)
        negative = not positive and any(p in low for p in C.NEGATIVE)
        reacted = None
        if positive and current:
            action, reacted = "liked", current[place]
        elif negative:
            reacted = current[place] if current else None
            if current and place + 1 < len(current):
                place += 1
                action = "next"
            else:
                action = "no_more"
        elif found:
            current, place, start, action = found, 0, turn, "shown"
        else:
            action = "no_results"
        state[conv] = (current, place, start)
        out[(conv, turn)] = (action, start, place + 1 if current else None, reacted)
    return out


def tables(spark, log, results):
    return (
        spark.createDataFrame(log, "conv_id long, turn long, role string, user_id string, text string").repartition(3),
        spark.createDataFrame(results, "conv_id long, turn long, rank int, business_id string"),
    )


@pytest.mark.parametrize("seed, chunk", [(1, 4096), (2, 5), (3, 2)])
def test_cursor_equals_live_session(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    log, results = random_log(seed)
    want = walk(log, results)
    messages, found = tables(spark, log, results)
    moves = C.cursor(messages, found).persist()
    got = {(r["conv_id"], r["turn"]): (r["action"], r["shown_turn"], r["shown_rank"]) for r in moves.collect()}
    assert got == {key: value[:3] for key, value in want.items()}
    items = {(r["conv_id"], r["turn"]): r["business_id"] for r in C.last_item(moves, found).collect()}
    assert items == {key: value[3] for key, value in want.items() if value[3]}
    shown = C.next_suggestion(moves, found)
    assert shown.count() == sum(value[0] in ("shown", "next") for value in want.values())
    moves.unpersist()


def test_feedback_phrases(spark):
    rows = spark.createDataFrame([(t,) for t in ("I LIKE it, next", "Don't", "something ELSE", "tacos", "don't like")], "text string")
    got = [tuple(r) for r in rows.select(C.feedback_class(F.col("text")), C.feedback_class(F.col("text"), (), C.NEGATIVE_SHORT)).collect()]
    assert got == [("positive", "negative"), ("negative", "search"), ("negative", "search"), ("search", "search"), ("negative", "negative")]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_running(spark, chunk):
    rng = random.Random(chunk)
    rows = [(g, o, rng.choice([None, 1, 2, 5])) for g in ("a", "b", None) for o in rng.sample(range(-20, 60), 30)]
    df = spark.createDataFrame(rows, "g string, o long, v int").repartition(5)
    got = ordered.running(
        df, ["g"], "o", sums={"s": F.coalesce("v", F.lit(0))}, lasts={"l": F.col("v"), "at": F.when(F.col("v") == 5, F.col("s"))},
        befores={"p": F.col("v")}, totals=["s"], chunk=chunk,
    ).collect()
    for g in ("a", "b", None):
        total, last, at, before = 0, None, None, None
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])
        assert len(mine) == 30
        for r in mine:
            total += r["v"] or 0
            last = r["v"] if r["v"] is not None else last
            at = total if r["v"] == 5 else at
            assert (r["s"], r["l"], r["at"], r["p"]) == (total, last, at, before)
            before = last
        assert {r["s_total"] for r in mine} == {total}


def test_history(spark):
    rows = spark.createDataFrame([(1, t, "user", "x") for t in (5, 2, 9)], "conv_id long, turn long, role string, text string")
    got = sorted((r["turn"], r["position"], r["from_last"]) for r in C.history(rows).collect())
    assert got == [(2, 1, 3), (5, 2, 2), (9, 3, 1)]


PLACES = [("b1", "Red Door", 10.0, 10.0), ("b2", "", 10.0, 10.1), ("b3", "door", 10.2, 10.0), ("b4", None, 0.0, 0.0)]


def places(spark):
    rows = [(b, n, "C", "PA", la, lo, None, "x") for b, n, la, lo in PLACES]
    return spark.createDataFrame(
        rows, "business_id string, name string, city string, state string, latitude double, longitude double, stars double, categories string"
    )


def test_selections_and_itinerary(spark):
    results = [(1, 0, 1, "b2"), (1, 0, 2, "b3"), (1, 0, 3, "b1"), (1, 6, 1, "b4"), (1, 6, 2, "b1"), (2, 0, 1, "b1")]
    texts = {
        (1, 0): "red door",  # has results of its own: a search
        (1, 2): "the RED DOOR please",  # two names fit, the better rank counts
        (1, 4): "thanks",
        (1, 6): "more",
        (1, 8): "red door then",
        (1, 10): "door",  # not in the current list
        (2, 2): "somewhere else",
        (3, 0): "red door",  # nothing shown yet
    }
    messages = spark.createDataFrame([(c, t, x) for (c, t), x in texts.items()], "conv_id long, turn long, text string")
    shown = spark.createDataFrame(results, "conv_id long, turn long, rank int, business_id string")
    chosen = C.place_selections(messages, shown, places(spark))
    got = sorted((r["conv_id"], r["turn"], r["list_turn"], r["business_id"]) for r in chosen.collect())
    assert got == [(1, 2, 0, "b3"), (1, 8, 6, "b1")]

    legs = sorted(C.itinerary(chosen).collect(), key=lambda r: r["visit"])
    assert [(r["visit"], r["business_id"], r["from_business_id"]) for r in legs] == [(1, "b3", None), (2, "b1", "b3")]
    assert legs[0]["leg_km"] is None and legs[1]["leg_km"] == pytest.approx(22.12, abs=0.01)
    total = C.itinerary_totals(C.itinerary(chosen)).first()
    assert (total["n_visits"], round(total["total_km"], 2)) == (2, 22.12)

    modes = {(r["conv_id"], r["turn"]): (r["mode"], r["origin_id"]) for r in C.search_origins(messages, chosen).collect()}
    assert modes[(1, 0)] == ("search", None) and modes[(1, 6)] == ("planning", "b3") and modes[(1, 10)] == ("planning", "b1")


def walk_choices(messages, shown, names):
    """Place selections turn by turn, as a live session makes them."""
    out, current = [], {}
    for conv, turn, text in sorted(messages):
        listed = shown.get((conv, current.get(conv)), [])
        picked = next((b for b in listed if names[b] and names[b].lower() in text.lower()), None)
        if picked:
            out.append((conv, turn, current[conv], picked))
        elif (conv, turn) in shown:
            current[conv] = turn
    return out


def test_naming_comes_before_searching(spark):
    draw = random.Random(8)
    names = {"b1": "Red Door", "b2": "Gym", "b3": "The Red Door", "b4": "", "b5": "Cafe"}
    rows = [(b, n, "c", "FL", 1.0, 2.0, 3.0, "x") for b, n in names.items()]
    business = spark.createDataFrame(
        rows, "business_id string, name string, city string, state string, latitude double, longitude double, stars double, categories string"
    )
    messages, shown = [], {}
    for conv in range(12):
        for turn in range(0, 30, 2):
            messages.append((conv, turn, draw.choice(["go to gym", "RED DOOR", "cafe then", "hello", "the red door, gym"])))
            if draw.random() < 0.7:
                shown[(conv, turn)] = draw.sample(sorted(names), draw.randint(1, 3))
    results = [(c, t, r, b) for (c, t), found in shown.items() for r, b in enumerate(found, 1)]
    chosen = C.place_selections(
        spark.createDataFrame(messages, "conv_id long, turn long, text string"),
        spark.createDataFrame(results, "conv_id long, turn long, rank int, business_id string"),
        business,
    )
    got = sorted((r["conv_id"], r["turn"], r["list_turn"], r["business_id"]) for r in chosen.collect())
    assert got == walk_choices(messages, shown, names)


def test_category_sets_and_upsert(spark):
    reacted = spark.createDataFrame(
        [("u1", "positive", "b1"), ("u1", "positive", "b1"), ("u1", "negative", "b2"), ("u3", "positive", "b2")],
        "user_id string, feedback string, business_id string",
    )
    business = spark.createDataFrame([("b1", "Tacos, BAR,tacos,"), ("b2", "Gym")], "business_id string, categories string")
    sets = C.category_sets(C.category_feedback(reacted, business))
    assert sorted(tuple(r) for r in sets.collect()) == [("u1", "bar, tacos", "gym"), ("u3", "gym", "")]
    users = spark.createDataFrame([("u1", "A", "old"), ("u2", "B", "kept")], "user_id string, name string, categories string")
    # Users the table does not know are stored only where asked for.
    got = sorted(tuple(r) for r in preferences.store_liked(users, sets).collect())
    assert got == [("u1", "A", "bar, tacos"), ("u2", "B", "kept")]
    got = sorted(tuple(r) for r in preferences.store_liked(users, sets, add_users=True).collect())
    assert got == [("u1", "A", "bar, tacos"), ("u2", "B", "kept"), ("u3", None, "gym")]
    assert [r["user_id"] for r in preferences.look_up(users, reacted).collect()] == ["u1"]


def test_intent(spark):
    vocabulary = spark.createDataFrame(
        [("city", "new york"), ("city", "york"), ("city", "st. louis"), ("category", "bars & grills"), ("category", "bar"), ("category", "")],
        "kind string, term string",
    )
    texts = ["A bar in New  York!", "bars grills, St Louis", "barber in yorkshire", "", "York or bar, bar?"]
    messages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
    got = {r["turn"]: (r["location"], r["category"], r["is_complete"]) for r in I.intent(messages, vocabulary).collect()}
    assert got == {
        0: ("new york", "bar", True),
        1: ("st louis", "bars grills", True),
        2: (None, None, False),
        3: (None, None, False),
        4: ("york", "bar", True),
    }


def test_prompts(spark):
    hits = spark.createDataFrame(
        [("q", 2, "B", "", "C", "PA", None, None), ("q", 1, "A", "x", None, "PA", 4.5, 1.25)],
        "query_id string, rank int, name string, categories string, city string, state string, stars double, distance_km double",
    )
    asked = spark.createDataFrame([("q", "where?"), ("none", "x")], "query_id string, text string")
    got = prompts.prompt_table(asked, hits).collect()
    assert len(got) == 1 and got[0]["prompt"].endswith(
        "Question: where?\n\nPlaces:\n- A (x), Unknown, PA, 4.5 stars, 1.25 km\n- B (), C, PA, ? stars, ? km\n"
    )
