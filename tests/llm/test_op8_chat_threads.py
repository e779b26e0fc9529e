from talweg.llm import op8_chat_threads as C

A = "The quarterly figures look wrong to me, could somebody check them again?"
B = "I checked the figures yesterday and they are fine by my count."


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, parent_turn string")
    return {(r.conv_id, r.turn): r for r in C.threads(df).collect()}


def test_nested_quotes_link_to_the_messages_they_quote(spark):
    rows = [
        (1, 0, "user", A, "x"),
        (1, 1, "assistant", f"On Monday somebody wrote:\n> {A.upper()}\n{B}", None),
        (1, 2, "user", f"> > {A}\n> {B}\nThanks, that settles it for all of us here.", None),
        (1, 3, "user", f">> not said by anybody in here\nSomething else entirely.", None),
        (1, 4, "user", f"> Thanks, that settles it\n> for all of us here.\nYou are welcome.", None),
        (2, 1, "user", f"> {A}\nAnother conversation quotes nothing of its own.", None),
        (3, 0, None, None, None),
        (3, 1, "user", "", None),
        (None, 1, "user", f"> {A}", None),
        (4, None, "user", "no turn", None),
    ]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert got[1, 1].parent_turn == 0 and got[1, 1].body == B
    assert got[1, 2].parent_turn == 1 and got[1, 2].quote_depth == 2 and got[1, 2].n_quoted == 2
    assert got[1, 3].parent_turn is None and got[1, 3].body == "Something else entirely."
    assert got[1, 4].parent_turn == 2 and [got[1, t].position for t in (0, 1, 2, 4)] == [0, 1, 2, 3] and got[1, 4].root_turn == 0
    assert got[2, 1].parent_turn is None and got[3, 0].body == "" and got[None, 1].parent_turn is None and got[4, None].position == 0


def test_ties_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, "u", A, None), (1, 1, "u", A, None), (1, 2, "u", f"> {A}\nyes", None), (1, 2, "u", f"> {A}\nyes", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, x string")
    got = C.threads(df).collect()
    assert len(got) == 4 and {r.parent_turn for r in got if r.turn == 2} == {1}
    assert C.threads(df.limit(0)).count() == 0


def test_brute_force_on_random_threads(spark):
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(12):
        said = []
        for turn in range(12):
            words = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(999)) for _ in range(8))
            parent = rng.randrange(turn) if turn and rng.random() < 0.8 else None
            quote = "" if parent is None else "\n".join("> " + x for x in said[parent].split("\n")) + "\n"
            rows.append((conv, turn, "u", quote + words, None))
            want[conv, turn] = parent
            said.append(quote + words)
    got, paths = run(spark, rows), {}
    for key, parent in want.items():
        assert got[key].parent_turn == parent
        chain, up = [key[1]], parent
        while up is not None:
            chain, up = [up, *chain], want[key[0], up]
        assert got[key].reply_depth == len(chain) - 1 and got[key].root_turn == chain[0]
        paths[key] = chain
    # The walk through a thread is the order of its messages' chains of turns.
    for conv in range(12):
        by_chain = sorted((c for k, c in paths.items() if k[0] == conv))
        by_walk = sorted((r for k, r in got.items() if k[0] == conv), key=lambda r: (r.root_turn, r.position))
        assert [c[-1] for c in by_chain] == [r.turn for r in by_walk]


def test_short_partial_and_reflowed_quotes_and_any_ids(spark):
    rows = [
        ("b", -3, "u", "Are you sure?", None),
        ("b", 10**10, "u", "> Are you sure?\nYes.", None),
        ("b", 10**10 + 1, "u", "First of all, I would rather not go there. The second part of it is\nquite another matter altogether. And more.", None),
        ("b", 10**10 + 2, "u", "> The second part of\n> it is quite another\n> matter altogether.\nIndeed.", None),
        ("c", 0, "u", "Are you sure?", None),
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, position string")
    got = {(r.conv_id, r.turn): r.parent_turn for r in C.threads(df).collect()}
    assert got == {("b", -3): None, ("b", 10**10): -3, ("b", 10**10 + 1): None, ("b", 10**10 + 2): 10**10 + 1, ("c", 0): None}


def test_latest_before_over_spans(spark, monkeypatch):
    import random

    monkeypatch.setattr(C, "SPAN", 4)
    rng = random.Random(3)
    said = [(k, rng.randrange(40)) for k in (1, 2, 3) for _ in range(9)] * 2
    asked = [(k, t, "x") for k in (1, 2, 4) for t in range(0, 45, 3)]
    got = {(r.k, r.turn): r.said for r in C.latest_before(spark.createDataFrame(asked, "k int, turn long, at string"), spark.createDataFrame(said, "k int, turn long"), ["k"]).collect()}
    assert got == {(k, t): max(s for q, s in said if q == k and s < t) for k, t, _ in asked if any(q == k and s < t for q, s in said)}
