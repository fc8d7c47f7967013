import random

from siftwood.llm import chat
from siftwood.llm.queries import oracle_sql


def turns(spark, conversations):
    rows = [(c, k, role, text) for c, said in conversations.items() for k, (role, text) in enumerate(said)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute(conversations):
    proper = {tuple(s[:k]) for s in conversations.values() for k in range(1, len(s))}
    groups = {}
    for c, said in conversations.items():
        if tuple(said) not in proper:
            groups.setdefault(tuple(said), []).append(c)
    return {(min(g), len(said), len(g)) for said, g in groups.items()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    conversations = {}
    for c in range(60):
        said = [(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(rng.randint(1, 6))]
        conversations[c] = said
    for block in (1, 2, 256):
        found = chat.maximal_conversations(turns(spark, conversations), block_turns=block).collect()
        assert {(r.conv_id, r.n_turns, r.n_copies) for r in found} == brute(conversations)


def test_snapshots_of_one_long_conversation(spark):
    said = [("user", f"turn {k}") for k in range(700)]
    conversations = {k: said[:k] for k in (1, 2, 255, 256, 257, 512, 700)} | {900: [("user", "turn 0"), ("user", "other")]}
    out = chat.format_chats(turns(spark, conversations), block_turns=256).collect()
    assert {r.conv_id for r in out} == {700, 900}
    whole = "".join(r.rendered for r in sorted(out, key=lambda r: r.turn) if r.conv_id == 700)
    assert whole == "".join(f"<|user|>\nturn {k}\n<|end|>\n" for k in range(700))


def test_null_and_empty_differ(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, None, None), (2, 0, None, ""), (2, 1, "a", "b"), (3, 0, "", None)]
    found = chat.maximal_conversations(spark.createDataFrame(rows, schema)).collect()
    assert {r.conv_id for r in found} == {1, 2, 3}


def test_plan_is_native(spark, small):
    plan = chat.format_chats(spark.read.parquet(f"{small}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "op7_snapshot_collapse" in oracle_sql()


def test_crowded_turns_are_split(spark):
    """Conversations whose rows share a turn number, or have none, or are all the same."""
    from collections import Counter

    rng = random.Random(3)
    schema = "conv_id long, turn long, role string, text string"
    said = {
        1: [(None, "user", f"t{k % 50}") for k in range(400)],
        2: [(None, "user", "same")] * 900,
        3: [(0, "user", f"x{rng.randrange(300)}") for _ in range(500)],
        4: [(k, "user", "a") for k in range(5)],
        5: [(None, "user", "same")] * 880,  # a prefix of 2
    }
    said[6], said[7] = said[1][::-1], said[3][:]
    rng.shuffle(said[7])
    rows = [(c, *r) for c, rs in said.items() for r in rs]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, schema)
    wanted = {(1, 400, 2), (2, 900, 1), (3, 500, 2), (4, 5, 1)}
    for most in (30, 64, 65_536):
        found = chat.maximal_conversations(frame, block_turns=16, most_rows=most).collect()
        assert {(r.conv_id, r.n_turns, r.n_copies) for r in found} == wanted
    out = chat.format_chats(frame).collect()
    assert Counter((r.conv_id, r.rendered) for r in out if r.conv_id == 2) == {(2, "<|user|>\nsame\n<|end|>\n"): 900}
