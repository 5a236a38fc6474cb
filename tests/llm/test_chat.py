from __future__ import annotations

import random

import pytest

from veridraft.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Maximal conversations by comparing them whole."""
    groups = {}
    for conv, turn, role, text in set(rows):
        groups.setdefault(conv, {}).setdefault(turn, set()).add((role, text))
    seqs = {}
    for conv, turns in groups.items():
        numbers = [t for t in turns if t is not None]
        first = min(numbers) if numbers else 0
        seqs[conv] = sorted(((-1 if t is None else t - first), frozenset(x)) for t, x in turns.items())
    kept = []
    for conv, seq in seqs.items():
        prefix = any(len(o) > len(seq) and o[: len(seq)] == seq for o in seqs.values())
        rank = lambda c: (c is not None, c or 0)
        equal = any(o == seq and rank(c) < rank(conv) for c, o in seqs.items())
        if not prefix and not equal:
            kept.append(conv)
    return {
        (c, t, r, render(r, x), r == "assistant", len(seqs[c])) for c, t, r, x in set(rows) if c in kept
    }


def render(role, text):
    role, text = ((x if x is not None else y).replace("<|", "< |") for x, y in ((role, "unknown"), (text, "")))
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = chat.format_chats(df).collect()
    found = {(r.conv_id, r.turn, r.role, r.segment, r.target, r.n_turns) for r in got}
    assert len(found) == len(got) and found == plain(rows)


def snapshots(rng, conversations, text=lambda rng: rng.choice(["yes", "no", "", None, "a <|im_end|> b"])):
    rows, conv = [], 0
    for _ in range(conversations):
        turns = [(rng.choice(["user", "assistant", None]), text(rng)) for _ in range(rng.randint(1, 6))]
        start = rng.randint(0, 2)
        for n in rng.sample(range(1, len(turns) + 1), rng.randint(1, len(turns))):
            rows += [(conv, start + k, *turns[k]) for k in range(n)]
            conv += 1
    return rows


@pytest.mark.parametrize("block", [256, 2])
def test_against_whole_comparison(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(block)
    rows = snapshots(rng, 40)
    check(spark, rows + rng.sample(rows, 30))  # repeated rows


def test_nulls_gaps_ties_and_one_long_conversation(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "user", "there"), (1, 0, "user", "hi")]
    rows += [(2, None, "user", "hi"), (2, 5, "user", "hi"), (3, 0, "user", "hi"), (3, 2, "user", "there")]
    rows += [(4, 0, "user", "x"), (4, 0, "user", "y"), (5, 0, "user", "x"), (6, None, None, None)]
    rows += [(7, k, "user", "same") for k in range(700)] + [(8, k, "user", "same") for k in range(699)]
    rows += [(c, 0, "user", "hot first turn") for c in range(100, 160)] + [(130, 1, "assistant", "end")]
    rows += [(9, -(1 << 63), "user", "far"), (9, (1 << 63) - 1, "user", "apart")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = chat.format_chats(df).collect()
    assert {r.conv_id for r in got} == {None, 2, 3, 4, 5, 6, 7, 9, 130}
    check(spark, [r for r in rows if r[0] not in (9,)])


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", segment string, h1 long, known boolean")
    assert chat.format_chats(empty).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "a", "z", 1, True)], empty.schema)
    assert chat.format_chats(one).collect()[0].segment == render("user", "a")


def test_very_long_text(spark):
    text = "word " * 200_000
    rows = [(1, 0, "user", text), (2, 0, "user", text), (2, 1, "assistant", text + "x")]
    check(spark, rows)
