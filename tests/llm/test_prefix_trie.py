import hashlib
import random
import zlib

import pytest

from lakeglass.llm import prefix_trie, queries, shared

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, slice long"


def plain_sequences(rows):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns, key=lambda t: t[:2])] for c, turns in found.items()}


def by_brute_force(sequences):
    """Every beginning of every conversation as a node of its own."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(path))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(sequences):
    out = {}
    for c, turns in sequences.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = sequences.get(base, [])[:h] + turns[h:]
    return out


def conversations(seed, n=60, longest=9):
    """Conversations that fork anywhere, in the middle of long shared stretches too."""
    rng, made, rows = random.Random(seed), [], []
    for _ in range(n):
        turns = list(rng.choice(made))[:rng.randrange(0, longest)] if made and rng.random() < 0.8 else []
        turns += [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é", "", "long text " * 5])) for _ in range(rng.randrange(0 if turns else 1, longest))]
        made.append(turns)
    for c, turns in zip(rng.sample(range(-40, 400), n), made):
        rows += [(c, 3 * t, role if role != "user" or t else None, text or None) for t, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def nodes(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "batches"), [(1, 1), (2, 2), (3, 4)])
def test_against_brute_force(spark, monkeypatch, seed, batches):
    monkeypatch.setattr(prefix_trie, "GROWTH", 3)
    rows = conversations(seed, longest=9 + 8 * (seed == 3))
    assert nodes(prefix_trie.conversation_trie(frame(spark, rows), batches)) == by_brute_force(plain_sequences(rows))


def test_hot_turns_and_one_long_conversation(spark, monkeypatch):
    """One conversation holds a third of all rows, most others open alike, and many are equal."""
    monkeypatch.setattr(shared, "HOT_PART", 20)
    rng = random.Random(9)
    rows = [(7, t, "user", f"turn {t % 90}") for t in range(400)]
    for c in range(100, 300):
        opening = [("user", "hello"), ("assistant", "hi")] if c % 8 else []
        turns = opening + ([("user", "same")] * 2 if c % 3 else [("user", rng.choice("abc")) for _ in range(rng.randrange(5))]) or [("user", "x")]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    rows += [(1000, t, "user", f"turn {t % 90}") for t in range(250)] + [(1000, 250, "user", "apart")]
    assert nodes(prefix_trie.conversation_trie(frame(spark, rows))) == by_brute_force(plain_sequences(rows))


def test_shared_openings(spark):
    """The query's conversations: turnless ones, absent bases, and negative ids."""
    rows = conversations(4, n=120, longest=12)
    steps = queries.with_shared_openings(prefix_trie.numbered(frame(spark, rows)))
    want = rebuilt(plain_sequences(rows))
    assert any(not turns for turns in want.values())
    assert nodes(prefix_trie.trie(steps, frame(spark, rows).select("conv_id"))) == by_brute_force(want)


def test_of_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, 1, "user", "b"), (5, None, "", ""), (6, 2, "x" * 100_000, "y" * 300_000), (6, -1, "", "")]
    want = plain_sequences(rows)
    assert [len(want[c]) for c in (5, 6)] == [3, 2]
    assert nodes(prefix_trie.conversation_trie(frame(spark, rows))) == by_brute_force(want)
    assert nodes(prefix_trie.conversation_trie(frame(spark, []))) == [] and nodes(prefix_trie.conversation_trie(frame(spark, rows[:1]))) == []
    only_root = prefix_trie.trie(prefix_trie.numbered(frame(spark, [])), spark.createDataFrame([(3,), (-2,), (3,)], "conv_id long"))
    assert nodes(only_root) == by_brute_force({3: [], -2: []})


def test_ties_are_repeatable(spark):
    """Turns of one number stand in an order that the order of the rows does not change."""
    rows = [(c, 0, "user", text) for c in (1, 2) for text in "abcd"]
    one, other = (nodes(prefix_trie.conversation_trie(frame(spark, r).repartition(n))) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert one == other and len(one) == 5
