"""Trie of conversations against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from emberwatch.llm import prefix_trie as pt


def plain_trie(rows):
    """Nodes as dictionaries in memory; rows are (conv_id, turn, role, text)."""
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        base, head = c - c % 100, zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(base, [])[:head] + turns[head:] if base != c else turns
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (
            min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def nodes(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in df.collect())


def talks(rng, convs, vocabulary, longest):
    rows = []
    for c in convs:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(vocabulary)) for t in range(rng.randrange(1, longest))]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("height", [2, 3, 16])
def test_trie(spark, height):
    rng = random.Random(height)
    rows = talks(rng, range(230), ["a", "b", "ünï"], 12) + talks(rng, [900, 905, 917], ["a", "b"], 9)
    for c in range(300, 380):  # a group of copies, of which some end earlier
        rows += [(c, t, "user", f"same {t}") for t in range(7 - c % 3)]
    rows += [(500, t, "user", "deep") for t in range(70)]  # one conversation with many turns
    rows += [(1000, None, None, None), (1000, 3, None, "x"), (1000, 3, None, "x"), (1000, 1, "user", None), (None, 1, "user", "lost")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", Text string").repartition(5)
    assert nodes(pt.conversation_trie(df, height)) == plain_trie(rows)


def test_turnless_conversations_belong_to_the_root(spark):
    ids = [c for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6 > 1]
    rows = [(c, 0, "user", "gone") for c in ids]  # conversation 100 is absent
    got = nodes(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_trie(rows) and len(got) == 1 and got[0][3] == len(ids)


def test_empty_and_null_tables(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pt.conversation_trie(spark.createDataFrame([(None, None, None, None)], SCHEMA)).count() == 0


def test_separators_inside_turns_make_different_nodes(spark):
    rows = [(0, 0, "a", "bc"), (1000, 0, "ab", "c"), (2000, 0, "a", "b"), (2000, 1, "c", ""), (3000, 0, None, "abc")]
    got = nodes(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_trie(rows) and got[0][4] == 4


def test_long_lists_of_ends_are_hashed_whole(spark):
    rows = [(c * 100, 0, "user", "hello") for c in range(1500)] + [(c * 100, 0, "user", "bye") for c in range(-3, 0)]
    assert nodes(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain_trie(rows)
