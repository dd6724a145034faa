"""The prefix trie against a walk over plain Python sequences."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from pairloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, at int, n int, up string, length long"


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = [*own.get(int(c / 5) * 5, [])[:h], *ts[h:]]
    members, ends = defaultdict(set), defaultdict(list)
    for c, ts in sorted(built.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
        ends[tuple(ts)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()
    )


def _same(spark, rows, parts=5):
    table = spark.createDataFrame([(*r, "x", 1, 2, "u", 3) for r in rows], SCHEMA).repartition(parts)
    out = prefix_trie.trie_query(table)
    assert out.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, out.collect())) == _brute(rows)


def _conversations(r, n, depth, words=4):
    return [(c, t, r.choice(["user", "assistant"]), f"{r.randrange(words)}ä") for c in range(n) for t in range(r.randrange(1, depth))]


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_prefixes(spark, seed):
    r = random.Random(seed)
    rows = _conversations(r, 60, 14, 2)
    rows += [(100, None, "user", "first"), (100, 0, None, None), (100, 0, "user", "b"), (100, 0, "user", "a"), (100, 0, "user", "a"), (100, 5, "", "")]
    rows += [(None, 0, "user", "nobody"), (102, 7, "user", "late"), (207, 0, "user", "no base"), (208, 0, "user", "no base"), (-4, 0, "user", "below"), (-3, 0, "user", "zero"), (-3, 1, "user", "zero")]
    r.shuffle(rows)
    _same(spark, rows)


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    r = random.Random(4)
    rows = [(c, t, "user", str(r.randrange(3)) if c else "same") for c in (0, 1, 7) for t in range(300)] + _conversations(r, 20, 5)[5:]
    _same(spark, rows)


def test_many_ends_go_through_the_hash_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    rows = [(c, 0, "user", "hello") for c in range(500)] + [(c, 1, "assistant", "yes") for c in range(0, 500, 3)] + [(c, 1, "assistant", "no") for c in range(1, 500, 30)]
    _same(spark, rows)


def test_roles_and_texts_do_not_run_together(spark):
    _same(spark, [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc"), (4, 0, "abc", None), (6, 0, None, "abc")])


def test_few_rows(spark):
    _same(spark, [])
    _same(spark, [(None, 1, "user", "x")])
    _same(spark, [(3, None, None, None)])
