"""Circulant MinHash dedup against all pairs by plain sets."""

import random
import re

import numpy as np
import pytest

from pairloom.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c string, key string, n string, a int, root int"


def _set(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def _brute(rows):
    """A list of (doc_id, size, component_id) in the order of rows."""
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def _table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, "c", "k", "n", 1, 2) for d, t in rows], SCHEMA).repartition(5)


def _same(spark, rows):
    got = sorted(map(str, ((g.doc_id, g.n_shingles, g.component_id, g.kept) for g in minhash.minhash_query(_table(spark, rows)).collect())))
    assert got == sorted(str((d, n, c, d == c)) for d, n, c in _brute(rows))


def _edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_against_all_pairs(spark):
    r = random.Random(11)
    rows, i = [], 0
    for size in (4, 5, 8, 20, 60, 60, 150, 400):
        base = [f"w{r.randrange(3000)}" for _ in range(size)]
        for k in range(25):
            rows.append((i := i + 1, _edited(r, base, k // 3)))
    rows += [(i + 1, None), (i + 2, ""), (i + 3, " \t\n"), (i + 4, "one"), (i + 5, "ONE"), (i + 6, "one two three"), (i + 7, "One  two\nThree"), (i + 8, "three two one"), (None, rows[0][1]), (None, "alone without an id"), (None, None)]
    rows += [(i + 20, "Ä b c d e"), (i + 21, "ä b c d e"), (i + 22, "a b a b a b a b a b"), (i + 23, "A B A B A B"), (i + 24, "w " * 5000), (5, rows[4][1]), (5, rows[4][1])]
    _same(spark, rows)


@pytest.mark.parametrize(("edits", "copies"), [(2, 120), (5, 90), (7, 90), (12, 60)])
def test_large_buckets_take_more_pivots(spark, edits, copies):
    """Copies that share buckets but link with some others, few or none."""
    r = random.Random(edits)
    base = [f"w{k}" for k in range(160)]
    rows = [(k, _edited(r, base, edits)) for k in range(copies)]
    _same(spark, rows + [(copies + k, rows[0][1]) for k in range(5)])


def test_large_buckets_without_bounds(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 10**6)
    r = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    _same(spark, [(k, _edited(r, base, k % 9)) for k in range(80)])


def test_chain_of_links(spark):
    """Each text is near the next one only."""
    words = [f"w{k}" for k in range(400)]
    _same(spark, [(50 - k, " ".join(words[8 * k : 8 * k + 100])) for k in range(30)])


def test_shared_pivot_in_slices(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HEAVY", 10)
    r = random.Random(2)
    base = [f"w{k}" for k in range(100)]
    _same(spark, [(k, _edited(r, base, 1)) for k in range(60)])


def test_empty(spark):
    out = minhash.minhash_query(_table(spark, []))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0
    assert minhash.minhash_query(_table(spark, [(1, None), (2, "")])).count() == 2


def test_permutations():
    x = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4097)
    assert len(np.unique(minhash.order_of(x.copy()))) == len(x)
    signature = minhash.signatures([np.arange(9, dtype=np.uint64), np.arange(5, 70, dtype=np.uint64)], 16)
    for k in range(16):  # coordinate k is the second permutation of the places, shifted by k
        for i, s in enumerate((np.arange(9, dtype=np.uint64), np.arange(5, 70, dtype=np.uint64))):
            assert signature[k, i] == minhash.order_of((minhash.places(s).astype(np.int64) + k).astype(np.uint32)).min()


def test_coordinates_agree_as_often_as_sets_do():
    r = np.random.default_rng(3)
    agree = []
    for _ in range(60):
        x = r.integers(0, 1 << 63, 300).astype(np.uint64)
        y = np.concatenate([x[:240], r.integers(0, 1 << 63, 60).astype(np.uint64)])
        s = minhash.signatures([x, y], 128)
        agree.append((s[:, 0] == s[:, 1]).mean())
    assert abs(np.mean(agree) - 240 / 360) < 0.02


def test_long_sets_go_in_steps(monkeypatch):
    r = np.random.default_rng(1)
    sets = [r.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 700, 3, 90, 1, 1, 2000, 5)]
    whole = minhash.signatures(sets, 8)
    monkeypatch.setattr(minhash, "STEP", 64)
    assert (minhash.signatures(sets, 8) == whole).all()
