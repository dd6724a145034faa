"""Operators with exact results, against brute force over small documents with awkward cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairloom.llm import decontam, lines, media, mixing, sharding, simhash, substring
from pairloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, k string, copies int, kept string"


def _corpus():
    """Copies, near copies, shared passages, repeated lines, nulls, blanks, a long text, repeated rows, ids that are null."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage, common = prose(60), "A line that many documents share, word for word."
    out = []
    for i in range(120):
        t = prose(r.randint(1, 200))
        if i % 6 == 0:
            t = t + " " + passage + " " + prose(20)
        if i % 5 == 0:
            t = t + "\n" + common + "\n" + prose(8)
        if i % 7 == 0:
            t = t + "\n" + common.replace("many", "mony") + "\n\n  " + common.upper()
        out.append((i, t))
    out += [(200 + i, out[3][1]) for i in range(15)]  # exact copies
    for i in range(15):  # near copies: one word of a long text changed
        w = out[0][1].split(" ") * 4
        w[r.randrange(len(w))] = f"new{i}"
        out.append((300 + i, " ".join(w)))
    out += [(400, None), (401, ""), (402, " \n\t "), (403, None), (404, "one"), (405, "one two three"), (406, prose(20000)), (407, passage), (407, passage), (None, passage), (None, "lonely text of a row without id"), (408, "ä é ü " * 40)]
    return [(i, t, "en", None if (i or 0) % 9 == 1 else f"s{(i or 0) % 4}", None, 1, "x", "y", 2, "z") for i, t in out]


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    return (t or "").encode().split()


def test_substring(docs, rows):
    n = Counter()
    for r in rows:
        w = _words(r[1])
        n.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = Counter()
    for i, t, *_ in rows:
        w = _words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if n[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, substring.substring_query(docs).collect())) == want


def test_substring_keeps_extra_columns(docs):
    out = substring.dedup(docs)
    assert set(docs.columns) < set(out.columns) and out.where("size = 1 and h = 'x'").count() == docs.count()
    for r in out.select("text", "kept", "spans", "n_removed").collect():
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_removed


def _removed(texts, width=35):
    n = Counter(tuple(w[k : k + width]) for w in map(_words, texts) for k in range(len(w) - width + 1))
    out = []
    for w in map(_words, texts):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if n[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append(sum(gone))
    return out


@pytest.mark.parametrize("piece,sent", [(2 << 20, 1 << 19), (900, 1 << 19), (900, 3)])
def test_substring_one_passage_in_very_many_documents(spark, monkeypatch, piece, sent):
    """What repeats is sent once a task, in whatever pieces it is read; what a task forgets is sent again."""
    monkeypatch.setattr(substring, "PIECE", piece)
    monkeypatch.setattr(substring, "SENT", sent)
    r = random.Random(6)
    passage = " ".join(r.choice("abcdefghij") + str(k) for k in range(50))
    texts = [" ".join(str(r.random()) for _ in range(r.randint(0, 60))) + " " + passage + " " + " ".join(str(r.random()) for _ in range(r.randint(0, 40))) for _ in range(150)]
    texts += [" ".join(str(r.random()) for _ in range(90)) for _ in range(20)] + [passage + " " + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [x.n_removed for x in substring.substring_query(df).orderBy("doc_id").collect()] == _removed(texts)


@pytest.mark.parametrize("n", [1024, 2048])
def test_substring_words_that_a_polynomial_confuses(spark, n):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    texts = [" ".join([w, *[f"same{k}" for k in range(33)], w, *[f"same{k}" for k in range(6)]]) for w in (one, two)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.n_removed for x in substring.substring_query(df).collect()] == [0, 0] == _removed(texts)


def test_substring_cuts_long_texts_in_parts():
    from pairloom.llm.shared import hashed_words, words_of

    text = " \t".join(f"w{k % 77}" for k in range(3000)).encode() + b" "
    assert [w for part in words_of(text, 100) for w in part] == text.split()
    whole, at = hashed_words([text, b"", b"x"])
    assert at.tolist() == [0, 3000, 3000, 3001] and len(set(whole.tolist())) == 78
    spans = np.array([[5, 40], [2990, 3000]], np.uint32).tobytes()
    w = text.split()
    assert substring.cut(text, spans) == (3000, 45, b" ".join(w[:5] + w[40:2990]))


def _fingerprint(t):
    import xxhash

    w = (t or "").encode()
    w = w.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _classes(n, linked):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                up[top(a)] = top(b)
    return [top(x) for x in range(n)]


def test_simhash(docs, rows):
    fps = [_fingerprint(r[1]) for r in rows]
    cls = _classes(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    least = defaultdict(list)
    for c, r in zip(cls, rows):
        if r[0] is not None:
            least[c].append(r[0])
    want = Counter((r[0], f"{f:016x}", min(least[c]) if least[c] else None) for r, f, c in zip(rows, fps, cls))
    assert Counter(map(tuple, simhash.simhash_query(docs).collect())) == want


def test_one_per_group(docs, rows):
    fps = [_fingerprint(r[1]) for r in rows]
    cls = _classes(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    out = simhash.one_per_group(docs)
    assert out.columns == docs.columns and out.count() == len(set(cls))


@pytest.mark.parametrize("radius,step", [(4, 1 << 21), (4, 50), (6, 700)])
def test_bk_tree(radius, step, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", step)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(8)]]))
    links = simhash.shard_links(fps, np.full(len(fps), 2, np.uint8), radius)
    up = _classes(len(fps), lambda a, b: int(fps[a] ^ fps[b]).bit_count() <= radius)
    got = _classes(len(fps), lambda a, b: (a, b) in pairs or (b, a) in pairs) if (pairs := {tuple(x) for x in links.tolist()}) else None
    assert len(set(got)) == len(set(up)) and len(links) == len(fps) - len(set(up))


def test_bk_forest_has_children_by_distance_and_follows_near_edges_only():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    fps[300:600] = fps[:300] ^ (np.uint64(7) << rng.integers(0, 60, 300, dtype=np.uint64))
    shard = np.arange(900) % 3
    order = np.argsort(shard, kind="stable")
    fps, shard = fps[order], shard[order]
    forest = simhash.BKForest(fps, np.arange(900), shard)
    assert sorted(forest.item.tolist()) == list(range(900)) and forest.roots == 3
    children = {}
    for child, code in enumerate(forest.edge.tolist(), forest.roots):
        parent, far = divmod(code, 128)
        a, b = forest.item[parent], forest.item[child]
        assert int(fps[a] ^ fps[b]).bit_count() == far and shard[a] == shard[b]
        assert children.setdefault((parent, far), child) == child
    found = set()
    forest.search(np.arange(900), shard, 4, lambda q, items: found.update(zip(q.tolist(), items.tolist())))
    assert found == {(a, b) for a in range(900) for b in range(900) if a != b and shard[a] == shard[b] and int(fps[a] ^ fps[b]).bit_count() <= 4} and found
    assert forest.visited < 900 * 300 / 2


def test_one_per_group_with_one_id_for_unlike_texts(spark):
    r = random.Random(2)
    prose = [" ".join(str(r.random()) for _ in range(40)) for _ in range(3)]
    df = spark.createDataFrame([(7, prose[0], "a"), (7, prose[1], "b"), (7, prose[1], "b"), (8, prose[1], "c"), (None, prose[2], "d"), (None, prose[2], "d")], "doc_id long, text string, rk string")
    assert sorted((x.doc_id or 0, x.text, x.rk) for x in simhash.one_per_group(df).collect()) == sorted([(7, prose[0], "a"), (7, prose[1], "b"), (0, prose[2], "d")])


def test_near_links_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    rng = np.random.default_rng(2)
    fps = sorted({0, *[int(1 << a | 1 << b) for a, b in rng.integers(0, 63, (60, 2))]})
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    roots = components(links).select("root").distinct().count()
    assert roots == 1  # all within two bits of zero


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    assert got == {x: top(x) for x in nodes}


def _norm(x):
    import re

    return re.sub(r"[ \t\n\x0b\f\r]+", " ", x.lower()).strip(" ")


def _within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    m = 0
    while m < min(len(a), len(b)) - k and a[-1 - m] == b[-1 - m]:
        m += 1
    return max(len(a), len(b)) - k - m <= 1


def _line_rows(rows):
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "", r[1] is None) for r in rows})
    first = {}
    for key in order:
        for p, x in enumerate(key[2].split("\n")):
            if (n := _norm(x)) and n not in first:
                first[n] = (key, p)
    ranked = sorted(first, key=lambda n: (order.index(first[n][0]), first[n][1]))
    near = {n for i, n in enumerate(ranked) if any(_within_one(n, m) for m in ranked[:i])}
    want = Counter()
    for r in rows:
        key, kept, n_lines, n_near, gone = (r[0] is None, r[0] or 0, r[1] or "", r[1] is None), [], 0, 0, 0
        for p, x in enumerate(key[2].split("\n")):
            n = _norm(x)
            stays = not n or (first[n] == (key, p) and n not in near)
            n_lines += bool(n)
            n_near += bool(n) and first.get(n) == (key, p) and n in near
            gone += not stays
            if stays:
                kept.append(x)
        want[r[0], n_lines, gone, n_near, hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("hot", [64, 1])
def test_lines(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    # rows with one id and unlike texts are ordered by a hash; the brute force knows no such rows here
    known = docs.where("doc_id is not null")
    assert Counter(map(tuple, lines.lines_query(known).collect())) == _line_rows([r for r in rows if r[0] is not None])


def test_within(spark):
    from pyspark.sql import functions as F

    r = random.Random(9)
    pairs = [("".join(r.choice("abc") for _ in range(r.randint(1, 12))), "".join(r.choice("abc") for _ in range(r.randint(1, 12)))) for _ in range(400)]
    pairs += [(a, a[: len(a) // 2] + a[len(a) // 2 + 1 :] or "a") for a, _ in pairs[:100]]
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        assert df.where(lines.within("a", "b", k) != (F.levenshtein("a", "b") <= k)).count() == 0


def test_near_lines_two_edits(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdef ") for _ in range(r.randint(4, 30))).strip() or "q" for _ in range(60)]
    texts = sorted({_norm(t) for t in [*base, *[b[:3] + "x" + b[4:] for b in base], *[b[1:] + "y" for b in base if len(b) > 3]]} - {""})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, t in enumerate(texts) for j in range(i) if _edits(t, texts[j]) <= 2}
    assert {x.doc_id for x in lines.dedup(df, 2).where("n_near = 1").collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_hot_keys_are_split(spark, monkeypatch, seed):
    """Very many lines alike but for a few places: no key may pair them all up, and none may be lost."""
    monkeypatch.setattr(lines, "HOT", 3)
    r = random.Random(seed)
    stem = "".join(r.choice("abcdefgh") for _ in range(11))
    texts = {stem}
    for _ in range(250):
        t = stem
        for _ in range(r.randint(1, 3)):
            p, kind = r.randrange(len(t) + 1), r.randrange(3)
            t = t[:p] + r.choice("abxyz") + t[p:] if kind == 0 else t[:p] + t[p + 1 :] if kind == 1 else t[:p] + r.choice("abxyz") + t[p + 1 :]
        texts.add(t)
    texts |= {"a", "b", "ab", "ba", "abc", "c"}
    texts = sorted(t for t in texts if t)
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, t in enumerate(texts) if any(_within_one(t, u) for u in texts[:i])}
    assert {x.doc_id for x in lines.dedup(df).where("n_near = 1").collect()} == want


def test_long_lines_at_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 3)
    r = random.Random(1)
    half = "".join(r.choice("abcdefgh ") for _ in range(20000)).strip()
    texts = [half + "".join(r.choice("abcdefgh") for _ in range(20000)) for _ in range(8)]
    texts += [texts[0][:30000] + texts[0][30001:], texts[1][:25000] + "X" + texts[1][25001:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.n_near for x in lines.dedup(df).orderBy("doc_id").collect()] == [0] * 8 + [1, 1]


def test_lines_of_rows_without_id(spark):
    texts = [f"line {i} of a row without an id {i * i}" for i in range(50)]
    df = spark.createDataFrame([(None, f"{t} {t}\n{t}") for t in texts], "doc_id long, text string")
    out = lines.dedup(df).collect()
    assert all(x.kept == x.text and x.n_removed == 0 for x in out) and len(out) == 50


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _shingles(t, k=5):
    import re

    w = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_decontamination(spark, docs, rows):
    r = random.Random(8)
    passage = rows[0][1].split(" ")[-81:-21]
    items = [(1, " ".join(passage)), (2, " ".join(passage[:30]).upper() + "!"), (3, " ".join(passage[:20] + [r.choice("xyz") for _ in range(20)])), (4, "one two three"), (5, None), (6, ""), (7, "of a row without id"), (8, "not in any document at all, never"), (9, " ".join([*passage[:30], "odd", *passage[31:]]))]
    want = Counter()
    for i, t in {(r[0], r[1]) for r in rows}:
        for j, u in items:
            a, b = _shingles(u), _shingles(t)
            if a and len(a & b) >= 0.8 * len(a) - 1e-9:
                want[i, j, len(a), len(a & b)] += 1
    got = decontam.decontam_query(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((x.doc_id, x.item_id, x.n_shingles, x.n_found) for x in got.collect()) == want and want
    dirty = {(k[0]) for k in want}
    clean = decontam.clean_docs(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns
    assert Counter(x.doc_id for x in clean.where("doc_id is not null").collect()) == Counter(r[0] for r in rows if r[0] is not None and r[0] not in dirty)


def _capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, free = (low + high) // 2, 0, 0
        for s in sizes:
            if s > free:
                used, free = used + 1, mid
            free -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(docs, rows, shards):
    out = sharding.shard(docs, shards).collect()
    assert len(out) == len(rows) and {x.shard for x in out} <= set(range(shards))
    size, group, where = defaultdict(int), {}, defaultdict(set)
    for x in out:
        size[x.shard] += x["size"]
        group[x.group_hash] = group.get(x.group_hash, 0) + x["size"]
        where[x.group_hash].add(x.shard)
    assert all(len(s) == 1 for s in where.values())
    assert max(size.values()) == _capacity([group[h] for h in sorted(group)], shards)
    for s in size:
        assert sorted(x.slot for x in out if x.shard == s) == list(range(sum(x.shard == s for x in out)))
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in out) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)


def test_very_many_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 4)
    rows = [(7, "same text")] * 301 + [(None, None)] * 5 + [(i, f"text {i}") for i in range(100, 140)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3).collect()
    assert Counter((x.doc_id, x.text_crc32) for x in out) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in {x.shard for x in out}:
        assert sorted(x.slot for x in out if x.shard == s) == list(range(sum(x.shard == s for x in out)))


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, left, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}, list(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > 2 * sizes[s]]
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing(docs, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(_words(r[1]))
    target = _targets(sizes)
    src = defaultdict(list)
    for r in rows:
        src[r[0], len(_words(r[1]))].append(r[3])
    out = mixing.mix(docs).collect()
    taken = defaultdict(int)
    assert len(out) == len(rows)
    for x in out:
        assert x.source_size == sizes[x.source] and abs(x.target - target[x.source]) < 1e-6
        assert x.taken == x.copies * x["size"] and 0 <= x.copies <= 2
        taken[x.source] += x.taken
    for s, t in target.items():
        small = sorted((len(_words(r[1])) for r in rows if r[3] == s), reverse=True)
        assert abs(taken[s] - t) <= small[0] / 2 + 1
    again = mixing.mixed_query(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter((x.doc_id, x["size"], x.source_size, x.target, x.taken, x.copies) for x in out)
    mixed = mixing.mixed_docs(docs)
    assert mixed.count() == sum(x.copies for x in out)
    assert mixed.columns == docs.columns  # extra columns named like those of `mix` too
    assert mixed.where("size != 1 or copies != 2").count() == 0


def _png_samples(image):
    """A plain decoder of greyscale PNGs, written from the format's description: all filters, any chunks."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, packed, head = 8, b"", None
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(image[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            head = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), *body[8:])
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    width, height, depth, colour, *_ = head
    assert (depth, colour) == (8, 0)
    flat, out, above = zlib.decompress(packed), [], [0] * width
    for y in range(height):
        kind, raw = flat[y * (width + 1)], flat[y * (width + 1) + 1 : (y + 1) * (width + 1)]
        row = []
        for x, v in enumerate(raw):
            a, b, c = row[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v + (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(bytes(row))
        above = row
    return b"".join(out)


def _payload(t):
    raw = (t or "").encode()
    return raw + b"\0" * (max(-(-len(raw) // 64), 1) * 64 - len(raw))


def test_media(docs, rows):
    got = media.media_query(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        p = _payload(t)
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in got) == want
    for x in got[:30]:
        (p,) = {_payload(r[1]) for r in rows if hashlib.sha256(_payload(r[1])).hexdigest() == x.payload_sha256}
        v = np.frombuffer(p, np.uint8).astype(float)
        assert x.feature == f"mean={v.mean():.4f};std={v.std():.4f};step={np.abs(np.diff(v)).mean():.4f};hist=" + ",".join(str(int((v // 32 == k).sum())) for k in range(8))


def test_media_is_what_is_stored(docs, rows, tmp_path, monkeypatch):
    path = str(tmp_path)
    media.store(docs, path)
    stored = media.load(docs.sparkSession, path)
    images = stored.collect()
    assert Counter((x.doc_id, _png_samples(bytes(x.media))) for x in images) == Counter((r[0], _payload(r[1])) for r in rows)
    sums = Counter((len(x.media), hashlib.sha256(x.media).hexdigest()) for x in images)
    assert Counter((x.media_bytes, x.media_sha256) for x in media.decoded(stored).collect()) == sums
    assert Counter(bytes(x.payload) for x in media.decoded(stored, payload=True).collect()) == Counter(_payload(r[1]) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
def test_media_in_pieces(n, monkeypatch):
    monkeypatch.setattr(media, "ROWS", 3)
    text = bytes(random.Random(n).choices(range(256), k=n))
    image = media.encode(memoryview(text))
    assert _png_samples(image) == text + b"\0" * (max(-(-n // 64), 1) * 64 - n) == b"".join(x.tobytes() for x in media.samples(image))
    assert media.unpadded(image) == n


def test_media_writes_add_up(spark, tmp_path):
    def rows(*ids):
        return spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")

    path = str(tmp_path / "a")
    media.store(rows(1, 2, 3), path)
    media.store(rows(4, 5, 6, 7, 8), path)
    assert sorted(x.doc_id for x in media.load(spark, path).collect()) == list(range(1, 9))
    (tmp_path / "a" / "part-left.tar").write_bytes(b"of an attempt that failed")
    assert media.load(spark, path).count() == 8
    media.store(rows(9), path, "overwrite")
    assert [x.doc_id for x in media.load(spark, path).collect()] == [9]
    assert media.load(spark, str(tmp_path / "none")).count() == 0


def test_media_ranges_and_retries(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(media, "RANGE", 2000)
    df = spark.createDataFrame([(i, f"text {i} " * i) for i in range(200)], "doc_id long, text string").coalesce(1)
    writer = media.MediaWriter(str(tmp_path))
    said = writer.write(df.toArrow().to_batches())
    writer.commit([said, None])
    reader = media.MediaReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) > 3 and all(p.end - p.start <= 2000 for p in parts)
    store, base = media._store(str(tmp_path))
    calls = []

    class Flaky:
        def open_input_file(self, name):
            calls.append(name)
            if len(calls) % 2:
                raise OSError("lost")
            return store.open_input_file(name)

    monkeypatch.setattr(media, "_store", lambda path: (Flaky(), base))
    rows = [r for p in parts for b in reader.read(p) for r in pa.Table.from_batches([b]).to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(200))
    assert all(_png_samples(r["media"]).rstrip(b"\0") == (f"text {r['doc_id']} " * r["doc_id"]).encode() for r in rows)


@pytest.mark.parametrize("run", [substring.substring_query, simhash.simhash_query, lines.lines_query, sharding.sharded_query, mixing.mixed_query, media.media_query, simhash.one_per_group, mixing.mixed_docs])
def test_empty(empty, run):
    assert run(empty).count() == 0


def test_empty_decontamination(spark, empty, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontam_query(docs, items).count() == 0
    assert decontam.clean_docs(docs, items).count() == docs.count()
    assert decontam.decontam_query(empty, items).count() == 0
