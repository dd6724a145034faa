"""The pipeline against its stages' plain definitions: brute force and SQL, one after the other."""

import duckdb
import pytest

import corpus_pipeline
from pairloom.llm import oracles, quality


def _fingerprint(t):
    import xxhash

    words = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _one_per_group(rows):
    """Of rows that links of up to 4 bits join, the one with the least id."""
    fps, group = [_fingerprint(r["text"]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for g, r in sorted(zip(group, rows), key=lambda x: x[1]["doc_id"]):
        best.setdefault(g, r)
    return list(best.values())


def test_pipeline_by_plain_definitions(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.quality_query(docs, labels).where("predicted = 1").collect()}
    rows = _one_per_group([r.asDict() for r in docs.collect() if r.doc_id in good])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")

    def table(rows):
        con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")] for r in rows])

    table(rows)
    leaks = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.DECONTAMINATION})").fetchall()}
    rows = [r for r in rows if r["doc_id"] not in leaks]
    table(rows)
    copies = dict(con.execute(f"SELECT doc_id, copies FROM ({oracles.MIXING})").fetchall())
    rows = [r for r in rows for _ in range(copies[r["doc_id"]])]
    table(rows)
    want = con.execute(f"SELECT doc_id, size, text_crc32, law, shard, slot, grown_shard FROM ({oracles.SHARDING})").fetchall()
    got = corpus_pipeline.run(spark, sf).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert leaks and len(want) > 50 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_quality_scores_by_hand(spark, sf):
    """The query's scores from plain counts and every pair of inputs, without the sum-of-squares identity."""
    import itertools
    import math
    from collections import Counter

    import numpy as np

    from pairloom.llm.shared import ByteHash

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    marks, space = set(b".,;:?!'\"-()"), set(b" \t\n\x0b\x0c\r")

    def letter(b):
        return 65 <= b <= 90 or 97 <= b <= 122 or b >= 128

    def odd(b):
        return not (letter(b) or 48 <= b <= 57 or b in marks or b in space)

    def share(x):
        return 0 if x <= 0 else min(max(math.floor(math.log2(max(x, 1e-9)) + 14), 1), 15)

    def column(word):
        data = np.frombuffer(word + b" ", np.uint8)
        return int(ByteHash(data).of(np.array([0]), np.array([len(word)]))[0]) % quality.WORD_COLUMNS

    def inputs(text):
        raw = (text or "").encode()
        words, size = raw.split(), max(len(raw), 1)
        n, counts = max(len(words), 1), Counter(words)
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        out = [(column(w), math.log1p(c) / norm) for w, c in counts.items()]
        upper = lambda w: sum(65 <= b <= 90 for b in w)
        stats = [
            share(upper(raw) / size), share(sum(48 <= b <= 57 for b in raw) / size), share(sum(map(odd, raw)) / size), share(sum(any(map(odd, w)) for w in words) / n), share(sum(upper(w) > 1 and sum(map(letter, w)) > 1 for w in words) / n),
            share(sum(a == b for a, b in itertools.pairwise(words)) / n), share(sum(w[-1] in marks for w in words) / n), min(int(15 * len(counts) / n), 15), min(int(15 * max(counts.values(), default=0) / n), 15),
            min(int(sum(map(len, words)) / n), 15), min(int(math.log2(len(words) + 1)), 15), min(max(int(math.log2(size + 1)) - 2, 0), 15),
        ]
        return out + [(quality.WORD_COLUMNS + quality.BINS * i + s, 0.5) for i, s in enumerate(stats)]

    rows = [r for r in docs.collect() if len(r.text or "") < 900][:40]
    scores = {r.doc_id: r.score for r in quality.quality_query(docs, labels).collect()}
    w, v = model.w.astype(np.float32).astype(float), model.v.astype(np.float32).astype(float)
    for r in rows:
        x = inputs(r.text)
        raw = model.w0 + sum(w[c] * a for c, a in x) + sum(float(v[c] @ v[d]) * a * b for (c, a), (d, b) in itertools.combinations(x, 2))
        assert scores[r.doc_id] == pytest.approx(1 / (1 + math.exp(-raw)), abs=2e-3)
    assert len(rows) == 40
