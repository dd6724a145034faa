"""Items that repeat, share an id or have none are searched like any other."""

from collections import Counter

from pairloom.llm import decontam


def test_repeated_and_null_items(spark):
    words = [f"w{i}" for i in range(36)]  # 32 shingles
    other = [f"v{i}" for i in range(36)]
    # one word changed leaves 27 of 32 or more; over all places every shingle is lost once
    docs = [(k, " ".join(words[:k] + ["odd"] + words[k + 1 :])) for k in range(36)] + [(100 + k, " ".join(other[:k] + ["odd"] + other[k + 1 :])) for k in range(36)] + [(200, "of a row without id"), (201, "clean text of its own")]
    items = [(1, " ".join(words))] * 7 + [(1, " ".join(other))] + [(None, "of a row without id")] * 2
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontam.decontam_query(docs, items).collect())
    assert got == Counter([(k, 1) for k in range(36)] + [(100 + k, 1) for k in range(36)] + [(200, None)])
    assert [r.doc_id for r in decontam.clean_docs(docs, items).collect()] == [201]


def test_an_index_beyond_the_bound(spark, monkeypatch):
    """Joined by shuffle behind a bitmap, the index finds the same."""
    import random

    from pairloom.llm import shared

    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(30)) for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(i, f"{t} and more of it" if i % 2 else "nothing of the sort at all here") for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "item_id long, text string")
    once = sorted(map(tuple, decontam.decontam_query(docs, items).collect()))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(decontam, "BITMAP", 8)
    assert sorted(map(tuple, decontam.decontam_query(docs, items).collect())) == once and len(once) == 20
    assert decontam.clean_docs(docs, items).count() == 20


def test_short_items_in_long_documents(spark):
    """Items of one to four words at the start, in the middle and at the end, against plain search; longer items as before."""
    import random
    import re

    r = random.Random(9)
    items = ["alpha", "Alpha, beta!", "alpha beta gamma", "alpha beta gamma delta", "alpha beta gamma delta epsilon", "w1 w2", "...", None]
    docs = []
    for k, t in enumerate(t for t in items[:6]):
        rest = [f"w{r.randrange(40)}" for _ in range(600)]
        docs += [f"{t} {' '.join(rest)}", " ".join([*rest[:300], t, *rest[300:]]), f"{' '.join(rest)} {t}"]
    docs += ["alpha gamma beta", "alpha", "beta gamma", "alphabeta", "", None, "Alpha  BETA", "gamma delta epsilon alpha beta"]

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def runs(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = Counter()
    for d, t in enumerate(docs):
        for i, x in enumerate(items):
            w = words(x)
            if w:
                of = runs(w, min(5, len(w)))
                found = len(of & runs(words(t), min(5, len(w))))
                if found >= 0.8 * len(of):
                    want[d, i, len(of), found] += 1
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = decontam.decontam_query(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert Counter((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got.collect()) == want and len(want) > 40
