"""The draw of a source: long documents, unequal inclusion odds, dense cells."""

from pairloom.llm import mixing


def test_long_document_is_passed_over(spark):
    # 400 documents of 5 words and one of 2,000; 1,000 words are drawn, the long one ranks early and never fits
    text = " ".join(["w"] * 2000)
    long = next(i for i in range(10_000, 20_000) if 0.2 < _u(i, text) < 0.25)
    docs = spark.createDataFrame([(i, f"a b c d {i}", "s") for i in range(400)] + [(long, text, "s")], "doc_id long, text string, source string")
    out = mixing.mix(docs, budget=1.25, tilt=0).collect()
    assert abs(sum(r.taken for r in out) - 5000) <= 2.5
    assert next(r.copies for r in out if r.doc_id == long) == 1


def _u(i, text):
    import hashlib

    key = hashlib.md5(f"{mixing.SEED}|{i}|s|{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
    return (int(key[:13], 16) + 0.5) / (1 << 52)


def _prose(spark):
    # 300 documents of 5 words and 300 of 60: three binary digits against six
    return spark.createDataFrame([(i, " ".join([f"w{i}"] * (5 if i % 2 else 60)), "s") for i in range(600)], "doc_id long, text string, source string")


def test_unequal_odds_rank_the_draw(spark):
    out = mixing.mix(_prose(spark), budget=1.25).collect()
    more = {r.doc_id for r in out if r.copies > 1}
    assert abs(sum(r.taken for r in out) - 1.25 * 300 * 65) <= 2.5
    # expected copies are 3 and 6 times one number: of long documents one part in 4 is copied again, of short ones, under 1, none
    long, short = [sum(r.copies for r in out if r.size == n) / 300 for n in (60, 5)]
    level = 1.25 * 300 * 65 / (300 * (3 * 5 + 6 * 60))
    assert abs(long - 6 * level) < 0.01 and abs(short - 3 * level) < 0.1
    # a rank by the bare hash would take other rows
    u = {r.doc_id: _u(r.doc_id, " ".join([f"w{r.doc_id}"] * r.size)) for r in out}
    extra = {r.doc_id for r in out if r.copies > (r.size == 60)}
    assert extra != set(sorted(u, key=u.get)[: len(extra)]) and more


def test_dense_cells_are_cut_again(spark, monkeypatch):
    once = mixing.mix(_prose(spark), budget=1.25).select("doc_id", "copies").collect()
    monkeypatch.setattr(mixing, "DENSE", 1)
    assert sorted(once) == sorted(mixing.mix(_prose(spark), budget=1.25).select("doc_id", "copies").collect())
