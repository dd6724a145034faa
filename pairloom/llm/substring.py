"""Substring dedup by fixed-block anchors.

A window of `width` words always holds one whole block of a grid with pitch
(width + 1) // 2. So the grid blocks of every document are indexed, all rolling
windows of a block's length probe the index, and a block that a second window
hits is an anchor. Anchors are extended to maximal exact repeats window by window: of
the `width`-word windows that hold an anchor, those whose word sequence occurs again
are kept, and neighbours among them are joined into one span, whose words are removed.

Neither step pairs documents up: both count equal hashes. Probes travel as packed
40-bit remainders in hash buckets (a chance hit only costs windows that the second
step refutes). Windows are told apart by 96 bits and more of two hashes over XXH3
values of their words.

What repeats inside one batch, or was sent by an earlier batch of the task, is settled
there: its places go on by their own document, and its hash is sent once. So a passage
with very many copies brings its bucket an entry a task, and the places of its copies
are spread over all buckets. The number of buckets follows the words, so a bucket's
size does not.

Rows with equal id and text are separate occurrences; their key (96 bits) and result
agree.

Cases: null and empty texts have no words; texts shorter than the window stay
whole; a null doc_id is kept; an empty table gives no rows; extra columns are
kept by `dedup` unless named like one of its own, which it replaces.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import WORD_BASES, forget, hashed_words, mix, pieces, rolling, row_key, utf8, words_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that are worked on at once; a longer text is worked on whole.
PIECE = 2 << 20
#: Bytes of text a bucket stands for.
BUCKET = 12 << 20
#: Hashes that a task remembers to have sent as repeated; a forgotten one is only sent again.
SENT = 1 << 19
OWN = ("n_words", "n_removed", "kept", "kept_sha256", "spans")
_PACKED = "bucket int, key binary, pos binary, hash binary, twice binary"
_KEY = np.dtype([("a", "<i8"), ("b", "<i4")])
_WINDOW = np.dtype([("h", "<u8"), ("o", "<u4")])


def bucket_bits(text_bytes: int) -> int:
    """How many leading bits of a hash name its bucket."""
    return min(max((text_bytes // BUCKET).bit_length(), 4), 24)


def _runs(x: np.ndarray):
    """(value, from, to) over equal neighbours."""
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    edges = [0, *cut.tolist(), len(x)]
    return [(int(x[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


class _Sent:
    """Hashes, with a second one each, that this task sent as repeated."""

    def __init__(self):
        self.h, self.o = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def has(self, h: np.ndarray, o: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return (self.h[i] == h) & (self.o[i] == o)

    def add(self, h: np.ndarray, o: np.ndarray) -> None:
        if len(self.h) + len(h) > SENT:
            self.h, self.o = self.h[:0], self.o[:0]
        if len(h) <= SENT:
            all_, at = np.unique(np.concatenate([self.h, h]), return_index=True)
            self.h, self.o = all_, np.concatenate([self.o, o])[at]


def _short(h: np.ndarray) -> bytes:
    """The lowest 40 bits of each hash."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _joined(table, name: str) -> bytes:
    return b"".join(table.column(name).to_pylist())


def _keys(b) -> np.ndarray:
    out = np.empty(len(b), _KEY)
    out["a"], out["b"] = b.column("a").to_numpy(), b.column("b").to_numpy()
    return out


def _record(rows: list[tuple]):
    import pyarrow as pa

    names = ("bucket", "key", "pos", "hash", "twice")
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _settled(key: np.ndarray, pos: np.ndarray, bits: int) -> list[tuple]:
    """Rows of places that need no comparison, dealt over negative buckets by their document."""
    part = _top(key["a"].copy(), bits)
    order = np.argsort(part, kind="stable")
    key, pos = key[order], pos[order]
    return [(-1 - k, key[x:y].tobytes(), pos[x:y].tobytes(), b"", b"") for k, x, y in _runs(part[order])]


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and whether each occurs more than once."""
    h = np.sort(h)
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(first)
    return h[at], np.diff(np.append(at, len(h))) > 1


def _in(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(h), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a piece: its text's number, its place in the text, and the text's size in words."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    return doc, np.arange(at[-1]) - at[doc], n[doc]


def _probes(batches, width: int, bits: int):
    """Packed grid blocks (key, pos) and rolling probes of each batch, a row for each bucket it touches."""
    block, sent = (width + 1) // 2, _Sent()
    for b in batches:
        texts, keys = utf8(b.column("text")), _keys(b)
        for lo, hi in pieces(texts, PIECE):
            words, at = hashed_words(texts[lo:hi])
            doc, place, size = _places(at)
            h = rolling(words, block, WORD_BASES[0])
            inside = np.flatnonzero((place + block <= size) & (size >= width))  # blocks that end in their text
            if not len(inside):
                continue
            probe, twice = _counted(h[inside])
            grid = inside[place[inside] % block == 0]
            gh, gk, gp = h[grid], keys[lo + doc[grid]], place[grid].astype(np.uint32)
            again = _in(probe[twice], gh) | sent.has(gh, gh)
            rows = _settled(gk[again], gp[again], bits) if again.any() else []
            new = ~sent.has(probe, probe)
            sent.add(probe[twice & new], probe[twice & new])
            probe, twice = probe[new], twice[new]
            gh, gk, gp = gh[~again], gk[~again], gp[~again]
            order = np.argsort(gh, kind="stable")
            gh, gk, gp = gh[order], gk[order], gp[order]
            own = {k: (x, y) for k, x, y in _runs(_top(gh, bits))}
            for k, x, y in _runs(_top(probe, bits)):
                u, v = own.pop(k, (0, 0))
                rows.append((k, gk[u:v].tobytes(), gp[u:v].tobytes(), _short(gh[u:v]), _short(probe[x:y]) + np.packbits(twice[x:y]).tobytes()))
            if rows:
                yield _record(rows)


def _anchors(table):
    """One bucket: the grid blocks that more than one rolling window equals."""
    import pyarrow as pa

    key, pos = np.frombuffer(_joined(table, "key"), _KEY), np.frombuffer(_joined(table, "pos"), np.uint32)
    if table.column("bucket")[0].as_py() >= 0:
        h = _long(_joined(table, "hash"))
        blocks, which = np.unique(h, return_inverse=True)
        seen = np.zeros(len(blocks), np.int64)
        for t in table.column("twice").to_pylist() if len(blocks) else ():
            n = len(t) * 8 // 41  # n entries take 5 n bytes and n bits
            while 5 * n + (n + 7) // 8 < len(t):
                n += 1
            probe = _long(t[: 5 * n])
            times = np.unpackbits(np.frombuffer(t[5 * n :], np.uint8), count=n) + np.uint8(1)
            i = np.minimum(np.searchsorted(blocks, probe), len(blocks) - 1)
            hit = blocks[i] == probe
            np.add.at(seen, i[hit], times[hit])
        found = seen[which] > 1 if len(blocks) else np.zeros(0, bool)
        key, pos = key[found], pos[found]
    return pa.table({"a": np.ascontiguousarray(key["a"]), "b": np.ascontiguousarray(key["b"]), "pos": pos.astype(np.int32)})


def _windows(batches, width: int, bits: int):
    """Packed `width`-word windows around the anchors; those that occur twice in the task are settled at once."""
    block, sent = (width + 1) // 2, _Sent()
    for b in batches:
        texts, keys, anchors = utf8(b.column("text")), _keys(b), b.column("anchors")
        for lo, hi in pieces(texts, PIECE):
            words, at = hashed_words(texts[lo:hi])
            doc, place, size = _places(at)
            own = anchors.slice(lo, hi - lo)
            pos, of = own.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(hi - lo), own.value_lengths().to_numpy())
            n = np.maximum(np.diff(at) - width + 1, 0)[of]
            near = np.zeros(len(words) + 1, np.int32)  # windows from pos - (width - block) to pos hold the block
            np.add.at(near, at[of] + np.clip(pos - (width - block), 0, n), 1)
            np.add.at(near, at[of] + np.clip(pos + 1, 0, n), -1)
            start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            if not len(start):
                continue
            h, other = (rolling(words, width, base)[start] for base in WORD_BASES)
            key, pos = keys[lo + doc[start]], place[start].astype(np.uint32)
            order = np.lexsort((h, other))  # buckets by one hash; the other is sent whole
            h, other, key, pos = h[order], other[order], key[order], pos[order]
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = (h[1:] == h[:-1]) & (other[1:] == other[:-1])
            code = mix(h ^ other)
            before = sent.has(code, h)
            twice, first = same[1:] | same[:-1], ~same[:-1]
            rows = _settled(key[twice | before], pos[twice | before], bits) if (twice | before).any() else []
            many = first & twice & ~before
            sent.add(code[many], h[many])
            record = np.empty(len(h), _WINDOW)
            record["h"], record["o"] = h, other & np.uint64(0xFFFFFFFF)
            a, d = np.flatnonzero(~twice & ~before), np.flatnonzero(many)
            single = {k: a[x:y] for k, x, y in _runs(_top(other[a], bits))}
            double = {k: d[x:y] for k, x, y in _runs(_top(other[d], bits))}
            none = a[:0]
            for k in single.keys() | double.keys():
                x, y = single.get(k, none), double.get(k, none)
                rows.append((k, key[x].tobytes(), pos[x].tobytes(), record[x].tobytes(), record[y].tobytes()))
            if rows:
                yield _record(rows)


def _repeated(table) -> tuple[np.ndarray, np.ndarray]:
    """One bucket: the places of single windows that occur elsewhere too."""
    key, pos = np.frombuffer(_joined(table, "key"), _KEY), np.frombuffer(_joined(table, "pos"), np.uint32)
    if table.column("bucket")[0].as_py() < 0:
        return key, pos
    one, many = (np.frombuffer(_joined(table, c), _WINDOW) for c in ("hash", "twice"))
    all_ = np.concatenate([one, many])
    order = np.lexsort((all_["o"], all_["h"]))
    new = np.ones(len(all_) + 1, bool)
    new[1:-1] = (all_["h"][order][1:] != all_["h"][order][:-1]) | (all_["o"][order][1:] != all_["o"][order][:-1])
    # a single is found if it has an equal neighbour; what was repeated somewhere is settled there
    alone = np.empty(len(all_), bool)
    alone[order] = new[1:] & new[:-1]
    found = ~alone[: len(one)]
    return key[found], pos[found]


def _marks(key: np.ndarray, pos: np.ndarray, bits: int):
    """Marks dealt by the leading bits of their key: rows (part, key, pos packed)."""
    return [(-1 - k, x, y) for k, x, y, _, _ in _settled(key, pos, min(bits, 16))]


def _spans(key: np.ndarray, pos: np.ndarray, width: int):
    """For each document the maximal runs of removed words: (a, b, packed (from, to) pairs)."""
    order = np.lexsort((pos, key["b"], key["a"]))
    key, pos = key[order], pos[order].astype(np.int64)
    other = np.ones(len(key), bool)
    other[1:] = key[1:] != key[:-1]
    new = other.copy()
    new[1:] |= pos[1:] > pos[:-1] + width
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(key)) - 1
    pairs = np.stack([pos[at], pos[last] + width], 1).astype(np.uint32)
    begins = np.flatnonzero(other[at])
    ends = np.append(begins[1:], len(at))
    return [(int(key["a"][at[x]]), int(key["b"][at[x]]), pairs[x:y].tobytes()) for x, y in zip(begins, ends, strict=True)]


def repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """a, b (a document's key), spans (packed uint32 pairs: word from, word to) of the documents that hold repeated windows; written."""
    import pyarrow as pa

    rows = _keyed(docs).select("a", "b", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(total)

    def probes(batches):
        yield from _probes(batches, width, bits)

    def anchors(table: pa.Table) -> pa.Table:
        return _anchors(table)

    found = written(rows.mapInArrow(probes, _PACKED).groupBy("bucket").applyInArrow(anchors, "a long, b int, pos int"), "substring-anchors")
    by_row = found.groupBy("a", "b").agg(F.collect_set("pos").alias("anchors"))  # as many as the text has blocks

    def windows(batches):
        yield from _windows(batches, width, bits)

    def marks(table: pa.Table) -> pa.Table:
        out = _marks(*_repeated(table), bits)
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "key": pa.array([x[1] for x in out], pa.binary()), "pos": pa.array([x[2] for x in out], pa.binary())})

    packed = written(rows.join(by_row, ["a", "b"]).select("a", "b", "text", "anchors").mapInArrow(windows, _PACKED), "substring-windows")
    forget(found)

    def spans(batches):
        # each part's marks by key: sorted by part, so a part ends where the next begins
        held: list[tuple[bytes, bytes]] = []
        part = None
        for b in batches:
            for p, k, q in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part and held:
                    yield _span_batch(held, width)
                    held = []
                part = p
                held.append((k, q))
        if held:
            yield _span_batch(held, width)

    dealt = packed.groupBy("bucket").applyInArrow(marks, "part int, key binary, pos binary").repartition("part").sortWithinPartitions("part")
    out = written(dealt.mapInArrow(spans, "a long, b int, spans binary"), "substring-spans")
    forget(packed)
    return out


def _span_batch(held: list[tuple[bytes, bytes]], width: int):
    import pyarrow as pa

    key = np.frombuffer(b"".join(x[0] for x in held), _KEY)
    pos = np.frombuffer(b"".join(x[1] for x in held), np.uint32)
    out = _spans(key, pos, width)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["a", "b", "spans"])


def _keyed(docs: DataFrame) -> DataFrame:
    """row (the columns of docs), text, and the document's key (a, b)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", row_key().alias("key"))
    return rows.select("row", "text", F.col("key.a").alias("a"), F.shiftright(F.col("key.b"), 32).cast("int").alias("b"))


def cut(text: bytes, spans: bytes | None) -> tuple[int, int, bytes]:
    """Words, removed words, and what is left, its words joined by one space."""
    gone = np.frombuffer(spans or b"", np.uint32).reshape(-1, 2).astype(np.int64)
    kept, n, n_kept = [], 0, 0
    for words in words_of(text):
        at = 0
        for x, y in gone[(gone[:, 1] > n) & (gone[:, 0] < n + len(words))] - n:
            if x > at:
                kept.append(b" ".join(words[at:x]))
                n_kept += x - at
            at = max(at, y)
        if at < len(words):
            kept.append(b" ".join(words[at:]))
            n_kept += len(words) - at
        n += len(words)
    return n, n - int(n_kept), b" ".join(kept)


def dedup(docs: DataFrame, width: int = 35) -> DataFrame:
    """docs with n_words, n_removed, kept (the text without repeats), kept_sha256 and spans [from, to) of removed words."""
    rows = _keyed(docs).join(repeats(docs, width), ["a", "b"], "left").select("row", "text", "spans")

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
        for b in batches:
            texts, spans = utf8(b.column("text")), b.column("spans").to_pylist()
            for lo, hi in pieces(texts, PIECE):
                out = []
                for t, s in zip(texts[lo:hi], spans[lo:hi], strict=True):
                    n, gone, kept = cut(t, s)
                    out.append((n, gone, kept.decode(), hashlib.sha256(kept).hexdigest(), [tuple(x) for x in np.frombuffer(s or b"", np.uint32).reshape(-1, 2).tolist()]))
                yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, hi - lo), *[pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]], ["row", *OWN])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string, kept_sha256 string, spans array<struct<from:long,to:long>>")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in OWN], *OWN)


def substring_query(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
