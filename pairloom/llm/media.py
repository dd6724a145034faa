"""Media columns: a Spark data source over archives of 8-bit greyscale images.

A payload (UTF-8 text, padded with zero bytes to a positive multiple of 64) is
stored losslessly as the samples of a PNG 64 pixels wide. Images are the members of
tar archives in one directory. The source's writer streams rows into an archive of its
own attempt; a commit adds a manifest that names the archives of the attempts that
succeeded, so what failed attempts leave is never read and a later write adds to what
is there (or replaces it, with mode overwrite).

The reader lists the directory and cuts every committed archive into byte ranges by its
size alone. A member belongs to the range in which its header begins. Every member's
name begins with the archive's random marker, so a range finds its first member by
looking for a tar header with that marker at multiples of 512. From there it reads
members by offset, each retried on its own with a fresh file handle, and streams them
in Arrow batches bounded in bytes. Files are opened with pyarrow's filesystems, so the
directory may lie in any store these reach.

Images are packed and unpacked in pieces: beside the value itself, a task holds one
piece of its samples. Statistics are whole numbers up to the last division.

Cases: a null text is the empty payload of 64 zero bytes; a null doc_id is kept;
rows that repeat are members of their own; an empty table makes a manifest without
archives and no rows, as does a directory without manifests; extra columns are
ignored; a text is stored whole, however long. Equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import tarfile
import uuid
import zlib

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pairloom.llm.shared import new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 64
#: Bytes of archive in one read partition, and bytes of images in one Arrow batch.
RANGE = 8 << 20
BATCH = 1 << 20
#: Rows of an image that are packed or unpacked at once.
ROWS = 1 << 13
TRIES = 3
_BLOCK = 512
_MAGIC, _END = b"\x89PNG\r\n\x1a\n", b"\0\0\0\0IEND\xaeB`\x82"


def _values(column):
    """The values of an Arrow string or binary column one by one, as buffers (null: empty) that are not copied."""
    import pyarrow as pa

    for x in column.cast(pa.binary()):
        yield memoryview(x.as_buffer()).cast("B") if x.is_valid else memoryview(b"")


def padded_size(n_bytes: int) -> int:
    """The least positive multiple of 64 that holds so many bytes."""
    return max(-(-n_bytes // WIDTH), 1) * WIDTH


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(text) -> bytes:
    """A PNG whose 8-bit samples are the text's bytes and zeros up to whole rows of 64; a text chunk holds the unpadded length."""
    n_bytes = len(text)
    height = padded_size(n_bytes) // WIDTH
    out = [_MAGIC, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)), _chunk(b"tEXt", b"Comment\0" + str(n_bytes).encode())]
    pack = zlib.compressobj(6)
    for at in range(0, height, ROWS):
        rows = np.zeros((min(ROWS, height - at), WIDTH + 1), np.uint8)  # a filter byte 0 before each row
        own = np.frombuffer(text[at * WIDTH : (at + len(rows)) * WIDTH], np.uint8)
        whole = len(own) // WIDTH
        rows[:whole, 1:] = own[: whole * WIDTH].reshape(-1, WIDTH)
        if len(own) % WIDTH:
            rows[whole, 1 : 1 + len(own) % WIDTH] = own[whole * WIDTH :]
        body = pack.compress(rows) + (pack.flush() if at + ROWS >= height else b"")
        if body:
            out.append(_chunk(b"IDAT", body))
    out.append(_chunk(b"IEND", b""))
    return b"".join(out)


def _chunks(image):
    """(kind, body) of a PNG's chunks, their checksums compared."""
    image = memoryview(image)
    if image[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at = 8
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = bytes(image[at + 4 : at + 8]), image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        yield kind, body
        at += n + 12


def unpadded(image) -> int:
    """The length before padding, as an image that `encode` made says it."""
    return next(int(bytes(body).partition(b"\0")[2]) for kind, body in _chunks(image) if kind == b"tEXt")


def samples(image):
    """The samples of an image that `encode` made, in pieces of whole rows."""
    unpack, left, most = zlib.decompressobj(), b"", ROWS * (WIDTH + 1)
    for kind, body in _chunks(image):
        while kind == b"IDAT" and len(body):
            rows = left + unpack.decompress(body, most)
            body, whole = unpack.unconsumed_tail, len(rows) // (WIDTH + 1) * (WIDTH + 1)
            left = rows[whole:]
            if whole:
                yield np.frombuffer(rows, np.uint8, whole).reshape(-1, WIDTH + 1)[:, 1:].ravel()
    rows = left + unpack.flush()
    if rows:
        yield np.frombuffer(rows, np.uint8).reshape(-1, WIDTH + 1)[:, 1:].ravel()


def described(image) -> dict:
    """What an image says of its payload: sizes, checksums, and a feature of sample statistics.

    The feature holds the mean, deviation, mean step between neighbours, and a coarse histogram.
    """
    sha, tail, size, steps, last = hashlib.sha256(), b"", 0, 0, None
    counts = np.zeros(256, np.int64)
    for x in samples(image):
        sha.update(x)
        tail = x[-WIDTH:].tobytes()
        size += len(x)
        counts += np.bincount(x, minlength=256)
        steps += int(np.where(x[1:] > x[:-1], x[1:] - x[:-1], x[:-1] - x[1:]).sum(dtype=np.int64))
        steps += abs(int(x[0]) - last) if last is not None else 0
        last = int(x[-1])
    value = np.arange(256)
    total, squares = int((counts * value).sum()), int((counts * value**2).sum())
    deviation = max(size * squares - total * total, 0) ** 0.5 / size
    bins = counts.reshape(8, 32).sum(1)
    feature = f"mean={total / size:.4f};std={deviation:.4f};step={steps / (size - 1):.4f};hist=" + ",".join(map(str, bins.tolist()))
    return {"n_bytes": unpadded(image), "payload_bytes": size, "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(), "feature": feature}


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


class Written(WriterCommitMessage):
    def __init__(self, archive: str | None):
        self.archive = archive


def _marker(file: str) -> str:
    """What the names of an archive's members begin with: the random part of the archive's own name."""
    return file.removeprefix("part-").removesuffix(".tar")


def _manifests(store, base: str) -> dict[str, list[str]]:
    """Path of each manifest and the archives it names."""
    from pyarrow import fs

    out = {}
    for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"):
            with store.open_input_stream(f.path) as x:
                out[f.path] = json.loads(x.read())
    return out


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        """One archive for a task; its name is the attempt's own, so attempts never meet."""
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        marker, out = uuid.uuid4().hex, None
        file = f"part-{marker}.tar"
        for b in iterator:
            for doc_id, text in zip(b.column("doc_id"), _values(b.column("text")), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{base}/{file}")
                image = encode(text)
                info = tarfile.TarInfo(f"{marker}/{doc_id.as_py() if doc_id.is_valid else 'null'}.png")
                info.size = len(image)
                out.write(info.tobuf(tarfile.GNU_FORMAT))
                out.write(image)
                out.write(b"\0" * (-len(image) % _BLOCK))
        if out is None:
            return Written(None)
        out.write(b"\0" * 2 * _BLOCK)  # the end of a tar archive
        out.close()
        return Written(file)

    def commit(self, messages):
        """A manifest of this write's own; with overwrite, what older ones name goes after it is there."""
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        old = _manifests(store, base) if self.overwrite else {}
        with store.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([m.archive for m in messages if m and m.archive]).encode())
        for path, archives in old.items():
            store.delete_file(path)
            for a in archives:
                store.delete_file(f"{base}/{a}")

    def abort(self, messages):
        store, base = _store(self.path)
        for m in messages:
            if m and m.archive:
                store.delete_file(f"{base}/{m.archive}")


class _Archive:
    """Reads at offsets; every read is tried again with a new handle."""

    def __init__(self, store, name: str):
        self.store, self.name, self.file = store, name, None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = None

    def tried(self, read):
        for left in range(TRIES - 1, -1, -1):
            try:
                if self.file is None:
                    self.file = self.store.open_input_file(self.name)
                return read(self.file)
            except (OSError, ValueError):
                self.close()
                if not left:
                    raise
        raise AssertionError

    def at(self, offset: int, size: int) -> bytes:
        def read(f):
            f.seek(offset)
            return f.read(size)

        return self.tried(read)

    def member(self, offset: int, marker: str) -> tuple[int | None, bytes, int] | None:
        """Id, image and the next offset of the member at an offset; None at the end of the archive."""

        def read(f):
            f.seek(offset)
            head = f.read(_BLOCK)
            if head == b"\0" * _BLOCK:
                return None
            info = _header(head, marker)
            if info is None:
                raise OSError("no member here")
            image = f.read(info.size)
            if len(image) != info.size or image[-12:] != _END:
                raise OSError("damaged member")
            stem = info.name.partition("/")[2].removesuffix(".png")
            return None if stem == "null" else int(stem), image, offset + _BLOCK + info.size + -info.size % _BLOCK

        return self.tried(read)


def _header(block: bytes, marker: str) -> tarfile.TarInfo | None:
    """The tar header in a block, if it is one of a member with the archive's marker."""
    if not block.startswith(marker.encode()):
        return None
    try:
        return tarfile.TarInfo.frombuf(block, "utf-8", "strict")  # compares the header's checksum
    except tarfile.TarError:
        return None


class MediaReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        """Byte ranges of the committed archives, from the directory's listing."""
        from pyarrow import fs

        store, base = _store(self.path)
        known = {a for archives in _manifests(store, base).values() for a in archives}
        out = []
        for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if f.base_name in known:
                out += [Range(f.base_name, x, min(x + RANGE, f.size)) for x in range(0, f.size, RANGE)]
                known.discard(f.base_name)
        if known:
            raise FileNotFoundError(f"{len(known)} archives are missing, {min(known)} among them")
        return out

    def _first(self, archive: _Archive, start: int, end: int, marker: str) -> int | None:
        """Where the first member of a range begins: the first header at a multiple of 512."""
        at = start + -start % _BLOCK
        while at < end:
            found = archive.at(at, min(1 << 16, end - at + _BLOCK))
            for i in range(0, min(len(found), end - at), _BLOCK):
                if _header(found[i : i + _BLOCK], marker):
                    return at + i
            at += 1 << 16
        return None

    def read(self, partition):
        import pyarrow as pa

        if partition is None:
            return
        store, base = _store(self.path)
        marker, archive = _marker(partition.file), _Archive(store, f"{base}/{partition.file}")
        ids, images, size = [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["doc_id", "media"])

        try:
            at = self._first(archive, partition.start, partition.end, marker)
            while at is not None and at < partition.end:
                found = archive.member(at, marker)
                if found is None:
                    break
                doc_id, image, at = found
                ids.append(doc_id)
                images.append(image)
                size += len(image)
                if size >= BATCH:
                    yield batch()
                    ids, images, size = [], [], 0
            if ids:
                yield batch()
        finally:
            archive.close()


class MediaSource(DataSource):
    """Options: path, the folder of archives. Write rows (doc_id, text); read rows (doc_id, media)."""

    @classmethod
    def name(cls):
        return "pairloom_media"

    def schema(self):
        return "doc_id long, media binary"

    def reader(self, schema):
        return MediaReader(self.options["path"])

    def writer(self, schema, overwrite):
        return MediaWriter(self.options["path"], overwrite)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaSource)
    # Spark looks registered sources up in the thread's active session
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)


def store(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Write the texts of docs as archives in a directory; mode append adds to it, overwrite replaces what it holds."""
    _register(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.write.format("pairloom_media").mode(mode).save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, media of every member of the archives in a directory."""
    _register(spark)
    return spark.read.format("pairloom_media").load(path)


def decoded(media: DataFrame, payload: bool = False) -> DataFrame:
    """The media columns: what each stored image says of its payload; with `payload`, its bytes too."""
    kinds = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"} | ({"payload": "binary"} if payload else {})

    def run(batches):
        import pyarrow as pa

        arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for b in batches:
            for at in range(0, len(b), 1024):  # what is made of a batch leaves in pieces
                part = b.slice(at, 1024)
                out: dict[str, list] = {k: [] for k in kinds}
                for image in _values(part.column("media")):
                    row = described(image) | ({"payload": b"".join(x.tobytes() for x in samples(image))} if payload else {})
                    for k in kinds:
                        out[k].append(row[k])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(out[k], arrow[kind]) for k, kind in kinds.items()]], ["doc_id", *kinds])

    return media.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {kind}" for k, kind in kinds.items()))


def media_query(docs: DataFrame) -> DataFrame:
    path = new_path(docs.sparkSession, "media")
    store(docs, path)
    return decoded(load(docs.sparkSession, path))
