"""Token ids in binary files: documents compressed one by one with a shared zstandard dictionary.

A file has a header (magic, id width, SHA-256 of the dictionary), the documents' frames, an index (ids, offsets, counts) and a
footer that says where the index is. So one short document can be read with two small reads and the dictionary. The dictionary
is trained on the serialized ids of at most SAMPLE_DOCS short documents and stored beside the files.

Documents are dealt by ranges of their id, so files in order of (part, number) are in order of ids. Files go through
``pyarrow.fs`` to the shared folder under names of the task attempt's own; only files that a finished task reported count.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.blocks import lean, slices, small_batches
from palimpsest.llm.ngram_join import PLAIN_KEY, loads, run_hashes
from palimpsest.storage import local_or_uri, materialize, new_path

END_ID = 0
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 16_000
DICT_BYTES = 64 << 10
FILE_BYTES = 128 << 20
LEVEL = 3
#: Pieces and their bytes that a worker remembers (beyond either it forgets them all), bytes of text whose pieces are looked up at once, pieces encoded in one run.
CACHE_PIECES = 1_000_000
CACHE_BYTES = 64 << 20
GROUP_BYTES = 2 << 20
STEP_BYTES = 1 << 18
RUN = 20
MAGIC = b"IDSTORE1"
HEADER = struct.Struct("<8sI32s")
FOOTER = struct.Struct("<qq8s")
#: Bytes next to which a text isn't cut: blanks and controls, and the first bytes of characters that some definition counts as blank.
ODD_BYTE = np.zeros(256, bool)
ODD_BYTE[:33] = ODD_BYTE[127] = True
ODD_LEAD = np.zeros(256, bool)
ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of a slice's texts: each text's start, and each lone space or line feed between two plain characters."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    start[offsets[:-1]] = True
    if n > 2:
        lead = ODD_LEAD[data]
        after = lead.copy()  # a byte of a character of up to three bytes behind an odd first byte
        after[1:] |= lead[:-1]
        after[2:] |= lead[:-2]
        middle = data[1:-1]
        cut = ((middle == 32) | (middle == 10)) & ~ODD_BYTE[data[:-2]] & ~after[:-2] & ~ODD_BYTE[data[2:]] & ~lead[2:]
        inside = np.ones(n + 1, bool)  # the neighbours must be of the same text
        inside[offsets[1:-1] - 1] = False
        start[1 : n - 1] |= cut & inside[1 : n - 1]
    start[n] = False
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts as bytes.

    Byte-level BPE with the usual pattern never joins bytes across a lone space or line feed between two plain characters. So texts
    are cut there, each distinct piece is encoded once, and its ids are copied to where it occurs. Pieces are found by a hash; every
    occurrence is compared byte by byte with the piece whose ids it gets. That encoded runs of pieces really end where the pieces do is
    checked by the tokens' byte lengths; if either fails, or with a tokenizer of another kind, texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        split = self.tokenizer.pre_tokenizer
        self.cuttable = isinstance(split, ByteLevel) and not split.add_prefix_space and split.use_regex and self.tokenizer.normalizer is None and isinstance(self.tokenizer.model, BPE)
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self._forget()

    def _forget(self) -> None:
        """Empty the memory of pieces: sorted hashes, where their ids and bytes begin and how many they are."""
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count, self.raw_at, self.raw_size = (np.zeros(0, np.int32) for _ in range(4))
        self.flat, self.raw = np.zeros(0, self.kind), np.zeros(0, np.uint8)

    def _ids(self, texts: list[str], step: int = 500) -> Iterator[list[int]]:
        for a in range(0, len(texts), step):
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + step], add_special_tokens=False))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(i, self.kind).tobytes() for i in self._ids(texts, 50)]

    def _learn(self, pieces: list[bytes], joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, count of each piece) for new pieces, the joinable ones in runs; None if a run of pieces doesn't end where they do."""
        plain, odd = np.flatnonzero(joinable).tolist(), np.flatnonzero(~joinable).tolist()
        runs = [b"".join([pieces[i] for i in plain[a : a + RUN]]).decode() for a in range(0, len(plain), RUN)]
        ids = np.fromiter(itertools.chain.from_iterable(self._ids(runs)), np.int64)
        ends = np.cumsum(self.token_bytes[ids])
        want = np.cumsum([len(pieces[i]) for i in plain])
        at = np.searchsorted(ends, want)
        if len(want) and (at[-1] >= len(ends) or not np.array_equal(ends[at], want)):
            return None
        count = np.zeros(len(pieces), np.int64)
        count[plain] = np.diff(at, prepend=-1)
        alone = list(self._ids([pieces[i].decode() for i in odd]))
        count[odd] = [len(x) for x in alone]
        out = np.zeros(int(count.sum()), self.kind)
        place = np.cumsum(count) - count
        mine = np.zeros(len(out), bool)
        for i, x in zip(odd, alone, strict=True):
            out[place[i] : place[i] + len(x)] = x
            mine[place[i] : place[i] + len(x)] = True
        out[~mine] = ids
        return out, count

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """Serialized ids of each text of an Arrow column, without an end id; null counts as empty."""
        for a, b, data, offsets in slices(column, GROUP_BYTES):
            yield from self._group(column[a:b], data, offsets)

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(self.encode_column(pa.array(texts, pa.string())))

    def _group(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        if not self.cuttable:
            yield from self.whole([t or "" for t in column.to_pylist()])
            return
        if len(self.keys) > CACHE_PIECES or len(self.raw) > CACHE_BYTES:
            self._forget()
        empty = np.diff(offsets) == 0
        starts = [np.unique(offsets[base : stop + 1]) for base, stop in _steps(offsets)]
        starts = [cuts(data[o[0] : o[-1]], o - o[0]) + o[0] for o in starts if len(o) > 1]
        if not starts:
            yield from [b""] * len(column)
            return
        start = np.concatenate(starts)
        end = np.append(start[1:], len(data))
        length = end - start
        kinds, sample, which = np.unique(run_hashes(data, loads(data), start, end, PLAIN_KEY), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, kinds)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == kinds if len(self.keys) else np.zeros(len(kinds), bool)
        old, fresh = np.flatnonzero(known), np.flatnonzero(~known)
        twin, seen = sample[which], sample[old]
        good = np.array_equal(length, length[twin]) and np.array_equal(length[seen], self.raw_size[at[old]])
        good = good and same_bytes(data, start, data, start[twin], length) and same_bytes(data, start[seen], self.raw, self.raw_at[at[old]], length[seen])
        s, n = start[sample[fresh]], length[sample[fresh]]
        if good:
            joinable = ((data[s] == 32) | (data[s] == 10)) & ~ODD_BYTE[data[s + n - 1]]
            for k in (1, 2, 3):
                joinable &= ~ODD_LEAD[data[np.maximum(s, s + n - k)]]
            pieces = [data[a:b].tobytes() for a, b in zip(s.tolist(), (s + n).tolist(), strict=True)]
            learned = self._learn(pieces, joinable)
            good = learned is not None
        if not good:  # two pieces with one hash, or a tokenizer that joins what was cut
            yield from self.whole([t or "" for t in column.to_pylist()])
            return
        ids, count = learned
        first, size = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        first[known], size[known] = self.first[at[known]], self.count[at[known]]
        first[fresh], size[fresh] = np.cumsum(count) - count + len(self.flat), count
        flat = self.flat = np.concatenate([self.flat, ids])
        raw_at = np.cumsum(n) - n + len(self.raw)
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(pieces), np.uint8)])
        place = np.searchsorted(self.keys, kinds[fresh])
        self.keys = np.insert(self.keys, place, kinds[fresh])
        for name, new in (("first", first[fresh]), ("count", count), ("raw_at", raw_at), ("raw_size", n)):
            setattr(self, name, np.insert(getattr(self, name), place, new))
        text_at = np.searchsorted(start, offsets)  # the first piece of each text
        for base, stop in _steps(offsets):
            p, q = int(text_at[base]), int(text_at[stop])
            n = size[which[p:q]]
            before = np.cumsum(n) - n
            total = int(n.sum())
            got = flat[np.repeat(first[which[p:q]] - before, n) + np.arange(total)].tobytes()
            edge = np.append(before, total)[text_at[base : stop + 1] - p] * self.width
            for i in range(stop - base):
                yield got[edge[i] : edge[i + 1]] if not empty[base + i] else b""


def same_bytes(one: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, length: np.ndarray, step: int = STEP_BYTES) -> bool:
    """Whether ``one[at[i]:at[i] + length[i]]`` equals the same length of ``other`` from ``there[i]`` for each i."""
    ends = np.cumsum(length)
    a = 0
    while a < len(length):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
        n = length[a:b]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(one[np.repeat(at[a:b], n) + place], other[np.repeat(there[a:b], n) + place]):
            return False
        a = b
    return True


def _steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about STEP_BYTES."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP_BYTES, "right")) - 1)
        yield a, b
        a = b


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer, so that its pieces serve all tasks of the process."""
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> bytes:
    """A dictionary from the ids of at most ``sample_docs`` whole documents of at most ``sample_chars`` characters; empty if there are too few.

    The documents are those with the smallest hashes; a threshold leaves about twice as many in all tasks together.
    """
    few = docs.where((F.length("text") > 0) & (F.length("text") <= sample_chars)).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("h"))
    threshold = min(1 << 40, (1 << 41) * sample_docs // max(1, few.count()))
    texts = [r["text"] for r in few.where(F.col("h") < threshold).orderBy("h", "text").limit(sample_docs).select("text").collect()]
    samples = Encoder(tokenizer).encode(texts)
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples for a dictionary
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class FileWriter:
    """One file of documents in the order of ``add``."""

    def __init__(self, out: object, width: int, dictionary: bytes) -> None:
        self.out = out
        shared = _dictionary(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared) if shared else zstandard.ZstdCompressor(level=LEVEL)
        self.width = width
        out.write(HEADER.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))
        self.at = HEADER.size
        self.ids: list[int | None] = []
        self.offsets, self.counts = [self.at], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(doc_id)
        self.offsets.append(self.at)
        self.counts.append(len(ids) // self.width)

    def close(self) -> None:
        known = np.array([i is not None for i in self.ids], np.uint8)
        index = [known, np.array([i or 0 for i in self.ids], "<i8"), np.array(self.offsets, "<i8"), np.array(self.counts, "<i8")]
        for a in index:
            self.out.write(a.tobytes())
        self.out.write(FOOTER.pack(self.at, len(self.ids), MAGIC))
        self.out.close()


class FileReader:
    """Random access to one file; ``ids(i)`` reads the frame of document i only."""

    def __init__(self, stream: object, dictionary: bytes) -> None:
        self.stream = stream
        magic, self.width, digest = HEADER.unpack(stream.read_at(HEADER.size, 0))
        at, n, tail = FOOTER.unpack(stream.read_at(FOOTER.size, stream.size() - FOOTER.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a file of token ids, or cut short")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        raw = stream.read_at(n + 8 * n + 8 * (n + 1) + 8 * n, at)
        known = np.frombuffer(raw, np.uint8, n)
        numbers = np.frombuffer(raw, "<i8", 3 * n + 1, n)
        self.doc_ids = [i if k else None for i, k in zip(numbers[:n].tolist(), known.tolist(), strict=True)]
        self.offsets, self.counts = numbers[n : 2 * n + 1], numbers[2 * n + 1 :]
        shared = _dictionary(dictionary)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")

    def _decode(self, frame: bytes, i: int) -> np.ndarray:
        ids = np.frombuffer(self.decompressor.decompress(frame), self.kind)
        if len(ids) != self.counts[i]:
            raise ValueError(f"document {i} has {len(ids)} ids, the index says {self.counts[i]}")
        return ids

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return self._decode(self.stream.read_at(b - a, a), i)

    def all(self, step: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Every document in order, by reads of about ``step`` bytes."""
        i, n = 0, len(self.counts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + step, "right")) - 1)
            start = int(self.offsets[i])
            raw = self.stream.read_at(int(self.offsets[j]) - start, start)
            for k in range(i, j):
                yield k, self._decode(raw[int(self.offsets[k]) - start : int(self.offsets[k + 1]) - start], k)
            i = j


def _writer(tokenizer: str, dictionary, folder: str, end_id: int | None, file_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        ids_of, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], ids_of.kind).tobytes()
        files: list[tuple] = []
        writer = name = None

        def close() -> None:
            writer.close()
            files.append((name, part, len(files), len(writer.ids), sum(writer.counts), writer.at))

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), ids_of.encode_column(batch.column("text")), strict=True):
                if writer is not None and writer.at >= file_bytes:
                    close()
                    writer = None
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/{uuid.uuid4().hex}.ids"
                    writer = FileWriter(fs.open_output_stream(name, compression=None, buffer_size=1 << 20), ids_of.width, dictionary.value)
                writer.add(doc_id, raw + end)
        if writer is not None:
            close()
        columns = zip(*files, strict=True) if files else [[]] * 6
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["file", "part", "number", "docs", "tokens", "bytes"])

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, bytes]:
    """Write the ids of all texts of ``docs`` (doc_id, text) under ``folder``; returns (manifest, dictionary).

    The manifest has file, part, number, docs, tokens, bytes; in order of (part, number) ids ascend, nulls first. Rows that repeat an
    id are in the order of their texts' hashes. A null text is empty: only the end id. A very long text is one frame, made in memory. An
    empty table writes no file. Other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    dictionary = train_dictionary(docs, tokenizer)
    folder = local_or_uri(folder)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{hashlib.sha256(dictionary).hexdigest()}.dictionary") as out:
        out.write(dictionary)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    writer = _writer(tokenizer, spark.sparkContext.broadcast(dictionary), folder, end_id, file_bytes)
    manifest = ordered.mapInArrow(lean(writer), "file string, part int, number int, docs long, tokens long, bytes long")
    return materialize(manifest, "ids-manifest"), dictionary


def _reader(dictionary, folder: str, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(file) as stream:
                    reader = FileReader(stream, dictionary.value)
                    rows = []
                    for i, ids in reader.all():
                        rows.append((reader.doc_ids[i], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_ids(manifest: DataFrame, dictionary: bytes, folder: str) -> DataFrame:
    """Per document of the files in ``manifest``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (as unsigned 32-bit integers)."""
    spark = manifest.sparkSession
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(lean(_reader(spark.sparkContext.broadcast(dictionary), local_or_uri(folder), schema)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32. Other columns aren't read.

    Nulls, empty and very long texts, repeated rows and empty tables are as in :func:`write_ids`.
    """
    folder = new_path(docs.sparkSession, "ids")
    manifest, dictionary = write_ids(docs.select("doc_id", "text"), folder, tokenizer)
    return read_ids(manifest, dictionary, folder)
