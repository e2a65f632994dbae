"""Token ids of documents as files of independent zstandard frames with a trailing seek table.

File layout, one file for a range of ascending document ids:

* one zstandard frame for each document: its ids as little-endian unsigned 32-bit integers;
* a skippable frame (magic 0x184D2A50) with the directory: row count, then for each document its id as a
  little-endian signed 64-bit integer, then one byte for each, 0 where the id is null;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public zstandard seekable format:
  compressed size, decompressed size and the low 32 bits of XXH64 of the decompressed bytes for each frame,
  then frame count, descriptor 0x80 (checksums present) and the magic 0x8F92EAB1.

A reader takes the tail, finds the frames it wants by the directory and decompresses nothing else.
"""

from __future__ import annotations

import array
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import fresh, whole

# Fixed values of the public formats.
SKIP_DIRECTORY, SKIP_SEEK, SEEK_FOOTER, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: The id appended to every document.
END_ID = 1
#: Bytes of texts that are encoded at once, and the longest piece that is merged in columns.
CHUNK, LONGEST = 6 << 20, 48
#: The rules under which the columnar path below gives the library's ids, as they stand in the vocabulary file.
COLUMNAR = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: Settings of the model under the same condition; any other value makes the library encode whole texts.
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Words of these characters alone are normalised by lower-casing and cut by PIECE; others go to the library.
SIMPLE = r"^[!-~À-ÖØ-öø-ÿ]*$"
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+|\n")
NEVER = np.int32(1 << 30)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """Byte-pair merges of many pieces at once; pairs are found by hashed buckets."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        bucket = self._bucket(keys)
        self.order = np.lexsort((np.arange(len(keys)), bucket)).astype(np.int32)
        self.keys = keys[self.order]
        self.start = np.searchsorted(bucket[self.order], np.arange((1 << 18) + 1)).astype(np.int32)

    @staticmethod
    def _bucket(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the list of merges; NEVER without one."""
        keys = left.astype(np.int64) << 32 | right
        bucket = self._bucket(keys)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(keys), NEVER)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.keys[here] == keys[open_]
            out[open_[hit]] = self.order[here[hit]]
            at[open_] += 1
            open_ = open_[~hit & (here + 1 < end[open_])]
        return out

    def __call__(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at least a byte, and their number in each piece. In a step every piece merges its first
        pair of the lowest rank; pieces without a pair left are done."""
        ends = np.cumsum(sizes)
        home = ends - sizes
        out = np.full(len(data), -1, np.int32)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        start, size = home.copy(), sizes.copy()
        piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.full(len(data), NEVER)
        inside = np.ones(len(data), bool)
        inside[ends - 1] = False
        inside = np.flatnonzero(inside)
        rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
        while len(start):
            best = np.minimum.reduceat(rank, start)
            done = best == NEVER
            if done.any():
                gone = done[piece]
                of = piece[gone]
                out[home[of] + np.flatnonzero(gone) - start[of]] = symbol[gone]
                symbol, rank = symbol[~gone], rank[~gone]
                home, size, best = home[~done], size[~done], best[~done]
                if not len(size):
                    break
                start = np.cumsum(size) - size
                piece = np.repeat(np.arange(len(size), dtype=np.int32), size)
            lowest = np.flatnonzero(rank == best[piece])
            of = piece[lowest]
            first = lowest[np.concatenate([[True], of[1:] != of[:-1]])]
            symbol[first] = self.result[rank[first]]
            keep = np.ones(len(symbol), bool)
            keep[first + 1] = False
            symbol, rank, piece = symbol[keep], rank[keep], piece[keep]
            each = np.arange(len(first))
            first, start, size = first - each, start - each, size - 1
            last = first == start + size - 1
            rank[first[last]] = NEVER
            inner = first[~last]
            rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
            before = first[first > start] - 1
            rank[before] = self.ranks(symbol[before], symbol[before + 1])
        there = out >= 0
        return out[there], np.add.reduceat(there, ends - sizes, dtype=np.int64) if len(sizes) else np.empty(0, np.int64)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of runs of the given sizes, one run after the other."""
    total = int(size.sum())
    kind = np.int32 if total < 1 << 31 and (not len(start) or int(start.max()) < 1 << 31) else np.int64
    out = np.repeat((start - (np.cumsum(size) - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


class Encoder:
    """Ids of whole texts by a vocabulary file. Under the rules above no token reaches across white space: the texts
    of a batch are cut into words and each distinct word is encoded once, in columns. Under other rules the library
    encodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            rules = json.load(source)
        model, known = rules["model"], _byte_letters()
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.columnar = (
            all(rules.get(k) == v for k, v in COLUMNAR.items())
            and all(model.get(k) == v for k, v in PLAIN_MODEL.items())
            and all(c in model["vocab"] and c + (model["end_of_word_suffix"] or "") in model["vocab"] for c in known)
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in rules["added_tokens"])
        )
        self.merges = Merges(model) if self.columnar else None

    def _by_library(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch(found, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.int32), np.array([len(x) for x in ids], np.int64)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of distinct lower-case pieces; a line end has none."""
        sizes = pc.binary_length(pieces).to_numpy().astype(np.int64)
        long = sizes > LONGEST
        short = ~long & ~pc.equal(pieces, "\n").to_numpy(zero_copy_only=False)
        size, start = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        # The array is a fresh dictionary, so its bytes lie end to end from the start of its buffer.
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[: int(sizes.sum())]
        ids, n = self.merges(data[np.repeat(short, sizes)], sizes[short])
        size[short], start[short] = n, np.cumsum(n) - n
        if long.any():
            more, m = self._by_library(pieces.filter(pa.array(long)).to_pylist())
            size[long], start[long] = m, len(ids) + np.cumsum(m) - m
            ids = np.concatenate([ids, more])
        return ids[spread(start, size)], size

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of distinct words."""
        simple = pc.match_substring_regex(words, SIMPLE)
        for t in self.added:
            simple = pc.and_not(simple, pc.match_substring(words, t))
        easy = simple.to_numpy(zero_copy_only=False)
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ids = np.empty(0, np.int32)
        if easy.any():
            some = pc.utf8_lower(words.filter(simple))
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n")[0].as_py() + "\n"
            pieces = pa.array(PIECE.findall(lines), pa.string()).dictionary_encode()
            known, n = self._pieces(pieces.dictionary)
            code, end = pieces.indices.to_numpy(), pc.index(pieces.dictionary, "\n").as_py()
            ids = known[spread((np.cumsum(n) - n)[code], n[code])]
            total = np.concatenate([[0], np.cumsum(n[code])[code == end]])
            size[easy], start[easy] = np.diff(total), total[:-1]
        if not easy.all():
            more, m = self._by_library(words.filter(pc.invert(simple)).to_pylist())
            size[~easy], start[~easy] = m, len(ids) + np.cumsum(m) - m
            ids = np.concatenate([ids, more])
        return ids[spread(start, size)], size

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words' ids and sizes, the words of all texts by number, and the first word of each text."""
        split = pc.ascii_split_whitespace(column)
        words = split.flatten().dictionary_encode()
        ids, size = self._words(words.dictionary)
        at = split.offsets.to_numpy().astype(np.int64)
        return ids, size, words.indices.to_numpy(), at - at[0]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other, and where each text begins (and the last ends)."""
        column = pc.fill_null(column, "")
        if not self.columnar:
            ids, n = self._by_library(column.to_pylist())
            return ids.astype("<u4"), np.concatenate([[0], np.cumsum(n)])
        ids, size, word, at = self._cut(column)
        total = np.concatenate([[0], np.cumsum(size[word])])[at]
        return ids.astype("<u4")[spread((np.cumsum(size) - size)[word], size[word])], total

    def count(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text of a column."""
        column = pc.fill_null(column, "")
        if not self.columnar:
            return self._by_library(column.to_pylist())[1]
        _, size, word, at = self._cut(column)
        total = np.concatenate([[0], np.cumsum(size[word])])
        return np.diff(total[at])


def chunked(rows: Iterable[pa.RecordBatch], column: str, least: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts take ``least`` bytes, so that distinct words repay their encoding."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in rows:
        held.append(b)
        size += b.column(column).nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class FrameWriter:
    """Writes one file; the rows' ids stay in memory as 21 bytes a document."""

    def __init__(self, sink, level: int = 1):
        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.seek, self.keys, self.known = bytearray(), array.array("q"), bytearray()

    def add(self, key: int | None, data: bytes) -> None:
        frame = self.zip.compress(data)
        self.sink.write(frame)
        self.seek += struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)
        self.keys.append(key if key is not None else 0)
        self.known.append(key is not None)

    def close(self) -> None:
        n = len(self.keys)
        directory = struct.pack("<Q", n) + self.keys.tobytes() + bytes(self.known)
        self.sink.write(struct.pack("<II", SKIP_DIRECTORY, len(directory)) + directory)
        self.sink.write(struct.pack("<II", SKIP_SEEK, len(self.seek) + 9) + bytes(self.seek) + struct.pack("<IBI", n, CHECKSUMS, SEEK_FOOTER))


class FrameReader:
    """Random access to one file; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2) or source.tell()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_FOOTER or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        start = end - 9 - 12 * n
        source.seek(start)
        rows = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.sizes, self.plain, self.sums = rows[:, 0].astype(np.int64), rows[:, 1], rows[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        source.seek(int(self.offsets[-1]) + 16)
        self.keys = np.frombuffer(source.read(8 * n), "<i8")
        self.known = np.frombuffer(source.read(n), np.uint8)
        self.unzip = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def _plain(self, i: int, frame: bytes) -> bytes:
        data = self.unzip.decompress(frame, max_output_size=max(1, int(self.plain[i])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.sums[i]):
            raise ValueError(f"frame {i} fails its checksum")
        return data

    def frame(self, i: int) -> bytes:
        """The ids of row ``i``; only its frame is read and decompressed."""
        self.source.seek(int(self.offsets[i]))
        return self._plain(i, self.source.read(int(self.sizes[i])))

    def find(self, key: int) -> list[bytes]:
        return [self.frame(int(i)) for i in np.flatnonzero((self.keys == key) & (self.known == 1))]

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        self.source.seek(0)
        for i in range(len(self)):
            yield (int(self.keys[i]) if self.known[i] else None), self._plain(i, self.source.read(int(self.sizes[i])))


def opened(uri: str):
    """A file system that every executor reaches, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the files into ``folder``; returns one row for each file:
    path, n_docs, n_ids, first_id, last_id (bounded: a row for each output file).

    One shuffle: rows are dealt by ranges of doc_id and each task writes one file. Null texts are empty and get the
    end id alone; null ids come first; rows with equal ids all stay, in the order of their texts; other columns are
    ignored; an empty table writes no file. A task that is run again writes a new temporary file and renames it over
    the old one, so files are whole and equal whichever attempt wins.
    """

    def write(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        part = TaskContext.get().partitionId()
        enc, tail = encoder(vocabulary), b"" if end_id is None else struct.pack("<I", end_id)
        n_docs = n_ids = 0
        first = last = None
        out = sink = None
        temporary, final = f"{top}/_{part:06d}-{uuid.uuid4().hex}", f"{top}/part-{part:06d}.ids.zst"
        for b in chunked(rows, "text"):
            ids, at = enc.encode(b.column(1))
            for key, lo, hi in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if out is None:
                    system.create_dir(top, recursive=True)
                    sink = system.open_output_stream(temporary, compression=None)
                    out, first = FrameWriter(sink), key
                data = ids[lo:hi].tobytes() + tail
                out.add(key, data)
                n_docs, n_ids, last = n_docs + 1, n_ids + len(data) // 4, key
        if out is not None:
            out.close()
            sink.close()
            system.move(temporary, final)
            name = f"{folder}/part-{part:06d}.ids.zst"
            yield pa.RecordBatch.from_pydict({"path": [name], "n_docs": [n_docs], "n_ids": [n_ids], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(write, "path string, n_docs long, n_ids long, first_id long, last_id long")


def read_tokens(files: DataFrame) -> DataFrame:
    """Read files back: (doc_id, start, ids binary) with ``start`` the ids in all files and rows before.
    ``files`` holds one row for each file with its ``path`` and ``base``."""

    def read(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                system, name = opened(path)
                with system.open_input_file(name) as source:
                    keys, starts, data, size = [], [], [], 0
                    for key, ids in FrameReader(source):
                        keys.append(key)
                        starts.append(base)
                        data.append(ids)
                        base, size = base + len(ids) // 4, size + len(ids)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "ids"])
                            keys, starts, data, size = [], [], [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "ids"])

    return files.mapInArrow(read, "doc_id long, start long, ids binary")


def with_bases(files: DataFrame) -> DataFrame:
    """Add ``base``, the ids in earlier files, by a running sum over one row for each file, one file to a task."""
    spark = files.sparkSession
    rows, base, out = sorted(files.select("path", "n_ids").collect()), 0, []
    for path, n in rows:
        out.append((path, base))
        base += n
    if not out:
        return spark.createDataFrame([], "path string, base long")
    return spark.createDataFrame(out, "path string, base long").repartition(len(out), "path")


def token_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents, read the files back, and give doc_id, start, n_tokens, ids_crc32 of each."""
    files = write_tokens(docs, fresh(docs.sparkSession, "tokens"), vocabulary)
    rows = read_tokens(with_bases(files))

    def digest(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
