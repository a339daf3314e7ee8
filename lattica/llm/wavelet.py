"""Token ids as one wavelet-matrix file per shard.

A shard holds documents in ascending doc_id order. Its file has the documents' ids and lengths, then a wavelet matrix
of the token ids: one bit plane per bit of the largest id, from the highest, each the stable partition of the sequence
by the planes before. Planes are stored as compressed blocks of BLOCK_BITS bits with the number of ones before each block, so
access, rank and select read one block per plane, and count, occurrences and select need no other index.

Layout, little-endian: magic, u32 planes, u64 tokens, u64 documents, u64 length of the index (JSON: offsets of the parts
and blocks, ones before each block, zeros per plane), the index, then the parts.

Defined cases: a null or empty text is the end id alone; documents are ordered by doc_id (null first), then text; rows
that repeat each get their place; no rows give no file and no rows.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import file_system, new_path, write_file, written
from lattica.llm.store import WIDTH, PieceStore, spread, text_bytes
from lattica.operators.state import running

MAGIC = b"WVLTMTX2"
BLOCK_BITS = 1 << 17
#: A task closes a file when it has this many tokens; its memory follows this, not the partition.
SHARD_TOKENS = 1 << 22
END_ID = 2


class Writer:
    """Collects documents and gives the bytes of a file."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], [len(ids)], ids)

    def extend(self, docs: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        """Documents whose ids are in a row."""
        self.docs += docs
        self.lengths += lengths
        self.ids.append(ids)
        self.tokens += len(ids)

    def bytes(self) -> bytes:
        seq = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint16)
        planes = max(1, int(seq.max()).bit_length()) if len(seq) else 1
        body, index = io.BytesIO(), {"planes": []}
        pack = zstandard.ZstdCompressor(level=1).compress

        def part(data: bytes | memoryview) -> list[int]:
            at = body.tell()
            body.write(pack(data))
            return [at, body.tell() - at]

        index["docs"] = part(np.array([-1 if d is None else d for d in self.docs], "<i8").tobytes())
        index["null_docs"] = part(np.packbits(np.array([d is None for d in self.docs], bool)).tobytes())
        index["lengths"] = part(np.array(self.lengths, "<u4").tobytes())
        step = BLOCK_BITS // 8
        for p in reversed(range(planes)):
            bit = (seq & seq.dtype.type(1 << p)) != 0
            packed = np.packbits(bit, bitorder="little")
            starts = np.arange(0, len(packed), step)
            each = np.add.reduceat(np.bitwise_count(packed), starts, dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
            view = memoryview(packed)
            index["planes"].append({"zeros": len(seq) - int(each.sum()), "blocks": [part(view[i : i + step]) for i in starts.tolist()], "ones": (np.cumsum(each) - each).tolist()})
            if p:
                seq = np.concatenate([np.compress(~bit, seq), np.compress(bit, seq)])
        head = json.dumps(index).encode()
        return MAGIC + struct.pack("<IQQQ", planes, self.tokens, len(self.docs), len(head)) + head + body.getvalue()


class Reader:
    """Answers from a file's bytes. A block is decompressed when it is first asked for."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.planes, self.tokens, self.documents, n = struct.unpack_from("<IQQQ", data, 8)
        self.index = json.loads(data[36 : 36 + n])
        self._body = memoryview(data)[36 + n :]
        self._block = cache(self._read_block)
        self._unpack = zstandard.ZstdDecompressor().decompress

    def _part(self, at: list[int]) -> bytes:
        return self._unpack(self._body[at[0] : at[0] + at[1]])

    @cached_property
    def doc_ids(self) -> list[int | None]:
        ids = np.frombuffer(self._part(self.index["docs"]), "<i8").tolist()
        null = np.unpackbits(np.frombuffer(self._part(self.index["null_docs"]), np.uint8))[: len(ids)]
        return [None if x else d for d, x in zip(ids, null.tolist(), strict=True)]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._part(self.index["lengths"]), "<u4").astype(np.int64)

    def _read_block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block, and the ones before each bit inside the whole plane (one more entry)."""
        plane = self.index["planes"][level]
        size = min(BLOCK_BITS, self.tokens - block * BLOCK_BITS)
        bits = np.unpackbits(np.frombuffer(self._part(plane["blocks"][block]), np.uint8), bitorder="little")[:size]
        before = np.empty(size + 1, np.int64)
        before[0] = plane["ones"][block]
        np.cumsum(bits, out=before[1:])
        before[1:] += before[0]
        return bits, before

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        plane = self.index["planes"][level]
        if i <= 0:
            return 0
        if i >= self.tokens:
            return self.tokens - plane["zeros"]
        return int(self._block(level, i // BLOCK_BITS)[1][i % BLOCK_BITS])

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for level in range(self.planes):
            bit = int(self._block(level, i // BLOCK_BITS)[0][i % BLOCK_BITS])
            ones = self._ones(level, i)
            i = self.index["planes"][level]["zeros"] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _narrow(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the symbol's occurrences of [lo, hi) lie in the bottom order."""
        if symbol >> self.planes:
            return 0, 0
        for level in range(self.planes):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.index["planes"][level]["zeros"] + a, self.index["planes"][level]["zeros"] + b) if symbol >> (self.planes - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences among the first i tokens."""
        lo, hi = self._narrow(symbol, 0, min(max(i, 0), self.tokens))
        return hi - lo

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._narrow(symbol, lo, self.tokens if hi is None else hi)
        return b - a

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane."""
        plane = self.index["planes"][level]
        before = np.array(plane["ones"], np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK_BITS - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        found = np.flatnonzero(self._block(level, block)[0] == bit)
        return block * BLOCK_BITS + int(found[k - int(before[block])])

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence."""
        lo, hi = self._narrow(symbol, 0, self.tokens)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in reversed(range(self.planes)):
            bit = symbol >> (self.planes - 1 - level) & 1
            i = self._find(level, bit, i - self.index["planes"][level]["zeros"] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def all_ids(self) -> np.ndarray:
        """The whole sequence, from the bottom plane up: each stable partition is undone."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        seq = np.zeros(self.tokens, kind)
        for level in reversed(range(self.planes)):
            plane = self.index["planes"][level]
            raw = b"".join(map(self._part, plane["blocks"]))  # blocks are whole bytes
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.tokens].view(bool)
            up = np.empty_like(seq)
            up[np.flatnonzero(~bit)] = seq[: plane["zeros"]]  # by index: many times faster than by mask
            up[np.flatnonzero(bit)] = seq[plane["zeros"] :] | kind(1 << (self.planes - 1 - level))
            seq = up
        return seq


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: ASCII marks, letters and digits; bytes that can start a character that is not white space (of the lead bytes of
#: white space beyond ASCII, 0xC2 and 0xE1 to 0xE3, none); letters and digits; stops.
GRAPH = _bytes(bytes(range(0x21, 0x7F)))
SOLID = GRAPH | _bytes(bytes(b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3)))
ALNUM = _bytes(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
STOPS = _bytes(b".,!?;:")


class ByteLevelEncoder:
    """Whole texts to ids with a byte-level tokenizer file.

    The splitting pattern goes from left to right and joins a blank to what follows it, so these places are never inside
    a token, whether the text goes on or not: before a blank that a non-blank follows; before a line break that an ASCII
    mark precedes, and after it, if a non-blank follows; between an ASCII letter or digit and a stop. Texts are cut
    there, each distinct piece is encoded once by the library (many joined in a text) and remembered, and a document is
    its pieces' ids in a row.
    """

    JOINED = 20_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens are found before the splitting pattern is used; texts that hold one go to the library whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)  # a byte-level token has a character per byte
        self.store = PieceStore(self.kind)

    def cuts(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where pieces start. whole: documents that are not cut."""
        b = data[: offsets[-1]]
        cut = np.zeros(len(b) + 1, bool)
        if len(b):
            solid, graph, line = SOLID[b], GRAPH[b], b == 10
            cut[: len(b) - 1] = (b[:-1] == 32) & solid[1:]
            last = offsets[1:][offsets[1:] > 0] - 1
            cut[last] = False  # what follows is another text
            cut[1:-1] |= (line[1:] & graph[:-1]) | (STOPS[b[1:]] & ALNUM[b[:-1]])
            cut[2:-1] |= line[1:-1] & graph[:-2] & solid[2:]
            for i in np.flatnonzero(whole).tolist():
                cut[offsets[i] : offsets[i + 1]] = False
            cut[offsets[:-1]] = True
        return np.flatnonzero(cut[:-1])

    def _joined(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, between: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are solved in one text, each followed by what goes between, whose ids are left out."""
        out, counts = [], []
        extra = len(between)
        for lo in range(0, len(starts), self.JOINED):
            s, n = starts[lo : lo + self.JOINED], sizes[lo : lo + self.JOINED]
            raw = data[spread(s, n + extra)]
            ends = np.cumsum(n + extra)
            if extra:
                raw[ends - 1] = ord(between)
            ids = np.array(self.tokenizer.encode_batch_fast([raw.tobytes().decode("utf-8")], add_special_tokens=False)[0].ids, self.kind)
            at = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
            if extra:
                ids = np.delete(ids, at - 1)
            counts.append(np.diff(at, prepend=0) - extra)
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, self.kind), np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def _solve(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library."""
        first, last = data[starts], data[starts + sizes - 1]
        short = sizes <= 2 * WIDTH
        inner = short & (sizes > 1) & (first == 32) & SOLID[data[starts + 1]]
        outer = short & ~inner & SOLID[first] & GRAPH[last]
        rest = np.flatnonzero(~inner & ~outer)
        groups = [(np.flatnonzero(inner), ""), (np.flatnonzero(outer), "\n")]
        done = [(at, *self._joined(data, starts[at], sizes[at], between)) for at, between in groups]
        texts = [data[s : s + n].tobytes().decode("utf-8") for s, n in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True)]
        each = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        done.append((rest, np.concatenate(each) if each else np.zeros(0, self.kind), np.fromiter(map(len, each), np.int64, len(each))))
        counts = np.zeros(len(starts), np.int64)
        for at, _, n in done:
            counts[at] = n
        out = np.empty(int(counts.sum()), self.kind)
        ends = np.cumsum(counts)
        for at, ids, n in done:
            out[spread((ends - counts)[at], n)] = ids
        return out, counts

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        import pyarrow.compute as pc

        data, offsets = text_bytes(column)
        whole = np.zeros(len(column), bool)
        for token in self.added:
            whole |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        starts = self.cuts(data, offsets, whole)
        sizes = np.diff(starts, append=offsets[-1])
        of = np.searchsorted(offsets, starts, side="right") - 1
        ids, n = self.store.ids_of(data, starts, sizes, self._solve, whole[of] if whole.any() else None)
        return ids, np.bincount(of, weights=n, minlength=len(column)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, n = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(n)[:-1]) if texts else []


@cache
def byte_level(path: str) -> ByteLevelEncoder:
    """One per Python process: its store serves all tasks that run there."""
    return ByteLevelEncoder(path)


def slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of about most bytes; a longer text is a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)


def write_shards(docs: DataFrame, make_encoder: Callable[[], object], end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, str]:
    """Encodes docs in doc_id order and writes one file per shard. Returns the shards (part, seq, file, documents,
    tokens), written, and their folder. A task that is run again writes the same bytes under the same names.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = make_encoder()
        out: list[tuple] = []
        w = Writer()

        def close() -> None:
            nonlocal w
            name = f"{folder}/{part:06d}-{len(out):06d}.wm"
            write_file(name, w.bytes())
            out.append((part, len(out), name, len(w.docs), w.tokens))
            w = Writer()

        for b in batches:
            for lo, hi in slices(b.column(1)):
                ids, n = encoder.encode_column(b.column(1).slice(lo, hi - lo))
                whole = np.empty(len(ids) + len(n), encoder.kind)
                ends = np.cumsum(n + 1) - 1
                inside = np.ones(len(whole), bool)
                inside[ends] = False
                whole[inside], whole[ends] = ids, end_id
                w.extend(b.column(0).slice(lo, hi - lo).to_pylist(), (n + 1).tolist(), whole)
                if w.tokens >= shard_tokens:
                    close()
        if w.docs:
            close()
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "seq", "file", "documents", "tokens"])

    return written(placed.mapInArrow(run, "part int, seq int, file string, documents long, tokens long"), "shards"), folder


def read_documents(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files. start counts the ids of all before it."""
    based = running(shards, "base", "part", "seq", of=F.col("tokens")).select("file", F.col("base").cast("long").alias("base"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = file_system(file)
                with store.open_input_stream(at) as f:
                    r = Reader(f.read())
                ids = r.all_ids()
                ends = np.cumsum(r.lengths)
                starts = ends - r.lengths
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, pa.int64()), pa.array(starts + base), pa.array(r.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(parts, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    shards, _ = write_shards(docs, lambda: byte_level(tokenizer))
    return read_documents(docs.sparkSession, shards)
