"""SentencePiece encoding and decoding with one pass over an Aho-Corasick automaton of the pieces.

At each position the automaton's output links give all pieces that end there, longest first, and the best path to the
position is relaxed over them. How a path is scored follows the model file's own type:
- unigram: the sum of piece scores is largest (Viterbi); a character without a piece costs the least score less 10;
- BPE: a sum of scores would choose other pieces than the merges do. The merged form of a text has the merged form of
  every prefix in it, so a position again keeps one path: the one whose last two pieces stay apart when they are merged
  alone. Which pairs do is found once per pair and remembered.
Either gives the ids that the public library gives (see tests).

Texts are cut between two characters that stand side by side in no piece (looked up in the model), as no path joins
them; each distinct part is solved once and remembered in a store that is bounded in bytes.

Defined cases: a null or empty text has no ids and decodes to the empty text; characters without a piece become their
UTF-8 bytes' pieces; a lone surrogate can't occur; rows that repeat are treated alike; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.store import PieceStore, spread, text_bytes
from lattica.llm.wavelet import slices

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """An encoder and decoder for a model file. unigram overrides the file's type."""

    PAIRS, PARTS = 200_000, 400_000

    def __init__(self, path: str, unigram: bool | None = None) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:  # the vocabulary comes with each machine's libraries
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with leading blanks is supported")
        self.prefix = norm.add_dummy_prefix
        self.unigram = model.trainer_spec.model_type == 1 if unigram is None else unigram
        self.pieces = [p.piece for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER)}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.least = min(p.score for p in model.pieces if p.type == NORMAL) - 10.0
        #: Whether two characters stand side by side in a piece; those beyond ASCII count as one, and stay together.
        self.joins = np.zeros((129, 129), bool)
        self.joins[128, 128] = True
        for p in self.id:
            row = [min(ord(c), 128) for c in p.replace(BLANK, " ")]
            self.joins[row[:-1], row[1:]] = True
        self.inside = frozenset("".join(self.id))  # characters that some piece has
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self.unigram or self.merged(piece) == [piece]:  # the merges can give no other piece
                self.automaton.add_word(piece, (i, len(piece), self.score[piece]))
        self.automaton.make_automaton()
        # what each id decodes to, in a row of bytes
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        shown = {NORMAL: lambda p: p.piece.replace(BLANK, " ").encode(), UNKNOWN: lambda p: " ⁇ ".encode()}
        shown[USER] = shown[NORMAL]
        texts = [of_byte[i] if i in of_byte else shown[p.type](p) if p.type in shown else b"" for i, p in enumerate(model.pieces)]
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.store = PieceStore("<u4", self.PARTS)
        self.apart: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merges of a short text by their definition: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stay(self, key: int, left: str, right: str) -> bool:
        """Whether left and right are apart when merged alone."""
        if len(self.apart) > self.PAIRS:
            self.apart.clear()
        found = self.apart[key] = self.merged(left + right) == [left, right]
        return found

    def best_path(self, part: str) -> list[str]:
        """Pieces (and characters without one) of a part, by one pass over its positions."""
        n = len(part)
        back = [0] * (n + 1)  # where the last piece of the best path to a position starts
        if self.unigram:
            best = [0.0] + [-np.inf] * n
            done = 0
            single = [False] * n
            for end, (_, size, score) in self.automaton.iter(part):
                while done < end:  # positions that no piece of one character ends at
                    done += 1
                    self._guess(best, back, single, done)
                single[end] |= size == 1
                start = end + 1 - size
                if best[start] + score > best[end + 1]:
                    best[end + 1], back[end + 1] = best[start] + score, start
            while done < n:
                done += 1
                self._guess(best, back, single, done)
        else:
            pieces, apart, many = self.pieces, self.apart, len(self.pieces)
            last = [-1] * (n + 1)  # the last piece, or -1 while there is none: then the character stands alone
            for end, (i, size, _) in self.automaton.iter(part):
                if last[end + 1] >= 0:
                    continue
                start = end + 1 - size
                before = last[start]
                if before >= 0:
                    key = before * many + i
                    fits = apart.get(key)
                    if fits is None:
                        fits = self._stay(key, pieces[before], pieces[i])
                elif start and part[start - 1] in self.inside:
                    fits = self.merged(part[start - 1] + pieces[i]) == [part[start - 1], pieces[i]]
                else:
                    fits = True
                if fits:
                    last[end + 1], back[end + 1] = i, start
            for i in range(1, n + 1):
                if last[i] < 0:
                    back[i] = i - 1
        out, i = [], n
        while i:
            out.append(part[back[i] : i])
            i = back[i]
        return out[::-1]

    def _guess(self, best: list[float], back: list[int], single: list[bool], i: int) -> None:
        if not single[i - 1] and best[i - 1] + self.least > best[i]:
            best[i], back[i] = best[i - 1] + self.least, i - 1

    def _ids(self, part: str) -> list[int]:
        out: list[int] = []
        for p in self.best_path(part):
            if p in self.id:
                out.append(self.id[p])
            elif self.byte:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def _solve(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts by one pass over each."""
        parts = (data[s : s + n].tobytes().decode("utf-8").replace(" ", BLANK) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True))
        each = list(map(self._ids, parts))
        return np.array([i for x in each for i in x], "<u4"), np.fromiter(map(len, each), np.int64, len(each))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        import pyarrow.compute as pc

        if pc.any(pc.match_substring(column, BLANK)).as_py():  # it stands for a blank
            column = pc.replace_substring(column, BLANK, " ")
        data, offsets = text_bytes(column, " " if self.prefix else "")
        kind = np.minimum(data[: offsets[-1]], 128).astype(np.int32)
        cut = np.zeros(len(kind) + 1, bool)
        if len(kind):
            cut[1:-1] = ~self.joins.ravel()[kind[:-1] * 129 + kind[1:]]
            cut[offsets[:-1]] = True
        starts = np.flatnonzero(cut[:-1])
        ids, n = self.store.ids_of(data, starts, np.diff(starts, append=offsets[-1]), self._solve)
        of = np.searchsorted(offsets, starts, side="right") - 1
        return ids, np.bincount(of, weights=n, minlength=len(column)).astype(np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_all(ids, np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The texts of ids in a row, n of them for each."""
        raw = self.flat[spread(self.at[ids], self.size[ids])].tobytes()
        ends = np.r_[0, np.cumsum(self.size[ids])][np.r_[0, np.cumsum(n)]].tolist()
        skip = int(self.prefix)
        return [raw[s + (skip and raw[s : s + 1] == b" ") : e].decode("utf-8", "replace") if e > s else "" for s, e in zip(ends[:-1], ends[1:], strict=True)]


@cache
def loaded(path: str) -> Pieces:
    return Pieces(path)


def _coded(batch: pa.RecordBatch, p: Pieces) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[str]]]:
    """Runs of a batch of (doc_id, text): the rows, their ids in a row, how many each has, what they decode to."""
    for lo, hi in slices(batch.column(1), 1 << 20):
        rows = batch.slice(lo, hi - lo)
        ids, n = p.encode_column(rows.column(1))
        yield rows, ids, n, p.decode_all(ids, n)
    pa.default_memory_pool().release_unused()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per row; ids as array of int, decoded the text that they give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(path)
        for batch in batches:
            for rows, ids, n, texts in _coded(batch, p):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), lists, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), exact (decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(path)
        for batch in batches:
            for rows, ids, n, texts in _coded(batch, p):
                raw, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(n)
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                exact = [x == (t or "").replace(BLANK, " ") for x, t in zip(texts, rows.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(crc, pa.int64()), pa.array(exact, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "exact"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, exact boolean")
