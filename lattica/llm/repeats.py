"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. Strings are judged by the suffix order of
their starts: a start's longest previous factor is the longer of its common prefixes with the previous and the next
start in that order that lies earlier in the corpus, and LENGTH or more of it means a repeat.

Equal strings must meet in one suffix order without moving all text, so work narrows first:
1. Every window of LENGTH bytes picks its smallest GRAM-byte hash as its anchor (a function of its bytes, so equal
   windows pick alike). An anchor stands for the run of windows that picked it; two hashes go on: of the gram, and of the
   fragment, all bytes that any window with this anchor can cover.
2. Anchors whose gram occurs once are dropped: their windows are unique. Of equal fragments the earliest stays and the
   others' windows are repeats. This is what collapses copies before anything is gathered.
3. What stays and shares its gram with different fragments is filed by CORE bytes around the anchor, that every window of
   a half of its run holds, and only files of two or more go on, with their bytes.
4. Files are put into blocks and each block gets its suffix and longest-previous-factor arrays. A file over FILE_ROWS is
   dealt to several blocks; what is first in its block meets the other blocks' firsts by hash.
Spark splits the joins' hot keys; all counts and minima are combined before they are shuffled.

Defined cases: a null text is empty; the order is doc_id (null first), then text among rows that share an id, so of
repeated rows the later ones go; texts under LENGTH lose nothing; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import parts_of, remove, written, written_at

LENGTH, GRAM = 100, 24
FILE_ROWS, BLOCK_ROWS = 4096, 8192
#: Bytes in a piece that anchors are found in at once; positions inside it take PLACE bits.
PIECE, PLACE = 1 << 19, 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _words(rows: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each row of a matrix of bytes."""
    rows = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(np.uint64)
    factors = np.random.default_rng(seed).integers(1, 2**63, rows.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(rows), np.uint64)
    for i, f in enumerate(factors):
        out = _mix(out + rows[:, i] * f)
    return out


def anchors(docs: list[tuple[int, bytes]], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Rows (doc's place in the list, gram hash, fragment hash, anchor, first and last window) as uint64 matrix.

    gram is 24: three words of eight bytes.
    """
    span = length - gram + 1
    margin = 2 * length
    out = []
    piece: list[tuple[int, int, int]] = []  # document, first window, windows
    size = 0

    def flush() -> None:
        nonlocal size
        if piece:
            out.append(_piece_anchors(docs, piece, length, span, margin))
        piece.clear()
        size = 0

    for i, (_, text) in enumerate(docs):
        n = len(text) - length + 1
        for lo in range(0, n, PIECE):
            take = min(PIECE, n - lo)
            if size and size + take + 2 * margin + length > PIECE:
                flush()
            piece.append((i, lo, take))
            size += take + 2 * margin + length
    flush()
    return np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.uint64)


def _piece_anchors(docs: list[tuple[int, bytes]], piece: list[tuple[int, int, int]], length: int, span: int, margin: int) -> np.ndarray:
    total = sum(n + length + 2 * margin for _, _, n in piece) + 8
    buf = np.zeros(total, np.uint8)
    doc, lo, n = np.array(piece).T
    at = np.cumsum(np.r_[0, (n + length + 2 * margin)[:-1]]) + margin  # where the first window of each part lies
    first, last = np.empty(len(piece), np.int64), np.empty(len(piece), np.int64)  # bounds of the text around it
    for j, (i, p, m) in enumerate(piece):
        text = docs[i][1]
        a, b = max(0, p - margin), min(len(text), p + m + length + margin)
        first[j], last[j] = at[j] - (p - a), at[j] + (b - p)
        buf[first[j] : last[j]] = np.frombuffer(text[a:b], np.uint8)
    x = buf.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    h = _mix(_mix(_mix(x[:-16]) + x[8:-8]) + x[16:])
    low = np.uint64((1 << PLACE) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the smallest hash, leftmost of equals
    reach = 1
    while reach * 2 <= span:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    m = np.minimum(m[: len(m) - (span - reach)], m[span - reach :])
    part = np.repeat(np.arange(len(piece)), n)
    window = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n) + at[part]
    pick = (m[window] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (part[1:] != part[:-1])])
    a, j = pick[new], part[new]
    s, e = window[new], window[np.r_[new[1:], len(window)] - 1]
    left, right = np.maximum(a - (span - 1), first[j]), np.minimum(a + length, last[j])
    col = (a - (span - 1))[:, None] + np.arange(span - 1 + length)
    rows = buf[np.clip(col, 0, total - 1)]
    rows[(col < left[:, None]) | (col >= right[:, None])] = 0
    fragment = _mix(_words(rows, 1) + ((a - left) * 4096 + (right - a)).astype(np.uint64))
    shift = lo[j] - at[j]
    return np.stack([doc[j].astype(np.uint64), h[a], fragment, *[(y + shift).astype(np.uint64) for y in (a, s, e)]])


def _found(base: DataFrame) -> DataFrame:
    """Anchors (h, fh, did, a, s, e) of all texts; of equal fragments in a batch, only the earliest. The others' windows
    come as rows without h, from byte s to byte e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 2500):
            docs = sorted(((d, (t or "").encode("utf-8", "surrogatepass")) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), key=lambda x: x[0])
            ids = np.array([d for d, _ in docs], np.int64)
            doc, h, f, a, s, e = anchors(docs)
            if not len(doc):
                continue
            did, a, s, e = ids[doc.astype(np.int64)], a.astype(np.int64), s.astype(np.int64), e.astype(np.int64)
            # rows are in corpus order, so the first of each pair of hashes is the earliest; pairs are brought together by
            # a mix of both and compared by both
            _, first, back = np.unique(h ^ _mix(f), return_index=True, return_inverse=True)
            first = first[back]
            later = (h == h[first]) & (f == f[first])
            later &= (did != did[first]) | (a != a[first])  # a long text's pieces may meet in an anchor
            keep, gone = np.flatnonzero(~later), np.flatnonzero(later)
            cols = [np.r_[x[keep], y] for x, y in ((did, did[gone]), (a, a[gone]), (s, s[gone]), (e, e[gone] + LENGTH))]
            mask = np.r_[np.zeros(len(keep), bool), np.ones(len(gone), bool)]
            hashes = [pa.array(np.r_[x[keep].view(np.int64), np.zeros(len(gone), np.int64)], mask=mask) for x in (h, f)]
            yield pa.RecordBatch.from_arrays([*hashes, pa.array(cols[0]), *[pa.array(c.astype(np.int32)) for c in cols[1:]]], names=["h", "fh", "did", "a", "s", "e"])

    return base.select("did", "text").mapInArrow(run, "h long, fh long, did long, a int, s int, e int")


def _fragments(listed: DataFrame) -> DataFrame:
    """From (did, text, marks: array of (h, a, s, e)): a row per half of an anchor's run, filed by its core."""
    half = (LENGTH - GRAM) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 500):
            dids, starts, sizes, raws, cores, sides, hashes = [], [], [], [], [], [], []
            for did, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for m in marks:
                    h, a, s, e = m["h"], m["a"], m["s"], m["e"]
                    # windows that start over half bytes before the anchor hold the bytes from a - half;
                    # the others hold those up to half bytes after the gram
                    cut = min(max(a - half, s), e + 1)
                    for side, lo, hi, core in ((0, s, cut - 1, data[a - half : a + GRAM] if a >= half else b""), (1, cut, e, data[a : a + GRAM + half])):
                        if lo <= hi:
                            dids.append(did)
                            starts.append(lo)
                            sizes.append(hi - lo + 1)
                            raws.append(data[lo : hi + LENGTH])
                            cores.append(core)
                            sides.append(side)
                            hashes.append(h)
            if dids:
                width = GRAM + half
                grid = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in cores), np.uint8).reshape(-1, width)
                key = _mix(_words(grid, 2) ^ np.array(hashes, np.int64).view(np.uint64) + np.array(sides, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(dids, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(raws, pa.binary())], names=["key", "did", "lo", "n", "raw"])

    return listed.mapInArrow(run, "key long, did long, lo int, n int, raw binary")


def previous_factors(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factor of each row of a matrix of bytes (suffixes cut at its width), capped at the width.

    place: the rows' order in the corpus; of rows with the same place none is earlier. Previous and next smaller places
    in suffix order are found by jumping along pointers, all at once; a pointer whose common prefix has become shorter
    than the width can't lead to a repeat and stops.
    """
    n, width = rows.shape
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    sorted_rows, p = rows[order], place[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    best = np.zeros(n, np.int64)
    for back in (True, False):
        q = p if back else p[::-1]
        c = common if back else common[::-1]
        to = np.arange(n) - 1
        reach = np.r_[0, c]
        while True:
            moving = np.flatnonzero((to >= 0) & (reach >= width) & (q[np.maximum(to, 0)] >= q))
            if not len(moving):
                break
            via = to[moving]
            reach[moving] = np.minimum(reach[moving], reach[via])
            to[moving] = to[via]
        reach[to < 0] = 0
        best = np.maximum(best, reach if back else reach[::-1])
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _judged(filed: DataFrame) -> DataFrame:
    """From (key, salt, hot, did, lo, n, raw), whole files together and sorted: removed bytes (did, lo, hi), and for hot
    files, with key and w, the windows that are first in their block."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        key, hot = t.column("key").to_numpy(), t.column("hot").to_numpy(zero_copy_only=False)
        did, lo, n = (t.column(c).to_numpy().astype(np.int64) for c in ("did", "lo", "n"))
        raws = t.column("raw").to_pylist()
        data = np.frombuffer(b"".join(raws), np.uint8)
        at = np.cumsum(np.r_[0, [len(r) for r in raws]])[:-1]
        row = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        windows = data[(at[row] + off)[:, None] + np.arange(LENGTH)]
        d, p = did[row], lo[row] + off
        place = np.empty(len(row), np.int64)
        by = np.lexsort((p, d))
        place[by] = np.cumsum(np.r_[0, (d[by][1:] != d[by][:-1]) | (p[by][1:] != p[by][:-1])])
        again = previous_factors(windows, place) >= LENGTH
        # removed windows in runs
        w = np.flatnonzero(again)
        new = np.flatnonzero(np.r_[True, (row[w][1:] != row[w][:-1]) | (w[1:] != w[:-1] + 1)]) if len(w) else w
        a, z = w[new], w[np.r_[new[1:], len(w)] - 1] if len(w) else w
        f = np.flatnonzero(~again & hot[row])
        mark = _words(windows[f], 3).view(np.int64)
        mask = np.r_[np.ones(len(a), bool), np.zeros(len(f), bool)]
        cols = [pa.array(np.r_[d[a], d[f]]), pa.array(np.r_[p[a], p[f]].astype(np.int32)), pa.array((np.r_[p[z], p[f]] + LENGTH).astype(np.int32))]
        cols += [pa.array(np.r_[np.zeros(len(a), np.int64), x], mask=mask) for x in (key[row][f], mark)]
        return pa.RecordBatch.from_arrays(cols, names=["did", "lo", "hi", "key", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            while rest.num_rows > BLOCK_ROWS:
                key, salt = rest.column("key").to_numpy(), rest.column("salt").to_numpy()
                ends = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
                if not len(ends):
                    break
                cut = int(ends[max(0, np.searchsorted(ends, BLOCK_ROWS, side="right") - 1)])
                yield solve(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return filed.mapInArrow(run, "did long, lo int, hi int, key long, w long")


def _cut(joined: DataFrame) -> DataFrame:
    """From (doc_id, text, gone: array of (lo, hi) or null): what is left of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1000):
            rows = []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                keep, end, spans, removed = hashlib.sha256(), 0, 0, 0
                for lo, hi in sorted((g["lo"], g["hi"]) for g in gone or ()):
                    if lo > end or not spans:
                        keep.update(data[end:lo])
                        spans += 1
                        removed += hi - lo
                        end = hi
                    elif hi > end:
                        removed += hi - end
                        end = hi
                keep.update(data[end:])
                rows.append((len(data), removed, spans, keep.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _based(docs: DataFrame) -> DataFrame:
    """(did, doc_id, text) with did unique and in corpus order: doc_id itself where that is so."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("did"), "doc_id", "text")
    # numbers of a range-sorted table rise with it; it is written, so they stay
    return written(rows.orderBy(F.col("doc_id").asc_nulls_first(), "text").select(F.monotonically_increasing_id().alias("did"), "doc_id", "text"), "ordered")


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (did, doc_id, text) and their removed bytes (did, lo, hi), which may overlap."""
    spark = docs.sparkSession
    base = _based(docs)
    found, found_at = written_at(_found(base), "anchors")
    marks = found.where("h is not null")
    local = written(found.where("h is null").select("did", F.col("s").alias("lo"), F.col("e").alias("hi")), "repeats-local")
    grams = marks.groupBy("h").agg(F.count("*").alias("n"), F.min("fh").alias("x"), F.max("fh").alias("y")).where("n > 1")
    grams = written(grams.select("h", (F.col("x") != F.col("y")).alias("mixed")), "repeats-grams")
    again, again_at = written_at(marks.join(grams, "h"), "repeats-anchors")
    remove(spark, found_at)
    firsts, firsts_at = written_at(again.groupBy("h", "fh").agg(F.min(F.struct("did", "a")).alias("first")), "repeats-firsts")
    here = F.struct("did", "a")
    split = written(again.join(firsts, ["h", "fh"]).where("mixed or struct(did, a) > first").select("h", "did", "a", "s", "e", (here > F.col("first")).alias("later")), "repeats-split")
    for path in (again_at, firsts_at):
        remove(spark, path)
    later = split.where("later").select("did", F.col("s").alias("lo"), (F.col("e") + LENGTH).alias("hi"))
    listed = split.where("not later").groupBy("did").agg(F.collect_list(F.struct("h", "a", "s", "e")).alias("marks"))
    fragments, fragments_at = written_at(_fragments(base.select("did", "text").join(listed, "did").select("did", "text", "marks")), "repeats-fragments")
    files = written(fragments.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "repeats-files")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("did", "lo"), F.ceil(F.col("rows") / FILE_ROWS)).cast("int")
    filed = fragments.join(files, "key").select("key", salt.alias("salt"), (F.col("rows") > FILE_ROWS).alias("hot"), "did", "lo", "n", "raw")
    judged = written(_judged(filed.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt")), "repeats-judged")
    remove(spark, fragments_at)
    met = judged.where("w is not null")
    firsts = written(met.groupBy("key", "w").agg(F.min(F.struct("did", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeats-met")
    across = met.join(firsts, ["key", "w"]).where("struct(did, lo) > first").select("did", "lo", "hi")
    return base, local.union(later).union(judged.where("w is null").select("did", "lo", "hi")).union(across)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    base, gone = repeated(docs)
    by_doc = written(gone.groupBy("did").agg(F.collect_list(F.struct("lo", "hi")).alias("gone")), "repeats-gone")
    return _cut(base.join(by_doc, "did", "left").select("doc_id", "text", "gone"))
