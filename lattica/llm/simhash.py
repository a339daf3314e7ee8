"""SimHash near-duplicates through pivot distance tables.

Fingerprints are made per document, equal ones are merged first, and only distinct fingerprints are compared. Two of
them within k bits agree on at least BLOCKS - k of BLOCKS bit blocks, so each is filed under every choice of blocks;
inside a file, the Hamming distances to PIVOTS reference fingerprints are computed once per fingerprint, pairs whose
distance to any pivot differs by more than k are discarded (the triangle inequality: nothing is lost), and survivors are
verified. A file emits a spanning forest of its links, not its pairs. A file of over FILE_ROWS rows is cut into chunks,
and every two chunks meet in a task of their own, so a task's memory is bounded and all its pairs are still compared.
Components come from repeated contraction to the smallest neighbour, each round written to the shared folder.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text under the shingle length
is one shingle; rows that repeat a doc_id each get a row; a null doc_id is never a component's name unless alone in it;
no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, parts_of, written

SHINGLE, BITS, SEED = 4, 4, 42
BLOCKS, PIVOTS, FILE_ROWS = 6, 16, 4096
#: For sets of shingles: prefix shingles that similar sets share at least; sets in a small file; shingles in a chunk;
#: buckets that a set's shingles are counted in; rows of counts in a chunk.
SHARED, SMALL, CHUNK, BUCKETS, COUNTS = 4, 64, 1 << 19, 256, 2048
#: For their fingerprints: bits that may differ, and the blocks of which two agree then.
NEAR_BITS, NEAR_BLOCKS = 6, 8
#: Above this many distinct fingerprints, files are keyed by four of eight blocks instead of two of six.
MANY = 50_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    hash_ = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for lo in range(0, len(starts), 1 << 16):
        h = np.array([hash_(joined[s:e], SEED) for s, e in zip(starts[lo : lo + (1 << 16)], ends[lo : lo + (1 << 16)], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * total > len(starts))
    return sum(1 << int(b) for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp as signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int, bits: int) -> list[int]:
    """Masks of every choice of blocks - bits among blocks runs of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(runs, blocks - bits)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(n)], np.uint64)


def spanning(fps: np.ndarray, table: np.ndarray, bits: int, split: int | None = None) -> list[tuple[int, int]]:
    """Index pairs that connect what is linked, each with the first of its component. table: distances to the pivots.
    split: only pairs across this index."""
    n = len(fps)
    label = np.arange(n)
    order = np.argsort(table[:, 0], kind="stable")
    near = table[order, 0].astype(np.int64)
    ends = np.searchsorted(near, near + bits, side="right")
    counts = ends - np.arange(n) - 1
    lo = 0
    while lo < n:  # rows of order, as many as make about two million pairs
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(counts[lo:]), 2_000_000, side="right")) + lo)
        c = counts[lo:hi]
        a = np.repeat(np.arange(lo, hi), c)
        b = a + 1 + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        a, b = order[a], order[b]
        if split is not None:
            across = (a < split) != (b < split)
            a, b = a[across], b[across]
        for p in range(1, table.shape[1]):  # discard by the largest coordinate difference, one coordinate at a time
            far = np.abs(table[a, p].astype(np.int16) - table[b, p]) > bits
            if far.any():
                a, b = a[~far], b[~far]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        a, b = a[linked], b[linked]
        while True:  # smallest labels go along all links at once, then along themselves
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        lo = hi
    rest = np.flatnonzero(label != np.arange(n))
    return list(zip(label[rest].tolist(), rest.tolist(), strict=True))


def _small(fps: np.ndarray, table: np.ndarray, run: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of rows with the same run number; runs are contiguous and short."""
    left, right = [], []
    d = 1
    while d < len(run):
        a = np.flatnonzero(run[:-d] == run[d:])
        if not len(a):
            break
        b = a + d
        for p in range(table.shape[1]):
            keep = np.abs(table[a, p].astype(np.int16) - table[b, p]) <= bits
            a, b = a[keep], b[keep]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        left.append(a[linked])
        right.append(b[linked])
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(distinct: DataFrame, bits: int = BITS, blocks: int = BLOCKS, n_pivots: int = PIVOTS, file_rows: int = FILE_ROWS) -> DataFrame:
    """(a, b), a < b: enough links between distinct fingerprints (column fp) to connect all that are linked."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks(blocks, bits))])
    filed = distinct.select("fp", F.explode(keys).alias("f")).select("f.t", "f.k", "fp")
    sizes = filed.groupBy("t", "k").count().where("count > 1")  # rows alone in their file meet nobody
    many = filed.join(sizes, ["t", "k"]).withColumn("n", F.ceil(F.col("count") / file_rows).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda c: F.struct(F.least(c, own).alias("ci"), F.greatest(c, own).alias("cj")))
    dealt = many.select("t", "k", "fp", own.alias("c"), F.explode(pairs).alias("p")).select("t", "k", "p.ci", "p.cj", "c", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(n_pivots)

        def solve(key: np.ndarray, c: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            """key: one number per row, equal within a file, ascending; whole files only."""
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            table = np.stack([np.bitwise_count(fp ^ r) for r in refs], axis=1)
            small = np.repeat(sizes <= 48, sizes)
            at = np.flatnonzero(small)
            x, y = _small(fp[at], table[at], key[at], bits)
            a, b = [at[x]], [at[y]]
            for s, n in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist(), strict=True):
                own = c[s : s + n]
                by = np.argsort(own, kind="stable") + s
                split = None if own.min() == own.max() else int((own == own.min()).sum())
                if found := spanning(fp[by], table[by], bits, split):
                    i, j = np.array(found).T
                    a.append(by[i])
                    b.append(by[j])
            u, v = fp[np.concatenate(a)].view(np.int64), fp[np.concatenate(b)].view(np.int64)
            both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            cols = [rest.column(i).to_numpy() for i in range(4)]
            new = np.r_[True, np.any([x[1:] != x[:-1] for x in cols], axis=0)]
            last = int(np.flatnonzero(new)[-1])
            if last:  # the last file may go on
                yield solve(np.cumsum(new)[:last], rest.column(4).to_numpy()[:last], rest.column(5).to_numpy().view(np.uint64)[:last])
                rest = rest.slice(last).combine_chunks()
        if rest is not None and rest.num_rows:
            yield solve(np.zeros(rest.num_rows, np.int64), rest.column(4).to_numpy(), rest.column(5).to_numpy().view(np.uint64))

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.repartition(parts, "t", "k", "ci", "cj").sortWithinPartitions("t", "k", "ci", "cj")
    return placed.mapInArrow(run, "a long, b long").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node it reaches.

    Each round ranks the nodes anew by a hash, points every node at the best ranked of itself and its neighbours, jumps
    once, and contracts the edges. The ranks are random, so a share of the nodes goes each round whatever the graph's
    shape, and rounds are logarithmic.
    """
    edges = written(edges.select("a", "b"), "cc-edges")
    mapped, turn = None, 0
    while True:
        turn += 1
        ranked = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("p"), F.col(c).alias("v"))
        both = edges.union(edges.select("b", "a"))
        best = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), ranked("a"))["v"].alias("to"))
        best = written(best, "cc-best")
        jump = best.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = written(best.join(jump, "to").select("node", F.col("next").alias("to")), "cc-step")
        if mapped is None:
            mapped = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            mapped = mapped.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        mapped = written(mapped, "cc-map")
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        if edges.isEmpty():
            break
    least = mapped.groupBy("root").agg(F.min("node").alias("least"))
    return written(mapped.join(least, "root").select("node", F.col("least").alias("root")), "cc-roots")


def components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest doc_id reachable."""
    marked = written(fingerprints(docs, shingle), "simhash")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    blocks = BLOCKS if classes.count() < MANY else 8
    roots = contracted(links(classes.select("fp"), bits, blocks))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = written(named.join(least, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(of_class, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    found = components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by SimHash and pivots, checked by the exact Jaccard similarity of shingle sets, for the pipeline.
#
# Fingerprints within NEAR_BITS are found by links(), as above, and what they name is verified. They can't decide alone:
# texts of similarity 0.8 differ by some 10 of 64 bits, many by more, and a radius that keeps them all (about 20) is one at
# which pivots discard nothing. So an exact join on shared prefix shingles follows for sets that are still apart, and no link
# is lost.


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct word shingles of a text as ascending 64-bit hashes; a text under the shingle length is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = (b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def set_fingerprint(found: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of shingles, as shingles() gives it; 0 if there is none."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(found), 1 << 16):
        total += np.unpackbits(found[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return _signed(sum(1 << int(b) for b in np.flatnonzero(2 * total > len(found))))


def prefix(found: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first shingles in an order that all texts share: frequent ones (hot, rarest first) last, else by hash.

    Sets of Jaccard 0.8 have ceil(0.8 n) shingles or more of either in common, so they share SHARED of these at least.
    Under four shingles only equal sets reach 0.8.
    """
    n = len(found)
    if n < SHARED:
        return found[:0]
    rank = np.zeros(n, np.int64)
    if len(hot):
        by = np.argsort(hot)
        at = np.minimum(np.searchsorted(hot, found, sorter=by), len(hot) - 1)
        rank = np.where(hot[by[at]] == found, by[at] + 1, 0)
    return found[np.argsort(rank, kind="stable")][: n - (4 * n + 4) // 5 + SHARED]


def frequent(docs: DataFrame, shingle: int, most: int = 200_000) -> np.ndarray:
    """Shingles that about 10,000 of the texts often have, rarest first. It sets an order; no result depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, shingle).view(np.int64))], names=["h"])

    every = max(1, docs.count() // 10_000)
    some = docs.where(F.pmod(F.xxhash64("doc_id", "row"), F.lit(every)) == 0).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(most).toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint64)


def counted(found: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of BUCKETS buckets; 255 stands for more."""
    return np.minimum(np.bincount((found & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _grid(column: pa.Array) -> np.ndarray:
    """Counts of a column as a matrix."""
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    return raw[column.offset * BUCKETS : (column.offset + len(column)) * BUCKETS].reshape(-1, BUCKETS)


def may_be_similar(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether sets may have a similarity of 0.8: they share at most the smaller count of each bucket, so their distance
    in counts is a lower bound of the shingles that they don't share. Nothing similar is discarded."""
    both = np.minimum(x, y).sum(axis=-1, dtype=np.int64)
    return (9 * both >= 4 * (nx.astype(np.int64) + ny)) | (x.max(axis=-1, initial=0) == 255) | (y.max(axis=-1, initial=0) == 255)


def connecting(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs of similar sets that connect what is linked: each set meets all that no other has reached yet."""
    out: list[tuple[int, int]] = []
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(flat.max()) + 1, bool)
    rest, rows = np.arange(len(sets)), flat
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue = [int(rest[0])]
            rows, rest = rows[sizes[rest[0]] :], rest[1:]
        x = queue.pop()
        if not len(rest):
            break
        own = flat[starts[x] : starts[x] + sizes[x]]
        mark[own] = True
        n = sizes[rest]
        both = np.add.reduceat(mark[rows], np.cumsum(n) - n, dtype=np.int64)
        mark[own] = False
        near = 9 * both >= 4 * (sizes[x] + n)
        if near.any():
            found = rest[near].tolist()
            out += [(x, y) for y in found]
            queue += found
            rows, rest = rows[np.repeat(~near, n)], rest[~near]
    return out


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole files of rows that come sorted by their first column."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        h = rest.column(0).to_numpy()
        last = int(np.searchsorted(h, h[-1])) if len(h) else 0
        if last:  # the last file may go on
            yield rest.slice(0, last)
            rest = rest.slice(last).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _sizes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's first row of its file, and the file's size."""
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    n = np.diff(np.r_[starts, len(h)])
    return np.repeat(starts, n), np.repeat(n, n)


def similar(docs: DataFrame, shingle: int = 5, small: int = SMALL, chunk: int = CHUNK, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, sid) per row of docs, row being the column that tells rows of a doc_id apart and sid naming its set of shingles, and (a, b): enough links to
    connect all sets of Jaccard similarity 0.8 or more.

    First the sets' fingerprints are linked, by block keys and pivots, and each such link is verified on the sets. What they
    don't reach follows: sets are filed under each shingle of their prefix. Every set of a file is compared with the file's first, which
    connects most groups whatever their size. Then only files with sets that are still apart go on: in files of up to
    small sets all pairs are counted, and those that meet SHARED times are compared; in larger files all sets meet, chunk
    by chunk. Pairs are discarded by their counts in buckets, a table made once for each set, before the sets themselves
    are fetched. Nothing is lost.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(row) if row else F.xxhash64("text")).alias("row"), "text")
    hot = frequent(docs, shingle)
    name = lambda x: _signed(xxhash.xxh64_intdigest(x.tobytes(), SEED))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1000):
            sets = [shingles(t, shingle) for t in b.column(2).to_pylist()]
            cols = [pa.array([name(x) for x in sets], pa.int64()), pa.array(list(map(set_fingerprint, sets)), pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(list(map(counted, sets)), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, pa.array([prefix(x, hot).view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "row", "sid", "fp", "n", "c", "pre"])

    marked = written(docs.mapInArrow(mark, "doc_id long, row long, sid long, fp long, n int, c binary, pre array<long>"), "near-sets")
    filed = marked.select("sid", "n", "pre").dropDuplicates(["sid"]).select(F.explode("pre").alias("h"), "sid", "n")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of files of two sets or more, with the file's first set. Rows come sorted by h and sid."""
        for t in _files(batches):
            first, size = _sizes(t.column(0).to_numpy())
            at = np.flatnonzero(size > 1)
            sid, n = t.column(1).to_numpy(), t.column(2).to_numpy()
            cols = [t.column(0).to_numpy()[at], sid[at], n[at], sid[first[at]], n[first[at]]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["h", "sid", "n", "ref", "ref_n"])

    files = filed.repartition(parts, "h").sortWithinPartitions("h", "sid").mapInArrow(shared, "h long, sid long, n int, ref long, ref_n int")
    files = written(files, "near-files")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                sets = [shingles(t, shingle) for t in b.column(0).slice(lo, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([name(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["sid", "s"])

    def sets_of(sids: DataFrame) -> DataFrame:
        """(sid, s) of some sets, from one text each."""
        sids = written(sids.distinct(), "near-needed")
        first = marked.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "row")).alias("k"))
        keys = written(first.select("k.doc_id", "k.row").distinct(), "near-texts")
        return written(_with(docs, keys).select("text").mapInArrow(again, "sid long, s array<long>").dropDuplicates(["sid"]), "near-shingles")

    def counts_of(sids: DataFrame) -> DataFrame:
        return marked.select("sid", "n", "c").join(sids.distinct(), "sid", "left_semi").dropDuplicates(["sid"])

    def bounded(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose counts allow that they are similar."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = may_be_similar(_grid(b.column(3)), _grid(b.column(5)), b.column(2).to_numpy(), b.column(4).to_numpy())
                at = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

        pairs = written(pairs, name)
        each = counts_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")))
        x = each.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
        y = each.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
        met = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "ca", "nb", "cb")
        return written(met.mapInArrow(run, "a long, b long"), f"{name}-bounded")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        at = lambda c, s: sets.select(F.col("sid").alias(c), F.col("s").alias(s))
        enough = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
        return pairs.join(at("a", "x"), "a").join(at("b", "y"), "b").where(enough).select("a", "b")

    # sets whose fingerprints are equal or linked
    firsts = written(marked.groupBy("fp").agg(F.min("sid").alias("first")), "near-fingerprints")
    first_of = lambda fp, c: firsts.select(F.col("fp").alias(fp), F.col("first").alias(c))
    equal = marked.select("fp", "sid").distinct().join(firsts, "fp").where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    across = links(firsts.select("fp"), NEAR_BITS, NEAR_BLOCKS).join(first_of("a", "x"), "a").join(first_of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    close = bounded(equal.union(across), "near-close")
    close = written(verified(close, sets_of(close.select(F.explode(F.array("a", "b")).alias("sid")))), "near-close-links")
    joined = contracted(close)
    root_of = lambda c, r: joined.select(F.col("node").alias(c), F.col("root").alias(r))

    # every set with the first of its files, unless they are joined by now
    near = (5 * F.least("n", "ref_n") >= 4 * F.greatest("n", "ref_n")) & (F.col("sid") != F.col("ref"))
    stars = files.where(near).groupBy(F.col("ref").alias("a"), F.col("sid").alias("b")).count().where(f"count >= {SHARED}").select("a", "b")
    stars = stars.join(root_of("a", "x"), "a", "left").join(root_of("b", "y"), "b", "left").where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")
    stars = bounded(stars, "near-stars")
    found = written(close.union(verified(stars, sets_of(stars.select(F.explode(F.array("a", "b")).alias("sid"))))), "near-star-links")
    roots = contracted(found).withColumnRenamed("node", "sid")

    # what is still apart
    placed = files.join(roots, "sid", "left").select("h", "sid", "n", F.coalesce("root", "sid").alias("root"))
    apart = placed.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    left = placed.join(apart, "h", "left_semi").repartition(parts, "h").sortWithinPartitions("h")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """h, a, b of pairs in small files; h, a, null, n, root of the rows of large ones."""
        for t in _files(batches):
            h, sid, n, root = (t.column(i).to_numpy() for i in range(4))
            _, sizes = _sizes(h)
            large = np.flatnonzero(sizes > small)
            at = np.flatnonzero(sizes <= small)
            ends = [(np.zeros(0, np.int64),) * 2]
            for d in range(1, min(small, len(at))):
                x = np.flatnonzero(h[at[:-d]] == h[at[d:]])
                if not len(x):
                    break
                i, j = at[x], at[x + d]
                fits = (5 * np.minimum(n[i], n[j]).astype(np.int64) >= 4 * np.maximum(n[i], n[j]).astype(np.int64)) & (root[i] != root[j])
                ends.append((i[fits], j[fits]))
            i, j = (np.concatenate(x) for x in zip(*ends, strict=True))
            a, b = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
            b = pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(large), pa.int64())])
            sized = np.r_[np.zeros(len(i), np.int32), n[large]].astype(np.int32)
            roots_ = np.r_[np.zeros(len(i), np.int64), root[large]]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[h[i], h[large]]), pa.array(np.r_[a, sid[large]]), b, pa.array(sized), pa.array(roots_)], names=["h", "a", "b", "n", "root"])

    met = written(left.mapInArrow(meet, "h long, a long, b long, n int, root long"), "near-met")
    pairs = bounded(met.where("b is not null").groupBy("a", "b").count().where(f"count >= {SHARED}").select("a", "b"), "near-pairs")
    large = met.where("b is null").select("h", F.col("a").alias("sid"), "n", "root")

    def chunked(rows: DataFrame, counts: DataFrame, *cols: str) -> DataFrame:
        """Rows once for every two chunks of their file that they are in; counts: (h, chunks)."""
        own = F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, own).alias("ci"), F.greatest(c, own).alias("cj")))
        two = F.filter(others, lambda p: (p["ci"] < p["cj"]) | (F.col("chunks") == 1))  # two chunks in one task hold their own pairs
        return rows.join(counts, "h").select("h", "sid", *cols, F.explode(two).alias("p")).select("h", "p.ci", "p.cj", "sid", *cols)

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h, sid) of the sets that may be similar to one of another root. Whole chunks come sorted."""
        key, held = None, []

        def solve() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            n, root, c = t.column(4).to_numpy(), t.column(5).to_numpy(), np.concatenate([_grid(x.column(6)) for x in held])
            hit = np.zeros(len(n), bool)
            for i in range(len(n) - 1):
                fits = (root[i + 1 :] != root[i]) & may_be_similar(c[i + 1 :], c[i][None], n[i + 1 :], n[i : i + 1])
                hit[i + 1 :] |= fits
                hit[i] |= fits.any()
            at = pa.array(np.flatnonzero(hit))
            return pa.RecordBatch.from_arrays([t.column(0).combine_chunks().take(at), t.column(3).combine_chunks().take(at)], names=["h", "sid"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy() for k in range(3)])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]).tolist()
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if held and tuple(keys[:, lo]) != key:
                    yield solve()
                    held = []
                key = tuple(keys[:, lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield solve()

    rows = large.join(counts_of(large.select("sid")).select("sid", "c"), "sid")
    whole = chunked(rows, large.groupBy("h").agg(F.ceil(F.count("*") / COUNTS).cast("int").alias("chunks")), "n", "root", "c")
    whole = whole.repartition(parts, "h", "ci", "cj").sortWithinPartitions("h", "ci", "cj")
    fit = whole.mapInArrow(partnered, "h long, sid long").distinct()
    large = written(large.join(fit, ["h", "sid"], "left_semi").select("h", "sid", "n"), "near-large")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")).union(large.select("sid")))

    # a chunk is as large as its sets, about CHUNK shingles
    counts = large.groupBy("h").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("chunks"))
    dealt = chunked(large.drop("n"), counts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sids, held = None, [], []

        def solve() -> pa.RecordBatch:
            found = np.array(connecting(held) if held else [], np.int64).reshape(-1, 2)
            of = np.array(sids, np.int64)
            a, b = of[found[:, 0]], of[found[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            h, ci, cj, sid = (b.column(i).to_pylist() for i in range(4))
            for i, k in enumerate(zip(h, ci, cj, strict=True)):
                if k != key and held:
                    yield solve()
                    sids, held = [], []
                key = k
                sids.append(sid[i])
                held.append(b.column(4)[i].values.to_numpy())
        yield solve()

    together = dealt.join(sets, "sid").select("h", "ci", "cj", "sid", "s").repartition(parts, "h", "ci", "cj").sortWithinPartitions("h", "ci", "cj")
    more = verified(pairs, sets).union(together.mapInArrow(compare, "a long, b long"))
    return marked.select("doc_id", "row", "sid"), found.union(more).distinct()


def dedup(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without near-duplicates: texts are linked by a Jaccard similarity of their word shingles of 0.8 or more; of
    each component, one row stays, with the smallest doc_id (null is last).

    Rows are told apart by a hash of all their columns, so unlike rows that share a doc_id are judged each by itself; of
    rows equal in all columns one stays.
    """
    cols = [F.to_json(F.struct(f.name)) if "map" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*cols).alias("row"), "text", F.struct("*").alias("whole"))
    with Scratch() as scratch:
        marked, edges = similar(rows.select("doc_id", "row", "text"), shingle, row="row")
        roots = contracted(edges).withColumnRenamed("node", "sid")
        ranked = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("k")
        first = marked.join(roots, "sid", "left").groupBy(F.coalesce("root", "sid")).agg(ranked).select("k.doc_id", "k.row")
        first = scratch.keep(first, "near-first")
        many = scratch.keep(marked.groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row"), "near-equal")
    kept = _with(rows, first)
    if many.isEmpty():
        return kept.select("whole.*")
    equal = _with(kept, many).dropDuplicates(["doc_id", "row"])
    return _with(kept, many, "left_anti").select("whole.*").unionByName(equal.select("whole.*"))


def _with(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose doc_id (null like any other) and row are among keys, or are not."""
    named = keys.select(F.col("doc_id").alias("_kd"), F.col("row").alias("_kr"))
    return rows.join(named, F.col("doc_id").eqNullSafe(F.col("_kd")) & (F.col("row") == F.col("_kr")), how)
