"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest pivots in order. The index is written once, one file for each chunk of
vectors: the vectors, their ids, and an inverted file per pivot whose entries carry the pivot's place. Queries are
written in blocks with their own prefixes. A task takes a block past a run of chunk files, so vectors are not shuffled
again: for a query, its own pivots' files are walked and every entry adds to its vector what the shared pivot takes off
the footrule distance (places past the prefix count as PREFIX). The nearest RERANK of the chunk by footrule distance,
ties included, are reranked by exact inner product of the original vectors in double precision, and the block's lists
are merged from chunk to chunk, so a task gives one list per query.

Pivots are PIVOTS vectors chosen by hash (the bounded sample that the index is fitted on); every row is indexed. Equal
vectors are merged first with as many of their smallest ids as a result can hold, so copies make no pairs. RERANK is a
share, so recall does not fall as tables grow; it is set for vectors without structure, where pruning is hardest.

Defined cases: rows with a null id or a vector that is null, empty, zero or holds a null or non-finite component take no
part; vectors shorter than the longest count as padded with zeros; rows that share an id are one query and one
candidate, whose score is the best of their vectors; rows that repeat count once; no rows give no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import file_system, new_path, write_file, written

PIVOTS, PREFIX, RERANK = 2048, 64, 0.12
#: Vectors of a chunk (fewer where they are long: BYTES in double precision), queries of a block, chunks of a run: what
#: a task holds at once is a chunk, a block and the block's lists.
CHUNK, BYTES, QUERIES, RUN = 65_536, 1 << 26, 4096, 16
NEAREST, EVERY = 20, 20


def keyed(vectors: DataFrame, id_col: str, vec_col: str, nearest: int) -> DataFrame:
    """(id, key): key has a vector's bytes, in the column's own precision. Of equal vectors in a batch, the nearest + 1
    smallest ids, and all in asked()."""
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = precision(vectors, vec_col)
    name = "float" if kind == "<f4" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[bytes, set[int]] = {}
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = np.array(x.values, kind)
                # padding and the sign of zero make no difference
                found.setdefault((at[: np.flatnonzero(at)[-1] + 1] + at.dtype.type(0)).tobytes(), set()).add(i)
            pairs = [(i, k) for k, ids in found.items() for i in (sorted(ids)[: nearest + 1] if nearest else ids)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([k for _, k in pairs], pa.binary())], names=["id", "key"])

    return vectors.where(fine).select(F.col(id_col).cast("long").alias("i"), v.cast(f"array<{name}>").alias("v")).mapInArrow(run, "id long, key binary")


def precision(vectors: DataFrame, vec_col: str) -> str:
    return "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"


def classes(rows: DataFrame, nearest: int) -> DataFrame:
    """(key, ids): a row per distinct vector with its nearest + 1 smallest ids. The ranks are limited before the shuffle
    too, so a vector that fills the table reaches it as a few rows for each task."""
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy("id"))
    return rows.withColumn("r", rank).where(F.col("r") <= nearest + 1).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def matrix(keys: list[bytes], width: int, kind: str) -> np.ndarray:
    out = np.zeros((len(keys), width), kind)
    for i, k in enumerate(keys):
        x = np.frombuffer(k, kind)
        out[i, : len(x)] = x
    return out


def order(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    prefix = min(prefix, len(pivots))
    out = np.empty((len(x), prefix), np.uint16)
    for lo in range(0, len(x), 4096):
        far = -(x[lo : lo + 4096].astype(float) @ pivots.T)
        near = np.sort(np.argpartition(far, prefix - 1, axis=1)[:, :prefix], axis=1) if prefix < len(pivots) else np.broadcast_to(np.arange(prefix), far.shape)
        by = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
        out[lo : lo + 4096] = np.take_along_axis(near, by, axis=1)
    return out


class Files:
    """Inverted files of a chunk: per pivot, the vectors that have it in their prefix, and its place there."""

    def __init__(self, size: int, prefix: int, edges: np.ndarray, rows: np.ndarray, places: np.ndarray) -> None:
        self.size, self.prefix, self.edges, self.rows, self.places = size, prefix, edges, rows, places

    @classmethod
    def made(cls, near: np.ndarray, n_pivots: int) -> Files:
        flat = near.ravel()
        by = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[by], np.arange(n_pivots + 1))
        return cls(len(near), near.shape[1], edges, (by // near.shape[1]).astype(np.uint32), (by % near.shape[1]).astype(np.uint16))

    def saved(self, own: np.ndarray) -> np.ndarray:
        """What the pivots that each vector shares with a query's prefix take off the footrule distance, by half."""
        out = np.zeros(self.size, np.int32)
        for place, pivot in enumerate(own.tolist()):
            a, b = self.edges[pivot], self.edges[pivot + 1]
            out[self.rows[a:b]] += self.prefix - np.maximum(self.places[a:b], place)
        return out

    def footrule(self, own: np.ndarray) -> np.ndarray:
        """Distances of the chunk's vectors from a query's prefix."""
        return self.prefix * (self.prefix + 1) - 2 * self.saved(own)

    def nearest(self, own: np.ndarray, take: int, least: int) -> np.ndarray:
        """Rows of the take nearest by footrule distance, ties included. Vectors that share no pivot with the query are
        as far as can be; they are taken only where fewer than least others are there."""
        saved = self.saved(own)
        above = np.cumsum(np.bincount(saved)[::-1])  # vectors with the highest sums, from the top
        bound = len(above) - 1 - int(np.searchsorted(above, min(take, self.size)))
        if bound <= 0 and self.size - int((saved == 0).sum()) >= least:
            bound = 1
        return np.flatnonzero(saved >= bound)


Near = tuple[np.ndarray, np.ndarray]


def merged(ids: np.ndarray, scores: np.ndarray, k: int) -> Near:
    """The k best ids, each once, by score, then id."""
    by = np.lexsort((ids, -scores))
    _, first = np.unique(ids[by], return_index=True)
    keep = by[np.sort(first)[:k]]
    return ids[keep], scores[keep]


def best(x: np.ndarray, q: np.ndarray, rows: np.ndarray, starts: np.ndarray, ids: np.ndarray, k: int) -> Near:
    """The k ids with the highest inner products among some rows; starts and ids list the ids of each row."""
    score = np.einsum("ij,j->i", x[rows].astype(float), q)
    take = k
    while True:
        keep = np.arange(len(rows)) if len(rows) <= take else np.flatnonzero(score >= np.partition(score, -take)[-take])
        n = starts[rows[keep] + 1] - starts[rows[keep]]
        at = np.repeat(starts[rows[keep]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = merged(ids[at], np.repeat(score[keep], n), k)
        if len(found[0]) >= k or len(keep) == len(rows):  # rows that share an id may have to make room for others
            return found
        take *= 4


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _opened(path: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file; None where no row was dealt to it."""
    from pyarrow import fs

    store, at = file_system(path)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(at) as f:
        return dict(np.load(io.BytesIO(f.read())))


def _dealt(rows: DataFrame, files: int, folder: str, name: str, pack) -> DataFrame:  # noqa: ANN001
    """Writes rows (key and more) to files name-0 .., dealt by key. A task that is run again writes the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if t is not None:
            write_file(f"{folder}/{name}-{TaskContext.get().partitionId()}", pack(t.sort_by("key")))
        yield pa.RecordBatch.from_arrays([pa.array([t.num_rows if t else 0], pa.int64())], names=["rows"])

    return rows.repartition(files, "key").mapInArrow(run, "rows long")


class Index:
    """A written index of vectors: build() makes the files, search() takes queries past them."""

    def __init__(self, folder: str, chunks: int, rows: int, width: int, kind: str, pivots: np.ndarray, prefix: int) -> None:
        self.folder, self.chunks, self.rows, self.width, self.kind, self.pivots, self.prefix = folder, chunks, rows, width, kind, pivots, prefix

    @classmethod
    def build(cls, found: DataFrame, kind: str, n_pivots: int = PIVOTS, prefix: int = PREFIX, chunk: int = CHUNK) -> Index:
        """found: (key, ids), a row per distinct vector."""
        item = np.dtype(kind).itemsize
        sizes = found.agg(F.count("*").alias("n"), F.max(F.length("key")).alias("w")).first()
        width = (sizes["w"] or 0) // item
        pivots = matrix([r["key"] for r in found.select("key").orderBy(F.xxhash64("key"), "key").limit(n_pivots).collect()], width, kind).astype(float)
        chunk = min(chunk, max(1024, BYTES // (8 * max(1, width))))
        chunks = -(-sizes["n"] // chunk)
        folder = new_path(found.sparkSession, "permutations")

        def pack(t: pa.Table) -> bytes:
            x = matrix(t.column("key").to_pylist(), width, kind)
            f = Files.made(order(x, pivots, prefix), len(pivots))
            ids = t.column("ids").combine_chunks()
            starts = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
            return _packed(x=x, edges=f.edges, rows=f.rows, places=f.places, starts=starts, ids=ids.flatten().to_numpy())

        if chunks:
            _dealt(found, chunks, folder, "chunk", pack).agg(F.sum("rows")).collect()
        return cls(folder, chunks, sizes["n"], width, kind, pivots, min(prefix, len(pivots)))

    def search(self, queries: DataFrame, k: int, rerank: float = RERANK) -> DataFrame:
        """(key, id, score): the k nearest found of each distinct key of queries, one list or more for each."""
        spark, folder, width, kind, pivots, prefix, chunks = queries.sparkSession, self.folder, self.width, self.kind, self.pivots, self.prefix, self.chunks
        schema = "key binary, id long, score double"
        asked = queries.count()
        if not asked or not chunks:
            return spark.createDataFrame([], schema)
        name = f"block-{id(queries):x}"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(-(-asked // QUERIES), min(parts, -(-asked // 64)))
        runs = -(-chunks // RUN)

        def pack(t: pa.Table) -> bytes:
            keys = t.column("key").to_pylist()
            q = matrix(keys, width, kind)
            return _packed(q=q, near=order(q, pivots, prefix), sizes=np.fromiter(map(len, keys), np.int64, len(keys)))

        _dealt(queries.select("key"), blocks, folder, name, pack).agg(F.sum("rows")).collect()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for n in (x for b in batches for x in b.column(0).to_pylist()):
                block = _opened(f"{folder}/{name}-{n % blocks}")
                if block is None:
                    continue
                q, near = block["q"].astype(float), block["near"]
                lists: list[Near] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
                for c in range(n // blocks * RUN, min(chunks, (n // blocks + 1) * RUN)):
                    if (part := _opened(f"{folder}/chunk-{c}")) is None:
                        continue
                    x, starts, ids = part["x"], part["starts"], part["ids"]
                    files = Files(len(x), prefix, part["edges"], part["rows"], part["places"])
                    take = max(4 * k, int(np.ceil(rerank * len(x))))
                    for i, (v, own) in enumerate(zip(q, near, strict=True)):
                        more = best(x, v, files.nearest(own, take, 4 * k), starts, ids, k)
                        lists[i] = merged(np.r_[lists[i][0], more[0]], np.r_[lists[i][1], more[1]], k) if len(lists[i][0]) else more
                keys = [r[:s].tobytes() for r, s in zip(block["q"], (block["sizes"] // block["q"].dtype.itemsize).tolist(), strict=True)]
                at = pa.array(np.repeat(np.arange(len(keys)), [len(i) for i, _ in lists]))
                cols = [pa.array(keys, pa.binary()).take(at), pa.array(np.concatenate([i for i, _ in lists]), pa.int64()), pa.array(np.concatenate([s for _, s in lists]))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "score"])

        return spark.range(0, blocks * runs, 1, blocks * runs).mapInArrow(run, schema)


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", nearest: int = NEAREST, every: int = EVERY, n_pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row whose id is divisible by every."""
    index = Index.build(written(classes(keyed(vectors, id_col, vec_col, nearest), nearest), "vectors"), precision(vectors, vec_col), n_pivots, prefix)
    asking = written(keyed(vectors.where(F.col(id_col) % every == 0), id_col, vec_col, 0).distinct(), "queries")
    found = written(index.search(written(asking.select("key").distinct(), "query-vectors"), nearest + 1, rerank), "nearest")
    # a list per distinct query vector, then every query takes the lists of its vectors
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    lists = found.withColumn("r", place).where(F.col("r") <= nearest + 1).groupBy("key").agg(F.collect_list(F.struct("id", "score")).alias("near"))
    each = asking.join(lists, "key").select(F.col("id").alias("query_id"), F.explode("near").alias("x")).where("x.id <> query_id")
    scored = each.groupBy("query_id", F.col("x.id").alias("vec_id")).agg(F.max("x.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
