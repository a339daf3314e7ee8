"""Language identification by n-gram filters that answer with a bitmask of languages.

One Bloom filter per language, stored bit-sliced: slot h holds a mask with a bit per language, so the AND of an n-gram's
slots is the set of all languages that have it. A text's n-grams give a popcount per language, from which the false
positives that its filter's fill makes likely are taken off; the largest share decides.

Fitting uses at most about SAMPLE labelled rows per language, chosen by a hash of doc_id (a documented bound on the
classifier's sample). Their n-grams are counted on the executors; a language's member is one with at least MIN_SHARE of
its count there, seen LEAST times (or as often as any in a language with less), whose frequency is at least 1 / CONTRAST
of the highest in any language. The filters' slots are put together on the executors too, so what reaches the driver,
and goes to every task, is the table alone: SLOTS masks per 64 languages (2 MB), whatever the corpus. No language is left out; a table over MOST_BYTES is an error.

Defined cases: a null text, or one without a letter, is "und" with score 0; a text of which no n-gram is known gets
the smallest value and score 0; with nothing to learn from, every text is "und"; ties go to the smaller
value; rows that repeat are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import written

SIZES = (2, 3, 4)
SAMPLE, MIN_SHARE, CONTRAST, LEAST = 3000, 1e-5, 6, 3
SLOTS, HASHES, MOST_BYTES = 1 << 18, 3, 1 << 29


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letters(text: str) -> np.ndarray:
    """Code points in lower case; everything but letters is one blank, also at the ends."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, back = np.unique(points, return_inverse=True)
    ok = np.fromiter((chr(c).isalpha() for c in kinds.tolist()), bool, len(kinds))
    points = np.where(ok[back], points, 32)
    points = np.r_[np.uint32(32), points, np.uint32(32)]
    keep = np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]
    return points[keep]


def grams(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams with a letter."""
    out = []
    x = points.astype(np.uint64)
    h = np.zeros(0, np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(x) < n:
            break
        h = x.copy() if n == 1 else (h[:-1] * np.uint64(0x100000001B3)) ^ x[n - 1 :]
        if n in SIZES:
            out.append(_mixed(h + np.uint64(n << 56)))
    return np.concatenate(out) if out else h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def slots(h: np.ndarray, n_slots: int = SLOTS, hashes: int = HASHES) -> list[np.ndarray]:
    """Double hashing; n_slots is a power of two."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(k) * b) & np.uint64(n_slots - 1)).astype(np.int64) for k in range(hashes)]


class Filters:
    """The bit-sliced filters of some languages."""

    def __init__(self, langs: list[str], members: list[np.ndarray], n_slots: int = SLOTS, hashes: int = HASHES) -> None:
        table = np.zeros((max(1, -(-len(langs) // 64)), n_slots), np.uint64)
        for i, own in enumerate(members):
            for at in slots(own, n_slots, hashes):
                table[i // 64, at] |= np.uint64(1 << i % 64)
        self._filled(langs, table, hashes)

    @classmethod
    def of_table(cls, langs: list[str], table: np.ndarray, hashes: int = HASHES) -> Filters:
        out = cls.__new__(cls)
        out._filled(langs, table, hashes)
        return out

    def _filled(self, langs: list[str], table: np.ndarray, hashes: int) -> None:
        self.langs, self.table, self.n_slots, self.hashes = langs, table, table.shape[1], hashes
        self.false = np.array([np.count_nonzero(table[i // 64] & np.uint64(1 << i % 64)) / self.n_slots for i in range(len(langs))]) ** hashes

    def containing(self, h: np.ndarray) -> np.ndarray:
        """Masks (words x n-grams) of all languages that contain each n-gram."""
        ats = slots(h, self.n_slots, self.hashes)
        out = self.table[:, ats[0]]
        for at in ats[1:]:
            out &= self.table[:, at]
        return out

    def shares(self, h: np.ndarray) -> np.ndarray:
        """Share of the n-grams that each language has, less the false positives expected."""
        masks = self.containing(h)
        hits = np.array([np.count_nonzero(masks[i // 64] & np.uint64(1 << i % 64)) for i in range(len(self.langs))], float)
        n = max(1, len(h))
        return np.clip((hits / n - self.false) / (1 - self.false), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        points = letters(text)
        if not (points != 32).any():
            return "und", 0.0
        share = self.shares(grams(points))
        best = int(share.argmax())
        return self.langs[best], float(share[best])


def fit(docs: DataFrame, sample: int = SAMPLE, min_share: float = MIN_SHARE, contrast: float = CONTRAST, least: int = LEAST) -> Filters:
    """Filters from (doc_id, text, lang) of the rows that are not held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = written(rows.groupBy("lang").count(), "languages")  # a row per language; its measured size lets Spark choose the join
    chance = (F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)
    drawn = rows.join(sizes, "lang").where(chance < F.lit(float(sample)) / F.col("count")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n-gram counts of a task, summed batch by batch."""
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    g, n = np.unique(grams(letters(text)), return_counts=True)
                    by.setdefault(lang, []).append(np.stack([g.view(np.int64), n]))
            for lang, parts in by.items():
                g, n = np.concatenate(parts, axis=1)
                kinds, back = np.unique(g, return_inverse=True)
                total = np.bincount(back, weights=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds), pa.array(total)], names=["lang", "gram", "n"])

    counted = written(drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    totals = written(totals, "grams-totals")
    top = counted.join(totals, "lang").where((F.col("n") >= F.least(F.lit(least), "most")) & (F.col("n") >= min_share * F.col("total"))).select("lang", "gram", "n")
    top = written(top, "grams-top")  # 1 / min_share rows per language at most
    langs = sorted(r["lang"] for r in top.select("lang").distinct().collect())
    if not langs:
        return Filters([], [])
    words = -(-len(langs) // 64)
    if words * SLOTS * 8 > MOST_BYTES:
        raise ValueError(f"the filters of {len(langs)} languages would take over {MOST_BYTES} bytes")
    spark = docs.sparkSession
    numbered = spark.createDataFrame(list(enumerate(langs)), "at int, lang string")
    kept = top.groupBy("lang").agg(F.sum("n").alias("kept"))
    shared = top.join(kept, "lang").select("lang", "gram", (F.col("n") / F.col("kept")).alias("share"))
    highest = shared.groupBy("gram").agg(F.max("share").alias("highest"))
    members = shared.join(highest, "gram").where(F.col("share") * contrast >= F.col("highest")).join(numbered, "lang").select("at", "gram")
    # the same double hashing as slots()
    low, high = F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    each = F.explode(F.array(*[(low + F.lit(k) * high).bitwiseAND(F.lit(SLOTS - 1)) for k in range(HASHES)]))
    bits = members.select(F.floor(F.col("at") / 64).cast("int").alias("word"), each.alias("slot"), F.expr("shiftleft(1L, at % 64)").alias("bit"))
    filled = bits.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    table = np.zeros((words, SLOTS), np.uint64)
    table[filled.column("word").to_numpy(), filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    return Filters.of_table(langs, table)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs))  # SLOTS words per 64 languages, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for b in batches:
            got = [f.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
