"""URL filter: rules on host and path, and logistic regression on hashed character n-grams where no rule fits.

The regression is trained from labelled(), a small table of urls that a seeded rule makes of two lists of words, with
full-batch gradient descent, so it is the same on every run; its weights are one vector of N_BUCKETS numbers, made once
in each process. Which urls are to be judged has no part in it. Sub-domains, domains and paths are drawn alike for both
labels, so only names can tell them apart.

Defined cases: a null url, or one without "://", has empty host and path and is allowed by the method (there is nothing
to judge); rules hold for a host and its subdomains and for paths with the rule's prefix, the longest wins (ties can't
be: such rules would be equal); rows that repeat are judged alike; no rows give no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Words of names to be blocked, and of ordinary ones: fixed values.
SPAM = (
    "pills viagra pharma meds casino poker slots bonus jackpot lottery bet bets betting gamble odds xxx porn adult cams escort dating hookup loans payday credit cash "
    "money replica watches rolex warez crack keygen torrent malware phishing spam spammer farm linkfarm clickbait click clicks followers seo backlinks traffic ads adserver "
    "track tracker tracking popup miracle diet free win winner prize gift cheap discount deals offer nude sexy hot"
).split()
PLAIN = (
    "river garden museum library school history science weather market harbour theatre kitchen forest mountain bridge village council church hospital station music painting "
    "dance bicycle physics chemistry biology poetry novel archive journal press courier gazette recipes baker carpenter pottery knitting sailing hiking chess astronomy "
    "geology botany language grammar travel railway airport castle island valley meadow orchard farmhouse beekeeping woodwork parliament university college research"
).split()
TRAIN_URLS, TRAIN_SEED = 1600, 5
SIZES = (3, 4, 5)
N_BUCKETS = 1 << 14


def buckets(host: str, path: str) -> list[int]:
    """Buckets of the distinct n-grams of host and path, marked by where they are from."""
    found: set[int] = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            found.update(zlib.crc32(f"{mark}{part[i : i + n]}".encode("utf-8", "surrogatepass")) % N_BUCKETS for i in range(len(part) - n + 1))
    return sorted(found)


def labelled(n: int = TRAIN_URLS, seed: int = TRAIN_SEED) -> list[tuple[int, str, str]]:
    """(label, host, path) of n urls, 1 for those to be blocked. Half of the ordinary names are made of syllables."""
    rng = random.Random(seed)
    consonants, vowels = "bcdfghjklmnprstvwyz", "aeiou"
    out = []
    for k in range(n):
        label = k % 2
        if label:
            name = rng.choice(SPAM) + rng.choice(("-", "-", "", "24")) + rng.choice(SPAM)
        elif rng.random() < 0.5:
            name = rng.choice(PLAIN) + rng.choice(("-", "-", "", "24")) + rng.choice(PLAIN)
        else:
            syllable = lambda: rng.choice(consonants) + rng.choice(("", "h", "r")) + rng.choice(vowels) + rng.choice(("", "", "n", "r", "s", "t"))
            name = "".join(syllable() for _ in range(rng.randint(1, 4))) + rng.choice(("", "ing", "tion", "ble", "ed", "ly"))
        host = rng.choice(("", "", "www.", "m.", "blog.", "shop.", "news.")) + name + rng.choice((".example", "", ".co")) + rng.choice((".com", ".org", ".net", ".de", ".info"))
        path = rng.choice(("", "/", f"/en/{rng.randint(1, 9999)}", f"/de/{rng.randint(1, 9999)}.html", f"/fr/{rng.randint(1, 9999)}/", f"/{rng.randint(2000, 2030)}/index.html", "/about"))
        out.append((label, host, path))
    return out


@cache
def trained(steps: int = 400, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept. A url's n-grams weigh one over the root of their number each."""
    table = labelled()
    found = [buckets(h, p) for _, h, p in table]
    n = np.fromiter(map(len, found), np.int64, len(found))
    at, scale = np.concatenate(found).astype(np.int64), 1 / np.sqrt(n)
    starts, each = np.cumsum(n) - n, np.repeat(scale, n)
    y = np.array([v for v, _, _ in table], float)
    w, b = np.zeros(N_BUCKETS), 0.0
    for _ in range(steps):
        miss = y - 1 / (1 + np.exp(-(np.add.reduceat(w[at], starts) * scale + b)))
        w += rate * (np.bincount(at, np.repeat(miss, n) * each, N_BUCKETS) / 16 - decay * w)
        b += rate * miss.mean()
    return w, b


def probability(host: str, path: str) -> float:
    """That a url is to be blocked."""
    if not host and not path:
        return 0.0
    w, b = trained()
    at = buckets(host, path)
    return float(1 / (1 + np.exp(-(w[at].sum() / np.sqrt(max(1, len(at))) + b))))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(tail, r"^[^?#]*", 0)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, blocked_p) of every row's url."""
    host, path = parts(F.col("url"))
    split = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    ruled = split.select(key, "host", "path", rule_for(F.col("host"), F.col("path")).alias("r")).select(key, "host", "path", "r.rule", F.col("r.verdict").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained()
        for b in batches:
            p = [probability(h, q) for h, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            verdict = [v or ("block" if x >= 0.5 else "allow") for v, x in zip(b.column(4).to_pylist(), p, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(verdict, pa.string()), pa.array(p, pa.float64())], names=[key, "host", "path", "rule", "verdict", "blocked_p"])

    return ruled.mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string, blocked_p double")
