"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what the patterns can't see.

Patterns give emails, IPs, cards and phones. The field labels entity-shaped tokens (all others are outside by the
model's structure) as person, secret or account. Chain edges join neighbours; skip edges join occurrences of the same
word, compared without case, inner punctuation and possessive ending, each to the next, so a group of n costs n edges.
Damped sum-product messages run until they settle, so an occurrence with a cue ("token = ...") labels those without one.
Every text gets its messages, whether it has a cue or not; texts are put into one graph in batches, and each stops by
itself, so its labels are the same in any batch.

The weights are fitted here, by pseudo-likelihood, on sentences made from templates (TRAIN_DOCS of them).

Defined cases: a null or empty text has no spans; rows that repeat are treated alike; no rows give no rows; other
columns are carried along by mask(). All patterns are linear in a text's length.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import parts_of

BASE = ("email", "ip", "card", "phone")
LABELS = ("", "person", "secret", "account")
KINDS = {k: i for i, k in enumerate((*BASE, *LABELS[1:]))}
TRAIN_DOCS, TRAIN_SEED = 400, 11

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Matches can start only where a run of digits starts, so nothing is lost by asking for that.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping. An @ stops every local part, so scanning back from each @ is linear."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    found: list[Span] = list(emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS[s[2]]))


# Cue words: fixed values.
CUES = {
    "secret": frozenset("token secret password passwd pwd apikey api_key key passwort clave contraseña".split()),
    "person": frozenset("mr mrs ms dr prof herr frau monsieur madame mme señor señora sr sra".split()),
    "account": frozenset("account passport ssn konto kontonummer cuenta compte pasaporte passeport iban".split()),
    "harmless": frozenset("commit sha1 sha256 md5 checksum hash revision version order page isbn".split()),
}
CUE_OF = {w: kind for kind, words in CUES.items() for w in words}
SPACES = np.array([chr(c).isspace() for c in range(0x3002)])  # no space lies beyond
INNER = re.compile(r"\w(?:[\w.@'-]*\w)?")
FEATURES = ("bias", "hex_long", "mixed_long", "digits", "title", "cue_secret", "cue_person", "cue_account", "cue_harmless", "short_hop", "sentence_start")
#: Distinct tokens that a process remembers, and the longest of them: bounds their bytes.
KEPT_TOKENS, KEPT_LENGTH = 40_000, 32
#: Code points of the texts that are judged together; a longer text is judged alone.
TOGETHER = 1 << 18


def _form(low: str) -> str:
    """What occurrences share that are linked: a word without possessive ending and inner punctuation."""
    return re.sub(r"[^\w]|_", "", low.removesuffix("'s")) or low


class _Tokens(dict):
    """What a token's own characters tell: a number below PLAIN for tokens without a cue or a candidate, twice the number
    of their words plus whether a full stop ends them; else PLAIN and the place in told. told has, for each word, (cue,),
    () or (start, end, form, shape bits), and whether a full stop ends the token."""

    PLAIN = 1 << 20

    def __init__(self) -> None:
        super().__init__()
        self.told: list[tuple[list[tuple], bool]] = []

    def __missing__(self, raw: str) -> int:
        words, plain, stop = [], True, raw[-1] in ".!?"
        for m in INNER.finditer(raw):
            word = m.group()
            low = word.lower()
            if low in CUE_OF:
                words.append((CUE_OF[low],))
                plain = False
                continue
            digits = sum("0" <= c <= "9" for c in word)
            title = len(word) > 1 and word[0].isupper() and word[1:].islower()
            if title or digits >= 6 or (len(word) >= 8 and digits):
                hex_ = len(word) >= 16 and 0 < digits < len(word) and all(c in "0123456789abcdefABCDEF" for c in word)
                bits = hex_ | (len(word) >= 8 and 0 < digits < len(word)) << 1 | (digits == len(word)) << 2 | title << 3 | (digits > 0) << 4
                words.append((m.start(), m.end(), _form(low), bits))
                plain = False
            else:
                words.append(())
        if plain:
            found = min(2 * len(words) + (stop and bool(words)), self.PLAIN - 2 + (stop and bool(words)))
        else:
            found = self.PLAIN + len(self.told)
            self.told.append((words, stop))
        if len(raw) <= KEPT_LENGTH:
            self[raw] = found
        return found

    def trim(self) -> None:
        if len(self.told) > KEPT_TOKENS or len(self) > KEPT_TOKENS:
            self.clear()
            self.told = []


@cache
def _tokens() -> _Tokens:
    return _Tokens()


CUE_BIT = {"": 0, "secret": 1, "person": 2, "account": 3, "harmless": 4}


def _features() -> tuple[np.ndarray, np.ndarray]:
    """The rows of features, and what the shape rules out, of every code: five bits of shape, the cue, hop and start."""
    code = np.arange(1 << 10)
    bit = lambda k: code >> k & 1
    cue = code >> 5 & 7
    x = np.stack([code * 0 + 1, bit(0), bit(1), bit(2), bit(3), cue == 1, cue == 2, cue == 3, cue == 4, bit(8), bit(9)], axis=1).astype(float)
    # a person needs a capital, a secret or account a digit
    barred = np.stack([code * 0, 1 - bit(3), 1 - bit(4), 1 - bit(4)], axis=1) * -50.0
    return x, barred


class Graph:
    """Candidate words of texts: spans, the text of each, features, chain edges and skip edges.

    Each word has at most one chain and one skip edge before it and after it.
    """

    def __init__(self, *texts: str) -> None:
        known = _tokens()
        known.trim()
        tokens: list[str] = []
        sizes, places = [0], []
        for text in texts:
            tokens += text.split()
            sizes.append(len(tokens))
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            solid = ~SPACES[np.minimum(points, len(SPACES) - 1)]
            places.append(np.flatnonzero(solid & ~np.r_[False, solid[:-1]]))
        n = len(tokens)
        kind = np.fromiter(map(known.__getitem__, tokens), np.int64, n)
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        first = np.array(sizes[:-1], np.int64)  # each text's first token
        at = np.flatnonzero(kind >= known.PLAIN)
        own = np.searchsorted(first, at, side="right") - 1
        # what lies between a token that tells something and the one before it in the text
        before = np.r_[-1, at[:-1]][: len(at)]
        before = np.maximum(before, first[own] - 1)
        plain = np.where(kind < known.PLAIN, kind, 0)
        words, stops = np.r_[0, np.cumsum(plain >> 1)], np.r_[0, np.cumsum(plain & 1)]
        latest = np.maximum.accumulate(np.r_[-1, np.where(plain > 1, np.arange(n), -1)])[at]  # the last plain token with a word
        gap = (words[at] - words[before + 1]).tolist()
        stop = (stops[at] - stops[before + 1] > 0).tolist()
        starts = np.where(latest > before, (plain[np.maximum(latest, 0)] & 1) if n else 0, -1).tolist()
        apart = (at - before > 1).tolist()

        spans, codes, docs, chain, skip = [], [], [], [], []
        doc, cue, hop, start, near, seen = -1, "", 9, True, False, {}
        for d, p, k, g, s, b, a in zip(own.tolist(), place[at].tolist(), (kind[at] - known.PLAIN).tolist(), gap, stop, starts, apart, strict=True):
            if d != doc:
                doc, cue, hop, start, near, seen = d, "", 9, True, False, {}
            if a:
                near = False
            if b >= 0:
                start = b == 1
                hop += g
                if s or hop > 2:
                    cue = ""
            entries, ends = known.told[k]
            left = len(entries)
            for w in entries:
                left -= 1
                if len(w) == 4:
                    j = len(codes)
                    codes.append(w[3] | CUE_BIT[cue] << 5 | (bool(cue) and hop <= 1) << 8 | start << 9)
                    spans.append((p + w[0], p + w[1]))
                    docs.append(d)
                    if near:
                        chain.append((j - 1, j))
                    if (i := seen.get(w[2])) is not None:
                        skip.append((i, j))
                    seen[w[2]] = j
                    near = True
                elif w:  # a cue; its full stop is an abbreviation's
                    cue, hop, start, near = w[0], 0, False, False
                    continue
                else:
                    near = False
                hop, start = hop + 1, ends and not left
                if hop > 2 or start:
                    cue = ""
        self.spans, self.docs = spans, np.array(docs, np.int64)
        self.chain, self.skip = chain, skip
        x, barred = _features()
        code = np.array(codes, np.int64)
        self.x, self.barred = x[code], barred[code]


class Field:
    """Weights: unary (features x labels), chain and skip (labels x labels)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, g: Graph, rounds: int = 50, damp: float = 0.3, least: float = 1e-4) -> np.ndarray:
        """Loopy sum-product: all messages at once, damped, until a text's messages change by less than least. A text
        whose messages have settled is left as it is, so what else is in the graph makes no difference."""
        score = g.x @ self.unary + g.barred
        kinds = [(np.array(e, np.int64).reshape(-1, 2), p) for e, p in ((g.chain, self.chain), (g.skip, self.skip)) if len(e)]
        if not kinds:
            return _softmax(score)
        doc = np.asarray(getattr(g, "docs", np.zeros(0, np.int64)))
        doc = doc if len(doc) == len(score) else np.zeros(len(score), np.int64)
        # messages along each edge, forth and back; a word has at most one edge of a kind before it, and one after it
        flows = []
        for edges, pot in kinds:
            weight = np.exp(pot - pot.max())
            flows += [(edges[:, 0], edges[:, 1], weight), (edges[:, 1], edges[:, 0], weight.T)]
        flows = [(src, dst, weight, doc[src]) for src, dst, weight in flows]
        msgs = [np.zeros((len(f[0]), score.shape[1])) for f in flows]
        live = [np.arange(len(f[0])) for f in flows]
        moving = np.ones(int(doc.max()) + 1, bool)
        for _ in range(rounds):
            belief = score.copy()
            for (_, dst, _, _), m in zip(flows, msgs, strict=True):
                belief[dst] += m
            news, change = [], np.zeros(len(moving))
            for k, (src, _, weight, of) in enumerate(flows):
                e = live[k]
                out = belief[src[e]] - msgs[k ^ 1][e]
                new = np.log(np.exp(out - out.max(axis=1, keepdims=True)) @ weight)
                new -= new.max(axis=1, keepdims=True)
                np.maximum.at(change, of[e], np.abs(new - msgs[k][e]).max(axis=1))
                news.append(new)
            for k, new in enumerate(news):
                msgs[k][live[k]] = damp * msgs[k][live[k]] + (1 - damp) * new
            moving &= change >= least
            live = [e[moving[f[3][e]]] for f, e in zip(flows, live, strict=True)]
            if not any(map(len, live)):
                break
        belief = score
        for (_, dst, _, _), m in zip(flows, msgs, strict=True):
            belief[dst] += m
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(n: int = TRAIN_DOCS, seed: int = TRAIN_SEED) -> Iterator[tuple[str, dict[str, str]]]:
    """Sentences from templates, with the label of each token that has one."""
    rng = random.Random(seed)
    syllables = "an be ca do el fi ga ho in ja ka lu mo na or pa que ra sen ti un ver wi".split()
    word = lambda k=3: "".join(rng.choices(syllables, k=rng.randint(1, k)))
    fill = lambda: " ".join(word() for _ in range(rng.randint(2, 6)))
    hex_ = lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice((24, 32, 40)))) + str(rng.randint(0, 9)) + rng.choice("abcdef")
    number = lambda: "".join(rng.choices("0123456789", k=rng.randint(6, 12)))
    for _ in range(n):
        labels: dict[str, str] = {}
        parts = [fill().capitalize() + "."]
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice(("secret", "person", "account", "harmless", "bare", "bare_number", "bare_name"))
            if kind == "secret":
                v = hex_() if rng.random() < 0.7 else word(4) + number()[:4] + word(4)
                cue = rng.choice(sorted(CUES["secret"]))
                parts += [rng.choice((f'{cue} = "{v}"', f"{cue}: {v}", f"{cue} {v}", f"{cue} is {v}")), fill()]
            elif kind == "person":
                v = word(3).capitalize() + "e"
                parts += [f"{rng.choice(sorted(CUES['person'])).capitalize()}. {v}", fill()]
                if rng.random() < 0.4:
                    second = word(3).capitalize() + "o"
                    parts[-2] += " " + second
                    labels[second.lower()] = "person"
            elif kind == "account":
                v = number()
                parts += [f"{rng.choice(sorted(CUES['account']))} {rng.choice(('', 'no. ', 'is ', ': '))}{v}", fill()]
            elif kind == "harmless":
                v = rng.choice((hex_, number))()
                parts += [f"{rng.choice(sorted(CUES['harmless']))} {v}", fill()]
            else:
                v = {"bare": hex_, "bare_number": number, "bare_name": lambda: word(3).capitalize() + "a"}[kind]()
                parts += [v, fill()]
            labels[v.lower()] = kind if kind in LABELS else ""
            if rng.random() < 0.6:
                parts += [fill() + ",", v, fill() + "."]
        yield " ".join(parts), labels


@cache
def fitted(steps: int = 1500, rate: float = 2.0, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood: each token given its neighbours' true labels, by gradient ascent with momentum."""
    xs, ys, chain_l, chain_r, skips, total = [], [], [], [], [], 0
    for text, labels in examples():
        g = Graph(text)
        if not len(g.x):
            continue
        xs.append(g.x)
        ys += [LABELS.index(labels.get(text[a:b].lower(), "")) for a, b in g.spans]
        chain_l += [a + total for a, _ in g.chain]
        chain_r += [b + total for _, b in g.chain]
        skips += [(a + total, b + total) for a, b in g.skip]
        total += len(g.x)
    x, y = np.concatenate(xs), np.array(ys)
    k = len(LABELS)
    one = np.eye(k)[y]
    left, right, near = np.zeros((total, k)), np.zeros((total, k)), np.zeros((total, k))
    left[chain_r], right[chain_l] = one[chain_l], one[chain_r]
    for a, b in skips:
        near[a] += one[b]
        near[b] += one[a]
    w, t, s = np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros((k, k))
    moves = [np.zeros_like(m) for m in (w, t, s)]
    for _ in range(steps):
        miss = one - _softmax(x @ w + left @ t + right @ t.T + near @ s)
        ds = near.T @ miss
        for m, v, grad in zip((w, t, s), moves, (x.T @ miss, left.T @ miss + miss.T @ right, ds + ds.T), strict=True):
            v *= 0.9
            v += rate * (grad / total - decay * m)
            m += v
    return Field(w, t, s)


def added_spans(texts: list[str], field: Field, taken: list[list[Span]], least: float = 0.5) -> list[list[Span]]:
    """Spans that the field adds to each text, clear of those taken."""
    out: list[list[Span]] = [[] for _ in texts]
    g = Graph(*texts)
    if not len(g.x):
        return out
    p = field.marginals(g)
    best = p.argmax(axis=1)
    starts = [sorted(s for s, _, _ in spans) for spans in taken]
    ends = [list(accumulate((e for _, e, _ in sorted(spans)), max)) for spans in taken]
    for n in np.flatnonzero((best > 0) & (p.max(axis=1) >= least)).tolist():
        (s, e), doc = g.spans[n], int(g.docs[n])
        before = bisect_left(starts[doc], e)
        if not before or ends[doc][before - 1] <= s:
            out[doc].append((s, e, LABELS[best[n]]))
    return out


def spans_of(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans. Texts of about TOGETHER code points are judged at once."""
    out: list[tuple[list[Span], list[Span]]] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= TOGETHER):
            size += len(texts[hi] or "")
            hi += 1
        some = [t or "" for t in texts[lo:hi]]
        base = [base_spans(t) for t in some]
        for b, more in zip(base, added_spans(some, field, base), strict=True):
            out.append((b, sorted([*b, *more], key=lambda s: (s[0], KINDS[s[2]]))))
        lo = hi
    return out


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    return spans_of([text], field)[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list[Span]) -> str:
    """text with each span, or run of overlapping spans, as the kind of its first in brackets."""
    out, end = [], 0
    for s, e, kind in spans:
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def report(docs: DataFrame) -> DataFrame:
    field = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1000):
            cols: dict[str, list] = defaultdict(list)
            for base, spans in spans_of(b.column(1).to_pylist(), field):
                for kind in BASE:
                    cols[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols["spans"].append(joined(spans))
            arrays = [b.column(0), *[pa.array(cols[f"n_{k}"], pa.int64()) for k in BASE], pa.array(cols["base_sha256"], pa.string()), pa.array(cols["spans"], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span masked in text; n_chars, where there is one, follows."""
    field = fitted()
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1000):
            given = b.column(at).to_pylist()
            texts = [None if t is None else masked(t, spans) for t, (_, spans) in zip(given, spans_of(given, field), strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(texts, cols[at].type)
            if size is not None:
                cols[size] = pa.array([n if t is None else len(t) for t, n in zip(texts, cols[size].to_pylist(), strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
