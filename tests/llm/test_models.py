"""The fitted operators (personal data, languages, neighbours) against plain versions of themselves."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import langid, permindex, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# The skip-chain field


def plain_messages(g, f, rounds=50, damp=0.3):
    """Loopy sum-product over a graph of one text, edge by edge."""
    score = g.x @ f.unary + g.barred
    edges = [(a, b, f.chain) for a, b in g.chain] + [(a, b, f.skip) for a, b in g.skip]
    flows = [(a, b, p) for a, b, p in edges] + [(b, a, p.T) for a, b, p in edges]
    back = [(k + len(edges)) % (2 * len(edges)) for k in range(2 * len(edges))]
    msg = [np.zeros(4) for _ in flows]
    for _ in range(rounds):
        belief = score.copy()
        for (_, b, _), m in zip(flows, msg):
            belief[b] += m
        new = []
        for k, (a, _, p) in enumerate(flows):
            out = belief[a] - msg[back[k]]
            v = np.array([math.log(sum(math.exp(out[y] - out.max() + p[y, z]) for y in range(4))) for z in range(4)])
            new.append(v - v.max())
        change = max((np.abs(n - m).max() for n, m in zip(new, msg)), default=0)
        msg = [damp * m + (1 - damp) * n for n, m in zip(new, msg)]
        if change < 1e-4:
            break
    belief = score.copy()
    for (_, b, _), m in zip(flows, msg):
        belief[b] += m
    e = np.exp(belief - belief.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def mixed_texts(n=60, seed=8):
    rng = random.Random(seed)
    words = "Tomase Maria 123456 654321 token password Mr. account the a of hex 9f8e7d6c5b4a39281706 and, end. Is commit x-1 Tomase's 12345678".split()
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


def test_loopy_messages_are_the_plain_ones():
    f = pii.fitted()
    texts = mixed_texts()
    loops = 0
    for t in texts:
        g = pii.Graph(t)
        if len(g.x):
            loops += len(g.chain) + len(g.skip) >= len(g.x)
            assert np.allclose(f.marginals(g), plain_messages(g, f), atol=1e-6)
    assert loops > 10


def test_texts_in_a_batch_are_judged_alone():
    f = pii.fitted()
    texts = [*mixed_texts(), "", None, "x" * 3000]
    assert pii.spans_of(texts, f) == [pii.all_spans(t, f) for t in texts]


def test_field_needs_no_cue():
    """No text is passed by: without a cue word the field's own marginals decide."""
    f = pii.fitted()
    bare = "123456 Tomase 654321 Maria " * 4
    g = pii.Graph(bare)
    p = plain_messages(g, f)
    want = [(s, e, pii.LABELS[k]) for (s, e), k, q in zip(g.spans, p.argmax(axis=1), p.max(axis=1)) if k and q >= 0.5]
    assert [s for s in pii.all_spans(bare, f)[1]] == want and want


def test_similar_words_are_linked():
    f = pii.fitted()
    t = "I met Mr. Tomase today. Then Tomase's dog ran off."
    assert [t[s:e] for s, e, k in pii.all_spans(t, f)[1] if k == "person"] == ["Tomase", "Tomase's"]


# Languages


def brute_members(rows):
    """Members of each language's filter, by counting."""
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        if text:
            counts[lang].update(langid.grams(langid.letters(text)).tolist())
    share = {}
    for lang, c in counts.items():
        total, most = sum(c.values()), max(c.values(), default=0)
        kept = {g: n for g, n in c.items() if n >= min(langid.LEAST, most) and n >= langid.MIN_SHARE * total}
        whole = sum(kept.values())
        share[lang] = {g: n / whole for g, n in kept.items()}
    top = Counter()
    for s in share.values():
        for g, v in s.items():
            top[g] = max(top[g], v)
    return {lang: {g for g, v in s.items() if v * langid.CONTRAST >= top[g]} for lang, s in share.items()}


def brute_predict(text, members, filled):
    points = langid.letters(text or "")
    if not (points != 32).any():
        return "und", 0.0
    g = langid.grams(points)
    at = langid.slots(g)
    best = ("und", -1.0)
    for lang in sorted(members):
        hits = sum(all(int(a[k]) in filled[lang] for a in at) for k in range(len(g)))
        false = (len(filled[lang]) / langid.SLOTS) ** langid.HASHES
        score = min(1.0, max(0.0, (hits / len(g) - false) / (1 - false)))
        if score > best[1]:
            best = (lang, score)
    return best


def test_languages_by_brute_force(spark):
    rng = random.Random(5)
    tongues = {"aa": "an be ca do el", "bb": "sti kro vna plu", "cc": "шу ка ро ми", "rare": "zyx wvu"}
    rows = []
    for i in range(160):
        lang = "rare" if i in (3, 14, 25, 36, 90) else rng.choice(["aa", "bb", "cc"])
        words = ["".join(rng.choices(tongues[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(words), lang))
    rows += [(900, None, "aa"), (901, "12 !!", "bb"), (902, "an be", None)]
    df = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], DOCS)
    got = {r.doc_id: r for r in langid.report(df).collect()}
    members = brute_members([r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[2]])
    filled = {x: {int(s) for a in langid.slots(np.array(sorted(m), np.uint64)) for s in a} for x, m in members.items()}
    assert set(members) == set(tongues)
    for i, t, _ in rows:
        lang, score = brute_predict(t, members, filled)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(max(score, 0.0))
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_every_language_is_learned(spark):
    """More languages than a mask has bits, some with a single short text."""
    rows = [(i, " ".join(chr(0x4E00 + 7 * i + k) * 2 for k in range(3)), f"l{i:03d}", "s", 0) for i in range(150)]
    f = langid.fit(spark.createDataFrame(rows, DOCS))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert f.langs == [r[2] for r in learned] and all(f.predict(t)[0] == x for _, t, x, *_ in learned)


# Neighbours


def brute_nearest(rows, k=20, every=20):
    """The nearest of every query id, an id's score being the best of its vectors."""
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q in {i for i, _ in fine if i % every == 0}:
        best = {}
        for i, v in fine:
            for j, u in fine:
                if j == q and i != q:
                    n = min(len(u), len(v))
                    s = float(u[:n] @ v[:n])
                    best[i] = max(best.get(i, -math.inf), s)
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_neighbours_of_odd_rows(spark):
    """Shared ids, repeated rows, doubles, short vectors, rows that take no part; few enough for the search to be exact."""
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)]
    rows += [(20, [rng.uniform(-1, 1) for _ in range(5)]), (7, [rng.uniform(-1, 1) for _ in range(5)]), rows[40], rows[3], (3, [0.5, 0.25])]
    rows += [(80, None), (81, []), (100, [0.0] * 5), (120, [1.0, None]), (140, [float("nan")] * 5), (160, [float("inf"), 1.0]), (None, [1.0] * 5)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("key", "id", "ids", "r", "rank", "score", "query_id", "near"):
        df = df.withColumn(c, F.lit(f"{c}!"))
    got = defaultdict(list)
    for r in permindex.neighbours(df, rerank=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [(r, i) for r, i, _ in got[q]] == [(n + 1, i) for n, (i, _) in enumerate(near)]
        assert all(s == pytest.approx(t, abs=1e-15) for (_, _, s), (_, t) in zip(got[q], near))


def test_scores_are_doubles(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, 1.0])], "vec_id long, embedding array<double>")
    assert permindex.neighbours(df).first()["score"] == pytest.approx(0.1 * 0.3 + 0.2 * 1.0, abs=1e-16)


def test_recall_of_the_shipped_setting(spark):
    """The query's own pivots, prefix and share on the given vectors; several chunks, runs and blocks give the same
    lists as a search of every vector for the ids found."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null").collect()
    got = defaultdict(list)
    for r in permindex.neighbours(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect():
        got[r.query_id].append(r.vec_id)
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    ask = np.flatnonzero(ids % 20 == 0)
    hits = 0
    for q in ask:
        s = x @ x[q]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != ids[q]][:20]
        hits += len(set(best) & set(got[ids[q]]))
    assert hits / (20 * len(ask)) >= 0.9


def test_chunks_and_runs(spark, monkeypatch):
    """An index of many chunks and runs, read whole, gives the exact lists."""
    monkeypatch.setattr(permindex, "RUN", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = permindex.classes(permindex.keyed(df, "vec_id", "embedding", 20), 20)
    index = permindex.Index.build(found, "<f8", 100, 16, 1024)
    assert index.chunks == 3
    asked = permindex.keyed(df.where("vec_id % 300 = 0"), "vec_id", "embedding", 0)
    got = defaultdict(list)
    for r in index.search(asked, 5, 1.0).collect():
        got[r.key].append((-r.score, r.id))
    assert len(got) == 10
    for r in asked.collect():
        s = x @ x[r.id]
        assert [i for _, i in sorted(got[r.key])[:5]] == np.lexsort((np.arange(3000), -s))[:5].tolist()


# Quality rules


def test_long_lines_of_prose_may_hold_marks_and_phrases(spark):
    from lattica.llm import line_quality

    prose = "The baker said that a cookie needs more butter than most people think and that the « old » recipe from the « north » was the best of all those she had tried in forty years of work, even more than the one that her teacher wrote down for her."
    lines = {prose: False, "Alle Rechte vorbehalten, Verlag und Druckerei der Stadt am Fluss.": True, "Startseite Kontakt": True, "a | b | c | d | e | f.": True}
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.bad for r in df.select("line", line_quality.line_fails(F.col("line")).alias("bad")).collect()} == lines
