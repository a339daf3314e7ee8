"""The pipeline against plain versions of its stages, written from their rules."""

import hashlib
import random
import re
from collections import Counter

import pytest

from lattica.llm import line_quality, pii
from tests.llm.test_llm import ODD, brute_base, frame, texts
from tests.llm.test_models import plain_messages

P = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    """The kept text, or None."""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    if len(words) < 50 or 2 * len(inside) > len(words):
        return None
    kept, lost, size = [], 0, 0
    for line in text.split("\n"):
        w = WORDS.findall(line)
        chars, marks, bars = sum(map(len, w)), sum(c in "#*$%&|<>" for c in line), sum(c in "|»›>•·" for c in line)
        bad = len(w) < 6 and not re.search(line_quality.CLOSED, line)
        bad |= 5 * marks > chars or 10 * len(re.findall(r"!!|\?\?", line)) > 3 * len(w)
        bad |= (bars >= 3 and 8 * bars >= len(w)) or (len(w) <= 8 and re.search(line_quality.MENU.replace("(?i:", "(?:"), line, re.I) is not None)
        bad |= len(w) <= 40 and any(x in line.lower() for x in line_quality.PHRASES)
        size += chars
        if w and bad:
            lost += chars
        else:
            kept.append(line)
    return "\n".join(kept) if 5 * lost <= 2 * size else None


def plain_groups(docs):
    """The ids that stay: of each group linked by a similarity of 0.8, the smallest."""
    sets = {}
    for i, t in docs.items():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, label = sorted(docs), {i: i for i in docs}
    near = {i: [j for j in ids if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in ids}
    for _ in ids:
        label = {i: min(label[j] for j in near[i]) for i in ids}
    return {i for i in ids if label[i] == i}


def plain_mask(text, field):
    base = brute_base(text)
    g = pii.Graph(text)
    p = plain_messages(g, field) if len(g.x) else []
    more = [(s, e, pii.LABELS[k]) for (s, e), k, q in zip(g.spans, [x.argmax() for x in p], [x.max() for x in p]) if k and q >= 0.5 and all(b <= s or a >= e for a, b, _ in base)]
    out, end = "", 0
    for s, e, kind in sorted(base + more, key=lambda x: (x[0], list(pii.KINDS).index(x[2]))):
        if s >= end:
            out += text[end:s] + f"[{kind.upper()}]"
        end = max(end, e)
    return out + text[end:]


def plain_mix(docs):
    """From id: (text, source): how often each is taken."""
    size = {i: len(WORDS.findall(t)) for i, (t, _) in docs.items()}
    names = sorted({s for _, s in docs.values() if s is not None}) + ([None] if any(s is None for _, s in docs.values()) else [])
    own = {s: sum(size[i] for i, (_, x) in docs.items() if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(own.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * own[s]}
        target |= {s: 2.0 * own[s] for s in over} if over else share
        left -= sum(2.0 * own[s] for s in over)
        open_ = open_ - over if over else set()
    out = {}
    for s in names:
        rate = target[s] / own[s] if own[s] else 0.0
        tries = []
        for k in range(32):
            u = lambda i, k=k: int(hashlib.md5(f"17:{k}:{i}".encode()).hexdigest()[:13], 16) / 16**13
            n = {i: int(rate) + (u(i) < rate - int(rate)) for i, (_, x) in docs.items() if x == s}
            tries.append((abs(sum(n[i] * size[i] for i in n) - target[s]), k, n))
        out |= min(tries, key=lambda x: x[:2])[2]
    return out


def corpus():
    rng = random.Random(12)
    rows = texts(110)
    base = [w for w in rows[0][1].split(" ")]
    for k in range(8):  # near copies
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = f"changed{k}"
        rows.append((800 + k, " ".join(copy), "en", "b", 0))
    rows.append((900, ODD[8][1] + " Mr. Tomase wrote: token = 9f8e7d6c5b4a39281706 today. " + " ".join(f"own{k}" for k in range(70)) + ".", "en", "z", 10))
    rows += [(901, None, "en", "z", 0), (902, "", "en", None, 0), (903, rows[5][1], "en", None, 0)]
    return rows


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    rows = corpus()
    frame(spark, rows).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    source = {r[0]: r[3] for r in rows}
    clean = {i: plain_quality(t or "") for i, t, *_ in rows}
    clean = {i: t for i, t in clean.items() if t is not None}
    assert 20 < len(clean) < len(rows) - 5
    single = plain_groups(clean)
    assert len(single) < len(clean) - 5
    field = pii.fitted()
    masked = {i: plain_mask(clean[i], field) for i in single}
    want = {i: n for i, n in plain_mix({i: (t, source[i]) for i, t in masked.items()}).items() if n}
    assert Counter(r.doc_id for r in got) == Counter(want)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in got:
        assert r.ids == sp.encode(masked[r.doc_id]) and r.n_tokens == len(r.ids) and r.decoded == masked[r.doc_id]
    assert any("[EMAIL]" in t and "[SECRET]" in t for t in masked.values())


def test_stages_are_whole(spark, tmp_path):
    """Odd rows go through every stage; all but the last keep the columns."""
    import corpus_pipeline

    docs = frame(spark, [*ODD, ODD[3], ODD[4], (None, "no name here", None, None, None)], extra=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        else:
            assert out.count() == docs.count()
