"""Hard negatives, toxicity and source divergence against brute force, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import divergence, hard_negatives, toxicity

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("n", "leaf", "part", "score", "to", "low", "high", "slots", "vec", "cand", "term", "p", "q", "base", "value", "rank", "item", "y", "h", "x.y")


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


def mined(rows, positives=5, negatives=3, every=50):
    """The contract, pair by pair."""
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        own[i] = min(own.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in own.items():
        if a % every:
            continue
        score = {c: sum(x * y for x, y in zip(v, w)) for c, (_, w) in own.items() if c != a}
        order = sorted(score, key=lambda c: (-score[c], c))
        for p in [c for c in order if own[c][0] == label][:positives]:
            fine = [c for c in order if own[c][0] != label and 50 * score[p] <= 100 * score[c] <= 95 * score[p]]
            out += [(a, p, k + 1, c, score[p], score[c]) for k, c in enumerate(fine[:negatives])]
    return sorted(out, key=str)


def vectors(rng, n, dim=8):
    centres = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.15) for x in rng.choice(centres)], rng.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"leaf_rows": 16, "anchor_rows": 4}, {"leaf_rows": 8, "anchor_rows": 2, "max_depth": 3, "sample": 40}])
def test_hard_negatives(spark, sizes):
    rng = random.Random(3)
    rows = vectors(rng, 600)
    rows += [(600 + i, rows[5][1], i % 3) for i in range(60)]  # copies: ties in every score
    rows += [(700, None, 1), (None, rows[0][1], 1), (750, rows[1][1], None), (800, [float("nan")] * 8, 2), (850, [None] + [0.1] * 7, 2), (900, [float("-inf")] + [0.1] * 7, 2)]
    rows += [(950, [0.0] * 8, 3), (1000, [], 4), (1050, [0.3, 0.2], 5), rows[0], (0, rows[7][1], 0)]
    got = hard_negatives.hard_negatives(clashing(spark.createDataFrame(rows, VECTORS)).repartition(3), **sizes)
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows)


def test_hard_negatives_drops_node_pairs():
    """Far clusters are ruled out without a look at their rows."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(10 * c, 1, (64, 4)) for c in (-3, -1, 1, 3)]).round()
    tree = hard_negatives.fit_tree(rows, 3, 4)
    leaf = tree.leaf_of(rows)
    lo, hi = np.full((8, 4), np.inf), np.full((8, 4), -np.inf)
    np.minimum.at(lo, leaf, rows)
    np.maximum.at(hi, leaf, rows)
    radius = np.zeros(8)
    np.maximum.at(radius, leaf, np.linalg.norm(rows - tree.centres[leaf], axis=1))
    nodes = hard_negatives.Nodes.above(lo, hi, tree.centres, radius)
    scores = rows @ rows.T
    order = np.argsort(leaf, kind="stable")
    own = rows[order]
    low = np.sort(scores, axis=1)[:, -5][order][:, None]
    slots = np.zeros_like(low, dtype=np.int64)
    group = hard_negatives.Anchors(leaf[order], order, slots[:, 0], own, slots, slots, low, np.full_like(low, 1e9))
    found = dict(hard_negatives.walked(group, nodes))
    for i in range(len(own)):
        for j in np.flatnonzero(scores[order[i]] >= low[i, 0]):
            assert leaf[j] == leaf[order[i]] or found[leaf[j]][i]
    assert sum(int(m.sum()) for m in found.values()) < 0.5 * 7 * len(own)


def test_anchors_alone_are_bounded_along_the_lines():
    """What a leaf can reach, by length and along the lines above it, holds all its rows and rules out far anchors."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(600, 12))
    rows = (256 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).round()
    tree = hard_negatives.fit_tree(rows, 4, 12)
    leaf = tree.leaf_of(rows)
    along = tree.along(rows, leaf)
    norm, lo, hi = np.zeros(16), np.full((16, 4), np.inf), np.full((16, 4), -np.inf)
    np.maximum.at(norm, leaf, np.linalg.norm(rows, axis=1))
    np.minimum.at(lo, leaf, along)
    np.maximum.at(hi, leaf, along)
    nodes = hard_negatives.Nodes([], [], [], [], tree, norm, lo, hi)
    scores, ruled_out = rows @ rows.T, 0
    for c in range(16):
        low, high = nodes.reach(rows, c)
        own = scores[:, leaf == c]
        assert (own.min(axis=1) >= low).all()
        assert (own.max(axis=1) <= high).all()
        ruled_out += int((high < 0.98 * 65536).sum())
    assert ruled_out > 0.6 * 16 * 600  # no copies of the row can be there


def test_hard_negatives_send_no_tasks_to_the_driver(spark):
    rows = [(i, [float(i % 7), float(i % 11)], i % 3) for i in range(400)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), leaf_rows=20, anchor_rows=4)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [0.5], 1), (2, [0.25], 2)], VECTORS)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(50, [0.5], 1)], VECTORS)).count() == 0
    big = [(50, [3e6, 1.0], 1), (51, [2e6, 1.0], 1), (52, [1.5e6, 2.0], 2)]
    assert sorted(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(big, VECTORS)).collect())) == mined(big)


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def diverged(rows, min_docs, top):
    df, cells, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]
        cells.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= min_docs)
        own = sorted(s for x, s in groups if x == lang)
        counts = {s: {t: cells[lang, s, t] for t in kept} for s in own}
        counts[None] = {t: sum(counts[s][t] for s in own) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()} for s, c in counts.items()}
        for s in own:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][t] - p[None][t], t) for t in kept if counts[s][t] and p[s][t] > p[None][t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("width", "block"), [(None, 64), (64, 2), (1 << 16, 1)])
def test_divergence(spark, monkeypatch, width, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(9)
    words = ["alpha", "Beta", "GAMMA", "dél", "ÉTÉ", "été", "x1y", "zeta'z"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 40))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", "Ä", None, "dd"])) for i in range(400)]
    rows += [(1000 + i, "alpha beta", "en", f"site{i}") for i in range(9)] + [(2000, None, "xx", "lone"), (2001, "", "xx", "other"), (2002, "7 8 ---", "yy", "only"), rows[3], rows[3]]
    df = spark.createDataFrame([(i, t, x, s, 0) for i, t, x, s in rows], DOCS).repartition(5)
    for top in (50, 2):
        got = sorted(map(tuple, divergence.divergence(clashing(df), min_docs=12, top=top, width=width).select("lang", "source", "part", "item", "value", "rank").collect()))
        assert got == diverged(rows, 12, top)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_never_underestimates(spark):
    rng = random.Random(4)
    texts = [" ".join({f"t{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(9)}) for _ in range(300)]
    df = spark.createDataFrame([(t, "en", "s") for t in texts], "text string, lang string, source string").repartition(4)
    docs = collections.Counter(t for x in texts for t in x.split())
    for width in (64, 4096):
        bits = divergence.possible(df, width, 5)
        keep = dict(zip(docs, divergence.surviving(bits, b"en", [t.encode() for t in docs], width), strict=True))
        assert all(keep[t] for t, n in docs.items() if n >= 5)
    assert not all(keep.values())  # a wide one drops most of the rest


def toxic_corpus(rng, n=1500):
    plain = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("ra", "ne", "ti") for c in ("m", "n", "sh", "l")]
    rows, labels = [], []
    for i in range(n):
        words, y, lang = rng.choices(plain, k=rng.randint(3, 120)), rng.random() < 0.15, rng.choice(["en", "qq"])
        if y:
            bad = ["idiot", "scum", "Moron", "loser"] if lang == "en" else [f"zorg{s}" for s in ("al", "em", "in", "ul", "ok")] + ["vurtel", "vurtom"]
            for w in rng.sample(bad, rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), w)
        rows.append((i, " ".join(words), lang, f"s{i % 3}"))
        if rng.random() < 0.7:
            labels.append((i, 1, int(y)))
    truth = {i: "idiot" in t or "scum" in t or "Moron" in t or "loser" in t or "zorg" in t or "vurt" in t for i, t, _, _ in rows}
    return rows, labels, truth


def scored(spark, rows, labels, **more):
    docs = spark.createDataFrame([(*r, None) for r in rows], DOCS).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return toxicity.toxicity_scores(clashing(docs), clashing(marks), **more).collect()


def test_toxicity_on_held_out_rows(spark):
    rows, labels, truth = toxic_corpus(random.Random(6))
    got = scored(spark, rows, labels)
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    caught = sum(r.predicted for r in held if truth[r.doc_id]) / sum(truth[r.doc_id] for r in held)
    wrong = sum(r.predicted for r in held if not truth[r.doc_id]) / sum(not truth[r.doc_id] for r in held)
    assert caught > 0.95
    assert wrong < 0.01
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    # labels of held-out rows are not looked at, nor are lang and source
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    other = [(i, t, "xx", None) for i, t, _, _ in rows]
    assert {(r.doc_id, r.score) for r in scored(spark, other, flipped)} == {(r.doc_id, r.score) for r in got}


def test_toxicity_edges(spark):
    rows, labels, _ = toxic_corpus(random.Random(8), 300)
    long = "barn dont " * 200_000
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, long, "en", "s"), (1003, long + "you idiot", None, None), (None, "scum", "en", "s"), rows[2], rows[2]]
    labels += [(5000, 1, 1), (None, 1, 1), (7, 0, None), labels[0]]
    got = collections.defaultdict(list)
    for r in scored(spark, rows, labels):
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got[1000][0].score == got[1001][0].score
    assert got[1000][0].predicted == got[1002][0].predicted == 0
    assert got[None][0].predicted == 1
    assert not got[None][0].held_out
    assert len(got[2]) == 3
    assert len({r.score for r in got[2]}) == 1
    # without labels the given lists vote
    plain = {r.doc_id: r.predicted for r in scored(spark, rows, [])}
    assert plain[None] == 1
    assert plain[1001] == 0
    assert scored(spark, [], labels) == []


def test_label_model_finds_accuracies_and_correlations():
    """Planted voters: their rates are found without labels, and a voter that repeats another hangs on it."""
    rng = np.random.default_rng(2)
    n, k = 40_000, len(toxicity.VOTERS)
    y = rng.random(n) < 0.2
    rates = np.stack([np.linspace(0.01, 0.06, k), np.linspace(0.85, 0.4, k)])
    bits = rng.random((n, k)) < rates[y.astype(int)]
    bits[:, 4] = np.where(rng.random(n) < 0.95, bits[:, 3], bits[:, 4])
    patterns, counts = np.unique(bits @ (1 << np.arange(k)), return_counts=True)
    none = toxicity.Votes(np.zeros((0, k)), np.zeros(0))
    model = toxicity.fit_labels(toxicity.tally(patterns, counts), (none, none))
    assert abs(model.prior - 0.2) < 0.02
    assert model.parent[4] == 3 or model.parent[3] == 4
    found = model.posterior(toxicity.as_bits(patterns)) > 0.5
    truth = {p: c for p, c in zip(*np.unique((bits @ (1 << np.arange(k)))[y], return_counts=True), strict=True)}
    hits = sum(truth.get(p, 0) for p, f in zip(patterns, found, strict=True) if f)
    assert hits / y.sum() > 0.97
    root = int(np.flatnonzero(model.parent < 0)[0])
    assert np.allclose(model.table[:, root, 0, 1], rates[:, root], atol=0.03)
