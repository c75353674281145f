"""Toxicity from weak supervision.

Voters are lexicons and patterns. Some word lists are given; others are found on labelled documents: words
and word stems that are far more frequent in toxic ones, by a likelihood ratio, each dealt by its form to one
of several lexicons, so that voters err apart. Every document gets a vote pattern, a bit for each voter; patterns are
counted over all documents, at most 2 ** voters of them whatever the corpus.

The generative model has a hidden class, and each voter's bit depends on the class and on one other voter:
the tree of the largest mutual information given the class holds the correlations, so voters that repeat
each other don't count twice. Expectation-maximisation fits it on the counted patterns; labels of the fitting sample
enter as one more voter whose accuracy is estimated too. The model's posteriors of the sample are the targets of a linear
classifier over lexicon entries and voters, which then scores every document.

Labels are used of fitting rows only (crc32 of the doc_id as text, modulo `folds`, is not `held`); language,
source and doc_id are never inputs. Both text passes are without shuffle but for counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, text_slices, word_codes, written

#: Words of contempt by kind.
LISTS = {
    "mind": "brainless cretin dimwit dumb fool idiot imbecile moron stupid".split(),
    "worth": "clown disgusting garbage loser pathetic scum trash vermin worthless".split(),
    "oaths": "arse asshole bastard bitch crap fuck fucking shit whore".split(),
}
YOU = frozenset(b"you your youre ur yourself u".split())
STEMS = (4, 5, 6)
VOTERS = (*LISTS, "words_a", "words_b", "words_c", "stems_4a", "stems_4b", "stems_5a", "stems_5b", "several", "dense", "addressed", "shouting", "exclaims", "none", "none_long")
BIT = {name: 1 << i for i, name in enumerate(VOTERS)}
#: Voters that a single word sets off.
BY_WORD = sum(BIT[v] for v in VOTERS[:10])
UPPER = bytes(range(65, 91))
SMALL = bytes(range(97, 123))
#: Words whose entries a worker remembers.
REMEMBERED = 400_000


def grams(word: bytes) -> Iterator[str]:
    """The word in lower case, and its stems with a sign behind them."""
    w = word.decode(errors="replace").lower()
    yield w
    for k in STEMS:
        if len(w) > k:
            yield w[:k] + "+"


def voter_of(gram: str) -> int:
    h = xxhash.xxh3_64_intdigest(gram)
    if gram[-1] != "+":
        return BIT["words_" + "abc"[h % 3]]
    return BIT["stems_" + ("4" if len(gram) == 5 else "5") + "ab"[h % 2]]


@dataclass
class Entries:
    """The lexicons: each entry's voters and its place among the features."""

    bits: dict[str, int]
    known: dict[bytes, tuple[int, tuple[int, ...]]] = field(default_factory=dict)
    place: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.place = {g: i + len(VOTERS) for i, g in enumerate(sorted(self.bits))}

    def of(self, word: bytes) -> tuple[int, tuple[int, ...]]:
        """(voters, features) of a word."""
        found = self.known.get(word)
        if found is None:
            hits = [g for g in grams(word) if g in self.bits]
            found = 0, ()
            if hits:
                found = sum({1 << i for g in hits for i in range(len(VOTERS)) if self.bits[g] >> i & 1}), tuple(self.place[g] for g in hits)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found


def lexicon(induced: list[str]) -> Entries:
    bits = {g: voter_of(g) for g in induced}
    for name, words in LISTS.items():
        for w in words:
            bits[w] = bits.get(w, 0) | BIT[name]
    return Entries(bits)


def seen(texts: list[bytes], entries: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pattern of each text; rows and features of the entries found, each pair once)."""
    codes, sizes, words = word_codes([t.translate(LETTERS).split() for t in texts])
    found = [entries.of(w) for w in words]
    bits = np.fromiter((b for b, _ in found), np.int64, len(found))
    hit, you = bits > 0, np.fromiter((w in YOU for w in words), bool, len(words))
    row = np.repeat(np.arange(len(texts)), sizes)
    pattern, near = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    at = np.flatnonzero(hit[codes])
    np.bitwise_or.at(pattern, row[at], bits[codes[at]])
    for back in (1, 2, 3):
        pair = at[at >= back]
        pair = pair[you[codes[pair - back]] & (row[pair - back] == row[pair])]
        near[row[pair]] = True
    once = np.unique(row[at] * max(1, len(words)) + codes[at])
    which, word = once // max(1, len(words)), once % max(1, len(words))
    n_hits, kinds = np.bincount(row[at], minlength=len(texts)), np.bincount(which, minlength=len(texts))
    shout = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        upper = len(t) - len(t.translate(None, UPPER))
        shout[i] = upper > 20 and upper > 0.4 * (upper + len(t) - len(t.translate(None, SMALL)))
    for name, on in (
        ("several", kinds >= 2), ("dense", (n_hits > 0) & (50 * n_hits >= sizes)), ("addressed", near), ("shouting", shout),
        ("exclaims", np.fromiter((b"!!" in t for t in texts), bool, len(texts))), ("none", (n_hits == 0) & (sizes < 50)), ("none_long", (n_hits == 0) & (sizes >= 50)),
    ):
        pattern |= np.where(on, BIT[name], 0)
    lists = [found[w][1] for w in word.tolist()]
    flat = np.fromiter((f for x in lists for f in x), np.int64)
    pairs = np.unique(np.stack([np.repeat(which, list(map(len, lists))), flat]), axis=1) if len(flat) else np.zeros((2, 0), np.int64)
    return pattern, pairs[0], pairs[1]


def signature(words: list[bytes]) -> int:
    """The least hash of three words in a row: near copies mostly share it."""
    runs = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return min(map(xxhash.xxh3_64_intdigest, runs)) - (1 << 63)


def fitting_labels(labels: DataFrame, folds: int, held: int, label: str) -> DataFrame:
    """(doc_id, y) of the fitting rows; a document with several labels is toxic if one says so."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).alias("y")).where("doc_id is not null and y is not null")
    return own.where(fold_of(folds) != held).groupBy("doc_id").agg(F.max("y").alias("y"))


def fold_of(folds: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def fitting_sample(rows: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, y, text): of each class the documents with the `sample` smallest hashes, near copies once. Where a class
    has no labels, documents without a label (y is null) stand beside."""
    turn = F.xxhash64("doc_id")
    some = [labels.where("y" if y else "not y").orderBy(turn, "doc_id").limit(sample) for y in (True, False)]
    if any(own.isEmpty() for own in some):
        free = rows.where("doc_id is not null").select("doc_id", F.lit(None).cast("boolean").alias("y")).distinct().join(labels, "doc_id", "left_anti")
        some.append(free.orderBy(turn, "doc_id").limit(sample))
    ids = F.broadcast(written(reduce(DataFrame.unionByName, some), "tox-ids"))  # at most 3 * sample rows of 9 bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                sig = pa.array([signature(t.translate(LETTERS).split()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, sig], names=["doc_id", "y", "text", "sig"])

    signed = rows.join(ids, "doc_id").select("doc_id", "y", "text").mapInArrow(work, "doc_id long, y boolean, text string, sig long")
    first = signed.groupBy("y", "sig").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    return written(first.select("x.doc_id", "y", "x.text"), "tox-sample")


def telling(sample: DataFrame, least: float, ratio: float) -> list[str]:
    """Words and stems with a likelihood ratio of `least` or more that are `ratio` times as frequent in toxic documents."""
    sample = sample.where("y is not null")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in batches:
            for part, texts in text_slices(batch):
                for y, text in zip(part.column("y").to_pylist(), texts, strict=True):
                    counts[y].update({g for w in set(text.translate(LETTERS).split()) for g in grams(w)})
        for y, found in enumerate(counts):
            names, n = list(found), list(found.values())
            for i in range(0, len(names), 1 << 16):
                stop = slice(i, i + (1 << 16))
                none = [0] * len(n[stop])
                yield pa.RecordBatch.from_arrays([pa.array(names[stop]), *(pa.array(n[stop] if y == z else none, pa.int64()) for z in (1, 0))], names=["gram", "bad", "good"])

    total = sizes[True] + sizes[False]
    found = sample.mapInArrow(work, "gram string, bad long, good long").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = F.col("bad") + F.col("good")

    def gain(x: str, size: int) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) * total / (n * size))).otherwise(0.0)

    kept = found.where(F.col("bad") * sizes[False] > ratio * sizes[True] * F.col("good")).where(2 * (gain("bad", sizes[True]) + gain("good", sizes[False])) >= least)
    return sorted(kept.select("gram").toArrow().column("gram").to_pylist())  # as many as a bounded sample has


@dataclass
class Votes:
    """Patterns as bits, and how often each is seen."""

    bits: np.ndarray
    n: np.ndarray


def as_bits(patterns: np.ndarray) -> np.ndarray:
    return (np.asarray(patterns, np.int64)[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


class LabelModel:
    """prior of toxic; parent of each voter (-1: none); table[class, voter, parent's bit, bit]; says[class, label]."""

    def __init__(self) -> None:
        k = len(VOTERS)
        self.prior, self.parent = 0.1, np.full(k, -1)
        self.table = np.full((2, k, 2, 2), 0.5)
        self.says = np.array([[0.95, 0.05], [0.05, 0.95]])

    def odds(self, bits: np.ndarray) -> np.ndarray:
        above = np.where(self.parent >= 0, bits[:, self.parent], 0).astype(int)
        own, at = bits.astype(int), np.arange(bits.shape[1])
        ratio = np.log(self.table[1] / self.table[0])
        return ratio[at, above, own].sum(axis=1) + np.log(self.prior / (1 - self.prior))

    def posterior(self, bits: np.ndarray, label: int | None = None) -> np.ndarray:
        odds = self.odds(bits) + (0 if label is None else np.log(self.says[1, label] / self.says[0, label]))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def tree(self, bits: np.ndarray, weights: list[np.ndarray]) -> None:
        """The spanning tree of voters with the largest mutual information given the class."""
        k = bits.shape[1]
        link, all_weight = np.zeros((k, k)), sum(w.sum() for w in weights)
        for w in weights:
            share = w.sum() / max(all_weight, 1e-12)
            w = w / max(w.sum(), 1e-12)
            one = w @ bits
            both = bits.T @ (w[:, None] * bits)
            cells = ((both, one[:, None] * one), (one[:, None] - both, one[:, None] * (1 - one)), (one - both, (1 - one)[:, None] * one), (1 - one[:, None] - one + both, (1 - one)[:, None] * (1 - one)))
            link += share * sum(np.where((p > 1e-12) & (e > 1e-12), p * np.log(np.maximum(p, 1e-12) / np.maximum(e, 1e-12)), 0) for p, e in cells)
        self.parent[:] = -1
        inside = [0]
        while len(inside) < k:
            rest = [j for j in range(k) if j not in inside]
            part = link[np.ix_(inside, rest)]
            i, j = np.unravel_index(int(part.argmax()), part.shape)
            self.parent[rest[j]] = inside[i]
            inside.append(rest[j])

    def learn(self, bits: np.ndarray, weights: list[np.ndarray], pseudo: float) -> None:
        above = np.where(self.parent >= 0, bits[:, self.parent], 0)
        for c, w in enumerate(weights):
            for p in (0, 1):
                given = w[:, None] * (above == p)
                on = (given * bits).sum(axis=0)
                base = np.clip((w @ bits) / max(w.sum(), 1e-12), 0.02, 0.98)  # of the voter whatever its parent
                share = (on + pseudo * base) / (given.sum(axis=0) + pseudo)
                self.table[c, :, p] = np.stack([1 - share, share], axis=1)


def fit_labels(all_docs: Votes, labelled: tuple[Votes, Votes], rounds: int = 40, pseudo: float = 5.0) -> LabelModel:
    """Expectation-maximisation over all documents' patterns and those of the labelled sample (clean, toxic). The
    sample weighs as much as what all documents give to a class: labels are few, and anchor the classes."""
    model = LabelModel()
    good, bad = labelled
    bits = np.concatenate([all_docs.bits, good.bits, bad.bits])
    start = np.where((all_docs.bits @ (2.0 ** np.arange(len(VOTERS)))).astype(np.int64) & BY_WORD, 0.9, 0.02)
    q = np.concatenate([start, np.full(len(good.n), 0.05), np.full(len(bad.n), 0.95)])
    a, b = len(all_docs.n), len(all_docs.n) + len(good.n)
    n = np.concatenate([all_docs.n, good.n, bad.n]).astype(float)
    for turn in range(rounds):
        weights = []
        for c in (0, 1):
            w = n * (q if c else 1 - q)
            known, free = w[a:].sum(), w[:a].sum()
            if known > 0:
                w[a:] *= free / known
                said = np.array([w[a:b].sum(), w[b:].sum()]) * known / free + 20 * np.array([[0.95, 0.05], [0.05, 0.95]])[c]
                model.says[c] = said / said.sum()
            weights.append(w)
        model.prior = float(np.clip((all_docs.n * q[:a]).sum() / max(all_docs.n.sum(), 1), 1e-4, 0.5))
        if turn % 10 == 0:
            model.tree(bits, weights)
        model.learn(bits, weights, pseudo)
        q = np.concatenate([model.posterior(all_docs.bits), model.posterior(good.bits, 0), model.posterior(bad.bits, 1)])
    return model


def fit_scorer(rows: np.ndarray, features: np.ndarray, n_rows: int, width: int, target: np.ndarray, prior: float, rounds: int = 200, rate: float = 0.5, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, both classes weighing the same, by full-batch AdaGrad; the bias is set for `prior`."""
    weights, bias = np.zeros(width), 0.0
    if not n_rows:
        return weights, float(np.log(prior / (1 - prior)))
    share = float(np.clip(target.mean(), 0.02, 0.98))
    gain = 0.5 * (target / share + (1 - target) / (1 - share)) / n_rows
    squares, bias_square = np.full(width, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(rows, weights[features], n_rows) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * gain
        gradient = np.bincount(features, error[rows], width) + decay * weights
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
        bias_square += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(bias_square)
    return weights, float(bias + np.log(prior / (1 - prior)))


def with_votes(pattern: np.ndarray, rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The voters' bits as features before those of entries."""
    r, v = np.nonzero(as_bits(pattern))
    return np.concatenate([r, rows]), np.concatenate([v, features])


def tally(patterns: np.ndarray, counts: np.ndarray) -> Votes:
    order = np.argsort(patterns)
    return Votes(as_bits(patterns[order]), counts[order].astype(float))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = 10_000, threshold: float = 0.3, label: str = "toxic", least: float = 24.0, ratio: float = 8.0) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= threshold), weak_label and votes.

    `sample` bounds, for each class, the labelled documents that find lexicon entries and fit the scorer; votes and the label
    model cover all documents. A null text is empty; a text without words gets the score of a document without entries.
    A null doc_id stays null, is not held out and has no label; repeated rows are scored each and count each for the label
    model; labels of unknown documents and null labels are ignored; without labels of both classes only the given lists
    vote, and the scorer is fitted on documents without labels too. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    some = fitting_sample(rows, fitting_labels(labels, folds, held, label), sample)
    entries = lexicon(telling(some, least, ratio))
    shared = context.broadcast(entries.bits)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Entries(shared.value), Counter()
        for batch in batches:
            for _, texts in text_slices(batch):
                counts.update(seen(texts, own)[0].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Entries(shared.value)
        for batch in batches:
            for part, texts in text_slices(batch):
                pattern, at, feature = seen(texts, own)
                ends = np.searchsorted(at, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(pattern), lists], names=["doc_id", "y", "pattern", "features"])

    found = rows.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** voters rows
    known = some.mapInArrow(look, "doc_id long, y boolean, pattern long, features array<long>").orderBy("doc_id", "pattern").toArrow()  # at most 3 * sample rows
    y, own_patterns = np.array(known.column("y").to_pylist(), object), known.column("pattern").to_numpy()
    sides = tuple(tally(*np.unique(own_patterns[y == c], return_counts=True)) for c in (False, True))
    model = fit_labels(tally(found.column("pattern").to_numpy(), found.column("n").to_numpy()), sides)
    target = np.zeros(len(y))
    for c in (None, False, True):
        target[y == c] = model.posterior(as_bits(own_patterns[y == c]), None if c is None else int(c))
    lists = known.column("features").to_pylist()
    at = np.repeat(np.arange(len(lists)), list(map(len, lists))).astype(np.int64)
    r, f = with_votes(own_patterns, at, np.fromiter((x for own in lists for x in own), np.int64))
    fitted = fit_scorer(r, f, len(lists), len(VOTERS) + len(entries.bits), target, model.prior)
    sent = context.broadcast((model, *fitted))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (judge, weights, bias) = Entries(shared.value), sent.value
        for batch in batches:
            for part, texts in text_slices(batch):
                pattern, at, feature = seen(texts, own)
                r, f = with_votes(pattern, at, feature)
                z = np.bincount(r, weights[f], len(texts)) + bias
                marks = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks), pa.array(judge.posterior(as_bits(pattern))), pa.array(pattern)], names=["doc_id", "score", "weak_label", "votes"])

    scored = rows.mapInArrow(score, "doc_id long, score double, weak_label double, votes long")
    return scored.select("doc_id", (fold_of(folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weak_label", "votes")

