"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Their votes are counted by pattern,
at most 3 ** labellers of them whatever the corpus, so expectation-maximisation over the patterns
is exact over all documents and runs on the driver. It estimates, for each labeller, how often
it votes each way, or not at all, on good and on bad documents, and gives each pattern its posterior.
A linear scorer over hashed words and word shapes learns those posteriors on a bounded sample of
documents (the `sample` smallest hashes, `sample_bytes` of text at most) and scores every document.
No shuffle but the counts and the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, BLANKS, sums_by_row, text_slices, word_codes

ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("length", "symbols", "capitals", "symbol_words", "variety", "repeated_lines", "line_ends", "letters")
SYMBOLS = b"#*$%&|<>{}[]=_~^\\"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
NO_LETTER = bytes(c for c in range(0x80) if not chr(c).isalpha())
BUCKETS = 1 << 17
#: Folds letters, digits and symbols into one sign each, for word shapes.
SHAPE = bytes(ord("A") if 65 <= c < 91 else ord("a") if 97 <= c < 123 or c >= 0x80 else ord("0") if 48 <= c < 58 else c for c in range(256))


def vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(text: bytes) -> list[int]:
    """Each labeller's vote. Most only know what is bad. No two look at the length alone: labellers that
    abstain together on short documents would make those a class."""
    words = text.split()
    n = len(words)
    if not n:
        return [BAD] + [ABSTAIN] * (len(LABELLERS) - 1)
    solid = text.translate(None, BLANKS)
    letters = len(solid) - len(solid.translate(None, LETTERS))
    capitals = len(solid) - len(solid.translate(None, UPPER))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in (line.strip(BLANKS) for line in text.split(b"\n")) if x]
    signed = sum(len(w.translate(None, SYMBOLS)) < len(w) for w in words)
    variety = len(set(words)) / n
    again = 1 - len(set(lines)) / len(lines)
    ended = sum(x[-1:] in b".!?\"')" for x in lines) / len(lines)
    bare = sum(not w.translate(None, NO_LETTER) for w in words) / n
    return [
        vote(n < 5, False),
        vote(symbols > 0.2 * n, False),
        vote(letters > 20 and capitals > 0.4 * letters, False),
        vote(signed > 0.1 * n, False),
        vote(n >= 50 and variety < 0.25, variety > 0.4),
        vote(again > 0.4, False),
        vote(ended < 0.2, ended > 0.6),
        vote(bare > 0.25, False),
    ]


def voted(rows: DataFrame) -> DataFrame:
    """(doc_id, pattern): the votes as one number in base 3."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for part, texts in text_slices(batch):
                pattern = np.array([votes(t) for t in texts], np.int64) @ weight
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pattern)], names=["doc_id", "pattern"])

    return rows.select("doc_id", "text").mapInArrow(work, "doc_id long, pattern long")


@dataclass
class LabelModel:
    """prior: share of good documents; table[labeller, class, vote]; posterior by pattern."""

    prior: float
    table: np.ndarray
    posterior: np.ndarray


def unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


#: Votes (none, bad, good) on bad and on good documents that stand for no data: PSEUDO documents of each
#: class, however many there are. They keep estimates off 0.
EXPECTED = np.array([[0.5, 0.25, 0.25], [0.5, 0.01, 0.49]])
PSEUDO = 10.0


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation from a start where one bad vote makes a document likely bad; votes are
    taken as independent given the class. Good is the class with fewer bad votes."""
    ballot = unpack(patterns)
    q = np.where((ballot == BAD).any(axis=1), 0.1, 0.98)
    table = np.tile(EXPECTED, (len(LABELLERS), 1, 1))
    prior = 0.85
    for _ in range(rounds if len(patterns) else 0):
        for c, weight in enumerate((counts * (1 - q), counts * q)):
            for v in range(3):
                table[:, c, v] = ((ballot == v) * weight[:, None]).sum(axis=0) + PSEUDO * EXPECTED[c, v]
            table[:, c] /= table[:, c].sum(axis=1, keepdims=True)
        prior = float(np.clip((counts * q).sum() / counts.sum(), 0.01, 0.99))
        q = posterior_of(ballot, prior, table)
    if table[:, 1, BAD].sum() > table[:, 0, BAD].sum():
        prior, table = 1 - prior, table[:, ::-1]
    every = np.arange(3 ** len(LABELLERS))
    return LabelModel(prior, table, posterior_of(unpack(every), prior, table))


def posterior_of(ballot: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """The probability of good; that a labeller gives no vote is evidence too."""
    ratio = np.log(table[:, 1] / table[:, 0])
    odds = ratio[np.arange(len(LABELLERS)), ballot].sum(axis=1) + np.log(prior / (1 - prior))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Two features of each word: its lower-cased form and its shape (runs of like signs as one)."""
    out = np.empty((len(words), 2), np.int64)
    for i, w in enumerate(words):
        shape = w.translate(SHAPE)
        short = bytes(c for k, c in enumerate(shape[:24]) if not k or c != shape[k - 1])
        out[i] = xxhash.xxh3_64_intdigest(w.translate(ASCII_LOWER)) % BUCKETS, xxhash.xxh3_64_intdigest(short, 1) % BUCKETS
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, counts per row, scale per row): a document is the mean of its words' features."""
    codes, sizes, words = word_codes([t.split() for t in texts])
    buckets = word_buckets(words)[codes].reshape(-1)
    return buckets, 2 * sizes, 1 / np.maximum(1, sizes)


def fit_scorer(texts: list[bytes], target: np.ndarray, rounds: int = 60, rate: float = 2.0, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, by full-batch AdaGrad; classes weigh the same."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not texts:
        return weights, bias
    buckets, sizes, scale = features(texts)
    buckets = buckets.astype(np.int32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    value = np.repeat(scale, sizes)
    share = float(np.clip(target.mean(), 0.02, 0.98))
    gain = target / share + (1 - target) / (1 - share)
    squares, bias_square = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, weights[buckets] * value, len(texts)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * gain / len(texts)
        gradient = np.bincount(buckets, error[row] * value, BUCKETS) + decay * weights
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
        bias_square += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(bias_square)
    return weights, bias


def sampled_texts(rows: DataFrame, total: int, sample: int, sample_bytes: int) -> list[bytes]:
    """Texts of the distinct rows with the `sample` smallest hashes; a text that what is left of
    `sample_bytes` can't hold is passed over. Sizes come to the driver first, then those texts."""
    part = min(1.0, 1.2 * sample / max(1, total))  # of the hashes; a few more rows than the sample meet in the sort
    hashed = rows.withColumns({"h": F.xxhash64("doc_id", "text"), "n": F.octet_length("text")})
    some = hashed.where((F.col("n") > 0) & (F.col("h") <= int(part * (1 << 63)) * 2 - (1 << 63) - (part == 1.0)))
    kept, left = [], sample_bytes
    for h, n in some.groupBy("h").agg(F.max("n").alias("n")).orderBy("h").limit(sample).collect():
        if n <= left:
            kept.append(h)
            left -= n
    texts = some.where(F.col("h").isin(kept)).groupBy("h").agg(F.max("text").alias("text")).orderBy("h")
    return [t.encode() for t in texts.toArrow().column("text").to_pylist()]


def quality_scores(docs: DataFrame, sample: int = 4000, threshold: float = 0.5, sample_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, weak_label (posterior that it is good), score, kept, and the votes.

    The scorer's score decides, `kept` is score >= threshold. A text without words scores 0 and is not
    kept. A null doc_id stays null; repeated rows are scored each, count each for the label model and are
    in the sample once; other columns are not read; an empty table gives no rows. `sample` and
    `sample_bytes` bound what fits the scorer; the label model sees every document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = voted(rows).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 3 ** labellers rows
    model = fit_labels(found.column("pattern").to_numpy(), found.column("n").to_numpy())
    texts = sampled_texts(rows, sum(found.column("n").to_pylist()), sample, sample_bytes)
    ballots = np.array([votes(t) for t in texts], np.int64).reshape(len(texts), len(LABELLERS))
    fitted = fit_scorer(texts, model.posterior[ballots @ 3 ** np.arange(len(LABELLERS))])
    shared = docs.sparkSession.sparkContext.broadcast((model.posterior, *fitted))
    schema = pa.schema([("doc_id", pa.int64()), ("weak_label", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_()), ("votes", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, weights, bias = shared.value
        weight = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for part, texts in text_slices(batch):
                ballot = np.array([votes(t) for t in texts], np.int64)
                buckets, sizes, scale = features(texts)
                z = sums_by_row(weights[buckets], sizes) * scale + bias
                score = np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
                shown = ["".join("-x+"[v] for v in b) for b in ballot.tolist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(posterior[ballot @ weight]), pa.array(score), pa.array(score >= threshold), pa.array(shown)], schema=schema)

    return rows.mapInArrow(work, "doc_id long, weak_label double, score double, kept boolean, votes string")
