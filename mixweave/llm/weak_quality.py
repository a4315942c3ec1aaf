"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Votes are counted by
pattern over the whole corpus (at most 3^labellers patterns), and expectation-maximisation estimates
from the counts how often each labeller votes what on good and bad documents. The posteriors label a
bounded sample of documents, on which a hashed linear scorer is trained in one task; it then scores
every document.

Defined results: a null text or one without words gets score 0 and is not kept; documents with equal
text get equal scores; null ids are scored like others; an empty table gives an empty table, and a
corpus without a bad pattern keeps all documents that have words. Other columns are kept; `votes`,
`score` and `keep` replace columns of those names.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stage, unstage

#: Distinct texts that the scorer is fitted on: about so many at most, chosen by a hash. Counts cover all.
FIT_DOCS = 4000
MIN_SCORE = 0.5
GRAMS, WORDS, BUCKETS = 4096, 4096, 64
DIMS = GRAMS + WORDS + BUCKETS
EM_ROUNDS = 500
#: How often a labeller accuses a good document and a bad one before any is seen, and how many documents that counts as.
FALSE_ALARMS, HIT_RATE, PRIOR_DOCS = 0.01, 0.3, 10.0
FIT_ROUNDS = 200

#: Classes of UTF-8 bytes.
_CLASSES = np.full(256, 15, np.uint16)
for _k, _chars in enumerate((b" \t\x0b\x0c", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b";:'\"()-?", b"!", b"#", b"$%&*", b"|", b"+=@^~<>_\\/{}[]`", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)))):
    _CLASSES[list(_chars)] = _k
_LETTERS, _SYMBOLS = [2, 3, 13], [8, 9, 10, 11, 12]


class Signals:
    """What the labellers and the scorer see of one text."""

    def __init__(self, text: str):
        raw = text.encode()
        classes = _CLASSES[np.frombuffer(raw, np.uint8)]
        self.by_class = np.bincount(classes, minlength=16)
        self.classes = classes
        self.words = raw.split()
        n = self.n = len(self.words)
        self.repeats = sum(map(operator.eq, self.words, self.words[1:])) / max(n - 1, 1)
        self.distinct = len(set(self.words)) / max(n, 1)
        c = self.by_class
        letters, shown = int(c[_LETTERS].sum()), int(c[2:14].sum())
        self.letters = letters / max(shown, 1)
        self.upper = c[3] / max(c[2] + c[3], 1)
        self.symbols = int(c[_SYMBOLS].sum()) / max(n, 1)
        self.odd_ends = sum(w[-1:] in b"!#$%&*+=@^~|<>_/\\" for w in self.words) / max(n, 1)
        self.length = letters / max(n, 1)


def _vote(bad: bool, good: bool) -> str:
    return "-" if bad else "+" if good else "0"


#: Heuristic labellers; each sees one side of a document and abstains in between.
LABELLERS = (
    lambda s: _vote(s.letters < 0.4, s.letters > 0.6),
    lambda s: _vote(s.symbols > 0.8, s.symbols < 0.3),
    lambda s: _vote(s.odd_ends > 0.3, s.odd_ends < 0.05),
    lambda s: _vote(s.n >= 5 and s.upper > 0.5, s.upper < 0.2),
    lambda s: _vote(s.n >= 10 and s.repeats > 0.3, s.n >= 10 and s.repeats < 0.1),
    lambda s: _vote(s.n >= 20 and s.distinct * math.sqrt(s.n) < 1.0, s.n >= 20 and s.distinct * math.sqrt(s.n) > 3.0),
    lambda s: _vote(s.length < 1.8 or s.length > 18, 2.5 < s.length < 10),
)


def votes_of(s: Signals) -> str:
    return "".join(f(s) for f in LABELLERS) if s.n else "0" * len(LABELLERS)


def features(s: Signals) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features as (indices, values): class trigrams, words, and bucketed ratios."""
    c = s.classes
    grams = np.bincount((c[:-2] * 256 + c[1:-1] * 16 + c[2:]).astype(np.int64), minlength=GRAMS) if len(c) > 2 else np.zeros(GRAMS)
    words = np.bincount(np.fromiter(map(crc32, s.words), np.int64, s.n) % WORDS, minlength=WORDS)
    ratios = np.zeros(BUCKETS)
    for i, x in enumerate((s.repeats, s.distinct, s.letters, s.upper, min(s.symbols, 1.0), s.odd_ends)):
        ratios[i * 10 + min(int(x * 10), 9)] = 1.0
    x = np.concatenate([np.sqrt(grams / max(grams.sum(), 1)), 0.5 * np.sqrt(words / max(s.n, 1)), 0.5 * ratios])
    at = np.flatnonzero(x)
    return at.astype(np.int32), x[at].astype(np.float32)


def vote_docs(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """A row (votes, text_hash, at, values) per document; features only where the text's hash picks it.

    Equal texts are picked together, and each text is fitted on once, so that about fit_docs rows at
    most are, however often rows repeat.
    """
    total = max(docs.count(), 1)
    cutoff = int(min(1.0, fit_docs / total) * (1 << 30))
    hashed = docs.select("text", F.xxhash64("text").alias("text_hash"))
    schema = "votes string, text_hash long, at array<int>, vals array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            votes, at, values = [], [], []
            for text, pick in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = Signals(text or "")
                i, x = features(s) if pick and s.n else (None, None)
                votes.append(votes_of(s))
                at.append(i)
                values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.string()), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["votes", "text_hash", "at", "vals"])

    return hashed.withColumn("pick", F.pmod("text_hash", F.lit(1 << 30)) < cutoff).mapInArrow(run, schema)


def _em(accuses: np.ndarray, clears: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rates [labeller, class], class weights, shares [pattern, class] and likelihood; the good class is last.

    Beta priors of a few documents' weight keep rates off 0 and 1. EM stops when it no longer moves.
    """
    k = share.shape[1]
    hits = np.array([HIT_RATE] * (k - 1) + [FALSE_ALARMS])
    rate, weight, before = np.empty((0, k)), np.empty(k), -np.inf
    for _ in range(rounds):
        w = n[:, None] * share
        bad_votes, all_votes = accuses.T @ w, (accuses + clears).T @ w
        rate = (bad_votes + PRIOR_DOCS * hits) / (all_votes + PRIOR_DOCS)
        weight = (w.sum(0) + 1) / (n.sum() + k)
        score = accuses @ np.log(rate) + clears @ np.log(1 - rate) + np.log(weight)
        top = score.max(1, keepdims=True)
        total = np.exp(score - top).sum(1, keepdims=True)
        share = np.exp(score - top) / total
        likelihood = float(n @ (top + np.log(total))[:, 0])
        if likelihood - before < 1e-7 * n.sum():
            break
        before = likelihood
    return rate, weight, share, likelihood


def fit_votes(counts: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float, dict[str, float]]:
    """EM over vote patterns: how often each labeller accuses, as [labeller, class] with bad first,
    the share of good documents, and each pattern's posterior of good.

    Labellers err independently on good documents and on each kind of bad ones. A kind is added, from
    the accused pattern that the model explains worst, as long as that lowers the Bayesian information
    criterion and its documents are accused by some labeller more often than not. Where one kind
    explains the votes, this is the plain model of two classes. An abstention says nothing, so that a
    document too short for a labeller isn't held against it.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    accuses, clears = (np.array([[x == k for x in p] for p in patterns], float) for k in "-+")
    accused = accuses.any(1)
    share = np.stack([np.where(accused, 0.9, 0.1), np.where(accused, 0.1, 0.9)], 1)
    rate, weight, share, likelihood = _em(accuses, clears, n, share, rounds)
    price = (accuses.shape[1] + 1) * math.log(max(n.sum(), 2.0)) / 2
    for _ in range(accuses.shape[1] - 1):
        score = np.exp(accuses @ np.log(rate) + clears @ np.log(1 - rate) + np.log(weight)).sum(1)
        seen = accuses + clears
        alike = seen @ seen.T == seen.sum(1)[:, None]  # patterns that hold all votes that this one's labellers cast
        of = np.array([n[a].sum() for a in alike])
        excess = np.where(accused, n * np.log(np.maximum(n / np.maximum(of * score, 1e-300), 1e-300)), -np.inf)
        best = None
        for worst in np.argsort(-excess, kind="stable")[:3]:
            if excess[worst] <= 0:
                break
            new = 0.9 * ((accuses @ accuses[worst] > 0) & (clears @ accuses[worst] == 0))
            tried = np.concatenate([new[:, None], share * (1 - new[:, None])], 1)
            found = _em(accuses, clears, n, tried, rounds)
            if (found[0][:, :-1].max(0) >= 0.5).all() and (best is None or found[3] > best[3]):
                best = found
        if best is None or best[3] - likelihood <= price:
            break
        rate, weight, share, likelihood = best
    bad = rate[:, :-1] @ weight[:-1] / weight[:-1].sum()
    return np.stack([bad, rate[:, -1]], 1), float(weight[-1]), dict(zip(patterns, share[:, -1].tolist(), strict=True))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, l2: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, of a logistic scorer on soft labels, by accelerated gradient steps."""
    x = np.zeros((len(rows), DIMS + 1), np.float32)
    for r, (at, values) in enumerate(rows):
        x[r, at] = values
    x[:, -1] = 1.0
    w = look = np.zeros(DIMS + 1, np.float32)
    step = 4.0 / max(float(np.einsum("ij,ij->i", x, x).max()), 1.0)
    for k in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        new = look - step * (x.T @ (p - wanted) / len(rows) + l2 * look)
        look = new + k / (k + 3) * (new - w)
        w = new.astype(np.float32)
    return w


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[np.ndarray | None, dict[str, float]]:
    """The scorer's weights (None without documents to fit on) and the posterior of each pattern."""
    voted = stage(vote_docs(docs, fit_docs), "quality-votes")
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None, {}
    posterior = fit_votes(counts)[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, wanted = [], []
        for batch in batches:
            at, values = batch.column(1), batch.column(2)
            rows += [(at[i].values.to_numpy(), values[i].values.to_numpy()) for i in range(batch.num_rows)]
            wanted += [posterior[p] for p in batch.column(0).to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([fit_scorer(rows, np.array(wanted, np.float32)).tobytes()], pa.binary())], names=["weights"])

    sample = voted.where("at is not null").dropDuplicates(["text_hash"]).select("votes", "at", "vals")
    found = sample.repartition(1).mapInArrow(run, "weights binary").collect()
    unstage(voted)
    return (np.frombuffer(bytes(found[0]["weights"]), np.float32) if found else None), posterior


def classify(docs: DataFrame, min_score: float = MIN_SCORE, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Add votes, score (probability of good) and keep to docs (doc_id, text, ...)."""
    weights, posterior = fit(docs, fit_docs)
    kept = [c for c in docs.columns if c not in ("votes", "score", "keep")]
    docs = docs.select(*kept)
    at = kept.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("votes", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            votes, scores = [], []
            for text in batch.column(at).to_pylist():
                s = Signals(text or "")
                votes.append(votes_of(s))
                if not s.n:
                    scores.append(0.0)
                elif weights is None:
                    scores.append(posterior.get(votes[-1], 1.0))
                else:
                    i, x = features(s)
                    z = float(weights[i].astype(float) @ x.astype(float)) + float(weights[-1])
                    scores.append(1 / (1 + math.exp(-max(min(z, 50.0), -50.0))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes, pa.string()), pa.array(scores, pa.float64()), pa.array([x >= min_score for x in scores], pa.bool_())], names=[*kept, "votes", "score", "keep"])

    return docs.mapInArrow(run, schema)


def quality_query(docs: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text")).select("doc_id", "votes", F.round("score", 6).alias("score"), "keep")
