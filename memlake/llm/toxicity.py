"""Abusive, hateful or sexual content by weak supervision.

1. Every text is cut into segments of plain words (``plaintext``) and dozens of voters
   vote on each (``voters``); words and votes are written once to the shared folder.
2. A generative label model over the counts of all vote patterns of the whole corpus
   estimates how often each voter speaks on either class and which voters repeat each
   other.  Where hand labels of documents are given, the reviewers are one more voter,
   on the document: its segments share the label, and how often reviewers err is
   estimated with the rest.
3. A linear classifier over words, word pairs and some of the voters learns the
   posteriors of a bounded sample of segments.
4. A document's score is that of its worst segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.plaintext import Words, segments
from memlake.llm.voters import AGAINST, SHOWN, VOTERS, votes
from memlake.operators.spread import spread
from memlake.scratch import materialize

#: Segments of unlabelled documents and labelled documents that the classifier learns from, at most about so many.
SAMPLE_SEGMENTS, LABELLED_AT_MOST = 20_000, 10_000
#: What all segments without label together weigh, a segment of a labelled document weighing 1.
UNLABELLED_WEIGHT = 150.0
#: What all vote patterns without their words together weigh.
WORDLESS_WEIGHT = 500.0
#: Words and pairs that stand in fewer documents of the sample are not learnt.
MIN_DOCUMENTS = 3
#: Labels of one document in so many (by hash of its id) are never learnt from, so that accuracy can be measured.
HELD_OUT_ONE_IN = 5
#: Hashed features of the classifier; the last ones are the voters'.
FEATURES = 1 << 18
_PAIR = np.uint32(0x9E3779B1)


def vote_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, segments, votes) of every row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                s = segments(part.column("text"), words)
                ends = np.searchsorted(s.row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (s.text, pa.array(votes(s), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), *lists], ["doc_id", "source", "segments", "votes"]
                )

    form = "doc_id bigint, source string, segments array<string>, votes array<bigint>"
    return materialize(spread(documents.select("doc_id", "source", "text")).mapInArrow(run, form), "votes")


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Bags:
    """Segments of labelled documents: which document each belongs to, and what its reviewers said (share of 1s)."""

    def __init__(self, bag: np.ndarray, said: np.ndarray):
        self.bag, self.said = bag, said
        self.sure, self.wrong = 0.95, 0.03  # P(label 1 | abusive), P(label 1 | not)

    def posterior(self, p: np.ndarray) -> np.ndarray:
        """What each segment's own probability becomes once the document's label is heard."""
        if not len(p):
            return p
        p = np.minimum(p, 0.95)  # neither votes nor words are surer than this before the label is heard
        calm = np.exp(np.bincount(self.bag, np.log1p(-p), len(self.said)))
        if len(self.said) >= 50:
            some = 1 - calm
            self.sure = float((some @ self.said + 9.5) / (some.sum() + 10))
            self.wrong = float((calm @ self.said + 0.6) / (calm.sum() + 20))
        yes = np.where(self.said > 0.5, self.sure, np.where(self.said < 0.5, 1 - self.sure, 0.5))
        no = np.where(self.said > 0.5, self.wrong, np.where(self.said < 0.5, 1 - self.wrong, 0.5))
        return p * (yes / (yes * (1 - calm) + no * calm))[self.bag]


class LabelModel:
    """Generative model of the votes: class prior, each voter's rate by class, correlations between voters.

    Fitted by expectation maximisation on pattern counts and, where there are labelled
    documents, on their segments.  Voters that agree more than the class explains share
    their weight, so that two lists of the same words don't count twice.
    """

    def __init__(self, patterns: dict[int, int], labelled: np.ndarray | None = None, bags: Bags | None = None, rounds: int = 25, emphasis: float = 5.0):
        self.patterns = np.array(sorted(patterns), np.int64)
        n = np.array([patterns[p] for p in self.patterns.tolist()], float)
        m = len(VOTERS)
        fired = self._fired(self.patterns)
        plus, minus = fired[:, : m - len(AGAINST)].sum(1), fired[:, m - len(AGAINST) :].sum(1)
        post = np.where(plus >= 3, 0.8, np.where(plus == 2, 0.5, np.where(plus == 1, 0.15, 0.001))) * np.where(minus > 0, 0.5, 1.0)
        self.share, self.prior = np.ones(m), 0.01
        self.given = np.full((2, m), 0.5)
        at = np.searchsorted(self.patterns, labelled) if labelled is not None and len(labelled) else np.zeros(0, int)
        for _ in range(rounds if n.sum() else 0):
            weight = np.stack([n * (1 - post), n * post])
            self.prior = float((weight[1].sum() + 1) / (n.sum() + 100))
            if len(at):  # what the labels say about segments with these votes
                own = bags.posterior(post[at])
                weight[1] += emphasis * np.bincount(at, own, len(n))
                weight[0] += emphasis * np.bincount(at, 1 - own, len(n))
            total = weight.sum(1)
            lean = np.full((2, m), 0.05)  # a voter is held better than chance: pseudo counts for its own side
            lean[1, : m - len(AGAINST)] = lean[0, m - len(AGAINST) :] = 0.3
            self.given = (weight @ fired + lean) / (total[:, None] + lean + 4.0)
            excess = np.zeros((m, m))
            for c in (0, 1):
                w = weight[c] / max(total[c], 1e-9)
                centred = fired - w @ fired
                cov = (centred * w[:, None]).T @ centred
                spread_ = np.sqrt(np.maximum(np.diag(cov), 0.0))
                excess += 0.5 * np.abs(cov) / (np.outer(spread_, spread_) + 1e-9)
            np.fill_diagonal(excess, 0)
            self.correlation = excess
            self.share = 1 / (1 + np.clip(excess, 0, 1).sum(1) / 2)
            post = self._posterior(fired)
        self.post = post

    @staticmethod
    def _fired(patterns: np.ndarray) -> np.ndarray:
        return ((patterns[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)

    def _posterior(self, fired: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.given[1] / self.given[0]), np.log((1 - self.given[1]) / (1 - self.given[0]))
        return _sigmoid(_logit(self.prior) + fired @ (self.share * yes) + (1 - fired) @ (self.share * no))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that a segment with these votes is abusive."""
        return self._posterior(self._fired(np.asarray(patterns, np.int64)))


def features(hashes: np.ndarray, start: np.ndarray, vote: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, feature): words, pairs of words that follow each other, and the voters shown."""
    of = np.repeat(np.arange(len(start) - 1), np.diff(start))
    room = np.uint32(FEATURES - len(VOTERS))
    pair = np.flatnonzero(of[1:] == of[:-1])
    two = (hashes[pair] * _PAIR) ^ hashes[pair + 1]
    fired = [np.flatnonzero(vote >> i & 1) for i in SHOWN]
    return (
        np.concatenate([of, of[pair], *fired]),
        np.concatenate([hashes % room, two % room, *(np.full(len(f), FEATURES - len(VOTERS) + i) for f, i in zip(fired, SHOWN))]).astype(np.int64),
    )


def _coded(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of segments, and where each segment starts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    tokens = pc.split_pattern(texts, " ")
    coded = tokens.flatten().dictionary_encode()
    dictionary = coded.dictionary.to_pylist()
    o = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
    at = coded.indices.to_numpy()
    ids = words.ids(dictionary)  # before the arrays, which grow with it
    hashes = words.hash[ids[at]] if len(coded) else np.zeros(0, np.uint32)
    if "" in dictionary:
        some = at != dictionary.index("")
        return hashes[some], np.r_[0, np.cumsum(some)][o]
    return hashes, o


class Classifier:
    """Logistic regression over hashed words, word pairs and votes; ``bias`` is added to each segment."""

    def __init__(self, w: np.ndarray | None = None, bias: float = 0.0):
        self.w = np.zeros(FEATURES, np.float32) if w is None else w
        self.bias = bias

    def odds(self, at: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at, self.w[idx], n) + self.bias


class Trainer:
    """Adaptive gradient descent on soft labels; equal segments are one row with the sum of their weights.

    A segment without words stands for words that aren't known: it has its votes only.
    """

    def __init__(self, texts: list[str], vote: np.ndarray, document: np.ndarray, weight: np.ndarray):
        keys = np.array([t or f"\x00{v}" for t, v in zip(texts, vote.tolist())], object)
        _, first, self.row = np.unique(keys, return_index=True, return_inverse=True)
        self.row = self.row.reshape(-1)
        self.weight = weight / weight.sum()
        self.total = np.bincount(self.row, self.weight)
        at, idx = features(*_coded(pa.array([texts[i] for i in first], pa.string()), Words()), vote[first])
        # a word or pair of too few documents would only remember them
        seen = np.unique(np.stack([self.row, document]), axis=1)
        row_documents = np.bincount(seen[0])
        pairs = np.unique(at * FEATURES + idx)
        often = np.bincount(pairs % FEATURES, row_documents[pairs // FEATURES], FEATURES) >= MIN_DOCUMENTS
        keep = often[idx] | (idx >= FEATURES - len(VOTERS))
        self.at = at[keep]
        self.used, self.place = np.unique(idx[keep], return_inverse=True)
        self.place = self.place.reshape(-1)
        self.w, self.seen = np.zeros(len(self.used)), np.full(len(self.used), 1e-10)
        self.bias, self.seen_bias = 0.0, 1e-10

    def _odds(self) -> np.ndarray:
        return np.bincount(self.at, self.w[self.place], len(self.total)) + self.bias

    def odds(self) -> np.ndarray:
        """The odds of every segment, in the order given."""
        return self._odds()[self.row]

    def steps(self, y: np.ndarray, n: int, rate: float = 0.3, decay: float = 1e-5) -> None:
        goal = np.bincount(self.row, self.weight * y)
        self.seen[:], self.seen_bias = 1e-10, 1e-10
        for _ in range(n):
            gap = _sigmoid(self._odds()) * self.total - goal
            grad = np.bincount(self.place, gap[self.at], len(self.used)) + decay * self.w
            self.seen += grad * grad
            self.w -= rate * grad / np.sqrt(self.seen)
            self.seen_bias += gap.sum() ** 2
            self.bias -= rate * gap.sum() / np.sqrt(self.seen_bias)

    def classifier(self) -> Classifier:
        w = np.zeros(FEATURES, np.float32)
        w[self.used] = self.w
        return Classifier(w, float(self.bias))


def held_out(doc_id=None):
    """The condition under which a document's label is kept for measuring."""
    return F.pmod(F.xxhash64(F.lit(11), F.col("doc_id") if doc_id is None else doc_id), F.lit(HELD_OUT_ONE_IN)) == 0


def said_of(labels: DataFrame) -> DataFrame:
    """(doc_id, said): the share of each document's labels that call it abusive."""
    return labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("said"))


def fit(voted: DataFrame, labels: DataFrame | None = None) -> tuple[LabelModel, Classifier]:
    """The label model of all votes and the classifier trained on its posteriors.

    The driver gets the distinct vote patterns with their counts, about
    ``SAMPLE_SEGMENTS`` segments (each pattern by the square root of its count, those
    of least hash) and the segments of at most about ``LABELLED_AT_MOST`` labelled
    documents (by hash; held-out ones never), however large the corpus.
    """
    each = voted.select(F.explode(F.arrays_zip("votes", "segments")).alias("s")).select(F.col("s.votes").alias("pattern"), F.col("s.segments").alias("segment"))
    n = {r["pattern"]: r["n"] for r in each.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    root = {p: c**0.5 for p, c in n.items()}
    total = sum(root.values())
    ids, said, found = [], [], []
    if labels is not None:
        said_ = said_of(labels.where(~held_out()))
        size = said_.count()
        if size > LABELLED_AT_MOST:
            said_ = said_.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1_000_000)) < int(LABELLED_AT_MOST / size * 1_000_000))
        for r in voted.join(said_, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("said", "segments", "votes").toLocalIterator():
            ids += [len(said)] * len(r["votes"])
            said.append(r["said"])
            found.append((r["segments"], r["votes"]))
    bags = Bags(np.array(ids, int), np.array(said, float))
    labelled = np.array([v for _, vs in found for v in vs], np.int64)
    model = LabelModel(n, labelled, bags)
    texts, patterns = [s for ss, _ in found for s in ss], labelled.tolist()
    if n:
        grain = 1 << 40
        quota = voted.sparkSession.createDataFrame(
            [(p, int(min(1.0, SAMPLE_SEGMENTS * root[p] / total / n[p]) * grain)) for p in n], "pattern bigint, least bigint"
        )
        rows = each.join(quota, "pattern").where(F.pmod(F.xxhash64("segment"), F.lit(grain)) < F.col("least"))
        for r in rows.select("pattern", "segment").distinct().orderBy("pattern", "segment").toLocalIterator():
            texts.append(r["segment"])
            patterns.append(r["pattern"])
    if not texts:
        return model, Classifier()
    return model, learn(model, bags, texts, np.array(patterns, np.int64), len(labelled), n)


def learn(model: LabelModel, bags: Bags, texts: list[str], vote: np.ndarray, k: int, n: dict[int, int]) -> Classifier:
    """The classifier of segments, of which the first ``k`` are those of the labelled documents.

    Each vote pattern is learnt without words too, so that the voters are heard where
    no word is known.
    """
    bare = np.array(sorted(n), np.int64)
    root = np.sqrt([n[p] for p in bare.tolist()])
    m = len(vote)
    weight = np.r_[np.ones(k), np.full(m - k, UNLABELLED_WEIGHT / max(1, m - k)), WORDLESS_WEIGHT * root / root.sum()]
    texts, vote = texts + [""] * len(bare), np.r_[vote, bare]
    trainer = Trainer(texts, vote, np.r_[bags.bag, len(bags.said) + np.arange(len(vote) - k)], weight)
    own = model.posterior(vote)
    y = own.copy()
    y[:k] = bags.posterior(own[:k])
    trainer.steps(y, 80)
    for _ in range(10 if k else 0):  # what a label says of a document settles on the segments that the words give away
        y[:k] = bags.posterior(_sigmoid(trainer.odds()[:k]))
        trainer.steps(y, 30)
    return trainer.classifier()


def score_voted(voted: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, source, score, worst) of documents that have been voted on."""
    weights, bias = classifier.w.tobytes(), classifier.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, words = _classifier(weights, bias), Words()
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                lists = part.column("segments")
                texts, vote = lists.flatten(), part.column("votes").flatten().to_numpy()
                row = pc.list_parent_indices(lists).to_numpy()
                hashes, start = _coded(texts, words)
                odds = c.odds(*features(hashes, start, vote), len(vote))
                order = np.lexsort((np.arange(len(row)), -odds, row))
                first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(row) else order
                score, worst = np.zeros(part.num_rows), np.full(part.num_rows, -1, np.int64)
                score[row[first]], worst[row[first]] = _sigmoid(odds[first]), first
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), pa.array(score), texts.take(pa.array(worst, mask=worst < 0))],
                    ["doc_id", "source", "score", "worst"],
                )

    return voted.mapInArrow(run, "doc_id bigint, source string, score double, worst string")


@lru_cache(maxsize=2)
def _classifier(weights: bytes, bias: float) -> Classifier:
    return Classifier(np.frombuffer(weights, np.float32), bias)


def score_documents(documents: DataFrame, labels: DataFrame | None = None, classifier: Classifier | None = None) -> DataFrame:
    """(doc_id, source, score, worst): every document with the score and plain words of its worst segment.

    Null, empty and blank texts score 0 with a null segment.  Texts are read whole.
    Repeated rows give repeated results.  Without a classifier one is fitted first, on
    the documents themselves and, where given, on hand labels (doc_id, toxic).
    """
    voted = vote_documents(documents)
    return score_voted(voted, classifier or fit(voted, labels)[1])


def held_out_accuracy(scored: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(documents, labelled_abusive, flagged, both, precision, recall) over the labels that fitting never sees; torn labels are left out."""
    said = said_of(labels.where(held_out())).where("said != 0.5")
    bad, hit = F.col("said") > 0.5, F.col("score") >= threshold
    return (
        scored.groupBy("doc_id").agg(F.max("score").alias("score")).join(said, "doc_id")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if(bad).alias("labelled_abusive"), F.count_if(hit).alias("flagged"), F.count_if(bad & hit).alias("both"))
        .withColumns({"precision": F.col("both") / F.nullif("flagged", F.lit(0)), "recall": F.col("both") / F.nullif("labelled_abusive", F.lit(0))})
    )


def rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, n_documents, n_flagged, rate, mean_score); documents without source are one group."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum((F.col("score") >= threshold).cast("bigint")).alias("n_flagged"),
        F.avg((F.col("score") >= threshold).cast("double")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )
