"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max index.

Terms are words and their beginnings of four and five letters, so that unseen words of a seen stem
count. The vocabulary holds the terms that occur with label 1 more often than chance allows
(chi-square) and at least ``LEAST_LIFT`` times as often as with label 0, at most ``TERMS``. Examples are a sample of learned labels, at most ``EXAMPLES`` of
each label, by a hash of the id, each text once; vocabulary, vectors of examples and the index are
bounded by these and are what the driver holds. A vector holds the known terms of a text, but is
normed over all its terms: what else a document says makes it less like any example. Document
frequencies of all terms are counted over all documents, in ``SLOTS`` slots by hash; terms of one slot
count as one in norms and frequencies.

The index lists, by term and block of examples, the postings and the greatest weight. A query
bounds every block by these weights, scores the best blocks, and then all blocks whose bound
reaches the k-th score so far: the neighbours are exactly those of the full cosine. Their votes
are weighted by similarity, and the share of label 1 among all votes along; a logistic curve, fitted on
the examples with each left out in turn and weighted back to the share of the labels, turns votes and similarity into a probability.

Results: a text without a known term (null and empty ones too) gets the share of toxic ones among
such examples; without any learned label the score is 0, with one class only it is that class's
share. Repeated rows are scored alike; ids with contradicting or null labels aren't learned from;
labels of absent documents are ignored; an empty table gives an empty table; ties go to the
example that comes first in the index; very long texts are read whole. Other columns are ignored. No score reads label, language,
source or id of the scored row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetrail.llm.shipping import ship_code
from changetrail.llm.storage import written
from changetrail.llm.text_arrays import ragged

EXAMPLES = 4000
TERMS = 4096
LEAST_DOCS = 3
LEAST_CHI_SQUARE = 24.0
LEAST_LIFT = 4.0
NEIGHBOURS = 15
BLOCK = 64
FIRST_BLOCKS = 4
THRESHOLD = 0.7
STEMS = (4, 5)
SLOTS = 1 << 18
MASS = 1.0  # of the share of label 1 among the votes: as much as one neighbour of cosine 1
KNOWN_WORDS = 1 << 17  # whose slots a task remembers
WORD = re.compile(r"\w+")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def text_terms(text: str | None) -> Counter:
    """Occurrences of every term; stems end in ``*``."""
    words = Counter(WORD.findall((text or "").lower()))
    terms = Counter(words)
    for word, n in words.items():
        for size in STEMS:
            if len(word) > size:
                terms[word[:size] + "*"] += n
    return terms


def slot(term: str) -> int:
    return zlib.crc32(term.encode()) % SLOTS


class Slots(dict):
    """The slots of a word and its stems, remembered for the words asked for last."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        own = (slot(word), *[slot(word[:size] + "*") for size in STEMS if len(word) > size])
        self[word] = own
        return own

    def counted(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The slots of all terms of some counted words, and how often each occurs."""
        own = [(at, n) for word, n in words.items() for at in self[word]]
        pairs = np.array(own, dtype=np.int64).reshape(-1, 2)
        slots, where = np.unique(pairs[:, 0], return_inverse=True)
        return slots, np.bincount(where, pairs[:, 1], minlength=len(slots))


def idf_of(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.log((1 + documents) / (1 + frequency)) + 1


# --- index -------------------------------------------------------------------------------
@dataclass
class Index:
    """Unit vectors of the examples by term and block."""

    idf: np.ndarray
    owners: np.ndarray  # of postings: the example
    weights: np.ndarray  # of postings
    bounds: np.ndarray  # (terms, blocks + 1): where a block's postings of a term begin
    most: np.ndarray  # (terms, blocks): greatest weight of a block
    toxic: np.ndarray
    ids: np.ndarray
    prior: float  # of a text without known terms
    share: float  # of label 1 among all learned labels
    curve: tuple[float, float, float]

    def vector(self, terms: np.ndarray, counts: np.ndarray, norm: float) -> np.ndarray:
        """Weights of the known terms of a text whose whole vector has the length ``norm``."""
        return (1 + np.log(counts)) * self.idf[terms] / norm

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS,
                but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the ``k`` nearest examples of positive cosine."""
        above = weights @ self.most[terms]
        order = np.argsort(-above, kind="stable")
        order = order[above[order] > 0]
        found, scores = self._score(order[:FIRST_BLOCKS], terms, weights, but)
        kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 0.0
        rest = order[FIRST_BLOCKS:]
        rest = rest[above[rest] >= kth - 1e-6]
        if len(rest):
            more, more_scores = self._score(rest, terms, weights, but)
            found, scores = np.concatenate([found, more]), np.concatenate([scores, more_scores])
        best = np.lexsort((found, -scores))[:k]
        return found[best], scores[best]

    def _score(self, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray,
               but: int) -> tuple[np.ndarray, np.ndarray]:
        starts = self.bounds[terms][:, blocks].ravel()
        counts = self.bounds[terms][:, blocks + 1].ravel() - starts
        at = ragged(starts, counts)
        share = np.repeat(np.repeat(weights, len(blocks)), counts) * self.weights[at]
        owners, where = np.unique(self.owners[at], return_inverse=True)
        scores = np.bincount(where, share, minlength=len(owners))
        keep = owners != but
        return owners[keep], scores[keep]

    def votes(self, found: np.ndarray, scores: np.ndarray) -> tuple[float, float]:
        """Share of label 1 among the neighbours, weighted by similarity, and their closeness.

        The share among all labels votes too, so that neighbours far away say little.
        """
        vote = ((scores * self.toxic[found]).sum() + MASS * self.share) / (scores.sum() + MASS)
        return float(vote), float(scores.mean()) if len(found) else 0.0

    def score(self, vote: float, close: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * vote + c * close))))


def build_index(vectors: list[tuple[int, int, np.ndarray, np.ndarray, float]], documents: int,
                frequency: np.ndarray, shares: tuple[int, int]) -> Index:
    """``vectors``: (id, label, terms, counts, norm) of examples; ``shares``: learned labels 0 and 1."""
    idf = idf_of(documents, frequency)
    known = [v for v in vectors if len(v[2])]
    # Examples with the same strongest term stand together, so that a block has few terms.
    known.sort(key=lambda v: (int(v[2][np.argmax(np.log(v[3]) + idf[v[2]])]), v[0]))
    n, blocks, terms = len(known), max(1, -(-len(known) // BLOCK)), len(frequency)
    index = Index(idf, *(np.zeros(0),) * 4, np.array([v[1] for v in known], dtype=float),
                  np.array([v[0] for v in known], dtype=np.int64), 0.0, shares[1] / max(1, sum(shares)),
                  (0.0, 0.0, 0.0))
    term_of = np.concatenate([v[2] for v in known] or [np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(v[2]) for v in known])
    weight = np.concatenate([index.vector(*v[2:]) for v in known] or [np.zeros(0)])
    order = np.lexsort((owner, term_of))
    index.owners, index.weights = owner[order], weight[order]
    cell = term_of[order] * blocks + index.owners // BLOCK
    counts = np.bincount(cell, minlength=terms * blocks)
    ends = np.cumsum(counts).reshape(terms, blocks)
    index.bounds = np.hstack([(ends - counts.reshape(terms, blocks))[:, :1], ends])
    index.most = np.zeros(terms * blocks)
    np.maximum.at(index.most, cell, index.weights)
    index.most = index.most.reshape(terms, blocks)
    # Back from the balanced sample to the share of the labels.
    sampled = np.bincount([v[1] for v in vectors], minlength=2)
    scale = np.array([shares[y] / sampled[y] if sampled[y] else 0.0 for y in (0, 1)])
    blank = np.bincount([v[1] for v in vectors if not len(v[2])], minlength=2) * scale
    index.prior = float((blank[1] + index.share) / (blank.sum() + 1)) if len(vectors) else 0.0
    if sampled.min() == 0:
        index.prior = index.share
    votes = [index.votes(*index.nearest(v[2], index.vector(*v[2:]), but=i)) for i, v in enumerate(known)]
    # Examples without known terms have no neighbours.
    without = [v[1] for v in vectors if not len(v[2])]
    votes = np.array(votes + [(index.share, 0.0)] * len(without)).reshape(-1, 2)
    labels = np.concatenate([index.toxic, np.array(without, dtype=float)])
    index.curve = fit_curve(votes, labels, scale[labels.astype(int)])
    return index


def fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.hstack([np.ones((len(votes), 1)), votes])
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    curve = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        gradient = x.T @ (weights * (labels - p)) - ridge @ curve
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        curve = curve + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, curve))


# --- Spark -------------------------------------------------------------------------------
def learned_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``id, toxic`` of ids with one label that may be learned from."""
    return (labels.where(F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("id"))
            .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high"))
            .where("toxic = high and toxic in (0, 1)").select("id", F.col("toxic").cast("int").alias("toxic")))


def sample_texts(docs: DataFrame, learned: DataFrame, key: str, text: str) -> DataFrame:
    """``id, toxic, text`` of at most EXAMPLES examples of each label, one text each, equal ones once."""
    chosen = None
    for label in (0, 1):
        part = learned.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES)
        chosen = part if chosen is None else chosen.union(part)
    chosen = written(chosen, "chosen")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Broadcast: at most 2 * EXAMPLES rows of 12 bytes.
    # One text of each id, however many rows it has.
    found = (rows.join(F.broadcast(chosen), "id").groupBy("id", "toxic")
             .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    return written(found.groupBy(F.xxhash64("text").alias("digest"))
                   .agg(F.min(F.struct("id", "toxic", "text")).alias("one")).select("one.*"), "examples")


def vocabulary(examples: DataFrame) -> list[str]:
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(text_terms(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.string()))],
                                             ["toxic", "terms"])

    sizes = {row["toxic"]: row["n"] for row in
             examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return []
    counted = (examples.select("toxic", "text").mapInArrow(terms, "toxic int, terms array<string>")
               .select("toxic", F.explode("terms").alias("term")).groupBy("term")
               .agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")))
    a, n, total = F.col("a").cast("double"), F.col("n").cast("double"), float(ones + zeros)
    chi = total * F.pow(a * zeros - (n - a) * ones, 2) / (ones * zeros * n * (total - n))
    best = (counted.where((F.col("n") >= LEAST_DOCS) & (n < total) & (a * zeros >= LEAST_LIFT * (n - a) * ones))
            .withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI_SQUARE)
            .orderBy(F.desc("chi"), "term").limit(TERMS))
    return [row["term"] for row in best.select("term").collect()]


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """The number of rows, and of rows per slot that have a term there. A task sends one row per slot."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, rows = Slots(), np.zeros(SLOTS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found[known.counted(Counter(WORD.findall((text or "").lower())))[0]] += 1
            rows += batch.num_rows
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, SLOTS), pa.int32()),
                                          pa.array(np.append(found[some], rows))], ["slot", "n"])

    counted = (docs.select(F.col(text)).mapInArrow(count, "slot int, n long")
               .groupBy("slot").agg(F.sum("n").alias("n")).collect())  # at most SLOTS + 1 rows
    frequency = np.zeros(SLOTS + 1)
    for row in counted:
        frequency[row["slot"]] = row["n"]
    return int(frequency[SLOTS]), frequency[:SLOTS]


def document_vectors(docs: DataFrame, terms: list[str], idf: np.ndarray, key: str, text: str) -> DataFrame:
    """``id, terms, counts, norm, digest`` of every row: the known terms of its whole text, the length
    of the vector of all its terms, and the text's hash."""
    shared = docs.sparkSession.sparkContext.broadcast(({term: i for i, term in enumerate(terms)}, idf))
    key_type = docs.schema[key].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, weights = shared.value
        stems = {size: {t[:-1]: i for t, i in numbers.items() if t[-1] == "*" and len(t) == size + 1}
                 for size in STEMS}
        known = Slots()
        for batch in batches:
            own, norms = [], []
            for text in batch.column(1).to_pylist():
                found: Counter = Counter()
                words = Counter(WORD.findall((text or "").lower()))
                for word, n in words.items():
                    if word in numbers:
                        found[numbers[word]] += n
                    for size, stem_numbers in stems.items():
                        stem = word[:size]
                        if stem in stem_numbers and len(word) > size:
                            found[stem_numbers[stem]] += n
                own.append(sorted(found.items()))
                # Only texts with a known term are compared.
                slots, counts = known.counted(words) if found else (np.zeros(0, np.int64), np.zeros(0))
                norms.append(float(np.sqrt((((1 + np.log(counts)) * weights[slots])**2).sum())))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([[t for t, _ in row] for row in own], pa.list_(pa.int32())),
                pa.array([[n for _, n in row] for row in own], pa.list_(pa.int32())),
                pa.array(norms, pa.float64()), batch.column(2)],
                ["id", "terms", "counts", "norm", "digest"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest")).mapInArrow(
        vectors, f"id {key_type}, terms array<int>, counts array<int>, norm double, digest long")


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Per input row ``key, held_out, score, predicted, evidence`` (the nearest examples' ids) and
    ``found_terms`` (the known terms of most weight)."""
    return scored_texts(docs, labels, key, text).select(
        F.col("id").alias(key), held_out("id").alias("held_out"), "score", "predicted", "evidence", "found_terms")


def scored_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row ``id, score, evidence, found_terms, predicted`` and ``digest``, the text's xxhash64."""
    spark = docs.sparkSession
    ship_code(spark)
    learned = written(learned_labels(labels, key), "learned")
    shares = learned.agg(F.count(F.when(F.col("toxic") == 0, 1)),
                         F.count(F.when(F.col("toxic") == 1, 1))).first()
    examples = sample_texts(docs, learned, key, text)
    terms = vocabulary(examples)
    documents, frequency = document_frequencies(docs, text)
    idf = idf_of(documents, frequency)
    vectors = written(document_vectors(docs, terms, idf, key, text), "vectors")
    own = document_vectors(examples, terms, idf, "id", "text").join(
        F.broadcast(examples.select("id", "toxic")), "id").distinct().collect()
    index = build_index([(r["id"], r["toxic"], np.array(r["terms"], dtype=np.int64),
                          np.array(r["counts"], dtype=float), r["norm"]) for r in own],
                        documents, frequency[[slot(term) for term in terms]], tuple(shares))
    shared = spark.sparkContext.broadcast((index, terms))
    key_type = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = shared.value
        for batch in batches:
            scores, near, strong = [], [], []
            for found, counts, norm in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                if not found or not len(known.ids):
                    scores.append(known.prior)
                    near.append([])
                    strong.append([])
                    continue
                numbers = np.array(found)
                weights = known.vector(numbers, np.array(counts, dtype=float), norm)
                nearest, cosines = known.nearest(numbers, weights)
                scores.append(known.score(*known.votes(nearest, cosines)))
                near.append(known.ids[nearest[:3]].tolist())
                strong.append([names[i] for i in numbers[np.argsort(-weights, kind="stable")[:5]]])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())),
                pa.array(strong, pa.list_(pa.string())), batch.column(4)],
                ["id", "score", "evidence", "found_terms", "digest"])

    scored = vectors.mapInArrow(
        score, f"id {key_type}, score double, evidence array<long>, found_terms array<string>, digest long")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
