"""Toxicity by compression distance to two zstandard dictionaries.

Both dictionaries are trained by zstandard, on the words of labelled documents: the
ordinary one on those of ordinary documents, the toxic one on those words of toxic
documents that hold a typical segment.  A segment (``SHORTEST`` to ``LONGEST`` bytes, with
the spaces around a word) is typical if the lower bound of its rate in toxic documents
is ``RATIO`` times its rate in ordinary ones: labels mark whole documents, whose words are mostly
ordinary, and trained on all of them the two dictionaries hardly differ (the README has
figures).  A word counts once for each document that holds it.  The
toxic dictionary is followed by the ordinary one, so that both agree on ordinary words to the byte.

A document is cut into windows of ``WINDOW_WORDS``
words over its whole text (longer words than ``LONG_WORD`` characters, as in scripts
without spaces, are cut into overlapping pieces that count as words); each window is compressed with both dictionaries, and
the difference of the lengths is its distance.  A logistic unit on how many
windows pass each distance, calibrated on the labelled sample, gives the score.

Learning uses at most ``MAX_LABELLED`` labelled documents (those first by a hash
of the id), of each the whole text.  The tasks count and measure; what reaches the driver are words and segments
that a share of the sample's documents have in common, and a few numbers for each of these documents.
Id, language, source and labels are never inputs of a score.

Edge cases: a null or empty text has no windows and gets the score of distance 0;
repeated rows score alike; without toxic or ordinary labels every score is 0; a column
``score`` of the input is replaced, other columns come back as they were; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrand.llm.common import bounded_batches, discard, held_out, map_batches, materialize, share, table
from keystrand.llm.quality_classifier import labelled_sample

WINDOW_WORDS = 10
MAX_LABELLED = 6000
#: Characters of a word, beyond which it is cut into pieces.
LONG_WORD = 64
#: Segment lengths in bytes, with the spaces around a word.
SHORTEST, LONGEST = 5, 9
#: A segment is typical if its lower bound in toxic documents is this many times its rate in ordinary ones.
RATIO = 12
#: Share of its label's documents that a word of the ordinary dictionary, and a typical segment, is in at least.
LEAST_WORD, LEAST_SEGMENT = 0.001, 0.01
ORDINARY_BYTES, TOXIC_BYTES = 32_000, 8_192
DISTANCES = (1, 2, 3, 4, 5, 6, 8)


def pieces_of(word: str) -> list[str]:
    """The word, or its pieces if it is long; they overlap, so that each segment lies whole in one of them."""
    step = LONG_WORD - LONGEST + 1
    return [word[i : i + LONG_WORD] for i in range(0, max(1, len(word) - LONGEST + 1), step)] if len(word) > LONG_WORD else [word]


def windows_of(text: str | None) -> list[bytes]:
    words = [p for w in text.lower().split() for p in pieces_of(w)] if text else []
    return [f" {' '.join(words[i : i + WINDOW_WORDS])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), WINDOW_WORDS)]


def segments_of(windows: list[bytes]) -> set[bytes]:
    words = {w for x in windows for w in x.split()}
    return {s[i : i + n] for w in words if (s := b" " + w + b" ") for n in range(SHORTEST, LONGEST + 1) for i in range(len(s) - n + 1)}


def typical_segments(toxic: dict[bytes, int], n_toxic: int, ordinary: dict[bytes, int], n_ordinary: int) -> frozenset[bytes]:
    """Segments by the number of documents of either label that hold them."""
    return frozenset(s for s, n in toxic.items() if (n - math.sqrt(n)) / n_toxic >= RATIO * (ordinary.get(s, 0) + 1) / n_ordinary)


def dictionary(words: dict[bytes, int], size: int, k: int, d: int) -> bytes:
    """A dictionary that zstandard trains on words, each as often as its documents; too few words to train on are the dictionary."""
    samples = [b" " + w + b" " for w, n in sorted(words.items()) for _ in range(n)]
    random.Random(5).shuffle(samples)
    try:
        found = zstandard.train_dictionary(size, samples, k=k, d=d, level=3).as_bytes()
    except zstandard.ZstdError:
        found = b"".join(samples)
    return found[-size:] or b" "


class CompressionModel:
    """The two dictionaries and the calibrated logistic unit."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = (ordinary, toxic)
        self.weights = np.zeros(0)
        self._open()

    def __getstate__(self):
        return {"contents": self.contents, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def _open(self) -> None:
        settings = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, min_match=SHORTEST, window_log=17, hash_log=16, chain_log=16, search_log=6,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.compressors = []
        for content in self.contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=settings))

    def measures(self, windows: list[bytes]) -> list[float]:
        ordinary, toxic = (c.compress for c in self.compressors)
        d = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in windows), np.int64, len(windows)) if windows else np.zeros(1, np.int64)
        over = [(d >= k).sum() for k in DISTANCES]
        return [*np.log1p(over), *np.sqrt(np.array(over) / len(d)), float(d.max()), float(np.log1p(len(d)))]

    def calibrate(self, x: np.ndarray, labels: np.ndarray, steps: int = 3000) -> None:
        """Gradient descent on the log-loss of standardised measures."""
        mean, scale = x.mean(0), x.std(0) + 1e-6
        x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 0.5 * (x.T @ (p - labels) / len(labels) + 1e-3 * np.append(w[:-1], 0))
        self.weights = np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())

    def score(self, windows: list[bytes]) -> float:
        z = float(np.dot(self.weights[:-1], self.measures(windows)) + self.weights[-1])
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def counted(rows: DataFrame, things: Callable[[list[bytes]], set[bytes]], least: float = 1) -> dict[bytes, int]:
    """How many of the rows' texts have each of the things; those of at least ``least`` texts."""

    def count(batches):
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(things(windows_of(text)))
            if len(found) > 1 << 20:
                yield pa.RecordBatch.from_pydict({"thing": list(found), "n": list(found.values())})
                found = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["thing", "n"])

    sums = rows.select("text").mapInArrow(count, "thing binary, n bigint").groupBy("thing").agg(F.sum("n").alias("n"))
    return {bytes(r["thing"]): r["n"] for r in sums.filter(F.col("n") >= least).collect()}


def words_in(windows: list[bytes]) -> set[bytes]:
    return {w for x in windows for w in x.split()}


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> CompressionModel | None:
    """Fit on a bounded sample of labelled rows."""
    bounded_batches(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, "toxic", limit).select("text", "label"), "toxicity-sample")
    sizes = dict(sample.groupBy("label").agg(F.count("*")).collect())
    n, m = sizes.get(1, 0), sizes.get(0, 0)
    if not n or not m:
        return None
    toxic, ordinary = sample.filter("label = 1"), sample.filter("label = 0")
    rate = counted(toxic, segments_of, max(4, LEAST_SEGMENT * n))
    other = counted(ordinary, lambda windows: segments_of(windows) & rate.keys())
    typical = typical_segments(rate, n, other, m)
    base = dictionary(counted(ordinary, words_in, LEAST_WORD * m), ORDINARY_BYTES, 64, 6)
    telling = dictionary(counted(toxic, lambda windows: {w for w in words_in(windows) if not typical.isdisjoint(segments_of([w]))}), TOXIC_BYTES, 16, 6)
    model = CompressionModel(base, telling + base)

    def measured(batches):
        for batch in batches:
            x = [model.measures(windows_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    rows = sorted((r["label"], r["x"]) for r in sample.select("label", "text").mapInArrow(measured, "label int, x array<double>").collect())
    model.calibrate(np.array([x for _, x in rows]), np.array([k for k, _ in rows], np.float64))
    discard(sample)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """All columns of ``docs`` plus score (0 to 1); learns from ``labels`` first."""
    model = share(docs.sparkSession, train(docs, labels, limit))

    def make():
        m = model()

        def fn(batch: pa.RecordBatch) -> dict[str, object]:
            return {"score": [m.score(windows_of(t)) if m else 0.0 for t in batch.column("text").to_pylist()]}

        return fn

    return map_batches(docs, [T.StructField("score", T.DoubleType())], make)


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
