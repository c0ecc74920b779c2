"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (about ``PASSAGE_WORDS`` words each, over the whole
text).  Every passage is described by language-free measures of its bytes and
words, encoded by one hidden layer, weighted by gated attention, and the weighted
sum of the encodings is scored by a logistic unit.  All weights, the attention
included, are learned from document labels.

Training uses at most ``MAX_LABELLED`` labelled documents (those first by a hash
of the id), with all their passages; scoring uses every passage of every document.
Id, language, source and labels are never inputs of a score.

Edge cases: a null or empty text is one passage without words and gets a score
like any other; repeated rows score alike; without labels every score is 0.5; a column
``score`` of the input is replaced, other columns come back as they were; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrand.llm.common import held_out, map_batches, share, shielded, table, training_rows

PASSAGE_WORDS = 100
MAX_LABELLED = 6000
HIDDEN, ATTENTION = 24, 12
EPOCHS = 30
SEED = 11

#: Byte classes; every byte of UTF-8 text is in one.
_LETTER_LOW, _LETTER_UP, _DIGIT, _SPACE, _STOP, _MARK, _HIGH, _REST = range(8)


def _classes() -> np.ndarray:
    kind = np.full(256, _REST, np.int64)
    kind[ord("a") : ord("z") + 1] = _LETTER_LOW
    kind[ord("A") : ord("Z") + 1] = _LETTER_UP
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    kind[[ord(c) for c in ".,;:?"]] = _STOP
    kind[[ord(c) for c in "#*$%&|<>!@={}[]\\^~_"]] = _MARK
    kind[128:] = _HIGH
    return kind


_KIND = _classes()
N_FEATURES = 22


def passage_features(text: str | None) -> np.ndarray:
    """One row of measures for each passage of the whole text."""
    words = text.split() if text else []
    count = max(1, -(-len(words) // PASSAGE_WORDS))
    out = np.zeros((count, N_FEATURES), np.float32)
    seen: set[str] = set()
    for p in range(count):
        part = words[p * PASSAGE_WORDS : (p + 1) * PASSAGE_WORDS]
        n = len(part)
        if not n:
            continue
        raw = np.frombuffer(" ".join(part).encode("utf-8", "surrogatepass"), np.uint8)
        by = np.bincount(_KIND[raw], minlength=8) / len(raw)
        distinct = set(part)
        lengths = np.fromiter(map(len, part), np.int64, n)
        doubled = sum(a == b for a, b in zip(part, part[1:], strict=False))
        row = out[p]
        row[:8] = by
        row[8] = np.log(n) / 5
        row[9] = len(distinct) / n
        row[10] = doubled / n
        row[11] = lengths.mean() / 10
        row[12] = lengths.std() / 10
        row[13] = (lengths == 1).mean()
        row[14] = (lengths > 20).mean()
        row[15] = sum(map(str.isalpha, part)) / n
        row[16] = sum(map(str.istitle, part)) / n
        row[17] = sum(map(str.isupper, part)) / n
        row[18] = sum(w[-1] in ".?!" for w in part) / n
        row[19] = sum(w in seen for w in distinct) / len(distinct)
        row[20] = len(set(zip(part, part[1:], strict=False))) / n
        row[21] = np.log1p(len(words)) / 10
        seen |= distinct
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Passage encoder, gated attention and logistic unit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.weights = {
            "W": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION),
            "a": draw(ATTENTION, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Bags are consecutive rows of x that begin at ``starts``."""
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (v * u) @ w["a"]
        bag = np.zeros(len(x), np.int64)
        bag[starts[1:]] = 1
        bag = np.cumsum(bag)
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        attention = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(attention[:, None] * h, starts)
        return {"x": x, "h": h, "v": v, "u": u, "bag": bag, "attention": attention, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def gradient(self, f: dict[str, np.ndarray], starts: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
        """Of the loss whose derivative by each bag's logit is g."""
        w, bag, at, h = self.weights, f["bag"], f["attention"], f["h"]
        dz = g[:, None] * w["c"]
        inner = (dz[bag] * h).sum(1)
        de = at * (inner - np.add.reduceat(at * inner, starts)[bag])
        dv, du = de[:, None] * w["a"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * w["a"] * f["v"] * f["u"] * (1 - f["u"])
        dh = (at[:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T) * (1 - h**2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": ((f["v"] * f["u"]) * de[:, None]).sum(0), "c": f["z"].T @ g, "d": g.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> AttentionModel:
        """Adam on the mean log-loss; the rarer label counts up to three times."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        share1 = min(0.75, max(0.25, labels.mean()))
        weight = np.where(labels == 1, 0.5 / share1, 0.5 / (1 - share1))
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        s = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            order = rng.permutation(len(bags))
            for k in range(0, len(order), 64):
                pick = order[k : k + 64]
                starts = np.cumsum([0, *(len(bags[i]) for i in pick)])[:-1]
                f = self.forward(np.concatenate([bags[i] for i in pick]), starts)
                grads = self.gradient(f, starts, weight[pick] * (f["p"] - labels[pick]) / len(pick))
                step += 1
                for name, value in self.weights.items():
                    g = grads[name] + 1e-4 * value
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.999 * s[name] + 0.001 * g * g
                    value -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        return self.forward(np.concatenate(bags), starts)["p"] if bags else np.empty(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents, first by a hash of the id, that may be learned from; columns doc_id, text and label."""
    rows = labels.filter(training_rows() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    # at most ``limit`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> AttentionModel | None:
    def measured(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                rows.append(passage_features(text).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, "quality", limit)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(sample.mapInArrow(measured, f"doc_id {kind}, label int, x binary").collect(), key=lambda r: (str(r["doc_id"]), bytes(r["x"])))
    if not rows:
        return None
    bags = [np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES).astype(np.float64) for r in rows]
    return AttentionModel().fit(bags, np.array([r["label"] for r in rows], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """All columns of ``docs`` plus score (0 to 1); learns from ``labels`` first."""
    model = share(docs.sparkSession, train(docs, labels, limit))

    def make():
        m = model()

        def fn(batch: pa.RecordBatch) -> dict[str, object]:
            bags = [passage_features(t) for t in batch.column("text").to_pylist()]
            return {"score": m.score(bags) if m else np.full(len(bags), 0.5)}

        return fn

    return map_batches(docs, [T.StructField("score", T.DoubleType())], make)


KEEP_AT = 0.3


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts have a score like any other, repeated rows go or stay together.

    All columns of the input come back as they were, whatever their names.
    """
    given, own = shielded(docs, ["score"])
    scored = score_quality(given, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= KEEP_AT).select(*[own(c) for c in docs.columns])
