"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence has a logistic score of the words in it, the document the noisy-or of its sentences, and
only document labels are learnt from.  The fit runs on a bounded, hash-chosen sample of labelled
documents; scoring is one pass over all texts that also names the most offending sentence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, materialize, rows

#: Bound of the training sample: documents of each label, lowest hash of the doc_id first.
TRAIN_POSITIVE, TRAIN_NEGATIVE = 4000, 8000
#: A feature is kept if MIN_POSITIVE toxic documents of the sample have it, and MIN_Z standard deviations more
#: of them than chance would give; of these, the MAX_FEATURES with the largest deviation.
MIN_POSITIVE, MIN_Z, MAX_FEATURES = 3, 3.5, 20000
EPOCHS, RATE, L2, START_BIAS = 200, 0.3, 1e-4, -5.0
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, words) of each sentence that has words; offsets are code points of the text."""
    out = []
    for m in SENTENCE.finditer(text or ""):
        words = set(WORD.findall(m.group().lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def features(word: str) -> list[str]:
    """The word itself and its beginnings and ends."""
    n = len(word)
    return ["=" + word, *["^" + word[:k] for k in PREFIXES if n > k], *["$" + word[-k:] for k in SUFFIXES if n > k]]


class Model:
    """Feature weights and bias; ``score`` gives the noisy-or of a document and its worst sentence.

    The logit of a sentence is the bias plus the weights of its distinct words, that of a word the sum over
    its features.  Words are remembered by spelling, up to ``remembered`` of them.
    """

    def __init__(self, weights: dict[str, float], bias: float, remembered: int = 200_000):
        self.by_feature, self.bias, self.limit = weights, bias, remembered
        self.weights: dict[str, float] = {}
        self.absent: set[str] = set()

    def learn_words(self, words: set[str]) -> None:
        if len(self.absent) > self.limit:
            self.absent.clear()
        if len(self.weights) > self.limit:
            self.weights.clear()
        get = self.by_feature.get
        for w in [w for w in words if w not in self.weights and w not in self.absent]:  # (a difference with keys() walks all keys)
            found = [x for x in map(get, features(w)) if x is not None]
            if found:
                self.weights[w] = math.fsum(found)
            else:
                self.absent.add(w)

    def score(self, text: str | None) -> tuple[float, int | None, int | None, float]:
        """(score, start, end, sentence score); a text without sentences has score 0 and no worst sentence."""
        keep, worst = 0.0, (-1.0, None, None)
        bag = sentences(text)
        self.learn_words(set().union(*[b[2] for b in bag]))
        known, get = self.weights.keys(), self.weights.get
        base = math.log1p(math.exp(self.bias))
        for start, end, words in bag:
            hit = known & words
            if hit:
                z = self.bias + math.fsum(map(get, hit))
                cost = z if z > 30 else math.log1p(math.exp(z))
                p = 1.0 / (1.0 + math.exp(-max(z, -700.0)))
            else:
                cost, p = base, 1.0 / (1.0 + math.exp(-self.bias))
            keep += cost
            if p > worst[0]:
                worst = (p, start, end)
        return 1.0 - math.exp(-keep), worst[1], worst[2], max(worst[0], 0.0)


class Bags:
    """Documents as bags of sentences in flat arrays: each kind of sentence of a document once, with its number.

    Sentences without any feature are all of one kind; most are.
    """

    def __init__(self, table: pa.Table):
        order = np.lexsort((table.column("toxic").to_numpy(), table.column("digest").to_numpy()))
        table = table.take(pa.array(order))
        self.toxic = table.column("toxic").to_numpy().astype(np.float64)
        of = lambda c: [np.frombuffer(x, np.int32) for x in table.column(c).to_pylist()]
        sizes, features, empty = of("sizes"), of("features"), table.column("empty").to_numpy()
        self.n = sum(map(len, sizes)) + len(sizes)
        self.feature = np.concatenate([*features, np.empty(0, np.int32)])
        every = [np.append(x, np.int32(0)) for x in sizes]  # the last kind of each document is the sentence without features
        self.sentence = np.repeat(np.arange(self.n, dtype=np.int32), np.concatenate([*every, np.empty(0, np.int32)]))
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), [len(x) for x in every])
        self.times = np.ones(self.n)
        self.times[np.cumsum([len(x) for x in every], dtype=np.int64) - 1] = empty


def fit_bags(bags: Bags, n_features: int) -> tuple[np.ndarray, float]:
    """(weights, bias) by full-batch Adam on the noisy-or log likelihood of the documents' labels.

    log(1 - P) of a document is the sum of log(1 - p) over its sentences, so a label of 0 pushes every
    sentence down, while a label of 1 shares its pull among the sentences by (1 - P) / P * p.
    """
    y, s, f, owner, times = bags.toxic, bags.sentence, bags.feature, bags.owner, bags.times
    if not y.sum():
        return np.zeros(n_features), -30.0
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / max((1 - y).sum(), 1))
    theta = np.concatenate([np.zeros(n_features), [START_BIAS]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(s, theta[f], bags.n) + theta[-1]
        keep = np.bincount(owner, times * np.logaddexp(0, z), len(y))
        p_doc = -np.expm1(-keep)
        pull = np.where(y > 0, (1 - p_doc) / np.maximum(p_doc, 1e-12), -1.0) * weight
        g_z = -pull[owner] * times / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(f, g_z[s], n_features) + L2 * theta[:-1], [g_z.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def training_sample(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """(text, toxic) of labelled documents whose crc32(doc_id as text) mod ``fold`` is not 0, within the bounds.

    Rows of ``labels`` without a doc_id or a label are left out; a doc_id labelled twice takes the larger label.
    Documents of one label whose whole texts agree count once.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(fold)) != 0).withColumn("_rank", F.xxhash64(F.lit("toxic"), "_id"))
    parts = [
        marks.where(F.col("toxic") > 0).orderBy("_rank", "_id").limit(TRAIN_POSITIVE),
        marks.where(F.col("toxic") <= 0).orderBy("_rank", "_id").limit(TRAIN_NEGATIVE),
    ]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # bounded by the two limits
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(sample, "_id")
    return materialize(texts.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct(), "toxic")


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """Feature weights and bias.  The sample and the features that go to the driver are bounded by parameters."""
    sample = training_sample(docs, labels)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = Emitter(arrow_schema(feature=pa.string(), toxic=pa.int32()))
            for text, toxic in zip(*rows(batch, "text", "toxic"), strict=True):
                words = set(WORD.findall(text.lower()))
                for f in {f for w in words for f in features(w)}:
                    e.add(f, toxic)
                if e.full():
                    yield e.take()
            yield e.take()

    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    share = totals.p / max(totals.n, 1)
    counts = sample.mapInArrow(held, "feature string, toxic int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))
    z = (F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    chosen = counts.where(F.col("p") >= MIN_POSITIVE).withColumn("z", z).where(F.col("z") >= MIN_Z)
    names = sorted(r.feature for r in chosen.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect())
    number = {f: i for i, f in enumerate(names)}

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = Emitter(arrow_schema(toxic=pa.int32(), digest=pa.int64(), empty=pa.int32(), sizes=pa.binary(), features=pa.binary()))
            for text, toxic in zip(*rows(batch, "text", "toxic"), strict=True):
                found = [sorted(number[f] for w in s[2] for f in features(w) if f in number) for s in sentences(text)]
                some = [x for x in found if x]
                flat = np.array([i for x in some for i in x], np.int32)
                e.add(toxic, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), len(found) - len(some), np.array([len(x) for x in some], np.int32).tobytes(), flat.tobytes())
            yield e.take()

    # at most TRAIN_POSITIVE + TRAIN_NEGATIVE rows, of selected features only, in flat form
    bags = Bags(sample.mapInArrow(bag, "toxic int, digest long, empty int, sizes binary, features binary").toArrow())
    weights, bias = fit_bags(bags, len(names))
    return dict(zip(names, weights.tolist(), strict=True)), bias


#: What ``classify`` appends.
VERDICT = ("score", "predicted", "worst_start", "worst_end", "worst_score")


def classify(docs: DataFrame, labels: DataFrame, names: Sequence[str] = VERDICT) -> DataFrame:
    """``docs`` with score, predicted, worst_start, worst_end, worst_score appended, by ``names``; one row per row.

    Null and empty texts score 0; a text of any length is scored whole.  Scores depend on the text alone, so
    repeated rows score alike.  Columns of ``docs`` with these names are replaced; all others, whatever
    their names, pass through.  Without labelled documents nothing is predicted toxic; an empty table gives
    an empty result.
    """
    weights, bias = train(docs, labels)
    own = list(names)
    keep = [c for c in docs.columns if c not in own]
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # at most MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*model.value)
        for batch in batches:
            found = [scorer.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            extra = [
                pa.array([f[0] for f in found], pa.float64()),
                pa.array([int(f[0] >= 0.5) for f in found], pa.int32()),
                pa.array([f[1] for f in found], pa.int32()),
                pa.array([f[2] for f in found], pa.int32()),
                pa.array([f[3] for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns + extra, [*keep, *own])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in zip(own, ("double", "integer", "integer", "integer", "double"), strict=True):
        schema = schema.add(name, kind)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text")).toDF(*[f"c{k}" for k in range(len(keep) + 1)]).mapInArrow(run, schema)
