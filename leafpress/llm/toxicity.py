"""Toxic passages by maximum-scoring segments.

Fit: over labelled documents, the log-odds of each word and word stem (STEMS first code points) of standing in toxic against
clean text, with an informative Dirichlet prior (Monroe et al. 2008); a document counts each at most BURST times. A word scores
the largest log-odds of itself and its stems among those that are significant; every other word costs DRIFT.
Score: one linear scan (Ruzzo and Tompa 1999) finds all maximal scoring segments of a text. A segment of score S in n words has
the expectation E = K n exp(-lambda S) in clean text (Karlin and Altschul 1990): lambda solves sum p(w) exp(lambda s(w)) = 1
over the clean words, K is the density of segments in clean training text. Segments with E below SIGNIFICANT are the toxic
passages; a document's evidence is the sum of -ln E over them, and a logistic curve fitted to training labels turns it into a score.

The fit reads at most FIT_DOCS labelled documents, those with the least hash of their id, and keeps at most MODEL_WORDS words, so
that what goes to every worker is bounded. Scoring covers all texts, whole. Null and empty texts have no segment and get the
score of no evidence. Null labels and labels without a document aren't used; of several labels of an id the larger holds.
With no toxic or no clean training document, nothing scores above 0.
Texts of any length are scanned whole in one pass, in memory that grows with their toxic words alone. Other columns stay; only those
named as an output are replaced. Repeated rows get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, documents, plus, sealed, small_batches, unsealed

FIT_DOCS, MODEL_WORDS = 20_000, 20_000
#: Prior strength as a share of all counts, least z-score of a toxic word, cost of any other word, largest expectation of a
#: toxic passage.
PRIOR, LEAST_Z, DRIFT, SIGNIFICANT = 0.02, 5.0, 0.5, 0.5
STEMS, BURST = (4, 5, 6, 7), 8
#: Runs of ASCII letters and anything beyond ASCII.
TOKEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_tokens = re.compile(TOKEN).findall


@dataclass(frozen=True)
class Model:
    words: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    base: float = -10.0
    seen: dict[str, float] = field(default_factory=dict, compare=False, repr=False)

    def score(self, word: str) -> float:
        """0: not a toxic word. The words seen are remembered up to a bound."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= 200_000:
                self.seen.clear()
            got = self.seen[word] = max((self.words.get(f, 0.0) for f in features(word)), default=0.0)
        return got


def features(word: str) -> list[str]:
    """The word, and its stems with a mark."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence whose element i scores s for (i, s) in hits, s > 0, and
    -drift elsewhere. Each held segment remembers its nearest predecessor with a smaller left sum, so that no step repeats."""
    held: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, last, index of that predecessor
    total, done = 0.0, 0
    for i, s in hits:
        left = total - drift * (i - done)
        total, done = left + s, i + 1
        right, first = total, i
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0 or held[j][1] >= right:
                break
            left, first = held[j][0], held[j][2]
            below = held[j][4]
            del held[j:]
            j = below
        held.append((left, right, first, i, j))
    return [(a, b, r - l) for l, r, a, b, _ in held]


def passages(text: str | None, model: Model) -> tuple[list[tuple[int, int, float]], int]:
    """Segments of a text in words, and its number of words."""
    words = _tokens((text or "").lower())
    get, score = model.seen.get, model.score
    hits = [(i, s) for i, w in enumerate(words) if (s := get(w)) or s is None and (s := score(w))]
    return (segments(hits, DRIFT) if hits else []), len(words)


def evidence(found: list[tuple[int, int, float]], n: int, model: Model) -> float:
    total = 0.0
    for _, _, s in found:
        e = math.log(model.k * n) - model.lam * s
        if e < math.log(SIGNIFICANT):
            total -= e
    return total


def _fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5


def training_labels(labels: DataFrame, id_col: str, label_col: str, fit_docs: int) -> DataFrame:
    """At most fit_docs rows (lid, y): ids outside the held-out fold."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (_fold(id_col) != 0))
    one = usable.groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("lid"), "lid").limit(fit_docs)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> Model:
    rows = training_labels(labels, id_col, label_col, fit_docs).collect()
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r.lid, r.y) for r in rows], plus(docs.select(F.col(id_col).alias("lid")).schema, "y int")))
    train = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).join(chosen, "lid")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for y, x in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
                of_doc: Counter[str] = Counter()
                for word, n in Counter(_tokens((x.as_py() or "").lower())).items():
                    for f in features(word):
                        of_doc[f] += n
                for f, n in of_doc.items():
                    sums.setdefault(f, [0, 0])[y != 1] += min(n, BURST)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], names=["word", "t", "c"])

    small_batches(docs.sparkSession)
    counts = cut(train.mapInArrow(count, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    n_t, n_c = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c")).first())
    if not n_t or not n_c:
        return Model()
    prior = (F.col("t") + F.col("c")) * PRIOR
    odds = lambda n, of: F.log((n + prior) / (of + PRIOR * (n_t + n_c) - n - prior))
    delta = odds(F.col("t"), n_t) - odds(F.col("c"), n_c)
    z = delta / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    kept = counts.select("word", "c", delta.alias("delta"), z.alias("z")).filter((F.col("z") >= LEAST_Z) & (F.col("delta") > DRIFT)).orderBy(F.desc("z"), "word").limit(MODEL_WORDS).collect()
    scores = {r.word: float(r.delta) for r in kept}
    if not scores:
        return Model()

    # A word that no clean text has counts as half an occurrence there; a stem's words count for the stem alone.
    p = np.array([max(r.c, 0.5) / n_c for r in kept]) / (1 + len(STEMS))
    s = np.array([r.delta for r in kept])
    low, high = 1e-6, 50.0
    for _ in range(200):
        lam = (low + high) / 2
        low, high = (lam, high) if (p * np.exp(np.minimum(lam * s, 700))).sum() + (1 - p.sum()) * math.exp(-lam * DRIFT) < 1 else (low, lam)
    model = Model(scores, lam)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [passages(x.as_py(), model) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([f for f, _ in found], _SEGMENTS), pa.array([n for _, n in found], pa.int64())], names=["y", "found", "n"])

    small_batches(docs.sparkSession)
    scanned = train.mapInArrow(scan, "y int, found array<struct<first:int,last:int,score:double>>, n long")
    clean = scanned.filter("y != 1").agg(F.sum(F.size("found")), F.sum("n")).first()
    model = Model(scores, lam, ((clean[0] or 0) + 0.5) / ((clean[1] or 0) + 1.0))
    log_e = lambda x: F.log(F.lit(model.k) * F.col("n")) - x["score"] * model.lam
    strength = F.aggregate(F.filter("found", lambda x: log_e(x) < math.log(SIGNIFICANT)), F.lit(0.0), lambda a, x: a - log_e(x))
    # The logarithm of a strength is below 40, so these are 2 * 8001 rows at most.
    bins = scanned.select("y", F.round(F.log1p(strength) * 200).cast("int").alias("bin")).groupBy("y", "bin").count().collect()
    x, y, w = (np.array(v, float) for v in zip(*[(r["bin"] / 200, float(r.y == 1), r["count"]) for r in bins], strict=True))
    slope, base = _logistic(x, y, w)
    return Model(scores, lam, model.k, slope, base)


_SEGMENTS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and base of the ridge-penalised logistic curve: Newton steps, each halved until the penalised likelihood grows."""
    features, penalty = np.stack([x, np.ones_like(x)], 1), np.diag([0.1, 0.001])
    share = min(max((w * y).sum() / w.sum(), 1e-6), 1 - 1e-6)
    a = np.array([0.0, math.log(share / (1 - share))])

    def gain(a: np.ndarray) -> float:
        z = features @ a
        return float((w * (y * z - np.logaddexp(0, z))).sum() - a @ penalty @ a / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ a, -30, 30)))
        step = np.linalg.solve(features.T @ (features * (w * p * (1 - p))[:, None]) + penalty, features.T @ (w * (y - p)) - penalty @ a)
        while np.abs(step).max() > 1e-10 and gain(a + step) < gain(a):
            step = step / 2
        a = a + step
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs and toxic_score (0 to 1), toxic_passages: first and last word and score of each significant passage, in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, kept = [], []
            for x in batch.column("__text"):
                found, n = passages(x.as_py(), model)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * math.log1p(evidence(found, n, model)) + model.base)))))
                kept.append([f for f in found if math.log(model.k * n) - model.lam * f[2] < math.log(SIGNIFICANT)])
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(scores, pa.float64()), pa.array(kept, _SEGMENTS)], names=[*names, "toxic_score", "toxic_passages"])

    small_batches(docs.sparkSession)
    inner = sealed(docs, {"__text": F.col(text_col)}, ["toxic_score", "toxic_passages"])
    schema = plus(inner.drop("__text").schema, "toxic_score double, toxic_passages array<struct<first:int,last:int,score:double>>")
    return unsealed(inner.mapInArrow(scan, schema), F.col("toxic_score"), F.col("toxic_passages"))


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_passages").alias("n_passages"))
