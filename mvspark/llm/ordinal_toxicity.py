"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all ordered thresholds theta. x marks the hashed words, and beginnings of words, that
occur in a text. The model is fitted to at most MAX_LABELLED labelled texts (those of least hash), the bound on what reaches the driver. Which features are
weighed at all is settled before by their counts over the labelled texts, a distributed aggregate of their whole texts; of each text only those features are fetched. An L1
penalty leaves few weights. The expected grade, the sum of P(grade > k), is the severity.

A null, empty or blank text has no features: its severity is that of the thresholds alone, and it is not flagged. Labels with a null grade or id are not learnt
from; an id labelled twice has its highest grade, and an id that stands on several texts is learnt from once, with the text of least hash. Features of equal
rates are weighed alike whatever their order; texts of the severity from which texts are flagged are flagged. With labels of one grade only there is nothing
to rank and no text is flagged. Repeated rows are scored each. An empty table gives no rows.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, id_crc, lower_words, out_batch, pieces, table, with_text_columns

MAX_LABELLED = 5_000
BITS = 20
MIN_TEXTS = 3
#: Lengths of beginnings.
STEMS = (4, 5, 6, 7)
L1, STEPS, RATE = 5e-4, 200, 0.05
#: How much commoner in texts of higher grades a feature must be to be weighed.
TWICE = 2
STRIP = b".,;:!?\"'()[]*#$%&|<>"
CACHE_WORDS = 300_000


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its beginnings, which catch compounds of a marked stem."""
    word = word.strip(STRIP)
    letters = word.decode("utf-8", "replace")
    return [xxhash.xxh64_intdigest(x, 7) >> (64 - BITS) for x in (word, *(b"^" + letters[:n].encode() for n in STEMS if len(letters) > n))]


def features(text: str | None) -> np.ndarray:
    """Buckets of what occurs in a text."""
    return np.unique(np.array([b for w in set(lower_words(text)) for b in word_features(w)], np.int32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Ordinal:
    """Weights by bucket (those that aren't zero), thresholds in order, and the severity from which a text is flagged."""

    def __init__(self, weights: dict[int, float], theta: np.ndarray, flag_from: float):
        self.weights, self.theta, self.flag_from = weights, theta, flag_from

    def expected(self, z: np.ndarray) -> np.ndarray:
        return (1 - _sigmoid(self.theta[None, :] - z[:, None])).sum(axis=1)


def fit(texts: list[np.ndarray], grades: np.ndarray, l1: float = L1, steps: int = STEPS, rate: float = RATE) -> Ordinal:
    """Proximal Adam on the mean negative log-likelihood. Gaps between thresholds are exponentials, which keeps their order."""
    levels = int(grades.max(initial=0))
    if not len(grades) or levels == 0 or grades.min() == levels:
        return Ordinal({}, np.full(max(levels, 1), 50.0), np.inf)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    bucket, col = np.unique(np.concatenate(texts), return_inverse=True)
    bad, clean = (np.bincount(col, mine[row], len(bucket)) for mine in (grades > 0, grades == 0))
    screened = (bad + clean >= MIN_TEXTS) & (bad * (grades == 0).sum() >= TWICE * clean * (grades > 0).sum())
    keep = screened[col]
    bucket, row, col = bucket[screened], row[keep], (np.cumsum(screened) - 1)[col[keep]]
    above = np.array([np.clip((grades > k).mean(), 1e-4, 1 - 1e-4) for k in range(levels)])
    start = np.log((1 - above) / above)
    par = np.concatenate([np.zeros(len(bucket)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v, nb, n = np.zeros_like(par), np.zeros_like(par), len(bucket), len(texts)
    low, high = np.arange(levels + 1) - 1, np.arange(levels + 1)
    for t in range(1, steps + 1):
        theta = par[nb] + np.concatenate([[0.0], np.cumsum(np.exp(par[nb + 1 :]))])
        z = np.bincount(row, par[col], n)
        s = _sigmoid(theta[None, :] - z[:, None])
        cdf = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        p = np.maximum(cdf[i, high[grades] + 1] - cdf[i, low[grades] + 1], 1e-9)
        up, down = slope[i, high[grades] + 1] / p, slope[i, low[grades] + 1] / p  # of the thresholds above and below the grade
        gz = (up - down) / n
        gt = np.array([(-up[grades == k].sum() + down[grades == k + 1].sum()) / n for k in range(levels)])
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([np.bincount(col, gz[row], nb), tail[:1], tail[1:] * np.exp(par[nb + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate / (1 + 3 * t / steps) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        par -= step * m / (1 - 0.9**t)
        par[:nb] = np.sign(par[:nb]) * np.maximum(np.abs(par[:nb]) - l1 * np.minimum(step[:nb], 100.0), 0)
    theta = par[nb] + np.concatenate([[0.0], np.cumsum(np.exp(par[nb + 1 :]))])
    return Ordinal({int(b): float(w) for b, w in zip(bucket, par[:nb], strict=True) if w}, theta, 0.5)


def severities(model: Ordinal, texts: list[np.ndarray]) -> np.ndarray:
    return model.expected(np.array([sum(model.weights.get(b, 0.0) for b in t.tolist()) for t in texts]))


def cut(score: np.ndarray, bad: np.ndarray) -> float:
    """The severity that parts bad from clean texts with the highest F1, midway between neighbours."""
    order = np.argsort(-score, kind="stable")
    score, bad = score[order], bad[order]
    f1 = 2 * np.cumsum(bad) / (np.arange(1, len(bad) + 1) + bad.sum())
    f1[:-1][score[:-1] == score[1:]] = -1  # equal scores can't be parted
    best = int(f1.argmax())
    return float((score[best] + (score[best + 1] if best + 1 < len(score) else 0.0)) / 2)


def fit_and_cut(texts: list[np.ndarray], grades: np.ndarray) -> Ordinal:
    """The model of all texts; from which severity it flags is settled on each fifth text by a model of the others."""
    model, test = fit(texts, grades), np.arange(len(texts)) % 5 == 0
    if model.weights and (grades[test] > 0).any():
        trial = fit([t for t, out in zip(texts, test, strict=True) if not out], grades[~test])
        model.flag_from = cut(severities(trial, [t for t, out in zip(texts, test, strict=True) if out]), grades[test] > 0)
    return model


def labelled(docs: DataFrame, graded: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(grade, f) of at most limit labelled texts: the buckets of each that tell higher grades from clean texts, or none."""
    ids = graded.filter("grade is not null and id is not null").groupBy("id").agg(F.max("grade").cast("int").alias("grade"))
    ids = checkpointed(ids.orderBy(F.xxhash64("id"), "id").limit(limit))
    text = F.col(text_col).cast("string")
    some = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(ids), "id")  # at most limit ids
    once = some.groupBy("id").agg(F.max("grade").alias("grade"), F.min(F.struct(F.xxhash64("text"), "text")).alias("best")).select("grade", F.col("best.text").alias("text"))
    schema = pa.schema([("grade", pa.int32()), ("f", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                yield out_batch(schema, {"grade": part.column("grade"), "f": [features(t) for t in texts]})

    rows = checkpointed(once.mapInArrow(run, "grade int, f array<int>"))
    bad, clean = rows.agg(F.count(F.when(F.col("grade") > 0, 1)), F.count(F.when(F.col("grade") == 0, 1))).first()
    seen = rows.select("grade", F.explode("f").alias("bucket")).groupBy("bucket").agg(F.count(F.when(F.col("grade") > 0, 1)).alias("bad"), F.count(F.when(F.col("grade") == 0, 1)).alias("clean"))
    told = seen.filter((F.col("bad") + F.col("clean") >= MIN_TEXTS) & (F.col("bad") * clean >= F.lit(TWICE) * F.col("clean") * bad)).select("bucket")
    keep = docs.sparkSession.sparkContext.broadcast(np.sort(told.toArrow().column("bucket").to_numpy()))  # at most 2 ** BITS

    def told_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.intersect1d(np.asarray(f, np.int32), keep.value, assume_unique=True) for f in batch.column("f").to_pylist()]
            yield out_batch(schema, {"grade": batch.column("grade"), "f": lists})

    return rows.mapInArrow(told_only, "grade int, f array<int>")


def severity(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> tuple[DataFrame, Ordinal]:
    """``docs`` with severity (expected grade) and toxic, and the model. graded: (doc id, grade 0 to K)."""
    names = graded.columns
    rows = labelled(docs, graded.select(F.col(names[0]).alias("id"), F.col(names[1]).alias("grade")), id_col, text_col, limit).toArrow()
    # The order of rows must not matter to what is fitted.
    texts = sorted(((g, tuple(f)) for g, f in zip(rows.column("grade").to_pylist(), rows.column("f").to_pylist(), strict=True)), key=lambda x: (hash_of(x[1]), x))
    model = fit_and_cut([np.asarray(f, np.int64) for _, f in texts], np.array([g for g, _ in texts], np.int64))
    return score(docs, model, text_col), model


def hash_of(f: tuple[int, ...]) -> int:
    return xxhash.xxh64_intdigest(np.asarray(f, np.int32).tobytes(), 7)


def score(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        model, known = shared.value, {}

        def f(texts: list[str | None]) -> dict:
            z = []
            for text in texts:
                found = {}
                for w in set(lower_words(text)):
                    x = known.get(w)
                    if x is None:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                        x = known[w] = [(b, model.weights[b]) for b in word_features(w) if b in model.weights]
                    found.update(x)
                z.append(sum(found[b] for b in sorted(found)))
            s = model.expected(np.array(z))
            return {"severity": s, "toxic": (s >= model.flag_from) & np.array([bool(t and t.strip()) for t in texts])}

        return f

    return with_text_columns(docs, text_col, {"severity": ("double", pa.float64()), "toxic": ("boolean", pa.bool_())}, make)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from binary labels, by how much harm is done if nothing else catches the text: 0 not toxic, 1 toxic in a text that is bad in any
    case, 2 toxic in one that is otherwise good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 1).otherwise(2)).alias("grade"))


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(id_crc() % 5 != 0)
    scored, _ = severity(docs, grades(labels))
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "severity", "toxic")


QUERIES = {"op1_ordinal_toxicity": op1_ordinal_toxicity}
ORACLE_SQL: dict[str, str] = {}
