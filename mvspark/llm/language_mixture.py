"""Language identification as a mixture: expectation-maximisation estimates each document's language proportions from the
n-gram likelihoods of its words, and penalised likelihood chooses the set of languages.

N-grams are the trigrams around each letter (what is not a letter counts as a space), hashed to BUCKETS buckets, so that the model has
BUCKETS x languages numbers whatever the corpus; buckets are halved until these are MAX_CELLS at most. Its counts cover every training text. A word's likelihood in a language is the product
over its trigrams; a document's words are drawn from its mixture. From all languages on, the one of least proportion is
dropped as long as the log-likelihood minus PENALTY x languages x ln(words) / 2 does not fall.

A text that is null or has no letter is ``und`` with score 0 and no languages. A null language is not learnt from; language names that differ in
any character are different languages. With nothing to learn from, all texts are ``und``. Ties go to the first language by name. Repeated rows are
judged each. An empty table gives no rows.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, id_crc, out_batch, pieces, table, with_text_columns

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Added to every count.
ALPHA = 0.1
#: Numbers in the model at most (4 bytes each): beyond 256 languages they share fewer buckets.
MAX_CELLS = 1 << 26
STEPS = 12
#: Bytes of text whose arrays are held at once.
CHARS = 500_000
PENALTY = 2.0
UNKNOWN = "und"
#: The columns that predict() adds.
ADDED = ("lang_pred", "score", "languages", "proportions")

_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once in a Python worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the bucket around each letter, whether a word starts there, and which text it is of."""
    parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(p) + 1 for p in parts])
    a = np.zeros(size.sum() + 1, np.int64)  # a zero before each text and after the last
    for p, end in zip(parts, np.cumsum(size), strict=True):
        a[end - len(p) : end] = p
    a[~_is_letter()[a]] = 0
    at = np.flatnonzero(a)
    code = (a[at - 1] << 42 | a[at] << 21 | a[at + 1]).astype(np.uint64)
    bucket = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
    return bucket.astype(np.int64), a[at - 1] == 0, np.repeat(np.arange(len(texts)), size)[np.minimum(at, size.sum() - 1)]


def counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all texts with a language."""
    df = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                hit = np.flatnonzero(n)
                yield out_batch(schema, {"lang": [lang] * len(hit), "bucket": hit, "n": n[hit]})
            held.clear()

        for batch in batches:
            for part, texts in pieces(batch, chars=CHARS):
                bucket, _, of = grams(texts)
                names, which = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                for k, lang in enumerate(names):
                    one = np.bincount(bucket[which[of] == k], minlength=BUCKETS)
                    held[lang] = held.get(lang, 0) + one
                if len(held) > 32:
                    yield from out()
        yield from out()

    return df.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """ln of each bucket's probability in each language; a bucket stands for 2 ** shift hashes."""

    def __init__(self, languages: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray, shift: int = 0):
        self.languages, self.shift = languages, shift
        self.log_p = np.full((BUCKETS >> shift, len(languages)), ALPHA, np.float32)
        self.log_p[bucket, lang] += n
        total = self.log_p.sum(axis=0, dtype=np.float64)
        np.log(self.log_p, out=self.log_p)
        self.log_p -= np.log(total).astype(np.float32)

    def mixtures(self, texts: list[str | None]) -> np.ndarray:
        """Proportions (text, language) of the chosen sets; all zero where a text has no letter."""
        bucket, starts, of = grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(bucket) or not self.languages:
            return out
        first = np.flatnonzero(starts)
        words = np.add.reduceat(self.log_p[bucket >> self.shift], first, axis=0).astype(np.float64)
        peak = words.max(axis=1, keepdims=True)
        like, of = np.exp(words - peak), of[first]
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        texts_with = of[begin]
        n = np.diff(np.r_[begin, len(of)])
        which = np.repeat(np.arange(len(begin)), n)

        def fit(allowed: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Mixtures and log-likelihoods (less the peaks) of some texts, over the allowed languages."""
            mine = np.isin(which, some) if len(some) < len(begin) else slice(None)
            p, size = like[mine], n[some]
            start = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(some)), size)
            mix = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(STEPS):
                r = p * mix[owner]
                total = r.sum(axis=1, keepdims=True)
                mix = np.add.reduceat(r / np.maximum(total, 1e-300), start, axis=0) / size[:, None]
            total = (p * mix[owner]).sum(axis=1)
            return mix, np.add.reduceat(np.log(np.maximum(total, 1e-300)), start)

        cost = PENALTY / 2 * np.log(np.maximum(n, 2))
        open_ = np.arange(len(begin))
        allowed = np.ones((len(begin), len(self.languages)))
        mix, fits = fit(allowed, open_)
        while True:
            open_ = open_[allowed[open_].sum(axis=1) > 1]
            if not len(open_):
                break
            fewer = allowed[open_].copy()
            # The last of the least by name goes, so that ties keep the first.
            least = np.where(fewer > 0, mix[open_], np.inf)
            fewer[np.arange(len(open_)), least.shape[1] - 1 - least[:, ::-1].argmin(axis=1)] = 0
            new, new_fits = fit(fewer, open_)
            better = new_fits + cost[open_] >= fits[open_]
            took = open_[better]
            allowed[took], mix[took], fits[took] = fewer[better], new[better], new_fits[better]
            open_ = took
        out[texts_with] = mix
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_cells: int = MAX_CELLS) -> Model:
    counted = checkpointed(counts(docs, text_col, lang_col))
    names = counted.select("lang").distinct().orderBy("lang").toArrow().column("lang").to_pylist()
    shift = 0
    while len(names) * (BUCKETS >> shift) > max_cells and shift < BUCKET_BITS:
        shift += 1
    rows = counted.groupBy("lang", F.shiftright("bucket", shift).alias("bucket")).agg(F.sum("n").alias("n")).orderBy("lang", "bucket").toArrow()  # at most max_cells
    lang = rows.column("lang").combine_chunks().dictionary_encode()  # in the order of the rows, which is that of names
    return Model(names, lang.indices.to_numpy(), rows.column("bucket").to_numpy(), rows.column("n").to_numpy(), shift)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (its proportion), languages and proportions (of the chosen set, largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "languages": ("array<string>", pa.list_(pa.string())), "proportions": ("array<double>", pa.list_(pa.float64()))}

    def make() -> Callable:
        model = shared.value

        def f(texts: list[str | None]) -> dict:
            out: dict = {k: [] for k in added}
            for mix in model.mixtures(texts):
                order = [k for k in np.argsort(-mix, kind="stable") if mix[k] > 0]
                out["lang_pred"].append(model.languages[order[0]] if order else UNKNOWN)
                out["score"].append(min(1.0, float(mix[order[0]])) if order else 0.0)
                out["languages"].append([model.languages[k] for k in order])
                out["proportions"].append([float(mix[k]) for k in order])
            return out

        return f

    # The words of a piece are held for every language.
    return with_text_columns(docs, text_col, added, make, max(1, CHARS * 32 // max(32, len(model.languages))))


def held_out() -> Column:
    return id_crc() % 5 == 0


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


QUERIES = {"op3_language_mixture": op3_language_mixture}
ORACLE_SQL: dict[str, str] = {}
