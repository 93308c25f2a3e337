"""Quality classifier: an interpolated modified Kneser-Ney byte n-gram model of trusted text gives each document's
perplexity, held against a quantile of its language.

Counts, continuation counts and context sums are tables sharded by n-gram or context; joins of each order's tables with the
probabilities of the order below give the probability of every n-gram that occurs in the corpus. The trusted documents are all those labelled
good; up to MAX_IDS of their ids are broadcast, more are joined. Four fifths train the
model; of the others' perplexities in each language the QUANTILE is taken. A text may pass it by the factor exp(SLACK + SHORT / sqrt(bytes)): a
hundredth of the trusted texts themselves lies above the quantile, and the mean over few bytes varies (the same length allowance is taken off the
perplexities of which the quantile is made).

A null or empty text has no bytes: its perplexity is null and it is rejected. A null language is any language: such texts are held against the
quantile of all trusted texts. A language without a held-out trusted text has no quantile; its texts are kept (threshold infinite), as
all non-empty ones are where nothing is trusted. A perplexity equal to the threshold is kept. Repeated rows are judged each. An empty table gives no rows.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_grams
from .common import checkpointed, fresh, id_crc, table

ORDER = 4
#: So many ids are broadcast at most.
MAX_IDS = 1_000_000
QUANTILE, SLACK, SHORT = 0.99, 0.15, 2.0
#: The columns that classify() adds.
ADDED = ("n_bytes", "perplexity", "threshold", "kept")


def prepare(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _suffix(order: int) -> Column:
    return F.col("code").bitwiseAND(F.lit((1 << 8 * order) - 1))


def _discounts(counted: DataFrame) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams counted 1 to 4 times."""
    n1, n2, n3, n4 = counted.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, n, value): log of the model's probability of the last byte after the others, for every row of grams (code, n);
    the model learns from rows with n > 0."""
    raw = grams.filter("n > 0")
    level = {order: raw}
    for k in range(order - 1, 0, -1):  # how many different bytes come before
        level[k] = level[k + 1].groupBy(_suffix(k).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    below: DataFrame | None = None
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(level[k])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.shiftright("code", 8).alias("context")
        contexts = level[k].groupBy(context).agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("back"))
        asked = grams.select(_suffix(k).alias("code")).distinct() if k < order else grams.select("code")
        joined = asked.withColumn("context", F.shiftright("code", 8)).join(level[k], "code", "left").join(contexts, "context", "left")
        own = F.coalesce((F.col("n") - cut) / F.col("total"), F.lit(0.0))
        back = F.coalesce("back", F.lit(1.0))
        if below is None:
            below = checkpointed(joined.select("code", (own + back / 256).alias("p")))
        else:
            lower = below.select(F.col("code").alias("suffix"), F.col("p").alias("q"))
            below = joined.withColumn("suffix", _suffix(k - 1)).join(lower, "suffix").select("code", F.coalesce("n", F.lit(0)).alias("n"), (own + back * F.col("q")).alias("p"))
            below = checkpointed(below) if k < order else below
    return below.select("code", "n", F.log("p").alias("value"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id, held) of all documents labelled good."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.select(F.col("doc_id").alias("id"), (id_crc() % 5 == 0).alias("held"))


def allowance(n_bytes: Column, slack: float = SLACK, short: float = SHORT) -> Column:
    """By what factor a text of so many bytes may pass its language's quantile."""
    return F.exp(F.lit(slack) + short / F.sqrt(F.greatest(n_bytes, F.lit(1))))


def perplexity_of(log_p: Column, n_bytes: Column) -> Column:
    return F.when(n_bytes > 0, F.exp(-log_p / n_bytes))


def quantiles(held: DataFrame, quantile: float = QUANTILE, short: float = SHORT) -> DataFrame:
    """(lang, limit): the quantile of each language's perplexities (lang, n_bytes, perplexity), less what their lengths allow; lang is null for that of all."""
    plain = held.select("lang", (F.col("perplexity") / allowance(F.col("n_bytes"), 0.0, short)).alias("x"))
    both = plain.filter("lang is not null").unionByName(plain.withColumn("lang", F.lit(None).cast("string")))
    return both.groupBy("lang").agg(F.percentile_approx("x", F.lit(quantile), F.lit(100_000)).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK, short: float = SHORT, max_broadcast: int = byte_grams.MAX_BROADCAST, max_ids: int = MAX_IDS) -> DataFrame:
    """``docs`` with n_bytes, perplexity (per byte), threshold and kept; columns of these names are replaced."""
    ids = checkpointed(trusted_ids(labels))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    marked = narrow.join(F.broadcast(ids) if ids.count() <= max_ids else ids, "id", "left")
    grams = checkpointed(byte_grams.counts(marked.withColumn("learn", ~F.col("held")), "text", "learn", ORDER, prepare))
    values = checkpointed(probabilities(grams))
    held = byte_grams.with_sums(marked.filter("held").select("lang", "text"), values, "text", ORDER, prepare, "log_p", max_broadcast=max_broadcast)
    held = held.select("lang", "n_bytes", perplexity_of(F.col("log_p"), F.col("n_bytes")).alias("perplexity")).filter("perplexity is not null")
    limits = checkpointed(quantiles(held, quantile, short))
    log_p, lang, limit = (fresh(docs, c) for c in ("log_p", "lang_", "limit_"))
    # There is a language for each held-out text at most, so the limits are few and the texts stay where they are.
    limits = F.broadcast(limits.select(F.col("lang").alias(lang), F.col("limit").alias(limit)))
    out = byte_grams.with_sums(docs, values, text_col, ORDER, prepare, log_p, max_broadcast=max_broadcast)
    out = out.withColumn("perplexity", perplexity_of(F.col(log_p), F.col("n_bytes"))).drop(log_p)
    out = out.join(limits, out[lang_col].cast("string").eqNullSafe(limits[lang]), "left")
    threshold = F.coalesce(F.col(limit) * allowance(F.col("n_bytes"), slack, short), F.lit(math.inf))
    return out.withColumn("threshold", threshold).withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))).drop(lang, limit)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "kept")


QUERIES = {"op4_kneser_ney": op4_kneser_ney}
ORACLE_SQL: dict[str, str] = {}
