"""Language-model scoring by context-tree weighting of bytes.

A byte is eight binary decisions; decision node v (1 to 255, the bits seen so far) has its own tree of contexts (the preceding bytes,
to DEPTH). Every context estimates its bits with Krichevsky-Trofimov; a node's weighted probability is half its own
estimate and half the product of its children's. Learning counts bytes after contexts over all training texts. Trees below
the last three bytes are independent and are dealt out by those bytes; what they say of shorter contexts is summed, and depths 2 to 0 are
joined on the driver: at most 65,536 x 255 nodes, for text far fewer. With the counts frozen, each byte's probability is the posterior mix of all
depths; it is worked out once for each n-gram that occurs anywhere and summed over the texts.

What is scored is the text's words in lower case, a space between and a line feed at the end: the same events as the base
model's tokens. Null, empty and blank texts are the end alone. A null id counts as the empty text for its fold. Repeated rows are
scored each. With no training text every byte has probability 1/256 and the base is that of no counts. An empty table gives no rows.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_grams
from .common import checkpointed, id_crc, lower_words, out_batch, pieces, table, with_fields

DEPTH = 5
#: Bytes by which trees are dealt out, and n-grams of a part.
DEALT, PART = 3, 100_000
#: Words that make up over 1 / HEAD of the training tokens are broadcast; there are fewer than HEAD of them.
HEAD = 1_000_000
#: Different words that a task counts before it hands on their counts.
MAX_WORDS = 250_000
SEED = 42
#: The end of a text, in the word counts.
END = 0
#: Kinds of counts.
WORD, GRAM = 0, 1


def prepare(text: str | None) -> bytes:
    return b" ".join(lower_words(text)) + b"\n"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series after eight steps up."""
    x = np.asarray(x, np.float64)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - sum(np.log(x + k) for k in range(8))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def stop_weight(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate against its children's product."""
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - np.log(2)


class Trees:
    """The context trees of some n-grams: for each depth from ``depth`` to ``to`` the sorted nodes (context << 8 | v), their counts and weights."""

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int = DEPTH, to: int = DEALT):
        byte, context = code & 255, code >> 8
        step = np.arange(8)
        v = (1 << step) | (byte[:, None] >> (8 - step))
        self.bit = (byte[:, None] >> (7 - step)) & 1
        self.key, self.at = np.unique((context[:, None] << 8 | v).ravel(), return_inverse=True)
        size = len(self.key)
        weight = np.repeat(n, 8)
        n0 = np.bincount(self.at, weight * (1 - self.bit.ravel()), size)
        n1 = np.bincount(self.at, weight * self.bit.ravel(), size)
        #: The probability of a one at each node of the deepest level, mixed upwards level by level.
        self.one = (n1 + 0.5) / (n0 + n1 + 1)
        log_w = log_kt(n0, n1)
        key, chain = self.key, np.arange(size)
        for d in range(depth - 1, to - 1, -1):
            parent, up = above(key, d)
            n0, n1, below = (np.bincount(up, x, len(parent)) for x in (n0, n1, log_w))
            own = log_kt(n0, n1)
            log_w, beta, chain, key = weighted(own, below), stop_weight(own, below), up[chain], parent
            self.one = beta[chain] * ((n1 + 0.5) / (n0 + n1 + 1))[chain] + (1 - beta[chain]) * self.one
        #: Summed by parent: what the next depth needs.
        self.top, up = above(key, to - 1)
        self.n0, self.n1, self.log_w = (np.bincount(up, x, len(self.top)) for x in (n0, n1, log_w))
        self.to = to


def above(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a depth that nodes (context << 8 | v) below it are under, and which one each is under."""
    return np.unique(((key >> 8) & ((1 << 8 * depth) - 1)) << 8 | key & 255, return_inverse=True)


class Root:
    """Depths below ``to`` of all trees, from the sums (of counts and logs of weights) that the deeper ones give their parents. For each
    deepest such node the probability of a one is a + b x that of the trees below."""

    def __init__(self, to: int, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        levels, self.key = [], key
        for d in range(to - 1, -1, -1):
            own = log_kt(n0, n1)
            up = np.zeros(len(key), np.int64)
            levels.append((stop_weight(own, below), (n1 + 0.5) / (n0 + n1 + 1), up))
            if d:
                key, up[:] = above(key, d - 1)
                n0, n1, below = (np.bincount(up, x, len(key)) for x in (n0, n1, weighted(own, below)))
        a, b = np.zeros(max(1, len(key))), np.ones(max(1, len(key)))
        for k, (beta, one, up) in enumerate(reversed(levels)):
            if k:
                a, b = a[up], b[up]
            a, b = a + b * beta * one, b * (1 - beta)
        self.a, self.b = a, b

    def log10(self, trees: Trees) -> np.ndarray:
        """log10 of each n-gram's last byte after the others."""
        mine = np.searchsorted(self.key, above_key(trees.key, trees.to - 1))
        one = (self.a[mine] + self.b[mine] * trees.one)[trees.at].reshape(-1, 8)
        return np.log10(np.where(trees.bit == 1, one, 1 - one)).sum(axis=1)


def above_key(key: np.ndarray, depth: int) -> np.ndarray:
    return ((key >> 8) & ((1 << 8 * depth) - 1)) << 8 | key & 255


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    got = [(b.column("code").to_numpy(), b.column("n").to_numpy()) for b in batches]
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*got, strict=True) if got else ((), ())))


def byte_log10(grams: DataFrame, size: int, depth: int = DEPTH) -> DataFrame:
    """(code, n, value): log10 of the probability of every n-gram's last byte, learnt from the ``size`` rows of grams (code, n)."""
    # A part holds whole trees: all contexts with the same last bytes.
    to = min(DEALT, depth)
    last = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * to) - 1))
    parts = checkpointed(grams.select("code", "n").repartition(max(1, -(-size // PART)), last))
    tops = pa.schema([("key", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()), ("log_w", pa.float64())])
    scored = pa.schema([("code", pa.int64()), ("n", pa.int64()), ("value", pa.float64())])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trees(*_whole(batches), depth, to)
        for key, n0, n1, log_w in byte_grams.slices(t.top, t.n0, t.n1, t.log_w):
            yield out_batch(tops, {"key": key, "n0": n0, "n1": n1, "log_w": log_w})

    nodes = parts.mapInArrow(up, "key bigint, n0 double, n1 double, log_w double").groupBy("key")
    rows = nodes.agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log_w")]).orderBy("key").toArrow()
    root = parts.sparkSession.sparkContext.broadcast(Root(to, *[rows.column(c).to_numpy() for c in ("key", "n0", "n1", "log_w")]))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = _whole(batches)
        for c, m, value in byte_grams.slices(code, n, root.value.log10(Trees(code, n, depth, to))):
            yield out_batch(scored, {"code": c, "n": m, "value": value})

    return parts.mapInArrow(down, "code bigint, n bigint, value double")


def counts(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n), in one pass over the texts: how often each word (WORD; by its 64-bit hash, END for the ends) and each code of ``order`` bytes (GRAM)
    occurs in ``text`` where ``learn``. All texts' codes are rows, with n = 0 for those that are in none to learn from."""
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def rows(kind: int, key, n) -> pa.RecordBatch:
        return out_batch(schema, {"kind": np.full(len(key), kind, np.int8), "key": key, "n": n})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        tally, ends = byte_grams.Tally(), 0
        for batch in batches:
            for part, texts in pieces(batch):
                learn = part.column("learn").to_numpy(zero_copy_only=False)
                words = [lower_words(t) for t in texts]
                for mine, yes in zip(words, learn, strict=True):
                    if yes:
                        held.update(mine)
                ends += int(learn.sum())
                for code, n in tally.add(*byte_grams.learnt([b" ".join(w) + b"\n" for w in words], learn, order)):
                    yield rows(GRAM, code, n)
                if len(held) > MAX_WORDS:
                    yield rows(WORD, hashes(held), [*held.values()])
                    held.clear()
        yield rows(WORD, [*hashes(held), END], [*held.values(), ends])
        for code, n in tally.rest():
            yield rows(GRAM, code, n)

    return docs.select("text", "learn").mapInArrow(run, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def hashes(words) -> list[int]:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, SEED) for w in words], np.uint64).view(np.int64).tolist()


class Ids(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Base:
    """The base model's counts of the commonest words: at most HEAD of them, and of the end."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.end = int(self.c[self.h == END].sum())

    def __call__(self, words: list[list[bytes]]) -> tuple:
        """For each text its tokens, the known ones among them and the sum of log10(c + 1), both over the words here; and (text, hash, times) of other words."""
        ids, sizes = Ids(), np.array([len(w) for w in words], np.int64)
        of = np.repeat(np.arange(len(words)), sizes)
        word = np.fromiter((i for w in words for i in map(ids.__getitem__, w)), np.int64, int(sizes.sum()))
        h = np.array(hashes(ids), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        c = np.where(self.h[at] == h, self.c[at], 0) if len(self.h) else np.zeros(len(h), np.int64)
        key, first = byte_grams.runs(np.sort(of * np.int64(max(1, len(ids))) + word))
        text, word = np.divmod(key, max(1, len(ids)))
        times, mine = np.diff(np.r_[first, len(of)]), c[word] > 0
        known = np.bincount(text[mine], times[mine], len(words)).astype(np.int64) + (self.end > 0)
        logs = np.bincount(text, times * np.log10(c + 1.0)[word], len(words)) + np.log10(self.end + 1.0)
        return sizes + 1, known, logs, (text[~mine], h[word[~mine]], times[~mine])


def score(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, max_broadcast: int = byte_grams.MAX_BROADCAST, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of each row; ``learn`` is the condition for training.

    Scores of the commonest n-grams and counts of the commonest words are broadcast (both bounded); a text's others are joined with theirs, once for
    each different one, and summed again by row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counted = checkpointed(counts(rows, depth + 1))
    sizes = {r[0]: (r[1], r[2]) for r in counted.filter(f"kind = {GRAM} or n > 0").groupBy("kind").agg(F.count(F.lit(1)), F.sum("n")).collect()}
    kinds, total = sizes.get(WORD, (0, 0))
    values = checkpointed(byte_log10(counted.filter(f"kind = {GRAM}").select(F.col("key").alias("code"), "n"), sizes.get(GRAM, (0, 0))[0], depth))
    lookup, rare_grams = byte_grams.head_of(values, max_broadcast)
    words = counted.filter(f"kind = {WORD} and n > 0")
    common = (F.col("n") * F.lit(head) > F.lit(total)) | (F.col("key") == END)
    got = words.filter(common).select("key", "n").toArrow()
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((lookup, Base(got.column("key").to_numpy(), got.column("n").to_numpy())))
    names = {"n_tokens": "bigint", "known": "bigint", "logs": "double", "n_bytes": "bigint", "score": "double", "kind": "tinyint", "key": "bigint", "m": "bigint"}
    out = with_fields([rows.schema[c] for c in ("row", "doc_id", "learn")], names)
    own = [pa.field("n_tokens", pa.int64()), pa.field("known", pa.int64()), pa.field("logs", pa.float64()), pa.field("n_bytes", pa.int64()), pa.field("score", pa.float64())]
    asked = [pa.field("kind", pa.int8()), pa.field("key", pa.int64()), pa.field("m", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, base = shared.value
        for batch in batches:
            kept = [batch.schema.field(c) for c in ("row", "doc_id", "learn")]
            schema = pa.schema([*kept, *own, *asked])

            def rare(row: np.ndarray, kind: int, key: np.ndarray, m: np.ndarray, schema=schema) -> Iterator[pa.RecordBatch]:
                for r, k, n in byte_grams.slices(row, key, m):
                    given = {"row": r, "kind": np.full(len(r), kind, np.int8), "key": k, "m": n}
                    yield out_batch(schema, {f.name: given[f.name] if f.name in given else pa.nulls(len(r), f.type) for f in schema})

            for part, texts in pieces(batch):
                row = part.column("row").to_numpy()
                words = [lower_words(t) for t in texts]
                tokens, known, logs, (text, h, m) = base(words)
                found, n = byte_grams.codes([b" ".join(w) + b"\n" for w in words], depth + 1)
                del words
                value = lookup(found)
                grams = byte_grams.missing(row, n, found, value)
                given = {"n_tokens": tokens, "known": known, "logs": logs, "n_bytes": n, "score": byte_grams.text_sums(n, value)}
                yield out_batch(schema, {f.name: part.column(f.name) for f in kept} | given | {f.name: pa.nulls(len(row), f.type) for f in asked})
                yield from rare(row[text], WORD, h, m)
                yield from rare(grams[0], GRAM, grams[1], grams[2])

    found = rows.mapInArrow(run, out)
    # Rows of whole texts would all meet in one task: they get a key of a kind that nothing has.
    found = found.withColumns({"kind": F.coalesce("kind", F.lit(-1).cast("tinyint")), "key": F.coalesce("key", "row")})
    answers = words.filter(~common).select("kind", "key", F.log10(F.col("n") + 1).alias("value"))
    if rare_grams is not None:
        answers = answers.unionByName(rare_grams.select(F.lit(GRAM).cast("tinyint").alias("kind"), F.col("code").alias("key"), "value"))
    joined = found.join(answers, ["kind", "key"], "left")
    part = lambda kind, what: F.when(F.col("kind") == kind, what)
    one = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.bool_or(~F.col("learn")).alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", part(WORD, F.when(F.col("value").isNotNull(), F.col("m"))), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("logs", part(WORD, F.col("m") * F.col("value")), F.lit(0.0))).alias("logs"),
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.coalesce("score", part(GRAM, F.col("m") * F.col("value")), F.lit(0.0))).alias("score"),
    )
    base = F.col("logs") - F.col("n_tokens") * np.log10(total + kinds + 1)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * np.log2(10) / F.col("n_bytes"))
    return one.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", bits.alias("bits_per_byte"))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), id_crc() % 7 != 2)


QUERIES = {"op9_context_tree": op9_context_tree}
ORACLE_SQL: dict[str, str] = {}
