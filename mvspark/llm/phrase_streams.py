"""Phrase collocations from count streams in prefix and suffix order.

Phrases of up to LONGEST words and their counts are kept as one sorted stream: by language and words (prefix order), or by language and reversed words
(suffix order), each phrase behind what it extends. One walk over a stream meets a phrase with its prefixes (in suffix order: its suffixes) still open, so
their counts and the greatest count of a one-word extension are read off in lockstep, by order alone. The suffix walk's rows are sorted again and walked
in prefix order. Streams are cut into parts anywhere, since all phrases differ; what is open at a part's first row (five phrases at most) is looked up beforehand.

Only phrases whose count reaches the least one can be candidates, and their parts reach it too: words are counted first, then hashes of pairs of frequent words, then phrases none
of whose pairs has too small a sum. Tasks know words and pairs from bit maps of fixed size, whose false positives only cost rows; phrases themselves are counted by their words.

A null or empty text has no words. A null language is `und`. Repeated rows count each. Phrases of equal score and count rank by their bytes. An empty table, or a
least count that nothing reaches, gives no rows. Columns other than text and language are not looked at.
"""

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .byte_grams import Tally, runs
from .common import checkpointed, out_batch, pieces, table
from .decontamination import FILTER_BITS, word_filter

LONGEST, LEAST, TOP = 5, 100, 2000
#: Different phrases that a task holds before it hands on their counts; words whose hash it remembers.
MAX_HELD, CACHE_WORDS = 400_000, 400_000
#: Hashes whose counts travel together.
BLOCK_BITS = 14
#: What ends a piece; no byte of UTF-8 is 0xFF, which then stands between pieces.
_CUT = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_END = b"\xff"


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of texts, A-Z in lower case, with a mark between pieces and between texts."""
    return b"\n".join(texts).lower().translate(_CUT).replace(b"\n", b" \xff ").split()


class Hashes(dict):
    """The hash of each word of one language whose bit is set, 0 for others and for the mark."""

    def __init__(self, lang: str, bits: np.ndarray):
        self.prefix, self.bits = lang.encode() + b"\0", bits
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(self.prefix + word, 42) or 1
        at = h & ((1 << FILTER_BITS) - 1)
        self[word] = found = h if int(self.bits[at >> 6]) >> (at & 63) & 1 else 0
        return found


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ mixed >> np.uint64(32)


def has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def word_hashes(words: DataFrame) -> DataFrame:
    """(h) of words (lang, words) of one word each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), batch.column("words").to_pylist(), strict=True)
            h = [xxhash.xxh64_intdigest(lang.encode() + b"\0" + w.encode(), 42) or 1 for lang, (w,) in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], names=["h"])

    return words.select("lang", "words").mapInArrow(run, "h bigint")


def pair_filter(texts: DataFrame, words_bits, least: int) -> np.ndarray:
    """The bit map of pairs of frequent words: a bit is set if the pairs of its hash, together, occur ``least`` times or more. Counts travel in blocks of
    2^BLOCK_BITS hashes, each task's added up first, and are added block by block as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally = Known(words_bits.value), Tally()
        for batch in batches:
            for part, some in pieces(batch):
                for lang, own in by_language(part, some).items():
                    _, h = known(lang, own)
                    found = pair_hash(h[:-1], h[1:])[(h[:-1] != 0) & (h[1:] != 0)] & np.uint64((1 << FILTER_BITS) - 1)
                    for code, n in tally.add(*np.unique(found.astype(np.int64), return_counts=True)):
                        yield _blocks(code, n)
        for code, n in tally.rest():
            yield _blocks(code, n)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = -1, np.zeros(1 << BLOCK_BITS, np.int64)

        def bits() -> pa.RecordBatch:
            words = np.packbits(sums >= least, bitorder="little").view(np.int64)
            at = np.flatnonzero(words)
            return pa.RecordBatch.from_arrays([pa.array(at + now * len(words)), pa.array(words[at])], names=["at", "bits"])

        for batch in batches:
            for block, codes, n in zip(batch.column("block").to_pylist(), batch.column("codes"), batch.column("n"), strict=True):
                if block != now:
                    if now >= 0:
                        yield bits()
                    now, sums[:] = block, 0
                sums[np.frombuffer(codes.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<u4")
        if now >= 0:
            yield bits()

    rows = texts.mapInArrow(run, "block int, codes binary, n binary").repartition("block").sortWithinPartitions("block")
    rows = rows.mapInArrow(added, "at bigint, bits bigint").toArrow()  # a row for each 64 hashes at most
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _blocks(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(block, codes, n) of sorted hashes and their counts."""
    block, first = runs(code >> BLOCK_BITS)
    codes, counts = (code & ((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes(), np.minimum(n, (1 << 32) - 1).astype("<u4").tobytes()
    ends = np.r_[first, len(code)]
    offsets = lambda size: pa.py_buffer((ends * size).astype(np.int32).tobytes())
    binary = [pa.Array.from_buffers(pa.binary(), len(block), [None, offsets(size), pa.py_buffer(x)]) for size, x in ((2, codes), (4, counts))]
    return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *binary], names=["block", "codes", "n"])


def by_language(part: pa.RecordBatch, texts: list[bytes]) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
        out.setdefault(lang, []).append(text)
    return out


class Known:
    """Words of texts with their hashes, 0 for those that are not frequent."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.of = bits, {}

    def __call__(self, lang: str, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        if sum(map(len, self.of.values())) > CACHE_WORDS:
            self.of.clear()
        if lang not in self.of:
            self.of[lang] = Hashes(lang, self.bits)
        words = tokens(texts)
        return words, np.fromiter(map(self.of[lang].__getitem__, words), np.uint64, len(words))


def _counted(texts: DataFrame, make: Callable[[], Callable[[str, list[bytes]], list[bytes]]]) -> DataFrame:
    """(lang, phrase, n): how often make()'s function gives each phrase for the texts (lang, text binary) of a language."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def flushed(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            phrases, n = [*counter], [*counter.values()]
            for i in range(0, len(n), 100_000):
                some = pa.array(phrases[i : i + 100_000], pa.binary()).cast(pa.string())
                yield out_batch(schema, {"lang": [lang] * len(some), "phrase": some, "n": n[i : i + 100_000]})
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, held = make(), {}
        for batch in batches:
            for part, some in pieces(batch):
                for lang, own in by_language(part, some).items():
                    held.setdefault(lang, Counter()).update(phrases(lang, own))
                    if sum(map(len, held.values())) > MAX_HELD:
                        yield from flushed(held)
        yield from flushed(held)

    return texts.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _words_of(lang: str, texts: list[bytes]) -> list[bytes]:
    """Every word, and the empty phrase as often."""
    found = [w for w in tokens(texts) if w != _END]
    return found + [b""] * len(found)


def _longer(words_bits, pairs_bits, longest: int) -> Callable[[], Callable]:
    """Phrases of two words or more, of frequent words and with no pair that is surely rare."""

    def make() -> Callable[[str, list[bytes]], list[bytes]]:
        known, bits = Known(words_bits.value), pairs_bits.value

        def f(lang: str, texts: list[bytes]) -> list[bytes]:
            words, h = known(lang, texts)
            at = joins = (h[:-1] != 0) & (h[1:] != 0) & has_bit(bits, pair_hash(h[:-1], h[1:]))
            out = []
            for m in range(2, longest + 1):
                if m > 2:
                    at = at[:-1] & joins[m - 2 :]
                out += [b" ".join(words[i : i + m]) for i in np.flatnonzero(at).tolist()]
            return out

        return f

    return make


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words array<string>, n): every phrase of up to so many words that occurs ``least`` times or more in its language, and the empty phrase
    with the number of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("text is not null")

    def kept(counts: DataFrame) -> DataFrame:
        root = F.col("phrase") == ""
        words = F.when(root, F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
        return checkpointed(counts.filter(root | (F.col("n") >= least)).select("lang", words.alias("words"), "n"))

    words = kept(_counted(texts, lambda: _words_of))
    if longest < 2:
        return words
    words_bits = spark.sparkContext.broadcast(word_filter(word_hashes(words.filter(F.size("words") == 1))))
    pairs_bits = spark.sparkContext.broadcast(pair_filter(texts, words_bits, least))
    return words.unionByName(kept(_counted(texts, _longer(words_bits, pairs_bits, longest))))


def _boundaries(stream: DataFrame) -> DataFrame:
    """(lang, key, n, extension) of what is open at the first row of each part: the proper beginnings of its key. A part has no more of them than a phrase has words."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    spark = stream.sparkSession
    rows = stream.select("lang", "key").mapInArrow(first, stream.select("lang", "key").schema)
    opened = rows.select("lang", F.explode(F.transform(F.sequence(F.lit(0), F.size("key")), lambda k: F.slice("key", 1, k))).alias("key"), F.size("key").alias("depth"))
    # As many rows as the stream has parts, times the words of a phrase.
    wanted = spark.createDataFrame(opened.filter(F.size("key") < F.col("depth")).select("lang", "key").distinct().toArrow())
    own = stream.join(F.broadcast(wanted), ["lang", "key"]).select("lang", "key", "n", F.lit(0).cast("bigint").alias("extension"))
    parent = stream.filter(F.size("key") > 0).select("lang", F.slice("key", 1, F.size("key") - 1).alias("key"), "n")
    longer = parent.join(F.broadcast(wanted), ["lang", "key"]).select("lang", "key", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("extension"))
    return own.unionByName(longer).groupBy("lang", "key").agg(F.max("n").alias("n"), F.max("extension").alias("extension"))


def walked(rows: DataFrame, key: Column, counts: str, extension: str) -> DataFrame:
    """``rows`` (lang, words, n, ...) with ``counts``, the counts of the proper beginnings of the key from the shortest on, the empty one first, and
    ``extension``, the greatest count of a phrase one word longer that begins with it."""
    given = rows.columns
    stream = rows.withColumn("key", key).repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
    stream = checkpointed(stream)
    edge = _boundaries(stream).toArrow().to_pylist()
    edges = rows.sparkSession.sparkContext.broadcast({(r["lang"], tuple(r["key"])): (r["n"], r["extension"]) for r in edge})
    out = stream.drop("key").schema.add(counts, ArrayType(LongType())).add(extension, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = edges.value
        held = None  # rows that are open, shallowest first; those of other parts too
        best, own = np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                lang, first = batch.column("lang")[0].as_py(), batch.column("key")[0].as_py()
                names = {"lang": [lang] * len(first), "key": [first[:k] for k in range(len(first))], "n": [known[lang, tuple(first[:k])][0] for k in range(len(first))]}
                held = pa.RecordBatch.from_arrays([pa.array(names[f.name], f.type) if f.name in names else pa.nulls(len(first), f.type) for f in batch.schema], schema=batch.schema)
                best, own = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
            fresh = [known.get((lang, tuple(words)), (0, 0))[1] if len(words) < LONGEST else 0 for lang, words in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            both = pa.concat_batches([held, batch])
            best, own = np.r_[best, np.array(fresh, np.int64)], np.r_[own, np.ones(batch.num_rows, bool)]
            n = both.column("n").to_numpy()
            depth = np.diff(both.column("key").offsets.to_numpy())
            place = np.arange(len(n))
            last = [np.maximum.accumulate(np.where(depth == k, place, -1)) for k in range(depth.max() + 1)]
            for k in range(1, len(last)):
                at = np.flatnonzero(depth == k)
                np.maximum.at(best, last[k - 1][at], n[at])
            still = np.array([last[k][-1] for k in range(depth[-1] + 1)])
            done = own.copy()
            done[still] = False
            yield _rows(both, np.flatnonzero(done), depth, n, last, best, given)
            held, best, own = both.take(pa.array(still)), best[still], own[still]
        if held is not None:
            n = held.column("n").to_numpy()
            depth = np.arange(len(n))
            last = [np.where(depth >= k, k, -1) for k in range(len(n))]
            yield _rows(held, np.flatnonzero(own), depth, n, last, best, given)

    def _rows(both: pa.RecordBatch, at: np.ndarray, depth: np.ndarray, n: np.ndarray, last: list[np.ndarray], best: np.ndarray, names: list[str]) -> pa.RecordBatch:
        d = depth[at]
        grid = np.stack([n[x[at]] for x in last], axis=1) if len(last) else np.zeros((len(at), 0), np.int64)
        values = grid[np.arange(grid.shape[1]) < d[:, None]]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(d)].astype(np.int32)), pa.array(values))
        taken = both.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*[taken.column(c) for c in names], lists, pa.array(best[at])], names=[*names, counts, extension])

    return stream.mapInArrow(run, out)


def collocations(phrases: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among phrases (lang, words, n) that no longer one of the same count holds. What holds a phrase in a
    longer one of equal count holds it in one of one word more, so the extensions of both sides decide."""
    suffix = walked(phrases, F.reverse("words"), "rights", "before")
    both = walked(suffix, F.col("words"), "lefts", "after")
    size = F.size("words")
    chosen = both.filter((size > 1) & (F.col("n") >= least) & (F.greatest("before", "after") < F.col("n")))
    total = F.element_at("lefts", 1)

    def cut(k: Column) -> Column:
        left, right = F.get("lefts", k), F.get("rights", size - k)
        top = (F.col("n") * 1000).cast("decimal(19,0)") * total.cast("decimal(18,0)")
        return F.struct(F.call_function("div", top, left.cast("decimal(18,0)") * right.cast("decimal(18,0)")).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))
    rows = chosen.select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), total.alias("total"), best.alias("cut"))
    return rows.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").cast("bigint").alias("score"))


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language. Tasks keep no more than so many of a language before rows are moved."""
    rank = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")
    return rows.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(collocations(frequent_phrases(table(spark, sf_dir, "documents"))))


_ORACLE = r"""
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from d),
f as materialized (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as c from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from p, range(1, 6) s(m) where len(w) >= m) group by all),
total as (select lang, cast(sum(c) as bigint) as n from f where m = 1 group by lang),
cand as materialized (select *, string_split(phrase, ' ') as w from f where m >= 2 and c >= 100),
inner_ as (select distinct lang, c, array_to_string(w[i:i + m - 2], ' ') as phrase from (select *, unnest([1, 2]) as i from cand where m > 2)),
open_ as (select cand.* from cand anti join inner_ using (lang, phrase, c)),
cuts as (select lang, w, phrase, c, k, array_to_string(w[:k], ' ') as p1, array_to_string(w[k + 1:], ' ') as p2 from (select *, unnest(range(1, m)) as k from open_)),
sc as (select cuts.lang, cuts.phrase, cuts.c as a, k, x.c as l, y.c as r, n, cast((1000::hugeint * cuts.c * n) // (x.c::hugeint * y.c) as bigint) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = p1 join f y on y.lang = cuts.lang and y.phrase = p2 join total on total.lang = cuts.lang),
low as (select * from sc qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from low
qualify row_number() over (partition by lang order by score desc, a desc, encode(phrase)) <= 2000
"""
QUERIES = {"op11_phrase_streams": op11_phrase_streams}
ORACLE_SQL = {"op11_phrase_streams": _ORACLE}
