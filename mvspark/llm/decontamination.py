"""Benchmark decontamination by a prefix-filtered set join.

A window is WINDOW consecutive words of a benchmark item (the whole item if it has fewer); a document holds it if all its words
stand there in order. For such containment the prefix of a window's words in order of rarity (by the number of documents that have them)
is its rarest word: only places with that word are candidates. They are joined with the prefix words' places in windows; these give the
one place that can match, which length and position bound, and the words there are joined with the windows word for word.

Nothing of the benchmark's or the corpus's size is broadcast: tasks know the words asked for from a bit map of FILTER_BITS bits, whose false positives
only cost rows. Documents are known by two 64-bit hashes of their text, so copies are one document in all joins.

A null or blank text has no words and no hits; a null or wordless item has no windows. A null item id counts as
the empty text. Words of equal rarity are ordered by their hashes. Repeated rows are judged each, repeated items are one for each id. With an empty benchmark
nothing is hit; an empty table gives no rows.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fresh, named, out_batch, pieces, table

WINDOW = 10
#: Bits of the map of words (8 MB).
FILTER_BITS = 26
#: Words, and texts, that a task remembers.
CACHE_WORDS, CACHE_TEXTS = 300_000, 100_000
#: Tasks to which the places of one word are dealt.
SALTS = 16
#: The columns that contamination() adds.
ADDED = ("n_words", "spans", "items")
#: What a word is made of, after A-Z are in lower case.
WORD_CHARS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: A-Z to lower case; other ASCII than letters and digits to a space. UTF-8's other bytes stand.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def hash_of(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(words, n, h, items array<string>): every different window, the hashes of its words, and the items that have it."""
    df = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("item_id", pa.string()), ("words", pa.string()), ("n", pa.int32()), ("h", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                for item, text in zip(part.column("item_id").to_pylist(), texts, strict=True):
                    words = words_of(text)
                    n = min(WINDOW, len(words))
                    own = {b" ".join(words[i : i + n]): words[i : i + n] for i in range(len(words) - n + 1)} if n else {}
                    yield out_batch(schema, {"item_id": [item] * len(own), "words": [w.decode() for w in own], "n": [n] * len(own), "h": [[*map(hash_of, x)] for x in own.values()]})

    found = df.mapInArrow(run, "item_id string, words string, n int, h array<bigint>")
    return found.groupBy("words", "n").agg(F.first("h").alias("h"), F.sort_array(F.collect_set("item_id")).alias("items"))


class Known(dict):
    """The hash of each word whose bit is set, 0 for others; worked out once for each word while it is remembered."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = hash_of(word)
        at = h & ((1 << FILTER_BITS) - 1)
        self[word] = found = h if int(self.bits[at >> 6]) >> (at & 63) & 1 else 0
        return found


def word_filter(hashes: DataFrame) -> np.ndarray:
    """The bit map of hashes (h): FILTER_BITS bits, whatever their number."""
    at = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    one = F.expr("shiftleft(1L, cast(h & 63 as int))")
    rows = hashes.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return bits.view(np.uint64)


def document_frequency(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(h, n): in how many texts each word of words (h) occurs; words with the bit of one may be among them."""
    shared = texts.sparkSession.sparkContext.broadcast(word_filter(words))
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Known(shared.value), Counter()
        for batch in batches:
            for _, some in pieces(batch):
                for text in some:
                    held.update([h for w in set(words_of(text)) if (h := known[w])])
                if len(held) > CACHE_WORDS:
                    yield out_batch(schema, {"h": [*held], "n": [*held.values()]})
                    held.clear()
        yield out_batch(schema, {"h": [*held], "n": [*held.values()]})

    return texts.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(asked: DataFrame, frequency: DataFrame) -> DataFrame:
    """(h, at, n, words, items): each window's rarest word and its first place there. A window with a word that no text has is left out."""
    places = asked.select("words", F.posexplode("h").alias("at", "h")).join(frequency.withColumnRenamed("n", "df"), "h", "left")
    rarest = places.groupBy("words").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "at")).alias("r")).filter("r.df > 0")
    return asked.drop("h").join(rarest, "words").select("r.h", "r.at", "n", "words", "items")


def occurrences(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(k1, k2, p, total, h, lo, near): every place p where a text (k1, k2, text) of so many words has a prefix word, with the words from lo on that a
    window there can hold. A text that a task has just seen isn't looked at again."""
    shared = texts.sparkSession.sparkContext.broadcast(word_filter(found.select("h")))
    schema = pa.schema([*[pa.field(c, pa.int64()) for c in ("k1", "k2")], *[pa.field(c, pa.int32()) for c in ("p", "total")], pa.field("h", pa.int64()), pa.field("lo", pa.int32()), pa.field("near", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, held = Known(shared.value), set(), []
        for batch in batches:
            for part, some in pieces(batch):
                if len(seen) > CACHE_TEXTS:
                    seen.clear()
                for k1, k2, text in zip(part.column("k1").to_pylist(), part.column("k2").to_pylist(), some, strict=True):
                    if (k1, k2) in seen:
                        continue
                    seen.add((k1, k2))
                    words = words_of(text)
                    h = [*map(known.__getitem__, words)]
                    for p in [p for p, x in enumerate(h) if x]:
                        lo = max(0, p - WINDOW + 1)
                        held.append((k1, k2, p, len(words), h[p], lo, b" ".join(words[lo : p + WINDOW]).decode()))
                        if len(held) == 20_000:
                            yield out_batch(schema, dict(zip(schema.names, zip(*held, strict=True), strict=True)))
                            held.clear()
        if held:
            yield out_batch(schema, dict(zip(schema.names, zip(*held, strict=True), strict=True)))

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, p int, total int, h bigint, lo int, near string")


def hits(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(k1, k2, at, n, items): the windows that occur in texts, where."""
    shapes = found.groupBy("h").agg(F.collect_set(F.struct(F.col("at").alias("offset"), "n")).alias("shapes"))  # at most WINDOW^2 to a word
    # A frequent word's places are dealt to SALTS tasks; its shapes, one row, are repeated for each.
    shapes = shapes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = occurrences(texts, found).withColumn("salt", F.pmod(F.col("k2") + F.col("p"), F.lit(SALTS)).cast("int"))
    places = places.join(shapes, ["h", "salt"]).select("k1", "k2", "p", "total", "lo", "near", F.explode("shapes").alias("s"))
    at = F.col("p") - F.col("s.offset")
    places = places.withColumn("at", at).filter((F.col("at") >= 0) & (F.col("at") + F.col("s.n") <= F.col("total")))
    words = F.array_join(F.slice(F.split("near", " "), F.col("at") - F.col("lo") + 1, F.col("s.n")), " ")
    places = places.select("k1", "k2", "at", words.alias("words")).distinct()
    return places.join(found.select("words", "n", "items"), "words").select("k1", "k2", "at", "n", "items")


def merged(spans: Column) -> Column:
    """Sorted spans [from, to) as disjoint ones."""
    none = F.array().cast("array<array<int>>")
    start = F.struct(none.alias("done"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    closed = lambda acc: F.when(acc["b"] > acc["a"], F.concat(acc["done"], F.array(F.array(acc["a"], acc["b"])))).otherwise(acc["done"])

    def step(acc: Column, s: Column) -> Column:
        more = s["at"] <= acc["b"]
        return F.struct(
            F.when(more, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(more & (acc["b"] > acc["a"]), acc["a"]).otherwise(s["at"]).alias("a"),
            F.when(more, F.greatest(acc["b"], s["to"])).otherwise(s["to"]).alias("b"),
        )

    return F.aggregate(spans, start, step, closed)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, spans (disjoint, array of [from, to) in words) and items (ids, sorted) of the windows that occur in each text; columns of
    these names are replaced."""
    text = F.col(text_col).cast("string")
    keys = {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}
    asked = checkpointed(windows(benchmark, item_col, item_text_col))
    texts = docs.filter(text.isNotNull()).select(*[k.alias(c) for c, k in keys.items()], text.alias("text"))
    words = asked.select(F.explode("h").alias("h")).distinct()
    found = checkpointed(prefixes(asked, document_frequency(texts, words)))
    spans = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("to"))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    marked = hits(texts, found).groupBy("k1", "k2").agg(merged(spans).alias("spans"), items.alias("items"))
    kept = docs.drop(*ADDED)
    own = {c: fresh(kept, f"{c}_") for c in keys}
    marked = checkpointed(marked).withColumnsRenamed(own)
    n_words = F.coalesce(F.regexp_count(text, F.lit(WORD_CHARS)), F.lit(0)).cast("long")
    rows = kept.withColumns({own[c]: k for c, k in keys.items()} | {"n_words": n_words}).join(marked, [*own.values()], "left")
    empty = {"spans": F.array().cast("array<array<int>>"), "items": F.array().cast("array<string>")}
    return rows.select(*[named(c) for c in kept.columns], "n_words", *[F.coalesce(c, e).alias(c) for c, e in empty.items()])


def n_hit() -> Column:
    """Words inside the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


_ORACLE = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select coalesce(cast(item_id as varchar), '') as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
bw as (select item_id, words, least(len(words), 10) as n, unnest(range(1, len(words) - least(len(words), 10) + 2)) as i from b where len(words) > 0),
win as (select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as g from bw),
sizes as (select distinct n from win),
dw as (select r, n, words, unnest(range(1, len(words) - n + 2)) as i from d, sizes where len(words) >= n),
hit as (select r, dw.n, i, item_id from dw join win on win.n = dw.n and win.g = array_to_string(words[i:i + dw.n - 1], ' ')),
pos as (select distinct r, unnest(range(i, i + n)) as p from (select distinct r, i, n from hit)),
nh as (select r, count(*) as n_hit from pos group by r),
it as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hit) group by r)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join nh using (r) left join it using (r)
"""
QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE_SQL = {"op10_decontamination": _ORACLE}
