"""Alignment of two tokenizers' tokens of a text, by white-space anchors.

Both tokenizers encode the whole text. Where a token of each begins with a space at the same byte, both have ended before: an anchor. Anchors cut a text's tokens into windows, a pair of
id tuples, and what is inside a window depends on the ids alone: its groups (cut where tokens of both end), its links (pairs of tokens whose bytes overlap). It is
worked out once for a task and remembered by the ids. A text counts only if each side's token bytes, joined, are the text with a space before it.

The first tokenizer splits into pieces by a pattern, the second into runs of spaces and what follows (no piece of its vocabulary has a space after another letter, which is checked), and neither
merges across: a part between two single spaces has the same tokens in any text, and is remembered as well. Texts with several spaces together are encoded in one go.

Links of a pair of ids are counted over the corpus. The commonest pairs, of over a 2^-HEAD_BITS share of all links (so fewer than 2^HEAD_BITS), go to all tasks; the others
are joined. Each way always runs.

A null or empty text, or one whose bytes differ, has no tokens: all numbers 0 and the digest empty. Repeated rows count each. A row with a null id is a row. An empty table gives no rows.
Columns other than the id and the text are not looked at.
"""

import base64
import hashlib
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import out_batch, pieces, shared_folder, table

#: Parts of texts, and windows, that a task remembers: the first ones, others while a batch needs them.
CACHE_PARTS, CACHE_WINDOWS = 300_000, 300_000
#: Fewer than 2^HEAD_BITS pairs of ids are broadcast.
HEAD_BITS = 18
#: Bits of the second tokenizer's ids in a pair.
B_BITS = 20


class Tokenizers:
    """Both tokenizers and the bytes of their tokens, from files of the two libraries."""

    def __init__(self, ranks_path: str, piece_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.first = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes = [self._piece(i) for i in range(self.second.get_piece_size())]
        if any("▁" in self.second.id_to_piece(i).lstrip("▁") for i in range(self.second.get_piece_size())):
            raise ValueError("a piece of the second vocabulary goes on after a space: parts can't be encoded apart")
        self.a_size, self.b_size = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        #: An id as text with what follows it in a group, or after its side of the group.
        self.a_text, self.b_text = ([np.array([b"%d%s" % (i, x) for i in range(len(tokens))], object) for x in after] for tokens, after in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";"))))
        self.a_space, self.b_space = (np.array([t[:1] == b" " for t in tokens]) for tokens in (self.a_bytes, self.b_bytes))

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()

    def encoded(self, text: str) -> tuple[bytes, bytes, bool]:
        """Ids of both as 32-bit integers, and whether their bytes are the text with a space before it."""
        a, b = self.first.encode_ordinary(" " + text), self.second.encode(text)
        whole = b" " + text.encode()
        same = b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])
        return array("i", a).tobytes(), array("i", b).tobytes(), same

    def encoded_parts(self, parts: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """The same of parts without spaces, together: with one space between they have the tokens that they have alone. Parts among which one has other bytes are halved."""
        if len(parts) < 2:
            return [self.encoded(x) for x in parts]
        a, b, same = self.encoded(" ".join(parts))
        if not same:
            half = len(parts) // 2
            return self.encoded_parts(parts[:half]) + self.encoded_parts(parts[half:])
        stops = np.cumsum([len(x.encode()) + 1 for x in parts])
        sides = []
        for ids, size in ((a, self.a_size), (b, self.b_size)):
            ends = np.cumsum(size[np.frombuffer(ids, np.int32)])
            at = np.searchsorted(ends, stops)
            if (ends[at] != stops).any():
                raise ValueError("a token goes on after a part")
            sides.append(_cut(np.r_[0, at + 1], ids))
        return [(x, y, True) for x, y in zip(*sides, strict=True)]


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(paths: tuple[str, str]) -> Tokenizers:
    """Both once for each Python worker; files are read where the worker is."""
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizers(*paths)
    return _LOADED[paths]


class Parts(dict):
    """Tokens of parts between single spaces."""

    def __init__(self, both: Tokenizers):
        self.both = both

    def of(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both for each whole text; None for a text without tokens."""
        parts = [t.split(" ") for t in texts]
        whole = ["" in p for p in parts]  # several spaces together, or one at an end
        wanted = set().union(*[p for p, w in zip(parts, whole, strict=True) if not w])
        fresh = [p for p in wanted if p not in self]
        self.update(zip(fresh, self.both.encoded_parts(fresh), strict=True))
        out: list[tuple[bytes, bytes] | None] = []
        for text, part, one in zip(texts, parts, whole, strict=True):
            found = None if one else [self[p] for p in part]
            if found is None or not all(x[2] for x in found):
                a, b, same = self.both.encoded(text) if text else (b"", b"", False)
                out.append((a, b) if same else None)
            else:
                out.append((b"".join([x[0] for x in found]), b"".join([x[1] for x in found])))
        while len(self) > CACHE_PARTS:
            self.popitem()
        return out


class Windows(dict):
    """What is inside a window of ids, by its number; numbers follow from (ids of the first, ids of the second)."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.text: list[bytes] = []
        self.groups: list[int] = []
        self.pairs: list[bytes] = []  # 64-bit integers

    def trim(self) -> None:
        while len(self) > CACHE_WINDOWS:
            self.popitem()
        for values in (self.text, self.groups, self.pairs):
            del values[CACHE_WINDOWS:]

    def numbers(self, keys: list[tuple[bytes, bytes]]) -> np.ndarray:
        """The windows' numbers; those not met before are worked out together."""
        fresh = [k for k in dict.fromkeys(keys) if k not in self]
        if fresh:
            self.update(zip(fresh, range(len(self.text), len(self.text) + len(fresh)), strict=True))
            self._work_out(fresh)
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def _work_out(self, keys: list[tuple[bytes, bytes]]) -> None:
        both = self.both
        a, b = (np.frombuffer(b"".join([k[side] for k in keys]), np.int32).astype(np.int64) for side in (0, 1))
        n_a, n_b = (np.array([len(k[side]) // 4 for k in keys]) for side in (0, 1))
        # One after another, windows have the same bytes on both sides.
        ends_a, ends_b = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
        # A token overlaps those from the first that ends after it begins to the first that ends with it or later.
        first, last = np.searchsorted(ends_b, ends_a - both.a_size[a], "right"), np.searchsorted(ends_b, ends_a, "left")
        times = last - first + 1
        links = np.repeat(a, times) << B_BITS | b[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first, times)]
        marks = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        marks[ends_a] |= 1
        marks[ends_b] |= 2
        close_a, close_b = marks[ends_a] == 3, marks[ends_b] == 3
        group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
        stop_a, stop_b = np.flatnonzero(close_a) + 1, np.flatnonzero(close_b) + 1
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.r_[0, stop_b][group_a]] = np.where(close_a, both.a_text[1][a], both.a_text[0][a])
        text[np.arange(len(b)) + stop_a[group_b]] = np.where(close_b, both.b_text[1][b], both.b_text[0][b])
        flat, begin_a = text.tolist(), np.cumsum(n_a) - n_a
        at = np.r_[0, np.cumsum(n_a + n_b)].tolist()
        self.text += [b"".join(flat[i:j])[:-1] for i, j in zip(at, at[1:])]  # noqa: B905
        self.groups += np.add.reduceat(close_a.astype(np.int64), begin_a).tolist()
        self.pairs += _cut(2 * np.r_[0, np.cumsum(np.add.reduceat(times, begin_a))], links.tobytes())


def _cut(bounds: np.ndarray, buffer: bytes) -> list[bytes]:
    at = (4 * bounds).tolist()
    return [buffer[i:j] for i, j in zip(at, at[1:])]  # noqa: B905


class Aligner:
    """Windows and links of whole texts."""

    def __init__(self, both: Tokenizers):
        self.both, self.parts, self.windows = both, Parts(both), Windows(both)

    def __call__(self, texts: list[str | None]) -> dict[str, object]:
        rows = self.parts.of([t or "" for t in texts])
        some = [r for r in rows if r]
        n = len(texts)
        has = np.array([r is not None for r in rows], bool)
        counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        digest = [""] * n
        pairs, times, per_row = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(n, np.int64)
        if some:
            raw_a, raw_b = (b"".join([r[k] for r in some]) for k in (0, 1))
            a, b = np.frombuffer(raw_a, np.int32), np.frombuffer(raw_b, np.int32)
            size_a, size_b = (np.array([len(r[k]) // 4 for r in some]) for k in (0, 1))
            counts["n_a"][has], counts["n_b"][has] = size_a, size_b
            start_a, start_b = (np.cumsum(s) - s for s in (self.both.a_size[a], self.both.b_size[b]))
            first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
            # The texts' bytes stand one after another on both sides, so one array marks the anchors of all.
            marks = np.zeros(int(self.both.a_size[a].sum()) + 1, np.uint8)
            marks[start_a[self.both.a_space[a]]] |= 1
            marks[start_b[self.both.b_space[b]]] |= 2
            marks[start_a[first_a]] = 3
            cut_a, cut_b = np.flatnonzero(marks[start_a] == 3), np.flatnonzero(marks[start_b] == 3)
            number = self.windows.numbers([*zip(_cut(np.r_[cut_a, len(a)], raw_a), _cut(np.r_[cut_b, len(b)], raw_b), strict=True)])
            window_row = np.searchsorted(first_a, cut_a, "right") - 1
            stops = np.searchsorted(window_row, np.arange(len(some)), "right")
            text = [self.windows.text[k] for k in number.tolist()]
            made, i = [], 0
            for stop in stops.tolist():
                made.append(hashlib.sha256(b";".join(text[i:stop])).hexdigest())
                i = stop
            places = np.flatnonzero(has)
            for at, value in zip(places.tolist(), made, strict=True):
                digest[at] = value
            used, inverse = np.unique(number, return_inverse=True)
            groups = np.array([self.windows.groups[k] for k in used])[inverse]
            own = [self.windows.pairs[k] for k in used]
            sizes = np.array([len(x) // 8 for x in own])
            begin = (np.cumsum(sizes) - sizes)[inverse]
            links = sizes[inverse]
            counts["n_groups"][has] = np.bincount(window_row, groups, len(some)).astype(np.int64)
            counts["n_links"][has] = np.bincount(window_row, links, len(some)).astype(np.int64)
            flat = np.frombuffer(b"".join(own), np.int64)[np.arange(links.sum()) - np.repeat(np.cumsum(links) - links - begin, links)]
            row = np.repeat(places[window_row], links)
            key = np.sort(row << 40 | flat)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(key)]).astype(np.int32)
            pairs, per_row = key[first] & ((1 << 40) - 1), np.bincount(key[first] >> 40, minlength=n)
        self.windows.trim()
        offsets = pa.array(np.r_[0, np.cumsum(per_row)].astype(np.int32))
        return {**counts, "groups_sha256": digest, "pairs": pa.ListArray.from_arrays(offsets, pa.array(pairs)), "times": pa.ListArray.from_arrays(offsets, pa.array(times))}


def aligned(docs: DataFrame, ranks_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): each whole text's alignment, with its different pairs of ids (the first's id
    above B_BITS bits of the second's) and how many of its links each has."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    paths = (ranks_path, piece_path)
    numbers = [StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    out = StructType([df.schema["doc_id"], *numbers, StructField("groups_sha256", StringType()), StructField("pairs", ArrayType(LongType())), StructField("times", ArrayType(IntegerType()))])
    types = [*[(c.name, pa.int64()) for c in numbers], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_tokenizers(paths))
        for batch in batches:
            for part, texts in pieces(batch):
                yield out_batch(pa.schema([part.schema.field("doc_id"), *types]), {"doc_id": part.column("doc_id"), **aligner(texts)})

    return df.mapInArrow(run, out)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair of ids over all rows, and whether its second id has no pair of more."""
    links = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = links.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))  # a row for each token of the second vocabulary
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def agreement(docs: DataFrame, ranks_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", head_bits: int = HEAD_BITS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). The alignments are written to the shared folder once and read from there."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    aligned(docs, ranks_path, piece_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    pair_counts(rows).write.parquet(f"{folder}/pairs")
    counts = spark.read.parquet(f"{folder}/pairs")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)")).first()[0]
    common = F.col("n").cast("decimal(38,0)") * (1 << head_bits) > F.lit(total).cast("decimal(38,0)")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    sums = [F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    # Fewer than 2^head_bits rows have so large a share.
    found = links.join(F.broadcast(counts.filter(common)), "pair", "left")
    head = found.filter("n is not null").groupBy("row").agg(*sums)
    tail = found.filter("n is null").select("row", "pair", "times").join(counts.filter(~common), "pair").groupBy("row").agg(*sums)
    both = head.unionByName(tail).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(both, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *none, "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return agreement(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLE_SQL: dict[str, str] = {}
