"""Byte n-grams as integers: counting them over a corpus, and summing a value of theirs over each text.

An n-gram of order k is the integer of its k bytes, the first highest; a text is preceded by k - 1 line feeds. A code's suffix
is its low bytes, its context the code without its last byte. Null, empty and blank texts have what ``prepare`` makes of them; a text
without bytes has no codes and the sum 0. An empty table has no counts and no sums.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, out_batch, pieces, with_text_columns

#: Codes whose values are broadcast at most (about 26 bytes each): all, or the commonest; the others are joined.
MAX_BROADCAST = 6_000_000
#: Codes that a task holds before it hands on their counts.
MAX_HELD = 750_000


def codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts one after another, and each text's number of them (its bytes)."""
    n = np.array([len(t) for t in texts], np.int64)
    if not n.sum():
        return np.zeros(0, np.int64), n
    pad = b"\n" * (order - 1)
    buffer = np.frombuffer(b"".join([x for t in texts for x in (pad, t)]), np.uint8)
    windows = len(buffer) - order + 1
    out, done = buffer.astype(np.int64), 1
    wide = out
    while 2 * done <= order:  # windows of 1, 2, 4 ... bytes
        wide = wide[:-done] << 8 * done | wide[done:]
        done *= 2
    out = wide
    while done < order:
        more = min(done, order - done)
        tail = wide if more == done else codes_of(buffer, more)
        out = out[: len(buffer) - done - more + 1] << 8 * more | tail[done : done + len(buffer) - done - more + 1]
        done += more
    # A window counts where its last byte is of a text, not of the padding.
    own = np.repeat(np.tile([False, True], len(n)), np.stack([np.full(len(n), order - 1), n], axis=1).ravel())
    return out[:windows][own[order - 1 :]], n


def codes_of(buffer: np.ndarray, order: int) -> np.ndarray:
    """All windows of a few bytes."""
    out = np.zeros(len(buffer) - order + 1, np.int64)
    for k in range(order):
        out = out << 8 | buffer[k : k + len(out)]
    return out


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted array, and where each begins."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], first


def learnt(texts: list[bytes], learn: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, n) of some texts, a code twice at most; n counts those of texts to learn from."""
    code, n = codes(texts, order)
    key = np.sort(code << 1 | np.repeat(learn, n))
    kinds, first = runs(key)
    return kinds >> 1, np.diff(np.r_[first, len(key)]) * (kinds & 1)


class Tally:
    """Sums of counts by code, held back until there are many."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate([x[k] for x in self.held]) for k in (0, 1))
        order = np.argsort(code, kind="stable")
        code, first = runs(code[order])
        return code, np.add.reduceat(n[order], first) if len(first) else n

    def add(self, code: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.held.append((code, n))
        if sum(len(c) for c, _ in self.held) > 2 * MAX_HELD:
            self.held = [self.merged()]
            if len(self.held[0][0]) > MAX_HELD:
                yield from slices(*self.held.pop())

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            yield from slices(*self.merged())


def slices(*columns: np.ndarray, rows: int = 100_000) -> Iterator[tuple[np.ndarray, ...]]:
    for i in range(0, len(columns[0]), rows):
        yield tuple(c[i : i + rows] for c in columns)


def counts(docs: DataFrame, text_col: str, learn_col: str, order: int, prepare: Callable[[str | None], bytes]) -> DataFrame:
    """(code bigint, n bigint) of every code in any text; n counts those of texts to learn from (0: none)."""
    df = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(learn_col), F.lit(False)).alias("learn"))
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part, texts in pieces(batch):
                learn = part.column("learn").to_numpy(zero_copy_only=False)
                for code, n in tally.add(*learnt([prepare(t) for t in texts], learn, order)):
                    yield out_batch(schema, {"code": code, "n": n})
        for code, n in tally.rest():
            yield out_batch(schema, {"code": code, "n": n})

    return df.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


class Lookup:
    """Values of codes in a table with linear probing, made and asked by whole arrays; NaN for a code that isn't there."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        self.size = 1 + len(code) * 8 // 5
        slot = self._slot(code)
        order = np.argsort(slot, kind="stable")
        place = np.arange(len(code))
        at = place + np.maximum.accumulate(slot[order] - place) if len(code) else place
        length = int(max(self.size, at[-1] + 1 if len(at) else 0)) + 1  # the last stays empty
        self.used = np.zeros(length, bool)
        self.code, self.value = np.zeros(length, np.int64), np.full(length, np.nan)
        self.used[at], self.code[at], self.value[at] = True, code[order], value[order]
        self.code[~self.used] = -1

    def _slot(self, code: np.ndarray) -> np.ndarray:
        mixed = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return ((mixed * np.uint64(self.size)) >> np.uint64(32)).astype(np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        at = self._slot(code)
        miss = np.flatnonzero(self.code[at] != code)
        while len(miss):
            miss = miss[self.used[at[miss]]]
            at[miss] += 1
            miss = miss[self.code[at[miss]] != code[miss]]
        return self.value[at]


def head_of(values: DataFrame, max_broadcast: int) -> tuple[Lookup, DataFrame | None]:
    """The values (code, n, value) to broadcast, max_broadcast at most, and those to join (None: none). If not all fit, those of a share of
    the counts over 1 / max_broadcast are broadcast."""
    rows, total = values.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = F.lit(True) if rows <= max_broadcast else F.col("n") * F.lit(max_broadcast) > F.lit(total)
    got = values.filter(common).select("code", "value").toArrow()
    return Lookup(got.column("code").to_numpy(), got.column("value").to_numpy()), None if rows <= max_broadcast else values.filter(~common)


def text_sums(n: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive texts of n values each."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def missing(row: np.ndarray, n: np.ndarray, code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, times) of the codes without a value, once for each row and code; their values become 0."""
    at = np.flatnonzero(np.isnan(value))
    value[at] = 0.0
    row, code = np.repeat(row, n)[at], code[at]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[first], code[first], np.diff(np.r_[first, len(row)])


def with_sums(docs: DataFrame, values: DataFrame, text_col: str, order: int, prepare: Callable[[str | None], bytes], name: str, bytes_name: str = "n_bytes", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with its texts' bytes and the sum ``name`` of ``values`` (code, n, value; materialised, for all codes of these texts) over
    each. At most max_broadcast values are broadcast, the commonest; rarer codes are joined with theirs and summed again by row."""
    lookup, rare = head_of(values, max_broadcast)
    shared = docs.sparkSession.sparkContext.broadcast(lookup)
    added = {bytes_name: ("bigint", pa.int64()), name: ("double", pa.float64())}

    if rare is None:

        def make() -> Callable:
            lookup = shared.value

            def f(texts: list[str | None]) -> dict:
                found, n = codes([prepare(t) for t in texts], order)
                return {bytes_name: n, name: text_sums(n, lookup(found))}

            return f

        return with_text_columns(docs, text_col, added, make)

    row = fresh(docs, "row")
    # Numbered once and written: the rows are read twice, and must keep their numbers whatever order their table comes in.
    rows = checkpointed(docs.drop(*added).withColumn(row, F.monotonically_increasing_id()))
    schema = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("s", pa.float64()), ("code", pa.int64()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for batch in batches:
            for part, texts in pieces(batch):
                ids = part.column("row").to_numpy()
                found, n = codes([prepare(t) for t in texts], order)
                value = lookup(found)
                r, code, m = missing(ids, n, found, value)
                none = pa.nulls(len(ids), pa.int64())
                yield out_batch(schema, {"row": ids, "n": n, "s": text_sums(n, value), "code": none, "m": none})
                for r_, c_, m_ in slices(r, code, m):
                    yield out_batch(schema, {"row": r_, "n": pa.nulls(len(r_), pa.int64()), "s": pa.nulls(len(r_), pa.float64()), "code": c_, "m": m_})

    asked = rows.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "row bigint, n bigint, s double, code bigint, m bigint")
    # Rows without a code would all meet in one task: they get one that nothing has.
    asked = asked.withColumn("at", F.coalesce("code", -F.xxhash64("row").bitwiseAND(F.lit((1 << 62) - 1)) - 1))
    joined = asked.join(rare.select(F.col("code").alias("at"), "value"), "at", "left")
    sums = joined.groupBy(F.col("row").alias(row)).agg(F.max("n").alias(bytes_name), F.sum(F.coalesce("s", F.col("m") * F.col("value"))).alias(name))
    return rows.join(sums, row, "left").drop(row)
