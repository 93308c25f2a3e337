"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most RADIUS of 64 bits agree in at least BLOCKS - RADIUS of BLOCKS bit blocks; each choice of so
many blocks is a table of buckets, and every pair within the radius meets in some bucket. In a bucket the fingerprints stand as
64 vertical bit planes; carry-save counters add up many distances at once, and queries whose distances all exceed the radius
are abandoned. Equal fingerprints are one before any comparison. Buckets over CHUNK members are compared chunk by chunk in
separate groups, so no group is ever larger than two chunks and no pair is lost. A group gives a star of links, never all pairs.

A null, empty or blank text has fingerprint zero and links like any other. A null id keeps its row and its fingerprint and
gets the least id of its component (null if all are). Repeated rows stay rows. An empty table gives no rows. Columns other than the
id and the text are not looked at.

representatives() also takes a similarity, for texts that are near copies by their word shingles. Then a text's 128 minima give keys (a bucket
for each few of them) and a 128-bit sketch; members of a bucket whose sketches are near, by the same bit-sliced counting, are candidates, and
a candidate is a link only if the two shingle sets have the similarity. One candidate of each member is checked first; candidates within what that connects are
not checked again; for the others a bucket's members (two chunks of CHUNK and of CHUNK_BYTES on average at most) bring their sets, which are compared
in the bucket, a range of shingle hashes at a time.
The keys and the sketch miss less than one pair in 5,000 that just has the similarity, fewer above it.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fresh, lower_words, out_batch, pieces, table, with_fields
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = 5
CHUNK = 1024
#: Shingle sets of a chunk take so many bytes (8 a shingle) on average at most, but for a single set that is larger.
CHUNK_BYTES = 1 << 25
#: Minima of a text's shingles, and the share of pairs of just the similarity that the keys may miss.
MINIMA = 128
MISSED = 1e-4
_SPIN = np.random.default_rng(SEED)
_MUL, _ADD, _MIX = (_SPIN.integers(0, 2**64 - 1, MINIMA, np.uint64) | np.uint64(1) for _ in range(3))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is in over half the hashes of the word shingles (repeats included)."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    last = len(words) - min(shingle, len(words)) + 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:last], stops[len(words) - last :], strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key): the key, a hash of the text, finds a row of an id again without working out what its text holds."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp bigint) of each row."""
    df = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                schema = pa.schema([part.schema.field("doc_id"), pa.field("key", pa.int64()), pa.field("fp", pa.int64())])
                yield out_batch(schema, {"doc_id": part.column("doc_id"), "key": part.column("key"), "fp": [fingerprint(t, shingle) for t in texts]})

    return df.mapInArrow(run, with_fields([df.schema["doc_id"]], {"key": "bigint", "fp": "bigint"}))


def close(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which pairs i < j of one group are within the radius (at most 3): a matrix. Distances to 64 members are counted by each
    64-bit operation; counters hold 0 to 3 and a flag for more."""
    n = len(fp)
    words = -(-n // 64)
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")  # member, bit
    planes = np.zeros((64, words * 64), np.uint8)
    planes[:, :n] = bits.T
    planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
    asked = np.arange(n)
    pairs = np.zeros((n, words * 64), np.uint8)
    pairs[:, :n] = (group[:, None] == group[None, :]) & (asked[:, None] < asked[None, :])
    over = ~np.packbits(pairs, axis=1, bitorder="little").view(np.uint64)  # what isn't asked counts as beyond
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    flip = np.where(bits.T.astype(bool), ~np.uint64(0), np.uint64(0))  # bit, query
    for k in range(0, 64, 3):
        a, b, c = (planes[i][None, :] ^ flip[i, asked][:, None] if i < 64 else np.zeros_like(over) for i in (k, k + 1, k + 2))
        half = a ^ b
        total, two = half ^ c, (a & b) | (half & c)
        carry = ones & total
        ones ^= total
        both = two ^ carry
        over |= (two & carry) | (twos & both)
        twos ^= both
        if k % 12 == 9:  # abandon queries all of whose distances exceed the radius
            live = np.flatnonzero((over != ~np.uint64(0)).any(axis=1))
            if len(live) < len(asked):
                asked, over, ones, twos = asked[live], over[live], ones[live], twos[live]
            if not len(asked):
                break
    beyond = over | {3: np.uint64(0), 2: ones & twos, 1: twos, 0: ones | twos}[radius]
    out = np.zeros((n, n), bool)
    out[asked] = np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    return out


def stars(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of what is connected within the radius in each group."""
    return _stars(fp, close(fp, group, radius))


def _stars(fp: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of what a matrix connects."""
    i, j = np.nonzero(near)
    label = np.arange(len(fp))
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp) in the order of bucket: links. A bucket is whole in its partition; batches of whole buckets are packed into blocks of about
    CHUNK members, in which groups are kept apart."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def packed(bucket: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.r_[True, bucket[1:] != bucket[:-1]] if len(bucket) else np.zeros(0, bool)
        group = np.cumsum(new)
        size = np.bincount(group)[group] if len(group) else group
        fp, group = fp[size > 1], group[size > 1]
        start = 0
        while start < len(fp):
            stop = min(start + CHUNK, len(fp))
            if stop < len(fp):
                first = np.searchsorted(group, group[stop])
                stop = first if first > start else np.searchsorted(group, group[stop], side="right")
            a, b = stars(fp[start:stop], group[start:stop], radius)
            if len(a):
                yield out_batch(schema, {"a": a, "b": b})
            start = stop

    for batch in batches:
        bucket, fp = (np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("bucket", "fp"), strict=True))
        cut = np.searchsorted(bucket, bucket[-1]) if len(bucket) else 0
        yield from packed(bucket[:cut], fp[:cut])
        held = [bucket[cut:], fp[cut:]]
    yield from packed(*held)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b) links between distinct ``fp`` that connect all pairs within the radius."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    tables = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        bits = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        tables.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(bits - (1 << 64) if bits >> 63 else bits))))
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("key"))
    # Members of a bucket over the limit are dealt to chunks; each pair of chunks is compared on its own.
    hot = rows.groupBy("key").count().filter(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))
    rows = rows.join(hot, "key", "left").withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", other)
    rows = rows.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "fp")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _linked(batches, radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each row."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle).select("doc_id", "fp"))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct.select("fp"), radius))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(classes.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the word shingles; a text of fewer words is one shingle."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    one = np.array([digest(w, SEED) for w in words], np.uint64)
    size = min(shingle, len(one))
    h = np.zeros(len(one) - size + 1, np.uint64)
    for k in range(size):  # an odd multiplier and two mixes after each word
        h = (h ^ one[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def set_node(h: np.ndarray) -> int:
    """A hash of a shingle set: equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64))


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of a set under each of MINIMA hashes."""
    out = np.full(MINIMA, ~np.uint64(0))
    for i in range(0, len(h), 1024):
        np.minimum(out, (h[None, i : i + 1024] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out


def band_size(similarity: float) -> int:
    """The most minima in a key at which a pair of the similarity is missed by all keys less often than MISSED."""
    return max([r for r in range(1, MINIMA + 1) if (1 - similarity**r) ** (MINIMA // r) <= MISSED], default=1)


def sketch_radius(similarity: float) -> int:
    """Bits of the sketch in which a pair of the similarity may differ: mean and 4.5 deviations."""
    p = (1 - similarity) / 2
    return int(np.ceil(MINIMA * p + 4.5 * np.sqrt(MINIMA * p * (1 - p))))


def marks(docs: DataFrame, id_col: str, text_col: str, shingle: int, band: int) -> DataFrame:
    """(doc_id, key, node, s0, s1, keys, size) of each row, size the number of different shingles; a text without words has no keys."""
    df = _keyed(docs, id_col, text_col)
    bands = MINIMA // band
    fields = [pa.field("node", pa.int64()), pa.field("s0", pa.int64()), pa.field("s1", pa.int64()), pa.field("keys", pa.list_(pa.int64())), pa.field("size", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                out: dict[str, list] = {f.name: [] for f in fields}
                for text in texts:
                    h = shingle_set(text, shingle)
                    least = minima(h)
                    mixed = least * _MIX
                    s0, s1 = np.packbits(mixed >> np.uint64(63) == 1, bitorder="little").view(np.int64).tolist()
                    keys = (mixed[: bands * band] ^ (mixed[: bands * band] >> np.uint64(31))).reshape(bands, band).sum(axis=1, dtype=np.uint64) + _ADD[:bands]
                    for name, value in zip(out, (set_node(h), s0, s1, keys.view(np.int64) if len(h) else [], len(h)), strict=True):
                        out[name].append(value)
                given = {c: part.column(c) for c in ("doc_id", "key")}
                yield out_batch(pa.schema([*[part.schema.field(c) for c in given], *fields]), given | out)

    return df.mapInArrow(run, with_fields([df.schema["doc_id"]], {"key": "bigint", "node": "bigint", "s0": "bigint", "s1": "bigint", "keys": "array<bigint>", "size": "bigint"}))


def within(sketch: np.ndarray, group: np.ndarray, root: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs i < j of one group and different roots are within any radius: a matrix. As in close(), but counters are as wide as the
    radius asks and start so that they overflow beyond it."""
    n = len(sketch)
    words = -(-n // 64)
    bits = np.unpackbits(sketch.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    planes = np.zeros((len(bits), words * 64), np.uint8)
    planes[:, :n] = bits
    planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
    flip = np.where(bits.astype(bool), ~np.uint64(0), np.uint64(0))
    size = radius.bit_length()
    start = (1 << size) - 1 - radius
    counters = [np.full((n, words), ~np.uint64(0) if start >> b & 1 else np.uint64(0)) for b in range(size)]
    over = np.zeros((n, words), np.uint64)
    for plane, turned in zip(planes, flip, strict=True):
        carry = plane[None, :] ^ turned[:, None]
        for c in counters:
            more = c & carry
            c ^= carry
            carry = more
        over |= carry
    near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    place = np.arange(n)
    return near & (group[:, None] == group[None, :]) & (root[:, None] != root[None, :]) & (place[:, None] < place[None, :])


def _candidates(batches: Iterator[pa.RecordBatch], radius: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node, s0, s1, root) in the order of bucket and node: of each member with a candidate, its pair (a, b) with the least one (pairs), or
    itself (bucket, node, root)."""
    schema = pa.schema([(c, pa.int64()) for c in (("a", "b") if pairs else ("bucket", "node", "root"))])
    names = ("bucket", "node", "s0", "s1", "root")

    for group, bucket, node, s0, s1, root in _groups(batches, names):
        near = within(np.stack([s0, s1], axis=1), group, root, radius)
        near |= near.T
        i = np.flatnonzero(near.any(axis=1))
        if pairs:
            pair = np.sort(np.stack([node[i], node[near[i].argmax(axis=1)]]), axis=0)
            yield out_batch(schema, {"a": pair[0], "b": pair[1]})
        else:
            yield out_batch(schema, {"bucket": bucket[i], "node": node[i], "root": root[i]})


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list]:
    """Group numbers and columns of about CHUNK rows of whole buckets at a time, those of all members of one root left out: they ask for nothing.
    The first column is the bucket, the rows are in its order, and ``root`` is among them."""
    held: list[pa.RecordBatch] = []

    def packed(rows: pa.RecordBatch) -> Iterator[list]:
        bucket, root = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "root"))
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        open_ = np.flatnonzero((np.minimum.reduceat(root, first) < np.maximum.reduceat(root, first))[group])
        group, rows = group[open_], rows.take(pa.array(open_))
        start = 0
        while start < len(group):
            stop = min(start + CHUNK, len(group))
            if stop < len(group):
                begin = np.searchsorted(group, group[stop])
                stop = begin if begin > start else np.searchsorted(group, group[stop], side="right")
            columns = [rows.column(c).slice(start, stop - start) for c in names]
            yield [group[start:stop], *[c if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in columns]]
            start = stop

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            bucket = rows.column("bucket").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield from packed(rows.slice(0, cut))
            held = [rows.slice(cut)]
    if held:
        yield from packed(held[0])


def common(sets: list[np.ndarray], columns: int = 4096, part: int = 1 << 20) -> np.ndarray:
    """How many shingles each two sets have in common: products of blocks of the table of members and shingles, those of one member alone left out."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    for some in _ranges(sets, part):
        _add_common(out, some, columns)
    return out


def _ranges(sets: list[np.ndarray], part: int) -> Iterator[list[np.ndarray]]:
    """The sets (sorted as unsigned numbers) cut at the same values into ranges of about ``part`` shingles in all, as hashes lie evenly."""
    sets = [x.view(np.uint64) for x in sets]
    n = -(-sum(map(len, sets)) // part)
    cuts = np.array([k * 2**64 // n for k in range(1, n)], np.uint64)
    places = [[0, *np.searchsorted(x, cuts).tolist(), len(x)] for x in sets]
    for k in range(n):
        yield [x[at[k] : at[k + 1]] for x, at in zip(sets, places, strict=True)]


def _add_common(out: np.ndarray, sets: list[np.ndarray], columns: int) -> None:
    member = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shingle, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    at, member = (np.cumsum(shared) - 1)[at[shared[at]]], member[shared[at]]
    order = np.argsort(at, kind="stable")
    at, member = at[order], member[order]
    for c in range(0, int(shared.sum()), columns):
        some = slice(*np.searchsorted(at, [c, c + columns]))
        block = np.zeros((len(sets), columns), np.float32)
        block[member[some], at[some] - c] = 1
        out += block @ block.T


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node, root, shingles) in the order of bucket: stars of links between members of a bucket whose sets have the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for group, _, node, _, shingles in _groups(batches, ("bucket", "node", "root", "shingles")):
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            sets = [np.asarray(shingles[int(i)].values) for i in mine]
            size = np.array([len(x) for x in sets])
            both = common(sets)
            near = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6
            a, b = _stars(node[mine], np.triu(near, 1))
            yield out_batch(schema, {"a": a, "b": b})


def buckets(distinct: DataFrame, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(bucket, node, s0, s1) of the members of all keys that several nodes share. A key over the limit, of members or of the bytes of their sets, is
    dealt to chunks, and each pair of chunks is a bucket, as in links()."""
    rows = distinct.select("node", "s0", "s1", "size", F.explode("keys").alias("key"))
    chunks = F.least(F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("size") * 8 / chunk_bytes)), F.col("n")).cast("int")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter("n > 1").select("key", chunks.alias("k"))
    rows = rows.join(shared, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "node", "s0", "s1")


def _shingle_sets(docs: DataFrame, text_col: str, shingle: int, marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted``, from the text of each that ``marked`` (node, key; a row for each node) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for batch in batches:
            for _, texts in pieces(batch):
                for text in texts:  # a set is named by what it holds
                    h = shingle_set(text, shingle)
                    yield out_batch(schema, {"node": [set_node(h)], "shingles": [h.view(np.int64)]})

    keys = marked.join(wanted, "node", "left_semi").select("key")
    text = F.col(text_col).cast("string")
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("key")).join(keys, "key", "left_semi").dropDuplicates(["key"])
    return texts.select("text").mapInArrow(run, "node bigint, shingles array<bigint>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have the similarity (Jaccard)."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(a, "a").join(b, "b").filter(common >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - common) - 1e-9).select("a", "b")


def nodes(marked: DataFrame) -> DataFrame:
    """One row (node, key, s0, s1, keys, size) for each node of ``marked`` (see marks())."""
    return marked.groupBy("node").agg(F.min(F.struct("key", "s0", "s1", "keys", "size")).alias("m")).select("node", "m.*")


def similar_links(docs: DataFrame, text_col: str, shingle: int, similarity: float, marked: DataFrame, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(a, b) links between the nodes of ``marked`` (see marks()) that connect all candidates of the similarity."""
    radius = sketch_radius(similarity)
    distinct = checkpointed(nodes(marked))
    members = checkpointed(buckets(distinct, chunk, chunk_bytes))

    def candidates(rows: DataFrame, pairs: bool) -> DataFrame:
        ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "node")
        ddl = "a bigint, b bigint" if pairs else "bucket bigint, node bigint, root bigint"
        return ordered.mapInArrow(lambda batches: _candidates(batches, radius, pairs), ddl)

    # Every member with a candidate is in the first pairs. What they connect needs no further check. Buckets that still hold candidates get the sets of
    # these members and compare them where they are, so that no table of pairs is made.
    first = checkpointed(candidates(members.withColumn("root", F.col("node")), True).distinct())
    sets = checkpointed(_shingle_sets(docs, text_col, shingle, distinct, first.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    sure = checkpointed(_similar(first, sets, similarity))
    roots = components(sure).withColumnRenamed("node", "in")
    now = members.join(roots, members["node"] == roots["in"], "left").select("bucket", "node", "s0", "s1", F.coalesce("root", "node").alias("root"))
    rest = candidates(now, False).join(sets, "node").select("bucket", "node", "root", "shingles").repartition("bucket").sortWithinPartitions("bucket")
    return sure.unionByName(rest.mapInArrow(lambda batches: _verified(batches, similarity), "a bigint, b bigint"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates: of those with its least id, one with the least fingerprint. A null id counts as
    greater than all others. An id that stands on texts of several classes may stay once for each. Texts are linked by fingerprints within
    RADIUS, or, with a similarity, by shingle sets of that Jaccard similarity or more."""
    if similarity is None:
        rows = checkpointed(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed("fp", "node"))
        return _chosen(docs, id_col, text_col, rows, links(rows.select(F.col("node").alias("fp")).distinct()))
    marked = checkpointed(marks(docs, id_col, text_col, shingle, band_size(similarity)))
    linked = similar_links(docs, text_col, shingle, similarity, marked)
    return _chosen(docs, id_col, text_col, marked.select("doc_id", "key", "node"), linked)


def _chosen(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame, linked: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: rows holds (doc_id, key, node) of each row, and linked the links between nodes."""
    # The best row of each node first, so that many rows of one node don't meet.
    once = rows.withColumn("nameless", F.col("doc_id").isNull()).groupBy("node").agg(F.min(F.struct("nameless", "doc_id", "key")).alias("of"))
    roots = components(linked).select(F.col("node").alias("in"), "root")
    own = once.join(roots, once["node"] == roots["in"], "left").select(F.coalesce("root", "node").alias("root"), "node", "of.*")
    least = own.groupBy("root").agg(F.min(F.struct("nameless", "doc_id", "node", "key")).alias("best"))
    times = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("of"), F.col("key").alias("k"), "n")
    least = least.select(F.col("best.doc_id").alias("id"), F.col("best.key").alias("best"))
    least = checkpointed(least.join(times, least["id"].eqNullSafe(times["of"]) & (least["best"] == times["k"]), "left").select("id", "best", F.coalesce("n", F.lit(1)).alias("n")))
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))

    def kept(least: DataFrame) -> DataFrame:
        return keyed.join(least, keyed[id_col].eqNullSafe(least["id"]) & (keyed[key] == least["best"]), "left_semi")

    out, repeated = kept(least.filter("n = 1")), least.filter("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(kept(repeated).dropDuplicates([id_col, key]))
    return out.drop(key)


def op7_bitslice_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_bitslice_simhash": op7_bitslice_simhash}
ORACLE_SQL: dict[str, str] = {}
