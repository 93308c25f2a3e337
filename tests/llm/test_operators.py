import hashlib
import html.parser
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mvspark.llm import bitslice_simhash, byte_grams, context_tree, decontamination, extendible_sharding, kneser_ney, language_mixture, ordinal_toxicity, registry, rule_ledger, segment_bpe, warc_derivatives
from tests.oracle import connection, same

LONG = "word other " * 40_000
#: Nulls, empty, blank and very long texts, repeated rows, and columns with names that operators add.
ODD = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, LONG, "en"), (5, "Same text here, again and again.", "en"), (5, "Same text here, again and again.", "en"), (None, "Same text here, again and again.", "en"), (None, None, None), (8, "...!!! 123", "de")]
def clash():
    return {"score": F.lit("mine"), "fp": F.lit(7), "n_words": F.lit(1), "row": F.lit(2), "spans": F.lit("x"), "kept": F.lit("no"), "hash": F.lit(3), "perplexity": F.lit(1.0)}




@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns(clash())


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), connection(sf_dir), registry.oracle_sql()[name])


@pytest.mark.parametrize("limit", [20_000, 200_000])
def test_sharding(spark, sf_dir, limit):
    rows = extendible_sharding.sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = extendible_sharding.assign(rows, extendible_sharding.directory(rows, limit))
    same(out, connection(sf_dir), extendible_sharding.oracle(limit))
    assert out.filter(f"shard_bytes > {limit}").count() == 0


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h = [bitslice_simhash.xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("chunk", [4, 1024])
def test_simhash(spark, chunk):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    fp = np.unique(np.concatenate([base, *[base ^ (np.int64(1) << rng.integers(0, 63, 12)) ^ (np.int64(1) << rng.integers(0, 63, 12)) for _ in range(9)]]))
    apart = np.array([[(int(a) ^ int(b)) & (2**64 - 1) for b in fp] for a in fp], object)
    near = np.vectorize(lambda x: x.bit_count() <= 3)(apart)
    root = {int(x): int(x) for x in fp}
    for _ in fp:
        root = {int(x): min(root[int(y)] for y in fp[near[i]]) for i, x in enumerate(fp)}
    links = bitslice_simhash.links(spark.createDataFrame([(int(x),) for x in fp], "fp long"), chunk=chunk)
    found = {r.node: r.root for r in bitslice_simhash.components(links).collect()}
    assert {x: found.get(x, x) for x in root} == root


def test_simhash_rows(spark, sf_dir, docs, odd):
    got = {r.doc_id: r.fingerprint for r in bitslice_simhash.op7_bitslice_simhash(spark, sf_dir).collect()}
    assert got == {i: f"{brute_fingerprint(t):016x}" for i, t in zip(docs.doc_id, docs.text, strict=True)}
    rows = bitslice_simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.fp == 0} == {1}
    kept = bitslice_simhash.representatives(odd)
    assert set(kept.columns) == set(odd.columns) and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 8]


def test_representatives_of_repeated_ids(spark):
    x, y, z = ("red green blue and seven more words of one text", "quite another text about cats and dogs at home", "the third one holds numbers like four and five")
    rows = [(5, x), (3, x), (5, y), (9, y), (7, z), (7, z), (7, y + " x" * 40), (None, x), (None, "only here, with no id at all"), (None, "only here, with no id at all")]
    kept = bitslice_simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(3, x), (5, y), (7, z), (7, y + " x" * 40), (None, "only here, with no id at all")], key=str)


def test_similar_texts(spark, odd):
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for _ in range(60):
        base = word(100)
        texts.append(base)
        for changed in (1, 2, 2, 3, 5):  # similarities from about 0.9 to 0.6
            copy = base.copy()
            for place in rng.choice(100, changed, replace=False):
                copy[place] = "new" + word(1)[0]
            texts.append(copy)
    texts += [base[:3], base[:3], base[:2], [*base[:50], *word(50)]]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    alike = [[k for k, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)] for x in sets]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[k] for k in near) for near in alike]
    assert len(set(root)) < len(texts) - 100
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = bitslice_simhash.representatives(df, shingle=5, similarity=0.8).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root))
    # Keys over the limit are dealt to chunks without loss.
    marked = bitslice_simhash.marks(df, "doc_id", "text", 5, bitslice_simhash.band_size(0.8)).persist()
    node = {r.doc_id: r.node for r in marked.select("doc_id", "node").collect()}
    classes = lambda of: {frozenset(k for k in node if of(k) == r) for r in map(of, node)}
    for limits in ({"chunk": 2}, {"chunk_bytes": 3000}):
        linked = bitslice_simhash.similar_links(df, "text", 5, 0.8, marked, **limits)
        found = {r.node: r.root for r in bitslice_simhash.components(linked).collect()}
        assert classes(lambda k: found.get(node[k], node[k])) == classes(root.__getitem__)
    assert sorted(r.doc_id for r in bitslice_simhash.representatives(odd, shingle=5, similarity=0.8).collect()) == [1, 4, 5, 8]


def test_similar_texts_about_one_that_are_not_alike(spark):
    # Many texts are like a middle one but not like one another; others are nearly like it. All pairs of one bucket have near sketches.
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    texts = [base]
    for k in range(160):
        copy = base.copy()
        for place in rng.choice(120, 1 + k % 5, replace=False):
            copy[place] = f"n{k}_{place}"
        texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = [[k for k, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)] for x in sets]
    root = list(range(len(texts)))
    for _ in range(6):
        root = [min(root[k] for k in near) for near in alike]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = bitslice_simhash.representatives(df, shingle=5, similarity=0.8).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root)) and 1 < len(set(root)) < 160
    own = [np.unique(np.array([hash(x) for x in s]).view(np.uint64)).view(np.int64) for s in sets[:40]]
    for both in (bitslice_simhash.common(own, 64), bitslice_simhash.common(own, 64, part=300)):
        assert all(both[i, j] == len(np.intersect1d(own[i], own[j])) for i in range(40) for j in range(i))


def test_bpe(spark, docs, odd):
    from tokenizers import Tokenizer

    path = segment_bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), segment_bpe.Encoder(segment_bpe.Vocabulary(path))
    texts = [*docs.text, "ΟΔΟΣ's <|startoftext|>don't<|endoftext|>", "日本 🎉 ½", "a" * 3000, "x\x1cy", None, ""]
    for text, found in zip(texts, own.encode(texts), strict=True):
        ids = np.frombuffer(b"".join(f[0] for f in found), "<u4").tolist()
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == want and " ".join(f[1] for f in found) == library.decode(want, skip_special_tokens=False)
    rows = {r.doc_id: r for r in segment_bpe.digests(odd, path).collect()}
    assert rows[1].n_tokens == 0 and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest() and rows[4].n_tokens == 80_000
    encoded = segment_bpe.encode(odd.filter("doc_id = 5"), path)
    assert segment_bpe.decode(encoded, path).first().decoded == encoded.first().decoded


def test_rules_on_odd_rows(odd):
    rows = rule_ledger.apply_policy(rule_ledger.ledger(odd), 2)
    got = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == len(ODD) and got[1].n_words == got[2].n_words == got[3].n_words == 0
    assert got[4].n_words == got[4].n_repeat_words == 80_000 and not got[4].kept


def test_language(spark, sf_dir, odd):
    rows = language_mixture.op3_language_mixture(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    model = language_mixture.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {r.doc_id: r for r in language_mixture.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and got[4].score > 0
    mixed = model.mixtures(["the and that of in to is the and that of " * 9 + " der die und ein ich nicht der die und " * 9])[0]
    assert (mixed > 0.2).sum() == 2
    empty = language_mixture.learn(odd.filter("false"))
    assert language_mixture.predict(odd, empty).first().lang_pred == "und"


def brute_kneser_ney(text_list, order):
    """Probability of a byte after its context, straight from the definition."""
    raw = Counter()
    for t in text_list:
        b = b"\n" * (order - 1) + t
        raw.update(b[i : i + order] for i in range(len(b) - order + 1))
    level = {order: raw}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    cuts = {}
    for k, c in level.items():
        n = [sum(v == j for v in c.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2])
        cuts[k] = [0, *(min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.05), j - 0.05) for j in (1, 2, 3))]

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        after = [v for x, v in level[k].items() if x[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        cut = lambda v: cuts[k][min(v, 3)]
        c = level[k].get(g, 0)
        return ((c - cut(c)) if c else 0) / sum(after) + sum(map(cut, after)) / sum(after) * p(g[1:])

    return p


def test_kneser_ney(spark, docs, odd, sf_dir):
    texts = [t.encode()[:300] for t in docs.text[:12]]
    learn = spark.createDataFrame([(t.decode("utf-8", "ignore"), k < 9) for k, t in enumerate(texts)], "text string, learn boolean")
    prepared = [t.decode("utf-8", "ignore").encode() for t in texts]
    values = {r.code: r.value for r in kneser_ney.probabilities(byte_grams.counts(learn, "text", "learn", 3, kneser_ney.prepare).persist(), 3).collect()}
    p = brute_kneser_ney(prepared[:9], 3)
    for code in list(values)[::17]:
        assert abs(math.exp(values[code]) - p(code.to_bytes(3, "big"))) < 1e-9
    table = spark.createDataFrame([(c, c % 5, v) for c, v in values.items()], "code long, n long, value double")
    for most in (10**6, 0, 300):  # broadcast, joined, and the common ones broadcast
        rows = byte_grams.with_sums(learn, table, "text", 3, kneser_ney.prepare, "s", max_broadcast=most).collect()
        want = {t.decode(): sum(values[c] for c in byte_grams.codes([t], 3)[0].tolist()) for t in prepared}
        assert all(abs(r.s - want[r.text]) < 1e-6 for r in rows)
    out = kneser_ney.classify(odd, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert out.count() == len(ODD) and not out.filter("text is null and kept").count()
    labelled = kneser_ney.op4_kneser_ney(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rate = {r.quality: r.k for r in labelled.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.35


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.1"
    rows = ordinal_toxicity.op1_ordinal_toxicity(spark, sf).filter("held_out").withColumnRenamed("toxic", "flag").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.flag for r in rows if r.toxic]) > 0.85 and np.mean([r.flag for r in rows if not r.toxic]) < 0.03
    model = ordinal_toxicity.fit([np.array([k]) for k in (0, 0, 0, 0, 1, 1, 1, 2, 2, 2)], np.array([0, 0, 0, 0, 1, 1, 1, 2, 2, 2]), 1e-6, 400)
    assert (np.diff(model.theta) > 0).all() and (np.diff(ordinal_toxicity.severities(model, [np.array([k]) for k in (0, 1, 2)])) > 0).all()
    flags = {r.doc_id: r.toxic for r in ordinal_toxicity.score(odd, model).collect()}
    assert not flags[1] and not flags[2] and not flags[3]


def test_context_tree(spark, sf_dir, docs, odd):
    words = {i: re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in context_tree.op9_context_tree(spark, sf_dir).collect():
        want = sum(math.log10((x + 1) / (n + v + 1)) for x in [*(c[w] for w in words[r.doc_id]), ends])
        assert abs(want - r.base_score) < 1e-6 * abs(want) and r.n_known == sum(c[w] > 0 for w in words[r.doc_id]) + 1
        assert r.held_out == held[r.doc_id] and r.train_tokens == n and r.n_tokens == len(words[r.doc_id]) + 1 and r.score < 0
    rows = context_tree.score(odd, F.lit(True), depth=2).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}


def direct_context_tree(texts, depth):
    """log10 of a text's bytes, straight from the definition: a tree of byte contexts for each place in a byte's bits."""
    raw = Counter()
    for t in texts:
        b = b"\n" * depth + t
        for i in range(depth, len(b)):
            for k in range(8):
                for d in range(depth + 1):
                    raw[b[i - d : i], k, b[i] >> (8 - k), b[i] >> (7 - k) & 1] += 1
    counts = lambda *node: (raw[(*node, 0)], raw[(*node, 1)])
    contexts = {x[0] for x in raw}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    memo = {}

    def parts(c, k, v):  # log of half the own estimate, log of half the children's
        if (c, k, v) not in memo:
            below = sum(weight(bytes([x]) + c, k, v) for x in range(256) if bytes([x]) + c in contexts)
            memo[c, k, v] = kt(*counts(c, k, v)) - math.log(2), below - math.log(2)
        return memo[c, k, v]

    def weight(c, k, v):
        return kt(*counts(c, k, v)) if len(c) == depth else float(np.logaddexp(*parts(c, k, v)))

    def one(c, k, v, full):
        a, b = counts(c, k, v)
        own = (b + 0.5) / (a + b + 1)
        if len(c) == depth:
            return own
        beta = math.exp(parts(c, k, v)[0] - weight(c, k, v))
        return beta * own + (1 - beta) * one(full[depth - len(c) - 1 :], k, v, full)

    def log10(t):
        b = b"\n" * depth + t
        p = [(one(b"", k, b[i] >> (8 - k), b[i - depth : i]), b[i] >> (7 - k) & 1) for i in range(depth, len(b)) for k in range(8)]
        return sum(math.log10(x if bit else 1 - x) for x, bit in p)

    return log10


def test_context_tree_scores(spark):
    texts = ["abra cadabra", "abra abra", "a cad", "never seen xyz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # All broadcast; rare words and n-grams joined; and trees that are cut above their depth.
    cases = [(2, {}), (2, {"max_broadcast": 8, "head": 3}), (4, {}), (1, {"head": 1})]
    for depth, r in [(d, r) for d, how in cases for r in context_tree.score(df, F.col("doc_id") < 3, depth=d, **how).collect()]:
        direct = direct_context_tree([t.encode() + b"\n" for t in texts[:3]], depth)
        seen = Counter(w for t in texts[:3] for w in [*t.split(), None])
        mine = [*texts[r.doc_id].split(), None]
        assert r.n_known == sum(seen[w] > 0 for w in mine)
        assert abs(r.base_score - sum(math.log10((seen[w] + 1) / (seen.total() + len(seen) + 1)) for w in mine)) < 1e-9
        assert abs(r.score - direct(texts[r.doc_id].encode() + b"\n")) < 1e-6
        assert r.n_bytes == len(texts[r.doc_id]) + 1 and abs(r.bits_per_byte + r.score * math.log2(10) / r.n_bytes) < 1e-9


def test_context_tree_counts_rare_ends(spark):
    rows = context_tree.score(spark.createDataFrame([(1, "word " * 250_000)], "doc_id long, text string"), F.lit(True), depth=1).collect()
    n = 250_001
    want = 250_000 * math.log10(250_001 / (n + 3)) + math.log10(2 / (n + 3))
    assert rows[0].n_known == n and abs(rows[0].base_score - want) < 1e-6


def test_context_tree_is_a_distribution():
    code, n = np.unique(byte_grams.codes([b"abracadabra\n", b"abra cadabra\n"], 4)[0], return_counts=True)
    ctx = code[5] >> 8
    asked = np.unique(np.concatenate([code, ctx << 8 | np.arange(256)]))
    counts = np.zeros(len(asked), np.int64)
    counts[np.searchsorted(asked, code)] = n
    for to in (1, 2, 3):  # wherever the trees are cut, the root joins them to the same
        t = context_tree.Trees(asked, counts, 3, to)
        root = context_tree.Root(to, t.top, t.n0, t.n1, t.log_w)
        assert abs((10.0 ** root.log10(t)[asked >> 8 == ctx]).sum() - 1) < 1e-9


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short, item"), (3, None), (4, "..."), (None, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "X one two THREE four five six seven eight nine ten eleven y short-item"), (2, "one two three"), (3, None), (3, None)], "doc_id long, text string").withColumns(clash())
    out = decontamination.contamination(docs, bench).select("doc_id", "items", decontamination.n_hit().alias("hit")).collect()
    assert sorted((r.doc_id, tuple(r["items"]), r.hit) for r in out) == [(1, ("", "1", "2"), 13), (2, (), 0), (3, (), 0), (3, (), 0)]
    assert decontamination.contamination(odd, bench.filter("false")).filter("size(spans) > 0").count() == 0
    clean = decontamination.contamination(docs.filter("doc_id = 2"), bench).first()
    assert clean.score == "mine" and clean.n_words == 3 and [*clean.spans] == []


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(7)  # few words, so that windows, ties of rarity and overlaps are many
    word = lambda n, k: [f"w{x}" for x in rng.integers(0, k, n)]
    items = [word(int(n), 6) for n in rng.integers(1, 16, 60)] + [word(40, 500) for _ in range(60)]
    docs = [word(int(n), 6) for n in rng.integers(0, 80, 60)] + [word(30, 500) + items[60 + k][5 : 10 + k] + word(9, 500) for k in range(40)]
    docs += [docs[3], docs[3], items[70] * 50]
    found = decontamination.contamination(
        spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(f"i{k}", "-".join(x)) for k, x in enumerate(items)], "item_id string, text string")
    )
    wanted = {}
    for k, x in enumerate(items):
        n = min(10, len(x))
        for i in range(len(x) - n + 1):
            wanted.setdefault(tuple(x[i : i + n]), set()).add(f"i{k}")
    rows = found.select("*", decontamination.n_hit().alias("hit")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        d, hit, names = docs[r.doc_id], set(), set()
        for i in range(len(d)):
            for n in range(1, 11):
                if i + n <= len(d) and (own := wanted.get(tuple(d[i : i + n]))):
                    hit.update(range(i, i + n))
                    names |= own
        assert r.n_words == len(d) and r.hit == len(hit) and [*r["items"]] == sorted(names)
        assert {p for a, b in r.spans for p in range(a, b)} == hit and all(x[1] < y[0] for x, y in zip(r.spans, r.spans[1:]))


class Reader(html.parser.HTMLParser):
    BLOCKS = {"p", "div", "li", "ul", "nav", "article", "footer", "h1", "body", "html", "br"}

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        self.out += ["\n"] if tag in self.BLOCKS else []

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        self.out += ["\n"] if tag in self.BLOCKS else []

    def handle_data(self, data):
        self.out += [] if self.skip else [data]


def test_warc(spark, sf_dir):
    pages = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    rows = warc_derivatives.derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    by = {(r.page_id, r.record_type): r for r in rows}
    for p in pages:
        reader = Reader()
        reader.feed(p["html"])
        lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
        conversion, metadata = by[p["page_id"], "conversion"], by[p["page_id"], "metadata"]
        assert conversion.block.decode() == "\n".join(x for x in lines if x)
        assert conversion.refers_to == metadata.refers_to and metadata.source_digest == warc_derivatives.digest(p["html"].encode())
        head = dict(tuple(h) for h in conversion.headers)
        assert head["WARC-Refers-To"] == conversion.refers_to and head["Content-Length"] == str(len(conversion.block))
    raw = warc_derivatives.serialise({"headers": [("WARC-Type", "conversion"), ("Content-Length", "3")], "block": b"abc"})
    assert raw == b"WARC/1.1\r\nWARC-Type: conversion\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    nulls = spark.createDataFrame([(1, None, None), (None, "http://[bad", "<a href=x>y")], "page_id long, url string, html string")
    assert warc_derivatives.derivatives(nulls).count() == 4


def test_warc_sources(spark):
    page = b"<html lang='de'><head><title> A &amp; B </title></head><body><a class=x href='/one?a=1&amp;b=2'>1</a><A HREF=two>2</A><a name=n>3</a><!-- <a href=no> --><a href=\"x>y\">4</a></body></html>"
    block = b"HTTP/1.1 200 OK\r\nServer: test\r\nContent-Type: text/html\r\n\r\n" + page
    sent = [("X-Own", "yes")]
    rows = [(1, "http://h/d/", None, block, "2020-01-02T03:04:05Z", "<urn:uuid:1>", None), (2, "http://h/d/", None, page, None, None, sent), (2, "http://h/d/", None, page, None, None, sent), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, raw binary, at string, rid string, sent array<struct<name:string,value:string>>")
    got = warc_derivatives.derivatives(df, date_col="at", record_id_col="rid", headers_col="sent", block_col="raw").collect()
    assert len(got) == 8
    meta = {r.page_id: bytes(r.block).decode().split("\r\n")[:-1] for r in got if r.record_type == "metadata"}
    assert meta[1][:2] == ["source-server: test", "source-content-type: text/html"] and meta[2][0] == "source-x-own: yes"
    assert meta[1][2] == meta[2][1] == f"source-payload-digest: {warc_derivatives.digest(page)}"
    assert meta[1][4:] == ["title: A & B", "language: de", *(f"outlink: http://h/{x} L a/@href" for x in ("one?a=1&b=2", "d/two", "d/x>y"))]
    head = {(r.page_id, r.record_type): dict(tuple(h) for h in r.headers) for r in got}
    assert head[1, "conversion"]["WARC-Date"] == "2020-01-02T03:04:05Z" and head[1, "metadata"]["WARC-Refers-To"] == "<urn:uuid:1>"
    assert head[3, "conversion"]["WARC-Date"] == warc_derivatives.NO_DATE and "WARC-Target-URI" not in head[3, "conversion"]


@pytest.mark.parametrize("part", ["<title>", "<a ", "<a href=", "<!", "<!--", "<p", "<script>", "<?", "</title ", "<html "])
def test_warc_scans_are_linear(part):
    began = time.time()
    for page in (part * 200_000, part * 100_000 + ">" + part * 100_000):
        warc_derivatives.derive(page.encode(), [], "http://h/", warc_derivatives.NO_DATE, "<urn:uuid:1>")
    assert time.time() - began < 20


def test_sharding_on_odd_rows(spark, odd):
    many = odd.unionByName(spark.range(50).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same row " * 20).alias("text"), F.lit("en").alias("lang")).withColumns(clash()))
    rows = extendible_sharding.sized(many)
    out = extendible_sharding.assign(rows, extendible_sharding.directory(rows, 2_000)).collect()
    assert len(out) == len(ODD) + 50
    same_row = {(r.shard_id, r.overflow, r.shard_rows) for r in out if r.doc_id == 7}
    assert len(same_row) == 1 and {x[1:] for x in same_row} == {(True, 50)}
    assert [r.overflow for r in out if r.doc_id == 4] == [True] and all(r.overflow or r.shard_bytes <= 2_000 for r in out)


def test_many_languages(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}x word{chr(97 + k % 26)}{chr(97 + k // 26)} " * 5, f"l{k:03}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for cells in (language_mixture.MAX_CELLS, 300 * 4096):
        model = language_mixture.learn(df, max_cells=cells)
        assert len(model.languages) == 300 and model.log_p.size <= cells
        got = language_mixture.predict(df.filter("doc_id % 50 = 0"), model).collect()
        assert len(got) == 6 and all(r.lang_pred == r.lang for r in got)


def brute_mixture(model, text, languages, steps):
    """Proportions and log-likelihood of a set of languages by EM over words, straight from the definition."""
    words, bare = [], "".join(c if c.isalpha() else " " for c in text.lower())
    for w in re.finditer(r"\S+", bare):
        around = [" " if not (0 <= i < len(bare)) else bare[i] for i in range(w.start() - 1, w.end() + 1)]
        code = lambda c: 0 if c == " " else ord(c)
        bucket = [((code(a) << 42 | code(b) << 21 | code(c)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language_mixture.BUCKET_BITS) for a, b, c in zip(around, around[1:], around[2:])]
        words.append([math.exp(sum(float(model.log_p[b, k]) for b in bucket)) for k in languages])
    mix = [1 / len(languages)] * len(languages)
    for _ in range(steps):
        post = [[p * m / sum(x * y for x, y in zip(w, mix)) for p, m in zip(w, mix)] for w in words]
        mix = [sum(p[k] for p in post) / len(words) for k in range(len(languages))]
    return mix, sum(math.log(sum(x * y for x, y in zip(w, mix))) for w in words), len(words)


def test_mixture_against_brute_force(spark, sf_dir):
    model = language_mixture.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for text in ("the and that of ist nicht und der", "les des une pour dans avec", "un texto corto y the other one", "a"):
        chosen = list(range(len(model.languages)))
        mix, fit, n = brute_mixture(model, text, chosen, language_mixture.STEPS)
        while len(chosen) > 1:
            least = max(k for k in range(len(chosen)) if mix[k] == min(mix))
            fewer = [x for k, x in enumerate(chosen) if k != least]
            new, new_fit, _ = brute_mixture(model, text, fewer, language_mixture.STEPS)
            if new_fit + language_mixture.PENALTY / 2 * math.log(max(n, 2)) < fit:
                break
            chosen, mix, fit = fewer, new, new_fit
        got = model.mixtures([text])[0]
        assert np.allclose(got[chosen], mix, atol=1e-4) and abs(got.sum() - 1) < 1e-6


def test_toxicity_on_odd_labels(spark):
    # A very long labelled text, whose mark comes last; ids on several texts and labels; null labels.
    rows = [(k, f"plain words number {k} " + ("vile" if k % 2 else "kind") + " end") for k in range(40)]
    rows += [(100, " ".join(f"w{x}" for x in range(100_000)) + " vile"), *[(101, f"vile text {k}") for k in range(5)], (None, "vile"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, 1 if k % 2 else 0, 0 if k % 4 == 1 else 1) for k in range(40)] + [(100, 1, 1), (101, 0, 1), (101, 1, 1), (102, 0, 1), (None, 1, 1), (5, None, None)]
    graded = ordinal_toxicity.grades(spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    ids = graded.select(F.col("doc_id").alias("id"), "grade")
    learnt = ordinal_toxicity.labelled(df, ids, "doc_id", "text", 1000).collect()
    assert len(learnt) == 43 and sum(len(r.f) > 0 for r in learnt if r.grade > 0) == 22  # one row an id; the long text's mark is among its features
    out = ordinal_toxicity.severity(df, graded)[0].collect()
    assert len(out) == len(rows) and all(r.toxic == (r.text is not None and "vile" in r.text) for r in out)


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd):
    import corpus_pipeline

    names = {"n_bytes": F.lit("a"), "threshold": F.lit("b"), "lang_pred": F.lit("c"), "languages": F.lit("d"), "items": F.lit("e"), "__text": F.lit("f"), "__id": F.lit("g"), "key": F.lit("h"), "text_": F.lit("i"), "k1_": F.lit("j"), "log_p": F.lit("k")}
    many = odd.withColumns(names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (many, many.filter("false")):
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            rows = out.collect()
            assert all(r.score == "mine" and r.items == "e" and r.fp == 7 and r.kept == "no" for r in rows) and len(rows) <= len(ODD)
            assert name == "near_duplicates" or sum(r.doc_id == 5 for r in rows) in (0, 2)
    assert corpus_pipeline.tokens(spark, many, sf_dir).count() == len(ODD)


def awkward():
    """Names that differ from added ones by case, a nested name with a dash, a name with a backtick."""
    return {"Score": F.lit("mine"), "Kept": F.lit("no"), "Spans": F.lit("x"), "N_Words": F.lit("w"), "nest": F.struct(F.lit(1).alias("a-b"), F.struct(F.lit(2).alias("c d")).alias("e`f")), "tick`s": F.lit("t"), "dot.ted": F.lit("d")}


def test_awkward_names(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns(awkward())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all((r.Score, r.Kept, r.Spans, r.N_Words, r.nest["a-b"], r["tick`s"], r["dot.ted"]) == ("mine", "no", "x", "w", 1, "t", "d") for r in rows)
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    nested = docs.withColumn("doc", F.struct(F.col("doc_id").alias("a-b")))
    for out in (ordinal_toxicity.severity(docs, ordinal_toxicity.grades(labels))[0], kneser_ney.classify(docs, labels), decontamination.contamination(docs, bench), language_mixture.predict(docs, language_mixture.learn(docs))):
        assert all((r["tick`s"], r.nest["a-b"]) == ("t", 1) for r in out.collect())
    for out in (segment_bpe.digests(nested, segment_bpe.vocabulary_path(), "doc"), bitslice_simhash.fingerprints(nested, "doc")):
        assert {r.doc_id["a-b"] for r in out.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_classes_by_joined_counts(spark, sf_dir):
    """n-grams that are joined instead of broadcast, over a table dealt at random."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    plain = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    joined = kneser_ney.classify(docs.orderBy(F.rand()).repartition(7), labels, max_broadcast=50).collect()
    assert len(joined) == len(plain)
    for r in joined:
        assert r.kept == plain[r.doc_id].kept and r.perplexity == pytest.approx(plain[r.doc_id].perplexity) and r.threshold == pytest.approx(plain[r.doc_id].threshold)


def test_warc_query_gives_the_records(spark, sf_dir):
    rows = warc_derivatives.op2_warc_derivatives(spark, sf_dir).collect()
    assert len(rows) == 2 * spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    for r in rows:
        block = bytes(r.block)
        raw = warc_derivatives.serialise({"headers": [tuple(h) for h in r.headers], "block": block})
        assert hashlib.sha256(raw).hexdigest() == r.record_sha256 and warc_derivatives.digest(block) == r.block_digest and len(block) == r.content_length
        assert r.record_type == "conversion" or b"conversion-record-id: " in block


def test_empty_tables(spark, odd, sf_dir):
    none = odd.filter("false")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = extendible_sharding.sized(none)
    made = [
        segment_bpe.digests(none, segment_bpe.vocabulary_path()),
        rule_ledger.ledger(none),
        bitslice_simhash.near_duplicates(none),
        extendible_sharding.assign(rows, extendible_sharding.directory(rows)),
        kneser_ney.classify(none, labels),
        context_tree.score(none, F.lit(True)),
        decontamination.contamination(none, bench),
        warc_derivatives.derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet").filter("false")),
        ordinal_toxicity.severity(none, ordinal_toxicity.grades(labels))[0],
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() < docs.count() and out.count() == out.select("doc_id").distinct().count()
    leaked = {r.doc_id for r in decontamination.op10_decontamination(spark, sf_dir).filter("contaminated").collect()}
    assert not leaked & {r.doc_id for r in out.collect()}
