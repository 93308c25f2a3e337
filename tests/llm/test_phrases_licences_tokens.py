import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from mvspark.llm import licence_automaton, phrase_streams, token_alignment
from mvspark.llm.segment_bpe import _byte_letters

LONG = "word other " * 40_000
ODD = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, LONG, "en"), (5, "Same text here, again and again.", "en"), (5, "Same text here, again and again.", "en"), (None, "Same text here.", "en"), (None, None, None), (8, "...!!! 123", "de")]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns({"score": F.lit("mine"), "n": F.lit(7), "row": F.lit(2), "phrase": F.lit("x"), "pairs": F.lit(1), "Labels": F.lit("y"), "words": F.lit(1)})


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()


# Phrases


def brute_phrases(rows, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if (q := p[i : i + m]) in cand and a >= cand[q]}
        found = []
        for p, a in cand.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, x, y, total[lang], -s) for n, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def streamed(df, least, longest, top):
    found = phrase_streams.collocations(phrase_streams.frequent_phrases(df, least=least, longest=longest), least)
    return sorted(tuple(r) for r in phrase_streams.ranked(found, top).collect())


@pytest.mark.parametrize(("least", "longest", "top"), [(2, 5, 2000), (3, 3, 10), (2, 2, 50)])
def test_phrases(spark, least, longest, top):
    rng = random.Random(least)
    words = ["a", "a\x01", "b", "B", "é", "c\x1fd", "the"]
    rows = [(rng.choice(["x", "y", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t", " , ", ".\n"]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    assert streamed(spark.createDataFrame(rows, "lang string, text string").repartition(5), least, longest, top) == brute_phrases(rows, least, longest, top)


def test_small_batches(spark):
    """Open phrases are handed from batch to batch and from part to part."""
    rows = [("en", "in the end of the day in the end of the night"), ("de", "am ende des tages am ende")] * 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert streamed(spark.createDataFrame(rows, "lang string, text string"), 3, 5, 99) == brute_phrases(rows, 3, 5, 99)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_phrases(spark, odd):
    want = brute_phrases([(lang, text) for _, text, lang in ODD], 2, 5, 2000)
    assert streamed(odd, 2, 5, 2000) == want
    assert streamed(odd.limit(0), 2, 5, 2000) == []
    assert streamed(odd, 10**9, 5, 2000) == []


def test_large_counts(spark):
    """Products beyond 64 bits."""
    a, n = 3 * 10**11, 10**13
    rows = [("en", [], n), ("en", ["a"], 2 * a), ("en", ["b"], 5 * a), ("en", ["a", "b"], a)]
    got = phrase_streams.collocations(spark.createDataFrame(rows, "lang string, words array<string>, n long")).collect()
    assert [r.score for r in got] == [1000 * a * n // (10 * a * a)]


# Licences


def brute_matches(words, templates, long):
    """Matches by comparing every run: of each place of the longest run that ends at a word, those that the next word does not continue."""
    out = []
    for i in range(len(words)):
        for size in range(i + 1, 0, -1):
            run = words[i - size + 1 : i + 1]
            places = [(k, e) for k, t in enumerate(templates) for e in range(size - 1, len(t)) if t[e - size + 1 : e + 1] == run]
            if places:
                break
        else:
            continue
        after = words[i + 1] if i + 1 < len(words) else None
        if size >= long:
            out += [(k, e - size + 1, i - size + 1, size) for k, e in places if e + 1 == len(templates[k]) or templates[k][e + 1] != after]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    letters = [b"a", b"b", b"c"]
    templates = [[rng.choice(letters) for _ in range(rng.randrange(5, 30))] for _ in range(4)]
    automaton = licence_automaton.Automaton([(str(k), t) for k, t in enumerate(templates)], {"a b": "ab", "b a c": "bac"})
    words = [rng.choice([*letters, b"z"]) for _ in range(60)]
    words[20:20] = templates[1]
    phrases, matches, at = [], [], 0
    for run in b" ".join(words).split(b"z"):
        run = run.split()
        p, m = automaton.scan([automaton.ids[w] for w in run], at)
        phrases, matches, at = phrases + p, matches + m, at + len(run) + 1
    assert sorted(matches) == brute_matches(words, templates, licence_automaton.LONG)
    want = [(i, 0) for i in range(len(words)) if words[i : i + 2] == [b"a", b"b"]] + [(i, 1) for i in range(len(words)) if words[i : i + 3] == [b"b", b"a", b"c"]]
    assert sorted(phrases) == sorted(want)


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licence_automaton.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places(spark, sf_dir, docs):
    got = {r.doc_id: tuple(r)[1:6] for r in licence_automaton.op12_licence_automaton(spark, sf_dir).collect()}
    assert got == {i: brute_base(t) for i, t in zip(docs.doc_id.tolist(), docs.text, strict=True)}


def test_templates_found(spark):
    """Each template inside other words, whole, with a word in eight replaced, or in halves far apart."""
    rng = random.Random(3)
    rows, want = [], {}
    for k, (label, text) in enumerate(licence_automaton.TEMPLATES):
        w = text.split()
        noise = ["zz%d" % rng.randrange(99) for _ in range(40)]
        rows.append((3 * k, " ".join([*noise, *w, *noise])))
        worn = [x if i % 16 != 15 else "qq" for i, x in enumerate(w)]
        rows.append((3 * k + 1, " ".join([*noise, *worn])))
        rows.append((3 * k + 2, " ".join([*w[: len(w) // 2], *noise, *w[len(w) // 2 :]])))
        want[3 * k] = want[3 * k + 1] = label
    out = {r.doc_id: r for r in licence_automaton.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in want.items():
        assert label in out[i].labels
        span = next(x for x in out[i].licences if x.label == label)
        n = len(licence_automaton.words_of(dict(licence_automaton.TEMPLATES)[label]))
        assert span["first"] == 40 and span["last"] <= 40 + n and span.share >= licence_automaton.SHARE
        assert i % 3 or span.share == 1 and span["last"] == 39 + n
    for k, (label, _) in enumerate(licence_automaton.TEMPLATES):
        assert label not in out[3 * k + 2].labels and out[3 * k + 2].score <= 1


def test_repeated_licence(spark):
    """Thousands of spans in one text."""
    notice = dict(licence_automaton.TEMPLATES)["mit-notice"] + ". "
    row = licence_automaton.licences(spark.createDataFrame([(1, notice * 5000)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, len(row.licences)) == (25_000, 5000, 3, 24_998, 5000)


def test_odd_licences(spark, odd):
    rows = licence_automaton.licences(odd).collect()
    assert len(rows) == len(ODD) and {r.row for r in rows} == {2} and all(r.score == 0 and r.labels == [] and r.first_word is None for r in rows)
    assert licence_automaton.licences(odd.limit(0)).count() == 0


# Tokens


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(rows):
    """By the first library's own file form, links by comparing byte ranges."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=paths()[1])
    letters = {c: b for b, c in enumerate(_byte_letters())}
    out, counts = [], Counter()
    for doc, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in first.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = ([sum(map(len, x[: i + 1])) for i in range(len(x))] if len(x) < 3000 else list(running(x)) for x in (bytes_a, bytes_b))
        links, j = [], 0
        for x, e, t in zip(a, ends_a, bytes_a, strict=True):
            while ends_b[j] <= e - len(t):
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(bytes_b[k]) < e:
                links.append((x, b[k]))
                k += 1
        shared = set(ends_a) & set(ends_b)
        groups_a, groups_b = cut(a, ends_a, shared), cut(b, ends_b, shared)
        counts.update(links)
        out.append((doc, a, b, [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(groups_a, groups_b, strict=True)], links))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((doc, len(a), len(b), len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), digest(g)) for doc, a, b, g, x in out), key=str)


def running(tokens):
    at = 0
    for t in tokens:
        at += len(t)
        yield at


def cut(ids, ends, shared):
    out = [[]]
    for x, e in zip(ids, ends, strict=True):
        out[-1].append(x)
        if e in shared:
            out.append([])
    return out[:-1]


def agreed(df, **options):
    return sorted((tuple(r) for r in token_alignment.agreement(df, *paths(), **options).collect()), key=str)


ODD_TEXTS = ["a  b   c", " x", "x ", "<|endoftext|> <s> </s> <unk>", "▁x y", "ﬁ ① é é \x00 ​ z", "日本語 テキスト 😀 a\tb\r\n c", "   ", "don't 's x\n y\n\n z", "a b 　c", "x\n\n  y", "a▁b"]


@pytest.mark.parametrize("bits", [1, 4, 18])
def test_alignment_of_odd_texts(spark, bits):
    """Most pairs are joined, some, or none."""
    rows = [*enumerate(ODD_TEXTS * 2), (None, "x y"), (77, None), (78, "")]
    assert agreed(spark.createDataFrame(rows, "doc_id long, text string"), head_bits=bits) == brute_alignment(rows)


def test_alignment_of_documents(spark, sf_dir, docs):
    got = sorted((tuple(r) for r in token_alignment.op13_token_alignment(spark, sf_dir).collect()), key=str)
    assert got == brute_alignment([*zip(docs.doc_id.tolist(), docs.text, strict=True)])


def test_forgotten_parts_and_windows(spark, docs, monkeypatch):
    """Aligned again after all that is remembered was dropped."""
    both = token_alignment.Tokenizers(*paths())
    texts = docs.text.tolist()[:40]
    plain = token_alignment.Aligner(both)(texts)
    monkeypatch.setattr(token_alignment, "CACHE_PARTS", 50)
    monkeypatch.setattr(token_alignment, "CACHE_WINDOWS", 50)
    aligner = token_alignment.Aligner(both)
    small = [aligner(texts[i : i + 5]) for i in range(0, 40, 5)]
    for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"):
        assert [x for part in small for x in list(map(str, part[name]))] == list(map(str, plain[name]))


def test_odd_alignment(spark, odd):
    rows = [(i, text) for i, text, _ in ODD]
    assert agreed(odd) == brute_alignment(rows)
    assert agreed(odd.limit(0)) == []
