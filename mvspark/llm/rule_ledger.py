"""Quality rules as a bitmask ledger: each rule is evaluated once per document, its failure is one bit, and policies are masks over the bits.

Main path: DataFrame functions only. Nulls: a null text has no words (all measurements 0). Repeated rows each get their
own ledger row. An empty table gives an empty ledger. Input columns other than the id and the text are not looked at, so
that their names can't clash.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
WINDOW = 5

#: Rules in bit order; each condition says when a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
#: A policy of a version is the set of rules that count.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_windows"),
    2: tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _repeat_words() -> Column:
    """Words covered by the windows that start at ``starts`` (ascending)."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.size("starts") - 1),
        F.lit(0),
        lambda acc, k: acc + F.least(F.lit(WINDOW), F.get("starts", k) - F.get("starts", k - 1)),
    )
    return F.when(F.size("starts") == 0, 0).when(F.size("starts") == 1, WINDOW).otherwise(WINDOW + steps)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements for each input row. Equal windows are found by sorting their 64-bit hashes within the
    document, so that a text of n words costs n log n and no shuffle. Every array is read more than once by the step after
    it, which keeps Catalyst from inlining (and so repeating) the step that makes it."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    word_lines = F.filter(F.split("text", "\n"), lambda s: F.translate(s, SPACE, "") != "")
    df = df.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.translate("text", SPACE, "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        word_lines.alias("lines"),
    )
    df = df.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        "word_chars",
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    df = df.select(*keep, F.when(F.size("h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("win"))
    # Only texts with an equal pair are sorted; the others get an empty list.
    ordered = F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.select(*keep, F.when(F.size(F.array_distinct("win")) < F.size("win"), ordered).otherwise(F.slice(ordered, 1, 0)).alias("s"))
    same = lambda x, k: F.coalesce(F.get("s", k)["x"] == x["x"], F.lit(False))
    twice = F.filter("s", lambda x, k: (F.when(k > 0, same(x, k - 1)).otherwise(False)) | same(x, k + 1))
    df = df.select(*keep, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("starts"))
    return df.select(*[F.col(c) if c == "doc_id" else F.col(c).cast("long") for c in keep], _repeat_words().cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit k is set if rule k fails."""
    bits = [F.when(F.expr(condition), 1 << k).otherwise(0) for k, condition in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("fail_bits", total.cast("long"))


def apply_policy(rows: DataFrame, version: int) -> DataFrame:
    """``base_failed`` by policy 1, ``kept`` if neither it nor the version's policy objects."""
    failed = lambda v: F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[v]))) != 0
    return rows.withColumns({"base_failed": failed(1), "kept": ~(failed(1) | failed(version))})


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it removes (kept again without it); from one
    pass of partial sums over the bits."""
    names, policy = list(RULES), F.lit(mask(POLICIES[version]))
    sums = []
    for r in POLICIES[version]:
        bit = 1 << names.index(r)
        sums += [
            F.count(F.when(F.col("fail_bits").bitwiseAND(F.lit(bit)) != 0, 1)).alias(f"{r}_failed"),
            F.count(F.when(F.col("fail_bits").bitwiseAND(policy) == bit, 1)).alias(f"{r}_alone"),
        ]
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_or("fail_bits").alias("any_bits"), *sums)
    each = [F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"), F.col(f"{r}_failed").alias("n_failed"), F.col(f"{r}_alone").alias("n_only_this")) for r in POLICIES[version]]
    return one.select("n", F.explode(F.array(*each)).alias("x")).select("x.*", F.col("n").alias("n_docs"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents")), version=2)


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(table(spark, sf_dir, "documents")), version=2)


_MEASURED = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
p as (select r, unnest(words) as w, unnest(range(len(words))) as i, len(words) as n from w),
q as (select r, i, n, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o as g
      from p window o as (partition by r order by i)),
g as (select r, i, count(*) over (partition by r, g) as c from q where i + 5 <= n),
s as (select r, i, lead(i) over (partition by r order by i) - i as step from g where c > 1),
rep as (select r, sum(coalesce(least(step, 5), 5)) as n_repeat_words from s group by r),
ln as (select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
       from (select r, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
m as (select w.doc_id, cast(len(words) as bigint) as n_words,
        cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
      from w left join rep using (r) left join ln using (r)),
b as (select *, cast((case when n_words < 10 then 1 else 0 end) + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
        + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end)
        + (case when word_chars < 2 * n_words then 16 else 0 end) + (case when word_chars > 15 * n_words then 32 else 0 end) as bigint) as fail_bits
      from m)
"""
QUERIES = {"op6_rule_ledger": op6_rule_ledger, "rule_ablations": rule_ablations}
ORACLE_SQL = {
    "op6_rule_ledger": _MEASURED + "select *, fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept from b",
    "rule_ablations": _MEASURED
    + "select rule, bit, count(case when fail_bits & bit <> 0 then 1 end) as n_failed, count(case when fail_bits = bit then 1 end) as n_only_this, count(*) as n_docs from b, (values "
    + ", ".join(f"('{r}', cast({1 << k} as bigint))" for k, r in enumerate(RULES))
    + ") as t(rule, bit) group by rule, bit",
}
