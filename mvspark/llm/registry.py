"""The queries of this subpackage and their SQL."""

from importlib import import_module

MODULES = (
    "ordinal_toxicity",
    "warc_derivatives",
    "language_mixture",
    "kneser_ney",
    "segment_bpe",
    "rule_ledger",
    "bitslice_simhash",
    "extendible_sharding",
    "context_tree",
    "decontamination",
    "phrase_streams",
    "licence_automaton",
    "token_alignment",
)


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").ORACLE_SQL.items()}
