"""The library's queries and their SQL (without those of the text operators)."""

from importlib import import_module

MODULES = ("operators.align", "sources.logs", "sources.records", "sources.stored", "operators.triangulate", "operators.quality", "operators.calibration", "operators.rig_graph", "operators.samples", "operators.smooth", "operators.tracks", "operators.occlusion", "operators.hands", "operators.sequences", "operators.rigs", "operators.lens", "operators.meshes", "streaming.states")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").ORACLE_SQL.items()}
