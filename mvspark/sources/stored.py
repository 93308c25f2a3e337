"""Extraction whose results are kept: only what is wanted and not stored yet is extracted, and stores of an older schema are brought up to date."""

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvspark.functions.series import checkpointed
from mvspark.plans.fixtures import keypoint_lists, keypoints_sql

KEYS = ["session", "cam_id", "frame"]
#: The store's own columns: its partitions (the first key as text) and what was extracted for a row.
FOLDER, HOLDS = "stored_of", "holds"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The store's rows under all columns that any of its files has; None where there is no store."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def extract_missing(wanted: DataFrame, extraction: Callable[[DataFrame], DataFrame], path: str, needed: list[str], keys: list[str] = KEYS, force: bool = False) -> DataFrame:
    """Rows (keys, needed) of all wanted keys, from the store at ``path``, a Parquet table in a folder for each value of the first key.

    ``extraction`` turns keys into rows (keys, needed), one a key at most; a key without a row is stored with nulls, so that it isn't tried again. Keys whose stored rows
    were extracted without one of ``needed`` (an older schema) are extracted again and their folders written anew, with the rows of keys not wanted now as they were; other
    missing keys are added to their folders. ``force`` extracts all wanted keys again. If nothing is missing, nothing is written. Repeated keys are one; keys with
    a null are left out. A run that ends early leaves what was stored, and the next one completes it."""
    spark, own = wanted.sparkSession, [*keys, *needed, HOLDS]
    wanted = wanted.select(*keys).dropna().distinct()
    old = stored(spark, path)
    if old is not None and HOLDS not in old.columns:
        old = old.withColumn(HOLDS, F.lit(None).cast("array<string>"))
    missing, again = wanted, None
    if old is not None:
        whole = F.coalesce(F.size(F.array_except(F.array(*map(F.lit, needed)), HOLDS)) == 0, F.lit(False))
        missing = wanted if force else wanted.join(old.filter(whole).select(*keys), keys, "left_anti")
    missing = checkpointed(missing)
    if not missing.isEmpty():
        found = missing.join(extraction(missing).select(*keys, *needed), keys, "left").withColumn(HOLDS, F.array(*map(F.lit, needed)))
        if old is not None:
            # Folders in which rows are replaced are written anew; the others get more files.
            again = checkpointed(old.join(missing, keys, "left_semi").select(keys[0]).distinct())
        if again is not None and not again.isEmpty():
            found = checkpointed(found)  # extracted once, written in two ways
            kept = old.join(again, keys[0], "left_semi").join(missing, keys, "left_anti").drop(FOLDER)
            anew = checkpointed(found.join(again, keys[0], "left_semi").unionByName(kept, allowMissingColumns=True))
            _write(anew, keys[0], path, "overwrite")
            found = found.join(again, keys[0], "left_anti")
        _write(found, keys[0], path, "append")
    out = stored(spark, path)
    if out is None:  # nothing was wanted, and nothing is stored
        return extraction(wanted).select(*keys, *needed)
    return out.join(wanted, keys, "left_semi").select(*own[:-1])


def _write(rows: DataFrame, key: str, path: str, mode: str) -> None:
    # A folder's rows come together first (a large one's in several parts): else each task would write a file into each folder.
    rows.withColumn(FOLDER, F.col(key).cast("string")).hint("rebalance", FOLDER).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(path)


def _landmarks(seen: DataFrame, parts: dict[str, tuple[str, ...]]) -> Callable[[DataFrame], DataFrame]:
    """An extraction: of each image the landmarks of each part, of rows (KEYS, part, n) with the number of a side's landmarks."""
    counts = [F.coalesce(F.sum(F.when(F.col("part").isin(*of), F.col("n"))), F.lit(0)).alias(name) for name, of in parts.items()]
    return lambda missing: seen.join(missing, KEYS, "left_semi").groupBy(*KEYS).agg(*counts)


def _upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even frames are stored without a body first; the second run upgrades them and adds the others."""
    rows = keypoint_lists(spark, sf_dir)
    wanted = checkpointed(rows.select(*KEYS).distinct())
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    hands = {"left": ("left",), "right": ("right",)}
    seen = rows.select(*KEYS, "part", F.size(F.filter("conf", lambda c: c >= 0.5)).alias("n")).filter("n > 0")
    extract_missing(wanted.filter("frame % 2 = 0"), _landmarks(seen, hands), path, list(hands))
    whole = hands | {"body": ("left", "right")}
    return extract_missing(wanted, _landmarks(seen, whole), path, list(whole))


QUERIES = {"upgraded_extraction": _upgraded}
ORACLE_SQL = {
    "upgraded_extraction": "with " + keypoints_sql(0.0) + """, n as (select session, cam_id, frame, count(*) filter (part = 'left') as l, count(*) filter (part = 'right') as r, count(*) as b from keypoint where conf >= 0.5 group by all)
 select k.session, k.cam_id, k.frame, l as "left", r as "right", b as body from (select distinct session, cam_id, frame from keypoint) k left join n using (session, cam_id, frame)""",
}
