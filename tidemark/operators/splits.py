"""Deterministic splits: by hash, by time, walk-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binning import key_after
from tidemark.functions.hashing import hash_bucket
from tidemark.operators.selection import VALUE_LIMIT, key_cuts


def stratified_split(df: DataFrame, label: str, key: str, test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Add ``part``: a row's place depends on its key within its class only."""
    stratum = F.concat(F.col(label).cast("string"), F.lit(":"), F.col(key).cast("string"))
    held = hash_bucket(stratum, seed, 100) < test_pct
    return df.withColumn("part", F.when(held, "test").otherwise("train"))


def fold_assignment(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..folds-1, spread within each class."""
    stratum = F.concat(F.col(label).cast("string"), F.lit(":"), F.col(key).cast("string"))
    return df.withColumn("fold", hash_bucket(stratum, f"fold{seed}", folds))


def _at_or_after(value: Column, key: Column, cut: tuple[float, int]) -> Column:
    at = (value == F.lit(cut[0])) & (key == F.lit(cut[1]))
    return at | key_after([value, key], cut)


def _instant(time: str) -> Column:
    """Microseconds; rows without a time come last."""
    return F.coalesce(F.unix_micros(F.col(time).cast("timestamp")).cast("double"), F.lit(8e18))


def chronological_split(
    df: DataFrame, time: str, key: str, train: float = 0.70, valid: float = 0.85, limit: int = VALUE_LIMIT
) -> DataFrame:
    """Add ``part``: the first rows by (time, key) train, the next validate, the rest test.

    Only the two boundary keys are looked up; no row is numbered.
    """
    at, tie = _instant(time), F.col(key)
    spots: list[int] = []

    def positions(n: int) -> list[int]:
        spots.extend([int(n * train), int(n * valid)])
        return [s for s in spots if s < n]

    found = key_cuts(df, {"at": at}, tie, positions, limit)["at"]

    def after(spot: int) -> Column:
        return _at_or_after(at, tie, found[spot]) if spot in found else F.lit(False)

    part = F.when(after(spots[1]), "test").when(after(spots[0]), "valid").otherwise("train")
    return df.withColumn("part", part)


def walk_forward_folds(
    df: DataFrame, time: str, key: str, folds: int = 5, limit: int = VALUE_LIMIT
) -> DataFrame:
    """Add ``test_fold``: the fold testing the row, -1 for rows that are only trained on.

    Fold i trains on every row with a smaller ``test_fold``.
    """
    at, tie = _instant(time), F.col(key)

    def positions(n: int) -> list[int]:
        step = n // (folds + 1)
        if step == 0:
            raise ValueError("too few rows for the number of folds")
        return [n - (folds - i) * step for i in range(folds)]

    cuts = key_cuts(df, {"at": at}, tie, positions, limit)["at"]
    fold = F.lit(-1)
    for cut in cuts.values():
        fold = fold + _at_or_after(at, tie, cut).cast("int")
    return df.withColumn("test_fold", fold)
