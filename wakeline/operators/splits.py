"""Subject-independent splits, folds and their guards.

A subject's place in the shuffled order is the hash of (seed, subject), so a split is two
cut points in hash space: rows are labelled by comparing a hash, without moving them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.scalars import recording_subject
from wakeline.operators.segments import cut, index_rows
from wakeline.schemas import MIRROR_RATIOS, RECORDING_RATIOS, VALIDATION_RATIOS

class SubjectLeakageError(AssertionError):
    """A subject appears in more than one split."""


def subject_hash(subject: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), subject.cast("string")))


def subject_independent_split(
    manifest: DataFrame,
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
    seed: int = 0,
    subject: str = "subject_id",
) -> DataFrame:
    """Adds ``split``: round(r0 * n) subjects train, round(r1 * n) validate, the rest test.

    Halves round to even. The same seed gives the same split.
    """
    place = subject_hash(F.col(subject), seed)
    subjects = manifest.select(F.col(subject).cast("string").alias("_s")).distinct().select(
        subject_hash(F.col("_s"), seed).alias("_h"),
        "_s",
    )
    subjects = cut(subjects)
    ranked = index_rows(subjects, [], ["_h", "_s"], "_rank")
    n = subjects.agg(F.count(F.lit(1)).alias("_n"))
    n_train = F.rint(F.lit(ratios[0]) * F.col("_n"))
    n_val = F.rint(F.lit(ratios[1]) * F.col("_n"))
    last = lambda k: F.max(F.when(F.col("_rank") < k, F.struct("_h", "_s")))
    cuts = ranked.crossJoin(F.broadcast(n)).agg(
        last(n_train).alias("_train"), last(n_train + n_val).alias("_val")
    )
    mine = F.struct(place.alias("_h"), F.col(subject).cast("string").alias("_s"))
    split = F.when(mine <= F.col("_train"), "train").when(mine <= F.col("_val"), "val").otherwise("test")
    return manifest.crossJoin(F.broadcast(cuts)).withColumn("split", split).drop("_train", "_val")


def leaked_subjects(split: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Subjects found in more than one split; empty for a sound split."""
    pairs = split.select(subject, "split").distinct()
    return pairs.groupBy(subject).agg(F.count(F.lit(1)).alias("splits")).filter(F.col("splits") > 1)


def assert_subject_independent(split: DataFrame, subject: str = "subject_id") -> DataFrame:
    leaked = [r[0] for r in leaked_subjects(split, subject).orderBy(subject).limit(20).collect()]
    if leaked:
        raise SubjectLeakageError(f"not on one side of the split only: {leaked}")
    return split


def contracted_split(
    manifest: DataFrame,
    expected_train: int = 70,
    expected_test: int = 20,
    ratios: tuple[float, float, float] = MIRROR_RATIOS,
    seed: int = 0,
    subject: str = "subject_id",
) -> DataFrame:
    """A split whose subject counts must come out exactly as agreed."""
    split = assert_subject_independent(subject_independent_split(manifest, ratios, seed, subject), subject)
    counts = {
        r["split"]: r["n"]
        for r in split.select("split", subject).distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    train, test = counts.get("train", 0), counts.get("test", 0)
    if (train, test) != (expected_train, expected_test):
        raise ValueError(
            f"the contract is {expected_train} subjects to train and {expected_test} to test on, "
            f"the split has {train} and {test}"
        )
    return split


def carve_validation(
    split: DataFrame,
    ratios: tuple[float, float, float] = VALIDATION_RATIOS,
    seed: int = 0,
    subject: str = "subject_id",
) -> DataFrame:
    """Inner train and validation subjects, taken from the training rows only."""
    train = split.filter(F.col("split") == "train").drop("split")
    return subject_independent_split(train, ratios, seed, subject)


def recording_split(
    recordings: DataFrame,
    stem: str = "stem",
    ratios: tuple[float, float, float] = RECORDING_RATIOS,
    seed: int = 0,
) -> DataFrame:
    """Split recordings by the subject named in their stem."""
    named = recordings.withColumn("subject_id", recording_subject(F.col(stem)))
    return subject_independent_split(named, ratios, seed)


def subject_folds(df: DataFrame, subject: str = "subject_id", strict: bool = True) -> DataFrame:
    """One fold per subject: (fold, held_out, n_train_subjects, n_train, n_test).

    The training side of a fold is every row of the other subjects (`train_rows`); its
    size is the total less the held-out rows, so no pairs of subjects are formed. A table
    without subjects is an error.
    """
    per_subject = cut(df.groupBy(F.col(subject).alias("held_out")).agg(F.count(F.lit(1)).alias("n_test")))
    if strict and per_subject.isEmpty():
        raise ValueError("no subjects to make folds of")
    ordered = index_rows(per_subject, [], ["held_out"], "fold")
    totals = per_subject.agg(F.count(F.lit(1)).alias("_subjects"), F.sum("n_test").alias("_rows"))
    return ordered.crossJoin(F.broadcast(totals)).select(  # totals is a single row
        "fold",
        "held_out",
        (F.col("_subjects") - 1).alias("n_train_subjects"),
        (F.col("_rows") - F.col("n_test")).alias("n_train"),
        "n_test",
    )


def train_rows(df: DataFrame, held_out: str, subject: str = "subject_id") -> DataFrame:
    return df.filter(F.col(subject) != held_out)


def held_out_rows(df: DataFrame, held_out: str, subject: str = "subject_id") -> DataFrame:
    return df.filter(F.col(subject) == held_out)


def union_manifests(*manifests: DataFrame, strict: bool = True, key: str = "sample_id") -> DataFrame:
    """Concatenate manifests; a sample id found twice is an error."""
    if not manifests:
        raise ValueError("a union needs a manifest")
    out = manifests[0]
    for other in manifests[1:]:
        out = out.unionByName(other)
    if strict:
        twice = [r[0] for r in duplicate_ids(out, key).limit(5).collect()]
        if twice:
            raise ValueError(f"sample ids that two manifests share: {twice}")
    return out


def duplicate_ids(manifest: DataFrame, key: str = "sample_id") -> DataFrame:
    return manifest.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
