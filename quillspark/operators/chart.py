"""A chart of accounts that changes: versions with the time from which and up to which each holds.

A version is a row (id, name, type, since, until): it holds from `since` (null: always) until before `until` (null: still)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .categorize import MOST_ACCOUNTS

VERSION = "id int, name string, type string, since timestamp, until timestamp"


def versions(changes: DataFrame) -> DataFrame:
    """changes(id, name, type, since), an account's state from a time on, as versions.  A null `since` comes first; of states with one time
    the greatest (name, type) counts, and a change that changes nothing makes no version.  Changes without an id are left out."""
    at_once = changes.filter("id is not null").groupBy("id", "since").agg(F.max(F.struct("name", "type")).alias("state"))
    order = Window.partitionBy("id").orderBy(F.asc_nulls_first("since"))
    numbered = at_once.withColumns({"n": F.row_number().over(order), "before": F.lag("state").over(order)})
    kept = numbered.filter((F.col("n") == 1) | ~F.col("before").eqNullSafe(F.col("state")))
    dated = kept.select(F.col("id").cast("int").alias("id"), "state.name", "state.type", F.col("since").cast("timestamp").alias("since"))
    return dated.withColumn("until", F.lead("since").over(order))


def current(stored: DataFrame) -> DataFrame:
    """The accounts (id, name, type) that hold still."""
    return stored.filter("until is null").select("id", "name", "type")


def seeded(stored: DataFrame, seeds: DataFrame, at: Column) -> DataFrame:
    """stored versions and, for each name of seeds(name, type) that no account holds now, a new one from `at` on: seeding twice changes nothing.

    New accounts take the next free ids in the order of names.  Of seeds with one name the least type counts; seeds without a name
    are left out.  New ids are numbered in one task, as a chart is small; more than MOST_ACCOUNTS new names are a ValueError."""
    wanted = seeds.filter("name is not null").groupBy("name").agg(F.min("type").alias("type"))
    absent = wanted.join(current(stored).select("name"), "name", "left_anti")
    if absent.limit(MOST_ACCOUNTS + 1).count() > MOST_ACCOUNTS:
        raise ValueError("too many accounts for a chart of accounts")
    top = stored.agg(F.max("id").alias("top")).first()["top"] or 0  # one row
    new = absent.select((F.row_number().over(Window.orderBy("name")) + top).cast("int").alias("id"), "name", "type", at.cast("timestamp").alias("since"), F.lit(None).cast("timestamp").alias("until"))
    return stored.select("id", "name", "type", "since", "until").union(new)


def as_of(df: DataFrame, stored: DataFrame, key: str, at: Column) -> DataFrame:
    """df with name and type (category_name, category_type) that the account of column `key` had at the time `at`.

    Nulls where the account wasn't there yet, the key is null or the time is unknown (then only versions without ends hold).
    An equality on the id, which the optimizer broadcasts by size or shuffles, and a range within it: versions don't overlap, so no row is doubled."""
    held = stored.select(F.col("id").alias("_id"), F.col("name").alias("category_name"), F.col("type").alias("category_type"), F.col("since").alias("_since"), F.col("until").alias("_until"))
    timed = df.withColumn("_at", at.cast("timestamp"))
    within = (F.col("_since").isNull() | (F.col("_since") <= F.col("_at"))) & (F.col("_until").isNull() | (F.col("_at") < F.col("_until")))
    return timed.join(held, (timed[key] == held["_id"]) & within, "left").drop("_id", "_since", "_until", "_at")
