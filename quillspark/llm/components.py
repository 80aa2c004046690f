"""Connected components of a link table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import Scratch, stored

FOREST = 10_000  #: links that a task turns into stars at a time


def _forests(batches):
    """Rows (a, b, rank_a, rank_b) to the links (a, b) of stars that join the same ids: within each batch, around the id of least rank."""
    for batch in batches:
        up: dict[int, int] = {}
        ranks: dict[int, tuple[int, int]] = {}

        def top(x: int) -> int:
            while up[x] != x:  # noqa: B023
                up[x] = x = up[up[x]]  # noqa: B023
            return x

        for a, b, rank_a, rank_b in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "rank_a", "rank_b")), strict=True):
            for x, rank in ((a, rank_a), (b, rank_b)):
                up.setdefault(x, x)
                ranks[x] = (rank, x)
            a, b = top(a), top(b)
            if ranks[a] < ranks[b]:
                up[b] = a
            else:
                up[a] = b
        rows = [(top(x), x) for x in up if up[x] != x]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), ()))], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links(a, b); the component is its smallest id.

    Rounds of random contraction.  First each batch of links becomes stars that join the same ids, in the task that holds
    it.  Then each id picks the one of least rank among itself and its neighbours, by a hash that is another in each round, and the
    links move on to what their ends picked.  A round leaves a fraction of the ids, so that all rounds
    together join little more than the links once, also for a chain or a hub.  The picks are then followed from the
    last round back to the first, again over fewer rows each.  No links give an empty table."""

    with Scratch(links.sparkSession) as made:
        links = made.stored(_distinct(links), "links-0")
        rounds: list[DataFrame] = []
        while count := links.count():
            rank = lambda c: F.xxhash64(c, F.lit(len(rounds)))  # noqa: B023, E731
            stars = links.coalesce(-(-count // FOREST)).select("a", "b", rank("a").alias("rank_a"), rank("b").alias("rank_b")).mapInArrow(_forests, "a long, b long")
            both = stars.select(F.col("a").alias("id"), F.col("b").alias("other")).union(stars.select("b", "a"))
            best = both.groupBy("id").agg(F.min(rank("other")).alias("rank"), F.min_by("other", rank("other")).alias("other"))
            rounds.append(made.stored(best.select("id", F.when(F.col("rank") < rank("id"), F.col("other")).otherwise(F.col("id")).alias("pick")), f"picks-{len(rounds)}"))
            one, two = (rounds[-1].select(F.col("id").alias(c), F.col("pick").alias(f"pick_{c}")) for c in "ab")
            moved = stars.join(one, "a").join(two, "b").select(F.col("pick_a").alias("a"), F.col("pick_b").alias("b"))
            links = made.stored(_distinct(moved), f"links-{len(rounds)}")
            made.discard(f"links-{len(rounds) - 1}")
        if not rounds:
            return stored(links.select(F.col("a").alias("id"), F.col("b").alias("component")), "components")
        found = rounds[-1]
        for picks in reversed(rounds[:-1]):
            top = found.select(F.col("id").alias("pick"), F.col("pick").alias("top"))
            found = picks.join(top, "pick", "left").select("id", F.coalesce("top", "pick").alias("pick"))
        least = found.groupBy("pick").agg(F.min("id").alias("component"))
        return stored(found.join(least, "pick").select("id", "component"), "components")


def _distinct(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
