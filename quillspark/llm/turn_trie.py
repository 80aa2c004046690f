"""Prefix tries of conversations.

A conversation's turns are in order of `turn` (null first; turns of one number by their digest); a null role or text is empty, and rows
without conv_id belong to no conversation.  Conversation c is rebuilt before: the first h turns of conversation c - c % BASE, then its own after the
first h, h being crc32(c) % HEADS.

1. A turn is the digest of its role and text, a conversation the digests of its turns end to end: its path.  Texts are
   read once, and move nowhere.  (So a conversation's digests, 16 bytes a turn, have to fit into a row.)
2. Conversations are sorted by path and id; those of one path become one row with their number, their smallest id and the hash of
   their ids, which is taken from pieces joined before, so that a path that many share is one long hash but few rows.
3. Paths are grouped by their first turn.  A group of more than GROUP_TURNS turns is dealt again by the first turn in which its
   paths differ, found from its least and greatest path, and so on; a group of one path stays.
4. The groups that fit are hash-partitioned, and each part builds tries of dictionaries and node numbers in applyInPandas, and sums them up
   in postorder by a loop.  What lies above a group that was dealt again is a chain with the group's tops below: these sums go
   upwards level by level, one row for each chain.

No conversations give no nodes.  Repeated rows are turns like any others.  Extra columns play no part and are not returned.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .steps import Scratch, stored

BASE, HEADS = 20, 4
DIGEST = 16  #: bytes of a turn's digest
GROUP_TURNS = 200_000  #: turns of all paths of a group, and of a part on average
IDS = 50_000  #: ids that are joined to one piece
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path binary, words array<int>): each conversation's turns with the head of its base."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), words.alias("words")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % BASE
    heads = own.filter(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h)
    both = own.withColumn("base", base).join(heads, "base", "left").select("conv_id", F.concat(head, F.slice("own", h + 1, F.size("own"))).alias("t"))
    return both.select("conv_id", F.unhex(F.array_join(F.col("t.digest"), "")).alias("path"), F.col("t.words").alias("words"))


def _pieces(batches):
    """Sorted (path, conv_id, words) to (path, words, least, n, ids): the ids that follow each other, joined, IDS of them at most."""
    for batch in batches:
        paths, ids, words = (batch.column(c).to_pylist() for c in ("path", "conv_id", "words"))
        cuts = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]] + [len(paths)]
        cuts = [x for a, b in pairwise(cuts) for x in range(a, b, IDS)] + [len(paths)]
        rows = [(paths[a], words[a], ids[a], b - a, ",".join(map(str, ids[a:b]))) for a, b in pairwise(cuts)]
        yield _batch(rows, ("path", "words", "least", "n", "ids"))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    types = {"path": pa.binary(), "words": pa.list_(pa.int32()), "ids": pa.string(), "sha": pa.string()}
    return pa.record_batch([pa.array(c, types.get(k, pa.int64())) for k, c in zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True)], names=list(names))


def _ends(batches):
    """Pieces, sorted by path and least id, to (path, words, least, n, sha), one for each path; a path may cross batches."""
    path = words = least = n = sha = None
    for batch in batches:
        out = []
        for p, w, i, m, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "least", "n", "ids")), strict=True):
            if p == path:
                sha.update(b",")
                n += m
            else:
                if path is not None:
                    out.append((path, words, least, n, sha.hexdigest()))
                path, words, least, n, sha = p, w, i, m, hashlib.sha256()
            sha.update(ids.encode())
        yield _batch(out, ("path", "words", "least", "n", "sha"))
    if path is not None:
        yield _batch([(path, words, least, n, sha.hexdigest())], ("path", "words", "least", "n", "sha"))


@F.pandas_udf(IntegerType())
def _shared_turns(low: pd.Series, high: pd.Series) -> pd.Series:
    """Turns that the least and the greatest path of a group, and so all its paths, begin with."""
    return pd.Series([len(commonprefix([a, b])) // DIGEST for a, b in zip(low, high, strict=True)], dtype="int32")


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the groups of one part; `up` is null but for the groups' tops."""
    tops: dict[bytes, int] = {}
    below: list[dict[bytes, int]] = []
    depth, parent, n, least, words, sha, above, up = [], [], [], [], [], [], [], []

    def node(d: int, over: int, w: int, outer, outer_id) -> int:
        for column, value in zip((below, depth, parent, n, least, words, sha, up, above), ({}, d, over, 0, None, w, NOTHING, outer, outer_id), strict=True):
            column.append(value)
        return len(depth) - 1

    for path, w, first, m, ends, k, outer, outer_id in zip(*(rows[c] for c in ("path", "words", "least", "n", "sha", "k", "up", "above")), strict=True):
        at = tops.get(path[: k * DIGEST])
        if at is None:
            at = tops[path[: k * DIGEST]] = node(k, -1, w[k - 1], outer, outer_id)
        for d in range(k, len(w) + 1):
            if d > k:
                turn = path[(d - 1) * DIGEST : d * DIGEST]
                if turn not in below[at]:
                    below[at][turn] = node(d, at, w[d - 1], None, None)
                at = below[at][turn]
            n[at] += m
            least[at] = first if least[at] is None else min(least[at], first)
        sha[at] = ends
    leaves, saved = [0] * len(depth), [(m - 1) * w for m, w in zip(n, words, strict=True)]
    todo = [(at, iter(below[at].values())) for at in tops.values()]
    while todo:  # a node is left, and added to its parent, after all its children
        at, rest = todo[-1]
        child = next(rest, None)
        if child is not None:
            todo.append((child, iter(below[child].values())))
            continue
        todo.pop()
        leaves[at] = leaves[at] or 1
        if parent[at] >= 0:
            leaves[parent[at]] += leaves[at]
            saved[parent[at]] += saved[at]
    over = [least[p] if p >= 0 else a for p, a in zip(parent, above, strict=True)]
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": over, "n_convs": n, "n_children": [len(b) for b in below], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha, "up": up})


def _chains(batches):
    """Groups that were dealt again, with the sums of their tops, to the nodes from depth k to the turn before these tops."""
    for rows in batches:
        out = []
        for r in rows.itertuples():
            own = (int(r.n) - 1) * np.asarray(r.words, dtype=np.int64)
            saved = int(r.saved) + np.cumsum(own[::-1])[::-1]
            for j, x in enumerate(saved):
                last, d = j == len(saved) - 1, r.k + j
                out.append((r.least, d, r.least if j else r.above, r.n, r.n_children if last else 1, r.n_leaves, x, r.sha if last else NOTHING, None if j else r.up))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")] + ["up"])


def prefix_nodes(conversations: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations, with the columns of NODE."""
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as made:
        convs = made.stored(rebuilt(conversations), "conversations")
        piece = "path binary, words array<int>, least long, n long, ids string"
        joined = convs.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_pieces, piece)
        paths = joined.repartition(parts, "path").sortWithinPartitions("path", "least").mapInArrow(_ends, "path binary, words array<int>, least long, n long, sha string")
        paths = made.stored(paths, "paths")
        root = paths.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max(F.when(F.octet_length("path") == 0, F.col("sha"))).alias("sha"), F.sum(F.size("words")).alias("turns")).first()
        if not root["n"]:
            return spark.createDataFrame([], NODE)
        left = paths.filter("octet_length(path) > 0").withColumns({"k": F.lit(1), "up": F.lit(b""), "above": F.lit(root["least"])})
        prefix = F.substring("path", F.lit(1), F.col("k") * DIGEST)
        fitting, dealt = [], []
        while True:
            left = left.withColumn("prefix", prefix)
            groups = left.groupBy("prefix").agg(F.sum(F.size("words") - F.col("k") + 1).alias("turns"), F.count("*").alias("kinds"), F.sum("n").alias("n"), F.min("least").alias("least"), F.min("path").alias("low"), F.max("path").alias("high"), F.min_by("words", "path").alias("words"), F.first("k").alias("k"), F.first("up").alias("up"), F.first("above").alias("above"))
            over = groups.filter((F.col("turns") > group_turns) & (F.col("kinds") > 1)).withColumn("shared", _shared_turns("low", "high")).drop("low", "high")
            over = made.stored(over, f"over-{len(dealt)}")
            if over.isEmpty():
                fitting.append(left)
                break
            fitting.append(left.join(over, "prefix", "left_anti").select(*left.columns))
            again = made.stored(left.drop("k", "up", "above").join(over.select("prefix", "shared", F.col("least").alias("above")), "prefix").withColumnRenamed("prefix", "up"), f"again-{len(dealt)}")
            at_end = again.filter(F.size("words") == F.col("shared")).select(F.col("up").alias("prefix"), "sha")
            dealt.append(over.join(at_end, "prefix", "left").withColumn("sha", F.coalesce("sha", F.lit(NOTHING))))
            left = again.filter(F.size("words") > F.col("shared")).withColumn("k", F.col("shared") + 1).drop("shared")
        rows = fitting[0]
        for more in fitting[1:]:
            rows = rows.unionByName(more)
        n_parts = max(parts, -(-2 * (root["turns"] or 0) // group_turns))
        part = F.pmod(F.xxhash64("prefix"), F.lit(n_parts))
        nodes = made.stored(rows.select(part.alias("part"), "path", "words", "least", "n", "sha", "k", "up", "above").groupBy("part").applyInPandas(_tries, f"{NODE}, up binary"), "nodes")
        every, tops = [nodes], nodes.filter("up is not null")
        for level, over in reversed(list(enumerate(dealt))):
            sums = tops.groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("up", "prefix")
            rows = over.join(sums, "prefix").select("least", "k", "above", "n", "n_children", "n_leaves", "saved", "sha", "up", F.slice("words", F.col("k"), F.col("shared") - F.col("k") + 1).alias("words"))
            every.append(made.stored(rows.mapInPandas(_chains, f"{NODE}, up binary"), f"chains-{level}"))
            tops = tops.union(every[-1].filter("up is not null"))
        first = tops.filter(F.octet_length("up") == 0).agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
        given = {"conv_id": root["least"], "depth": 0, "parent_conv_id": None, "n_convs": root["n"]}
        top = first.select(*(F.lit(v).cast("long").alias(c) for c, v in given.items()), "n_children", "n_leaves", "saved_tokens", F.lit(root["sha"] or NOTHING).alias("ends_sha256"))
        out = top
        for more in every:
            out = out.union(more.drop("up"))
        return stored(out, "trie")


def trie_sql() -> str:
    """The same nodes in DuckDB: each path's prefixes as lists, and each node joined to the prefixes of its own list."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
    return rf"""WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'d': d, 'w': w}} ORDER BY turn NULLS FIRST, d[1:32]) AS own FROM t GROUP BY 1),
h AS (SELECT *, CAST({crc} % {HEADS} AS INTEGER) AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h], []), h.own[h + 1:]) AS p FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % {BASE}),
m AS (SELECT conv_id, len(p) AS n, unnest(range(len(p) + 1)) AS depth, p FROM r),
n AS (SELECT p[1:depth] AS p, depth, count(*) AS n_convs, min(conv_id) AS conv_id, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
a AS (SELECT p, unnest(range(depth + 1)) AS up, CASE WHEN depth > 0 THEN (n_convs - 1) * p[-1].w ELSE 0 END AS s, NOT EXISTS (SELECT 1 FROM n c WHERE c.depth = n.depth + 1 AND c.p[1:n.depth] = n.p) AS leaf FROM n),
s AS (SELECT p[1:up] AS p, sum(s) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM a GROUP BY 1),
c AS (SELECT p[1:depth - 1] AS p, count(*) AS k FROM n WHERE depth > 0 GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.k, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.p = n.p LEFT JOIN c ON c.p = n.p LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]"""
