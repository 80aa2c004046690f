"""Exact deduplication by recursive partitioning: Grace hash deduplication.

Texts are equal when they are identical after every run of white space (space and 0x09 to 0x0D) has become one space; null counts as empty.

1. Each task first puts its own rows together in an open-addressing table: rows of one text become one row that holds the
   text once and its members.  A text that a third of all rows share thus leaves every task as a few rows.
2. These rows are dealt by hash into cells and written to spill files, a bucketed table in the shared folder, so that no later step
   shuffles texts again.  A cell whose distinct texts exceed TABLE_BYTES is dealt again, by another hash, into SPLIT cells, and
   so on until each cell fits a table or holds one hash only.  Cells that fit stay where they are.
3. Each cell goes through an open-addressing table that compares complete content: equal hashes alone never make two texts equal.
   A batch of the cell at a time is held, beside its distinct texts and 24 bytes for each row.
4. The members of the first step get the result of their row back, by its number; no text moves in this.

Of equal texts the row with the smallest doc_id stays.  A null doc_id comes after all others; of rows that repeat doc_id and text
one stays.  Empty and null texts are one group.  An empty table gives an empty one.  Extra columns of any
name are carried along, but for those of the result's names, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .steps import Scratch, stored

TABLE_BYTES = 64 << 20  #: distinct texts of a cell that one table takes
TASK_BYTES = 32 << 20  #: distinct texts that a task puts together before the spill
TASK_ROWS = 100_000  #: and rows
SPLIT = 16  #: cells that an oversized one is dealt into
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


class ContentTable:
    """Open addressing with linear probing; entries are told apart by their complete content."""

    def __init__(self):
        self.slots, self.codes, self.texts, self.n_bytes = [-1] * 1024, [], [], 0

    def entry(self, code: int, text: bytes) -> int:
        """The number of the text's entry, a new one if it isn't there yet."""
        mask = len(self.slots) - 1
        at = code & mask
        while (found := self.slots[at]) >= 0:
            if self.codes[found] == code and self.texts[found] == text:
                return found
            at = (at + 1) & mask
        self.slots[at] = len(self.texts)
        self.codes.append(code)
        self.texts.append(text)
        self.n_bytes += len(text)
        if 3 * len(self.texts) > 2 * len(self.slots):
            self._grow()
        return len(self.texts) - 1

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, code in enumerate(self.codes):
            at = code & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def normal_text(text: str = "text") -> Column:
    """The text with each run of white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _together(batches):
    """Rows (code, text, doc_id, member) of a task to rows (code, number, text, n_bytes, least, n, members), one for each text of a full table.

    The member of the smallest id comes first; numbers are unique among the rows of one code."""
    number = TaskContext.get().partitionId() << 32
    table, narrow, entries, rows = ContentTable(), [], [], 0

    def told():
        nonlocal number
        ids = pa.chunked_array([b.column("doc_id") for b in narrow]).to_pylist()
        entry = np.concatenate(entries)
        rank = np.array([x is None for x in ids]), np.array([x or 0 for x in ids], dtype=np.int64)
        order = np.lexsort((rank[1], rank[0], entry))
        bounds = np.searchsorted(entry[order], np.arange(len(table.texts) + 1)).astype(np.int32)
        members = pa.chunked_array([b.column("member") for b in narrow]).combine_chunks()
        if isinstance(members, pa.ChunkedArray):
            members = pa.concat_arrays(members.chunks)
        out = pa.record_batch(
            [
                pa.array(table.codes, pa.int64()),
                pa.array(np.arange(number, number + len(table.texts))),
                pa.array(table.texts, pa.binary()),
                pa.array([len(x) for x in table.texts], pa.int64()),
                pa.array([ids[i] for i in order[bounds[:-1]]], pa.int64()),
                pa.array(np.diff(bounds).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(bounds), members.take(pa.array(order))),
            ],
            names=["code", "number", "text", "n_bytes", "least", "n", "members"],
        )
        number += len(table.texts)
        return out

    for batch in batches:
        texts, codes = batch.column("text").to_pylist(), batch.column("code").to_pylist()
        at = 0
        while at < len(texts):
            found, start = [], at
            while at < len(texts) and table.n_bytes < TASK_BYTES and rows < TASK_ROWS:
                found.append(table.entry(codes[at], texts[at]))
                at, rows = at + 1, rows + 1
            narrow.append(batch.select(["doc_id", "member"]).slice(start, at - start))
            entries.append(np.array(found, dtype=np.int64))
            if at < len(texts):
                yield told()
                table, narrow, entries, rows = ContentTable(), [], [], 0
    if rows:
        yield told()


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one cell to (code, number, keep_id, keeper, group_size, text_sha256); keeper marks the row that holds the document that stays."""
    table = ContentTable()
    columns: list[list[np.ndarray]] = [[], [], [], []]
    least: list[tuple] = []  # by entry: (id is null, id, number) of the best row
    size: list[int] = []
    for batch in batches:
        code, number, low, n = (batch.column(c).to_pylist() for c in ("code", "number", "least", "n"))
        found = []
        for c, text, i, x, m in zip(code, batch.column("text").to_pylist(), number, low, n, strict=True):
            e = table.entry(c, text)
            rank = (x is None, x or 0, i)
            if e == len(size):
                least.append(rank)
                size.append(0)
            elif rank < least[e]:
                least[e] = rank
            size[e] += m
            found.append(e)
        for out, values in zip(columns, (code, number, found), strict=False):
            out.append(np.array(values, dtype=np.int64))
    if not size:
        return
    shas = np.array([hashlib.sha256(t).hexdigest() for t in table.texts], dtype=object)
    keep, keeper, sizes = np.array([None if r[0] else r[1] for r in least], dtype=object), np.array([r[2] for r in least]), np.array(size)
    for code, number, entry in zip(*columns[:3], strict=True):
        yield pa.record_batch([pa.array(code), pa.array(number), pa.array(keep[entry], pa.int64()), pa.array(keeper[entry] == number), pa.array(sizes[entry]), pa.array(shas[entry], pa.string())], names=["code", "number", "keep_id", "keeper", "group_size", "text_sha256"])


def exact_duplicates(documents: DataFrame, table_bytes: int = TABLE_BYTES, code: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """The documents' columns but the text, with keep_id, group_size, kept and text_sha256 (of the normalised text); one row for each row."""
    columns = [c for c in documents.columns if c != "text" and c not in RESULT]
    spark = documents.sparkSession
    with Scratch(spark) as made:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(f"`{c}`" for c in columns)).alias("member"), normal_text().alias("text"))
        docs = docs.select("doc_id", "member", code("text").alias("code"), F.col("text").cast("binary").alias("text"))
        told = [StructField(c, BinaryType() if c == "text" else LongType()) for c in ("code", "number", "text", "n_bytes", "least", "n")]
        rows = docs.mapInArrow(_together, StructType([*told, StructField("members", ArrayType(docs.schema["member"].dataType))]))
        rows = rows.withColumn("cell", F.pmod(F.xxhash64("code"), F.lit(4 * n)))
        parts, level = [], 0
        while True:
            spill = made.bucketed(rows, f"spill-{level}", n, "cell")
            kinds = spill.groupBy("cell", "code").agg(F.max("n_bytes").alias("b")).groupBy("cell").agg(F.sum("b").alias("b"), F.count("*").alias("kinds"))
            over = made.stored(kinds.filter((F.col("b") > table_bytes) & (F.col("kinds") > 1)).select("cell"), f"over-{level}")
            last = over.isEmpty()
            fits = spill if last else spill.join(over, "cell", "left_anti")
            found = fits.select("cell", "code", "number", "text", "least", "n").groupBy("cell").applyInArrow(_resolved, "code long, number long, keep_id long, keeper boolean, group_size long, text_sha256 string")
            parts.append(spill.select("code", "number", "members").join(found, ["code", "number"]))
            if last:
                break
            level += 1
            rows = spill.join(over, "cell", "left_semi").select(*rows.columns)
            rows = rows.withColumn("cell", F.col("cell") * SPLIT + F.pmod(F.xxhash64("code", F.lit(level)), F.lit(SPLIT)))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        out = out.select("keep_id", "keeper", "group_size", "text_sha256", F.posexplode("members").alias("at", "member"))
        kept = F.col("keeper") & (F.col("at") == 0)
        return stored(out.select(*(F.col(f"member.`{c}`").alias(c) for c in columns), "keep_id", "group_size", kept.alias("kept"), "text_sha256"), "copies")


def without_copies(documents: DataFrame, **how) -> DataFrame:
    """The documents that stay, whole; of rows that repeat doc_id and normalised text, one of them."""
    kept = exact_duplicates(documents.select("doc_id", "text"), **how).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    row = documents.select(F.struct(*(f"`{c}`" for c in documents.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.sha2(normal_text(), 256).alias("_sha"))
    same = row["_id"].eqNullSafe(kept["_id"]) & (row["_sha"] == kept["_sha"])
    return row.join(kept, same, "left_semi").dropDuplicates(["_id", "_sha"]).select("row.*")


def copies_digest(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_duplicates(documents.select("doc_id", "text"))


def copies_sql() -> str:
    return r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256 FROM t WINDOW w AS (PARTITION BY x)"""
