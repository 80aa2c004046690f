"""Importance resampling towards a target distribution, with a dictionary of distinct features.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; features are all runs of 1 to LONGEST words, joined by one space.
A bucket's gain is floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))), with s of all S features of the documents and t of all T of the target
in it; a document's weight is the sum of its features' gains, and its score the weight and a Gumbel term from its doc_id.

1. Each task counts features by document over slices of SLICE_BYTES of text: a slice's distinct strings with
   their counts, and for each document the numbers of its strings in that list, as gaps, with counts.  This table is written; texts are read once.
2. The slices' strings are counted over all slices, and each distinct string is hashed once.  Counts are summed by bucket: BUCKETS rows at most.
3. The strings of a slice get their gains from the dictionary.  A string comes once a slice, so that the commonest word is as many
   rows as there are slices, not documents; slices then meet their gains in tasks of their own.
4. Scores are sorted over all partitions; a rank is the number of rows in the partitions before, and of those before it in its own.

Null and empty texts have no feature and weight 0.  Documents of LEAST_WORDS words or more take part in the draw; ties go to the smaller doc_id, null ids last
(their Gumbel term is that of an empty id).  Rows that repeat an id are documents of their own.  An empty table gives an empty
one, an empty target weighs all documents.  Extra columns of any name are carried along, but for those of the result's names, which are replaced.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import textcodes as tc
from .steps import Scratch, stored

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SLICE_BYTES = 16 << 20
RESULT = ("n_features", "weight", "score", "rank")
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _features(part: pa.RecordBatch, longest: int) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Words of each row; the row of each feature, and all features, as numbers in the list of distinct ones."""
    data, offsets = tc.column_bytes(part.column("text"))
    data = _LOWER[data]
    word = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])[: len(word)]))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]])[: len(word)])) + 1
    n_words = np.diff(np.searchsorted(starts, offsets))
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    features = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[word])])
    rows = [np.repeat(np.arange(len(n_words)), n_words)]
    if longest > 1:
        words, of, grams = features.to_pylist(), rows[0], []
        for n in range(2, longest + 1):
            inside = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if len(of) >= n else np.zeros(0, dtype=np.int64)
            grams += [b" ".join(words[i : i + n]) for i in inside.tolist()]
            rows.append(of[inside])
        features = pa.concat_arrays([features, pa.array(grams, pa.binary())])
    return n_words, np.concatenate(rows), features.dictionary_encode()


def _sliced(longest: int):
    """Rows (row, text) to (slice, row, n_words, at, times); the first of a slice also has its strings and counts."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in tc.slices(batch, "text", SLICE_BYTES):
                n_words, rows, features = _features(part, longest)
                codes, n = features.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(features.dictionary))
                pairs, times = np.unique(rows * n + codes, return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(len(n_words) + 1) * n)
                at = pairs % n
                gaps, firsts = np.diff(at, prepend=0), bounds[:-1][bounds[:-1] < bounds[1:]]
                gaps[firsts] = at[firsts]
                gaps, times = gaps.astype(np.int32), times.astype(np.int32)
                empty = [None] * (len(n_words) - 1)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(n_words), number)),
                        part.column("row"),
                        pa.array(n_words, pa.int64()),
                        *(pa.array([x[a:b].tobytes() for a, b in pairwise(bounds)], pa.binary()) for x in (gaps, times)),
                        pa.array([features.dictionary.to_pylist(), *empty], pa.list_(pa.binary())),
                        pa.array([np.bincount(codes, minlength=len(features.dictionary)).tolist(), *empty], pa.list_(pa.int64())),
                    ],
                    names=["slice", "row", "n_words", "at", "times", "strings", "totals"],
                )
                number += 1

    return run


def _weighed(docs: pa.Table, gains: pa.Table) -> pa.Table:
    """Documents of one slice and the gains of its strings to (row, n_words, n_features, weight)."""
    gain = np.zeros(gains.num_rows, dtype=np.int64)
    gain[gains.column("at").to_numpy()] = gains.column("gain").to_numpy()
    weight, n = [], []
    for at, times in zip(docs.column("at").to_pylist(), docs.column("times").to_pylist(), strict=True):
        times = np.frombuffer(times, np.int32).astype(np.int64)
        weight.append(int((gain[np.cumsum(np.frombuffer(at, np.int32))] * times).sum()))
        n.append(int(times.sum()))
    return pa.table([docs.column("row"), docs.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["row", "n_words", "n_features", "weight"])


def _long(*names: str) -> list[StructField]:
    return [StructField(c, LongType()) for c in names]


def _strings(slices: DataFrame) -> DataFrame:
    """(slice, at, string, total) of the slices."""
    rows = slices.filter("strings is not null").select("slice", F.posexplode(F.arrays_zip("strings", "totals")).alias("at", "s"))
    return rows.select("slice", "at", F.col("s.strings").alias("string"), F.col("s.totals").alias("total"))


def weights(documents: DataFrame, target: DataFrame, made: Scratch, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(row, n_words, n_features, weight) for each document; row holds its columns but the text."""

    def sliced(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.struct(*(f"`{c}`" for c in df.columns if c != "text")).alias("row"), F.col("text").cast("binary").alias("text"))
        return made.stored(rows.mapInArrow(_sliced(longest), StructType([*_long("slice"), rows.schema["row"], *_long("n_words"), *(StructField(c, BinaryType()) for c in ("at", "times")), StructField("strings", ArrayType(BinaryType())), StructField("totals", ArrayType(LongType()))])), name)

    docs, aims = sliced(documents, "documents"), sliced(target.select("text", F.lit(0).alias("of")), "target")
    both = _strings(docs).select("string", F.col("total").alias("s"), F.lit(0).cast("long").alias("t")).union(_strings(aims).select("string", F.lit(0).cast("long"), "total"))
    known = made.stored(both.groupBy("string").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", F.crc32("string") % buckets), "dictionary")
    sums = made.stored(known.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    all_s, all_t = sums.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    gain = F.floor(1000 * F.log((F.col("t") + 1.0) * float(all_s + buckets) / ((F.col("s") + 1.0) * float(all_t + buckets))))
    gains = known.select("string", "bucket").join(F.broadcast(sums.select("bucket", gain.cast("long").alias("gain"))), "bucket").select("string", "gain")  # as many rows as there are buckets
    got = _strings(docs).select("slice", "at", "string").join(gains, "string").select(F.col("slice").alias("of"), "at", "gain")
    return docs.select("slice", "row", "n_words", "at", "times").groupBy("slice").cogroup(got.groupBy("of")).applyInArrow(_weighed, StructType([docs.schema["row"], *_long("n_words", "n_features", "weight")]))


def resampling(documents: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The documents' columns but the text, with n_features, weight, score and rank (null where not drawn)."""
    columns = [c for c in documents.columns if c not in (*RESULT, "text")]
    spark = documents.sparkSession
    with Scratch(spark) as made:
        rows = weights(documents.select(*(f"`{c}`" for c in columns), "text"), target, made, longest, buckets)
        doc_id = F.col("row.doc_id").cast("long")
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
        score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
        rows = made.stored(rows.select("row", "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("able"), doc_id.alias("id")), "scores")
        drawn = percent * rows.filter("able").count() // 100
        order = [F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last()]
        dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        dealt = made.stored(dealt.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}), "sorted")
        sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
        before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        rank = F.col("before") + F.col("at") + 1
        out = dealt.join(F.broadcast(before), "part").select(*(F.col(f"row.`{c}`").alias(c) for c in columns), "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
        return stored(out, "resampling")


def resample(documents: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents, whole; rows that repeat a drawn id come with it."""
    ids = resampling(documents.select("doc_id", "text"), target, **how).filter("rank is not null").select("doc_id").distinct()
    return documents.join(ids, documents["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")


def resampling_digest(documents: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank."""
    return resampling(documents.select("doc_id", "text"), target.select("text"))


def resampling_sql() -> str:
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda i: (strpos('0123456789ABCDEF', substr(hex(encode(f)), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(f)), 2 * i + 2, 1)) - 1)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
    words = lambda t: f"SELECT {t}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f"
    h = f"('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT"
    return rf"""WITH d AS ({words("doc_id")} FROM documents), b AS ({words("1")} FROM benchmark),
v AS (SELECT f, {crc} % {BUCKETS} AS bucket FROM (SELECT f FROM d UNION SELECT f FROM b)),
s AS (SELECT bucket, count(*) AS s FROM d JOIN v USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (f) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN v USING (f) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT documents.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({h.replace("doc_id", "documents.doc_id")} + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents LEFT JOIN w ON w.doc_id = documents.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS i FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND i <= {PERCENT} * (SELECT count(*) FROM x WHERE n_features >= {LEAST_WORDS}) // 100 THEN i END AS rank FROM r"""
