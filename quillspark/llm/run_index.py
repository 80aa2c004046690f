"""Exact removal of long repeats with a run-length index (suffix-array dedup).

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus.
Texts are UTF-8 bytes; matches never cross documents; a null text is empty.

Finding all repeats needs no index over the whole corpus.  Each window of `length` bytes has an
anchor, the leftmost of its k-byte strings with the least hash; equal windows have equal anchors.
The run of windows with one anchor is a *context*.
  0. Anchors are counted (partial aggregation), and contexts whose anchor comes once in the corpus are dropped.
  1. Contexts with equal bytes are counted (partial aggregation, also for a passage in a third of
     all documents): two or more places, and all their windows are repeats.
  2. Only anchors with several different contexts need a closer look.  One of each kind goes to the
     task of its anchor.  There, blocks of whole anchor groups get a run-length index: suffix order,
     Burrows-Wheeler transform cut into runs, match lengths sampled at run ends.  Streaming over
     the text, a match length is the last sample's minus the distance, so only run ends are compared.
  3. Anchors with more than GROUP kinds of contexts don't fit a block: their windows are counted by
     hash instead, which is exact as well.
Lineage is cut by written tables; no step keeps a document's repeats anywhere but in its own row.
Each row is a document of its own, with or without a doc_id, and also if others repeat it: rows are told apart by a 64-bit hash of
doc_id and text.  Rows that repeat both are repeats of each other.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import textcodes as tc
from .steps import Scratch, cuts, groups, stored

ANCHOR = 64  #: bytes of an anchor
GROUP = 4096  #: kinds of contexts of an anchor that are indexed together
BLOCK = 2 << 20  #: bytes of one index
_POS = np.uint64((1 << 28) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for every whole window."""
    n = len(x)
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """(row, first window, last window, anchor code, code of the covered bytes) of each context."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = tc.prefix_codes(data)
    at = np.arange(len(data) - anchor + 1)
    codes = tc.span_codes(prefix, at, at + anchor)
    least = (_sliding_min((codes & ~_POS) | at.astype(np.uint64), length - anchor + 1) & _POS).astype(np.int64)
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), windows)
    first = np.cumsum(windows) - windows
    starts = np.arange(len(rows)) - np.repeat(first, windows) + np.repeat(offsets[:-1], windows)
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    chosen = least[starts]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])])
    lo = starts[new]
    hi = starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
    row = rows[new]
    return row, lo - offsets[row], hi - offsets[row], codes[chosen[new]], tc.span_codes(prefix, lo, hi + length)


def _contexts(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.slices(batch, "text"):
                row, lo, hi, ah, ch = contexts(*tc.column_bytes(part.column("text")), length, anchor)
                ids = part.column("doc_id").to_numpy()
                yield pa.record_batch([pa.array(ids[row]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(ah.view(np.int64)), pa.array(ch.view(np.int64))], names=["doc_id", "lo", "hi", "ah", "ch"])

    return run


def _anchors(length: int, anchor: int):
    """The anchors of each document's contexts, once for each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.slices(batch, "text"):
                yield pa.record_batch([pa.array(contexts(*tc.column_bytes(part.column("text")), length, anchor)[3].view(np.int64))], names=["ah"])

    return run


_PARTS = "doc_id long, lo int, ah long, kinds long, bytes binary"


def _cut(length: int):
    """Documents with their open contexts to the contexts' bytes."""

    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "text"):
                out = {k: [] for k in ("doc_id", "lo", "ah", "kinds", "bytes")}
                for i, doc, spans in zip(range(part.num_rows), part.column("doc_id").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    data = tc.column_bytes(part.column("text").slice(i, 1))[0]
                    for s in spans:
                        out["doc_id"].append(doc)
                        out["lo"].append(s["lo"])
                        out["ah"].append(s["ah"])
                        out["kinds"].append(s["kinds"])
                        out["bytes"].append(data[s["lo"] : s["hi"] + length].tobytes())
                yield pa.record_batch([pa.array(out["doc_id"], pa.int64()), pa.array(out["lo"], pa.int32()), pa.array(out["ah"], pa.int64()), pa.array(out["kinds"], pa.int64()), pa.array(out["bytes"], pa.binary())], names=list(out))

    return run


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes, by prefix doubling; each round sorts only what is still tied."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key |= padded[j : j + n] << np.uint64(56 - 8 * j)
    order = np.argsort(key, kind="stable")
    heads = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    h = 8
    while True:
        single = heads & np.concatenate([heads[1:], [True]])
        open_ = np.flatnonzero(~single)
        if not len(open_) or h >= n:
            return order, rank
        at = order[open_]
        group, then = rank[at], rank[np.minimum(at + h, n)] + 1
        by = np.lexsort((then, group))
        at, group, then = at[by], group[by], then[by]
        order[open_] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        heads[open_] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, open_, 0))
        h *= 2


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b."""
    n = len(text)
    out = np.zeros(len(a), dtype=np.int64)
    left = np.arange(len(a))
    step = 16
    padded = np.concatenate([text.astype(np.int16), np.full(step, -1, np.int16)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, step)
    while len(left):
        x, y = a[left] + out[left], b[left] + out[left]
        inside = (x < n) & (y < n)
        left, x, y = left[inside], x[inside], y[inside]
        differ = lanes[x] != lanes[y]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), step)
        same = np.minimum(same, n - np.maximum(x, y))
        out[left] += same
        left = left[same == step]
    return out


def match_lengths(text: np.ndarray) -> np.ndarray:
    """For each position the longest match with another position of the text, by a run-length index."""
    n = len(text)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    order, _ = suffix_order(text)
    last = np.where(order > 0, text[order - 1].astype(np.int16), -1)  # the transform
    ends = np.flatnonzero(last[1:] != last[:-1])  # a run ends here, the next starts one further
    best = np.zeros(n, dtype=np.int64)
    at = np.arange(n)
    for this, other, edge in ((order[ends + 1], order[ends], order[0]), (order[ends], order[ends + 1], order[-1])):
        reach = np.zeros(n, dtype=np.int64)
        reach[this] = _common(text, this, other) + this
        reach[edge] = max(reach[edge], edge)
        best = np.maximum(best, np.maximum.accumulate(reach) - at)
    return best


def repeated_windows(docs: np.ndarray, los: np.ndarray, parts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(document, first byte, end) of the runs of repeated windows among some contexts."""
    by = np.lexsort((los, docs))
    pieces: list[bytes | bytearray] = []
    where: list[tuple[int, int]] = []
    for i in by:  # contexts of one document that touch become one segment: each place is in the index once
        doc, lo, part = int(docs[i]), int(los[i]), parts[i]
        if where and where[-1][0] == doc and lo <= where[-1][1] + len(pieces[-1]):
            pieces[-1] = pieces[-1] + part[where[-1][1] + len(pieces[-1]) - lo :]
        else:
            where.append((doc, lo))
            pieces.append(part)
    text = np.frombuffer(b"\xff".join(bytes(p) for p in pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes + 1) - sizes - 1
    matched = np.flatnonzero(match_lengths(text) >= length)
    seg = np.searchsorted(begins, matched, "right") - 1
    fits = matched + length <= begins[seg] + sizes[seg]
    matched, seg = matched[fits], seg[fits]
    if not len(matched):
        return []
    new = np.concatenate([[True], (matched[1:] != matched[:-1] + 1) | (seg[1:] != seg[:-1])])
    first = np.flatnonzero(new)
    end = np.concatenate([first[1:] - 1, [len(matched) - 1]])
    return [(where[seg[f]][0], where[seg[f]][1] + int(matched[f] - begins[seg[f]]), where[seg[f]][1] + int(matched[e] - begins[seg[f]]) + length) for f, e in zip(first, end, strict=True)]


def _spans_batch(spans: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*spans, strict=True)) or [[], [], []]
    return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["doc_id", "first", "end"])


def _indexed(length: int, block: int):
    """Whole anchor groups, in blocks, to spans of repeats."""

    def run(batches):
        for t in groups(batches, "ah"):
            at = cuts(t.column("ah").to_numpy())
            docs, los, parts = t.column("doc_id").to_numpy(), t.column("lo").to_numpy(), t.column("bytes").to_pylist()
            sizes = np.cumsum([0, *map(len, parts)])
            begin = 0
            for k in range(1, len(at)):
                if k == len(at) - 1 or sizes[at[k + 1]] - sizes[at[begin]] > block:
                    s, e = at[begin], at[k]
                    yield _spans_batch(repeated_windows(docs[s:e], los[s:e], parts[s:e], length))
                    begin = k

    return run


def _windows(length: int):
    def run(batches):
        for batch in batches:
            docs, los = batch.column("doc_id").to_numpy(), batch.column("lo").to_numpy()
            for i, part in enumerate(batch.column("bytes")):
                data = np.frombuffer(part.as_py(), dtype=np.uint8)
                at = np.arange(len(data) - length + 1)
                codes = tc.span_codes(tc.prefix_codes(data), at, at + length)
                yield pa.record_batch([pa.array(np.full(len(at), docs[i])), pa.array((los[i] + at).astype(np.int32)), pa.array(codes.view(np.int64))], names=["doc_id", "first", "code"])

    return run


def _keeps(least_bytes: int, over_words: int | None):
    """Cuts the runs of repeats of least_bytes bytes, or of more than over_words words."""

    def run(batches):
        return _kept(batches, lambda piece: len(piece) >= least_bytes or (over_words is not None and len(piece.split()) > over_words))

    return run


def _kept(batches, goes):
    """Rows (row, text, spans) to (row, n_bytes, n_removed, n_spans, kept)."""
    for batch in batches:
        for part in tc.slices(batch, "text"):
            rows = []
            for i, spans in enumerate(part.column("spans").to_pylist()):
                data = tc.column_bytes(part.column("text").slice(i, 1))[0]
                runs = []
                for s in sorted((s["first"], s["end"]) for s in spans or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                runs = [r for r in runs if goes(data[r[0] : r[1]].tobytes())]
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a].tobytes())
                    at = b
                kept = b"".join([*kept, data[at:].tobytes()])
                rows.append((len(data), len(data) - len(kept), len(runs), kept))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            numbers = [pa.array(c, pa.int64()) for c in cols[:3]]
            yield pa.record_batch([part.column("row"), *numbers, pa.array(cols[3], pa.binary())], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])


def _row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def repeat_spans(documents: DataFrame, length: int = 400, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id: the row's key, first, end): byte ranges that repeats cover; ranges may overlap.  See the module's text."""
    docs = documents.select(_row_key().alias("doc_id"), "text")
    long = docs.filter(F.octet_length("text") >= length)
    with Scratch(documents.sparkSession) as made:
        # most anchors come once; only the others' contexts are written
        twice = long.select("text").mapInArrow(_anchors(length, anchor), "ah long").groupBy("ah").agg(F.count("*").alias("n")).filter("n > 1").select("ah")
        twice = made.stored(twice, "anchors")
        rows = long.mapInArrow(_contexts(length, anchor), "doc_id long, lo int, hi int, ah long, ch long")
        rows = made.stored(rows.join(twice.hint("merge"), "ah", "left_semi"), "contexts")
        made.discard("anchors")
        kinds = made.stored(rows.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lo", "hi")).alias("at")), "kinds")
        copied = kinds.filter("n > 1").select("ah", "ch")
        spans = made.stored(rows.join(copied, ["ah", "ch"]).select("doc_id", F.col("lo").alias("first"), (F.col("hi") + length).cast("int").alias("end")), "whole")
        made.discard("contexts")
        several = kinds.groupBy("ah").agg(F.count("*").alias("kinds")).filter("kinds > 1")
        wanted = kinds.join(several, "ah").select("at.doc_id", F.struct("at.lo", "at.hi", "ah", "kinds").alias("span"))
        wanted = made.stored(wanted.groupBy("doc_id").agg(F.collect_list("span").alias("spans")), "open")
        made.discard("kinds")
        parts = made.stored(docs.join(wanted, "doc_id").mapInArrow(_cut(length), _PARTS), "parts")
        made.discard("open")
        few = parts.filter(F.col("kinds") <= GROUP).repartition("ah").sortWithinPartitions("ah").mapInArrow(_indexed(length, BLOCK), "doc_id long, first int, end int")
        spans = spans.union(few)
        many = parts.filter(F.col("kinds") > GROUP)
        if many.limit(1).count():
            windows = made.stored(many.mapInArrow(_windows(length), "doc_id long, first int, code long").distinct(), "windows")
            twice = windows.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").select("code")
            spans = spans.union(windows.join(twice, "code").select("doc_id", "first", (F.col("first") + length).cast("int").alias("end")))
        return stored(spans, "spans")


def drop_repeats(documents: DataFrame, length: int = 400, anchor: int = ANCHOR, least_bytes: int = 0, over_words: int | None = None) -> DataFrame:
    """One row per document: row (a struct of all its columns but the text), n_bytes, n_removed, n_spans (maximal removed
    runs) and kept (the bytes left, joined).

    An empty table, empty and null texts, and texts shorter than `length` lose nothing.  Of the runs, only those of least_bytes bytes or, if given, of more than over_words words go."""
    spans = repeat_spans(documents, length, anchor)
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "end")).alias("spans")).withColumnRenamed("doc_id", "id")
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != "text"), F.col("text").isNull().alias("text"))
    docs = documents.select(row.alias("row"), _row_key().alias("id"), "text")
    added = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept", BinaryType())]
    return docs.join(by_doc, "id", "left").select("row", "text", "spans").mapInArrow(_keeps(least_bytes, over_words), StructType([docs.schema["row"], *added]))


def texts_without_repeats(documents: DataFrame, length: int = 400, anchor: int = ANCHOR, least_bytes: int = 0, over_words: int | None = None) -> DataFrame:
    """The documents, all of them, with the text that is left; a character that was cut apart goes as a whole.

    Columns may have any name."""
    cut = drop_repeats(documents, length, anchor, least_bytes, over_words)
    return cut.select(*(_left().alias(c) if c == "text" else F.col(f"row.`{c}`") for c in documents.columns))


def _left():
    """The text that is left; null if there was none."""
    return F.when(F.col("row.text"), F.lit(None).cast("string")).when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(_whole_characters("kept"))


def _whole_characters(kept: str):
    """The bytes as text.  What is not a whole character becomes U+FFFD in between, marked so that one of the text's own stays."""
    own, mark = "\ufffd", "\ue5e5\ue5e5"
    text = F.replace(F.col(kept).cast("string"), F.lit(own), F.lit(mark))
    return F.replace(F.replace(F.make_valid_utf8(text), F.lit(own), F.lit("")), F.lit(mark), F.lit(own))


def repeat_digest(documents: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the SHA-256 of the bytes kept, and the text that is left."""
    cut = drop_repeats(documents.select("doc_id", "text"), length)
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), _left().alias("text"))
