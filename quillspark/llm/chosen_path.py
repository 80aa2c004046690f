"""MinHash near-duplicate detection as a chosen-path set similarity join.

Documents are sets of word shingles.  Independent trees branch them by minwise tokens: a node picks
a few coordinates of the MinHash signature by a hash of its path, and a document goes to the child
named by (node, coordinate, its value there); the first two levels are taken in one step.  Nodes with few documents are leaves; larger ones
branch again, up to a fixed depth.  Leaves are compared by signature, and every candidate link is
confirmed on the full shingle sets.

What keeps the work linear in a group of near copies:
  1. Each node of the first tree's first level links its documents to its most central member.  The pairs near by signature
     give components to begin with, and only nodes with several components are looked at from then on, in all trees: a
     group whose copies are all joined is dropped from every node at once, by a partial aggregation, before any join.
  2. Where one component crowds a node (more than LEAF members and half of it), only the others go on.  The crowd waits in one cell of
     its own, whatever the number of nodes that it fills, and the others visit it there.
  3. A cell with many documents is cut into blocks of residents and of visitors, and each pair of two such blocks is
     a cell, so nothing is capped.  A document is in a cell once, not once for each pair.
Steps 1 to 3 run twice: by signature over all documents, which leaves those that have a neighbour at all, then for these with the
components that their full sets confirm.  So texts are shuffled once, for documents with neighbours.

Null or wordless texts have no set and are linked with nothing.  Equal sets (repeated rows, copies)
are one class from the start and are never paired.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcodes as tc
from .components import components
from .steps import Scratch, cuts, groups, stored

COORDINATES = 256  #: of the signature, 16 bits each
TREES = 4
ROOT_BRANCHES = 4  #: children of a root, each by two coordinates of 64 bits; 16 in all: a pair at 0.8 misses all of them once in 1e7
BRANCHES = 2  #: coordinates of the signature an inner node picks
LEAF = 96  #: documents up to which a node is a leaf
BLOCK = 1024  #: residents or visitors whose signatures are compared at a time
SHINGLES = 1_000_000  #: of residents or visitors whose full sets are compared at a time (one set may be larger)
DEPTH = 3
MARGIN = 4.5  #: standard deviations of the signature's estimate below the threshold that are still confirmed

_MUL = np.random.default_rng(77).integers(1, 1 << 63, COORDINATES + 2 * TREES * ROOT_BRANCHES, dtype=np.uint64) | np.uint64(1)


def signatures(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nodes below the roots, (rows, 16), and its minwise values, (rows, COORDINATES) of 16 bits."""
    roots = np.empty((len(bounds) - 1, 2 * TREES * ROOT_BRANCHES), dtype=np.uint64)
    out = np.empty((len(bounds) - 1, COORDINATES), dtype=np.uint16)
    for k, mul in enumerate(_MUL):
        least = tc.mix(tc.row_reduce(np.minimum, codes * mul, bounds, 0))  # the 16 bits are the value's hash, not its low or high end
        if k < COORDINATES:
            out[:, k] = least >> np.uint64(48)
        else:
            roots[:, k - COORDINATES] = least
    nodes = tc.mix(tc.mix(roots[:, ::2] + np.arange(1, TREES * ROOT_BRANCHES + 1, dtype=np.uint64)) ^ roots[:, 1::2])
    return nodes, out


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.slices(batch, "text"):
                words = tc.Words(*tc.column_bytes(part.column("text")))
                codes, bounds = tc.distinct_by_row(*tc.gram_codes(words, size))
                n = np.diff(bounds)
                one = tc.row_reduce(np.add, tc.mix(codes), bounds, 0)
                two = tc.row_reduce(np.add, tc.mix(codes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds, 0)
                roots, sig = signatures(codes, bounds)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([r.tobytes() for r in roots], pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "roots", "sig"],
                )

    return run


def _sig(column) -> np.ndarray:
    return np.frombuffer(tc.column_bytes(column)[0], dtype=np.uint16).reshape(-1, COORDINATES)


def _roots(trees: int):
    """Rows (rep, component, roots) to rows (rep, component, node) of the first trees' roots' children."""

    def run(batches):
        for batch in batches:
            nodes = np.frombuffer(tc.column_bytes(batch.column("roots"))[0], dtype=np.int64).reshape(-1, TREES * ROOT_BRANCHES)[:, : trees * ROOT_BRANCHES]
            ids = (np.repeat(batch.column(c).to_numpy(), trees * ROOT_BRANCHES) for c in ("rep", "component"))
            yield pa.record_batch([*map(pa.array, ids), pa.array(nodes.ravel())], names=["rep", "component", "node"])

    return run


def _branch(batches):
    """Rows (rep, component, node, sig) to rows (rep, component, node) of the children."""
    for batch in batches:
        reps, comps, sig = batch.column("rep").to_numpy(), batch.column("component").to_numpy(), _sig(batch.column("sig"))
        nodes = batch.column("node").to_numpy().view(np.uint64)
        made = []
        for b in range(BRANCHES):
            pick = ((tc.mix(nodes ^ np.uint64(0x51)) + np.uint64(b * 37)) % np.uint64(COORDINATES)).astype(np.int64)
            value = sig[np.arange(len(reps)), pick].astype(np.uint64)
            made.append(tc.mix(tc.mix(nodes) ^ (pick.astype(np.uint64) << np.uint64(40)) ^ value))
        yield pa.record_batch([pa.array(np.tile(reps, BRANCHES)), pa.array(np.tile(comps, BRANCHES)), pa.array(np.concatenate(made).view(np.int64))], names=["rep", "component", "node"])


def _central(batches):
    """The member of each node whose signature agrees best with its most frequent values."""
    for t in groups(batches, "node"):
        nodes, reps, sig = t.column("node").to_numpy(), t.column("rep").to_numpy(), _sig(t.column("sig"))
        at = cuts(nodes)
        best = []
        for s, e in zip(at[:-1], at[1:], strict=True):
            if e - s == 2:  # they agree with each other's values as well
                best.append(s + int(reps[s] > reps[s + 1]))
                continue
            m = sig[s:e]
            agree = np.zeros(e - s)
            for k in range(0, COORDINATES, 4):
                _, inverse, count = np.unique(m[:, k], return_inverse=True, return_counts=True)
                agree += count[inverse]
            best.append(s + np.lexsort((reps[s:e], -agree))[0])
        yield pa.record_batch([pa.array(nodes[best]), pa.array(reps[best]), pa.array([sig[i].tobytes() for i in best], pa.binary())], names=["node", "center", "sig_center"])


def _near(least: float):
    """Rows (rep, center, sig, sig_center) to (rep, center, share) where the signatures agree in a share of at least `least`."""

    def run(batches):
        for batch in batches:
            share = (_sig(batch.column("sig")) == _sig(batch.column("sig_center"))).mean(axis=1)
            keep = pa.array(share >= least)
            yield pa.record_batch([batch.column("rep"), batch.column("center"), pa.array(share)], names=["rep", "center", "share"]).filter(keep)

    return run


def _involved(least: float):
    """The documents of a cell with a partner there that is near by signature and in another component."""

    def run(batches):
        for t in groups(batches, "cell"):
            cells, reps, comps, sides, n = (t.column(c).to_numpy() for c in ("cell", "rep", "component", "side", "n"))
            sig = _sig(t.column("sig"))
            at = cuts(cells)
            keep = np.zeros(len(cells), dtype=bool)
            for s, e in zip(at[:-1], at[1:], strict=True):
                c, side, m = comps[s:e], sides[s:e], sig[s:e]
                names, count = np.unique(c, return_counts=True)
                if len(names) == 1:
                    continue
                main = c == names[count.argmax()]  # pairs within the largest component need no look: all others have one end outside
                rest = ~main
                for i in np.flatnonzero(rest):
                    rest[i] = False
                    other = np.flatnonzero((c != c[i]) & ((side != side[i]) | (side == 2)) & (rest | main))
                    near = other[(m[other] == m[i]).mean(axis=1) >= least]
                    if len(near):
                        keep[s + near] = keep[s + i] = True
            yield pa.record_batch([pa.array(x[keep]) for x in (cells, reps, comps, sides, n)], names=["cell", "rep", "component", "side", "n"])

    return run


def _linked(size: int, percent: int):
    """Cells of documents with their texts to links between components (their names), by the full sets.

    A document's set is compared with all others of the cell at once; a pair whose ends the cell has already joined
    needs no look, so a cell gives fewer links than it has documents."""

    def run(batches):
        for t in groups(batches, "cell"):
            cells, reps, comps, sides = (t.column(c).to_numpy() for c in ("cell", "rep", "component", "side"))
            at = cuts(cells)
            a, b = [], []
            for s, e in zip(at[:-1], at[1:], strict=True):
                codes, bounds = tc.distinct_by_row(*tc.gram_codes(tc.Words(*tc.column_bytes(t.column("text").slice(s, e - s))), size))
                known, codes = np.unique(codes, return_inverse=True)
                n, side = np.diff(bounds), sides[s:e]
                _, group = np.unique(comps[s:e], return_inverse=True)
                mark = np.zeros(len(known), dtype=np.int32)
                main = np.bincount(group).argmax()
                for i in np.argsort(group == main, kind="stable"):
                    if group[i] == main and (group == main).all():
                        break
                    open_ = (group != group[i]) & ((side != side[i]) | (side == 2))
                    if not open_.any():
                        continue
                    own = codes[bounds[i] : bounds[i + 1]]
                    mark[own] = 1
                    same = np.add.reduceat(mark[codes], bounds[:-1])
                    mark[own] = 0
                    for j in np.flatnonzero(open_ & (100 * same >= percent * (n + n[i] - same))):
                        if group[i] != group[j]:
                            group[group == group[j]] = group[i]
                # a star of the old components around the smallest one they are now joined with
                order = np.lexsort((comps[s:e], group))
                least = comps[s:e][order][cuts(group[order])[:-1]]
                hub = np.repeat(least, np.diff(cuts(group[order])))
                old = comps[s:e][order]
                new = np.unique(np.stack([hub, old], axis=1)[hub != old], axis=0)
                a += new[:, 0].tolist()
                b += new[:, 1].tolist()
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _confirm(size: int, percent: int):
    """Keep the pairs whose full shingle sets reach the similarity."""

    def one(column, i: int) -> np.ndarray:
        words = tc.Words(*tc.column_bytes(column.slice(i, 1)))
        return np.unique(tc.gram_codes(words, size)[0])

    def run(batches):
        kept: tuple[int, np.ndarray] | None = None
        for batch in batches:
            hits = []
            ids = batch.column("a").to_pylist()
            for i, a in enumerate(ids):
                if kept is None or kept[0] != a:
                    kept = (a, one(batch.column("text_a"), i))
                x, y = kept[1], one(batch.column("text_b"), i)
                same = int(np.isin(x, y, assume_unique=True).sum()) if len(x) < len(y) else int(np.isin(y, x, assume_unique=True).sum())
                hits.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.filter(pa.array(hits, pa.bool_())).select(["a", "b"])

    return run


def confirmed(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by their whole texts(rep, text)."""
    one, two = (texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return stored(pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a long, b long"), "confirmed")


def _dealt(rows: DataFrame, weight, limit: int) -> DataFrame:
    """Rows (cell, rep, component, side, ...) dealt to smaller cells: residents (side 0) and visitors (1; both: 2) of a cell
    are cut by their ids into blocks of about `limit` of the weight, and each pair of two such blocks is a cell."""
    block = lambda side: F.ceil(F.sum(F.when(F.col("side") != side, weight).otherwise(0)) / limit).cast("long")
    wide = rows.groupBy("cell").agg(block(1).alias("res"), block(0).alias("vis"))
    rows = rows.join(wide, "cell")
    numbers = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    home, call = F.pmod(F.xxhash64("rep"), F.col("res")), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("vis"))
    stays = F.when(F.col("side") != 1, F.transform(numbers("vis"), lambda v: F.struct(home.alias("r"), v.alias("v")))).otherwise(F.array())
    visits = F.when(F.col("side") != 0, F.transform(numbers("res"), lambda r: F.struct(r.alias("r"), call.alias("v")))).otherwise(F.array())
    rows = rows.filter("res > 0 and vis > 0").select("*", home.alias("home"), call.alias("call"), F.explode(F.array_distinct(F.concat(stays, visits))).alias("at"))
    at_home, at_call = (F.col("side") != 1) & (F.col("at.r") == F.col("home")), (F.col("side") != 0) & (F.col("at.v") == F.col("call"))
    side = F.when(at_home & at_call, 2).when(at_home, 0).otherwise(1)
    return rows.withColumn("side", side).withColumn("cell", F.xxhash64("cell", "at.r", "at.v")).drop("home", "call", "at", "res", "vis")


def stars(classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) near by signature: each class with the best of the centers of its nodes in the first tree, and that one with the others.

    A node's center is found among LEAF or so of its members, picked by a hash."""
    with Scratch(classes.sparkSession) as made:
        rows = classes.select("rep", F.col("rep").alias("component"), "roots").mapInArrow(_roots(1), "rep long, component long, node long").select("rep", "node")
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        rows = made.stored(rows.join(sizes, "node").join(classes.select("rep", "sig"), "rep"), "first-tree")
        sample = rows.filter(F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("size") / LEAF)) == 0).select("node", "rep", "sig")
        centers = sample.repartition("node").sortWithinPartitions("node").mapInArrow(_central, "node long, center long, sig_center binary")
        near = rows.join(centers, "node").filter("rep <> center").select("rep", "center", "sig", "sig_center").mapInArrow(_near(least), "rep long, center long, share double")
        own = near.groupBy("rep").agg(F.max(F.struct("share", "center"))["center"].alias("best"), F.collect_set("center").alias("centers"))  # four centers at most
        # itself a center of some node, and other documents' best: the links between centers join their stars
        pairs = own.select("best", F.explode(F.array_append(F.filter("centers", lambda c: c != F.col("best")), F.col("rep"))).alias("other"))
        return stored(pairs.select(F.least("best", "other").alias("a"), F.greatest("best", "other").alias("b")).distinct(), "pairs")


def unsettled(docs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Documents (rep, component, roots) that share a leaf with one of another component and are near it by signature:
    rows (cell, rep, component, side, n) in which those of a cell are to be compared.  sets: (rep, n, sig)."""
    with Scratch(docs.sparkSession) as made:
        rows = docs.mapInArrow(_roots(TREES), "rep long, component long, node long")
        leaves, visits = None, None
        for depth in range(DEPTH):
            rows = made.stored(rows, f"nodes-{depth}")
            parts = rows.groupBy("node", "component").agg(F.count("*").alias("many"), *(F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"x{k}") for k in (0, 1)))
            mixed = parts.groupBy("node").agg(F.max_by("component", "many").alias("main"), F.max("many").alias("many"), F.sum("many").alias("size"), F.count("*").alias("parts"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"))
            crowd = F.expr(f"many > {LEAF} and 2 * many >= size")
            leaf = F.lit(True) if depth == DEPTH - 1 else F.when(crowd, F.col("size") - F.col("many")).otherwise(F.col("size")) <= LEAF
            # leaves with equal members count once
            mixed = mixed.filter("parts > 1").withColumn("leaf", leaf).groupBy("size", "x0", "x1", F.when(~F.col("leaf"), F.col("node")).alias("own"))
            mixed = mixed.agg(F.min(F.struct("node", "main", "many", "leaf")).alias("one")).select("size", "one.*")
            rows = made.stored(rows.join(mixed, "node").filter(~crowd | (F.col("component") != F.col("main"))), f"mixed-{depth}")
            made.discard(f"nodes-{depth}")
            ends = rows.filter("leaf").select(F.col("node").alias("cell"), "rep", "component", F.when(F.col("component") == F.col("main"), 0).otherwise(2).alias("side"))
            calls = rows.filter(crowd).select("rep", "component", "main")
            leaves, visits = (ends, calls) if leaves is None else (leaves.union(ends), visits.union(calls))
            rows = rows.filter("not leaf")
            if depth == DEPTH - 1 or rows.limit(1).count() == 0:
                break
            rows = rows.select("rep", "component", "node").join(sets.select("rep", "sig"), "rep").mapInArrow(_branch, "rep long, component long, node long").distinct()
        if visits.limit(1).count():
            # a crowd is in one cell of its own, once, whatever the number of nodes that it fills
            visits = visits.distinct()
            name = lambda c: F.xxhash64(c, F.lit("crowd")).alias("cell")
            at_home = docs.select("rep", "component").join(visits.select(F.col("main").alias("component")).distinct(), "component", "left_semi")
            leaves = leaves.union(visits.select(name("main"), "rep", "component", F.lit(1))).union(at_home.select(name("component"), "rep", "component", F.lit(0)))
        cells = _dealt(made.stored(leaves, "cells"), F.lit(1), BLOCK).join(sets, "rep")
        return stored(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_involved(least), "cell long, rep long, component long, side int, n long"), "involved")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and class_id, the smallest id with an equal set.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| on distinct shingles of `shingle` words; a text
    with fewer words has its whole sequence as one.  component_id is the smallest doc_id reachable by links.
    An id that comes with several texts is linked by any of them, each row has the n_shingles of its own.
    Rows with a null doc_id are linked with nothing: their component_id and class_id are null, and they are kept.
    Other columns of the input, whatever their names, are not read."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    described = stored(docs.mapInArrow(_describe(shingle), "doc_id long, n long, h1 long, h2 long, roots binary, sig binary"), "described")
    classes = described.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("roots").alias("roots"), F.first("sig").alias("sig"))
    classes = stored(classes, "classes")
    least = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / COORDINATES) ** 0.5

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    with Scratch(documents.sparkSession) as made:
        # by signature only: which documents have a neighbour at all
        pairs = stars(classes, least)
        guess = labelled(classes.select("rep", "roots"), components(pairs))
        near = unsettled(guess.select("rep", "component", "roots"), classes.select("rep", "n", "sig"), least).select("rep")
        near = made.stored(near.union(pairs.select("a")).union(pairs.select("b")).distinct(), "near")
        # the texts are shuffled for them once, at every size: what has neighbours grows with the input
        texts = docs.withColumnRenamed("doc_id", "rep").join(near.hint("merge"), "rep", "left_semi").distinct()
        texts = made.stored(texts, "texts")
        few = made.stored(classes.select("rep", "n", "roots", "sig").join(near, "rep", "left_semi"), "classes")
        # by the full sets
        links = confirmed(texts, pairs, shingle, percent)
        labels = components(links)
        again = labelled(few.select("rep", "roots"), labels).select("rep", "component", "roots")
        open_ = _dealt(unsettled(again, few.select("rep", "n", "sig"), least), F.col("n"), SHINGLES)
        fresh = open_.join(texts, "rep").repartition("cell").sortWithinPartitions("cell").mapInArrow(_linked(shingle, percent), "a long, b long")
        merged = components(fresh).select(F.col("id").alias("component"), F.col("component").alias("into"))  # names of components are their smallest ids
    whole = labelled(classes.select("rep", "h1", "h2", "n"), labels).join(merged, "component", "left").withColumn("component", F.coalesce("into", "component"))
    out = described.select("doc_id", "n", "h1", "h2").join(whole, ["h1", "h2", "n"], "left")
    named = F.col("doc_id").isNotNull()
    component = F.when(named, F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (~named | (component == F.col("doc_id"))).alias("kept"), F.when(named, F.coalesce("rep", "doc_id")).alias("class_id"))
