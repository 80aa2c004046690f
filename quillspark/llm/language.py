"""Language identification by cross-parsing entropy with suffix automata.

For each language a suffix automaton holds a bounded sample of labelled text: rows that are not held
out, those with the least hash in each of SAMPLE_ROWS buckets, joined and cut at BYTES_PER_LANGUAGE bytes
(at most BYTES_IN_ALL over all languages; both are documented parameters).  A text is parsed greedily
into the longest phrases that occur in the sample; few phrases mean little cross entropy.  The
language with the fewest phrases, normalised by its sample's size, wins; ties go to the smaller name.

Bytes are put into classes first: A-Z lower-cased, digits, white space, other ASCII marks, and the bytes
of other characters that the samples hold.  The automaton becomes a dense table of transitions in which a
missing one ends the phrase.  Whole texts are parsed, in chunks of CHUNK bytes that run side by side;
no phrase crosses a chunk's end.  The score is 1 - fewest / second fewest (1 with one language only).

A text that is null or without a letter is `und` with score 0, as is every text if there is nothing to learn
from.  Labels are read in training only.  Repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import textcodes as tc
from .steps import held_out

SAMPLE_ROWS = 24
ROW_CHARS = 4_000  #: longer labelled rows are passed over in training where there are shorter ones
BYTES_PER_LANGUAGE = 30_000
BYTES_IN_ALL = 240_000
CHUNK = 1_024
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def byte_classes(samples: dict[str, bytes]) -> np.ndarray:
    """The class of each byte; class 0 is for bytes that no sample holds."""
    out = np.zeros(256, dtype=np.uint8)
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
    out[48:58] = 2
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = 3
    for i in range(26):
        out[65 + i] = out[97 + i] = 4 + i
    seen = sorted({b for s in samples.values() for b in s if b >= 128})
    out[seen] = 30 + np.arange(len(seen))
    return out


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of the symbols, as a flat table.

    Entry [state * width + symbol] is 2 * (next state * width) + (1 if a phrase ended before the symbol)."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in symbols:
        now = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    table = np.full((len(link), width), 1, dtype=np.int32)
    for c, target in step[0].items():
        table[:, c] = 2 * target * width + 1
    for s, moves in enumerate(step):
        for c, target in moves.items():
            table[s, c] = 2 * target * width
    return table.ravel()


def phrases(table: np.ndarray, width: int, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each chunk; chunks are in descending order of length."""
    count = np.ones(len(starts), dtype=np.int32)
    state = np.zeros(len(starts), dtype=np.int32)
    for j in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -j, "left"))
        got = table[state[:live] + symbols[starts[:live] + j]]
        count[:live] += got & 1
        state[:live] = got >> 1
    return count


def learn(documents: DataFrame) -> dict[str, bytes]:
    """The sample of each language, as bytes."""
    rows = documents.select(F.col("doc_id").cast("long"), "text", "lang").filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    order = F.struct((F.char_length("text") > ROW_CHARS).cast("int"), (F.char_length("text") < 200).cast("int"), F.xxhash64("doc_id"), "doc_id")
    bucket = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(SAMPLE_ROWS))
    chosen = rows.groupBy("lang", bucket.alias("bucket")).agg(F.min_by(F.struct("text"), order).alias("row"))
    by: dict[str, list[bytes]] = {}
    for r in chosen.orderBy("lang", "bucket").toLocalIterator():
        by.setdefault(r["lang"], []).append(r["row"]["text"].encode()[:BYTES_PER_LANGUAGE])
    most = min(BYTES_PER_LANGUAGE, BYTES_IN_ALL // max(1, len(by)))
    return {k: b"\n".join(v)[:most] for k, v in sorted(by.items())}


def _predict(samples: dict[str, bytes]):
    def run(batches):
        names = sorted(samples)
        classes = byte_classes(samples)
        width = int(classes.max()) + 1
        tables = [automaton(classes[np.frombuffer(samples[k], np.uint8)].tolist(), width) for k in names]
        norm = np.array([np.log2(len(samples[k]) + 2) for k in names])
        for batch in batches:
            for part in tc.slices(batch, "text", 2 << 20):
                data, offsets = tc.column_bytes(part.column("text"))
                symbols = classes[data].astype(np.int32)
                sizes = np.diff(offsets)
                chunks = -(-sizes // CHUNK)
                row = np.repeat(np.arange(len(sizes)), chunks)
                k = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                starts = offsets[row] + k * CHUNK
                lengths = np.minimum(CHUNK, sizes[row] - k * CHUNK)
                order = np.argsort(-lengths, kind="stable")
                cost = np.zeros((len(sizes), len(names)))
                for i, table in enumerate(tables):
                    cost[:, i] = np.bincount(row[order], phrases(table, width, symbols, starts[order], lengths[order]), len(sizes)) * norm[i]
                ascii_letters = tc.row_reduce(np.add, _LETTER[data].astype(np.int64), offsets, 0) > 0
                langs, scores = [], []
                for i in range(len(sizes)):
                    letter = ascii_letters[i] or any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="ignore"))
                    if not letter or not names:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    best = int(cost[i].argmin())
                    others = np.delete(cost[i], best)
                    langs.append(names[best])
                    scores.append(float(1 - cost[i, best] / others.min()) if len(others) else 1.0)
                yield pa.record_batch([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return run


def identify(documents: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """The documents with lang_pred and score; columns of these names are replaced."""
    docs = documents.drop("lang_pred", "score")
    return docs.mapInArrow(_predict(samples), StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def language_digest(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = identify(documents.select("doc_id", "text"), learn(documents))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
