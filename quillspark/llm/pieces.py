"""Unigram subword pieces: encoding, decoding and counting tokens.

A vocabulary comes from a public SentencePiece model file (its path is a parameter).  The log score
of the r-th normal piece is -log(r + 2), a rank-frequency law, as that file's own numbers are ranks.
Text is split before each run of spaces and around bytes that no piece holds (line feeds); no piece
spans such a cut, so the best segmentation of a text is the best ones of its pre-tokens, joined.  A
space stands for the whitespace marker, and every non-empty text gets one in front, as
SentencePiece does.  A character without a piece of its own becomes its UTF-8 bytes' pieces, at a
score below all pieces (byte fallback).  Decoding turns markers into spaces, bytes into bytes and
drops the space in front: for every text decode(encode(text)) == text, as a marker character that the
text itself holds goes through byte fallback.

Ties: of equal totals the one with the longer last piece wins, at every prefix.
Null and empty texts have no tokens.  Nothing is normalised, dropped or capped.

`encode` runs Viterbi over a double-array trie for all distinct pre-tokens of a slice side by side.
`count` needs no segmentation: it puts the distinct pre-tokens in a trie (sorted rows share their
prefixes) and fills in the best score and its number of pieces once for each shared prefix, from
pieces read backwards in a second double array; the terminal nodes hold the counts.
Both keep what they know of pre-tokens between slices, up to KNOWN of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from . import textcodes as tc

MODEL = "piece_bpe_32k.model"
LONG = 40  #: bytes of a pre-token that still take part in the side-by-side work; longer ones go one by one
KNOWN = 400_000
_MARKER = "▁".encode()


class DoubleArray:
    """A byte trie in two integer arrays: the child of s by c is t = base[s] + c if check[t] == s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for k, key in enumerate(keys):
            at = 0
            for c in key:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = nxt
            value[at] = k
        size = 2 * len(children) + 1024
        base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        slot = {0: 0}
        free = ahead = 256  # from here on no base is negative
        queue = [0]
        for node in queue:
            kids = sorted(children[node])
            if not kids:
                continue
            while taken[free]:
                free += 1
            at = free if len(kids) == 1 else max(free, ahead)  # nodes with several children look on where the last one fitted; the gaps go to the others
            while True:
                b = at - kids[0]
                if b >= 0 and not taken[at] and all(not taken[b + c] for c in kids):
                    break
                at += 1
                if at + 256 >= len(taken):
                    grow = len(taken)
                    taken.extend(bytes(grow))
                    base, out = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([out, np.full(grow, -1, np.int32)])
                    check = np.concatenate([check, np.full(grow, -1, np.int32)])
            ahead = max(ahead, at) if len(kids) > 1 else ahead
            base[slot[node]] = b
            for c in kids:
                t = b + c
                taken[t] = 1
                check[t] = slot[node]
                slot[children[node][c]] = t
                out[t] = value[children[node][c]]
                queue.append(children[node][c])
        end = max(slot.values()) + 257
        if end > len(base):
            base, check, out = np.pad(base, (0, end - len(base))), np.pad(check, (0, end - len(check)), constant_values=-1), np.pad(out, (0, end - len(out)), constant_values=-1)
        self.base, self.check, self.value = base[:end], check[:end], out[:end]

    def step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the states go on, their children)."""
        t = self.base[states] + codes
        ok = np.flatnonzero(self.check[t] == states)
        return ok, t[ok]


class Vocabulary:
    """Pieces as bytes (the marker as a space), their scores, and the byte pieces' ids."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = [b""] * n
        self.byte_id = np.full(256, -1, np.int32)
        normal: list[int] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[3:-1], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i):
                self.bytes[i] = piece.encode().replace(_MARKER, b" ")
                normal.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        self.ids = np.array(normal, dtype=np.int32)
        self.keys = [self.bytes[i] for i in normal]
        self.scores = -np.log(np.arange(len(normal)) + 2.0)
        self.unknown = float(self.scores.min()) - 10.0
        held = np.zeros(256, dtype=bool)
        for key in self.keys:
            held[list(key)] = True
            if b" " in key.lstrip(b" "):
                raise ValueError("a piece holds a space after another character")
        held[128:] = True
        self.alone = ~held  # ASCII bytes that no piece holds
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.key_lengths = np.array([len(k) for k in self.keys], dtype=np.int64)
        self.forward = DoubleArray(self.keys)

    def backward(self) -> DoubleArray:
        return DoubleArray([k[::-1] for k in self.keys])


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


_CHAR = np.ones(256, dtype=np.int64)
_CHAR[0xC0:0xE0], _CHAR[0xE0:0xF0], _CHAR[0xF0:] = 2, 3, 4


def pretokens(data: np.ndarray, offsets: np.ndarray, alone: np.ndarray):
    """(bytes with a space in front of each text, starts, ends, first pre-token of each row)."""
    sizes = np.diff(offsets)
    full = sizes > 0
    spaced = np.insert(data, offsets[:-1][full], 0x20)
    at = offsets + np.concatenate([[0], np.cumsum(full)])
    n = len(spaced)
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    cut[n] = True
    space = spaced == 0x20
    cut[1:n] |= space[1:] & ~space[:-1]
    single = np.flatnonzero(alone[spaced])
    cut[single] = True
    cut[single + 1] = True
    places = np.flatnonzero(cut)
    starts, ends = places[:-1], places[1:]
    return spaced, at, starts, ends, np.searchsorted(starts, at)


def matrix(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The byte strings as rows, padded with 0."""
    width = int(lengths.max()) if len(lengths) else 0
    cols = np.arange(width)
    at = np.minimum(starts[:, None] + cols, max(len(data) - 1, 0))
    return np.where(cols < lengths[:, None], data[at], 0).astype(np.uint8)


def viterbi(v: Vocabulary, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, bounds) of the best segmentation of each row."""
    count, width = len(lengths), rows.shape[1]
    best = np.full((count, width + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((count, width + 1), dtype=np.int16)  # bytes of the last piece
    last = np.full((count, width + 1), -1, dtype=np.int32)  # its number; -1 for an unknown character
    for i in range(width):
        active = np.flatnonzero((lengths > i) & (best[:, i] > -np.inf))
        size = np.minimum(_CHAR[rows[active, i]], lengths[active] - i)
        alone = np.ones(len(active), dtype=bool)
        which, states = np.arange(len(active)), np.zeros(len(active), dtype=np.int32)
        j = i
        while len(which) and j < width:
            inside = lengths[active[which]] > j
            which, states = which[inside], states[inside]
            ok, states = v.forward.step(states, rows[active[which], j].astype(np.int32))
            which = which[ok]
            j += 1
            piece = v.forward.value[states]
            end = np.flatnonzero(piece >= 0)
            if len(end):
                w, r = which[end], active[which[end]]
                alone[w[size[w] == j - i]] = False
                total = best[r, i] + v.scores[piece[end]]
                better = total > best[r, j]
                r = r[better]
                best[r, j], back[r, j], last[r, j] = total[better], j - i, piece[end][better]
        r, s = active[alone], size[alone]
        total = best[r, i] + v.unknown
        better = total > best[r, i + s]
        r, s = r[better], s[better]
        best[r, i + s], back[r, i + s], last[r, i + s] = total[better], s, -1
    at = lengths.astype(np.int64).copy()
    made_row, made_at, made_id = [], [], []
    open_ = np.flatnonzero(at > 0)
    while len(open_):
        e = at[open_]
        size, piece = back[open_, e].astype(np.int64), last[open_, e]
        known = piece >= 0
        made_row.append(open_[known])
        made_at.append(e[known] - size[known])
        made_id.append(v.ids[piece[known]])
        for b in range(4):
            byte = np.flatnonzero(~known & (size > b))
            made_row.append(open_[byte])
            made_at.append(e[byte] - size[byte] + b)
            made_id.append(v.byte_id[rows[open_[byte], e[byte] - size[byte] + b]])
        at[open_] = e - size
        open_ = open_[at[open_] > 0]
    if not made_row:
        return np.zeros(0, np.int32), np.zeros(count + 1, np.int64)
    row, pos, ids = np.concatenate(made_row), np.concatenate(made_at), np.concatenate(made_id)
    order = np.argsort(row * (width + 1) + pos, kind="stable")
    return ids[order], np.searchsorted(row[order], np.arange(count + 1))


def viterbi_one(v: Vocabulary, text: bytes) -> list[int]:
    """The same for one pre-token of any length, in time and memory linear in it."""
    n = len(text)
    base, check, value, scores = v.forward.base, v.forward.check, v.forward.value, v.scores
    best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    last = [-1] * (n + 1)
    for i in range(n):
        if best[i] == float("-inf"):
            continue
        size, alone, state = min(int(_CHAR[text[i]]), n - i), True, 0
        for j in range(i, n):
            t = int(base[state]) + text[j]
            if check[t] != state:
                break
            state = t
            if value[t] >= 0:
                alone &= j + 1 - i != size
                total = best[i] + float(scores[value[t]])
                if total > best[j + 1]:
                    best[j + 1], back[j + 1], last[j + 1] = total, j + 1 - i, int(value[t])
        if alone and best[i] + v.unknown > best[i + size]:
            best[i + size], back[i + size], last[i + size] = best[i] + v.unknown, size, -1
    out: list[int] = []
    while n:
        size = back[n]
        out += [int(v.ids[last[n]])] if last[n] >= 0 else [int(v.byte_id[b]) for b in reversed(text[n - size : n])]
        n -= size
    return out[::-1]


def trie_counts(v: Vocabulary, suffixes: DoubleArray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pieces of the best segmentation of each row, one forward score for each shared prefix."""
    count, width = rows.shape
    if not count:
        return np.zeros(0, np.int64)
    padded = np.concatenate([rows, lengths[:, None].astype(np.uint8)], axis=1)
    order = np.argsort(np.ascontiguousarray(padded).view(np.dtype((np.void, width + 1))).ravel())
    rows, lengths = rows[order], lengths[order]
    differ = rows[1:] != rows[:-1]
    first = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), width)])  # bytes shared with the row before
    score = np.full((count, width + 1), -np.inf)
    pieces = np.zeros((count, width + 1), dtype=np.int32)
    node = np.zeros((width + 1, count), dtype=np.int32)  # the row that holds the values of a row's prefix
    score[0, 0] = 0
    for d in range(1, width + 1):
        opens = (first < d) & (np.arange(count) > 0)
        opens[0] = True
        node[d] = np.maximum.accumulate(np.where(opens, np.arange(count), 0))
        at = np.flatnonzero(opens & (lengths >= d))
        if not len(at):
            continue
        # candidates: pieces that end here, read backwards; the longest that wins is the one seen last with >=
        which, states = np.arange(len(at)), np.zeros(len(at), dtype=np.int32)
        best, many = np.full(len(at), -np.inf), np.zeros(len(at), dtype=np.int32)
        whole = np.zeros(len(at), dtype=np.int64)  # bit l: a piece of l bytes ends here
        for back in range(1, d + 1):
            ok, states = suffixes.step(states, rows[at[which], d - back].astype(np.int32))
            which = which[ok]
            if not len(which):
                break
            piece = suffixes.value[states]
            end = np.flatnonzero(piece >= 0)
            w = which[end]
            if back <= 4:
                whole[w] |= 1 << back
            before = node[d - back][at[w]]
            total = score[before, d - back] + v.scores[piece[end]]
            better = (total >= best[w]) & (total > -np.inf)
            best[w[better]], many[w[better]] = total[better], pieces[before[better], d - back] + 1
        for size in range(1, min(4, d) + 1):  # a whole character without a piece
            lead = rows[at, d - size]
            fits = np.flatnonzero((np.minimum(_CHAR[lead], lengths[at] - (d - size)) == size) & (whole >> size & 1 == 0))
            before = node[d - size][at[fits]]
            total = score[before, d - size] + v.unknown
            better = total > best[fits]
            best[fits[better]], many[fits[better]] = total[better], pieces[before[better], d - size] + size
        score[at, d], pieces[at, d] = best, many
    out = np.empty(count, dtype=np.int64)
    out[order] = pieces[node[lengths, np.arange(count)], lengths]
    return out


class Known:
    """What a task knows of pre-tokens: sorted codes with ragged values."""

    def __init__(self):
        self.codes, self.bounds, self.flat = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def missing(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        return np.flatnonzero(self.codes[at] != codes) if len(self.codes) else np.arange(len(codes))

    def add(self, codes: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> None:
        lengths = np.concatenate([np.diff(self.bounds), np.diff(bounds)])
        every, starts = np.concatenate([self.codes, codes]), np.concatenate([self.bounds[:-1], bounds[:-1] + len(self.flat)])
        order = np.argsort(every)
        self.codes, self.flat = every[order], gather(np.concatenate([self.flat, flat]), starts[order], lengths[order])
        self.bounds = np.concatenate([[0], np.cumsum(lengths[order])])


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]], end to end."""
    total = np.cumsum(lengths)
    return flat[np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)]


def _solve(v: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, suffixes: DoubleArray | None):
    """(values, bounds) of some pre-tokens: their ids, or their counts if suffixes are given."""
    short = lengths <= LONG
    order = np.argsort(lengths, kind="stable")
    flat, sizes, who = [], [], []
    for lo, hi in ((0, 8), (8, 16), (16, LONG)):
        at = order[(lengths[order] > lo) & (lengths[order] <= hi)]
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            rows = matrix(data, starts[part], lengths[part])
            who.append(part)
            if suffixes is None:
                ids, bounds = viterbi(v, rows, lengths[part])
                flat.append(ids)
                sizes.append(np.diff(bounds))
            else:
                flat.append(trie_counts(v, suffixes, rows, lengths[part]).astype(np.int32))
                sizes.append(np.ones(len(part), np.int64))
    for i in np.flatnonzero(~short):
        ids = viterbi_one(v, data[starts[i] : starts[i] + lengths[i]].tobytes())
        who.append(np.array([i]))
        flat.append(np.array(ids if suffixes is None else [len(ids)], dtype=np.int32))
        sizes.append(np.array([len(flat[-1])]))
    who, sizes, flat = np.concatenate(who), np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
    begin = np.cumsum(sizes) - sizes
    place = np.argsort(who)
    return gather(flat, begin[place], sizes[place]), np.concatenate([[0], np.cumsum(sizes[place])])


class Tokenizer:
    """Encodes, counts and decodes slices; one for each task."""

    def __init__(self, v: Vocabulary, counts: bool):
        self.v, self.known, self.suffixes = v, Known(), v.backward() if counts else None

    def rows(self, data: np.ndarray, offsets: np.ndarray):
        """(spaced bytes, text bounds there, place in `known` of each pre-token, first pre-token of each row)."""
        spaced, at, starts, ends, firsts = pretokens(data, offsets, self.v.alone)
        codes = tc.span_codes(tc.prefix_codes(spaced), starts, ends)
        distinct, where, inverse = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.known.codes) + len(distinct) > KNOWN:
            self.known = Known()
        new = self.known.missing(distinct)
        if len(new):
            self.known.add(distinct[new], *_solve(self.v, spaced, starts[where[new]], (ends - starts)[where[new]], self.suffixes))
        return spaced, at, np.searchsorted(self.known.codes, distinct)[inverse], firsts

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(spaced bytes, text bounds there, ids, bounds of each row's ids)."""
        spaced, at, place, firsts = self.rows(data, offsets)
        lengths = np.diff(self.known.bounds)[place]
        ids = gather(self.known.flat, self.known.bounds[:-1][place], lengths)
        return spaced, at, ids, np.concatenate([[0], np.cumsum(lengths)])[firsts]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, _, place, firsts = self.rows(data, offsets)
        return np.diff(np.concatenate([[0], np.cumsum(self.known.flat[place], dtype=np.int64)])[firsts])


def decode_ids(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes end to end, bounds) of each row's ids; each row that has any starts with the space in front."""
    lengths = v.lengths[ids]
    return gather(v.flat, v.starts[ids], lengths), np.concatenate([[0], np.cumsum(lengths)])[bounds]


def _run(model: str, make):
    def run(batches):
        make_rows = make(Vocabulary(model))
        for batch in batches:
            for part in tc.slices(batch, "text", 1 << 20):
                yield make_rows(part)

    return run


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """The documents with token_ids (array of int), n_tokens and round_trip (whether decoding the ids gives the text's
    bytes again); columns of these names are replaced."""
    docs = documents.drop("token_ids", "n_tokens", "round_trip")

    def make(v):
        tokenizer = Tokenizer(v, False)

        def rows(part):
            spaced, at, ids, bounds = tokenizer.encode(*tc.column_bytes(part.column("text")))
            back, back_at = decode_ids(v, ids, bounds)
            same = [np.array_equal(back[back_at[i] : back_at[i + 1]], spaced[at[i] : at[i + 1]]) for i in range(part.num_rows)]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
            return pa.record_batch([*part.columns, lists, pa.array(np.diff(bounds)), pa.array(same, pa.bool_())], names=[*part.schema.names, "token_ids", "n_tokens", "round_trip"])

        return rows

    schema = StructType([*docs.schema.fields, StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())])
    return docs.mapInArrow(_run(model or default_model(), make), schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the text of each row's token_ids; null ids give an empty text."""
    path = model or default_model()

    def run(batches):
        v = Vocabulary(path)
        for batch in batches:
            texts = []
            for ids in batch.column("token_ids").to_pylist():
                texts.append(b"".join(v.bytes[i] for i in ids or ())[1:].decode(errors="replace"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def encoding_digest(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_fallback (byte pieces), ids_sha256 (of 32-bit little-endian ids) and
    round_trip: whether decoding the ids gives the text's bytes again."""

    def make(v):
        tokenizer = Tokenizer(v, False)
        is_byte = np.zeros(len(v.bytes), dtype=bool)
        is_byte[v.byte_id] = True

        def rows(part):
            data, offsets = tc.column_bytes(part.column("text"))
            spaced, at, ids, bounds = tokenizer.encode(data, offsets)
            back, back_at = decode_ids(v, ids, bounds)
            fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])
            shas, same = [], []
            for i in range(part.num_rows):
                shas.append(hashlib.sha256(ids[bounds[i] : bounds[i + 1]].astype("<i4").tobytes()).hexdigest())
                same.append(np.array_equal(back[back_at[i] : back_at[i + 1]], spaced[at[i] : at[i + 1]]))
            return pa.record_batch(
                [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(bounds)), pa.array(np.diff(fallback[bounds]).astype(np.int64)), pa.array(shas), pa.array(same, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "n_fallback", "ids_sha256", "round_trip"],
            )

        return rows

    docs = documents.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_run(model or default_model(), make), "doc_id long, n_bytes long, n_tokens long, n_fallback long, ids_sha256 string, round_trip boolean")


def token_counts(documents: DataFrame, model: str | None = None) -> DataFrame:
    """The documents with n_tokens, by trie-shared dynamic programming; a column of this name is replaced."""
    docs = documents.drop("n_tokens")

    def make(v):
        tokenizer = Tokenizer(v, True)
        return lambda part: pa.record_batch([*part.columns, pa.array(tokenizer.count(*tc.column_bytes(part.column("text"))))], names=[*part.schema.names, "n_tokens"])

    return docs.mapInArrow(_run(model or default_model(), make), StructType([*docs.schema.fields, StructField("n_tokens", LongType())]))


def count_digest(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_chars (code points) and n_tokens."""
    counted = token_counts(documents.select("doc_id", "text"), model)
    return counted.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens")
