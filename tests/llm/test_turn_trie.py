"""The conversation trie against plain dictionaries."""

import hashlib
import math
import random
import re
import zlib

import pytest

from quillspark.llm import turn_trie


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append((turn is not None, turn or 0, sha, (role, text)))
    convs = {c: [x[3] for x in sorted(t)] for c, t in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        own = (len(nodes[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        rest = [below(c) for c in children.get(p, [])]
        return sum(r[0] for r in rest) or 1, own + sum(r[1] for r in rest)

    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, at in members if at)))
        leaves, saved = below(p)
        out.append((min(c for c, _ in members), len(p), min(c for c, _ in nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(1)
    rows = []
    for c in [*range(-3, 90), 200, 201, 219]:
        if c % 40 == 0:
            continue  # bases that are absent
        n = rng.choice([1, 2, 4, 6])
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["hi there", "", None, "one  two\nthree", "é b"])) for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 380) for t in range(8)]  # one long path, and its forks
    rows += [(c, 8, "user", f"fork {c % 3}") for c in range(300, 350)] + [(c, 9, "user", "end") for c in range(300, 310)]
    rows += [(400, None, "x", "first"), (400, 2, "x", "c"), (400, 2, "x", "b"), (400, 2, "x", "b"), (None, 1, "x", "nobody"), (7, 1, "user", "hi there")]
    rows += [(500, t, "user", f"long {t}") for t in range(300)]
    return rows


@pytest.mark.parametrize("turns", [turn_trie.GROUP_TURNS, 30, 1])
def test_equals_plain_dictionaries(spark, turns):
    """Also where groups are dealt again until each holds one path."""
    rows = conversations()
    df = spark.createDataFrame([(*r, 5, "p") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    assert sorted(map(tuple, turn_trie.prefix_nodes(df, turns).collect()), key=str) == brute(rows)


def test_ids_in_several_pieces(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(turn_trie, "IDS", 3)
    schema = pa.schema([("path", pa.binary()), ("conv_id", pa.int64()), ("words", pa.list_(pa.int32()))])
    batches = [pa.record_batch([[p] * len(ids), ids, [[1]] * len(ids)], schema=schema) for p, ids in ((b"a", list(range(8))), (b"a", [8, 9]), (b"b", [4]))]
    pieces = [b for x in batches for b in turn_trie._pieces([x])]
    assert [b.num_rows for b in pieces] == [3, 1, 1]
    got = [r for b in turn_trie._ends(pieces) for r in b.to_pylist()]
    assert [(r["path"], r["least"], r["n"]) for r in got] == [(b"a", 0, 10), (b"b", 4, 1)]
    assert got[0]["sha"] == hashlib.sha256(b"0,1,2,3,4,5,6,7,8,9").hexdigest()


def test_without_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert turn_trie.prefix_nodes(spark.createDataFrame([], schema)).collect() == []
    assert turn_trie.prefix_nodes(spark.createDataFrame([(None, 1, "a", "b")], schema)).collect() == []
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    assert [tuple(r) for r in turn_trie.prefix_nodes(spark.createDataFrame([(alone, 0, "a", "b")], schema)).collect()] == brute([(alone, 0, "a", "b")])
