"""The pipeline's stages on small tables with planted cases."""

import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq

from .test_operators import brute_components, prose


def tables(path, rng):
    rows = []
    for i in range(120):
        w = prose(rng, 80).split()
        if i % 6 == 0:
            w[5] = "vile"
        rows.append((i, " ".join(w)))
    passage, item = prose(rng, 70), prose(rng, 40)
    rows += [(200, prose(rng, 60) + " " + passage), (201, passage + " " + prose(rng, 60))]
    rows += [(202, prose(rng, 30) + " " + item + " " + prose(rng, 30))]
    base = prose(rng, 150)
    rows += [(203, base), (204, base + " more"), (205, base), (206, None), (207, "")]
    docs = {"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": [len(t or "") for _, t in rows]}
    pq.write_table(pa.table(docs), f"{path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": list(range(120)), "quality": [1] * 120, "toxic": pa.array([int(i % 6 == 0) for i in range(120)], pa.int32())}), f"{path}/labels.parquet")
    pq.write_table(pa.table({"item_id": [0], "text": [item]}), f"{path}/benchmark.parquet")
    return dict(rows)


def test_stages(spark, tmp_path):
    texts = tables(tmp_path, random.Random(11))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r for r in docs.collect()})
    toxic, near, cut, clean, ids = seen
    assert len(set(range(0, 120, 6)) - set(toxic)) >= 15 and set(texts) - set(toxic) <= set(range(0, 120, 6))
    want, _ = brute_components([(i, texts[i]) for i in toxic], 5, 80)
    assert set(near) == {i for i in toxic if want[i] == i} and 204 not in near
    assert set(cut) == set(near) and len(cut[200].text.split()) <= 62 and cut[200].n_chars == len(cut[200].text)
    assert set(cut) - set(clean) == {202}
    assert set(ids) == set(clean) and all(r.round_trip for r in ids.values()) and ids[206].n_tokens == ids[207].n_tokens == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(ids)


def test_empty_table(spark, tmp_path):
    tables(tmp_path, random.Random(11))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).count() == 0
