"""The pipeline's stages on a small corpus, each held against its own input."""

import random
import zlib

import pytest

import corpus_pipeline
from tests.llm.test_corpus_operators import brute_groups, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    shared = prose(rng, 55)
    for i in range(240):
        bad = i % 6 == 0
        text = "\n".join([prose(rng, 60), *([shared] if i % 9 == 0 else []), prose(rng, 50) + (" worthless scumbag idiot" if bad else "")])
        rows.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
        labels.append((i, 1, int(bad)))
    rows += [(300, rows[7][1], "en", "a", 1), (301, rows[8][1].replace("alpha", "alphas", 1), "en", "b", 1), (302, None, None, None, None), (303, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.collect())
    ids = [{r.doc_id for r in rows} for rows in seen]
    bad = {i for i in range(240) if i % 6 == 0}
    held = {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(ids[1] & bad & held) <= 1 and len(ids[0] - bad - ids[1]) <= 2
    lines = [x for r in seen[2] for x in (r.text or "").split("\n") if len(x) >= 60]
    assert len(lines) == len(set(lines)) and 300 not in ids[2] and {302, 303} <= ids[2]
    want, _ = brute_groups([(r.doc_id, r.text) for r in seen[2]], 5, 4, 5)
    assert ids[3] == {i for i, c in want.items() if i == c} and len(seen[3]) == len(ids[3])
    words = sum(len((r.text or "").split()) for r in seen[3])
    assert sum(len(r.text.split()) for r in seen[4]) == pytest.approx(1.5 * words, rel=0.02) and ids[4] <= ids[3]
    tokens = {}
    for r in seen[5]:
        tokens[r.sequence_id] = tokens.get(r.sequence_id, 0) + r.length
    assert max(tokens.values()) <= 4096 and {r.doc_id for r in seen[5]} == ids[4]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
