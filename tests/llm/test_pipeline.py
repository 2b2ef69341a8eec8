"""The pipeline's stages on a small table, each against what it must do to planted rows."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from siltstone.llm import bytebpe


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"{rng.choice(['lo', 'ra', 'ti', 'na'])}{rng.randint(0, 999)}q" for _ in range(800)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = {i: sentence(80) for i in range(40)}
    passage, item = sentence(60), sentence(30)
    texts[40] = texts[1]
    texts[41] = sentence(30) + " " + passage
    texts[42] = sentence(31) + " " + passage
    texts[43] = sentence(25) + " " + item + " " + sentence(25)
    texts |= {44: None, 45: "12 34 !!"}
    (tmp_path / "t").mkdir()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "t" / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "t" / "benchmark.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path / "t")).collect()}
    assert set(got) == set(range(40)) | {41, 42}
    bpe = bytebpe.ByteBPE(bytebpe.parse_ranks(bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN)
    texts[42] = " ".join(texts[42].split()[:31])
    for i, r in got.items():
        assert r["ids_sha256"] == hashlib.sha256(bpe.packed(texts[i])).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_a_forgetful_worker_keeps_no_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    maps = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: maps.append(run))
    for forget in (False, True):
        bytebpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256"), forget=forget)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["some words and others", None, "ñandú 123"]})
    kept, forgot = (pa.Table.from_batches([*maps[0](iter([batch]))]), len(bytebpe._loaded)), (pa.Table.from_batches([*maps[1](iter([batch]))]), len(bytebpe._loaded))
    assert kept[0].equals(forgot[0]) and (kept[1], forgot[1]) == (1, 0)
