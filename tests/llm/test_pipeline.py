"""The pipeline's stages on a small folder, each against brute force on what the stage before kept."""

import base64
import hashlib
import random

import pytest
import tiktoken

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import fold, links_of, prose, repeated


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    item = prose(rng, 25)
    clean = [prose(rng, rng.randint(70, 150)) for _ in range(30)]
    docs = clean + [clean[0], clean[1] + " more", prose(rng, 80) + " " + item, "short", " ".join(w + "###" for w in clean[2].split()), prose(rng, 60) + " " + clean[3][:300] + " " + prose(rng, 60)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, states = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        states.append({r["doc_id"]: r["text"] for r in df.collect()})
    n = len(clean)
    assert set(states[0]) == set(range(len(docs))) - {n + 3, n + 4}
    assert set(states[1]) == {lead for lead, _ in links_of(sorted(states[0].items()))} and n not in states[1] and n + 1 not in states[1]
    expected = repeated(sorted(states[1].items()))
    assert {i: len(t.encode()) for i, t in states[2].items()} == {i: e[0] - e[1] for i, e in expected.items()} and expected[n + 5][1] > 0
    window = " ".join(fold(item))
    assert set(states[3]) == {i for i, t in states[2].items() if window not in " ".join(fold(t))} and n + 2 not in states[3]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: (list(r["ids"]), r["n_tokens"]) for i, r in out.items()} == {i: (ids := encoding.encode_ordinary(t), len(ids)) for i, t in states[3].items()}
    assert all(r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() for r in out.values())
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in every column, ids that repeat, no rows at all."""
    rng = random.Random(9)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(0, prose(rng, 12)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [prose(rng, 90) for _ in range(4)]
    rows = [(None, clean[0], None, None, None), (None, clean[1], "en", None, 3), (1, clean[2], None, "s", None), (1, clean[3], "en", "s", 1), (1, clean[3], "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0)]
    for made in (rows, []):
        df = spark.createDataFrame(made, kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
        assert sorted(r["text"] for r in df.collect()) == sorted(clean if made else [])
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == (4 if made else 0)
