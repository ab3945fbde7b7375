from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_pipeline_equals_its_steps_by_brute_force(spark, tmp_path):
    import sys
    import zlib
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    import test_mixing as mixing
    import test_ngram_join as near
    import test_repetition as quality
    from tokenizers import Tokenizer

    from marginalia.llm import queries

    item = " ".join(f"question{i} of" for i in range(10))
    rows = near.corpus(7)[:150] + [(5000, "spam " * 40), (5001, None), (5002, "x " + item + " y"), (5003, "a b")]
    full = [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t) for i, t in rows if not quality.brute(t)[5]]
    groups = near.brute(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i and item not in (t or "")]
    mixing.MIX = queries.PRODUCTION_MIX
    picked = mixing.brute([(i, t, "en", f"src{i % 5}") for i, t in kept])
    plain, texts = Tokenizer.from_file(queries.tokenizer_path()), dict(rows)
    want, start = [], 0
    for i in sorted(i for i, _ in picked.elements()):
        ids = plain.encode(texts[i], add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "mixture", "tokens"]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows, nulls in every column, a long text, and columns whose names the stages use themselves."""
    long = " ".join(f"word{i} of" for i in range(60_000))
    rows = [(1, long, "en", "src99999999999", 1, "a", 2, "b"), (1, long, "en", "src99999999999", 1, "a", 2, "b"), (2, None, None, None, None, None, None, None), (3, "", "de", "src2", 0, "", 0, ""), (4, " ".join(f"other{i} text" for i in range(60)), None, None, None, None, 5, "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c``d` int, component_id string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    for folder in "ab":
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    kept = corpus_pipeline.decontamination(spark, corpus_pipeline.near_copies(spark, corpus_pipeline.quality(spark, docs, ""), ""), f"{tmp_path}/a")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 4]
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r.doc_id for r in got} == {1, 4} and all(r.n_tokens > 100 for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
