"""The corpus pipeline, stage by stage, against what each stage should keep."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(120):
        text = " ".join(f"w{(i * 7 + k * k * (i + 3)) % 997}" for k in range(80)) + (" vilgrum snarfle" if i % 6 == 1 else "")
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(i % 6 == 1)))
    rows += [(500 + i, rows[i][1], "en", "s1", 1) for i in (0, 2, 3)]  # exact copies
    near = " ".join(f"common{k}" for k in range(500))
    rows += [(600, near, "en", "s2", 1), (601, near.upper(), "en", "s2", 1), (700, None, None, None, None), (701, "", "en", "s1", 0)]
    spark.createDataFrame(rows, DOC).coalesce(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "sentencepiece"]
    f = dict(corpus_pipeline.STAGES)
    clean = f["toxicity"](spark, docs, sf_dir)
    assert set(range(120)) - set(ids(clean)) == {i for i in range(120) if i % 6 == 1} and clean.columns == docs.columns
    one = f["exact_dedup"](spark, clean, sf_dir)
    assert set(ids(clean)) - set(ids(one)) == {0, 2, 3, 700} and one.columns == docs.columns
    near = f["simhash_near_dedup"](spark, one, sf_dir)
    assert 600 in ids(near) and 601 not in ids(near) and near.columns == docs.columns
    mixed = f["mix_sources"](spark, near, sf_dir)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(near))


def test_training_memory_is_given_back(spark, sf_dir, monkeypatch):
    from assay.llm import shared, toxicity

    if not os.path.exists("/proc/self/statm"):
        pytest.skip("needs Linux's figures")
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    train = toxicity.train_toxicity

    def wasteful(*args):
        blocks = [bytearray(b"x" * 50_000) for _ in range(4_000)]  # 200 MB below the size that the heap maps apart
        keep.append(bytearray(50_000))
        del blocks
        return train(*args)

    keep = []
    monkeypatch.setattr(corpus_pipeline, "train_toxicity", wasteful)
    shared.give_back()
    before = held()
    corpus_pipeline.remove_toxic(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert held() - before < 100


def test_run(spark, sf_dir):
    pieces = pytest.importorskip("assay.llm.pieces")
    import os

    if not os.path.exists(pieces.MODEL):
        pytest.skip("the public tokenizer files are not installed")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and all(r["lossless"] for r in got)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
