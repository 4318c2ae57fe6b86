import hashlib
import random

import pytest
from test_models import brute_components, brute_fingerprint
from test_search import brute

import corpus_pipeline

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")


def test_pipeline_is_brute_force(spark, tmp_path):
    r = random.Random(8)
    pool = [f"w{k}é" for k in range(300)]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(30, 120)))) for i in range(30)]
    item = " ".join(f"b{k}" for k in range(15))
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # equal texts
    rows += [(200 + i, rows[i][1] + " end") for i in range(5)]  # near copies
    rows += [(300, None), (301, ""), (302, "12 34 !!"), (303, f"x y {item} z"), (304, item[:20])]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    last = {t: i for i, t in left}
    left = sorted((i, t) for i, t in left if last[t] == i)
    comp = brute_components([brute_fingerprint(t) for _, t in left])
    left = [x for k, x in enumerate(left) if comp[k] == k]
    hit = brute(left, [(1, item)], 13)
    left = [(i, t) for i, t in left if not (hit[i][1] and 20 * hit[i][1] >= hit[i][0])]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(sp.encode(t)), sha(",".join(map(str, sp.encode(t)))), sha(t)) for i, t in left}

    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, d).collect()}
    assert got == want
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, docs, d).columns == docs.columns


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows; repeated and null ids; columns whose names operators use themselves."""
    r = random.Random(3)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    one, two = text(60), text(60)
    kind = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, fp string, key int, n_hit long"
    rows = [(1, one), (1, one), (1, two), (None, one), (None, text(40)), (None, None), (2, two), (3, "")]
    for name, some in (("full", rows), ("empty", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, "en", "s", 1, 9, "r", "f", 1, 2) for i, t in some], kind).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert sorted(x.doc_id or 0 for x in got) == ([0, 1, 2] if some else [])
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == [c.split()[0] for c in kind.split(", ")]


def test_pipeline_leaves_no_tables(spark, tmp_path):
    import os

    d = str(tmp_path)
    spark.createDataFrame([(i, f"some words {i} and more", "en", "s", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/tessella"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, d)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("benchmark_decontamination") and out.count() == 5
