"""Each stage of the pipeline on what the stage before it kept, against plain Python."""

import brute
import corpus_pipeline
from conftest import DATA

from quillspark.llm import shared


def test_stages(spark):
    sf_dir = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    folder = shared.fresh_dir(spark, "pipeline-test")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = shared.stored(stage(spark, docs, sf_dir), f"{folder}/{at}")
        now = {r["doc_id"]: r for r in docs.collect()}
        if name == "language_id":
            want = {i for i, t in rows.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            want = {k for k, _ in brute.exact_groups(list(rows.items())).values()}
        elif name == "near_dedup":
            want = {c for _, c in brute.near_components(list(rows.items())).values()}
        elif name == "decontaminate":
            want = {i for i, t in rows.items() if not brute.contamination(t, items)[1]}
        else:
            want = set(rows)
            assert all(r["decoded_sha256"] == brute.sha(rows[i]) and r["n_tokens"] == len(r["ids"]) for i, r in now.items())
        assert set(now) == want, name
        if name != "byte_bpe":
            assert docs.columns == columns
            assert all(now[i]["text"] == rows[i] for i in now)
            rows = {i: rows[i] for i in want}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(now)


def test_edges(spark):
    """Nulls in any column, repeated rows, columns with names that operators use, and a very long text."""
    sf_dir = f"{DATA}/sf0.001"
    long = " ".join(f"w{k % 977}x" for k in range(40_000))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leak = next(t for _, t in items if len(brute.bench_words(t)) >= 10)
    base = [(k, f"the {w} cat and the dog of house {k}", "en") for k, w in enumerate("one two three four five six seven".split())]
    rows = [*base, (None, "words without an id", None), (8, None, "en"), (9, "", None), (10, "1 2 3 ...", "de"), (11, long, None), (12, long + " end", "en"), (13, "before " + leak + " after", "en"), (14, "same text", "en"), (14, "same text", "en"), (15, "same  text", None)]
    docs = spark.createDataFrame([(i, t, lang, None, None, "x", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, uid string, key int")
    folder, names = shared.fresh_dir(spark, "pipeline-edges"), docs.columns
    docs, kept = shared.stored(docs, f"{folder}/docs"), {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = shared.stored(stage(spark, docs, sf_dir), f"{folder}/{at}")
        kept[name] = sorted((r["doc_id"] for r in docs.collect()), key=repr)
        if name == "language_id":
            assert all(r["lang"] is not None for r in docs.collect())
        if name != "byte_bpe":
            assert docs.columns == names
    assert kept["language_id"] == sorted([*range(7), None, 11, 12, 13, 14, 14, 15], key=repr)
    assert kept["exact_dedup"] == sorted([*range(7), None, 11, 12, 13, 15], key=repr)
    assert kept["near_dedup"] == sorted([*range(7), None, 11, 13, 15], key=repr)
    assert kept["decontaminate"] == kept["byte_bpe"] == sorted([*range(7), None, 11, 15], key=repr)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"{DATA}/sf0.001")
    assert docs.count() == 0
