"""The pipeline's stages one after another against plain versions of their decisions."""

import random

from seriesmill.llm import op4_decontaminate, op8_quality_rules
from tests.llm.test_operators import DOCUMENTS, near_copies, plain_components

import corpus_pipeline


def test_run(spark, tmp_path):
    r = random.Random(3)
    names = ["the", "of", "and", "to", "a", "in"]

    def text(n):
        return " ".join(r.choice(names) if r.random() < 0.5 else f"v{r.randrange(5000)}" for _ in range(n))

    item = text(40)
    texts = [text(90) for _ in range(25)] + near_copies(6) + ["short", None, text(80) + " " + item, text(70) + " mail a.b@c.example.com now"]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))

    judged = {x["doc_id"] for x in op8_quality_rules.judge(docs).where("kept").collect()}
    classes = plain_components([t if k in judged else None for k, t in enumerate(texts)])
    single = {k for k in judged if classes[k][1] == k}
    dirty = {x["doc_id"] for x in op4_decontaminate.scores(docs, bench).where("contaminated").collect()}
    found = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == single - dirty
    assert len(texts) - 2 in dirty and len(texts) - 1 in found
    last = found[len(texts) - 1]
    assert last["text"].endswith("mail [EMAIL] now") and last["n_chars"] == len(last["text"])
    assert last["size"] == len(last["text"].split()) and 0 <= last["taken"] <= 2 * last["size"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "mixture"]


def test_rows_without_an_id_or_with_a_repeated_one(spark, tmp_path):
    """Nine clean, different texts: six without an id, two with the same one, and one more."""
    r = random.Random(11)
    names = ["the", "of", "and", "to", "a", "in"]
    texts = [" ".join(r.choice(names) if r.random() < 0.5 else f"x{k}y{r.randrange(5000)}" for _ in range(120)) for k in range(9)]
    ids = [None] * 6 + [7, 7, 3]
    rows = [(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "another text " * 20)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x["text"] for x in found) == sorted(texts)
    assert sorted(str(x["doc_id"]) for x in found) == sorted(map(str, ids))
    targets = {x["source"]: x["target"] for x in found}
    for source, target in targets.items():
        assert sum(x["taken"] for x in found if x["source"] == source) == round(target)
