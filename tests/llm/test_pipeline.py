import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from framemill.llm import quality_rules, suffix_dedup
from framemill.llm.shared import ship
from test_operators import brute_groups


def test_stages(spark, sf_dir):
    """Each stage does to its input what brute force does."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out, _ = corpus_pipeline.materialise(stage(spark, seen[-1], sf_dir), "test")
        assert out.columns == columns
        seen.append(out)
    raw, good, single, cut, mixed = seen
    rejected = {r["doc_id"] for r in quality_rules.cascade(raw).filter("NOT kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in raw.collect()} - rejected
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c in brute_groups(good.collect())})
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.dedup(single, characters=True).collect()}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {k: v for k, v in kept.items() if v.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    size = {r["doc_id"]: len(r["text"].split()) for r in cut.collect()}
    used: dict[int, int] = {}
    for r in mixed.collect():
        used[r["doc_id"]] = used.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(used[k] <= 2 * size[k] for k in used)
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, sf_dir).collect()
    assert len(last) == mixed.count() and all(r["n_tokens"] == len(r["ids"]) for r in last)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def near(a, b):
    """Jaccard similarity of sets of five words."""
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_from_80_percent_on_go(spark, sf_dir):
    base = [[f"d{d}w{k}" for k in range(200)] for d in range(4)]
    longer = base[0] + [f"more{k}" for k in range(40)]
    changed = base[1][:90] + [f"else{k}" for k in range(16)] + base[1][106:]
    far = base[2][:80] + [f"other{k}" for k in range(24)] + base[2][104:]
    assert 0.80 <= near(base[0], longer) < 0.85 and 0.80 <= near(base[1], changed) < 0.85 and near(base[2], far) < 0.80
    rows = [(k, " ".join(w)) for k, w in enumerate([*base, longer, changed, far])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, sf_dir).collect()) == [0, 1, 2, 3, 6]
