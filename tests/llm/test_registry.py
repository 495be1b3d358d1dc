from __future__ import annotations

import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from corpusmill.llm import mixing, registry, toxicity
from tests.llm import test_packing, test_simhash, test_templates
from tests.llm.helpers import doc, frame, odd_docs


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 1 + len(registry.QUERIES)))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_stages_keep_the_columns_and_take_odd_rows(spark, tmp_path):
    rows = odd_docs()
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns) and docs.count() > 0


def test_every_stage_against_a_plain_one(spark, tmp_path):
    """Rows of each stage, with columns whose names the stages use themselves."""
    rows = test_templates.corpus()
    rows += [doc(900 + k, rows[9][1] + " and more") for k in range(2)] + [doc(910, rows[9][1] + " and more", "b"), (None, "A text without an id", "en", "b", 20)]
    extra = {"n_dropped": 5, "gone_lines": 6, "simhash_key": 7, "own_size": 8, "toxic_score": 9}
    docs = frame(spark, [(*r, *extra.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra))
    spark.createDataFrame([(i, 0, i % 9 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[c] == v for r in out.collect() for c, v in extra.items())
        return out

    def pairs(df):
        return sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in df.collect())

    scores = toxicity.toxicity(docs, labels).collect()
    calm = after("toxicity", docs)
    clean = [r.doc_id for r in scores if r.score < 0.5]
    assert sorted(str(r.doc_id) for r in calm.collect()) == sorted(map(str, clean))
    known = calm.where("doc_id is not null")
    lined = after("line dedup", known)
    want = test_templates.brute([(r.doc_id, r.text) for r in known.collect()])
    assert {r.doc_id: r.text for r in lined.collect()} == {k: t for k, (t, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    single = after("simhash", lined)
    own = sorted(lined.collect(), key=lambda r: r.doc_id)
    groups = test_simhash.plain_components([test_simhash.plain(r.text) for r in own])
    first = {}
    for r, g in zip(own, groups):
        first.setdefault(g, (r.doc_id, r.text))
    assert pairs(single) == sorted(first.values())
    mixed = after("mixing", single)
    taken = {(r.doc_id, r.source): r.copies for r in mixing.balanced_mix(single).collect()}
    assert {k: n for k, n in taken.items() if n} == Counter((r.doc_id, r.source) for r in mixed.collect())
    packed = after("packing", mixed).collect()
    plain = test_packing.reference(test_packing.BYTES)
    assert sum(r.length for r in packed) == sum(len(plain(r.text)) + 1 for r in mixed.collect())
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
