"""The registered queries of this subpackage against their SQL twins, and the pipeline stage by stage."""

import hashlib
import os
import tempfile

import pytest
from compare import compare, connect

import corpus_pipeline
from casegraph.llm import decontaminate, line_dedup, near_dedup, toxicity
from casegraph.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(df, connect(SF), SQL[name]) is None
    elif name == "proximity_matches":
        found = {(r.doc_id, r.item_id) for r in df.collect() if r.wanting == 0}
        exact = decontaminate.contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
        assert found >= {(r.doc_id, i) for r in exact for i in r.item_ids} and found
    else:
        over = "SELECT DISTINCT conv_id FROM conversations" if name == "op12_repair" else "FROM documents"
        assert df.count() == len(connect(SF).execute(over).fetchall())


def test_substring_query_equals_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    first, expected = {}, {}
    for doc, text in rows:
        words, own = (text or "").encode().split(), []
        drop = [False] * len(words)
        for k in range(len(words) - 49):
            gram = tuple(words[k: k + 50])
            own.append(gram)
            if first.get(gram, doc) < doc:
                drop[k: k + 50] = [True] * 50
        for gram in own:
            first.setdefault(gram, doc)
        kept = b" ".join(w for w, d in zip(words, drop) if not d)
        expected[doc] = (len(words), sum(drop), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op9_substring_dedup"](spark, SF).collect()}
    assert got == expected


def test_pipeline_stages(spark):
    """Each stage on what its predecessor wrote, against plain Python over the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    before, grammar = docs, toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        path = os.path.join(folder, name)
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        if name != "sentencepiece":
            assert after.columns == docs.columns
        if name == "toxicity":
            classes = grammar.classes()
            fine = {d for d, r in old.items() if toxicity.scores(toxicity.matched(r.text.encode(), classes)[None], grammar.weights, grammar.bias)[0] < 0.7}
            assert new == {d: old[d] for d in fine}
        elif name == "line_dedup":
            held = {}
            for d, r in old.items():
                for key in set(line_dedup.keys_of(r.text.encode(), 20)) - {b""}:
                    held.setdefault(key, set()).add(d)
            for d, r in old.items():
                keep = [x for x, k in zip(r.text.split("\n"), line_dedup.keys_of(r.text.encode(), 20)) if len(held.get(k, ())) < 3 or max(held[k]) == d]
                assert new[d].text == "\n".join(keep) and new[d].n_chars == len(new[d].text)
        elif name == "near_dedup":
            kept = {r.doc_id for r in near_dedup.groups(before, width=5, percent=80).filter("kept").collect()}
            assert new == {d: old[d] for d in kept} and len(new) < len(old)
        elif name == "decontaminate":
            bad = {r.doc_id for r in decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
            assert bad and new == {d: r for d, r in old.items() if d not in bad}
        else:
            assert set(new) == set(old) and all(r.lossless and r.text == old[d].text for d, r in new.items())
        before = after
