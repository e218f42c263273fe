import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline

from subsidia.llm import mixing


def test_stages(spark, sf_dir, tmp_path):
    """Each stage against brute force on its own input."""
    docs = start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [{r.doc_id: r for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == start.columns
        if name == "source_mix":
            want = {r.doc_id: r.copies for r in mixing.mix_sources(before).collect() if r.taken}
            assert Counter(r.doc_id for r in docs.collect()) == want
        elif name == "packing":
            assert Counter(r.doc_id for r in docs.where("start = 0").collect()) == Counter(r.doc_id for r in before.collect())
            for own in brute.grouped(docs.collect(), lambda r: r.sequence_id).values():
                assert sum(p.length for p in own) <= 1024
        else:
            tables.append({r.doc_id: r for r in docs.collect()})
            old, new = tables[-2], tables[-1]
            if name == "language_id":
                assert {i for i, r in old.items() if any(c.isalpha() for c in r.text or "")} - set(new) == set()
            if name == "exact_dedup":
                assert set(new) == set({r.text: i for i, r in sorted(old.items())}.values())
            if name == "ngram_jaccard":
                near = brute.near_components([(i, r.text) for i, r in old.items()])
                assert set(new) == {i for i, (_, c) in near.items() if i == c}


def test_mix_reaches_its_targets(spark, sf_dir):
    """The drawn documents against targets filled up by rounds, and whole rows at most three times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = lambda text: len(brute.re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    before, after = docs.collect(), corpus_pipeline.source_mix(spark, docs, sf_dir).collect()
    sources = sorted({r.source for r in before}, key=lambda s: (s is None, s))
    sums = [sum(size(r.text) for r in before if r.source == s) for s in sources]
    for source, target in zip(sources, brute.water_filled(sums)):
        own = [size(r.text) for r in after if r.source == source]
        assert abs(sum(own) - target) <= max(own, default=0)
    assert max(Counter(r.doc_id for r in after).values()) <= 3 and set(after) <= set(before)


def test_stages_on_odd_tables(spark):
    """Null and repeated ids, null, empty and wordless texts, columns with any names, and an empty table, stage by stage."""
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "good words stay here"), (1, "12 34"), (2, None), (2, ""), (None, "good words stay here"), (None, "42"), (3, words), (4, words), (4, words), (5, words + " end")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, _file string, record int, file string"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7, "f", 8, "g") for i, t in rows], schema)
    want = {
        "language_id": [(1, "good words stay here"), (None, "good words stay here"), (3, words), (4, words), (4, words), (5, words + " end")],
        "exact_dedup": [(1, "12 34"), (1, "good words stay here"), (2, ""), (4, words), (5, words + " end"), (None, "42")],
        "ngram_jaccard": [(1, "12 34"), (1, "good words stay here"), (2, None), (2, ""), (3, words), (None, "42")],
    }
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, ""), stage(spark, docs.where("doc_id > 99"), "")
        assert none.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns == none.columns
        got = Counter(out.select("doc_id", "text").collect() if name != "packing" else [])
        if name in want:
            texts = lambda rs: Counter((i, t or "") for i, t in rs)
            assert texts(got.elements()) == texts(want[name]), name
        elif name == "source_mix":
            assert set(got) <= {r for r in docs.select("doc_id", "text").collect() if (r.text or "").split()}
        else:
            assert out.where("start = 0").count() == len(rows)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and np.array([r.length for r in rows]).max() <= 1024


def test_filters_reject_only_the_wordless(spark):
    rows = [(1, "the cat and the dog sat on the mat", "en"), (2, "12 34 !!", "en"), (3, None, "en"), (4, "", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} <= {1}
