"""Top-k search, chat formatting, union-find and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from pixelmill.llm import chat_format, components, topk_search

V = "vec_id long, embedding array<float>, v int, dim string"


def _topk(rows, queries, k):
    good = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted(queries):
        own = next((v for i, v in good if i == q), None)
        if own is None:
            continue
        ranked = sorted(((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in good if i != q and len(v) == len(own)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("block", [7, 8192])
def test_exact_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "VECTORS_PER_BLOCK", block)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, rows[4][1]) for i in range(10)]  # ties
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [0.0] * 6), (205, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "d") for i, v in rows], V)
    ids = [0, 4, 50, 104, 200, 202, 204, 205]
    found = topk_search.exact_topk(df, df.where(df.vec_id.isin(ids)), k=5).collect()
    assert sorted(tuple(r) for r in found) == sorted(_topk(rows, ids, 5))


def test_topk_stops_before_it_has_seen_all():
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.normal(0, 1, (4000, 2)) * 256)
    vectors[0] = [5000, 5000]
    lists = np.argsort(vectors, axis=0, kind="stable")
    ids = np.arange(4000)
    got, scores = topk_search.threshold_topk(vectors, ids, lists, np.array([256.0, 256.0]), -1, 1)
    assert got.tolist() == [0] and scores[0] == 2 * 256 * 5000


def test_topk_empty(spark):
    df = spark.createDataFrame([], V)
    assert topk_search.exact_topk(df, df).collect() == []


TURNS = "conv_id long, turn long, role string, text string, n int, p1 string"


def test_chat_collapse(spark):
    logs = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["a", "b", "c"], 6: ["z"], 7: [None], 8: [""], 9: ["b", "a"]}
    rows = [(c, k, "user" if k % 2 == 0 else None, t, 1, "p") for c, ts in logs.items() for k, t in enumerate(ts)]
    rows += [(None, 0, "user", "lost", 1, "p"), (6, None, "user", "last", 1, "p")]
    found = {r.conv_id: r for r in chat_format.collapse_and_render(spark.createDataFrame(rows, TURNS), template="[{role}|{text}]").collect()}
    assert {c: r.n_copies for c, r in found.items()} == {3: 2, 4: 1, 6: 1, 7: 2, 9: 1}
    assert found[3].rendered == "[user|a][|b][user|c]" and found[3].n_turns == 3
    assert found[6].rendered == "[user|z][user|last]"
    assert found[7].rendered == "[user|]"


def test_chat_empty(spark):
    assert chat_format.collapse_and_render(spark.createDataFrame([], TURNS)).collect() == []


def test_components_of_chain_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 299), (300, 300), (None, 5)]
    found = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 300: 299}


def test_pipeline_stages(spark):
    """Each stage's decisions on a small table, and the same rows from run()'s stages one by one."""
    from tests.llm.test_text_operators import _language_rows

    rng = random.Random(3)
    rows = [(i, t + "\n" + " ".join(rng.choice(t.split()) + str(rng.randrange(999)) for _ in range(30)), lang) for i, t, lang in _language_rows(5)[:40]]
    leak = "how many red apples does the tall farmer carry home when he sells seven of them"
    rows += [(50, rows[0][1], "bb"), (51, None, None), (52, "12345 !!", "aa"), (53, rows[2][1].split("\n")[0] + f"\nthe of the {leak} the of", "bb")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    import os
    import tempfile

    sf = tempfile.mkdtemp(prefix="spark-")
    docs.write.parquet(os.path.join(sf, "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(os.path.join(sf, "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.collect()}
    assert {51, 52} & kept["language"] == set() and {i for i, *_ in rows[:40]} <= kept["language"]
    assert 50 not in kept["lines"] and 53 in kept["lines"]
    assert 53 not in kept["benchmark"] and len(kept["benchmark"]) >= 38
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == kept["benchmark"]


def test_packing_stage_returns_token_ids(spark):
    import zlib

    docs = spark.createDataFrame([(1, "some words to pack"), (2, "more of them")], "doc_id long, text string")
    found = corpus_pipeline.packing(spark, docs, "").collect()
    assert {r.doc_id for r in found} == {1, 2}
    assert all(len(bytes(r.ids)) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in found)


def test_near_copies_stage_finds_edited_documents(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        edited = words[:]
        for k in range(1 + i % 5):
            edited[30 + 60 * k] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    rows += [(90, None), (91, ""), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert {2 * i for i in range(40)} | {90, None} <= set(kept)
    assert len(kept) <= 42 + 2, sorted(x for x in kept if x is not None and x % 2)


def test_registry_has_each_operator_once():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_oracle_sql_holds_text_only():
    import __spark_entry__ as entry

    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


def test_stages_take_empty_tables_and_clashing_columns(spark):
    import os
    import tempfile

    kind = "doc_id long, text string, lang string, source string, n_chars long, own int, exact string, h long, gone string, doc int"
    sf = tempfile.mkdtemp(prefix="spark-")
    leak = "how many red apples does the tall farmer carry home when he sells seven of them"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(os.path.join(sf, "benchmark.parquet"))
    rows = [(None, f"so {leak} then", "aa", "s", 1, 1, "e", 1, "g", 1), (1, "some words that stay", "aa", "s", 1, 1, "e", 1, "g", 1), (1, f"so {leak} again", "aa", "s", 1, 1, "e", 1, "g", 1)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.createDataFrame([], kind), sf).collect() == [], name
        found = stage(spark, spark.createDataFrame(rows, kind), sf)
        assert found.columns == [x.split()[0] for x in kind.split(", ")], name
        texts = {r.text for r in found.collect()}
        # a leaked text goes without an id too, and takes no other text of its id along
        assert rows[1][1] in texts and (name != "benchmark" or texts == {rows[1][1]}), name
