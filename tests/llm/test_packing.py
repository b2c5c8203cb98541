from __future__ import annotations

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelode.llm.packing import _encoder, TOKENIZER, pack, plan_containers, token_counts


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 400), max_size=40))
def test_plan_uses_every_item_once_and_fits(histogram):
    kinds = plan_containers(histogram, 60)
    used = Counter()
    for items, times in kinds:
        assert times > 0 and sum(size * n for size, n in items) <= 60
        for size, n in items:
            used[size] += n * times
    assert dict(used) == histogram
    containers = sum(t for _, t in kinds)
    # Never more than twice the space, as any two containers that were both under half would join.
    assert containers <= 2 * sum(s * n for s, n in histogram.items()) / 60 + 1


def test_items_whole_and_capacity_kept(spark):
    sizes = [(i, (i * 37) % 97 + 1) for i in range(3000)] + [(9001, 100), (9002, 250), (9003, 0), (9004, 1000), (9005, None), (9006, -3)]
    df = spark.createDataFrame([(k, n, 5) for k, n in sizes], "doc_id long, n_tokens int, container int")
    rows = pack(df, "doc_id", 100).collect()
    load, parts = Counter(), {}
    for r in rows:
        load[r["container"]] += r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append(r["n_tokens"])
    want = {k: max(n or 0, 0) for k, n in sizes}
    assert {k: sum(v) for k, v in parts.items()} == want
    assert all(len(parts[k]) == 1 for k, n in want.items() if n <= 100)
    assert sorted(parts[9002]) == [50, 100, 100] and parts[9004] == [100] * 10 and parts[9003] == [0]
    assert max(load.values()) <= 100
    # Next-fit would leave a quarter empty here.
    assert sum(load.values()) / (100 * len([c for c in load if load[c]])) > 0.99


def test_one_hot_length_and_empty_table(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(30).alias("n_tokens"))
    rows = pack(df, "doc_id", 100).groupBy("container").agg(F.count("*").alias("k")).collect()
    assert len(rows) == 1667 and max(r["k"] for r in rows) == 3
    assert pack(df.limit(0), "doc_id", 100).count() == 0


def test_token_counts(spark):
    texts = ["hello world", "", None, "<|endoftext|> é 日本 🙂\r\n", "a" * 50_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    encoder = _encoder(TOKENIZER)
    want = {i: len(encoder.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "doc_id", F.col("text")).collect()} == want
    assert want[0] == 2
