"""The pipeline's stages on rows with planted copies, and the registered queries on the smallest tables."""

import random
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from test_llm_operators import frame, odd_rows, prose

DATA = Path("/root/testdata/sf0.001")


def test_stages(spark):
    rnd = random.Random(21)
    rows = odd_rows(22, 80)
    base = prose(rnd, "en", 800).split()
    rows += [(900, " ".join(base), "en", "src0"), (901, " ".join(base), "en", "src0"), (902, " ".join([*base[:-1], "other"]), "en", "src1")]
    docs = frame(spark, rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == frame(spark, []).columns
    ids = {name: Counter(r["doc_id"] for r in out) for name, out in seen.items()}
    assert not set(ids["language"]) & {100, 101, 102, 103} and 900 in ids["language"]
    assert 901 not in ids["exact"] and max(ids["exact"].values()) == 1 and set(ids["exact"]) <= set(ids["language"])
    assert 902 not in ids["near"] and 900 in ids["near"]
    assert max(ids["mix"].values()) <= 2 and set(ids["mix"]) <= set(ids["near"])
    first = Counter(r["doc_id"] for r in seen["pack"] if r["start"] == 0)
    assert first == ids["mix"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n.startswith("op")))
def test_query_returns_a_row_per_document(spark, name):
    table = "conversations" if name.startswith("op6_") else "documents"
    out = __spark_entry__.queries()[name](spark, str(DATA))
    n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    rows = out.count()
    if name.startswith("op6_"):
        assert rows == spark.read.parquet(f"{DATA}/{table}.parquet").select("conv_id").distinct().count() + 1
    elif name.startswith("op7_"):
        assert out.where("start = 0").count() == n
    else:
        assert rows == n
