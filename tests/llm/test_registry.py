"""The registered queries on the smallest tables, against their SQL where there is some."""

import pytest

from packetloom.llm.registry import ORACLES, QUERIES
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert difference(spark, duck(FOLDER), QUERIES[name], ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_every_row(spark, name):
    table, key = {"op2": ("pages", "page_id"), "op10": ("conversations", "conv_id"), "op12": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    got = QUERIES[name](spark, FOLDER)
    have = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).distinct().count()
    found = got.select(key).distinct().count()
    assert 0 < found <= have if name == "pipeline" else found == have + (name.startswith("op10"))
