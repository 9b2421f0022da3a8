"""Tables that grow with the input are joined by shuffle, however small their files look to Spark."""

import pytest

from quillstone.llm import decisions, group_matrix, minhash_tensor
from quillstone.shelf import Shelf


@pytest.fixture
def plans(monkeypatch):
    seen, put = [], Shelf.put

    def noted(self, df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df, name)

    monkeypatch.setattr(Shelf, "put", noted)
    return seen


def texts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(10 * k + j, " ".join([f"k{k}", *words[k : k + 40], *[f"x{j}"] * (j > 0)])) for k in range(12) for j in range(3)]
    return spark.createDataFrame([*rows, (500, rows[0][1]), (501, "one"), (None, "one")], "doc_id long, text string")


@pytest.mark.parametrize("module, f", [(minhash_tensor, "near_duplicates"), (group_matrix, "jaccard_components")])
def test_components_are_found_without_broadcasts(spark, monkeypatch, plans, module, f):
    want = {tuple(r) for r in getattr(module, f)(texts(spark)).collect()}
    plans.clear()
    monkeypatch.setattr(module, "BROADCAST_IDS", 0)
    monkeypatch.setattr(module, "CHUNK_NODES", 4)
    assert {tuple(r) for r in getattr(module, f)(texts(spark)).collect()} == want
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "BroadcastHashJoin" in p]


def test_rows_are_dropped_without_broadcasts(spark, monkeypatch, plans):
    kept = {tuple(r) for r in decisions.drop_near(texts(spark)).collect()}
    monkeypatch.setattr(decisions, "BROADCAST_KEYS", 0)
    out = decisions.drop_near(texts(spark))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == kept and 0 < len(kept) < texts(spark).count()
