"""The self join of suppliers lists its pairs, all of them."""

from pyspark.sql import functions as F

from quillstone import catalog
from quillstone.plans import relational

WHERE = "/root/testdata/sf0.001"


def test_every_pair_of_suppliers_is_listed(spark, monkeypatch):
    nations = {r["s_suppkey"]: r["s_nationkey"] for r in spark.read.parquet(f"{WHERE}/supplier.parquet").collect()}
    want = {(a, b) for a, m in nations.items() for b, n in nations.items() if a != b and m == n}
    for rows in (0, relational.PAIRED_ROWS):  # shuffled, broadcast
        monkeypatch.setattr(relational, "PAIRED_ROWS", rows)
        got = catalog.queries()["join_same_key_other_row"](spark, WHERE).select(F.col("a"), F.col("b")).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
