"""The second ghost detector on odd descriptions, in both engines."""

import os

import duckdb
import pytest

from quillstone import catalog

WHERE = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "talent pool", "talent\x0bpool", "TALENT P\u0130PELINE", "tbd, duties as assigned", "x" * 199, "x" * 199 + "\u0130", "\u0130" * 150,
    "talent\npool, general\tapplication, roster\frole, ongoing\rrecruitment", "\u03a3" * 200, "tbd and perform other duties" + "y" * 300, "x" * 200,
]


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory):
    where = tmp_path_factory.mktemp("ghost")
    for f in os.listdir(WHERE):
        os.symlink(f"{WHERE}/{f}", where / f)
    os.unlink(where / "documents.parquet")
    rows = [(12 * i + k, text, "en", "a", len(text or "")) for i, text in enumerate(ODD) for k in range(12)]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY d TO '{where}/documents.parquet'")
    return str(where)


def test_odd_descriptions(spark, odd_tables):
    con = duckdb.connect()
    for f in os.listdir(odd_tables):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{odd_tables}/{f}'")
    want = {r[0]: r[1:] for r in con.sql(catalog.oracle_sql()["ghost_points"]).fetchall()}
    got = {r["id"]: (r["confidence"], r["is_ghost"]) for r in catalog.queries()["ghost_points"](spark, odd_tables).collect()}
    assert len(want) == 12 * len(ODD) and got == want
