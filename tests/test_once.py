"""Expressions that text queries name many times are worked out once a row."""

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import scoring as S
from quillstone.operators import screening as G

ROWS = ["one two three four five six seven eight", "short text", "", None, "- Build a data pipeline with python\nLead the whole team of engineers\n" * 3]


def plan_size(make, word):
    """How often the expression names word."""
    return str(make(F.col("t"))._jc.toString()).count(word)


def test_a_text_is_named_once(spark):
    spark.range(1)
    assert plan_size(lambda t: T.ngrams(F.lower(t), 6), "lower") == 1
    assert plan_size(lambda t: T.ngram_hashes(F.lower(t), 6), "lower") == 1
    assert plan_size(lambda t: S.duty_coverage(t, "- python and sql for many teams"), "lower(t)") == 1
    assert plan_size(G.specificity, "lower") == 1


def test_values_stay(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ROWS)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(T.ngrams(F.col("t"), 6)).collect()]
    plain = lambda t: [] if t is None else [" ".join(t.split()[k : k + 6]) for k in range(len(t.split()) - 5)]
    assert [x or [] for x in got] == [plain(t) for t in ROWS]
    assert [len(r[0] or []) for r in df.select(T.ngram_hashes(F.col("t"), 6)).collect()] == [len(plain(t)) for t in ROWS]
    found = [r[0] for r in df.select(S.duty_coverage(F.col("t"), "- python and sql in a data pipeline of teams")).collect()]
    assert found[4]["matched"] == ["Build a data pipeline with python"] * 3 and found[4]["uncovered"] == ["Lead the whole team of engineers"]
    assert found[2]["kinds"].asDict() == dict.fromkeys((k for k, _, _ in S.DUTY_KINDS), 75.0)
