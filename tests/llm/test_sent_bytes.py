"""What op4 sends to shards of a phrase that many documents have between different words."""

import random

from pyspark.sql import functions as F

from quillstone.llm import suffix_dedup
from quillstone.shelf import Shelf


def test_common_phrases_are_not_sent_window_by_window(spark, monkeypatch):
    r = random.Random(11)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = [letters(90) + " a phrase of nearly all documents here " + letters(90) for _ in range(1500)]
    texts.append("FIRST" + texts[7][60:160] + "LAST")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sent, put = [], Shelf.put

    def noted(self, df, name):
        out = put(self, df, name)
        if name == "sent":
            sent.append(out.filter("shard >= 0").agg(F.sum("n_bytes")).first()[0])
        return out

    monkeypatch.setattr(Shelf, "put", noted)
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in suffix_dedup.removal_digests(docs).filter("n_removed > 0").collect()}
    assert got == {1500: (100, 1)}, got
    assert 0 < sent[0] < 2 * sum(map(len, texts)), sent
