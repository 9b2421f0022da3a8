"""The thin queries over the training-data operators, and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.block_naming import exact_duplicates
from quillstone.llm.forced_bpe import encode_digests
from quillstone.llm.group_matrix import jaccard_components
from quillstone.llm.hilbert import hilbert_shards
from quillstone.llm.isomedia import media_index
from quillstone.llm.lexical_blocks import ranked_search
from quillstone.llm.minhash_tensor import near_duplicates
from quillstone.llm.nnls_packing import pack
from quillstone.llm.periodic_runs import run_digests
from quillstone.llm.preference import preference_pairs
from quillstone.llm.quality_pu import quality
from quillstone.llm.suffix_dedup import removal_digests
from quillstone.llm.toxicity_zstd import toxicity
from quillstone.session import spread


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def _spelt(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k is taken as chosen, 2k + 1 as rejected."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    sides = turns.withColumn("pair", F.expr("conv_id div 2")).withColumn("is_rejected", F.col("conv_id") % 2 != 0)
    return preference_pairs(sides, "pair", "is_rejected").withColumns({c: _spelt(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op4_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(documents(spark, sf_dir))


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))


def op6_isomedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_index(documents(spark, sf_dir))


def op7_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


def op8_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), tokenizer_path())


def op9_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def op11_sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(documents(spark, sf_dir))


def op12_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP3_SQL = """
WITH t AS (SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT pair_id, min(conv_id) FILTER (side = 0) AS chosen_conv, min(conv_id) FILTER (side <> 0) AS rejected_conv,
             count(*) FILTER (side = 0) AS n_chosen, count(*) FILTER (side <> 0) AS n_rejected FROM t GROUP BY pair_id),
m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.pos, b.pos)) AS first_diff
      FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side <> 0) b ON a.pair_id = b.pair_id AND a.pos = b.pos
      WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
c AS (SELECT n.*, coalesce(m.first_diff - 1, n.n_chosen) AS n_common FROM n LEFT JOIN m USING (pair_id)),
r AS (SELECT t.*, c.n_common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS seg FROM t JOIN c USING (pair_id)),
o AS (SELECT *, sum(length(seg)) FILTER (pos > n_common) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM r),
s AS (SELECT pair_id, side,
        coalesce(string_agg(seg, '' ORDER BY pos) FILTER (pos <= n_common), '') AS prompt,
        coalesce(string_agg(seg, '' ORDER BY pos) FILTER (pos > n_common), '') AS completion,
        coalesce(string_agg(CAST(upto - length(text) - 11 AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY pos) FILTER (pos > n_common AND role = 'assistant'), '') AS spans
      FROM o GROUP BY pair_id, side)
SELECT c.pair_id, c.chosen_conv, c.rejected_conv, CAST(c.n_common AS INT) AS n_common, CAST(c.n_chosen AS INT) AS n_chosen, CAST(c.n_rejected AS INT) AS n_rejected,
       coalesce(a.prompt, '') AS prompt, a.completion AS chosen, b.completion AS rejected, coalesce(a.spans, '') AS chosen_spans, coalesce(b.spans, '') AS rejected_spans
FROM c LEFT JOIN (SELECT * FROM s WHERE side = 0) a USING (pair_id) LEFT JOIN (SELECT * FROM s WHERE side <> 0) b USING (pair_id)
"""

OP9_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, arg_max(doc_id, (points, -doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


#: Terms, their counts and weights, and every document that has a term of an item.
OP12_SQL = r"""
WITH f AS MATERIALIZED (
  SELECT doc_id, x, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM documents) GROUP BY doc_id, x),
q AS MATERIALIZED (
  SELECT item_id, x, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark) GROUP BY item_id, x),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // total AS m FROM d, s),
w AS (SELECT x, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT x, count(*) AS df FROM f GROUP BY x), s),
r AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (x) JOIN f USING (x) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

#: Sets of word shingles, pairs by their common shingles, and the least doc_id that links lead to.
OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS k FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS class FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT class, min(doc_id) AS first, any_value(n) AS n FROM n GROUP BY class),
r AS MATERIALIZED (SELECT c.first, c.n, s.x FROM c JOIN s ON s.doc_id = c.first),
p AS MATERIALIZED (
  SELECT a.first AS u, b.first AS v FROM r a JOIN r b ON a.x = b.x AND a.first < b.first AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.first, b.first, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT u, v FROM p UNION SELECT v, u FROM p),
reach AS (SELECT u AS root, u AS node FROM e UNION SELECT reach.root, e.v FROM reach JOIN e ON reach.node = e.u),
least AS (SELECT root, min(node) AS m FROM reach GROUP BY root)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.m, c.first, w.doc_id) AS component_id, coalesce(least.m, c.first, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (class) LEFT JOIN least ON least.root = c.first
"""


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_toxicity": op2_toxicity,
        "op3_preference": op3_preference,
        "op4_suffix_sort": op4_suffix_sort,
        "op5_hilbert": op5_hilbert,
        "op6_isomedia": op6_isomedia,
        "op7_minhash_tensor": op7_minhash_tensor,
        "op8_forced_bpe": op8_forced_bpe,
        "op9_block_naming": op9_block_naming,
        "op10_nnls_packing": op10_nnls_packing,
        "op11_sync_runs": op11_sync_runs,
        "op12_geometric_blocks": op12_geometric_blocks,
        "op13_group_matrix": op13_group_matrix,
    }


def oracle_sql() -> dict:
    return {"op3_preference": OP3_SQL, "op9_block_naming": OP9_SQL, "op12_geometric_blocks": OP12_SQL, "op13_group_matrix": OP13_SQL}
