"""Registered queries of the package: name -> (query, SQL twin or None). Every query reads its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import divergence, language, main_text, mixing, neighbours, neural_lm, part_codes, pii, pq_join, sampling, simhash, token_store, toxicity

WEIGHTS = [5, 2, 1]
END_ID = 2
WORD_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table in enough partitions for the cluster; a table of one small file is dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) > 1 else df.repartition(cores)


def op1_pq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_join.pq_groups(_table(spark, sf_dir, "embeddings"))


def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), WEIGHTS)
    return out.withColumn("copies", F.col("copies").cast("long"))


def op3_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.segmentations(_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL), digest=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), END_ID)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(_table(spark, sf_dir, "pages"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_rows(_table(spark, sf_dir, "embeddings"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(_table(spark, sf_dir, "documents"))


def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.part_codes(_table(spark, sf_dir, "embeddings"))


def op12_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural_lm.score_texts(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    from corpus_pipeline import ORACLE_SQL, run

    return {
        "op1_pq_near_duplicates": (op1_pq_near_duplicates, PQ_SQL),
        "op2_mix_to_weights": (op2_mix_to_weights, mixing.MIX_SQL),
        "op3_sampled_segmentations": (op3_sampled_segmentations, None),
        "op4_toxicity": (op4_toxicity, None),
        "op5_token_blocks": (op5_token_blocks, None),
        "op6_language": (op6_language, None),
        "op7_main_text": (op7_main_text, None),
        "op8_nearest": (op8_nearest, None),
        "op9_simhash_groups": (op9_simhash_groups, None),
        "op10_personal_data": (op10_personal_data, None),
        "op11_part_codes": (op11_part_codes, part_codes.CODES_SQL),
        "op12_neural_lm": (op12_neural_lm, None),
        "op13_source_divergence": (op13_source_divergence, divergence.DIVERGENCE_SQL),
        "pipeline": (run, ORACLE_SQL),
    }


# all pairs of a label by brute force; components by the smallest id within reach
PQ_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, list_sum(list_transform(embedding::DOUBLE[], lambda e: e * e)) AS s
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.s > 0 AND b.s > 0 AND list_dot_product(a.x, b.x) / sqrt(a.s) / sqrt(b.s) >= 0.93),
r(vec_id, other) AS (SELECT a, b FROM p UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.other = p.a),
c AS (SELECT vec_id, min(other) AS least FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
