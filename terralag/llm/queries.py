"""The queries op1 to op13, with SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralag.llm import decontaminate, embedding_dedup, html_text, langid, line_dedup, merkle, packing, pii, resample, secret_scan, simhash_dedup, suffix_tree, token_count
from terralag.llm.common import slices, table, texts
from terralag.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"), width=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, t.line AS line, t.i AS i,
         translate(trim(t.line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) t
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM lines l LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_chars=20, min_docs=3))

    def digest(batches):
        for part in slices(batches):
            rows = []
            for text, bitmap in zip(texts(part), part.column("bitmap").to_pylist(), strict=True):
                lines = text.split("\n")
                if bitmap is None:
                    rows.append((len(lines), 0, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
                    continue
                keep = line_dedup.keep_mask(bitmap, len(lines))
                kept = "\n".join([x for x, k in zip(lines, keep, strict=True) if k])
                rows.append((len(lines), len(lines) - int(keep.sum()), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            n, gone, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), size=1024)
    return packing.pieces(packed)


@query("op4_pii_anchors")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents")))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(4, 2)))
    return langid.predict(docs.select("doc_id", "text", langid.held_out(4, 2).alias("held_out")), model).drop("text")


@query("op3_suffix_tree_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.language_model_scores(table(spark, sf_dir, "documents"), langid.held_out(7, 2))


@query("op2_embedding_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_html_layout_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query("op11_importance_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = resample.importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_secret_scan", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secrets(table(spark, sf_dir, "documents")))


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), arity=3, changed={"text": tampered})
    text = merkle.hex_text
    rows = rows.select("doc_id", text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"), F.sha2(merkle.proof_text(F.col("steps")), 256).alias("proof_sha256"), merkle.fold(text(F.col("other")), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
