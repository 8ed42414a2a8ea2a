"""The registered queries over the synthetic tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlume.llm import decontam, lang_id, license_scan, lm_score, media, packing, pii, simhash, store, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leak = F.col("leak")
    return decontam.scan(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        leak["n_words"].alias("n_words"),
        decontam.n_hit(leak).alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"),
        (F.size(leak["items"]) >= 2).alias("contaminated"),
        *[leak[c].alias(c) for c in ("longest_match", "longest_item", "longest_item_start", "longest_doc_start")],
    )


QUERIES = {"op7_decontamination": op7_decontamination}
SQL = {}
SQL["op7_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS rid, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT rid, item, i AS k, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n
), hit AS (
  SELECT doc_id, i, k, bw.n AS n, rid, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
), steps AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, rid, i - k ORDER BY i) AS run FROM hit
), runs AS (
  SELECT doc_id, item, count(*) + min(n) - 1 AS size, min(k) - 1 AS k, min(i) - 1 AS i FROM steps GROUP BY doc_id, rid, item, i - k, run
), longest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, item, k, i) = 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated,
  CAST(size AS BIGINT) AS longest_match, item AS longest_item, CAST(k AS BIGINT) AS longest_item_start, CAST(i AS BIGINT) AS longest_doc_start
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("pii")["spans"]

    def joined(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE_KINDS]
    base = F.filter(spans, lambda x: x["kind"].isin(*pii.BASE_KINDS))
    return pii.scan(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = F.col("licence")
    return license_scan.scan(docs).select(
        "doc_id",
        r["n_words"].alias("n_words"),
        F.size(r["base_words"]).cast("long").alias("n_base"),
        F.get(r["base_words"], F.lit(0)).alias("first_word"),
        F.when(F.size(r["base_words"]) > 0, F.element_at(r["base_words"], -1)).alias("last_word"),
        F.array_join(r["base_labels"], ",").alias("base_labels"),
        F.array_join(r["labels"], ",").alias("labels"),
        r["score"].alias("score"),
        r["spans"].alias("spans"),
    )


QUERIES |= {"op8_pii": op8_pii, "op2_license_scan": op2_license_scan}


def byte_bpe() -> dict:
    """Where the public byte-level vocabulary lies, as parameters of ``packing``."""
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, **byte_bpe())
    return packed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES |= {"op10_packing": op10_packing}


def crc_mod(column: str, n: int):
    """crc32 of an id's text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def language_model_of(docs: DataFrame) -> lang_id.Model:
    learn = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2))
    return lang_id.train(learn, order_by=F.col("doc_id"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model_of(docs.select("doc_id", "text", "lang"))
    found = F.col("language")
    return lang_id.predict(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), found["lang"].alias("lang_pred"), found["score"].alias("score"), found["bits"].alias("bits"), found["n_bytes"].alias("n_bytes"))


QUERIES |= {"op1_language_id": op1_language_id}


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_score.score(docs, (crc_mod("doc_id", 5) != 1) & F.col("doc_id").isNotNull())
    return out.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES |= {"op6_lm_score": op6_lm_score}


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES |= {"op3_simhash": op3_simhash}


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = store.scratch(spark, "archives")
    warc.write_archives(pages, path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES |= {"op5_warc": op5_warc}
SQL["op5_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain | None:
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    categories = {"low_quality": bad, "toxic": toxic, "toxic_and_low": bad & toxic}
    return toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), categories)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity_chain(spark, sf_dir)
    p = F.col("toxicity")
    return toxicity.predict(docs, chain, categories=("low_quality", "toxic", "toxic_and_low")).select("doc_id", (p["toxic"] >= (chain.thresholds["toxic"] if chain else 0.5)).alias("toxic"), p["toxic"].alias("score"), p["low_quality"].alias("p_low_quality"), p["toxic_and_low"].alias("p_toxic_and_low"))


QUERIES |= {"op4_toxicity": op4_toxicity}


def mosaic(values, side: int = 96) -> bytes:
    """A square picture of 64 grey cells from 64 numbers, as a binary PGM."""
    import numpy as np

    v = np.asarray(values, float)
    low, high = v.min(), v.max()
    grey = np.round((v - low) / (high - low) * 255 if high > low else np.full(len(v), 128.0)).astype(np.uint8)
    cell = side // 8
    return b"P5 %d %d 255\n" % (side, side) + np.kron(grey.reshape(8, 8), np.ones((cell, cell), np.uint8)).tobytes()


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as pictures: vec_id and image. A null or short vector has
    no picture."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = [mosaic(v) if v is not None and len(v) == 64 and None not in v else None for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "image"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, image binary")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.search(pictures(spark, sf_dir), F.col("vec_id") % 20 == 0, "vec_id")


QUERIES |= {"op9_media": op9_media}
