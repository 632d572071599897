"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_documents
from .common import table
from .exact_dedup import exact_dedup
from .langid import fit, predict
from .lattice import score_documents
from .line_dedup import line_dedup
from .media import media_round_trip
from .packing import pack_documents
from .pii import pii_documents
from .simhash import simhash_groups
from .warc import archive_pages

#: Rows of this remainder are held out of language identification; a null id counts as empty.
LANG_HELD_OUT = "crc32(coalesce(cast(doc_id AS string), '')) % 5 = 0"
#: Learn from rows whose remainder isn't 2; a null id counts as the empty string.
LM_TRAIN = "crc32(coalesce(cast(doc_id AS string), '')) % 7 <> 2"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, fit(documents, f"NOT ({LANG_HELD_OUT})"), passed=("doc_id",))
    return found.select("doc_id", F.expr(LANG_HELD_OUT).alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


OP2_SQL = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (SELECT page_id, payload, strlen(payload) AS payload_bytes,
        list_aggregate(list_transform(range(32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(sha, CAST(1 + 10 * (i // 8) AS INT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest
      FROM t)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload)
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_documents(table(spark, sf_dir, "documents")).drop("rid", "found")


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), LM_TRAIN).drop("rid")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_round_trip(table(spark, sf_dir, "documents"))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("hash")).alias("feature"), "error")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).drop("rid")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return bpe_documents(documents, vocabulary("byte_bpe_50k.json"), outputs=("ids_sha256", "decoded_sha256")).drop("rid")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    own = done.columns[-1]
    return done.select("doc_id", f"{own}.n_lines", F.size(f"{own}.removed").cast("long").alias("n_removed"), f"{own}.removed", f"{own}.partners", "text")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("rid")


OP8_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": op1_langid,
        "op2_warc": op2_warc,
        "op3_pii": op3_pii,
        "op4_lattice": op4_lattice,
        "op5_media": op5_media,
        "op6_packing": op6_packing,
        "op9_bpe": op9_bpe,
        "op7_line_dedup": op7_line_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op8_exact_dedup": OP8_SQL}
