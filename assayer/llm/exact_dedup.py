"""Exact deduplication by content-defined chunk recipes. DataFrame and SQL functions only.

A text is cut where its own content says so: after MIN_CHUNK characters at the first end of a line or a
sentence, or where none comes soon at the first three characters of certain classes, of which any text
in Latin letters or digits has some; MAX_CHUNK is for texts that have neither. After an insertion the
cuts fall into step again within a few chunks, with or without line ends. Each chunk is named by a 64-bit hash, and the names are verified: chunks that carry
one name must agree in length and in two halves of an MD5 digest, with one row per distinct chunk
moved and not the chunk's text. A document becomes its ordered list of verified names; documents with
equal lists are copies. Text is read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, text_or_empty, with_row_key

MIN_CHUNK, MAX_CHUNK = 512, 8192
#: Ends of lines and sentences, and what cuts where they are rare: about one in forty places has it.
ENDS, CLASSES = r"\n|[.!?]\s|[\x{3002}\x{FF01}\x{FF1F}]", "[a-dA-D0-2][e-mE-M3-5][n-zN-Z6-9]"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text in pieces, in order and without loss. The empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{4 * least}}}?(?:{ENDS})|.{{{least},{most}}}?{CLASSES}|.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """rid, key, text_sha256 and parts: an array of (name, a, b, n), one for each chunk."""
    norm = with_row_key(docs.select(key, text)).select("rid", key, ascii_lower(text_or_empty(text)).alias("norm"))
    cut = norm.select("rid", key, F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("cut"))

    def named(c: Column) -> Column:
        digest = F.md5(c.cast("binary"))
        return F.struct(
            F.xxhash64(c).alias("name"),
            F.xxhash64(F.substring(digest, 1, 16)).alias("a"),
            F.xxhash64(F.substring(digest, 17, 16)).alias("b"),
            F.length(c).alias("n"),
        )

    return cut.select("rid", key, "text_sha256", F.transform("cut", named).alias("parts"))


def verified(recipe: DataFrame) -> DataFrame:
    """recipe with ids, the verified names. A name that two different chunks carry (none is expected
    below billions of chunks) is replaced by one taken from their digests."""
    seen = recipe.select("rid", F.explode("parts").alias("p")).select("rid", "p.*")
    clash = stored(
        seen.groupBy("name")
        .agg(*[f(c).alias(f"{c}{i}") for c in ("a", "b", "n") for i, f in enumerate((F.min, F.max))])
        .where("a0 <> a1 or b0 <> b1 or n0 <> n1")
        .select("name"),
        "clash",
    )
    if clash.isEmpty():
        return recipe.withColumn("ids", F.col("parts.name")).drop("parts")
    hit = seen.join(clash, "name", "left_semi").groupBy("rid").agg(F.collect_set("name").alias("bad"))
    other = lambda p: F.when(F.array_contains("bad", p["name"]), F.xxhash64(p["a"], p["b"], p["n"])).otherwise(p["name"])
    mended = recipe.join(hit, "rid", "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<bigint>")))
    return mended.withColumn("ids", F.transform("parts", other)).drop("parts", "bad")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each input row: rid, key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null counts as the empty text. Of equal
    texts the row with the largest key stays; null is the smallest key, and of rows that repeat the
    largest key one stays. Very long texts are many chunks, an empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    rows = verified(stored(recipes(docs, text, key).withColumnRenamed(key, "_key"), "recipes"))
    rows = rows.withColumn("_hash", F.xxhash64("ids"))
    groups = stored(rows.groupBy("_hash", "ids").agg(F.max(F.struct("_key", "rid")).alias("_keep"), F.count("*").alias("group_size")), "groups")
    right = groups.withColumnRenamed("ids", "_ids").withColumnRenamed("_hash", "_hash2")
    # rows of one text may be many: both sides are plain shuffles, which Spark splits where a key is hot
    out = rows.join(right, (F.col("_hash") == F.col("_hash2")) & (F.col("ids") == F.col("_ids")), "inner")
    return out.select(
        "rid",
        F.col("_key").alias(key),
        F.col("_keep._key").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("_keep.rid")).alias("kept"),
        "text_sha256",
    )
