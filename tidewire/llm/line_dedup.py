"""Line dedup: lines are exploded and hashed, documents counted for each hash, lines over the threshold dropped, the rest joined by position.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. Keys of ``min_chars`` code points or more that are
in ``min_docs`` documents or more lose all their lines except in the largest id that holds them. Texts that are null or empty are one
empty line. Rows that repeat an id are the same document; a null id is a document before all others. Ids are integers.
Only hashes, ids and positions are shuffled for counting; each text moves once, to meet its dropped positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, same_columns, table

WS = " \t\n\x0b\f\r"
MIN_CHARS, MIN_DOCS = 20, 3


def key(line):
    return F.translate(F.btrim(line, F.lit(WS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text_col`` replaced by the kept text, and n_lines, n_dropped (columns of these names are replaced); all other columns as they are.

    A key found in very many documents is counted in two steps, (key, id) first, and met again by a join that Spark may split.
    """
    key_id, key_text, split, dropped = fresh(docs, "_id", "_th", "_lines", "_gone")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({key_id: F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), key_text: F.xxhash64(text), split: F.split(text, "\n", -1)})

    def hashed(line):
        k = key(line)
        return F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("line"), k).alias("b")))

    #: Written once, as both the counting and the join read it: hashes, ids and positions only.
    lines = table(
        rows.select(F.col(key_id).alias("i"), F.col(key_text).alias("t"), F.posexplode(F.transform(split, hashed)).alias("pos", "h"))
        .where(F.col("h").isNotNull())
        .select("i", "t", "pos", "h.a", "h.b"),
        "lines",
    )
    #: A table too, so that the join has an exchange on either side and Spark may split the rows of a line that is everywhere.
    common = lines.groupBy("a", "b").agg(F.countDistinct("i").alias("n"), F.max("i").alias("top")).where(F.col("n") >= min_docs).drop("n")
    common = table(common, "common")
    gone = lines.join(common, ["a", "b"]).where("i <> top").groupBy("i", "t").agg(F.sort_array(F.collect_set("pos")).alias(dropped)).withColumnsRenamed({"i": key_id, "t": key_text})
    met = rows.drop(text_col).join(gone, [key_id, key_text], "left").withColumn(dropped, F.coalesce(dropped, F.array().cast("array<int>")))
    #: Runs of kept lines lie between dropped positions; cutting them is linear in the lines.
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    ends = F.concat(F.col(dropped), F.array(F.size(split)))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(F.col(split), a + 1, b - a))
    out = met.withColumns({text_col: F.array_join(F.flatten(runs), "\n"), "n_lines": F.size(split).cast("long"), "n_dropped": F.size(dropped).cast("long")})
    kept = docs.drop("n_lines", "n_dropped")
    return out.select(*same_columns(kept), "n_lines", "n_dropped")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH rows_ AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM rows_),
keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id <> common.top AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
