"""Removal of lines that many documents hold.

A line's key is the line without blanks at both ends, in lower case (A-Z only). Hashes of the keys that are long enough are range-partitioned and sorted by
document (largest first) and position; the sorted runs are streamed, so the first document of a key, the number of its
documents and the lines that go come from one pass. What leaves that pass is positions, gathered into one compressed keep bitmap a document; texts are
shuffled once, to meet their bitmaps.

A key that a third of all lines share doesn't fall into one task: lines are counted by bucket of hashes first, and buckets that hold more than half of a
partition's fair share (at most two for each partition, so they can be broadcast) are dealt by document as well. The slices of such a key are summed up, one row each, and told
the outcome. Only DataFrame functions are used. Keys are told apart by 96 bits of two hashes.

Defined results: an empty table gives an empty result; null and empty texts are one empty line; rows of one doc_id are one document when documents are counted; no doc_id
(null) is one document, smaller than all others (as is the least long); repeated rows get the same lines; extra columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import parallelism, table
from tabloom.sources.shared import written

LEAST_POINTS, LEAST_DOCS = 20, 3
BLANKS = " \t\n\x0b\x0c\r"
#: Lines for each partition of hashes, and buckets of hashes for each partition.
PART_LINES, BUCKETS_EACH = 1 << 20, 64
_LEAST_LONG = -(1 << 63)


def split_lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def _row_keys() -> list[Column]:
    """What tells rows apart: rows that agree in both are copies and lose the same lines."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_LONG)).alias("d"), F.xxhash64("text").alias("t")]


def long_keys(docs: DataFrame, least: int) -> DataFrame:
    """(d, t, pos, h, h2) of every line whose key has `least` code points."""
    lines = docs.select(*_row_keys(), F.posexplode(split_lines()).alias("pos", "line"))
    keys = lines.select("d", "t", "pos", key_of(F.col("line")).alias("key")).filter(F.char_length("key") >= least)
    return keys.select("d", "t", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("h2"))


def keep_bitmaps(docs: DataFrame, least: int = LEAST_POINTS, docs_least: int = LEAST_DOCS) -> DataFrame:
    """(d, t, keep) of the documents that lose lines; keep: words of 64 lines, bits of kept lines set; words that aren't listed are kept whole."""
    spark = docs.sparkSession
    keys = written(long_keys(docs, least), "lines")  # read three times: to count, to find the bounds of ranges and to sort
    lines = keys.count()
    parts = parallelism(spark, lines, PART_LINES)
    keys = keys.withColumn("b", F.pmod("h", F.lit(parts * BUCKETS_EACH)))
    hot = keys.groupBy("b").count().filter(F.col("count") > lines / (2 * parts)).select("b", F.lit(True).alias("hot"))
    dealt = keys.join(F.broadcast(hot), "b", "left").withColumn("hot", F.col("hot").isNotNull())  # 2 * parts rows at most
    dealt = dealt.select("h", "h2", F.when(F.col("hot"), F.pmod(F.xxhash64("d"), F.lit(parts))).otherwise(0).cast("int").alias("slice"), "d", "t", "pos", "hot")
    key = ["h", "h2", "slice"]
    ordered = dealt.repartitionByRange(parts, *key).sortWithinPartitions(*key, F.desc("d"), "pos")
    seen = ordered.withColumn("nth", F.dense_rank().over(Window.partitionBy(*key).orderBy(F.desc("d")))).withColumn("docs", F.max("nth").over(Window.partitionBy(*key)))
    goes = (F.col("nth") > 1) & (F.col("docs") >= docs_least)
    found = written(seen.filter(F.col("hot") | goes).select(*key, "d", "t", "pos", "hot", "nth"), "told")

    sliced = found.filter("hot").groupBy(*key).agg(F.max("nth").alias("n"), F.max("d").alias("top"))
    whole = Window.partitionBy("h", "h2")
    told = sliced.select(*key, F.sum("n").over(whole).alias("n"), F.max("top").over(whole).alias("top")).filter(F.col("n") >= docs_least)
    gone = found.filter("not hot").select("d", "t", "pos").unionByName(found.filter("hot").join(told.drop("n"), key).filter("d < top").select("d", "t", "pos"))

    bits = gone.groupBy("d", "t", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return bits.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"))


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every document."""
    dense = F.flatten(F.transform("keep", lambda s, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), (s["word"] - F.when(i == 0, 0).otherwise(F.get("keep", i - 1)["word"] + 1)).cast("int")), F.array(s["bits"]))))
    # bound as a variable, so that it is made once a document and not once a line
    kept = F.transform(F.array(dense), lambda m: F.filter(split_lines(), lambda line, i: F.coalesce(F.getbit(F.get(m, F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1))
    rows = docs.select("doc_id", "text", *_row_keys()).join(bitmaps, ["d", "t"], "left")
    return rows.select(
        "doc_id",
        F.size(split_lines()).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("keep", F.lit(0).cast("long"), lambda n, s: n + F.bit_count(F.bitwise_not(s["bits"]))), F.lit(0)).alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept[0], "\n")).alias("kept_text"),
    )


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses, and a digest of those it keeps."""
    docs = table(spark, sf_dir, "documents")
    found = without_lines(docs, keep_bitmaps(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def oracle() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d),
    keys AS (SELECT *, translate(trim(line, {blanks}), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM lines),
    often AS (SELECT key, max(doc_id) AS top FROM keys WHERE length(key) >= {LEAST_POINTS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
    kept AS (SELECT k.doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n FROM keys k LEFT JOIN often o ON k.key = o.key
             WHERE o.key IS NULL OR k.doc_id = o.top GROUP BY k.doc_id)
    SELECT d.doc_id, len(l) AS n_lines, len(l) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """
