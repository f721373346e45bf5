"""Line deduplication over a corpus, in DataFrame functions alone.

Each text is split at \\n; a line's key is the line, stripped of ASCII white space at both
ends and with A-Z lower-cased, hashed to 128 bits. The distinct keys of each document are
exploded and counted (one row per key and task reaches the shuffle, so a line that stands in a third
of all documents costs no more than others). Lines of frequent keys are found by joining
(document, position, hash) with the frequent hashes, a written table, so that Spark knows its size and can
split a hot line's rows; the positions left are put back in order.
Texts shuffle once, to meet their dropped positions.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` are
never dropped; every row counts as a document, also rows that repeat an id or a whole row; null ids are kept;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_SPACE, ascii_lower, pick, row_key, text_of, written


def line_keys(text: Column) -> Column:
    """The key of each line."""
    return F.transform(F.split(text, "\n", -1), lambda line: ascii_lower(F.btrim(line, F.lit(ASCII_SPACE))))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """h1, h2 of keys found in min_docs documents or more; docs has ``text``."""
    distinct = F.array_distinct(F.transform(F.filter(line_keys(F.col("text")), lambda k: F.char_length(k) >= min_chars), _hashed))
    return docs.select(F.explode(distinct).alias("h")).groupBy("h.h1", "h.h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text (the lines that stay), n_lines, n_dropped for every row of docs."""
    rows = pick(docs, _id=id_column, text=text_column).select("_id", text_of().alias("text"))
    frequent, _ = written(frequent_lines(rows, min_docs, min_chars), "frequent-lines")
    keyed = F.transform(line_keys(F.col("text")), lambda k: F.when(F.char_length(k) >= min_chars, _hashed(k)))
    lines = rows.select(*row_key(F.col("_id"), F.col("text")), F.posexplode(keyed).alias("pos", "h")).select("_k1", "_k2", "pos", "h.h1", "h.h2").where("h1 is not null")
    hits = lines.join(frequent, ["h1", "h2"], "left_semi").groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("drop"))
    keyed_rows = rows.select(*row_key(F.col("_id"), F.col("text")), "_id", "text")
    parts = keyed_rows.join(hits, ["_k1", "_k2"], "left").select("_id", F.split("text", "\n", -1).alias("lines"), "drop")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return parts.select(F.col("_id").alias(id_column), kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
