"""Exact deduplication: a two-pass Bloom filter picks the rows that have to meet.

Pass 1 hashes every text to two slots of a bit table and keeps, as bits, the slots
that at least two rows chose. Only hashes move, summed before the shuffle. Pass 2 tests
each row against the bits: a row with a slot of its own has no equal and passes straight
through. The others, equal texts and false positives, are grouped by SHA-256.

The bit tables are broadcast. Their size is bounded by ``max_bits`` (2 * max_bits / 8
bytes: 4 MB by default), whatever the input: with more rows than bits more rows shuffle,
about 50 bytes each, and the result stays exact.

Defined cases: a null text counts as empty; a null id is smaller than any other; rows that
repeat id and text whole are ordered by their other columns, and one of them stays; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pick, text_of, written

#: Slots of a bit table that share one row of it.
BLOCK_BITS = 1 << 13


def table_bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    """A power of two, at most max_bits or one block."""
    bits = BLOCK_BITS
    while bits < rows * bits_per_row and 2 * bits <= max_bits:
        bits *= 2
    return bits


def _slots(text: Column, bits: int) -> list[Column]:
    """Two slots from independent hashes of the text."""
    return [F.pmod(F.xxhash64(text), F.lit(bits)), F.pmod(F.xxhash64(F.lit(1), text), F.lit(bits))]


def repeated_bits(texts: DataFrame, bits: int) -> DataFrame:
    """Pass 1 over column ``text``: (bit_table, block, words), the slots of two rows or more as 64-bit words."""
    slots = [F.struct(F.lit(i).alias("bit_table"), slot.alias("slot")) for i, slot in enumerate(_slots(F.col("text"), bits))]
    twice = texts.select(F.explode(F.array(*slots)).alias("c")).groupBy("c.bit_table", "c.slot").agg(F.count("*").alias("n")).where("n > 1")
    words = (
        twice.withColumn("block", F.shiftright("slot", 13))
        .withColumn("word", F.shiftright(F.col("slot").bitwiseAND(BLOCK_BITS - 1), 6).cast("int"))
        .groupBy("bit_table", "block", "word")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    )
    sets = words.groupBy("bit_table", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))
    zero = F.lit(0).cast("long")
    return sets.select("bit_table", "block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("set", i), zero)).alias("words"))


def possibly_repeated(rows: DataFrame, text: Column, bits_per_row: int = 16, max_bits: int = 1 << 24) -> DataFrame:
    """Pass 2: rows with a boolean column ``_maybe``, false only where no other row has the text."""
    texts = rows.select(text.alias("text"))
    bits = table_bits(texts.count(), bits_per_row, max_bits)
    table, _ = written(repeated_bits(texts, bits), "repeated-bits")
    own = rows.columns
    for i, slot in enumerate(_slots(text, bits)):
        words = F.broadcast(table.where(F.col("bit_table") == i).select(F.col("block").alias(f"_block{i}"), F.col("words").alias(f"_words{i}")))
        rows = rows.withColumn(f"_slot{i}", slot).join(words, F.shiftright(F.col(f"_slot{i}"), 13) == F.col(f"_block{i}"), "left")
    bit = [F.coalesce(F.expr(f"getbit(_words{i}[cast(shiftright(_slot{i} & {BLOCK_BITS - 1}, 6) as int)], cast(_slot{i} & 63 as int))"), F.lit(0)) for i in (0, 1)]
    return rows.select(*own, ((bit[0] == 1) & (bit[1] == 1)).alias("_maybe"))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Of equal texts the row with the largest id stays. With keep_columns the result holds all
    columns of docs instead, of the rows that stay.
    """
    width = len(docs.columns)
    flat = docs.toDF(*[f"_c{i}" for i in range(width)])
    if keep_columns:
        at = {name: f"_c{i}" for i, name in reversed(list(enumerate(docs.columns)))}
    else:
        flat, at = pick(docs, _c0=id_column, _c1=text_column), {id_column: "_c0", text_column: "_c1"}
    the_id, text = F.col(at[id_column]), text_of(at[text_column])
    others = [F.col(name) for name, kind in flat.dtypes if "map<" not in kind and "variant" not in kind]
    rows = possibly_repeated(flat, text).withColumn("_sha", F.unhex(F.sha2(text, 256)))
    alone = rows.where(~F.col("_maybe")).select(*flat.columns, "_sha", the_id.alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"))
    meet = rows.where("_maybe")
    # written, so that the join reads an exchange on both sides and Spark can split a large group
    groups, _ = written(meet.groupBy("_sha").agg(F.max(the_id).alias("_keep"), F.count("*").alias("_size")), "groups")
    turn = F.row_number().over(Window.partitionBy("_sha", the_id).orderBy(F.xxhash64(*others)))
    met = meet.withColumn("_turn", turn).join(groups, "_sha").select(*flat.columns, "_sha", "_keep", "_size", (the_id.eqNullSafe(F.col("_keep")) & (F.col("_turn") == 1)).alias("_kept"))
    both = alone.unionByName(met)
    if keep_columns:
        return both.where("_kept").select(*flat.columns).toDF(*docs.columns)
    return both.select(the_id.alias(id_column), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
