"""Consensus sequences of groups and species barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import BITS, CODE, MASK, WORD, word_of


#: Rows of a species whose running states are one window: places in the list, by their number.
BLOCK = 16_384
_LETTERS = "".join(MASK) + "?_-"


def _words(df: DataFrame, *keys: str) -> DataFrame:
    """keys, _w, _part: each sequence cut into words of 64 positions; an empty sequence has one empty word."""
    count = F.ceil(F.length("seq") / WORD).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda w: F.substring(F.col("seq"), w * WORD + 1, F.lit(WORD)))
    return df.select(*keys, F.posexplode(cuts).alias("_w", "_part"))


def _planes(letters: dict[str, str]) -> dict[str, str]:
    return {f"_{b}": "".join(k for k, m in MASK.items() if m & bit) for b, bit in BITS.items()} | letters


def _bit(plane: str) -> str:
    return f"(shiftright({plane}, 63 - k) & 1)"


#: Of position k of a word of planes: the mask of its bases, and the code of that mask.
_BASES = " + ".join(f"{BITS[b]} * {_bit(f'_{b}')}" for b in BITS)
_CODE = f"substring('{''.join(CODE[m] for m in range(1, 16))}', cast({_BASES} as int), 1)"


def _spelled(ch: str) -> Column:
    """The text of a word, up to the longest member's end, from the expression of position k."""
    return F.expr(f"array_join(transform(sequence(0, least(63, _longest - _w * {WORD} - 1)), k -> {ch}), '')")


def _in_order(text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_w", text))), lambda x: x[text]), "")


def consensus(df: DataFrame, group: str) -> DataFrame:
    """Per group one sequence: missing wins, then bases (merged into codes), inner gaps, outer gaps.

    Positions past the end of a shorter member are missing.  Sequences are cut into words of 64
    positions, a bit for each in a few planes; words are combined before the shuffle by OR, so a
    large group costs one row of planes per word and task.
    """
    words = _words(df, group).withColumn("_part", F.rpad("_part", WORD, "?"))
    planes = _planes({"_gap": "-", "_missing": "?"})
    per = words.groupBy(group, "_w").agg(F.count(F.lit(1)).alias("_n"), *[F.bit_or(word_of(F.col("_part"), letters)).alias(p) for p, letters in planes.items()])
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.max(F.length("seq")).alias("_longest"))
    text = _spelled(f"case when _n < size or {_bit('_missing')} = 1 then '?' when {_BASES} > 0 then {_CODE} when {_bit('_gap')} = 1 then '-' else '_' end")
    parts = per.join(size, group).select(group, "size", "_w", F.when(F.col("_longest") > F.col("_w") * WORD, text).otherwise("").alias("_text"))
    return parts.groupBy(group).agg(F.max("size").alias("size"), _in_order("_text").alias("consensus"))


def barcodes(df: DataFrame, min_match: int = 1) -> DataFrame:
    """Per species with several sequences: a column keeps its consensus where enough rows agree.

    In list order, a running consensus merges bases (a missing character is replaced by the next
    one), and each row equal to it is counted; columns with fewer than min_match such rows become
    N, and N at the ends become gaps.  Species with one sequence keep it.

    `ord` is a row's place in the list, each once.  Positions past the end of a shorter row don't count
    for it; an empty sequence is one missing character, a null one no row.  Rows travel as words of 64
    positions; a species of any size is dealt out by word and block of places.  Counters hold 2^31 rows.
    """
    # a merged character only ever rises: missing, outer gap, inner gap, then more and more bases; so the
    # running consensus is the OR of the planes so far, of earlier blocks first and then row by row
    clean = F.when(F.col("seq") == "", "?").otherwise(F.regexp_replace("seq", f"[^{_LETTERS}]", "?"))
    rows = df.where("species is not null and seq is not null").select("species", "ord", clean.alias("seq"))
    planes = _planes({"_gap": "-", "_outer": "_"})
    part = F.rpad("_part", WORD, "?")
    inside = F.when(F.length("_part") >= WORD, F.lit(-1).cast("long")).otherwise(F.expr(f"shiftleft(-1L, {WORD} - length(_part))"))
    words = _words(rows, "species", "ord").select("species", "_w", F.floor(F.col("ord") / BLOCK).alias("_block"), "ord", inside.alias("_in"), *[word_of(part, letters).alias(p) for p, letters in planes.items()])
    kept, keys = [*planes, "_in"], ["species", "_w", "_block"]
    blocks = words.groupBy(*keys).agg(*[F.bit_or(p).alias(p) for p in kept])
    earlier = W.partitionBy("species", "_w").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(*keys, *[F.coalesce(F.bit_or(p).over(earlier), F.lit(0)).alias(f"{p}0") for p in kept])
    so_far = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    run = {p: F.bit_or(p).over(so_far).bitwiseOR(F.col(f"{p}0")).alias(f"{p}1") for p in planes}
    twice = F.coalesce(F.bit_or("_in").over(before), F.lit(0)).bitwiseOR(F.col("_in0")).bitwiseAND(F.col("_in")).alias("_twice")
    states = words.join(starts, keys).select("species", "_w", *kept, *run.values(), twice)
    bases = " | ".join(f"_{b}1" for b in BITS)
    same = " & ".join(f"~(_{b} ^ _{b}1)" for b in BITS)
    found = F.expr(f"_in & ((({bases}) & {same}) | (~({bases}) & ((_gap1 & _gap) | (~_gap1 & (_outer | ~_outer1)))))")
    # counters of all positions side by side: two of 32 bits in each sum
    lanes = [F.sum(F.shiftrightunsigned("_found", j).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"_s{j}") for j in range(32)]
    per = states.withColumn("_found", found).groupBy("species", "_w").agg(F.bit_or("_twice").alias("_twice"), *[F.bit_or(p).alias(p) for p in planes], *lanes)
    size = rows.groupBy("species").agg(F.count(F.lit(1)).alias("sequences"), F.max(F.length("seq")).alias("_longest"))
    count = "(shiftrightunsigned(_s[(63 - k) % 32], cast(32 * ((63 - k) div 32) as int)) & 4294967295)"
    text = _spelled(f"case when {_bit('_twice')} = 1 and {count} < {int(min_match)} then 'N' when {_BASES} > 0 then {_CODE} when {_bit('_gap')} = 1 then '-' when {_bit('_outer')} = 1 then '_' else '?' end")
    parts = per.withColumn("_s", F.array(*[f"_s{j}" for j in range(32)])).join(size, "species").select("species", "sequences", "_w", text.alias("_text"))
    out = parts.groupBy("species").agg(F.max("sequences").alias("sequences"), _in_order("_text").alias("barcode"))
    head, tail = F.regexp_extract("barcode", "^N*", 0), F.regexp_extract("barcode", "N*$", 0)
    inner = F.expr("regexp_replace(regexp_replace(barcode, '^N+', ''), 'N+$', '')")
    return out.select("species", "sequences", F.when(F.col("sequences") > 1, F.concat(F.translate(head, "N", "-"), inner, F.when(inner == "", F.lit("")).otherwise(F.translate(tail, "N", "-")))).otherwise(F.col("barcode")).alias("barcode"))
