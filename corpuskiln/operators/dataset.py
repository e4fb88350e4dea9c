"""Assembling data sets: splits, samples, unions, and token records of fixed length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions.text import let

IGNORE = -100


def order_key(c: Column) -> Column:
    """A pseudorandom order that other engines can repeat."""
    return F.md5(F.concat(c.cast("string"), F.lit(":order")))


def split_sizes(n: int) -> tuple[int, int, int]:
    """Rows of train, val and test: 30 % are held out, half of them for test, both rounded up."""
    held = math.ceil(0.3 * n)
    test = math.ceil(0.5 * held)
    return n - held, held - test, test


#: Rows that one range of the split should hold.
RANGE = 100_000


def split(rows: DataFrame, key: str) -> DataFrame:
    """Add ``split`` with exact sizes, in the order of a hash of the key.

    A range holds the keys whose hash begins with the same digits; places are counts before the range and
    a numbering within it.  There are enough ranges for some RANGE rows each, so no task sees many.
    """
    ordered = rows.withColumn("_o", order_key(F.col(key)))
    # a hash in hexadecimal is even over its first digits, which serve as ranges
    digits = max(1, math.ceil(math.log(max(1, rows.count()) / RANGE, 16)))
    ordered = ordered.withColumn("_r", F.substring("_o", 1, digits))
    before = ordered.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_t", F.sum("_n").over(Window.partitionBy()))
    placed = ordered.join(before.select("_r", "_b", "_t"), "_r").withColumn("_p", F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy("_o", key)))
    held = F.ceil(F.col("_t") * 0.3)
    test = F.ceil(held * 0.5)
    name = F.when(F.col("_p") <= F.col("_t") - held, "train").when(F.col("_p") <= F.col("_t") - test, "val").otherwise("test")
    return placed.withColumn("split", name).drop("_o", "_r", "_b", "_t", "_p")


def sample(rows: DataFrame, key: str, n: int = 500) -> DataFrame:
    """A fixed sample of n rows: those first in the order of a hash of the key."""
    return rows.orderBy(order_key(F.col(key)), key).limit(n)


def union(**corpora: DataFrame) -> DataFrame:
    """All rows of several corpora, with the name of theirs."""
    out = None
    for name, rows in corpora.items():
        rows = rows.withColumn("corpus", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def pad(ids: Column, length: int, value: int = 0) -> Column:
    """The first ``length`` ids, filled up with a value at the end."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value), length)), 1, length)


def decoder_record(source: Column, target: Column, length: int, pad_id: int = 0, end_id: int = 1) -> Column:
    """Inputs, shifted decoder inputs and labels of one record."""
    labels = F.concat(target, F.array(F.lit(end_id)))
    shifted = F.concat(F.array(F.lit(pad_id)), F.slice(labels, F.lit(1), F.size(labels) - 1))
    return F.struct(pad(source, length, pad_id).alias("input_ids"), pad(shifted, length, pad_id).alias("decoder_input_ids"), pad(labels, length, IGNORE).alias("labels"))


def attention_mask(ids: Column, pad_id: int = 0) -> Column:
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def unmask(labels: Column, end_id: int = 1) -> Column:
    return F.transform(labels, lambda x: F.when(x == IGNORE, end_id).otherwise(x))


def chance(key: Column, salt: Column | str) -> Column:
    """A number from 0 to 1 that a key and salt fix: the first 32 bits of the MD5 of both."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), salt.cast("string"))), 1, 8), 16, 10).cast("double") / (1 << 32)


def mask_words(words: Column, key: Column, share: float = 0.1, mask: str = "<mask>") -> Column:
    return F.transform(words, lambda w, i: F.when(chance(key, i) < share, mask).otherwise(w))


def permute_sentences(sentences: Column, key: Column) -> Column:
    marked = F.transform(sentences, lambda s, i: F.struct(chance(key, i).alias("c"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(marked), lambda x: x["s"])


def roll(words: Column, key: Column) -> Column:
    """Words turned by a number of places that the key fixes."""
    n = F.size(words)
    k = F.floor(chance(key, "roll") * n).cast("int")
    return F.when(n > 0, F.concat(F.slice(words, k + 1, F.greatest(n - k, F.lit(0))), F.slice(words, F.lit(1), k))).otherwise(words)


def replace_some(words: Column, key: Column, sounds: dict[str, str], share: float = 0.2) -> Column:
    """Words put into another spelling, each with a chance; a dictionary gives the spellings."""
    table = F.create_map(*(F.lit(x) for kv in (sounds or {"": ""}).items() for x in kv))
    return F.transform(words, lambda w, i: F.when(chance(key, i) < share, F.coalesce(F.try_element_at(table, w), w)).otherwise(w))


def number_range(start: float, end: float, step: float) -> Column:
    """Numbers from start up to but without end."""
    n = max(0, math.ceil((end - start) / step - 1e-9))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(start) + i * step) if n else F.array().cast("array<double>")


def steps(n_rows: int, batch: int, devices: int = 1, epochs: int = 1, warmup: float = 0.1, accumulate: int = 1) -> dict[str, int]:
    """Training steps, warm-up steps and how often to log."""
    per = max(1, math.ceil(n_rows / max(1, batch * devices * accumulate)))
    return {"per_epoch": per, "total": per * epochs, "warmup": int(per * epochs * warmup), "log_every": max(1, min(50, per))}


def softmax(values: Column) -> Column:
    """The softmax of an array of numbers; an empty array stays empty."""
    powers = lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return let(powers(values), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def best_so_far(scores: DataFrame, by: str = "gleu") -> DataFrame:
    """The row of the best score; of equals the earliest ``epoch``."""
    return scores.orderBy(F.desc(by), "epoch").limit(1)


def spacing_errors(sides: DataFrame) -> DataFrame:
    """Share of sides whose number of spaces a grouping got wrong: ``n_spaces`` and ``n_groups`` of each."""
    wrong = F.count_if(F.col("n_spaces") + 1 != F.col("n_groups"))
    return sides.agg(F.count("*").alias("n_sides"), wrong.alias("n_wrong"), (wrong * 100.0 / F.count("*")).alias("percent"))
