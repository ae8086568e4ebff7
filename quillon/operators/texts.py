"""Sparse text features: one- and two-word grams weighted by term and document frequency, and a proxy student learnt on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import new_path
from . import dual, ordering

#: What counts as a word: two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"


def grams(text: Column) -> Column:
    """The words of a text in lower case, and its pairs of neighbours with a space between."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    # an array of one binds the words, so that the text is split once
    return F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.concat(w, pairs(w))).otherwise(w))[0]


def tallied(grams_: Column) -> Column:
    """Structs of gram and n, how often a text has it, within the row: its grams are sorted, and each begins where the one before differs."""

    def runs(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
        bounds = lambda s: F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(x))), lambda a, b: F.struct(F.get(x, a).alias("gram"), (b - a).cast("long").alias("n")))
        return F.filter(F.transform(F.array(starts), bounds)[0], lambda e: e["n"].isNotNull() & e["gram"].isNotNull())

    return F.get(F.transform(F.filter(F.array(F.sort_array(grams_)), lambda x: F.size(x) > 0), runs), F.lit(0))


def counted(docs: DataFrame, key: str) -> DataFrame:
    """key, gram, n: how often a text has a gram. Counted row by row, without a shuffle; the few keys of several rows are gathered first."""
    again = docs.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_again"))
    path = new_path(docs.sparkSession, "repeated")
    again.write.parquet(path)  # of a known size, so that Spark sends it to the texts if it is small
    again = docs.sparkSession.read.schema(again.schema).parquet(path)
    same = F.col(key).eqNullSafe(F.col("_again"))
    own = docs.select(key, grams(F.col("text")).alias("_grams"))
    single = own.join(again, same, "left_anti")
    gathered = own.join(again, same, "left_semi").groupBy(key).agg(F.flatten(F.collect_list("_grams")).alias("_grams"))
    # an inner explode would have Spark ask first, by working it all out once more, whether there is anything to explode
    rows = single.unionByName(gathered).select(key, F.explode_outer(tallied(F.col("_grams"))).alias("_g")).where("_g is not null")
    return rows.select(key, F.col("_g.gram").alias("gram"), F.col("_g.n").alias("n"))


def vocabulary(counts: DataFrame, docs: DataFrame, least: int = 2) -> DataFrame:
    """gram, idf: grams in `least` documents or more, weighted by ln((1 + documents) / (1 + documents with it)) + 1."""
    total = docs.count()
    # counts dealt out by gram are read by `weighted` too: all their columns are used here, so that both read one shuffle
    seen = counts.groupBy("gram").agg(F.count(counts.columns[0]).alias("df"), F.sum("n").alias("times")).where((F.col("df") >= least) & (F.col("times") >= least))
    return seen.select("gram", (F.ln(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf"))


def entries(docs: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key, gram, n, idf, raw: the vocabulary's grams of each text, (1 + ln n) * idf, dealt out by gram: one shuffle of the counts."""
    counts = counted(docs, key).repartition("gram")
    return counts.join(vocabulary(counts, docs, least).hint("shuffle_hash"), "gram").withColumn("raw", (1 + F.ln("n")) * F.col("idf"))


def lengths(entries_: DataFrame, key: str) -> DataFrame:
    """key, n_grams, norm (Euclidean), largest and total of the values raw / norm, which need no row of their own."""
    sums = entries_.groupBy(key).agg(F.count("*").alias("n_grams"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.max("raw").alias("_top"), F.sum("raw").alias("_sum"))
    return sums.select(key, "n_grams", "norm", (F.col("_top") / F.col("norm")).alias("largest"), (F.col("_sum") / F.col("norm")).alias("total"))


def student(train: DataFrame, test: DataFrame, key: str, label: str, c: float = 3.0, least: int = 2) -> DataFrame:
    """test's key, label and predicted class code (label: 0, 1, ...) after learning from train's texts and labels (no null ones).

    Texts are what people, or a teacher, have labelled: the driver holds some numbers a labelled text, and no coefficients (`dual`). A test
    text without any gram of the vocabulary gets the prior's class; a train text without one teaches nothing; a label that all train
    texts share is predicted for all."""
    placed = ordering.positions(train.select(key, "text", F.col(label).cast("int").alias("_y")), [key, "_y", "text"], "_place").withColumn("doc", F.col("_place") - 1)
    told = placed.select("doc", "_y").toArrow()
    y = np.empty(told.num_rows, np.int64)
    y[told["doc"].to_numpy()] = told["_y"].to_numpy()
    codes = np.unique(y)
    if len(codes) < 2:
        return test.select(key, label, F.lit(int(codes[0]) if len(codes) else None).cast("int").alias("predicted"))
    kept = dual.chunks(entries(placed, "doc", least))
    a, b = dual.fitted(kept, np.searchsorted(codes, y), len(codes), c)
    learnt, free = dual.coefficients(kept, a), range(len(b))
    raw = (1 + F.ln("n")) * F.col("idf")
    sums = counted(test, key).join(learnt, "gram").groupBy(key).agg(F.sqrt(F.sum(raw * raw)).alias("_norm"), *[F.sum(raw * F.col("weights")[k]).alias(f"_sum{k}") for k in free])
    asked = test.select(key, label).join(sums, key, "left")
    z = [F.coalesce(F.col(f"_sum{k}") / F.col("_norm"), F.lit(0.0)) + float(b[k]) for k in free]
    best = (z[0] > 0).cast("int") if len(z) == 1 else F.array_position(F.array(*z), F.greatest(*z)).cast("int") - 1
    return asked.select(key, label, F.element_at(F.array(*[F.lit(int(x)) for x in codes]), best + 1).alias("predicted"))
