"""Scoring of predicted against gold classes: rows (gold, predicted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import wilson
from ..sources.shared import staged


def class_scores(rows: DataFrame) -> DataFrame:
    """(class, support, predicted, hits, precision, recall): the last two null where undefined."""
    ends = rows.select(F.explode(F.array(F.struct(F.col("gold").alias("class"), F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("g"), F.lit(1).alias("p"), (F.col("gold") == F.col("predicted")).cast("int").alias("h")))).alias("x")).select("x.*")
    sums = ends.groupBy("class").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    return sums.withColumn("precision", F.round(F.col("hits") / F.nullif("predicted", F.lit(0)), 6)).withColumn("recall", F.round(F.col("hits") / F.nullif("support", F.lit(0)), 6))


def macro_f1(scores: DataFrame) -> DataFrame:
    """(macro_f1, classes): the mean over classes that occur, undefined parts counted as 0."""
    f1 = 2 * F.col("hits") / (F.col("support") + F.col("predicted"))
    return scores.where("support + predicted > 0").agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def report(rows: DataFrame) -> DataFrame:
    """(n, hits, accuracy, low, high, majority): accuracy with its interval, and the largest class's share."""
    counts = rows.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("hits"))
    total = counts.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("n").alias("m"))
    return total.select("n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"), wilson(F.col("hits"), F.col("n")).alias("w"), F.round(F.col("m") / F.col("n"), 6).alias("majority")).select("n", "hits", "accuracy", "w.low", "w.high", "majority")


def confusions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


def stratified(rows: DataFrame, by: str, key: str, take: int, seed: int = 7) -> DataFrame:
    """take rows of each class in the order of a seeded digest of their key: a sample that reruns repeat."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(drawn, key))).where(F.col("__n") <= take).drop("__n")


def _counted(rows: DataFrame) -> DataFrame:
    """(row, gold, token, n) of rows (row, gold, tokens, length), tokens in order: a token begins where the one before differs, and ends where the next begins."""
    begins = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1)))
    runs = lambda b: F.transform(b, lambda i, k: F.struct(F.get("tokens", i).alias("token"), (F.coalesce(F.get(b, k + 1), F.col("length")) - i).alias("n")))
    return rows.where("length > 0").select("row", "gold", F.explode(F.element_at(F.transform(F.array(begins), runs), 1)).alias("t")).select("row", "gold", "t.*")


def naive_bayes_held_out(rows: DataFrame) -> DataFrame:
    """(id, gold, predicted) of documents (id, gold, tokens), each classed by a multinomial naive Bayes of all others: add-one smoothing, counts less its own.

    Documents are read once and staged. Token counts of the classes are aggregated once, a row for each
    token; a document takes its own off again. Only a document's sums go on to class sizes, not its tokens.
    Documents without tokens have no result. Those of one id are scored together, each with the length of every
    one of them; of an id with several golds the best score counts.
    """
    whole = rows.select("id", "gold", F.array_sort("tokens").alias("tokens"), F.size("tokens").alias("length"), F.monotonically_increasing_id().alias("row"))
    rows = staged(whole, "bayes-rows")
    tokens = _counted(rows)
    by_class = tokens.groupBy("gold", "token").agg(F.sum("n").alias("total"))
    by_token = staged(by_class.groupBy("token").agg(F.collect_list(F.struct(F.col("gold").alias("class"), "total")).alias("totals")), "bayes-tokens")
    classes = rows.groupBy("gold").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("words"))
    vocabulary, documents = by_token.agg(F.count(F.lit(1)).alias("v")), classes.agg(F.sum("docs").alias("d"))
    sizes = F.broadcast(classes.join(vocabulary).join(documents).select(F.col("gold").alias("class"), "docs", "words", "v", "d"))
    # Only classes that have a token add to its sums (for others the logarithm is that of 1).
    mine = F.col("class") == F.col("gold")
    met = tokens.join(by_token, "token").select("row", "gold", "n", F.explode("totals").alias("t")).select("row", "gold", "n", "t.*")
    sums = met.groupBy("row", "class").agg(F.sum(F.col("n") * F.log(F.col("total") - F.when(mine, F.col("n")).otherwise(0) + 1)).alias("part"))
    # A row for each document and class: classes are the labels, a handful.
    each = rows.where("length > 0").select("id", "gold", "row", "length").join(sizes).join(sums, ["row", "class"], "left")
    each = each.join(rows.select("id", F.col("length").alias("mate")), "id")
    part = F.coalesce("part", F.lit(0.0)) - F.col("length") * F.log(F.col("words") - F.when(mine, F.col("mate")).otherwise(0) + F.col("v"))
    prior = F.log((F.col("docs") - mine.cast("int") + 1) / (F.col("d") - 1 + 2))
    scores = each.groupBy("id", "gold", "class").agg((F.sum(part) + F.max(prior)).alias("score"))
    best = F.max_by(F.struct("gold", F.col("class").alias("predicted")), F.struct(F.round("score", 6), -F.col("class"), -F.col("gold")))
    return scores.groupBy("id").agg(best.alias("b")).select("id", "b.*")
