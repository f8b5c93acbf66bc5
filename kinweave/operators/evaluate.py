"""Clustering quality against ground truth, all from the contingency table of predicted and true labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.scalars import basename, safe_ratio


def match_ground_truth(faces: DataFrame, truth: DataFrame, *, id_col: str = "face_id", path_col: str = "image_path", base: bool = True) -> DataFrame:
    """faces with gt_label, found by face id, else by image path, else (base) by file name; faces without any are dropped. truth: (key, gt_label)."""
    one = truth.groupBy("key").agg(F.max("gt_label").alias("gt_label"))
    levels = [F.col(id_col), F.col(path_col)] + [basename(F.col(path_col))] * base
    rows = faces
    for i, key in enumerate(levels):
        rows = rows.withColumn(f"__k{i}", key).join(one.select(F.col("key").alias(f"__k{i}"), F.col("gt_label").alias(f"__g{i}")), f"__k{i}", "left")
    found = rows.withColumn("gt_label", F.coalesce(*[f"__g{i}" for i in range(len(levels))])).filter("gt_label IS NOT NULL")
    return found.select(*faces.columns, "gt_label")


def contingency(rows: DataFrame, pred: str = "pred", truth: str = "gt") -> DataFrame:
    """(pred, gt, n) of rows with both labels and pred >= 0."""
    return rows.filter((F.col(pred) >= 0) & F.col(truth).isNotNull()).groupBy(F.col(pred).alias("pred"), F.col(truth).alias("gt")).agg(F.count("*").alias("n"))


def _pairs(n):
    return n * (n - 1) / 2


def pairwise(table: DataFrame) -> DataFrame:
    """One row of counts of pairs and precision, recall and f1, exact at any size: sums of squares of the table, its rows and its columns."""
    tp = table.agg(F.coalesce(F.sum(_pairs(F.col("n").cast("double"))), F.lit(0.0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"))
    side = lambda key, out: table.groupBy(key).agg(F.sum("n").cast("double").alias("m")).agg(F.coalesce(F.sum(_pairs(F.col("m"))), F.lit(0.0)).alias(out))
    one = tp.crossJoin(side("pred", "a")).crossJoin(side("gt", "b"))
    one = one.select("tp", (F.col("a") - F.col("tp")).alias("fp"), (F.col("b") - F.col("tp")).alias("fn"), (_pairs(F.col("total")) - F.col("a") - F.col("b") + F.col("tp")).alias("tn"))
    one = one.withColumns({"precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return one.select(*[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")], "precision", "recall", safe_ratio(2 * p * r, p + r).alias("f1"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    value = 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    return pairwise(table).select(F.when((F.col("fp") == 0) & (F.col("fn") == 0), F.lit(1.0)).otherwise(value).alias("ari"))


def normalized_mutual_information(table: DataFrame) -> DataFrame:
    """Mutual information over the mean of both entropies; 1 if both have a single class."""
    total = table.agg(F.sum("n").cast("double").alias("t"))
    rows, cols = table.groupBy("pred").agg(F.sum("n").alias("a")), table.groupBy("gt").agg(F.sum("n").alias("b"))
    cells = table.join(rows, "pred").join(cols, "gt").crossJoin(F.broadcast(total))
    mi = cells.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a").cast("double") * F.col("b")))).alias("mi"))
    entropy = lambda side, c, out: side.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(out))
    both = mi.crossJoin(entropy(rows, "a", "hu")).crossJoin(entropy(cols, "b", "hv"))
    mean = (F.col("hu") + F.col("hv")) / 2
    return both.select(F.when(mean <= 1e-15, F.lit(1.0)).otherwise(F.greatest(F.col("mi") / mean, F.lit(0.0))).alias("nmi"))


def purity(table: DataFrame) -> DataFrame:
    """(pred, size, majority_label, majority_count, purity) per cluster; of equally frequent true labels the smallest."""
    best = table.groupBy("pred").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("m"), "gt")).alias("top"))
    return best.select("pred", "size", F.col("top.gt").alias("majority_label"), (-F.col("top.m")).alias("majority_count"), (-F.col("top.m") / F.col("size")).alias("purity"))


def evaluation_report(rows: DataFrame, pred: str = "pred", truth: str = "gt") -> DataFrame:
    """One row: total, valid, noise, noise_ratio and all measures; measures are null with fewer than two valid rows."""
    counts = rows.agg(F.count("*").alias("total"), F.count_if(F.col(pred) < 0).alias("noise"))
    table = contingency(rows, pred, truth)
    valid = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("valid"))
    pure = purity(table).agg((F.sum("majority_count") / F.sum("size")).alias("purity"))
    one = counts.crossJoin(valid).crossJoin(pairwise(table)).crossJoin(adjusted_rand(table)).crossJoin(normalized_mutual_information(table)).crossJoin(pure)
    ok = F.col("valid") >= 2
    measures = ["precision", "recall", "f1", "ari", "nmi", "purity"]
    return one.select("total", "valid", "noise", safe_ratio(F.col("noise"), F.col("total")).alias("noise_ratio"), *[F.when(ok, F.col(m)).alias(m) for m in measures])


def report_text(found: DataFrame) -> DataFrame:
    """(text): each row of evaluation_report() as aligned lines, shares as percentages, measures that are null as n/a."""
    line = lambda name, value: F.concat(F.rpad(F.lit(name), 24, " "), value)
    measure = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.4f", F.col(c).cast("double")))
    noise = F.format_string("%d (%.1f %%)", F.col("noise"), F.coalesce(F.col("noise_ratio"), F.lit(0.0)).cast("double") * 100)
    names = {"ari": "adjusted Rand index", "nmi": "mutual information", "precision": "pairwise precision", "recall": "pairwise recall", "f1": "pairwise F1", "purity": "purity by size"}
    lines = [F.lit("Evaluation of the clusters"), line("faces with a truth", F.col("total").cast("string")), line("of them in clusters", F.col("valid").cast("string")), line("noise", noise)]
    return found.select(F.concat_ws("\n", *lines, *[line(n, measure(c)) for c, n in names.items()]).alias("text"))


def best_of_grid(results: DataFrame) -> DataFrame:
    """The row with the largest f1; of equal ones the first (smallest ordinal)."""
    return results.orderBy(F.desc("f1"), "ordinal").limit(1)


def rank_within(df: DataFrame, by: list[str], order: list, out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
