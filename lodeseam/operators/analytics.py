"""Analytics over reports: differences, correlation of drives, stop lists, encodings, block hashes, samples, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import runs

#: Drives of a set that are paired with as many others in one row.
DRIVES_BLOCK = 256


# Differences of two reports.


def histogram_diff(pre: DataFrame, post: DataFrame, key: str = "feature", n: str = "n") -> DataFrame:
    """(key, pre, post, delta) of all keys of either histogram; equal keys are summed up first."""
    a = pre.groupBy(key).agg(F.sum(n).alias("pre"))
    b = post.groupBy(key).agg(F.sum(n).alias("post"))
    both = a.join(b, key, "full")
    return both.select(key, F.coalesce("pre", F.lit(0)).alias("pre"), F.coalesce("post", F.lit(0)).alias("post")).withColumn("delta", F.col("post") - F.col("pre"))


def ordered_diff(diff: DataFrame, key: str = "feature") -> DataFrame:
    return diff.orderBy(F.desc("delta"), key, F.desc("post"), F.desc("pre"))


def feature_diff(pre: DataFrame, post: DataFrame, place: str = "pos0", feature: str = "feature") -> DataFrame:
    """(place, pre, post, state): only_pre, only_post or differs; places that agree are left out."""
    both = pre.select(place, F.col(feature).alias("pre")).join(post.select(place, F.col(feature).alias("post")), place, "full").where("NOT pre <=> post")
    return both.withColumn("state", F.when(F.col("post").isNull(), "only_pre").when(F.col("pre").isNull(), "only_post").otherwise("differs"))


def only_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).distinct().join(b.select(column), column, "left_anti")


def in_both(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def in_either(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).union(b.select(column)).distinct()


# Correlation of drives.


def drive_counts(features: DataFrame, drive: str, feature: str = "feature") -> DataFrame:
    """(drive, feature, count)."""
    return features.groupBy(F.col(drive).alias("drive"), F.col(feature).alias("feature")).agg(F.count("*").alias("count"))


def frequencies(counts: DataFrame) -> DataFrame:
    """(feature, drives, total): on how many drives a feature is, and how often in all."""
    return counts.groupBy("feature").agg(F.count("*").alias("drives"), F.sum("count").alias("total"))


def drive_distribution(counts: DataFrame) -> DataFrame:
    """(drives, features): how many features are on so many drives."""
    return frequencies(counts).groupBy("drives").agg(F.count("*").alias("features"))


def made_stop_list(counts: DataFrame, drives: int, threshold: float) -> DataFrame:
    """Features on at least int(drives * threshold) drives."""
    return frequencies(counts).where(F.col("drives") >= int(drives * threshold)).select("feature", "drives")


def combined_context_list(*features: DataFrame) -> DataFrame:
    out = features[0].select("feature", "context")
    for f in features[1:]:
        out = out.union(f.select("feature", "context"))
    return out.distinct()


def _drive_sets(counts: DataFrame, most_drives: int | None) -> DataFrame:
    """(feature, drives, on): the sorted drives of each feature on two or more drives, at most most_drives if given."""
    sets = counts.where("feature IS NOT NULL").groupBy("feature").agg(F.count("*").alias("drives"), F.sort_array(F.collect_list("drive")).alias("on"))
    return sets.where(F.col("drives") >= 2 if most_drives is None else F.col("drives").between(2, most_drives))


def _expanded(sets: DataFrame, keep: list[str]) -> DataFrame:
    """The columns kept with each pair a < b of the row's drives; long sets are dealt in pairs of blocks."""
    blocks = F.expr(f"transform(sequence(0, greatest(size(on) - 1, 0) div {DRIVES_BLOCK}), i -> slice(on, i * {DRIVES_BLOCK} + 1, {DRIVES_BLOCK}))")
    dealt = sets.select(*keep, blocks.alias("blocks")).select(*keep, F.explode(F.expr("flatten(transform(blocks, (x, i) -> transform(slice(blocks, i + 1, size(blocks)), y -> struct(x AS x, y AS y))))")).alias("p"))
    spread = dealt.select(*keep, "p.x", "p.y").repartition("x", "y")
    return spread.select(*keep, "y", F.explode("x").alias("a")).select(*keep, "a", F.explode("y").alias("b")).where("a < b")


def drive_pairs(counts: DataFrame, most_drives: int | None = None) -> DataFrame:
    """(a, b, weight, shared): for drives a < b the sum of 1 / drives over the features on both.

    Features on the same drives are counted first, so pairs are made once for each distinct set of drives and not for each
    feature. With most_drives, only features on that many drives at most count.
    """
    sets = _drive_sets(counts, most_drives).groupBy("on", "drives").agg(F.count("*").alias("n"))
    pairs = _expanded(sets, ["drives", "n"])
    return pairs.groupBy("a", "b").agg(F.sum(F.col("n") / F.col("drives")).alias("weight"), F.sum("n").alias("shared"))


def factors(counts: DataFrame, most_drives: int | None = None, n: int = 5) -> DataFrame:
    """The n features that weigh most in each pair of drives: (a, b, rank, feature, drives).

    Of the features on the same drives only the first n can be among a pair's n, so no more of a set are paired.
    """
    first = F.row_number().over(Window.partitionBy("on", "drives").orderBy("feature"))
    sets = _drive_sets(counts, most_drives).withColumn("__first", first).where(F.col("__first") <= n)
    pairs = _expanded(sets, ["feature", "drives"])
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy("drives", "feature"))).where(F.col("rank") <= n).select("a", "b", "rank", "feature", "drives")


def drive_matches(counts: DataFrame, drive: str, most_drives: int = 10, first_over: bool = True) -> DataFrame:
    """(other, weight): how one drive's features tie it to the others.

    The drive's features count in the order of their drives and names, up to and with the first that is on more than
    most_drives drives; without first_over that one is left out too.
    """
    own = counts.where(F.col("drive") == drive).select("feature").join(frequencies(counts), "feature")
    mine = own.where(F.col("drives") <= most_drives)
    if first_over:
        mine = mine.unionByName(own.where(F.col("drives") > most_drives).orderBy("drives", "feature").limit(1))
    return counts.where(F.col("drive") != drive).join(mine, "feature").groupBy(F.col("drive").alias("other")).agg(F.sum(1 / F.col("drives")).alias("weight"))


# Statistics and samples.


def encoding_stats(features: DataFrame, drive: str, recorder: str = "recorder", encoding: str = "encoding") -> DataFrame:
    """Per recorder and encoding: drives, sum, average, largest and standard deviation of the drives' counts."""
    per = features.groupBy(drive, recorder, encoding).agg(F.count("*").alias("n"))
    return per.groupBy(recorder, encoding).agg(
        F.count("*").alias("drives"), F.sum("n").alias("total"), F.avg("n").alias("average"), F.max("n").alias("largest"), F.stddev_pop("n").alias("deviation")
    )


def hash_sample(features: DataFrame, k: int, keys: list[str], seed: int = 1) -> DataFrame:
    """k rows in the order of a hash of their keys: a sample that is the same in every run."""
    return features.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))).orderBy("__h", *keys).limit(k).drop("__h")


def accuracy(graded: DataFrame, by: str, right: str) -> DataFrame:
    return graded.groupBy(by).agg(F.count("*").alias("n"), F.count_if(right).alias("right")).withColumn("error_rate", 1 - F.col("right") / F.col("n"))


def tag_table(rows: DataFrame, keys: list[str], tag: str, value: str, tags: list[str] | None = None) -> DataFrame:
    """One column a tag; with the tags given, their values are not collected first."""
    grouped = rows.groupBy(*keys).pivot(tag, tags) if tags else rows.groupBy(*keys).pivot(tag)
    return grouped.agg(F.min(value))


# Hashes of blocks.


def source_scores(blocks: DataFrame, sources: DataFrame, block_size: int = 512) -> DataFrame:
    """(source, blocks, score): the share of a source's blocks that were found, at most 1. sources: source, filesize."""
    found = blocks.groupBy("source").agg(F.countDistinct("file_block").alias("blocks"))
    whole = F.greatest(F.ceil(F.col("filesize") / block_size), F.lit(1))
    return found.join(sources, "source").select("source", "blocks", F.least(F.col("blocks") / whole, F.lit(1.0)).alias("score"))


def block_runs(blocks: DataFrame, step: int = 8, parts: int | None = None, distinct: bool = False) -> DataFrame:
    """Runs of blocks of a source that stand `step` sectors apart on the disk and one apart in the file. See joins.runs()."""
    rows = blocks.withColumn("__phase", F.pmod(F.col("disk_block"), F.lit(step)))
    found = runs(rows, ["source", "__phase"], {"disk_block": step, "file_block": 1}, parts, distinct)
    return found.select("source", F.col("first_disk_block").alias("first_block"), F.col("last_disk_block").alias("last_block"), F.col("first_file_block").alias("file_start"), "n")


def merged_runs(runs: DataFrame, gap: int) -> DataFrame:
    """Runs of a source joined where at most `gap` sectors lie between them and the file goes on by as much."""
    w = Window.partitionBy("source").orderBy("first_block")
    joins = (F.col("first_block") - F.lag("last_block").over(w) <= gap) & (F.col("file_start") > F.lag("file_start").over(w))
    marked = runs.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("source", "__g").agg(F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"), F.sum("n").alias("n")).drop("__g")


def candidate_sources(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    return blocks.join(candidates.select("source").distinct(), "source", "left_semi")


def known_files(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """files with the name under which their first block's hash is known, or null."""
    return files.join(hashes, "md5", "left")
