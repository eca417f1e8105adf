"""Images: one photo of each set of sizes, pictures matched with blocks by name and order, scores and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import first_of, names

#: The kinds of image that are content.
CONTENT_KINDS = ("photo", "product", "artwork", "chart", "diagram", "screenshot")


def normal_line(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def photo_key(url: Column) -> Column:
    """The address without query, size marks and ending: variants of one photo share it."""
    u = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"\.[A-Za-z0-9]{2,5}$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(u, r"[-_](\d{2,4}x\d{2,4}|scaled|thumb(nail)?|small|large|medium)", ""), r"/(w|h|width|height)[_=-]?\d+", ""))


def photo_variants(photos: DataFrame, by, key: str, side: str, position: str = "i", cap: int = 40) -> DataFrame:
    """The largest photo of each key, in the place of the first; at most ``cap`` a group."""
    keys = names(by)
    rest = [c for c in photos.columns if c not in (*keys, key)]
    one = photos.groupBy(*keys, key).agg(F.max_by(F.struct(*rest), F.struct(F.col(side), -F.col(position))).alias("x"), F.min(position).alias("first"))
    return first_of(one, keys, [F.col("first")], cap).select(*keys, key, "first", "x.*")


def by_occurrence(images: DataFrame, blocks: DataFrame, by, image_key: str, block_key: str) -> DataFrame:
    """The n-th image of a name joined with the n-th block of that name, within each group (columns i_image, i_block)."""
    keys = names(by)

    def numbered(df, key, i):
        w = Window.partitionBy(*keys, key).orderBy("i")
        return df.select(*keys, F.col(key).alias("name"), F.col("i").alias(i), F.row_number().over(w).alias("n"))

    return numbered(images, image_key, "i_image").join(numbered(blocks, block_key, "i_block"), [*keys, "name", "n"])


def only_block(names_of_images: DataFrame, lines: DataFrame, by) -> DataFrame:
    """Images (name, i) whose name is a line of one block only (name, block)."""
    keys = names(by)
    owners = lines.groupBy(*keys, "name").agg(F.countDistinct("block").alias("_n"), F.min("block").alias("i_block")).where("_n = 1").drop("_n")
    return names_of_images.join(owners, [*keys, "name"]).select(*keys, "name", F.col("i").alias("i_image"), "i_block")


def attach(images: DataFrame, blocks: DataFrame, by="page_id") -> DataFrame:
    """(by, i_image, i_block): images matched to blocks by first line in page order, the rest by a line that one block without an
    image has: one image a block, one whose name is the block's longest line before others, then the earlier one."""
    keys = names(by)
    titles = blocks.select(*keys, "i", normal_line(F.get(F.split("text", "\n"), F.lit(0))).alias("title"))
    named = images.select(*keys, "i", normal_line(F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.col("alt"))).alias("title")).where(F.char_length("title") >= 4)
    first = by_occurrence(named, titles, keys, "title", "title").select(*keys, "i_image", "i_block")
    rest = named.join(first.withColumnRenamed("i_image", "i"), [*keys, "i"], "left_anti").withColumnRenamed("title", "name")
    plain = blocks.where("kind IS NULL OR kind <> 'heading'") if "kind" in blocks.columns else blocks
    lines = F.filter(F.transform(F.split("text", "\n"), normal_line), lambda x: x != "")
    all_lines = plain.select(*keys, F.col("i").alias("block"), F.explode(lines).alias("name"))
    longest = plain.select(*keys, F.col("i").alias("i_block"), F.array_max(F.transform(lines, lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"].alias("_longest"))
    more = only_block(rest, all_lines, keys).join(first.select(*keys, "i_block"), [*keys, "i_block"], "left_anti").join(longest, [*keys, "i_block"])
    more = first_of(more, [*keys, "i_block"], [(F.col("name") == F.col("_longest")).desc(), F.col("i_image")])
    return first.unionByName(more.select(*keys, "i_image", "i_block"))


def blend(text: Column, pixels: Column, searching: bool) -> Column:
    """Pixels alone when searching, else the mean; the text's score where there are no pixels."""
    return F.coalesce(pixels if searching else (text + pixels) / 2, text)


def content_probability(probabilities: Column, kinds=CONTENT_KINDS) -> Column:
    return F.aggregate(F.filter(F.map_entries(probabilities), lambda e: e["key"].isin(*kinds)), F.lit(0.0), lambda a, e: a + e["value"])


def keep(images: DataFrame, by, threshold: float, cap: int) -> DataFrame:
    return first_of(images.where(F.col("p") >= threshold), by, [F.col("p").desc(), F.col("i").asc()], cap)


def looked(images: DataFrame, refused: DataFrame, by) -> DataFrame:
    """Adds ``state``: the first image of an origin is a probe; after a refusal the origin's others are skipped."""
    keys = names(by)
    d = images.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "origin").orderBy("i"))).join(refused.select("origin").distinct().withColumn("_r", F.lit(True)), "origin", "left")
    return d.withColumn("state", F.when(F.col("_r") & (F.col("_n") == 1), "refused").when(F.col("_r"), "skipped").otherwise("looked")).drop("_n", "_r")


def listed(text: DataFrame, col: str = "value") -> DataFrame:
    """(image, page, line) of lines ``image [page]``, the first of each image."""
    parts = F.split(F.trim(F.col(col)), r"\s+")
    d = text.where(F.trim(F.col(col)) != "").select(F.get(parts, F.lit(0)).alias("image"), F.get(parts, F.lit(1)).alias("page"), "line")
    return first_of(d, "image", [F.col("line")])
