"""Sources and sinks: page links, article files, image folders, versioned stores."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import or_else
from lodestone.sources import versions

# Link forms and image kinds.
ARTICLE_LINK = r"(?i)knowledgebase\.php\?article=(\d+)"
CATEGORY_LINK = r"(?i)knowledgebase\.php\?category=(\d+)"
IMAGE_KINDS = ("png", "jpg", "jpeg", "gif", "webp", "svg")


def linked_ids(html: Column, pattern: str = ARTICLE_LINK) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def discovered(pages: DataFrame, pattern: str = ARTICLE_LINK) -> DataFrame:
    """Distinct ids that any page links to."""
    return pages.select(F.explode(linked_ids(F.col("html"), pattern)).alias("article_id")).distinct()


def category_scan(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles that the wanted categories' pages link to (article_id, categories: how many name it), and the categories that gave none (category_id, reason).

    pages: category_id, html, error (null for a page that was fetched), at most a row a category; wanted: category_id.
    Only wanted categories count; links to further categories are not followed.  A page that failed or is missing
    is a row of the second table and costs the others nothing.
    """
    asked = wanted.select("category_id").distinct().join(pages.select("category_id", "html", "error", F.lit(True).alias("_there")), "category_id", "left")
    good = F.col("error").isNull() & F.col("html").isNotNull()
    linked = asked.filter(good).select("category_id", linked_ids(F.col("html")).alias("ids"))
    found = linked.select(F.explode("ids").alias("article_id")).groupBy("article_id").agg(F.count("*").alias("categories"))
    reason = F.when(F.col("_there").isNull(), "no page").when(~good, F.coalesce("error", F.lit("no text"))).when(F.size(linked_ids(F.col("html"))) == 0, "no article")
    return found, asked.select("category_id", reason.alias("reason")).filter("reason IS NOT NULL")


def crawled(pages: DataFrame) -> DataFrame:
    """Pages with a cleaned text that is not empty, by number."""
    from lodestone.functions import html

    rows = pages.select(F.col("page_id").cast("string").alias("article_id"), "url", "html", html.clean_html(F.col("html")).alias("text"))
    named = rows.filter(F.length("text") > 0).withColumns({"title": F.coalesce(html.extract_title(F.col("html")), F.concat(F.lit("Article "), "article_id")), "category": html.extract_category(F.col("html"))})
    return named.select("article_id", "title", "category", "url", "text").orderBy(F.col("article_id").cast("long"))


def write_articles(articles: DataFrame, path: str) -> None:
    articles.select("article_id", "title", "category", "url", "text").write.mode("overwrite").json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article files with the length of the text; unreadable ones have nulls."""
    rows = spark.read.schema("article_id string, title string, category string, url string, text string").option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("n_chars", F.length("text"))


def image_folder(spark: SparkSession, path: str, metadata: DataFrame) -> DataFrame:
    """Images of a folder with what a side table (filename, image_id, caption, alt_text, article_id, category, keywords) says of them.

    filepath is the path within the file system; an image without an id is named by its hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:(?://[^/]*)?(?=/)", "").alias("filepath")).withColumn("filename", F.element_at(F.split("filepath", "/"), -1))
    kept = named.filter(F.lower(F.element_at(F.split("filename", r"\."), -1)).isin(*IMAGE_KINDS))
    j = kept.join(metadata, "filename", "left")
    filled = j.withColumn("image_id", or_else(F.col("image_id"), F.substring(F.sha2("filepath", 256), 1, 16))).withColumn("caption", F.coalesce("caption", "filename"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    described = F.concat_ws(" | ", "caption", blank("alt_text"), blank("category"), F.concat(F.lit("article "), blank("article_id")))
    return filled.withColumns({"static_path": F.concat(F.lit("/static/images/"), F.col("filename")), "embed_text": described})


def inline_images(sources: DataFrame) -> DataFrame:
    """image_id, extension, data of data addresses (src) that can be decoded; an unknown kind is .png."""
    kind = F.lower(F.regexp_extract("src", r"^data:image/([a-zA-Z0-9.+-]+)", 1))
    body = F.expr(r"try_to_binary(regexp_replace(regexp_extract(src, '^data:image/[^,]*;base64,(.*)$', 1), '\\s', ''), 'base64')")
    known = F.create_map(*[F.lit(x) for k, e in {"png": ".png", "jpeg": ".jpg", "jpg": ".jpg", "gif": ".gif", "webp": ".webp", "svg+xml": ".svg"}.items() for x in (k, e)])
    rows = sources.select("src", F.coalesce(F.try_element_at(known, kind), F.lit(".png")).alias("extension"), body.alias("data")).filter("src rlike '^data:image/[^,]*;base64,' and octet_length(data) > 0")
    return rows.select(F.substring(F.sha2(F.sha2("data", 256), 256), 1, 16).alias("image_id"), "extension", "data")


def static_path(path: Column, filename: Column) -> Column:
    return F.when(path.isNull(), F.concat(F.lit("/static/images/"), filename)).otherwise(path)


class Store:
    """A table in versions: each write is a new folder, and the newest version's file names the one to read.

    Of two writers that publish at once one begins again after the other, so no write is lost unseen and readers see whole tables.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{folder}")
        while True:
            number, _ = versions.latest(self.spark, f"{self.path}/_versions")
            try:
                versions.publish(self.spark, f"{self.path}/_versions", number + 1, {"folder": folder})
                return folder
            except versions.Conflict:
                continue

    def read(self) -> DataFrame:
        state = versions.latest(self.spark, f"{self.path}/_versions")[1]
        if state is None:
            raise ValueError(f"nothing is stored at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{state['folder']}")
