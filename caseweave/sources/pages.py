"""Reading pages, side-cars, files and logs; listings; writing results."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions.classify import PREDICTION
from caseweave.functions.extract import page_info
from caseweave.functions.predicates import needs_ocr
from caseweave.functions.text import WS_CHARS, file_name, public_path, strip
from caseweave.operators.split import first_rows, split_row_number


def scan_pages(df: DataFrame, types: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """Recognised pages: completed, with text, of the given types. Filters reach the scan."""
    d = df.filter((F.col("status") == "completed") & (F.col("text") != ""))
    if types:
        d = d.filter(F.col("type").isin(*types))
    return d.orderBy("page_number", "page_id") if ordered else d


ANALYSIS = (
    f"ocr_status string, ocr_text string, ocr_file_path string, prediction {PREDICTION}, "
    "classifier_version string, analyzed_at string"
)


def light_analysis(df: DataFrame) -> DataFrame:
    """Without the large text: has_text and text_length in its place."""
    return df.withColumns(
        {
            "has_text": F.coalesce(F.col("ocr_text") != "", F.lit(False)),
            "text_length": F.length(F.coalesce(F.col("ocr_text"), F.lit(""))),
        }
    ).drop("ocr_text")


def read_page_analysis(spark: SparkSession, path: str) -> DataFrame:
    """One side-car file per page; a file that is no JSON gives nulls."""
    d = spark.read.schema(ANALYSIS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return light_analysis(d.withColumn("file_name", F.col("_metadata.file_name")))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Names and sizes only: the content column is never read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return d.select("path", "length", file_name(F.col("path")).alias("file_name"))


PAGE_NAME = r"(?i)^(case[0-9]+_[A-Za-z0-9]+)-([0-9]+)\.(png|jpg|jpeg)$"


def list_pages(files: DataFrame, meta: DataFrame, imported: DataFrame) -> DataFrame:
    """Page files with prefix and number, the metadata of their file and an imported flag.

    ``meta``: prefix, source_name, source_type. ``imported``: file_name, page_id.
    """
    d = files.filter(F.col("file_name").rlike(PAGE_NAME)).select(
        "file_name",
        F.regexp_extract("file_name", PAGE_NAME, 1).alias("prefix"),
        F.regexp_extract("file_name", PAGE_NAME, 2).try_cast("int").alias("page_number"),
    )
    ids = imported.groupBy("file_name").agg(F.min("page_id").alias("page_id"))
    return (
        d.join(meta, "prefix", "left")
        .join(ids, "file_name", "left")
        .withColumn("imported", F.col("page_id").isNotNull())
    )


def import_library(files: DataFrame, existing: DataFrame, stats: DataFrame, force: bool = False) -> DataFrame:
    """Route each library file: protected, skipped, needs_ocr, imported or failed.

    ``files``: path, pages, chars, chunks; ``existing``: doc_id, path, file_name;
    ``stats``: doc_id, protected. A path match goes before a name match.
    """
    name = file_name(F.col("path"))
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    f = files.withColumns({"file_name": name, "ext": ext}).filter(
        F.col("ext").isin("pdf", "docx") & ~F.startswith("file_name", F.lit("~$"))
    )
    by_path = existing.groupBy("path").agg(F.min("doc_id").alias("_by_path"))
    by_name = existing.groupBy("file_name").agg(F.min("doc_id").alias("_by_name"))
    d = (
        f.join(by_path, "path", "left").join(by_name, "file_name", "left")
        .withColumn("doc_id", F.coalesce("_by_path", "_by_name")).drop("_by_path", "_by_name")
        .join(stats.select("doc_id", "protected"), "doc_id", "left")
    )
    known = F.col("doc_id").isNotNull()
    state = (
        F.when(known & F.coalesce("protected", F.lit(False)), "protected")
        .when(known & F.lit(not force), "skipped")
        .when((F.col("ext") == "pdf") & needs_ocr(F.col("chars"), F.col("pages")), "needs_ocr")
        .when(F.col("chunks") > 0, "imported")
        .otherwise("failed")
    )
    return d.withColumn("status", state).drop("protected")


def write_partitioned(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet") -> None:
    """Replace only the partitions that ``df`` holds."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys).format(fmt).save(path)
    )


LOG_LINE = r"^(\S+ \S+) \[([A-Z]+)\] ([^:]+): (.*)$"


def tail_log(df: DataFrame, n: int = 100, level: str | None = None, longest: int = 500) -> DataFrame:
    """The last ``n`` lines, and only then the level filter."""
    d = df.orderBy(F.col("line_no").desc()).limit(min(n, longest))
    if level and level.upper() in ("DEBUG", "INFO", "WARNING", "ERROR"):
        d = d.filter(F.contains("line", F.lit(f"[{level.upper()}]")))
    names = ["logged_at", "level", "logger", "message"]
    return d.select("line_no", "line", *[F.regexp_extract("line", LOG_LINE, i + 1).alias(c) for i, c in enumerate(names)])


def pivot_settings(kv: DataFrame, keys: list[str]) -> DataFrame:
    """One wide row; a missing key is an empty string."""
    wide = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys]
    return kv.filter(F.col("key").isin(*keys)).agg(*wide).fillna("")


def upsert_settings(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("key"), "key", "left_anti").unionByName(new.select(*old.columns))


def append_numbered(
    existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column], bucket: Column,
    number: str = "page_number", label: str | None = None,
) -> DataFrame:
    """New rows numbered on from the count of their group (one shuffle, hot groups split)."""
    base = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_base"))
    d = split_row_number(new, keys, order, bucket, "_rn").join(base, keys, "left")
    d = d.withColumn(number, F.col("_rn") + F.coalesce("_base", F.lit(0))).drop("_rn", "_base")
    if label:
        d = d.withColumn("description", F.concat(F.lit(label), F.col(number).cast("string")))
    return existing.unionByName(d, allowMissingColumns=True)


def list_children(df: DataFrame, wanted: DataFrame, key: str = "case_id", kind: str | None = None, order: list[Column] | None = None) -> DataFrame:
    d = df if kind is None else df.filter(F.col("type") == kind)
    d = d.join(wanted.select(key).distinct(), key, "left_semi")
    return d.orderBy(*order) if order else d


def explode_paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line with its position."""
    rest = [c for c in df.columns if c != text]
    d = df.select(*rest, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "paragraph"))
    return d.withColumn("paragraph", strip(F.col("paragraph"))).filter(F.col("paragraph") != "")


def sequence_key(info: Column, page: Column, ident: Column) -> list[Column]:
    """Page order: pages with a file position first, then numbered ones, then by id."""
    own = info.isNull()
    return [
        own.cast("int"),
        F.coalesce(info["prefix"], F.lit("")),
        F.when(own, page.isNull().cast("int")).otherwise(info["number"]),
        F.when(own, F.coalesce(page, F.lit(0))).otherwise(F.lit(0)),
        ident,
    ]


def source_payload(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Best source page of a group and the number of its pages; null-safe when there is none."""
    info = page_info(F.col("file_name"))
    best = F.min_by(
        F.struct("page_id", "file_name", "page_number", "path", info["number"].alias("original")),
        F.struct(*sequence_key(info, F.col("page_number"), F.col("page_id"))),
    )
    per = pages.groupBy("group_id").agg(best.alias("_s"), F.count(F.lit(1)).alias("source_count"))
    return groups.join(per, "group_id", "left").select(
        *groups.columns, F.col("_s.page_id").alias("source_id"), F.col("_s.file_name").alias("source_file"),
        F.col("_s.page_number").alias("source_page"), F.col("_s.original").alias("original_page"),
        public_path(F.col("_s.path")).alias("url"), "source_count",
    )
