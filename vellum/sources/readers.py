"""Sources: file scans, books by page, newspaper scans, conversations, generated examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import with_index

MESSAGES = "array<struct<role:string, content:string>>"
SCAN = "struct<bboxes:array<struct<id:string, legibility:string>>, lccn:struct<title:string>, edition:struct<date:string>, `full articles`:array<struct<id:string, article:string, headline:string, byline:string, object_ids:array<string>>>>"


def recursive_parquet(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a path (or the file itself), unfinished ones left out."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


def log_table(spark: SparkSession, path: str) -> DataFrame:
    """A log to which rows of several shapes were appended; columns that some lack are null there."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document a file: name, text; ill-formed bytes are replaced."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("text"))


def with_optional(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that a file may lack, by their defaults."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def strided(df: DataFrame, order: list[str], group: int, ranks: int) -> DataFrame:
    """Rows with the rank that reads their group of ``group`` rows."""
    return with_index(df, *order).withColumn("rank", F.pmod(F.floor(F.col("idx") / group), F.lit(ranks)).cast("bigint"))


def epochs(df: DataFrame, n: int, resume: Column) -> DataFrame:
    """The rows n times over; the first pass resumes where ``resume`` holds."""
    return df.withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in range(n)]))).where((F.col("epoch") > 0) | resume)


def books_of_pages(pages: DataFrame) -> DataFrame:
    """record_id, text, n_pages, n_chars, ocr: non-empty pages in order; score averaged to 3 digits, -1 without one.

    Pages delivered again count once; pages without a number come last. A record may hold a third of
    all pages: its pages are gathered as one book, the unit that the operator makes.
    """
    rows = pages.where(~F.coalesce("empty_pg", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("record_id", "page_no", "text", "mean_wc_ocr").distinct()
    page = F.struct(F.col("page_no").isNull().alias("late"), "page_no", "text")
    return rows.groupBy("record_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"),
        F.coalesce(F.round(F.avg(F.when(F.col("mean_wc_ocr") >= 0, F.col("mean_wc_ocr"))).cast("decimal(18,9)"), 3).cast("double"), F.lit(-1.0)).alias("ocr"),
    )


def as_page_arrays(books: DataFrame) -> DataFrame:
    """Books as rows with page arrays, one page a paragraph."""
    return books.select("book_filename", "year", F.split("text", "\n\n", -1).alias("pages"))


def books_of_page_arrays(df: DataFrame, least: int, cutoff: int) -> DataFrame:
    """Books up to the cutoff year (or without one) whose joined pages reach ``least`` characters."""
    text = F.array_join("pages", "\n\n")
    return df.where("year is null or year <= %d" % cutoff).select("book_filename", "year", text.alias("text"), F.length(text).alias("n_chars")).where(F.col("n_chars") >= least)


def as_scans(df: DataFrame) -> DataFrame:
    """Articles wrapped as raw newspaper scans, one article and two boxes a scan."""
    boxes = F.array(F.struct(F.lit("1").alias("id"), F.lit("Legible").alias("legibility")), F.struct(F.lit("2").alias("id"), F.lit("Poor").alias("legibility")))
    art = F.array(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("article"), "headline", "byline", F.array(F.lit("1"), F.lit("2")).alias("object_ids")))
    return df.select(F.to_json(F.struct(boxes.alias("bboxes"), F.struct(F.col("newspaper").alias("title")).alias("lccn"), F.struct("date").alias("edition"), art.alias("full articles"))).alias("raw"))


def articles_of_scans(df: DataFrame, least: int = 500) -> DataFrame:
    """Articles of at least ``least`` characters with the share of their boxes that is legible, -1 without boxes."""
    s = df.select(F.from_json("raw", SCAN).alias("s")).select("s.*")
    a = s.select("bboxes", F.col("lccn.title").alias("newspaper"), F.explode("full articles").alias("a"))
    mine = F.filter("bboxes", lambda b: F.array_contains("a.object_ids", b["id"]))
    good = F.size(F.filter(mine, lambda b: b["legibility"] == "Legible"))
    out = a.select(F.col("a.id").alias("doc_id"), "newspaper", F.col("a.article").alias("text"), F.when(F.size(mine) > 0, F.bround(good / F.size(mine), 3)).otherwise(-1.0).alias("legibility"), F.when(F.col("a.headline").isNull() & F.col("a.byline").isNull(), 0).otherwise(1).alias("has_head"))
    return out.withColumn("n_chars", F.length("text")).where(F.col("n_chars") >= least)


def parsed_conversations(df: DataFrame, line_col: str) -> DataFrame:
    """Messages of JSON lines; ``bad`` marks lines that do not parse, which stay as rows."""
    m = F.from_json(line_col, MESSAGES, {"mode": "PERMISSIVE"})
    return df.withColumn("messages", m).withColumn("bad", F.col("messages").isNull())


def numbered_lines(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Non-blank lines with their number, which counts blank ones."""
    return df.select(id_col, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).where(F.trim("line") != "").select(id_col, F.col("line_no").cast("bigint").alias("line_no"), "line")


def roman_value(c: Column) -> Column:
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    num = F.transform(F.split(F.upper(c), ""), lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in value.items() for y in kv]), x))
    state = lambda t, p: F.struct(t.cast("int").alias("t"), p.cast("int").alias("p"))
    return F.aggregate(F.reverse(num), state(F.lit(0), F.lit(0)), lambda a, x: state(a["t"] + F.when(x < a["p"], -x).otherwise(x), F.greatest(x, a["p"])))["t"]


def subpage_rank(c: Column) -> Column:
    """Number, else roman numeral, else leading digits, else last."""
    return F.when(c.rlike(r"^\d+$"), c.cast("int")).when(c.rlike("(?i)^[ivx]+$"), roman_value(c)).when(c.rlike(r"^\d"), F.regexp_extract(c, r"^(\d+)", 1).cast("int")).otherwise(99999)


def letter_examples(spark: SparkSession, n: int) -> DataFrame:
    """Seeded letter-counting examples by row number."""
    words = F.array(*map(F.lit, ("strawberry", "banana", "vapour", "galvanometer")))
    df = spark.range(n).withColumn("word", F.element_at(words, (F.pmod("id", F.lit(4)) + 1).cast("int"))).withColumn("letter", F.substring(F.lit("aeiourn"), F.pmod("id", F.lit(7)).cast("int") + 1, F.lit(1)))
    return df.withColumn("n_letter", F.length("word") - F.length(F.replace("word", "letter", F.lit(""))))
