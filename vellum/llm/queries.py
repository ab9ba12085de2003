"""Queries of the training-data operators over the project's tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunking, instruct, language, mixing, neardup, packing, quality, scan, tokens
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicate_links(table(spark, d, "raw_documents"), k=3, threshold=0.5, min_chars=200)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.duplicate_pairs(*_near(spark, d))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_groups(*_near(spark, d)).withColumnRenamed("id", "doc_id")


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Records of documents and raw_documents with the columns of a slice."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", F.col("domain").alias("topic"), "year", "text")
    raw = table(spark, d, "raw_documents").select(F.lit("raw_documents").alias("tbl"), "doc_id", "source", F.col("language").alias("lang"), "topic", "year", "text")
    return docs.unionByName(raw)


SLICE = ["tbl", "source", "lang", "topic", "year"]


def p2_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(_both(spark, d), ["doc_id", *SLICE])


def p2_token_totals(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_totals(p2_document_tokens(spark, d), SLICE)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = _limit(spark, d, "physics_chunk")
    return chunking.chunked(table(spark, d, "physics_books"), "book_filename", size, overlap)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.stretches(_chunks(spark, d), "book_filename").select("book_filename", "start_char").distinct()


def p3_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pieces(_chunks(spark, d), "book_filename")


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return instruct.pair_defects(table(spark, d, "instruct_pairs"), language.fit_from_table(table(spark, d, "lang_refs")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).where("defect is not null").distinct()


def p4_pair_status(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).withColumn("status", F.coalesce("defect", F.lit("sound"))).drop("defect")


def _stats(spark: SparkSession, d: str, cols: list[str]) -> DataFrame:
    model = quality.fit_from_table(table(spark, d, "lang_refs"))
    return quality.quality_stats(table(spark, d, "documents"), model, cols)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.non_prose(_stats(spark, d, ["doc_id"])).select("doc_id", "kind").distinct()


def p5_quality_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, ["doc_id", "source"])


def p5_source_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.source_summary(_stats(spark, d, ["doc_id", "source"]))


def _scanned(spark: SparkSession, d: str, cols: list[str]) -> DataFrame:
    raw = table(spark, d, "raw_documents")
    model = language.fit_from_table(table(spark, d, "lang_refs"))
    return scan.scanned(raw, scan.vocabulary(raw, model=model), cols, model=model)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scan.line_rows(_scanned(spark, d, ["doc_id"]))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan.repairs(_scanned(spark, d, ["doc_id", "ocr_score"]))


def _doc_tokens(spark: SparkSession, d: str, cols: list[str]) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"), cols)


def _limit(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    row = table(spark, d, "size_limits").where(F.col("limit_name") == name).select("max_size", F.coalesce("overlap", F.lit(0))).first()
    return int(row[0]), int(row[1])


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_doc_tokens(spark, d, ["doc_id"]), ["doc_id"], _limit(spark, d, "pack_row")[0])


def p7_packed_small(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_doc_tokens(spark, d, ["doc_id"]), ["doc_id"], _limit(spark, d, "pack_row_small")[0])


def p7_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, d), _limit(spark, d, "pack_row")[0])


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(_doc_tokens(spark, d, ["doc_id", "source"]), table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_share_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _segments(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lang_refs")
    return language.language_segments(table(spark, d, "documents"), language.fit_from_table(refs), quality.fit_from_table(refs), ["doc_id"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(_segments(spark, d)).distinct()


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


#: Distinct three-word runs of the records that are compared, and their numbers; repeated deliveries count once.
_RUNS = """w as (select distinct doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || text), '[a-z0-9]+') as w from raw_documents where doc_id is not null and length(text) >= 200),
c as (select doc_id, md5(array_to_string(w, ' ')) as class from w),
s as (select distinct class, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select any_value(w) as w, class, unnest(range(1, len(any_value(w)) - 1)) as i from w join c using (doc_id) group by class)),
n as (select class, count(*) as n from s group by 1),
l as (select a.class as x, b.class as y from s a join s b on a.g = b.g and a.class < b.class join n na on na.class = a.class join n nb on nb.class = b.class group by a.class, b.class, na.n, nb.n having count(*) >= 0.5 * (na.n + nb.n - count(*)))"""

_WHITE = r"[\s\x{2}\x{b}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A mark (code point 1) is set at every boundary; code point 2 stands for the first half of a two-character line end.
_MARKED = f"""regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(2) || chr(10)), '([.!?]["''”’“»›)\\]}}]*)({_WHITE})', '\\1' || chr(1) || '\\2', 'g'),
'((?:\\x{{2}}?\\n|\\r)[ \\t]*(?:\\x{{2}}?\\n|\\r))', chr(1) || '\\1', 'g')"""

SQL = {
    "p1_found": f"with {_RUNS} select distinct least(p.doc_id, q.doc_id) as doc_id_a, greatest(p.doc_id, q.doc_id) as doc_id_b from (select x, y from l union all select class, class from n) e join c p on p.class = e.x join c q on q.class = e.y where p.doc_id <> q.doc_id",
    "p1_groups": f"""with recursive {_RUNS}, e as (select x, y from l union select y, x from l),
r as (select class as a, class as b from (select distinct class from c) union select r.a, e.y from r join e on r.b = e.x),
g as (select r.a as class, min(m.doc_id) as group_id, count(distinct m.doc_id) as group_size from r join c m on m.class = r.b group by 1)
select c.doc_id, min(group_id) as group_id, max(group_size) as group_size, max((select count(*) from e where e.x = c.class)) as n_links from c join g using (class) group by c.doc_id""",
    "p3_found": f"""with m as (select book_filename, string_split({_MARKED}, chr(1)) as parts from physics_books where text is not null),
u as (select book_filename, unnest(parts) as part, generate_subscripts(parts, 1) as i from m),
o as (select book_filename, part, coalesce(sum(length(part)) over (partition by book_filename order by i rows between unbounded preceding and 1 preceding), 0) as pos from u)
select distinct book_filename, cast(pos + length(part) - length(regexp_replace(part, '^{_WHITE}+', '')) as bigint) as start_char from o
where length(regexp_replace(regexp_replace(part, '^{_WHITE}+', ''), '{_WHITE}+$', '')) > (select max_size from size_limits where limit_name = 'physics_chunk')""",
}


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
