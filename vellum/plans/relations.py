"""Queries of joins, set operations and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import table
from ..operators import clean, dedup, joins
from .registry import query


@query("select text_md5, doc_id, source from (select md5(text) as text_md5, doc_id, source, row_number() over (partition by text order by doc_id) as r from documents where text in (select text from documents where year >= 1850)) where r = 1")
def j01_recover_metadata(spark, d):
    df = table(spark, d, "documents")
    return joins.recover(df.where("year >= 1850"), df, "text", [F.col("doc_id")]).select(F.md5("text").alias("text_md5"), "doc_id", "source")


@query("select record_id, page_id, coalesce(t, '') as title from book_pages left join (select record_id as k, max_by(title, page_id) as t from book_pages where title is not null group by 1) on record_id = k")
def j02_title_lookup(spark, d):
    p = table(spark, d, "book_pages")
    titles = p.where("title is not null").select("record_id", "title", "page_id")
    return joins.lookup(p.select("record_id", "page_id"), titles, "record_id", "title", F.lit(""), F.col("page_id"))


@query("select conv_id from (select distinct conv_id from instruct_pairs) where conv_id not in (select doc_id from documents where year > 1880)")
def j03_excluded_rows(spark, d):
    return joins.missing(table(spark, d, "instruct_pairs").select("conv_id").distinct(), table(spark, d, "documents").where("year > 1880").select(F.col("doc_id").alias("conv_id")), ["conv_id"])


@query("select book_filename from physics_books where book_filename not in (select book_filename from instruct_pairs where book_filename is not null and domain = 'optics')")
def j04_unused_books(spark, d):
    """Books from which no conversation on one subject was made yet."""
    used = table(spark, d, "instruct_pairs").where("book_filename is not null and domain = 'optics'")
    return joins.missing(table(spark, d, "physics_books").select("book_filename"), used, ["book_filename"])


_HEAD = "lower(substr(coalesce(text, ''), 1, 3000))"


@query(
    f"select doc_id, spec_id, how from (select doc_id, spec_id, case when len(list_filter(tw, lambda w: contains(lower(coalesce(title, '')), w))) > 0 then 'title' when len(list_filter(tw, lambda w: contains({_HEAD}, w))) > 0 and len(list_filter(aw, lambda w: contains({_HEAD}, w))) > 0 then 'text' end as how "
    "from documents, (values (1, ['treatise on', 'memoir on'], ['captain']), (2, ['voyage'], ['professor', 'reverend']), (3, ['electrode'], ['mrs.'])) s(spec_id, tw, aw)) where how is not null"
)
def j06_book_search(spark, d):
    specs = spark.createDataFrame([(1, ["treatise on", "memoir on"], ["captain"]), (2, ["voyage"], ["professor", "reverend"]), (3, ["electrode"], ["mrs."])], "spec_id int, title_words array<string>, author_words array<string>")
    return joins.search(table(spark, d, "documents"), specs, F.col("title"), F.col("text")).select("doc_id", "spec_id", "how")


@query("select c_name, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def j08_lookups(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(joins.small(n), c.c_nationkey == n.n_nationkey, "left").join(joins.small(r), n.n_regionkey == r.r_regionkey, "left").select("c_name", "n_name", "r_name")


@query("select a.doc_id, b.title_id from (select doc_id, row_number() over (order by n_chars nulls first, doc_id) as i from documents) a join (select doc_id as title_id, row_number() over (order by coalesce(title, ''), doc_id) as i from documents) b using (i)")
def j09_positional(spark, d):
    docs = table(spark, d, "documents")
    by_title = docs.select(F.col("doc_id").alias("title_id"), F.coalesce("title", F.lit("")).alias("t"))
    return joins.zipped(docs.select("doc_id", "n_chars"), by_title, ["n_chars", "doc_id"], ["t", "title_id"]).select("doc_id", "title_id")


@query("select coalesce(a.work_key, b.work_key) as work_key, greatest(a.score, b.score) as score from (select work_key, max(year) as score from documents where work_key is not null and source = 'books' group by 1) a full join (select work_key, max(year) as score from documents where work_key is not null and source <> 'books' group by 1) b using (work_key)")
def j11_best_of_two(spark, d):
    df = table(spark, d, "documents").where("work_key is not null")
    side = lambda cond: df.where(cond).groupBy("work_key").agg(F.max("year").alias("score"))
    return joins.merge_best(side("source = 'books'"), side("source <> 'books'"), "work_key", "score")


@query()
def j12_fuzzy_titles(spark, d):
    df = table(spark, d, "documents").where("title is not null").withColumn("k", clean.title_key(F.col("title")))
    return joins.fuzzy_titles(df, "doc_id", "k")


@query()
def u07_longest_of_alike_titles(spark, d):
    df = table(spark, d, "documents").where("title is not null").select("doc_id", "n_chars", clean.title_key(F.col("title")).alias("k"))
    return joins.best_of_titles(df, "doc_id", "k", "n_chars")


@query()
def u06_near_prompts(spark, d):
    """Distinct first questions to which no earlier alike one exists."""
    ask = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    asked = table(spark, d, "instruct_pairs").where("messages is not null").select("conv_id", ask.alias("prompt")).where("prompt is not null").distinct()
    one = asked.select(F.lit("all").alias("g"), "conv_id", "prompt", F.lit(0).alias("n"))
    return dedup.near_within(one, "g", "conv_id", "prompt", "n", floor=0.5).select("conv_id")


@query("select distinct md5(text) as text_md5 from documents where text is not null")
def u02_distinct_texts(spark, d):
    return dedup.distinct_texts(table(spark, d, "documents"), "text").select(F.md5("text").alias("text_md5"))


@query("select doc_id, source from (select doc_id, source, row_number() over (partition by substr(text, 1, 200) order by source nulls first, doc_id) as r from documents) where r = 1")
def u03_prefix_key(spark, d):
    return dedup.first_by(table(spark, d, "documents"), [F.substring("text", 1, 200)], [F.col("source"), F.col("doc_id")]).select("doc_id", "source")


@query()
def u05_near_within_work(spark, d):
    df = table(spark, d, "documents").where("work_key is not null").withColumn("n", F.coalesce("n_chars", F.lit(0)))
    return dedup.near_within(df, "work_key", "doc_id", "text", "n")


@query("select record_id, page_no, page_id from (select record_id, page_no, page_id, row_number() over (partition by record_id, page_no order by loaded_at desc nulls last, page_id) as r from book_pages) where r = 1")
def u08_by_location(spark, d):
    return dedup.first_by(table(spark, d, "book_pages"), [F.col("record_id"), F.col("page_no")], [F.col("loaded_at").isNull(), -F.unix_micros("loaded_at"), F.col("page_id")]).select("record_id", "page_no", "page_id")


@query("select origin, count(*) as n, sum(length(text)) as n_chars from (select 'documents' as origin, text from documents union all select 'raw', text from raw_documents union all select 'documents', text from documents) group by 1")
def o01_union_all(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("origin"), "text")
    b = table(spark, d, "raw_documents").select(F.lit("raw").alias("origin"), "text")
    return a.unionByName(b).unionByName(a).groupBy("origin").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("select title from (select distinct title from documents where title is not null) except select title from raw_documents")
def o03_except(spark, d):
    return table(spark, d, "documents").where("title is not null").select("title").distinct().join(table(spark, d, "raw_documents").select("title").distinct(), "title", "left_anti")


@query("select title from (select distinct title from documents where title is not null) intersect select title from raw_documents")
def o04_intersect(spark, d):
    return table(spark, d, "documents").where("title is not null").select("title").distinct().join(table(spark, d, "raw_documents").select("title").distinct(), "title", "left_semi")
