"""Queries of sources, chunking, sharding, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import table
from ..operators import chunk, sampling, training
from ..sources import readers, writers
from .registry import query


@query("select source, count(*) as n, sum(length(text)) as n_chars from raw_documents group by source")
def s01_recursive_scan(spark, d):
    return readers.recursive_parquet(spark, f"{d}/raw_documents.parquet").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("select count(text) as n, sum(length(text)) as n_chars, max(length(text)) as longest from documents")
def s02_pruned_scan(spark, d):
    return table(spark, d, "documents").agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.max(F.length("text")).alias("longest"))


@query("select book_filename, year, length(text) as n_chars from physics_books where year between 1 and 1880 and source is not null")
def s03_filtered_scan(spark, d):
    return table(spark, d, "physics_books").where("year between 1 and 1880 and source is not null").select("book_filename", "year", F.length("text").alias("n_chars"))


@query("select rank, count(*) as n, sum(doc_id) as ids from (select doc_id, (row_number() over (order by doc_id) - 1) // 100 % 4 as rank from documents) group by 1")
def s04_strided_groups(spark, d):
    return readers.strided(table(spark, d, "documents"), ["doc_id"], 100, 4).groupBy("rank").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("select e as epoch, doc_id from documents, (select unnest([0, 1]) as e) where e > 0 or doc_id >= 500")
def s05_epochs(spark, d):
    return readers.epochs(table(spark, d, "documents").select("doc_id"), 2, F.col("doc_id") >= 500)


@query(
    "select record_id, count(*) as n_pages, sum(length(text)) as n_chars, coalesce(round(cast(avg(case when mean_wc_ocr >= 0 then mean_wc_ocr end) as decimal(18, 9)), 3)::double, -1) as ocr from (select distinct record_id, page_no, text, mean_wc_ocr from book_pages where not coalesce(empty_pg, false) and trim(coalesce(text, '')) <> '') group by record_id"
)
def s11_books_of_pages(spark, d):
    return readers.books_of_pages(table(spark, d, "book_pages")).select("record_id", "n_pages", "n_chars", "ocr")


@query("select doc_id, case when headline is null and byline is null then 0 else 1 end as has_head, length(text) as n_chars from raw_documents where source = 'AmericanStories' and length(text) >= 500")
def s12_articles(spark, d):
    return readers.articles_of_scans(readers.as_scans(table(spark, d, "raw_documents").where("source = 'AmericanStories'"))).select("doc_id", "has_head", "n_chars")


@query("select book_filename, length(text) as n_chars from physics_books where length(text) >= 5000 and (year is null or year <= 1900)")
def s10_long_books(spark, d):
    return readers.books_of_page_arrays(readers.as_page_arrays(table(spark, d, "physics_books")), 5000, 1900).select("book_filename", "n_chars")


@query("select conv_id, len(messages) as n from instruct_pairs where messages is not null")
def s07_json_lines(spark, d):
    lines = table(spark, d, "instruct_pairs").where("messages is not null").select("conv_id", F.to_json("messages").alias("line"))
    return readers.parsed_conversations(lines, "line").where("not bad").select("conv_id", F.size("messages").cast("bigint").alias("n"))


@query(
    "with l as (select doc_id, coalesce(title, '') as t from documents) select doc_id, (ord - 1)::bigint as line_no, line from (select doc_id, unnest(string_split(t || chr(10) || chr(10) || 'end', chr(10))) as line, generate_subscripts(string_split(t || chr(10) || chr(10) || 'end', chr(10)), 1) as ord from l) where trim(line) <> ''"
)
def s08_numbered_lines(spark, d):
    return readers.numbered_lines(table(spark, d, "documents"), "doc_id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n\nend")))


@query("select key, rank from (values ('3', 3), ('iv', 4), ('XII', 12), ('7a', 7), ('note', 99999)) t(key, rank)")
def s17_subpage_order(spark, d):
    df = spark.createDataFrame([(k,) for k in ("3", "iv", "XII", "7a", "note")], "key string")
    return df.select("key", readers.subpage_rank(F.col("key")).alias("rank"))


@query("select i as idx, word, length(word) - length(replace(word, letter, '')) as n_letter from (select i, (list_value('strawberry', 'banana', 'vapour', 'galvanometer'))[(i % 4) + 1] as word, substr('aeiourn', (i % 7)::int + 1, 1) as letter from range(1000) t(i))")
def s23_letter_counts(spark, d):
    return readers.letter_examples(spark, 1000).select(F.col("id").alias("idx"), "word", F.col("n_letter").cast("bigint").alias("n_letter"))


def _window_sql(table_: str, key: str, limit: int, least: int) -> str:
    return rf"""with recursive s as (select {key}, text as rest, 0 as step, null::varchar as chunk, length(text) <= {limit} as whole from {table_} where text is not null),
r as (select {key}, rest, step, chunk, whole, false as done from s
 union all
 select {key}, case when length(rest) > {limit} then regexp_replace(substr(rest, cut + 1), '^\s+', '') else '' end, step + 1,
  case when length(rest) > {limit} then regexp_replace(substr(rest, 1, cut), '\s+$', '') when whole then rest else regexp_replace(regexp_replace(rest, '^\s+', ''), '\s+$', '') end, whole, length(rest) <= {limit}
 from (select *, case when pp - 2 > {limit // 4} then pp when se > {limit // 4} then se else {limit} end as cut from
  (select *, length(regexp_extract(substr(rest, 1, {limit}), '(?s)^(.*\n\n)', 1)) as pp, length(regexp_extract(substr(rest, 1, {limit}), '(?s)^(.*[.!?]\s)', 1)) as se from r where not done)))
select {key}, (row_number() over (partition by {key} order by step) - 1)::int as chunk_idx, md5(chunk) as chunk_md5, length(chunk) as n_chars from r where step > 0 and (length(chunk) >= {least} or whole)"""


@query(_window_sql("documents", "doc_id", 1000, 100))
def x01_windows(spark, d):
    w = chunk.windows(table(spark, d, "documents"), "doc_id", limit=1000, least=100)
    return w.select("doc_id", "chunk_idx", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("n_chars"))


@query()
def x03_packed_paragraphs(spark, d):
    return chunk.packed_paragraphs(table(spark, d, "physics_books"), "book_filename", limit=4000).select("book_filename", "chunk_idx", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query()
def x05_message_parts(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("turn", "m")).where("m.role = 'assistant'")
    return ms.select("conv_id", "turn", F.posexplode(chunk.split_messages(F.col("m.content"), 200)).alias("part", "text"))


@query("select shard, count(*) as n, sum(n_chars) as n_chars, sum(doc_id) as ids from (select doc_id, n_chars, ((row_number() over (order by n_chars nulls first, doc_id) - 1) % 7)::int as shard from documents) group by shard")
def w01_balanced_shards(spark, d):
    s = sampling.balanced_shards(table(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id", 7)
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.sum("doc_id").alias("ids"))


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents) where i >= n - n % 64")
def w02_remainder(spark, d):
    return writers.remainder(table(spark, d, "documents").select("doc_id"), ["doc_id"], 64)


@query("select doc_id, i as idx from (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) where i >= 10 and i < 900 and (i - 10) % 3 = 0")
def w04_slice(spark, d):
    return sampling.sliced(table(spark, d, "documents").select("doc_id"), ["doc_id"], 10, 900, 3)


@query("select doc_id from (select doc_id, n, sum(n) over (order by doc_id) as run from (select doc_id, coalesce(n_chars, 0) as n from documents)) where run - n <= 300000")
def w05_char_budget(spark, d):
    return sampling.within_budget(table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n")), ["doc_id"], F.col("n"), 300_000).select("doc_id")


@query("select doc_id, source, year, n_chars from documents where year is not null and n_chars is not null order by year desc, n_chars desc, doc_id limit 50")
def w09_top(spark, d):
    return table(spark, d, "documents").where("year is not null and n_chars is not null").orderBy(F.desc("year"), F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "source", "year", "n_chars")


@query("select event_id, event_type from events order by event_id desc limit 20 offset 40")
def w10_page(spark, d):
    return table(spark, d, "events").orderBy(F.desc("event_id")).offset(40).limit(20).select("event_id", "event_type")


_CH = "('0x' || substr(md5('0|' || doc_id), 1, 4))::int"


@query(f"select doc_id, case when {_CH} < 3276 then 'val' else 'train' end as split from documents")
def m01_bernoulli_split(spark, d):
    return sampling.bernoulli_split(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), 0.05)


@query("select doc_id, case when i < greatest(1, floor(n * 0.05)) then 'val' else 'train' end as split from (select doc_id, row_number() over (order by md5(doc_id::varchar), doc_id) - 1 as i, count(*) over () as n from documents)")
def m02_share_split(spark, d):
    return sampling.share_split(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), 0.05)


@query(
    "with g as (select work_key, case when i < greatest(1, floor(n * 0.1)) then 'val' else 'train' end as split from (select work_key, row_number() over (order by md5(work_key), work_key) - 1 as i, count(*) over () as n from (select distinct work_key from documents where work_key is not null))) "
    "select doc_id, split from documents join g using (work_key)"
)
def m03_group_split(spark, d):
    return sampling.group_split(table(spark, d, "documents").where("work_key is not null").select("doc_id", "work_key"), "work_key", 0.1).select("doc_id", "split")


@query("select doc_id, case when n > 2 and i < greatest(1, floor(n * 0.1)) then 'val' else 'train' end as split from (select doc_id, row_number() over (partition by source order by md5(doc_id::varchar), doc_id) - 1 as i, count(*) over (partition by source) as n from documents)")
def m04_stratified_split(spark, d):
    return sampling.share_split(table(spark, d, "documents").select("doc_id", "source"), F.col("doc_id"), 0.1, ["source"], 2).select("doc_id", "split")


@query("select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar), doc_id) as i from documents) where i <= 12")
def m06_per_source_sample(spark, d):
    return sampling.per_group(table(spark, d, "documents").select("doc_id", "source"), ["source"], F.col("doc_id"), 12)


@query("select doc_id, kind, decade from (select *, row_number() over (partition by kind, decade order by md5(doc_id::varchar), doc_id) as i from (select doc_id, case when source = 'newspapers' then 'news' else 'books' end as kind, coalesce(year // 10 * 10, 0) as decade from documents)) where i <= case when kind = 'books' then 6 else 4 end")
def m07_stratified_sample(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.when(F.col("source") == "newspapers", "news").otherwise("books").alias("kind"), F.coalesce(F.floor(F.col("year") / 10) * 10, F.lit(0)).alias("decade"))
    books = sampling.per_group(df.where("kind = 'books'"), ["kind", "decade"], F.col("doc_id"), 6)
    return books.unionByName(sampling.per_group(df.where("kind = 'news'"), ["kind", "decade"], F.col("doc_id"), 4))


@query(f"select doc_id, source from documents where {_CH} < case when source = 'books' then 9830 when source = 'newspapers' then 32768 else 65536 end")
def m09_thinned(spark, d):
    return sampling.thinned(table(spark, d, "documents").select("doc_id", "source"), F.col("source"), F.col("doc_id"), {"books": 0.15, "newspapers": 0.5})


@query("select part, key, row_number() over (order by md5(no || '|' || key), no, key) - 1 as idx from (select 'docs' as part, 0 as no, doc_id as key from documents union all select 'pairs', 1, conv_id from (select distinct conv_id from instruct_pairs))")
def j13_mixture(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("key"))
    b = table(spark, d, "instruct_pairs").select(F.col("conv_id").alias("key")).distinct()
    return sampling.mixed([("docs", a), ("pairs", b)], "key").select("part", "key", "idx")


@query("select greatest(1, round_even(count(*) / (100 * 4.0), 0)) * 100 * 4 as docs_per_shard, count(*) as n from documents")
def k03_shard_size(spark, d):
    return table(spark, d, "documents").agg((F.greatest(F.lit(1.0), F.bround(F.count("*") / 400.0, 0)) * 400).alias("docs_per_shard"), F.count("*").alias("n"))


@query("select count(*) as n, sum(coalesce(n_chars, 0))::bigint as n_chars from documents")
def k04_closed_shards(spark, d):
    """Shards that close on size and a row multiple lose no row."""
    s = writers.closed_shards(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 50_000, 16)
    per = s.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("n_chars"))
    return per.agg(F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("select piece, count(*) as cnt from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as piece from documents) group by 1")
def t01_piece_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("piece")).groupBy("piece").agg(F.count("*").alias("cnt"))


@query()
def t05_cropped_rows(spark, d):
    return training.pack_partitions(table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_tokens")), "doc_id", "n_tokens", 2049, 8)


@query()
def t06_padded_rows(spark, d):
    return training.pack_partitions(table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_tokens")), "doc_id", "n_tokens", 2049, 8, 100, crop=False)
