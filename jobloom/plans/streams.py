"""Queries on the incremental jobs: the tables they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import text
from jobloom.operators.matching import layered_matcher
from jobloom.plans import inputs
from jobloom.plans.codes_and_text import raw_postings
from jobloom.plans.registry import query
from jobloom.plans.titles import matchers
from jobloom.session import workspace
from jobloom.sources import readers
from jobloom.streaming import ingest

# Batches the postings arrive in, and postings in a file.
BATCHES = 4
FILE_ROWS = 10_000


@query(
    "st1_incremental_ingest",
    sql="""
    with p as (select t.url, t.title, t.company, t.category, t.post_id as ts,
                      md5(c.content) as content
               from v_posting_titles t
               join v_clean c on c.doc_id = t.post_id % (select count(*) from documents)
               where c.content is not null)
    select url, title, content, category, cast(ts as varchar) as "scrapeTimestamp", cast(company as varchar) as company from (
      select *, row_number() over (partition by url order by ts desc, content, title) as rn from p) x
    where rn = 1""",
)
def incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    source, table, state = (workspace(spark, n) for n in ("incoming", "postings", "state"))
    # Written where the postings are made, packed, in files that one task reads.
    n = inputs.table(spark, sf, "orders").count()
    arriving = raw_postings(spark, sf).drop("post_id").write
    arriving.option("maxRecordsPerFile", max(1, min(FILE_ROWS, n // BATCHES))).json(source, compression="gzip")
    files = len(spark.read.schema(readers.RAW_JOB_SCHEMA).json(source).inputFiles())
    ingest.ingest_postings(spark, source, table, state, text.cleaner(4), files_per_batch=max(1, -(-files // BATCHES)))
    return ingest.current_postings(spark, table).drop("section").withColumn("content", F.md5("content"))


@query("st2_incremental_match", sql="select post_id, title, code, assigned_title, layer from v_layered")
def incremental_match(spark: SparkSession, sf: str) -> DataFrame:
    source, table, state = (workspace(spark, n) for n in ("titles", "matched", "state"))
    inputs.posting_titles(spark, sf).select("post_id", "title").repartition(4, "post_id").write.parquet(source)
    match = layered_matcher(matchers(spark, sf), "post_id")
    ingest.match_stream(
        spark, source, "post_id bigint, title string", table, state, match, files_per_batch=2
    )
    return spark.read.parquet(table).drop(ingest.BATCH)
