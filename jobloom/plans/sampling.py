"""Queries on samples, local ids, work lists, splits and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators import ranking, worklists
from jobloom.plans import inputs
from jobloom.plans.registry import query

# ---------------------------------------------------------------- local ids

MATCHES_SQL = """
    select l_orderkey as patent_id, l_partkey as sent_id, l_suppkey as task_id,
           l_linenumber as pos, l_discount as distance
    from lineitem"""
inputs.VIEWS["v_matches"] = MATCHES_SQL
inputs.VIEWS["v_match_ids"] = """
    select m.*, i.sent_index from v_matches m join (
      select patent_id, sent_id, dense_rank() over (partition by patent_id order by first, sent_id) as sent_index
      from (select patent_id, sent_id, min(pos) as first from v_matches group by 1, 2) x) i
    on i.patent_id = m.patent_id and i.sent_id = m.sent_id"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("patent_id"),
        F.col("l_partkey").alias("sent_id"),
        F.col("l_suppkey").alias("task_id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_discount").alias("distance"),
    )


@query("wf4_nested_local_id", sql="select patent_id, sent_id, task_id, pos, sent_index from v_match_ids")
def nested_local_id(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.nested_local_id(
        matches(spark, sf).drop("distance"), "patent_id", "sent_id", "pos", "sent_index"
    )


@query(
    "wf5_random_local_id",
    sql="""
    select post_id, category, row_number() over (
      partition by category order by md5(concat('7', cast(post_id as varchar))), post_id) as local_id
    from v_posting_titles""",
)
def random_local_id(spark: SparkSession, sf: str) -> DataFrame:
    posts = inputs.posting_titles(spark, sf).select("post_id", "category")
    return ranking.random_local_id(posts, ["category"], "post_id", "7", "local_id")


@query(
    "wf6_split_documents",
    sql="""
    select p.patent_id, p.year, p.class, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) as abstract,
           'A' as classifier_group
    from v_patents p left join documents d on d.doc_id = p.patent_id""",
)
def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)["documents"]


@query("wf6_split_sentences", sql="select distinct patent_id, sent_index, concat('s', cast(sent_id as varchar)) as sentence from v_match_ids")
def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)["sentences"]


@query(
    "wf6_split_tasks",
    sql="""
    select patent_id, sent_index, row_number() over (
             partition by patent_id, sent_index order by md5(concat('7', cast(task_id as varchar))), task_id)
             as task_index, task, distance
    from (select patent_id, sent_index, task_id, concat('t', cast(task_id as varchar)) as task,
                 min(distance) as distance from v_match_ids group by all) x""",
)
def split_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)["tasks"]


def _split(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    found = (
        matches(spark, sf)
        .groupBy("patent_id", "sent_id", "task_id")
        .agg(F.min("pos").alias("pos"), F.min("distance").alias("distance"))
        .withColumn("sentence", F.concat(F.lit("s"), F.col("sent_id").cast("string")))
        .withColumn("task", F.concat(F.lit("t"), F.col("task_id").cast("string")))
    )
    texts = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("patent_id"), F.col("text").alias("abstract"))
    patents = inputs.patents(spark, sf).drop("status").join(texts, "patent_id", "left")
    return worklists.split_matches(found, patents, "A", seed="7", abstract="abstract")


# ---------------------------------------------------------------- samples

inputs.VIEWS["v_stratified"] = """
    select patent_id, class, year from (
      select patent_id, class, year, count(*) over (partition by class, year) as size,
             row_number() over (partition by class, year
                                order by md5(concat('1', cast(patent_id as varchar))), patent_id) as rn
      from v_patents) x
    where size > 5 and rn <= 5"""


@query("wf8_stratified_sample", sql="select patent_id, class, year from v_stratified")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking.stratified_sample(inputs.patents(spark, sf), ["class", "year"], "patent_id", 5)
    return out.select("patent_id", "class", "year")


@query(
    "wf9_random_sample",
    sql="select doc_id, lang from documents order by md5(concat('1', cast(doc_id as varchar))), doc_id limit 100",
)
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents").select("doc_id", "lang")
    return ranking.random_sample(docs, "doc_id", 100)


PATTERN = worklists.slot_pattern()
_slots = ", ".join(
    f"({j}, {g}, {PATTERN[: j + 1].count(g)}, {PATTERN.count(g)})" for j, g in enumerate(PATTERN)
)


@query(
    "wf10_work_list",
    sql=f"""
    with slots(slot, grp, nth, per) as (values {_slots}),
         w as (select unnest(range(1, 2001)) as worker_id),
         items as (
           select 0 as grp, patent_id, row_number() over (
                    order by md5(concat('1', cast(patent_id as varchar))), patent_id) as pos from v_stratified
           union all
           select 1, patent_id, row_number() over (
                    order by md5(concat('1', cast(patent_id as varchar))), patent_id)
           from v_patents where status = 'P'),
         sizes as (select grp, count(*) as m from items group by grp)
    select w.worker_id, cast(s.slot as bigint) as slot, i.patent_id
    from w cross join slots s join sizes z on z.grp = s.grp
    join items i on i.grp = s.grp and i.pos = z.m - (((w.worker_id - 1) * s.per + s.nth - 1) % z.m)""",
)
def work_list(spark: SparkSession, sf: str) -> DataFrame:
    patents = inputs.patents(spark, sf)
    sampled = ranking.stratified_sample(patents, ["class", "year"], "patent_id", 5)
    close = patents.where("status = 'P'")
    return ranking.assign_slots({0: sampled, 1: close}, "patent_id", 2000, PATTERN)


@query(
    "wf11_train_test_split",
    sql="""
    select doc_id, substr(md5(cast(doc_id as varchar)), 1, 2) < 'c0' as train from documents""",
)
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents").select(
        "doc_id", ranking.is_train("doc_id").alias("train")
    )


@query(
    "wf12_folds",
    sql="""
    select doc_id, cast(cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 4)) as bigint) % 3 as int) as fold
    from documents""",
)
def folds(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents").select("doc_id", ranking.hash_fold("doc_id", 3).alias("fold"))


@query(
    "wf13_sorted_head",
    sql="select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
)
def sorted_head(spark: SparkSession, sf: str) -> DataFrame:
    return (
        inputs.table(spark, sf, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(25)
    )


@query(
    "wf14_unpivot",
    sql="""
    select s_suppkey, variable, value from (
      select l_suppkey as s_suppkey, sum(l_quantity) as quantity, cast(count(*) as double) as lines
      from lineitem group by 1) x
    unpivot (value for variable in (quantity, lines))""",
)
def unpivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = (
        inputs.table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("s_suppkey"))
        .agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines"))
    )
    return wide.unpivot(["s_suppkey"], ["quantity", "lines"], "variable", "value")


@query(
    "ag32_sampled_texts",
    sql="""
    with t as (select code, r, ord, title, row_number() over (
                 partition by major, r order by md5(concat(cast(r as varchar), cast(ord as varchar))), ord) as rn,
               count(*) over (partition by major, r) as size, major
               from (select *, substr(code, 1, 2) as major from v_title_raw) x
               cross join (select unnest(range(0, 6)) as r) y)
    select major as code, cast(r as int) as replicate, cast((rn - 1) // 50 as bigint) as part,
           string_agg(title, '' order by rn) as content
    from t where rn <= round_even(0.33 * size, 0) group by 1, 2, 3""",
)
def sampled_texts(spark: SparkSession, sf: str) -> DataFrame:
    raw = inputs.title_raw(spark, sf).withColumn("major", F.substring("code", 1, 2))
    out = worklists.sampled_texts(raw, "major", "ord", "title", share=0.33, replicates=6, part_rows=50)
    return out.withColumnRenamed("major", "code")
