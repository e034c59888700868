"""The domain tables, derived from the given parquet tables, for Spark and as SQL.

Each `name(spark, sf)` has its SQL twin in `VIEWS`; `with_views` puts the ones a statement uses in
front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import sentences as sentence_array
from jobloom.operators.ranking import first_per_group
from jobloom.operators.tables import unambiguous_titles
from jobloom.session import spread

VIEWS: dict[str, str] = {
    "v_title_raw": """
        select lower(concat(p_name, ' ', p_type, ' ', cast(p_size as varchar))) as title,
               concat(cast(10 + cast(substr(p_brand, 7) as int) as varchar), '-',
                      cast(1000 + p_partkey % 9000 as varchar)) as code,
               p_partkey as ord
        from part""",
    "v_lookup": """
        select title, code, ord
        from (select t.*, count(code) over (partition by title) as n from v_title_raw t) x
        where n = 1""",
    "v_posting_titles": """
        select o.o_orderkey as post_id, o.o_orderdate as ts,
               concat('http://jobs.example.com/', cast(o.o_orderkey % 5000 as varchar)) as url,
               o.o_custkey as company, o.o_orderpriority as category,
               lower(case o.o_orderkey % 4 when 0 then t.title
                    when 1 then concat(t.title, ' - ', lower(o.o_orderpriority))
                    when 2 then concat('Senior / ', t.title, ', shift ', cast(o.o_custkey as varchar))
                    else concat('unlisted role ', cast(o.o_orderkey as varchar)) end) as title
        from orders o
        join v_title_raw t on t.ord = o.o_orderkey % (select count(*) from part)""",
    "v_scores": """
        select l.l_orderkey as doc_id, t.code as code, sum(l.l_quantity) as score
        from lineitem l join v_title_raw t on t.ord = l.l_partkey
        group by l.l_orderkey, t.code""",
    "v_probs": """
        select doc_id, code, score / sum(score) over (partition by doc_id) as p from v_scores""",
    "v_truth": """
        select doc_id, code from (
          select l.l_orderkey as doc_id, t.code as code,
                 row_number() over (partition by l.l_orderkey
                                    order by l.l_extendedprice desc, t.code) as rn
          from lineitem l join v_title_raw t on t.ord = l.l_partkey) x
        where rn = 1""",
    "v_rolled3": """
        select doc_id, substr(replace(code, '-', ''), 1, 3) as code, sum(score) as p
        from v_scores group by 1, 2""",
    "v_rolled2": """
        select doc_id, substr(replace(code, '-', ''), 1, 2) as code, sum(score) as p
        from v_scores group by 1, 2""",
    "v_pred3": """
        select s.doc_id, s.code as pred, substr(replace(t.code, '-', ''), 1, 3) as truth
        from (select *, row_number() over (partition by doc_id order by p desc, code) as rn
              from v_rolled3) s
        join v_truth t on t.doc_id = s.doc_id where s.rn = 1""",
    "v_pred2": """
        select s.doc_id, s.code as pred, substr(replace(t.code, '-', ''), 1, 2) as truth
        from (select *, row_number() over (partition by doc_id order by p desc, code) as rn
              from v_rolled2) s
        join v_truth t on t.doc_id = s.doc_id where s.rn = 1""",
    "v_labels3": """
        select distinct substr(replace(code, '-', ''), 1, 3) as label from v_title_raw""",
    "v_labels2": """
        select distinct substr(replace(code, '-', ''), 1, 2) as label from v_title_raw""",
    "v_cells3": """
        select a.label as truth, b.label as pred, cast(coalesce(c.n, 0) as bigint) as n
        from v_labels3 a cross join v_labels3 b
        left join (select truth, pred, count(*) as n from v_pred3 group by 1, 2) c
          on c.truth = a.label and c.pred = b.label""",
    "v_cells2": """
        select a.label as truth, b.label as pred, cast(coalesce(c.n, 0) as bigint) as n
        from v_labels2 a cross join v_labels2 b
        left join (select truth, pred, count(*) as n from v_pred2 group by 1, 2) c
          on c.truth = a.label and c.pred = b.label""",
    "v_class3": """
        select label, tp, fp, fn, tp + fn as support, tp + fp as predicted,
               case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as prec,
               case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as rec
        from (select l.label,
                     cast(sum(case when truth = label and pred = label then n else 0 end) as double) as tp,
                     cast(sum(case when truth <> label and pred = label then n else 0 end) as double) as fp,
                     cast(sum(case when truth = label and pred <> label then n else 0 end) as double) as fn
              from v_labels3 l join v_cells3 c on c.truth = l.label or c.pred = l.label
              group by l.label) x""",
    "v_official": """
        select code, cast(sum(p_size) as bigint) as tot_emp
        from part join v_title_raw on ord = p_partkey group by code""",
    "v_sentences": r"""
        select doc_id, row_number() over (partition by doc_id order by pos) as sent_no, sent
        from (select doc_id, pos, regexp_replace(part, '^\s+|\s+$', '', 'g') as sent
              from (select doc_id, unnest(string_split_regex(text, '\.\s+')) as part,
                           generate_subscripts(string_split_regex(text, '\.\s+'), 1) as pos
                    from documents) a) b
        where sent <> ''""",
    "v_patents": """
        select o_orderkey as patent_id, o_orderpriority as class,
               cast(extract(year from o_orderdate) as int) as year, o_orderstatus as status
        from orders""",
    "v_occ_task": """
        select s_nationkey as occ, p_size as soc, cast(l_linenumber as int) - 2 as cluster
        from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey""",
    "v_wage": """
        select c_nationkey as occ, avg(c_acctbal) as wage from customer group by c_nationkey""",
    "v_words": r"""
        select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as word
        from documents""",
    "v_word_vec": """
        select w.word, e.embedding
        from (select distinct word from v_words) w
        join embeddings e
          on e.vec_id = cast(('0x' || substr(md5(w.word), 1, 6)) as bigint)
                        % (2 * (select count(*) from embeddings))""",
}


def with_views(sql: str) -> str:
    """The statement, preceded by the views it (and they) mention."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9_]+\b", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


# Tables whose rows get heavy work, and the key to deal them by where the scan has too few splits.
HEAVY = {"documents": "doc_id", "orders": "o_orderkey", "lineitem": "l_orderkey"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    return spread(df, HEAVY[name]) if name in HEAVY else df


def title_raw(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.substring("p_brand", 7, 10).cast("int")
    return table(spark, sf, "part").select(
        F.lower(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))).alias("title"),
        F.concat(
            (brand + 10).cast("string"), F.lit("-"), (F.col("p_partkey") % 9000 + 1000).cast("string")
        ).alias("code"),
        F.col("p_partkey").alias("ord"),
    )


def lookup(spark: SparkSession, sf: str) -> DataFrame:
    return unambiguous_titles(title_raw(spark, sf), order=[F.col("ord")])


def posting_titles(spark: SparkSession, sf: str) -> DataFrame:
    titles = title_raw(spark, sf).select(F.col("title").alias("t"), "ord")
    parts = table(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    orders = table(spark, sf, "orders").withColumn("ord", F.col("o_orderkey") % parts)
    kind = F.col("o_orderkey") % 4
    title = (
        F.when(kind == 0, F.col("t"))
        .when(kind == 1, F.concat("t", F.lit(" - "), F.lower("o_orderpriority")))
        .when(kind == 2, F.concat(F.lit("Senior / "), "t", F.lit(", shift "), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit("unlisted role "), F.col("o_orderkey").cast("string")))
    )
    return orders.join(titles, "ord").select(
        F.col("o_orderkey").alias("post_id"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("http://jobs.example.com/"), (F.col("o_orderkey") % 5000).cast("string")).alias("url"),
        F.col("o_custkey").alias("company"),
        F.col("o_orderpriority").alias("category"),
        F.lower(title).alias("title"),
    )


def _coded_lines(spark: SparkSession, sf: str) -> DataFrame:
    codes = title_raw(spark, sf).select("code", "ord")
    return table(spark, sf, "lineitem").join(codes, F.col("l_partkey") == F.col("ord"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _coded_lines(spark, sf)
        .groupBy(F.col("l_orderkey").alias("doc_id"), "code")
        .agg(F.sum("l_quantity").alias("score"))
    )


def truth(spark: SparkSession, sf: str) -> DataFrame:
    lines = _coded_lines(spark, sf).select(
        F.col("l_orderkey").alias("doc_id"), "code", "l_extendedprice"
    )
    return first_per_group(lines, ["doc_id"], [F.desc("l_extendedprice"), F.col("code")]).select(
        "doc_id", "code"
    )


def official(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .join(title_raw(spark, sf), F.col("p_partkey") == F.col("ord"))
        .groupBy("code")
        .agg(F.sum("p_size").alias("tot_emp"))
    )


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    split = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(sentence_array(F.col("text"))).alias("pos", "sent")
    )
    return split.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("sent_no"), "sent")


def patents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("patent_id"),
        F.col("o_orderpriority").alias("class"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderstatus").alias("status"),
    )


def occ_task(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .select(
            F.col("s_nationkey").alias("occ"),
            F.col("p_size").alias("soc"),
            (F.col("l_linenumber") - 2).alias("cluster"),
        )
    )


def wage(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "customer")
        .groupBy(F.col("c_nationkey").alias("occ"))
        .agg(F.avg("c_acctbal").alias("wage"))
    )
