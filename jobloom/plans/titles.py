"""Queries on title matching, lookups and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import text, urls
from jobloom.operators import matching, metrics, tables
from jobloom.operators.ranking import first_values
from jobloom.operators.scores import text_prefix
from jobloom.plans import inputs
from jobloom.plans.class_scores import predictions, probs
from jobloom.plans.codes_and_text import raw_postings
from jobloom.plans.registry import query

inputs.VIEWS.update(
    {
        "v_crosswalk": """
            select code as code_2010,
                   case when ord % 11 <> 0 then concat(substr(code, 1, 3), cast(5000 + ord % 97 as varchar)) end
                     as code_2000, ord as xord
            from v_title_raw
            union all
            select code, concat(substr(code, 1, 3), '9999'), ord + 1000000000 from v_title_raw where ord % 3 = 0""",
        "v_segments": r"""
            select distinct title, regexp_replace(part, '^\s+|\s+$', '', 'g') as segment
            from (select title, unnest(string_split_regex(title, '[^0-9a-zA-Z\s]')) as part
                  from (select distinct title from v_posting_titles) t) x""",
        "v_segment_best": """
            select title, code, segment as assigned_title from (
              select s.title, l.code, s.segment, row_number() over (
                       partition by s.title order by length(s.segment) desc, l.ord) as rn
              from v_segments s join v_lookup l on l.title = s.segment) x
            where rn = 1""",
        "v_layered": """
            select p.post_id, p.title, l.code, p.title as assigned_title, 1 as layer
            from v_posting_titles p join v_lookup l on l.title = p.title
            union all
            select p.post_id, p.title, s.code, s.assigned_title, 2
            from v_posting_titles p join v_segment_best s on s.title = p.title
            where p.title not in (select title from v_lookup)""",
    }
)


def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    raw = inputs.title_raw(spark, sf)
    major = F.substring("code", 1, 3)
    mapped = F.when(
        F.col("ord") % 11 != 0, F.concat(major, (F.col("ord") % 97 + 5000).cast("string"))
    )
    first = raw.select(F.col("code").alias("code_2010"), mapped.alias("code_2000"), F.col("ord").alias("xord"))
    more = raw.where(F.col("ord") % 3 == 0).select(
        F.col("code").alias("code_2010"),
        F.concat(major, F.lit("9999")).alias("code_2000"),
        (F.col("ord") + 1_000_000_000).alias("xord"),
    )
    return first.unionByName(more)


def matchers(spark: SparkSession, sf: str) -> list[matching.Matcher]:
    known = inputs.lookup(spark, sf)
    return [matching.exact_matcher(known), matching.segment_matcher(known)]


def layered(spark: SparkSession, sf: str) -> DataFrame:
    match = matching.layered_matcher(matchers(spark, sf), "post_id")
    return inputs.posting_titles(spark, sf).select("post_id", "title").transform(match)


@query(
    "j1_crosswalk_join",
    sql="""
    select t.ord, t.title, c.code_2000 from v_title_raw t left join v_crosswalk c on c.code_2010 = t.code
    """,
)
def crosswalk_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = tables.attach_crosswalk(
        inputs.title_raw(spark, sf), crosswalk(spark, sf), "code", "code_2010"
    )
    return joined.select("ord", "title", "code_2000")


@query(
    "j2_translated_codes",
    sql="""
    select l.ord, l.title, c.code_2000 as code
    from v_lookup l
    join (select * from (select *, row_number() over (partition by code_2010 order by xord) as rn
                         from v_crosswalk) x where rn = 1) c
      on c.code_2010 = l.code
    where c.code_2000 is not null""",
)
def translated_codes(spark: SparkSession, sf: str) -> DataFrame:
    out = tables.translate_codes(
        inputs.lookup(spark, sf), crosswalk(spark, sf), "code", "code_2010", "code_2000", [F.col("xord")]
    )
    return out.select("ord", "title", "code")


@query(
    "j3_exact_match",
    sql="""
    select p.post_id, p.title, l.code, p.title as assigned_title
    from v_posting_titles p join v_lookup l on l.title = p.title""",
)
def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    match = matching.exact_matcher(inputs.lookup(spark, sf))
    return inputs.posting_titles(spark, sf).select("post_id", "title").transform(match)


@query(
    "j4_segment_match",
    sql="""
    select p.post_id, p.title, s.code, s.assigned_title
    from v_posting_titles p join v_segment_best s on s.title = p.title""",
)
def segment_match(spark: SparkSession, sf: str) -> DataFrame:
    match = matching.segment_matcher(inputs.lookup(spark, sf))
    return inputs.posting_titles(spark, sf).select("post_id", "title").transform(match)


@query("j5_layered_match", sql="select * from v_layered")
def layered_match(spark: SparkSession, sf: str) -> DataFrame:
    return layered(spark, sf)


@query(
    "j5_match_rate",
    sql="""
    select count(*) as matched, round(count(*) / (select count(*) from v_posting_titles), 6) as match_rate
    from v_layered""",
)
def match_rate(spark: SparkSession, sf: str) -> DataFrame:
    rate = matching.match_rate(layered(spark, sf), inputs.posting_titles(spark, sf))
    return rate.select("matched", F.round("match_rate", 6).alias("match_rate"))


@query(
    "ud2_matcher_chain",
    sql="""
    select layer, count(*) as n from (
      select layer from v_layered
      union all
      select 3 from v_posting_titles p
      where p.post_id not in (select post_id from v_layered) and p.title like 'unlisted role %') x
    group by layer""",
)
def matcher_chain(spark: SparkSession, sf: str) -> DataFrame:
    def unlisted(df: DataFrame) -> DataFrame:
        """A matcher of the caller's own."""
        return (
            df.where(F.col("title").startswith("unlisted role "))
            .withColumn("code", F.lit("00-0000"))
            .withColumn("assigned_title", F.lit("unlisted"))
        )

    match = matching.layered_matcher([*matchers(spark, sf), unlisted], "post_id")
    matched = inputs.posting_titles(spark, sf).select("post_id", "title").transform(match)
    return matched.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j6_fuzzy_match",
    sql="""
    select title, code, assigned_title, edits from (
      select t.title, l.code, l.title as assigned_title, levenshtein(t.title, l.title) as edits,
             row_number() over (partition by t.title order by levenshtein(t.title, l.title), l.ord) as rn
      from (select distinct title from v_title_raw) t join v_lookup l on l.title <> t.title) x
    where rn = 1""",
)
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    match = matching.fuzzy_matcher(inputs.lookup(spark, sf), exclude_equal=True)
    titles = inputs.title_raw(spark, sf).select("title").distinct().transform(match)
    return titles.withColumn("edits", F.col("edits").cast("bigint"))


@query(
    "j7_reranked_titles",
    sql="""
    with p as (select doc_id, code from (
                 select doc_id, code, row_number() over (partition by doc_id order by p desc, code) as rn
                 from v_probs) x where rn <= 3),
         t as (select doc_id, lower(concat(p_name, ' ', p_type)) as title from v_truth
               join v_title_raw r on r.code = v_truth.code join part on p_partkey = r.ord),
         c as (select p.doc_id, t.title, l.title as candidate, l.ord, p.code
               from p join t on t.doc_id = p.doc_id join v_lookup l on l.code = p.code),
         pairs as (select distinct title, candidate from c),
         subs as (
           select text, array_to_string(list_transform(list_filter(range(1, len(w) + 1),
                          lambda i: (m >> (i - 1)) & 1 = 1), lambda i: w[i]), ' ') as sub, bit_count(m) as k
           from (select text, w, unnest(range(1, cast(1 << len(w) as bigint))) as m
                 from (select text, string_split(text, ' ') as w from (
                         select title as text from pairs union select candidate from pairs) u) x) y),
         lcs as (select p.title, p.candidate, max(a.k) as k from pairs p
                 join (select distinct text, sub, k from subs) a on a.text = p.title
                 join (select distinct text, sub from subs) b on b.text = p.candidate and b.sub = a.sub
                 group by 1, 2),
         d as (select c.*, 1 - coalesce(k, 0) / greatest(len(string_split(c.title, ' ')),
                                                         len(string_split(c.candidate, ' '))) as distance
               from c left join lcs on lcs.title = c.title and lcs.candidate = c.candidate)
    select doc_id, code, candidate, round(distance, 6) as distance, rn as rank from (
      select *, row_number() over (partition by doc_id order by round(distance, 9), ord) as rn from d) x
    where rn <= 5""",
)
def reranked_titles(spark: SparkSession, sf: str) -> DataFrame:
    from jobloom.operators.scores import best_classes

    best = best_classes(probs(spark, sf), 3)
    # At most three codes per row, so the list is small whatever the input.
    codes = best.groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    named = inputs.table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("title")
    )
    titles = (
        inputs.truth(spark, sf)
        .join(inputs.title_raw(spark, sf).select("code", "ord"), "code")
        .join(named, "ord")
        .select("doc_id", "title")
    )
    out = matching.rerank_titles(
        codes.join(titles, "doc_id"), inputs.lookup(spark, sf), "doc_id", "codes"
    )
    return out.select("doc_id", "code", "candidate", F.round("distance", 6).alias("distance"), "rank")


@query(
    "j8_url_join",
    sql="""
    select c.c_custkey as company, p.post_id
    from customer c left join v_posting_titles p
      on p.url = concat('http://jobs.example.com/', cast(c.c_custkey as varchar))""",
)
def url_join(spark: SparkSession, sf: str) -> DataFrame:
    # Both lists carry other query values, which the canonical form drops.
    listed = F.concat(F.lit("http://jobs.example.com/"), F.col("c_custkey").cast("string"), F.lit("?from=list"))
    companies = inputs.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("company"), urls.canonical_url(listed).alias("url")
    )
    scraped = F.concat("url", F.lit("?utm=x&page=2"))
    posts = inputs.posting_titles(spark, sf).select("post_id", urls.canonical_url(scraped).alias("url"))
    return companies.join(posts, "url", "left").select("company", "post_id")


@query(
    "j9_mapping_join",
    sql="""
    select p.patent_id, p.class, p.year, s.code, s.score
    from v_scores s join v_patents p on p.patent_id = s.doc_id where s.score is not null""",
)
def mapping_join(spark: SparkSession, sf: str) -> DataFrame:
    s = inputs.scores(spark, sf).where(F.col("score").isNotNull())
    return s.join(inputs.patents(spark, sf), F.col("doc_id") == F.col("patent_id")).select(
        "patent_id", "class", "year", "code", "score"
    )


@query(
    "j10_semi_join",
    sql="""
    select post_id, title from v_posting_titles
    where company in (select company from v_posting_titles group by company having count(*) >= 10)""",
)
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    posts = inputs.posting_titles(spark, sf)
    frequent = posts.groupBy("company").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    return posts.join(frequent, "company", "left_semi").select("post_id", "title")


@query(
    "j11_anti_join",
    sql="select post_id, title from v_posting_titles where post_id not in (select post_id from v_layered)",
)
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    posts = inputs.posting_titles(spark, sf).select("post_id", "title")
    return posts.join(layered(spark, sf), "post_id", "left_anti")


@query(
    "j13_attached_predictions",
    sql="""
    select t.doc_id, t.code as true_code, p.pred, coalesce(d.title, p.pred) as description
    from v_truth t join v_pred3 p on p.doc_id = t.doc_id
    left join (select substr(replace(code, '-', ''), 1, 3) as code, min(title) as title
               from v_title_raw group by 1) d on d.code = p.pred""",
)
def attached_predictions(spark: SparkSession, sf: str) -> DataFrame:
    names = (
        inputs.title_raw(spark, sf)
        .groupBy(text_prefix(F.col("code"), 3).alias("prefix"))
        .agg(F.min("title").alias("name"))
    )
    pred = predictions(spark, sf, 3).select("doc_id", "pred")
    rows = inputs.truth(spark, sf).select("doc_id", F.col("code").alias("true_code")).join(pred, "doc_id")
    return tables.describe(
        rows.withColumn("prefix", F.col("pred")), names, "prefix", "name", "description"
    ).select("doc_id", "true_code", "pred", "description")


@query(
    "ag37_mistakes",
    sql="""
    with n as (select substr(replace(code, '-', ''), 1, 3) as code, min(title) as title
               from v_title_raw group by 1)
    select p.doc_id, p.truth, p.pred, coalesce(a.title, p.truth) as truth_name,
           coalesce(b.title, p.pred) as pred_name
    from v_pred3 p left join n a on a.code = p.truth left join n b on b.code = p.pred
    where p.pred <> p.truth""",
)
def mistakes(spark: SparkSession, sf: str) -> DataFrame:
    names = (
        inputs.title_raw(spark, sf)
        .groupBy(text_prefix(F.col("code"), 3).alias("prefix"))
        .agg(F.min("title").alias("name"))
    )
    out = predictions(spark, sf, 3).where(F.col("pred") != F.col("truth"))
    for side in ("truth", "pred"):
        named = names.withColumnRenamed("prefix", side)
        out = tables.describe(out, named, side, "name", f"{side}_name")
    return out


@query(
    "ag4_first_per_group",
    sql="""
    select company, post_id, title from (
      select *, row_number() over (partition by company order by ts, post_id) as rn
      from v_posting_titles) x where rn = 1""",
)
def first_row(spark: SparkSession, sf: str) -> DataFrame:
    from jobloom.operators.ranking import first_per_group

    posts = inputs.posting_titles(spark, sf).select("company", "post_id", "title", "ts")
    return first_per_group(posts, ["company"], [F.col("ts"), F.col("post_id")]).drop("ts")


@query(
    "ag4_first_values",
    sql="""
    select company, min_by(title, post_id) filter (title is not null) as title,
           min_by(status, post_id) filter (status is not null) as status
    from (select p.company, p.post_id, case when p.post_id % 3 <> 0 then p.title end as title,
                 case when p.post_id % 2 = 0 then o.o_orderstatus end as status
          from v_posting_titles p join orders o on o.o_orderkey = p.post_id) x
    group by company""",
)
def first_non_null(spark: SparkSession, sf: str) -> DataFrame:
    status = inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("post_id"), F.col("o_orderstatus").alias("status")
    )
    posts = inputs.posting_titles(spark, sf).join(status, "post_id").select(
        "company",
        "post_id",
        F.when(F.col("post_id") % 3 != 0, F.col("title")).alias("title"),
        F.when(F.col("post_id") % 2 == 0, F.col("status")).alias("status"),
    )
    return first_values(posts, ["company"], ["title", "status"], [F.col("post_id")])


@query(
    "ag5_distinct_by",
    sql="""
    select ord, title, code from (
      select *, row_number() over (partition by title, substr(code, 1, 2) order by ord) as rn
      from v_title_raw) x where rn = 1""",
)
def distinct_by(spark: SparkSession, sf: str) -> DataFrame:
    raw = inputs.title_raw(spark, sf).withColumn("major", F.substring("code", 1, 2))
    return tables.distinct_by(raw, ["title", "major"], [F.col("ord")]).drop("major")


@query("ag6_unambiguous_titles", sql="select ord, title, code from v_lookup")
def unambiguous(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.lookup(spark, sf)


@query(
    "ag7_frequent_classes",
    sql="""
    select ord, title, major from (select *, substr(code, 1, 2) as major from v_title_raw) x
    where major in (select substr(code, 1, 2) from v_title_raw group by 1 having count(*) >= 80)""",
)
def frequent(spark: SparkSession, sf: str) -> DataFrame:
    raw = inputs.title_raw(spark, sf).select("ord", "title", F.substring("code", 1, 2).alias("major"))
    return tables.frequent_classes(raw, "major", 80)


SUPPORT = ((590, 100), (17, 5), (280, 50), (17, 5))


def _support_sql() -> str:
    steps, source = [], "base"
    for i, (rows, partners) in enumerate(SUPPORT):
        key, other = ("a", "b") if i % 2 == 0 else ("b", "a")
        steps.append(
            f"s{i} as (select * from {source} where {key} in (select {key} from {source} group by {key} "
            f"having count(*) > {rows} and count(distinct {other}) > {partners}))"
        )
        source = f"s{i}"
    return (
        "with base as (select l_orderkey as id, l_linenumber as line, l_suppkey as a, l_partkey as b "
        "from lineitem), "
        + ", ".join(steps)
        + f" select id, line, a, b from {source}"
    )


@query("ag8_mutual_support", sql=_support_sql())
def mutual_support(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("a"),
        F.col("l_partkey").alias("b"),
    )
    return tables.mutual_support(rows, "a", "b", SUPPORT)


@query(
    "ag9_top_cross_section",
    sql="""
    select post_id, category, company from v_posting_titles
    where category in (select category from v_posting_titles group by 1 order by count(*) desc, 1 limit 3)
      and company in (select company from v_posting_titles group by 1 order by count(*) desc, 1 limit 10)""",
)
def top_cross_section(spark: SparkSession, sf: str) -> DataFrame:
    posts = inputs.posting_titles(spark, sf).select("post_id", "category", "company")
    by_category = tables.top_values(posts, "category", 3).select("category")
    by_company = tables.top_values(posts, "company", 10).select("company")
    return posts.join(by_category, "category", "left_semi").join(by_company, "company", "left_semi")


@query(
    "wf15_upsert_latest",
    sql="""
    with d as (select doc_id, md5(text) as content from documents),
         p as (select t.url, t.post_id, d.content from v_posting_titles t
               join d on d.doc_id = t.post_id % (select count(*) from documents))
    select url, cast(post_id as varchar) as "scrapeTimestamp", content from (
      select *, row_number() over (partition by url order by post_id desc, content) as rn from p) x
    where rn = 1""",
)
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    posts = raw_postings(spark, sf).select(
        "url", "scrapeTimestamp", text.content_key(F.col("description")).alias("content")
    )
    newest = [F.col("scrapeTimestamp").cast("bigint").desc(), F.col("content")]
    return tables.upsert_latest(posts, "url", newest)
