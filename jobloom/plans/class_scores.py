"""Queries on class scores: roll-up, best classes, confusion metrics, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators import metrics, scores, shares
from jobloom.operators.ranking import dense_index
from jobloom.operators.tables import common_keys, stack_labelled
from jobloom.plans import inputs
from jobloom.plans.registry import query
from jobloom.session import cut_lineage

SIX = 6  # decimals kept where sums of doubles may differ in their last bits


def _r(column: str) -> F.Column:
    return F.round(column, SIX).alias(column)


def probs(spark: SparkSession, sf: str) -> DataFrame:
    return scores.normalize_scores(inputs.scores(spark, sf)).select("doc_id", "code", "p")


def predictions(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """Best prefix per document next to the prefix of its true code."""
    rolled = scores.bubble_up(inputs.scores(spark, sf), n, p="score")
    best = scores.best_class(rolled, p="score").select("doc_id", F.col("code").alias("pred"))
    truth = inputs.truth(spark, sf).select(
        "doc_id", scores.text_prefix(F.col("code"), n).alias("truth")
    )
    return best.join(truth, "doc_id")


def labels(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return inputs.title_raw(spark, sf).select(scores.text_prefix(F.col("code"), n).alias("label")).distinct()


def cells(spark: SparkSession, sf: str, n: int = 3) -> DataFrame:
    return metrics.confusion(predictions(spark, sf, n), labels(spark, sf, n))


@query("ag14_bubble_up", sql="select doc_id, code, p from v_rolled3")
def bubble_up(spark: SparkSession, sf: str) -> DataFrame:
    return scores.bubble_up(inputs.scores(spark, sf), 3, p="score").withColumnRenamed("score", "p")


@query(
    "wf1_best_class",
    sql="""
    select doc_id, code, p from (
      select *, row_number() over (partition by doc_id order by p desc, code) as rn from v_rolled3) x
    where rn = 1""",
)
def best_class(spark: SparkSession, sf: str) -> DataFrame:
    rolled = scores.bubble_up(inputs.scores(spark, sf), 3, p="score")
    return scores.best_class(rolled, p="score").withColumnRenamed("score", "p")


@query(
    "ag15_bubble_up_accuracy",
    sql="""
    select count(*) as n, round(avg(case when pred = truth then 1.0 else 0.0 end), 6) as accuracy
    from v_pred3""",
)
def bubble_up_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return scores.bubble_up_accuracy(
        inputs.scores(spark, sf), inputs.truth(spark, sf), 3, p="score"
    ).select("n", _r("accuracy"))


@query(
    "wf2_top_classes",
    sql="""
    select doc_id, code, round(p, 6) as p, rn as rank from (
      select *, row_number() over (partition by doc_id order by p desc, code) as rn
      from (select doc_id, code, p from v_probs) y) x
    where rn <= 3""",
)
def top_classes(spark: SparkSession, sf: str) -> DataFrame:
    return scores.best_classes(probs(spark, sf), 3).select("doc_id", "code", _r("p"), "rank")


@query(
    "wf3_long_predictions",
    sql="""
    select m.patent_id, m.class, m.year, x.rn as rank, x.code as soc, round(x.p, 6) as prob
    from (select *, row_number() over (partition by doc_id order by p desc, code) as rn
          from (select doc_id, code, p / sum(p) over (partition by doc_id) as p from v_rolled3) y) x
    join v_patents m on m.patent_id = x.doc_id
    where x.rn <= 5""",
)
def long_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rolled = scores.normalize_scores(
        scores.bubble_up(inputs.scores(spark, sf), 3, p="score"), score="score"
    )
    best = scores.best_classes(rolled.select("doc_id", "code", "p"), 5)
    return best.join(inputs.patents(spark, sf), F.col("doc_id") == F.col("patent_id")).select(
        "patent_id", "class", "year", "rank", F.col("code").alias("soc"), F.round("p", SIX).alias("prob")
    )


@query(
    "wf7_dense_class_index",
    sql="""
    select company, cast(dense_rank() over (order by company) - 1 as bigint) as company_class
    from (select distinct company from v_posting_titles) x""",
)
def class_index(spark: SparkSession, sf: str) -> DataFrame:
    return dense_index(inputs.posting_titles(spark, sf), "company", "company_class")


@query("ag10_confusion", sql="select truth, pred, n from v_cells3")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf)


@query(
    "ag10_confusion_wide",
    sql="""
    select truth, """
    + ", ".join(f"cast(coalesce(sum(n) filter (pred = '{c}'), 0) as bigint) as c_{c}" for c in range(11, 36))
    + " from v_cells2 group by truth",
)
def confusion_wide(spark: SparkSession, sf: str) -> DataFrame:
    long = cells(spark, sf, 2)
    names = scores.class_list(long, "pred")
    wide = metrics.confusion_wide(long, names)
    return wide.select("truth", *[F.col(c).alias(f"c_{c}") for c in names])


@query(
    "ag11_class_scores",
    sql="""
    select label, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn,
           cast(support as bigint) as support, cast(predicted as bigint) as predicted,
           round(prec, 6) as precision, round(rec, 6) as recall,
           round(case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0 end, 6) as f1
    from v_class3""",
)
def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.class_scores(cells(spark, sf))
    return out.select(
        "label", "tp", "fp", "fn", "support", "predicted", _r("precision"), _r("recall"), _r("f1")
    )


@query(
    "ag12_averaged_scores",
    sql="""
    with a as (
      select 'micro' as mode, sum(tp) / (sum(tp) + sum(fp)) as p, sum(tp) / (sum(tp) + sum(fn)) as r
      from v_class3
      union all select 'macro', avg(prec), avg(rec) from v_class3 where support > 0
      union all select 'weighted', sum(prec * support) / sum(support), sum(rec * support) / sum(support)
      from v_class3)
    select mode, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1
    from a""",
)
def averaged_scores(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.averaged_scores(cells(spark, sf)).select(
        "mode", _r("precision"), _r("recall"), _r("f1")
    )


@query(
    "ag13_classification_summary",
    sql="""
    with s as (select *, case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0 end as f
               from v_class3)
    select round(sum(tp) / sum(support), 6) as accuracy, round(sum(tp) / sum(support), 6) as f1_micro,
           round(avg(f) filter (support > 0 or predicted > 0), 6) as f1_macro,
           round(sum(f * support) / sum(support), 6) as f1_weighted,
           round(sum(f * predicted) / sum(predicted), 6) as f1_weighted_by_pred
    from s""",
)
def classification_summary(spark: SparkSession, sf: str) -> DataFrame:
    table = cut_lineage(cells(spark, sf))
    by_truth = metrics.classification_summary(table)
    by_pred = metrics.classification_summary(table, weight_by="pred")
    return by_truth.select(
        _r("accuracy"),
        _r("f1_micro"),
        _r("f1_macro"),
        _r("f1_weighted"),
        F.round(by_pred.select("f1_weighted").scalar(), SIX).alias("f1_weighted_by_pred"),
    )


@query(
    "ag16_multi_label_hit_rate",
    sql="""
    with t as (select distinct l_orderkey as doc_id, substr(replace(code, '-', ''), 1, 3) as code
               from lineitem join v_title_raw on ord = l_partkey where l_quantity >= 25),
         p as (select doc_id, code from (
                 select *, row_number() over (partition by doc_id order by p desc, code) as rn
                 from v_rolled3) x where rn <= 2)
    select count(distinct t.doc_id) as n,
           round(count(distinct p.doc_id) / count(distinct t.doc_id), 6) as hit_rate
    from t left join p on p.doc_id = t.doc_id and p.code = t.code""",
)
def multi_label_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    codes = inputs.title_raw(spark, sf).select("code", "ord")
    truth = (
        inputs.table(spark, sf, "lineitem")
        .where("l_quantity >= 25")
        .join(codes, F.col("l_partkey") == F.col("ord"))
        .select(F.col("l_orderkey").alias("doc_id"), scores.text_prefix(F.col("code"), 3).alias("code"))
        .distinct()
    )
    best = scores.bubble_up_predict(inputs.scores(spark, sf), 3, top=2, p="score")
    return scores.multi_label_hit_rate(truth, best).select("n", _r("hit_rate"))


@query(
    "snk7_predictions_report",
    sql="""
    with p as (select doc_id, code, p / sum(p) over (partition by doc_id) as p from v_rolled2),
         best as (select doc_id, code from (
           select *, row_number() over (partition by doc_id order by p desc, code) as rn from p) x
           where rn = 1)
    select b.doc_id, b.code as top_class, """
    + ", ".join(
        f"round(coalesce(sum(p) filter (p.code = '{c}'), 0), 6) as p_{c}" for c in range(11, 36)
    )
    + " from p join best b using (doc_id) group by 1, 2",
)
def predictions_report(spark: SparkSession, sf: str) -> DataFrame:
    rolled = scores.normalize_scores(scores.bubble_up(inputs.scores(spark, sf), 2, p="score"))
    classes = scores.class_list(labels(spark, sf, 2), "label")
    out = scores.predictions_report(rolled.select("doc_id", "code", "p"), classes)
    return out.select("doc_id", "top_class", *[_r(f"p_{c}") for c in classes])


@query(
    "ag26_class_correlation",
    sql="""
    with p as (select doc_id, code, p / sum(p) over (partition by doc_id) as p from v_rolled2),
         n as (select count(distinct doc_id) as n from p),
         s as (select code, sum(p) as s, sum(p * p) as ss from p group by code),
         x as (select a.code as ca, b.code as cb, sum(a.p * b.p) as sab
               from p a join p b on a.doc_id = b.doc_id and a.code < b.code group by 1, 2)
    select a.code as class_a, b.code as class_b,
           round((n * coalesce(sab, 0) - a.s * b.s)
                 / sqrt((n * a.ss - a.s * a.s) * (n * b.ss - b.s * b.s)), 6) as corr
    from s a join s b on a.code < b.code cross join n
    left join x on x.ca = a.code and x.cb = b.code""",
)
def class_correlation(spark: SparkSession, sf: str) -> DataFrame:
    rolled = scores.normalize_scores(scores.bubble_up(inputs.scores(spark, sf), 2, p="score"))
    classes = scores.class_list(labels(spark, sf, 2), "label")
    return scores.class_correlation(rolled, classes).select("class_a", "class_b", _r("corr"))


@query(
    "ag29_class_weights",
    sql="""
    with c as (select truth, count(*) as n from v_pred3 group by truth)
    select truth, n, round((1.0 / n) / (select sum(1.0 / n) from c) * (select count(*) from c), 6)
             as inverse_weight,
           round((select sum(n) from c) / ((select count(*) from c) * n), 6) as balanced_weight
    from c""",
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_weights(predictions(spark, sf, 3), "truth").select(
        "truth", "n", _r("inverse_weight"), _r("balanced_weight")
    )


@query(
    "ag33_prefix_blocks",
    sql="""
    select truth, pred, n, substr(truth, 1, 2) as block from v_cells3
    where substr(truth, 1, 2) = substr(pred, 1, 2)""",
)
def prefix_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.prefix_blocks(cells(spark, sf), 2)


def _worst_sql(score: str, own: str, other: str, total: str) -> str:
    return f"""
    with w as (select label, {score} as score, support, predicted from v_class3
               where support > 5 order by score, label limit 5),
         names as (select substr(replace(code, '-', ''), 1, 3) as label, min(title) as description
                   from v_title_raw group by 1),
         train as (select substr(replace(code, '-', ''), 1, 3) as label, count(*) as train_n
                   from v_title_raw group by 1)
    select x.label, round(x.score, 6) as score, cast(x.support as bigint) as test_n, x.rn as rank,
           x.partner, round(x.n / x.{total}, 6) as proportion, t.train_n,
           case when length(description) > 12 then concat(substr(description, 1, 10), '…')
                else description end as partner_name
    from (select w.*, c.{other} as partner, c.n,
                 row_number() over (partition by w.label order by c.n desc, c.{other}) as rn
          from v_cells3 c join w on w.label = c.{own}) x
    left join train t on t.label = x.label
    left join names d on d.label = x.partner
    where x.rn <= 5"""


def _worst(spark: SparkSession, sf: str, by: str) -> DataFrame:
    coded = inputs.title_raw(spark, sf).withColumn("label", scores.text_prefix(F.col("code"), 3))
    names = coded.groupBy("label").agg(F.min("title").alias("description"))
    train = coded.groupBy("label").agg(F.count(F.lit(1)).alias("train_n"))
    out = metrics.worst_classes(cells(spark, sf), by, names, train, width=12)
    return out.withColumn("score", F.round("score", SIX)).withColumn(
        "proportion", F.round("proportion", SIX)
    )


@query("ag34_worst_by_recall", sql=_worst_sql("rec", "truth", "pred", "support"))
def worst_by_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _worst(spark, sf, "recall")


@query("ag34_worst_by_precision", sql=_worst_sql("prec", "pred", "truth", "predicted"))
def worst_by_precision(spark: SparkSession, sf: str) -> DataFrame:
    return _worst(spark, sf, "precision")


@query(
    "ag36_disagreement",
    sql="""
    with b as (select a.truth, a.pred as p0, substr(x.code, 1, 3) as p1 from v_pred3 a
               join (select doc_id, replace(code, '-', '') as code, row_number() over (
                       partition by doc_id order by score desc, code) as rn from v_scores) x
                 on x.doc_id = a.doc_id and x.rn = 1)
    select truth, count(*) as n from b where p0 <> p1 and p0 = truth group by truth""",
)
def disagreement(spark: SparkSession, sf: str) -> DataFrame:
    rolled = predictions(spark, sf, 3).withColumnRenamed("pred", "p0")
    leaf = scores.best_class(inputs.scores(spark, sf), p="score").select(
        "doc_id", scores.text_prefix(F.col("code"), 3).alias("p1")
    )
    return metrics.disagreement(rolled.join(leaf, "doc_id"), "truth", "p0", "p1")


@query("ag1_value_shares", sql="""
    select pred, count(*) as n, round(count(*) / (select count(*) from v_pred3), 6) as share
    from v_pred3 group by pred""")
def value_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares.value_shares(predictions(spark, sf, 3), "pred").select("pred", "n", _r("share"))


OFFICIAL = """official as (
      select substr(replace(code, '-', ''), 1, 3) as code,
             sum(tot_emp) / (select sum(tot_emp) from v_official) as share
      from v_official group by 1)"""
PREDICTED = """predicted as (
      select pred as code, count(*) / (select count(*) from v_pred3) as share
      from v_pred3 group by 1)"""


def official_shares(spark: SparkSession, sf: str) -> DataFrame:
    coded = inputs.official(spark, sf).withColumn("code", scores.text_prefix(F.col("code"), 3))
    return shares.weighted_shares(coded, "code", "tot_emp")


def predicted_shares(spark: SparkSession, sf: str) -> DataFrame:
    out = shares.value_shares(predictions(spark, sf, 3), "pred")
    return out.select(F.col("pred").alias("code"), "share")


@query("ag2_weighted_shares", sql=f"with {OFFICIAL} select code, round(share, 6) as share from official")
def weighted_shares(spark: SparkSession, sf: str) -> DataFrame:
    return official_shares(spark, sf).select("code", _r("share"))


@query(
    "ag3_mean_wage",
    sql="""
    select try_cast(c_mk as bigint) as code, round(avg(c_acctbal), 6) as wage
    from (select case when c_custkey % 7 = 0 then c_mktsegment
                      else cast(c_nationkey as varchar) end as c_mk, c_acctbal from customer) x
    where try_cast(c_mk as bigint) is not null group by 1""",
)
def mean_wage(spark: SparkSession, sf: str) -> DataFrame:
    # Every seventh code is text, the way raw wage files carry unusable codes.
    raw = inputs.table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 7 == 0, F.col("c_mktsegment"))
        .otherwise(F.col("c_nationkey").cast("string"))
        .alias("code"),
        "c_acctbal",
    )
    return shares.mean_by_code(raw, "code", "c_acctbal", "wage").select("code", _r("wage"))


@query(
    "ag17_confusion_adjusted_shares",
    sql="""
    with k as (select pred, count(*) as k from v_pred3 group by pred),
         w as (select c.truth, sum(c.n * k.k) as w from v_cells3 c join k on k.pred = c.pred group by 1)
    select truth as code, round(w / (select sum(w) from w), 6) as share
    from w where truth in (select pred from k)""",
)
def confusion_adjusted_shares(spark: SparkSession, sf: str) -> DataFrame:
    predicted = cut_lineage(predictions(spark, sf, 3))
    table = metrics.confusion(predicted, labels(spark, sf, 3))
    out = shares.confusion_adjusted_shares(predicted, table)
    return out.select("code", _r("share"))


@query(
    "ag18_relative_entropy",
    sql=f"""
    with {OFFICIAL}, {PREDICTED},
      j as (select o.share as p, q.share as q from official o join predicted q using (code)),
      t as (select sum(p) as tp, sum(q) as tq from j)
    select round(sum((p / tp) * ln((p / tp) / (q / tq))), 6) as kl from j, t""",
)
def relative_entropy(spark: SparkSession, sf: str) -> DataFrame:
    a, b = official_shares(spark, sf), predicted_shares(spark, sf)
    keys = common_keys("code", a, b)
    kl = shares.relative_entropy(
        a.join(keys, "code", "left_semi"), b.join(keys, "code", "left_semi"), "code"
    )
    return kl.select(_r("kl"))


@query(
    "ag19_share_gap",
    sql=f"""
    with {OFFICIAL}, {PREDICTED},
      g as (select code, o.share as a, q.share as b, round(o.share - q.share, 9) as gap
            from official o join predicted q using (code))
    (select code, round(a, 6) as share_a, round(b, 6) as share_b, round(gap, 6) as gap, 'over' as side
     from g order by g.gap, code limit 10)
    union all
    (select code, round(a, 6), round(b, 6), round(gap, 6), 'under'
     from g order by g.gap desc, code limit 10)""",
)
def share_gap(spark: SparkSession, sf: str) -> DataFrame:
    out = shares.share_gap(official_shares(spark, sf), predicted_shares(spark, sf), "code")
    return out.select("code", _r("share_a"), _r("share_b"), _r("gap"), "side")


@query(
    "ag20_stacked_shares",
    sql=f"""
    with {OFFICIAL}, {PREDICTED}
    select code, round(share, 6) as share, 'official' as source from official
    union all select code, round(share, 6), 'predicted' from predicted""",
)
def stacked_shares(spark: SparkSession, sf: str) -> DataFrame:
    stacked = stack_labelled(
        {"official": official_shares(spark, sf), "predicted": predicted_shares(spark, sf)}
    )
    return stacked.select("code", _r("share"), "source")


@query(
    "j12_common_codes",
    sql="""
    select code, cast(sum(score) as double) as total from v_scores
    where code in (select code from v_official intersect select code from v_truth
                   intersect select code from v_scores where score >= 50)
    group by code""",
)
def common_codes(spark: SparkSession, sf: str) -> DataFrame:
    s = inputs.scores(spark, sf)
    keys = common_keys(
        "code", inputs.official(spark, sf), inputs.truth(spark, sf), s.where("score >= 50")
    )
    return s.join(keys, "code", "left_semi").groupBy("code").agg(F.sum("score").alias("total"))


@query(
    "ud6_bubble_up_predict",
    sql="""
    select doc_id, code, p, rn as rank from (
      select *, row_number() over (partition by doc_id order by p desc, code) as rn from v_rolled2) x
    where rn <= 2""",
)
def bubble_up_predict(spark: SparkSession, sf: str) -> DataFrame:
    return scores.bubble_up_predict(inputs.scores(spark, sf), 2, top=2, p="score").withColumnRenamed(
        "score", "p"
    )
