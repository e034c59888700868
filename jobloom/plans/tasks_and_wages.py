"""Queries on task clusters, occupations and wages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators import clusters
from jobloom.plans import inputs
from jobloom.plans.registry import query

inputs.VIEWS["v_soc_tasks"] = """
    select l_orderkey as soc, p_size - 2 as cluster from lineitem join part on p_partkey = l_partkey"""
inputs.VIEWS["v_regression"] = """
    select distinct o.o_custkey as occ, t.cluster, c.c_acctbal as wage
    from orders o join v_soc_tasks t on t.soc = o.o_orderkey
    join customer c on c.c_custkey = o.o_custkey where t.cluster <> -1"""
inputs.VIEWS["v_wage_errors"] = """
    select c_custkey as occ, c_acctbal as actual, avg(c_acctbal) over (partition by c_nationkey) as prediction
    from customer"""


def regression_table(spark: SparkSession, sf: str) -> DataFrame:
    crosswalk = inputs.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("occ"), F.col("o_orderkey").alias("soc")
    )
    tasks = (
        inputs.table(spark, sf, "lineitem")
        .join(inputs.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .select(F.col("l_orderkey").alias("soc"), (F.col("p_size") - 2).alias("cluster"))
    )
    wages = inputs.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("occ"), F.col("c_acctbal").alias("wage")
    )
    return clusters.regression_table(crosswalk, tasks, wages, "soc", "occ", "cluster")


def mean_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Wage of every customer, predicted by the mean of its nation."""
    people = inputs.table(spark, sf, "customer")
    means = people.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("prediction"))
    return people.join(means, "c_nationkey").select(
        F.col("c_custkey").alias("occ"), F.col("c_acctbal").alias("actual"), "prediction"
    )


@query("j18_wage_chain", sql="select occ, cluster, wage from v_regression")
def wage_chain(spark: SparkSession, sf: str) -> DataFrame:
    return regression_table(spark, sf)


_HH = """
    select {g}, sum(n * n) / (sum(n) * sum(n)) as hh
    from (select {g}, {v}, cast(count(*) as double) as n from v_occ_task group by 1, 2) x group by 1"""


@query("ag21_cluster_concentration", sql=f"select cluster, round(hh, 6) as hh from ({_HH.format(g='cluster', v='soc')}) h")
def cluster_concentration(spark: SparkSession, sf: str) -> DataFrame:
    out = clusters.concentration(inputs.occ_task(spark, sf), "cluster", "soc")
    return out.select("cluster", F.round("hh", 6).alias("hh"))


@query(
    "ag21_concentrated_orders",
    sql="""
    select soc, round(sum(n * n) / (sum(n) * sum(n)), 6) as hh,
           sum(n * n) / (sum(n) * sum(n)) > 0.7 as high
    from (select soc, cluster, cast(count(*) as double) as n from v_soc_tasks group by 1, 2) x group by 1""",
)
def concentrated_orders(spark: SparkSession, sf: str) -> DataFrame:
    tasks = (
        inputs.table(spark, sf, "lineitem")
        .join(inputs.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .select(F.col("l_orderkey").alias("soc"), (F.col("p_size") - 2).alias("cluster"))
    )
    return clusters.concentrated(tasks, "soc", "cluster").withColumn("hh", F.round("hh", 6))


@query(
    "ag22_incidence",
    sql="select distinct occ, cluster from v_regression",
)
def incidence(spark: SparkSession, sf: str) -> DataFrame:
    """The long form, which needs no list of clusters."""
    return clusters.incidence(regression_table(spark, sf), "occ", "cluster")


@query("ag23_clusters_per_key", sql="select occ, count(*) as n_clusters from (select distinct occ, cluster from v_regression) x group by occ")
def clusters_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.task_overlap(regression_table(spark, sf), "occ", "cluster")[0]


@query("ag23_keys_per_cluster", sql="select cluster, count(*) as n_keys from (select distinct occ, cluster from v_regression) x group by cluster")
def keys_per_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.task_overlap(regression_table(spark, sf), "occ", "cluster")[1]


@query(
    "ag30_occupation_errors",
    sql="""
    select e.occ, round(prediction - actual, 6) as err, round(abs(prediction - actual), 6) as abs_err,
           c.c_name as title
    from v_wage_errors e join customer c on c.c_custkey = e.occ""",
)
def occupation_errors(spark: SparkSession, sf: str) -> DataFrame:
    titles = inputs.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("occ"), F.col("c_name").alias("title")
    )
    out = clusters.occupation_errors(mean_predictions(spark, sf), titles, "occ", "title", [F.col("title")])
    return out.select("occ", F.round("err", 6).alias("err"), F.round("abs_err", 6).alias("abs_err"), "title")


@query(
    "ag31_explained_variance",
    sql="""
    select round(1 - avg(power(prediction - actual, 2)) / var_pop(actual), 6) as r2 from v_wage_errors""",
)
def explained_variance(spark: SparkSession, sf: str) -> DataFrame:
    out = clusters.explained_variance(mean_predictions(spark, sf), "actual", "prediction")
    return out.select(F.round("r2", 6).alias("r2"))


@query(
    "ud5_grouped_measures",
    sql=f"""
    select 'soc' as measure, cast(cluster as int) as key, round(hh, 6) as value
    from ({_HH.format(g='cluster', v='soc')}) a
    union all
    select 'occ', cast(cluster as int), round(hh, 6) from ({_HH.format(g='cluster', v='occ')}) b""",
)
def grouped_measures(spark: SparkSession, sf: str) -> DataFrame:
    """One measure per group, given as a function; it stays a SQL aggregate."""
    tasks = inputs.occ_task(spark, sf)
    out = None
    for name in ("soc", "occ"):
        part = clusters.concentration(tasks, "cluster", name).select(
            F.lit(name).alias("measure"), F.col("cluster").alias("key"), F.round("hh", 6).alias("value")
        )
        out = part if out is None else out.unionByName(part)
    return out
