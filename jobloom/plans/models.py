"""Queries that fit models. Their results depend on an optimiser, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import text
from jobloom.operators import clusters, lasso, models, neighbors, pieces, scores, terms
from jobloom.plans import inputs, tasks_and_wages, vectors
from jobloom.plans.registry import query
from jobloom.session import workspace


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Given vectors whose class is the sign pattern of two components, so it can be learned."""
    quadrant = F.concat(
        F.lit("11-"),
        F.when(F.get("vec", F.lit(0)) > 0, "1").otherwise("2"),
        F.when(F.get("vec", F.lit(1)) > 0, "1").otherwise("2"),
        F.lit("00"),
    )
    items = vectors.items(spark, sf).drop("label")
    return models.with_features(items, "vec").withColumn("code", quadrant)


def labelled_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("code"))
    return models.with_words(docs, "text")


@query("ml6_logistic_regression")
def logistic_regression(spark: SparkSession, sf: str) -> DataFrame:
    data = labelled_vectors(spark, sf)
    model = models.fit_classifier(data, "code", C=5.0, balanced=True)
    return models.predict_scores(model, data, "vec_id")


@query("ml7_text_classifier")
def text_classifier(spark: SparkSession, sf: str) -> DataFrame:
    data = labelled_texts(spark, sf)
    model = models.fit_classifier(data, "code", C=100.0, stages=models.tfidf_stages())
    best = scores.best_class(models.predict_scores(model, data, "doc_id"))
    return best.join(data.select("doc_id", F.col("code").alias("truth")), "doc_id")


@query("ml8_grid_search")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    def make(rows: int, C: float, balanced: bool):
        return models.logistic_regression(rows, C, balanced)

    grid = {"C": [0.1, 1.0, 100.0], "balanced": [False, True]}
    return models.grid_search(labelled_vectors(spark, sf), "code", "vec_id", grid, make, folds=3)


@query("ml8_grid_search_single_split")
def grid_search_split(spark: SparkSession, sf: str) -> DataFrame:
    from jobloom.operators.ranking import is_train

    data = labelled_vectors(spark, sf).withColumn("train", is_train("vec_id"))
    grid = {"C": [1.0, 5.0, 10.0]}
    make = lambda rows, C: models.logistic_regression(rows, C, True)
    return models.grid_search(data, "code", "vec_id", grid, make, split="train")


@query("ml9_boosted_trees")
def boosted_trees(spark: SparkSession, sf: str) -> DataFrame:
    return models.fit_and_predict(labelled_vectors(spark, sf), "code", models.boosted_trees(2, 3), "vec_id")


@query("ml9_linear_svm")
def linear_svm(spark: SparkSession, sf: str) -> DataFrame:
    data = labelled_vectors(spark, sf)
    return models.fit_and_predict(data, "code", models.linear_svm(data.count(), 5.0), "vec_id")


@query("ml10_cluster_labels")
def cluster_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents").select("text", F.col("lang").alias("cluster"))
    return models.label_clusters(docs, "cluster", "text")


@query("ml11_spectral_clusters")
def spectral_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.spectral_clusters(vectors.items(spark, sf), "vec_id", "vec", 4, 0.75)


@query("ml12_bisecting_clusters")
def bisecting_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.bisecting_clusters(vectors.items(spark, sf), "vec_id", "vec", 8)


def wage_outputs(spark: SparkSession, sf: str):
    long = tasks_and_wages.regression_table(spark, sf)
    return lasso.wage_lasso(long, "occ", "cluster", "wage", [5.0, 50.0], folds=3, threshold=-1.0)


@query("ml14_wage_regression_scores")
def wage_scores(spark: SparkSession, sf: str) -> DataFrame:
    return wage_outputs(spark, sf)[2]


@query("ml14_wage_regression_coefficients")
def wage_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    return wage_outputs(spark, sf)[1]


@query("ml14_left_out_wages")
def left_out_wages(spark: SparkSession, sf: str) -> DataFrame:
    """Each occupation's wage predicted from all others, with the penalty that does this best."""
    long = tasks_and_wages.regression_table(spark, sf)
    return lasso.wage_lasso(long, "occ", "cluster", "wage", [5.0, 50.0])[0]


@query("ml15_cluster_sweep")
def cluster_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """In- and out-of-sample score of the wage regression at several cluster counts."""
    items = vectors.items(spark, sf)
    n = items.agg(F.count(F.lit(1))).scalar()
    crosswalk = inputs.table(spark, sf, "orders").select(F.col("o_custkey").alias("occ"), (F.col("o_orderkey") % n).alias("soc"))
    wages = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("occ"), F.col("c_acctbal").alias("wage"))

    def score(assigned: DataFrame) -> DataFrame:
        tasks = assigned.withColumnRenamed("vec_id", "soc")
        long = clusters.regression_table(crosswalk, tasks, wages, "soc", "occ", "cluster")
        scores = lasso.wage_lasso(long, "occ", "cluster", "wage", folds=3)[2]
        return scores.select(F.col("r2_in").alias("in_sample"), F.col("r2_out").alias("out_of_sample"))

    return clusters.sweep(items, "vec_id", "vec", clusters.bisecting_clusters, [2, 4, 8], score)


@query("ml16_word_vectors")
def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return models.train_word_vectors(labelled_texts(spark, sf), dim=20, min_count=20)


@query("ml17_word_pieces")
def word_pieces(spark: SparkSession, sf: str) -> DataFrame:
    counted = terms.vocabulary(vectors.words(spark, sf))
    return pieces.learn_pieces(counted)


@query("ml19_applied_model")
def applied_model(spark: SparkSession, sf: str) -> DataFrame:
    data = labelled_vectors(spark, sf)
    path = workspace(spark, "model")
    models.save_model(models.fit_classifier(data, "code", C=2.0), path)
    names = spark.createDataFrame([("111", "first"), ("112", "second")], "code string, description string")
    return models.predict_described(models.load_model(path), data, "vec_id", 3, names)


@query("snk6_stored_model")
def stored_model(spark: SparkSession, sf: str) -> DataFrame:
    """Largest difference between a model's probabilities before and after it was stored."""
    data = labelled_vectors(spark, sf)
    model = models.fit_classifier(data, "code", C=2.0)
    path, table = workspace(spark, "model"), workspace(spark, "scores")
    models.save_model(model, path)
    models.predict_scores(model, data, "vec_id").write.parquet(table)
    again = models.predict_scores(models.load_model(path), data, "vec_id").withColumnRenamed("p", "q")
    both = spark.read.parquet(table).join(again, ["vec_id", "code"])
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("p") - F.col("q"))), 6).alias("gap")
    )


@query("ag25_cluster_profile")
def cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents").select("doc_id", "lang", "text")
    # One text per vector: the documents dealt over the vectors by id.
    n = inputs.table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    items = vectors.items(spark, sf)
    tasks = docs.withColumn("vec_id", F.col("doc_id") % n).join(
        items.select("vec_id", F.col("label").alias("cluster")), "vec_id"
    )
    medoids = neighbors.cluster_medoids(items, "label", "vec_id", "vec")
    first = docs.groupBy((F.col("doc_id") % n).alias("vec_id")).agg(F.min_by("text", "doc_id").alias("text"))
    named = medoids.join(first, "vec_id").select(
        F.col("label").alias("cluster"), F.col("text").alias("medoid")
    )
    words = models.label_clusters(tasks, "cluster", "text")
    return clusters.cluster_profile(clusters.concentration(tasks, "cluster", "lang"), named, words, "cluster")


@query(
    "ud3_tokenizer",
    sql=r"""
    with w as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as term
               from documents),
         c as (select doc_id, term, count(*) as tf from w group by 1, 2),
         f as (select term, count(*) as df from c group by 1),
         n as (select cast(count(*) as double) as n from documents),
         x as (select c.doc_id, c.term, c.tf * (ln((1 + n) / (1 + df)) + 1) as v from c join f on f.term = c.term
               cross join n where df >= 25 and df <= 0.4 * n)
    select doc_id, term, round(v / sqrt(sum(v * v) over (partition by doc_id)), 6) as tfidf from x""",
)
def tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    """Term weights with a tokenizer of the caller's own."""
    docs = inputs.table(spark, sf, "documents").select("doc_id", "text")
    counts = terms.term_counts(docs, "doc_id", "text", lambda c: text.space_tokens(c), stop_words=())
    out = terms.tfidf(counts, "doc_id", docs.agg(F.count(F.lit(1))).scalar(), min_df=25, max_df=0.4)
    return out.withColumn("tfidf", F.round("tfidf", 6))


@query(
    "ud4_clusterer",
    sql="""
    with a as (select k, list_position(embedding[1:k], list_max(embedding[1:k])) as cluster
               from embeddings cross join (values (2), (4), (8)) s(k))
    select k as clusters, 'used' as variable, cast(count(distinct cluster) as double) as value from a group by k
    union all select k, 'items', cast(count(*) as double) from a group by k""",
)
def clusterer(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep with a clusterer of the caller's own: the best-fitting of k fixed directions."""

    def by_component(items: DataFrame, row_id: str, vec: str, n_clusters: int) -> DataFrame:
        head = F.slice(vec, 1, n_clusters)
        return items.select(row_id, (F.array_position(head, F.array_max(head)) - 1).alias("cluster"))

    def score(assigned: DataFrame) -> DataFrame:
        return assigned.agg(F.count_distinct("cluster").alias("used"), F.count(F.lit(1)).alias("items"))

    return clusters.sweep(vectors.items(spark, sf), "vec_id", "vec", by_component, [2, 4, 8], score)
