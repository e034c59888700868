"""A corpus pipeline: toxic documents out, one of each group of near copies, benchmark text out, secrets cut, sources mixed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import decontaminate, jaccard_join, mixing, queries, secretscan, toxicity
from jobloom.session import workspace


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """Each row as struct `kept`, its text, and as `doc_id` a key of its own: the id, nulls last, then where the row is written.

    Keys are strings in the order of the ids (whole numbers by value, others as text). They are the same
    each time the frame is read; rows that do not come straight from Parquet are written first.
    """

    def place(df: DataFrame) -> list[Column]:
        at = df.metadataColumn("_metadata")
        return [F.lpad(F.hex(F.xxhash64(at["file_path"])), 16, "0"), F.lpad(F.hex(at["row_index"]), 12, "0")]

    def with_key(df: DataFrame) -> DataFrame:
        whole = dict(df.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
        doc_id = F.lpad(F.hex(F.col("doc_id").cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") if whole else F.col("doc_id").cast("string")
        named = F.when(F.col("doc_id").isNull(), "1").otherwise(F.concat(F.lit("0"), doc_id, F.lit("\0")))
        return df.select(F.struct("*").alias("kept"), F.concat(named, *place(df)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    if docs._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            return with_key(docs)
        except AnalysisException:  # no Parquet, so rows have no place
            pass
    at = workspace(docs.sparkSession, "keyed")
    docs.write.parquet(at)
    return with_key(docs.sparkSession.read.parquet(at))


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of keyed `rows` but those whose key is in `keys`."""
    return rows.join(keys.select("doc_id"), "doc_id", "left_anti").select("kept.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    # Each row is judged on its own text, so the columns travel along and nothing is joined back.
    return toxicity.score(docs, model, docs.columns).filter(F.col("score") < toxicity.THRESHOLD).select("kept.*")


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one document whose id is the smallest; of several with that id, the one written first."""
    rows = keyed(docs)
    classes = jaccard_join.near_copy_classes(rows)
    return without(rows, classes.filter("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of benchmark text."""
    rows = keyed(docs)
    judged = decontaminate.decontaminate(rows, read(spark, sf_dir, "benchmark"))
    return without(rows, judged.filter("contaminated"))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets cut out of their texts."""
    scanned = secretscan.scan(docs)
    text = F.col("redacted")
    out = {"text": text.alias("text"), "n_chars": F.when(F.col("kept.n_chars").isNotNull(), F.char_length(text)).cast("bigint").alias("n_chars")}
    return scanned.select(*[out.get(c, F.col(f"kept.`{c}`")) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with all their columns, and how often each is in it: `copies`, or `mix_copies` beside a column of that name."""
    rows, name = keyed(docs).withColumnRenamed("doc_id", "row"), "mix_copies" if "copies" in docs.columns else "copies"
    levels = queries.with_domain(rows.select("row", "text", *[F.col(f"kept.{c}").alias(c) for c in ("doc_id", "lang", "source")]))
    mixed = mixing.mix_sources(levels, queries.MIX_WEIGHTS, keys=("row",)).filter("copies > 0")
    return rows.join(mixed.select("row", F.col("copies").alias(name)), "row").select("kept.*", name)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_per_group),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", cut_secrets),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            at = workspace(spark, f"stage-{name}")
            out.write.parquet(at)
            out = spark.read.parquet(at)
        docs = out
    return docs


# The toxicity and secret stages are trained models, which SQL can't state.
ORACLE_SQL = None
