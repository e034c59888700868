from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobloom.session import checkpoint_dir


@pytest.fixture
def tables(spark, tmp_path):
    i = F.col("id")
    words = F.concat(F.lit("These are many good words number "), i.cast("string"), F.lit("."))
    spark.range(40).select(i.alias("doc_id"), words.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(1, 9).select(
        i.alias("p_partkey"), F.lit("ring").alias("p_name"), F.lit("small").alias("p_type"), i.cast("int").alias("p_size"),
        F.lit("Brand#1").alias("p_brand"),
    ).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(80).select(
        i.alias("o_orderkey"), i.alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus"),
        F.to_date(F.lit("2020-01-01")).alias("o_orderdate"),
    ).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def added(spark, kind, run):
    """The result and the one folder `kind-…` that a query adds to the shared folder."""
    root = Path(checkpoint_dir(spark).removeprefix("file:")) / "jobloom"
    before = set(root.glob(f"{kind}-*"))
    got = run().collect()
    (folder,) = set(root.glob(f"{kind}-*")) - before
    return got, folder


def test_postings_arrive_packed_in_four_batches(spark, tables):
    run = lambda: entry.queries()["st1_incremental_ingest"](spark, tables)
    root = Path(checkpoint_dir(spark).removeprefix("file:")) / "jobloom"
    stored = set(root.glob("postings-*"))
    got, folder = added(spark, "incoming", run)
    # Order keys 0 and 8, 16, ... have no part.
    assert len(got) == len({r["url"] for r in got}) == 70
    files = [f.name for f in folder.iterdir() if not f.name.startswith((".", "_"))]
    assert len(files) >= 4 and all(f.endswith(".json.gz") for f in files)
    (table,) = set(root.glob("postings-*")) - stored
    assert 2 <= len(list(table.glob("batch=*"))) <= 4


def test_single_files_are_dealt_over_folders(spark, tables):
    run = lambda: entry.queries()["src6_file_per_document"](spark, tables)
    got, folder = added(spark, "files", run)
    assert sorted(r["doc_id"] for r in got) == sorted(f"doc-{i}" for i in range(40))
    assert len({f.parent for f in folder.glob("**/*.txt")}) > 20
