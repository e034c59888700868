import io
import json
import zipfile

from pyspark.sql import functions as F

from jobloom.functions.text import cleaner
from jobloom.operators.matching import exact_matcher
from jobloom.sources import readers, writers
from jobloom.streaming import ingest


def test_tolerant_json(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text('[\n{"id": "1", "abstract": "x"}\n{"id": \n{"id": "2"}\n')
    path = str(tmp_path / "a.json")
    assert rows(readers.read_tolerant_json(spark, path, header="[")) == [("1", "x")]
    kept = readers.read_tolerant_json(spark, path, header="[", required=None)
    assert sorted(kept.select(F.coalesce("id", F.lit("-"))).collect()) == [("-",), ("1",), ("2",)]


def test_zipped_members(spark, tmp_path, rows):
    for n, lines in enumerate((["id\ttext\tn", '1\t"many good words ""here"" now"\t3', "2\t\t0"], ["id\ttext\tn", "3\tshort\t1"])):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            z.writestr("x.tsv", "\n".join(lines) + "\n")
        (tmp_path / f"{n}.zip").write_bytes(packed.getvalue())
    (tmp_path / "note.txt").write_text("not an archive")
    assert rows(readers.read_zipped_tsv(spark, str(tmp_path))) == [("1", 'many good words "here" now'), ("3", "short")]
    assert rows(readers.read_zipped_tsv(spark, str(tmp_path), cleaner(4))) == [("1", "many good words here now")]


def test_documents_keep_their_stem(spark, tmp_path, rows):
    (tmp_path / "deep").mkdir()
    (tmp_path / "b two.txt").write_text("line\nline")
    (tmp_path / "deep" / "a.x.txt").write_text("text")
    assert rows(readers.read_documents(spark, str(tmp_path), recursive=True)) == [("a.x", "text"), ("b two", "line\nline")]


def test_quoted_and_sorted_files(spark, tmp_path, rows):
    df = spark.createDataFrame([("b", 'say "hi"\nthere\tnow'), ("a", None)], "url string, content string")
    writers.write_quoted(df, str(tmp_path / "q"))
    text = "".join(p.read_text() for p in (tmp_path / "q").glob("*.csv"))
    assert '"say ""hi""\nthere\tnow"' in text
    got = readers.read_tsv(spark, str(tmp_path / "q"), "url string, content string")
    assert got.where("url = 'b'").first()["content"] == 'say "hi"\nthere\tnow'
    writers.write_sorted_csv(df.select("url"), str(tmp_path / "s"))
    parts = sorted((tmp_path / "s").glob("*.csv"))
    assert [x for p in parts for x in p.read_text().split()[1:]] == ["a", "b"]


def test_labelled_lines(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", "IT & Web", "Dev/Ops")], "content string, category string, section string")
    writers.write_labelled_lines(df, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == "a b __label__it___web __label__dev_ops"


def test_job_records(spark, rows):
    raw = spark.createDataFrame(
        [
            ("http://x/p?jk=1&u=2", "Cook", "Cook many good meals daily.", "co", "2020", ["Food", "Kitchen"]),
            ("http://x/q", "Cook", "No.", "co", "2020", ["Food", "Kitchen"]),
        ],
        readers.RAW_JOB_SCHEMA,
    )
    got = readers.job_records(raw, cleaner(4)).select("url", "content", "category", "section")
    assert rows(got) == [("http://x/p?jk=1", "cook many good meals daily", "Food", "Kitchen")]


def test_coded_postings_need_a_code_and_a_text(spark, rows):
    raw = spark.createDataFrame(
        [(1, "11-1011.00", "Lead many good people here"), (2, " ", "Lead many good people here"), (3, "11-1011", "No")],
        "id int, onet_soc_code string, description string",
    )
    got = readers.coded_postings(raw, cleaner(4)).select("id", "description")
    assert rows(got) == [(1, "lead many good people here")]


def posting(url, stamp, text):
    return json.dumps(
        {"url": url, "title": "t", "description": text, "company": "c", "scrapeTimestamp": stamp, "categories": ["a", "b"]}
    )


def test_ingest_over_batches_and_restarts(spark, tmp_path, rows):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(
        posting("http://x/1", "2020-01-02", "new text of four words") + "\n" + posting("http://x/2", "2020-01-01", "first text of two here")
    )
    (tmp_path / "in" / "2.json").write_text(posting("http://x/1?utm=9", "2020-01-01", "old text of four words"))
    run = lambda: ingest.ingest_postings(spark, source, table, state, cleaner(4), files_per_batch=1)
    run()
    current = lambda: rows(ingest.current_postings(spark, table).select("url", "content"))
    assert current() == [("http://x/1", "new text of four words"), ("http://x/2", "first text of two here")]
    (tmp_path / "in" / "3.json").write_text(posting("http://x/2", "2020-01-03", "second text of two here"))
    run()
    run()  # nothing new
    assert current() == [("http://x/1", "new text of four words"), ("http://x/2", "second text of two here")]
    ingest.compact_postings(spark, table, str(tmp_path / "compact"))
    assert rows(spark.read.parquet(str(tmp_path / "compact")).select("url", "content")) == current()


def test_stream_matches_like_a_batch(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "Cook"), (2, "pilot"), (3, "NURSE")], "post_id long, title string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    match = exact_matcher(spark.createDataFrame([("cook", "1"), ("nurse", "2")], "title string, code string"))
    ingest.match_stream(
        spark, str(tmp_path / "in"), "post_id long, title string", str(tmp_path / "out"), str(tmp_path / "state"), match, 1
    )
    got = spark.read.parquet(str(tmp_path / "out")).select("post_id", "code")
    assert rows(got) == [(1, "1"), (3, "2")]


def test_zipped_texts_leave_in_batches_of_bounded_size(spark, tmp_path, rows):
    """A batch ends by its characters too, so long texts don't pile up in a task."""
    lines = ["id\ttext", *[f"{i}\t{'word ' * 200}{i}" for i in range(40)]]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.tsv", "\n".join(lines) + "\n")
    (tmp_path / "a.zip").write_bytes(packed.getvalue())
    read = readers.read_zipped_tsv(spark, str(tmp_path), batch_chars=2_500)
    assert "MapInArrow" in read._jdf.queryExecution().executedPlan().toString()

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    assert sum(r["n"] for r in read.mapInArrow(sizes, "n long").collect()) == 40
    assert rows(read) == sorted((str(i), f"{'word ' * 200}{i}") for i in range(40))
