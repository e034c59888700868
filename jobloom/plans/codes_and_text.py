"""Queries on codes, text expressions, URLs, readers and writers."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import codes, text, urls
from jobloom.operators.tables import describe, training_set
from jobloom.plans import inputs
from jobloom.plans.registry import query
from jobloom.session import workspace
from jobloom.sources import readers, writers

# ---------------------------------------------------------------- codes


@query(
    "sc1_code_prefix",
    sql="""
    select ord, code, cast(substr(replace(code, '-', ''), 1, 2) as int) as code2,
           cast(substr(replace(code, '-', ''), 1, 3) as int) as code3,
           cast(substr(replace(code, '-', ''), 1, 6) as int) as code6 from v_title_raw""",
)
def code_prefix(spark: SparkSession, sf: str) -> DataFrame:
    code = F.col("code")
    return inputs.title_raw(spark, sf).select(
        "ord", "code", *[codes.code_prefix(code, n).alias(f"code{n}") for n in (2, 3, 6)]
    )


@query(
    "sc2_code_prefix_str",
    sql="""
    select ord, substr(replace(code, '-', ''), 1, 3) as prefix from v_title_raw""",
)
def code_prefix_str(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit(" "), "code", F.lit(".00 "))
    return inputs.title_raw(spark, sf).select("ord", codes.code_prefix_str(padded).alias("prefix"))


@query("sc3_detailed_code", sql="select ord, substr(concat(code, '.01'), 1, 7) as code from v_title_raw")
def detailed_code(spark: SparkSession, sf: str) -> DataFrame:
    full = F.concat("code", F.lit(".01"))
    return inputs.title_raw(spark, sf).select("ord", codes.detailed_code(full).alias("code"))


@query(
    "sc4_numeric_prefix",
    sql="""
    select p_partkey, cast(substr(cast(cast(trunc(x) as bigint) as varchar), 1, 3) as int) as code3
    from (select p_partkey, case when p_size > 5 then p_retailprice * 100 end as x from part) y
    where x is not null""",
)
def numeric_prefix(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("p_size") > 5, F.col("p_retailprice") * 100)
    return (
        inputs.table(spark, sf, "part")
        .withColumn("x", code)
        .where(F.col("x").isNotNull())
        .select("p_partkey", codes.numeric_code_prefix(F.col("x")).alias("code3"))
    )


@query(
    "sc18_safe_int",
    sql="""
    select c_custkey, try_cast(x as bigint) as num, coalesce(cast(try_cast(x as bigint) as varchar), x) as raw
    from (select c_custkey, case when c_nationkey < 10 then c_mktsegment
                                 else cast(c_custkey as varchar) end as x from customer) y""",
)
def safe_int(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("c_nationkey") < 10, F.col("c_mktsegment")).otherwise(
        F.col("c_custkey").cast("string")
    )
    return inputs.table(spark, sf, "customer").select(
        "c_custkey", codes.safe_int(x).alias("num"), codes.int_or_raw(x).alias("raw")
    )


@query(
    "sc22_major_group",
    sql="""
    select ord, code, cast(substr(code, 1, 2) as int) = 11 as is_group
    from v_title_raw where cast(substr(code, 1, 2) as int) <> 35""",
)
def major_group(spark: SparkSession, sf: str) -> DataFrame:
    code = F.col("code")
    return (
        inputs.title_raw(spark, sf)
        .where(~codes.in_major_group(code, 35))
        .select("ord", "code", codes.in_major_group(code, 11).alias("is_group"))
    )


@query(
    "sc24_describe_codes",
    sql="""
    select x.l_orderkey as row_id, x.l_linenumber as line, x.code, coalesce(n.n_name, x.code) as name
    from (select l_orderkey, l_linenumber, cast(l_suppkey % 40 as varchar) as code from lineitem) x
    left join nation n on cast(n.n_nationkey as varchar) = x.code""",
)
def describe_codes(spark: SparkSession, sf: str) -> DataFrame:
    lines = inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("row_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_suppkey") % 40).cast("string").alias("code"),
    )
    nations = inputs.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("code"), "n_name"
    )
    return describe(lines, nations, "code", "n_name", "name")


# ---------------------------------------------------------------- URLs and labels


@query(
    "sc5_canonical_url",
    sql=r"""
    with p as (select page_id, url, regexp_extract(url, '^([^?#]*)', 1) as base,
                      regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as q,
                      regexp_extract(url, '#(.*)$', 1) as frag from pages),
         k as (select *, array_to_string(regexp_extract_all(q, '(?:^|&)(page=[^&]+)', 1), '&') as kept from p)
    select page_id, concat(base, case when kept <> '' then concat('?', kept) else '' end,
                           case when frag <> '' then concat('#', frag) else '' end) as url
    from k""",
)
def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "pages").select(
        "page_id", urls.canonical_url(F.col("url"), "page").alias("url")
    )


@query(
    "sc6_label_slug",
    sql=r"""
    select o_orderkey, lower(regexp_replace(concat(o_orderpriority, ' / ', o_orderstatus),
                                            '[^\p{L}\p{N}_]', '_', 'g')) as label from orders""",
)
def label_slug(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat_ws(" / ", "o_orderpriority", "o_orderstatus")
    return inputs.table(spark, sf, "orders").select("o_orderkey", text.label_slug(raw).alias("label"))


# ---------------------------------------------------------------- text

CLEAN_SQL = r"""
    select doc_id, nullif(array_to_string(list_filter(list_transform(
             string_split_regex(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), '[.!?]\s+|[\t\n]+'),
             lambda s: trim(regexp_replace(regexp_replace(s, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))),
             lambda s: s <> '' and len(string_split(s, ' ')) >= 4), chr(9)), '') as content
    from documents"""
inputs.VIEWS["v_clean"] = CLEAN_SQL


def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents").select(
        "doc_id", text.cleaner(4)(F.col("text")).alias("content")
    )


@query(
    "sc7_tabs_replaced",
    sql="""
    select doc_id, md5(replace(content, chr(9), '. ')) as periods,
           md5(replace(content, chr(9), ' ')) as spaces from v_clean""",
)
def tabs_replaced(spark: SparkSession, sf: str) -> DataFrame:
    content = F.col("content")
    return clean_documents(spark, sf).select(
        "doc_id",
        F.md5(text.tabs_to_periods(content)).alias("periods"),
        F.md5(text.tabs_to_spaces(content)).alias("spaces"),
    )


@query(
    "sc8_word_chunks",
    sql="""
    select doc_id, cast(i as bigint) as chunk_no,
           md5(array_to_string(w[1 + i * 300 : 300 + i * 300], ' ')) as chunk
    from (select doc_id, w, unnest(range(0, (len(w) + 299) // 300)) as i
          from (select doc_id, string_split(text, ' ') as w from documents) x) y""",
)
def word_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return (
        inputs.table(spark, sf, "documents")
        .select("doc_id", F.posexplode(text.word_chunks(F.col("text"))).alias("chunk_no", "chunk"))
        .select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("chunk"))
    )


@query(
    "sc9_sentences",
    sql=r"""
    with p as (select doc_id, sent_no, sent,
                 trim(regexp_replace(regexp_replace(regexp_replace(lower(sent), '<[^>]*>', ' ', 'g'),
                        '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) as processed
               from v_sentences)
    select doc_id, sent_no, md5(sent) as original, md5(processed) as processed
    from p where len(string_split(processed, ' ')) >= 3""",
)
def sentence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    processed = text.plain_words(F.col("sent"))
    long_enough = F.filter(F.array(processed), lambda s: F.size(F.split(s, " ")) >= 3)
    pairs = inputs.sentences(spark, sf).withColumn("processed", F.explode(long_enough))
    return pairs.select(
        "doc_id", "sent_no", F.md5("sent").alias("original"), F.md5("processed").alias("processed")
    )


@query(
    "sc10_tab_sentences",
    sql="select doc_id, unnest(string_split(content, chr(9))) as sent from v_clean",
)
def tab_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return clean_documents(spark, sf).select(
        "doc_id", F.explode(text.tab_sentences(F.col("content"))).alias("sent")
    )


@query(
    "sc11_sentence_flags",
    sql="""
    select doc_id, cast(coalesce(len(string_split(text, '. ')), 0) as int) as num_sents,
           coalesce(text[-1] <> '.', true) or text = '' as cutoff from documents""",
)
def sentence_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return inputs.table(spark, sf, "documents").select(
        "doc_id", text.sentence_count(t).alias("num_sents"), text.is_cut_off(t).alias("cutoff")
    )


@query(
    "sc12_collapsed_whitespace",
    sql=r"select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as text from documents",
)
def collapsed_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents").select(
        "doc_id", F.md5(text.collapse_whitespace(F.col("text"))).alias("text")
    )


@query("sc13_cleaner", sql="select doc_id, content from v_clean")
def cleaner(spark: SparkSession, sf: str) -> DataFrame:
    return clean_documents(spark, sf)


@query(
    "sc15_word_tokens",
    sql=r"""
    select doc_id, cast(len(w) as int) as n, md5(array_to_string(w, ' ')) as tokens
    from (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') as w from documents) x""",
)
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = text.word_tokens(F.col("text"))
    return inputs.table(spark, sf, "documents").select(
        "doc_id", F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ")).alias("tokens")
    )


@query(
    "sc16_ngrams",
    sql=r"""
    with t as (select regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as w from documents),
         g as (select unnest(list_concat(w,
                   list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) as gram
               from t)
    select gram, count(*) as n from g group by gram""",
)
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    tokens = text.long_word_tokens(F.lower("text"))
    return (
        inputs.table(spark, sf, "documents")
        .select(tokens.alias("w"))
        .select(F.explode(text.ngrams(F.col("w"), 1, 2)).alias("gram"))
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "sc17_truncated",
    sql="""
    select o_orderkey, case when length(t) > 12 then concat(substr(t, 1, 10), '…') else t end as short
    from (select o_orderkey, concat(o_orderpriority, ' ', o_orderstatus) as t from orders) x""",
)
def truncated(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
    return inputs.table(spark, sf, "orders").select("o_orderkey", text.truncate(label, 12).alias("short"))


@query(
    "sc19_flag_shares",
    sql="""
    select count(*) as n, round(avg(case when contains(text, 'the ') then 1.0 else 0.0 end), 6) as flagged,
           round(avg(length(text)), 6) as mean_length,
           round(avg(length(text)) filter (toxic = 1), 6) as mean_length_mistakes
    from documents join labels using (doc_id)""",
)
def flag_shares(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents").join(inputs.table(spark, sf, "labels"), "doc_id")
    size = F.length("text")
    return docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("text").contains("the ").cast("double")), 6).alias("flagged"),
        F.round(F.avg(size), 6).alias("mean_length"),
        F.round(F.avg(F.when(F.col("toxic") == 1, size)), 6).alias("mean_length_mistakes"),
    )


@query("sc20_content_key", sql="select doc_id, md5(text) as key from documents")
def content_key(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents").select(
        "doc_id", text.content_key(F.col("text")).alias("key")
    )


@query(
    "sc21_range_filters",
    sql="""
    select doc_id, lang, n_chars from documents
    where n_chars > 100 and n_chars < 5000 and not (coalesce(text[-1] <> '.', true) or text = '')
      and lang is not null""",
)
def range_filters(spark: SparkSession, sf: str) -> DataFrame:
    keep = (
        (F.col("n_chars") > 100)
        & (F.col("n_chars") < 5000)
        & ~text.is_cut_off(F.col("text"))
        & F.col("lang").isNotNull()
    )
    return inputs.table(spark, sf, "documents").where(keep).select("doc_id", "lang", "n_chars")


@query(
    "sc23_stop_list",
    sql="select title, code, ord from v_title_raw where title not in ('small ring economy 11', 'red widget economy 28')",
)
def stop_list(spark: SparkSession, sf: str) -> DataFrame:
    bad = ["small ring economy 11", "red widget economy 28"]
    return inputs.title_raw(spark, sf).where(~F.col("title").isin(bad))


RAW_POSTINGS_SQL = """
    select o.o_orderkey as post_id, t.url, t.title, d.text as description,
           cast(o.o_custkey as varchar) as company, cast(o.o_orderkey as varchar) as "scrapeTimestamp",
           o.o_orderpriority as category, o.o_orderstatus as section
    from orders o join v_posting_titles t on t.post_id = o.o_orderkey
    join documents d on d.doc_id = o.o_orderkey % (select count(*) from documents)"""
inputs.VIEWS["v_raw_postings"] = RAW_POSTINGS_SQL


def raw_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings as scraped: nested category pair, description from the documents."""
    docs = inputs.table(spark, sf, "documents")
    n = docs.agg(F.count(F.lit(1))).scalar()
    titles = inputs.posting_titles(spark, sf).select("post_id", "url", "title")
    orders = inputs.table(spark, sf, "orders").withColumn("doc_id", F.col("o_orderkey") % n)
    return (
        orders.join(titles, F.col("o_orderkey") == F.col("post_id"))
        .join(docs.select("doc_id", "text"), "doc_id")
        .select(
            "post_id",
            "url",
            "title",
            F.col("text").alias("description"),
            F.col("o_custkey").cast("string").alias("company"),
            F.col("o_orderkey").cast("string").alias("scrapeTimestamp"),
            F.array("o_orderpriority", "o_orderstatus").alias("categories"),
        )
    )


@query(
    "sc14_job_records",
    sql="""
    select p.url, p.title, md5(c.content) as content, p.category, p.section, p."scrapeTimestamp", p.company
    from (select post_id, url, title, category, section, "scrapeTimestamp", company from v_raw_postings) p
    join v_clean c on c.doc_id = p.post_id % (select count(*) from documents)
    where c.content is not null""",
)
def job_records(spark: SparkSession, sf: str) -> DataFrame:
    out = readers.job_records(raw_postings(spark, sf), text.cleaner(4))
    return out.withColumn("content", F.md5("content"))


@query(
    "ag35_training_set",
    sql="""
    select code, title as text from v_title_raw
    union all select cast(p_brand as varchar), p_name from part""",
)
def training(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = inputs.title_raw(spark, sf).select("code", F.col("title").alias("text"))
    tasks = inputs.table(spark, sf, "part").select(
        F.col("p_brand").alias("code"), F.col("p_name").alias("text")
    )
    return training_set(dictionary, tasks, ["code", "text"])


@query(
    "ud1_text_processor",
    sql=r"""
    select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'),
                   '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))) as text from documents""",
)
def text_processor(spark: SparkSession, sf: str) -> DataFrame:
    def apply(df: DataFrame, column: str, process: text.TextProcessor) -> DataFrame:
        return df.withColumn(column, process(F.col(column)))

    docs = inputs.table(spark, sf, "documents").select("doc_id", "text")
    return apply(docs, "text", text.plain_words).withColumn("text", F.md5("text"))


# ---------------------------------------------------------------- files

JOB_COLUMNS = "url string, title string, category string, company string"


def _written(spark: SparkSession, name: str) -> str:
    return workspace(spark, name)


@query("src1_read_jobs_csv", sql="select url, title, category, cast(company as varchar) as company from v_posting_titles")
def read_jobs_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "jobs-csv")
    jobs = inputs.posting_titles(spark, sf).select(
        "url", F.upper("title").alias("title"), "category", F.col("company").cast("string").alias("company")
    )
    writers.write_sorted_csv(jobs, path)
    return readers.read_jobs(spark, path, schema=JOB_COLUMNS)


@query("src2_read_tsv", sql="select p_partkey, p_name, p_size, p_retailprice from part")
def read_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "parts-tsv")
    parts = inputs.table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    writers.write_quoted(parts, path)
    return readers.read_tsv(
        spark, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double"
    )


@query("src3_read_json_lines", sql="select conv_id, turn, role, text from conversations")
def read_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "conversations-json")
    inputs.table(spark, sf, "conversations").write.json(path)
    return readers.read_json_lines(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query(
    "src4_tolerant_json",
    sql="""
    select cast(conv_id * 1000 + turn as varchar) as id, text as abstract
    from conversations where conv_id % 5 <> 0""",
)
def tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "abstracts")
    whole = F.to_json(
        F.struct(
            (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"),
            F.col("text").alias("abstract"),
        )
    )
    # Every fifth conversation is written as a broken line.
    line = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("{broken "), whole)).otherwise(whole)
    lines = inputs.table(spark, sf, "conversations").select(line.alias("value"))
    header = spark.range(1).select(F.lit("[abstracts]").alias("value"))
    header.unionByName(lines).write.text(path)
    return readers.read_tolerant_json(spark, path, header="[abstracts]")


@query(
    "src5_dropped_fields",
    sql="select p_name as title, cast(p_partkey as varchar) as onet_soc_code from part",
)
def dropped_fields(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "coded-json")
    inputs.table(spark, sf, "part").select(
        F.col("p_name").alias("title"),
        F.col("p_partkey").cast("string").alias("onet_soc_code"),
        F.struct(F.col("p_size").alias("value")).alias("baseSalary"),
        F.col("p_brand").alias("@context"),
        F.col("p_type").alias("_id"),
    ).write.json(path)
    schema = "title string, onet_soc_code string, baseSalary struct<value:int>, `@context` string, _id string"
    return readers.drop_fields(readers.read_json_lines(spark, path, schema))


def _with_scheme(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it, so that tasks write where readers look."""
    if "://" in path:
        return path
    probe = _written(spark, "probe")
    spark.range(1).write.parquet(probe)
    at = urlsplit(spark.read.parquet(probe).select(F.input_file_name()).first()[0])
    return f"{at.scheme}://{at.netloc}{path}"


FILE_FOLDERS = 256  # folders that files of single documents are dealt over


def _write_each(path: str, make):
    """A `mapInPandas` body that writes one file per row or batch to a path with a scheme and returns the names."""
    import pandas as pd
    import pyarrow.fs as pafs

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root)
        made = set()
        for pdf in batches:
            names = []
            for name, content in make(pdf):
                folder = name.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(f"{root}/{folder}")
                    made.add(folder)
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
                names.append(name)
            yield pd.DataFrame({"name": names})

    return write


@query(
    "src6_file_per_document",
    sql="select concat('doc-', cast(doc_id as varchar)) as doc_id, length(text) as n_chars, md5(text) as text from documents",
)
def file_per_document(spark: SparkSession, sf: str) -> DataFrame:
    import zlib

    path = _with_scheme(spark, _written(spark, "files"))

    def one_per_row(pdf):
        for doc_id, body in zip(pdf["doc_id"], pdf["text"]):
            name = f"doc-{doc_id}.txt"
            # One flat folder is listed by the driver alone, several are by tasks.
            yield f"{zlib.crc32(name.encode()) % FILE_FOLDERS:03x}/{name}", body.encode("utf-8")

    docs = inputs.table(spark, sf, "documents").select("doc_id", "text")
    docs.mapInPandas(_write_each(path, one_per_row), "name string").write.parquet(
        _written(spark, "file-names")
    )
    return readers.read_documents(spark, path, recursive=True).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text")
    )


@query("src7_zipped_tsv", sql="""
    select cast(c.doc_id as varchar) as id, md5(c.content) as text from v_clean c where c.content is not null""")
def zipped_tsv(spark: SparkSession, sf: str) -> DataFrame:
    import csv
    import io
    import uuid
    import zipfile

    path = _with_scheme(spark, _written(spark, "zips"))

    def one_per_batch(pdf):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z, z.open("detail.tsv", "w", force_zip64=True) as member:
            with io.TextIOWrapper(member, "utf-8", newline="") as lines:
                rows = csv.writer(lines, delimiter="\t", lineterminator="\n")
                rows.writerow(["id", "text", "length"])
                rows.writerows(zip(pdf["doc_id"], pdf["text"], pdf["n_chars"]))
        yield f"part-{uuid.uuid4().hex}.zip", packed.getvalue()

    # The given documents, zipped by the tasks that hold them, the way a bulk download arrives.
    docs = inputs.table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    docs.mapInPandas(_write_each(path, one_per_batch), "name string").write.parquet(
        _written(spark, "zip-names")
    )
    out = readers.read_zipped_tsv(spark, path, text.cleaner(4))
    return out.select("id", F.md5("text").alias("text"))


@query(
    "src8_read_tree",
    sql="select conv_id, turn, role from conversations",
)
def read_tree(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "tree")
    inputs.table(spark, sf, "conversations").withColumn("r", F.col("role")).write.partitionBy("r").json(path)
    return readers.read_tree(spark, path, "conv_id bigint, turn bigint, role string")


@query(
    "src9_word_vectors",
    sql="""
    select concat('w', cast(vec_id as varchar)) as token, cast(len(embedding) as int) as dim,
           round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 5) as total
    from embeddings""",
)
def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "vectors")
    inputs.table(spark, sf, "embeddings").select(
        F.concat_ws(
            "\t",
            F.concat(F.lit("w"), F.col("vec_id").cast("string")),
            F.transform("embedding", lambda x: x.cast("double").cast("string")),
        ).alias("value")
    ).write.text(path)
    vectors = readers.read_word_vectors(spark, path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return vectors.select("token", F.size("vec").alias("dim"), F.round(total, 5).alias("total"))


@query(
    "src10_without_first_field",
    sql="select p_partkey, concat(p_name, ',', p_type, ',', p_brand) as rest from part",
)
def without_first_field(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_type", "p_brand")
    return inputs.table(spark, sf, "part").select("p_partkey", text.without_first_field(line).alias("rest"))


@query("snk1_sorted_csv", sql="select url, category, count(*) as n from v_posting_titles group by 1, 2")
def sorted_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "sorted")
    counts = inputs.posting_titles(spark, sf).groupBy("url", "category").agg(F.count(F.lit(1)).alias("n"))
    writers.write_sorted_csv(counts, path)
    return readers.read_delimited(spark, path, "url string, category string, n bigint")


@query("snk2_quoted_tsv", sql="select conv_id, turn, text from conversations")
def quoted_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "quoted")
    writers.write_quoted(inputs.table(spark, sf, "conversations").select("conv_id", "turn", "text"), path)
    return readers.read_tsv(spark, path, "conv_id bigint, turn bigint, text string")


@query(
    "snk3_text_lines",
    sql="select content as value, count(*) as n from v_clean where content is not null group by 1",
)
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "lines")
    writers.write_lines(clean_documents(spark, sf), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk4_labelled_lines",
    sql=r"""
    select concat(replace(c.content, chr(9), ' '), ' __label__', d.lang, ' __label__',
                  lower(regexp_replace(d.source, '[^\p{L}\p{N}_]', '_', 'g'))) as value
    from v_clean c join documents d on d.doc_id = c.doc_id where c.content is not null""",
)
def labelled_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, "labelled")
    jobs = (
        inputs.table(spark, sf, "documents")
        .withColumn("content", text.cleaner(4)(F.col("text")))
        .where(F.col("content").isNotNull())
    )
    writers.write_labelled_lines(jobs, path, labels=("lang", "source"))
    return spark.read.text(path)


@query("snk5_by_group", sql="select pred, truth, n from v_cells3 where n > 0")
def by_group(spark: SparkSession, sf: str) -> DataFrame:
    from jobloom.plans.class_scores import predictions

    path = _written(spark, "by-group")
    counts = predictions(spark, sf, 3).groupBy("pred", "truth").agg(F.count(F.lit(1)).alias("n"))
    writers.write_by_group(counts, path, "pred")
    return spark.read.schema("truth string, n bigint, pred string").parquet(path)
