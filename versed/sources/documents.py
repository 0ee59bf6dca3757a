"""Landed inputs as tables: cached documents, registries, catalogues, result pages, query results, and atomic outputs."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versed.functions.text import squeeze, strip
from versed.plans.session import ship

DOCUMENT = (
    "law_id string, title string, url string, text string, source string, adapter string, source_policy string, content_hash string, "
    "articles map<string,string>, scraped_at string, char_count long, amendment_date string, doc_kind string, real_title string, registry_pinned boolean, _corrupt_record string"
)
REGISTRY = "aliases map<string,string>, laws map<string,struct<title:string,url:string,print_url:string,last_scraped:string,cache_ttl_days:int,volatile:boolean,category:string,notes:string,aliases:array<string>>>"
#: Version of the index tables; readers refuse another one.
SCHEMA_VERSION = 1


def cached_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file; unreadable ones and blank texts go, a missing law_id is the file's stem."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_name").alias("file"))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    rows = rows.where(F.col("_corrupt_record").isNull() & (strip(F.coalesce("text", F.lit(""))) != ""))
    return rows.withColumn("law_id", F.coalesce(F.nullif(F.trim("law_id"), F.lit("")), stem)).drop("_corrupt_record", "file")


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(laws, aliases): every id, title and listed alias leads to its law; aliases that the file states override those."""
    raw = spark.read.schema(REGISTRY).option("multiLine", True).json(path)
    laws = raw.select(F.explode("laws").alias("law_id", "law")).select("law_id", "law.*")
    own = laws.select("law_id", F.explode(F.concat(F.array("law_id", "title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), F.lit(1).alias("rank"))
    stated = raw.select(F.explode("aliases").alias("alias", "law_id")).select("law_id", "alias", F.lit(0).alias("rank"))
    every = own.union(stated).withColumn("alias", F.lower(F.trim("alias"))).where("alias <> ''")
    best = W.partitionBy("alias").orderBy("rank", "law_id")
    return laws.drop("aliases"), every.withColumn("n", F.row_number().over(best)).where("n = 1").select("alias", "law_id")


def catalogue(spark: SparkSession, path: str, member: str = "doc.txt") -> DataFrame:
    """law_id, title, accepted, updated, url, line_no and status of a zipped tab-separated catalogue, cp1251 or else UTF-8 by line.

    An archive that is none, or lacks the member, is one row with status unusable_archive.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["line_no", "line", "status"]
        for batch in batches:
            for content in batch.column("content").to_pylist():
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                        held: list[tuple] = []
                        for n, raw in enumerate(f, 1):
                            try:
                                line = raw.decode("cp1251")
                            except UnicodeDecodeError:
                                line = raw.decode("utf-8", "replace")
                            held.append((n, line.rstrip("\r\n"), "ok"))
                            if len(held) == 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=names)
                                held = []
                        if held:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=names)
                except (zipfile.BadZipFile, KeyError):
                    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([None], type=pa.string()), pa.array(["unusable_archive"])], names=names)

    rows = files.mapInArrow(run, "line_no long, line string, status string").withColumn("c", F.split("line", "\t"))
    ident, title = F.trim(F.get("c", 1)), F.trim(F.get("c", 2))
    good = (F.size("c") >= 3) & (ident != "") & (title != "")
    day = F.regexp_extract(F.coalesce(F.get("c", 5), F.lit("")), r":(\d{8}):", 1)
    accepted = F.when(day != "", F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))
    return rows.where((F.col("status") != "ok") | good).select(ident.alias("law_id"), title.alias("title"), accepted.alias("accepted"), F.trim(F.get("c", 8)).alias("updated"), F.concat(F.lit("/laws/show/"), ident).alias("url"), "line_no", "status")


def changes(rows: DataFrame, payload: str, most: int) -> DataFrame:
    """law_id, title and changed of a feed, which is an object with a list or a list itself; the first dated column counts."""
    return change_rows(rows, payload).orderBy("n").limit(most)


def change_rows(rows: DataFrame, payload: str, *keep: str) -> DataFrame:
    """`keep`, n (place in the feed), law_id, title and changed of all entries of feeds, on tables and streams alike."""
    item = "struct<id:string,nreg:string,nazva:string,title:string,datred:string,organs:string,date:string>"
    listed = F.coalesce(F.from_json(F.col(payload), f"struct<cnt:string,list:array<{item}>>")["list"], F.from_json(F.col(payload), f"array<{item}>"))
    x = rows.select(*keep, F.posexplode(listed).alias("n", "x")).select(*keep, "n", "x.*")
    day = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("datred", "date", "organs")))
    return x.select(*keep, "n", F.coalesce(F.nullif(F.trim("nreg"), F.lit("")), "id").alias("law_id"), F.coalesce("nazva", "title").alias("title"), day.alias("changed"))


def change_feed(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of the entries of landed feeds, one JSON document a file: file, n, law_id, title and changed. A file is an offset: with a checkpoint a stream that starts again reads nothing twice and misses nothing."""
    reader = spark.readStream.option("wholetext", True)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    rows = reader.text(folder).withColumn("file", F.col("_metadata.file_name"))
    return change_rows(rows, "value", "file")


def result_rows(pages: DataFrame, key: str, html: str, most: int = 20) -> DataFrame:
    """key, seq, id and snippet (500 characters) of the rows of a result page that name a /Review/N, the first of each id."""
    parts = pages.select(key, F.posexplode(F.split(F.col(html), "(?i)<tr")).alias("seq", "part"))
    rows = parts.withColumn("id", F.regexp_extract("part", r"/Review/(\d+)", 1)).where("id <> ''")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy(key, "id").orderBy("seq"))).where("n = 1")
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("seq"))).where(F.col("place") <= most)
    return rows.select(key, F.col("place").alias("seq"), "id", F.substring(squeeze(F.regexp_replace("part", "<[^>]+>", " ")), 1, 500).alias("snippet"))


def redirect_ids(rows: DataFrame, location: str) -> DataFrame:
    """Ids of a redirect to a list of documents: the last part of the path, split on commas and decoded."""
    return redirected(rows, location)


def redirected(rows: DataFrame, location: str, *keep: str) -> DataFrame:
    """`keep`, seq and law_id of many redirects."""
    last = F.substring_index(F.regexp_extract(F.col(location), "^[^?#]*", 0), "/", -1)
    return rows.select(*keep, F.posexplode(F.split(last, ",")).alias("seq", "id")).select(*keep, "seq", F.coalesce(F.try_url_decode("id"), "id").alias("law_id")).where("law_id <> ''")


def tenders(rows: DataFrame, payload: str) -> DataFrame:
    """Compact rows of tender documents."""
    schema = "struct<id:string,tenderID:string,title:string,status:string,dateModified:string,value:struct<amount:double,currency:string>,procuringEntity:struct<name:string,identifier:struct<id:string>>,awards:array<struct<id:string,status:string>>>"
    x = rows.select(F.from_json(F.col(payload), f"struct<data:{schema}>")["data"].alias("x"))
    return x.select(F.coalesce("x.tenderID", "x.id").alias("tender_id"), "x.title", F.coalesce("x.status", F.lit("not_found")).alias("status"), F.col("x.value.amount").alias("amount"), F.col("x.value.currency").alias("currency"), F.col("x.procuringEntity.name").alias("buyer"), F.greatest(F.lit(0), F.size("x.awards")).alias("n_awards"), F.col("x.dateModified").alias("modified"))


def datasets(rows: DataFrame, payload: str) -> DataFrame:
    """Normal rows of open-data catalogue results; formats are sorted, distinct and in capitals."""
    item = "struct<id:string,name:string,title:string,notes:string,organization:struct<title:string>,resources:array<struct<format:string,url:string>>>"
    lists = [F.from_json(F.col(payload), f"struct<{k}:array<{item}>>")[k] for k in ("results", "items", "data", "list")]
    x = rows.select(F.explode(F.coalesce(*lists, F.from_json(F.col(payload), f"array<{item}>"))).alias("x"))
    formats = F.array_sort(F.array_distinct(F.filter(F.transform("x.resources", lambda r: F.upper(F.trim(r["format"]))), lambda f: f != "")))
    return x.select(F.coalesce("x.name", "x.id").alias("dataset_id"), "x.title", F.substring("x.notes", 1, 300).alias("notes"), F.col("x.organization.title").alias("publisher"), formats.alias("formats"))


def bindings(spark: SparkSession, path: str, *variables: str) -> DataFrame:
    """The values of the variables in a stored SPARQL result, one row for each binding."""
    one = "struct<type:string,datatype:string,value:string>"
    raw = spark.read.schema(f"results struct<bindings:array<map<string,{one}>>>").option("multiLine", True).json(path)
    return raw.select(F.explode("results.bindings").alias("b")).select(*(F.col("b")[v]["value"].alias(v) for v in variables))


def hits(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of stored case-law search hits, nested in `columns` or flat."""
    inner = ",".join(f"{c}:string" for c in columns)
    raw = spark.read.schema(f"results array<struct<columns:struct<{inner}>,{inner}>>").option("multiLine", True).json(path)
    return raw.select(F.explode("results").alias("r")).select(*(F.coalesce(F.col(f"r.columns.{c}"), F.col(f"r.{c}")).alias(c) for c in columns))


def decoded(content: bytes) -> str:
    """UTF-8, else cp1251."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1251", "replace")


def first_format(*variants: F.Column) -> F.Column:
    """The first landed variant that isn't blank."""
    return F.coalesce(*(F.nullif(strip(v), F.lit("")) for v in variants))


def replace_table(df: DataFrame, folder: str) -> str:
    """Write a new version of a table beside the old one and point to it; a reader sees the old or the new one, never a part."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.parquet(f"{folder}/v-{name}")
    pointer = spark.range(1).select(F.lit(name).alias("version"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{folder}/_versions.parquet")
    return name


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of a table that replace_table() wrote; another schema version is refused."""
    row = spark.read.parquet(f"{folder}/_versions.parquet").orderBy(F.desc("at"), "version").first()
    if row["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"index has schema version {row['schema_version']}, this code reads {SCHEMA_VERSION}")
    return spark.read.parquet(f"{folder}/v-{row['version']}")


def replace_tables(tables: dict[str, DataFrame], folder: str) -> str:
    """Write new versions of several tables and let them count in one step: a reader sees all the old ones or all the new ones. Tables that aren't given stay as they are."""
    spark = next(iter(tables.values())).sparkSession
    name, old = uuid.uuid4().hex, {}
    if (row := _pointer(spark, folder)) is not None:
        old = row["versions"]
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}/v-{name}")
    new = spark.createDataFrame([(name, SCHEMA_VERSION, old | dict.fromkeys(tables, name))], "step string, schema_version int, versions map<string,string>")
    new.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/_steps.parquet")
    return name


def _pointer(spark: SparkSession, folder: str):
    try:
        return spark.read.parquet(f"{folder}/_steps.parquet").orderBy(F.desc("at"), "step").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the latest step that replace_tables() finished; none before the first, another schema version is refused."""
    row = _pointer(spark, folder)
    if row is None:
        return {}
    if row["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"tables have schema version {row['schema_version']}, this code reads {SCHEMA_VERSION}")
    return {table: spark.read.parquet(f"{folder}/{table}/v-{name}") for table, name in row["versions"].items()}


def landed(df: DataFrame, folder: str) -> DataFrame:
    """The rows written as a table in a shared folder and read again: later steps neither repeat their work nor depend on the executors that did it. The table stays."""
    path = f"{folder}/landed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# fixed values: the marks of a search-result page
FOUND = r"(?is)Знайдено</a>\s*<strong>(\d+)</strong>"
LIST_TOKEN = r"/laws/main/(u[0-9a-f-]{36})"
ECHO = r'(?is)<span class="find_params">(.*?)</span>'
PAGE = r"/laws/main/u[0-9a-f-]{36}/page(\d+)"
ITEM = r'(?is)<li>\s*<div class="doc">\s*<a href="[^"]*/laws/show/([^"?#]+?)(?:/sp:[^"]*)?"[^>]*alt="([^"]*)"[^>]*>(.*?)</a>'


def search_pages(pages: DataFrame, key: str, html: str, most: int) -> DataFrame:
    """key, found (the count that the page states, else its items), token of the list, params_echo, pages, and the first `most` items (law_id, title, status) of each search-result page."""
    def plain(x: F.Column) -> F.Column:
        return squeeze(F.regexp_replace(x, r"(?s)<[^>]+>", ""))

    def all_(pattern: str, group: int) -> F.Column:
        return F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(group))

    def item(i: F.Column, state: F.Column, title: F.Column) -> F.Column:
        return F.struct(F.coalesce(F.try_url_decode(i), i).alias("law_id"), plain(title).alias("title"), F.trim(state).alias("status"))

    raw = F.slice(F.arrays_zip(all_(ITEM, 1).alias("i"), all_(ITEM, 2).alias("s"), all_(ITEM, 3).alias("t")), 1, most)
    items = F.transform(raw, lambda r: item(r["i"], r["s"], r["t"]))
    count = F.nullif(F.regexp_extract(html, FOUND, 1), F.lit("")).cast("long")
    last = F.array_max(F.transform(all_(PAGE, 1), lambda n: n.cast("int")))
    return pages.select(key, items.alias("items"), count.alias("stated"), F.regexp_extract(html, LIST_TOKEN, 1).alias("token"), plain(F.regexp_extract(html, ECHO, 1)).alias("params_echo"), F.coalesce(last, F.lit(1)).alias("pages")).select(
        key, F.coalesce("stated", F.size("items").cast("long")).alias("found"), "token", "params_echo", "pages", "items")
