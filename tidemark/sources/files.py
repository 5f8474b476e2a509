"""Files around the engine: CSV, JSON and text scans, nested facts, word lists, sinks, an append log."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.unicode import normal


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; on a local master
    without that setting a folder of /tmp."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "/tmp/tidemark-work"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read again, for plans that use it often."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: More different headers than this below one path are taken for a mistake.
MOST_HEADERS = 1000


def headers(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """file, header: the first line that is not blank of every file below `path`.

    The lines of files' first blocks are scanned as plain text; a line per file and task is shuffled."""
    lines = spark.read.options(**options).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    lines = lines.where("file_block_start = 0 AND trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    return lines.groupBy(F.col("file_path").alias("file")).agg(F.min_by("value", "at").alias("header"))


def read_named(spark: SparkSession, path: str, schema: str, clean: Callable[[str], str] = str.strip, most_files: int = 100_000, **options: object) -> DataFrame:
    """The columns of `schema` of all CSV files below `path`, each file's by the names in its own header.

    clean: from a header's cell, without a byte order mark, to the name it is asked for by. A file
    without a column has nulls there; a column that no file has is an error, as is a name twice in one
    header. Empty cells are nulls, a word such as NULL stays a word, what is not of the column's
    type is null. Files with one header are read by its order; with several, rows find their file's
    order by a join with a row per file, broadcast up to `most_files`.
    """
    wanted = [(f.name, f.dataType) for f in T.StructType.fromDDL(schema).fields]
    found = headers(spark, path, **{k: v for k, v in options.items() if k == "recursiveFileLookup"})
    kinds = [r["header"] for r in found.select("header").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"over {MOST_HEADERS} different headers below {path}")
    cells = {h: [clean(c) for c in next(csv.reader([h.removeprefix("\ufeff")]))] for h in kinds}
    for name, _ in wanted:
        if kinds and not any(name in c for c in cells.values()) or any(c.count(name) > 1 for c in cells.values()):
            raise ValueError(f"{name} must stand once in a header, and in some file")
    places = {h: [c.index(name) if name in c else -1 for name, _ in wanted] for h, c in cells.items()}
    width = max((len(c) for c in cells.values()), default=len(wanted))
    columns = [f"_c{i}" for i in range(width)]
    raw = spark.read.options(header=True, nullValue="", emptyValue="", enforceSchema=True, **options).schema(", ".join(f"{c} string" for c in columns)).csv(path)
    if len({tuple(p) for p in places.values()}) <= 1:
        place = next(iter(places.values()), list(range(len(wanted))))
        return raw.select(*[(F.col(columns[i]) if i >= 0 else F.lit(None)).try_cast(t).alias(n) for i, (n, t) in zip(place, wanted, strict=True)])
    orders = F.broadcast(spark.createDataFrame(list(places.items()), "header string, place array<int>"))  # at most MOST_HEADERS rows
    of_file = found.join(orders, "header").select("file", "place")
    of_file = F.broadcast(of_file) if found.count() <= most_files else of_file
    cell = F.array(*columns)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), cell.alias("cell")).join(of_file, "file")
    return rows.select(*[F.when(F.col("place")[k] >= 0, F.get("cell", F.col("place")[k])).try_cast(t).alias(n) for k, (n, t) in enumerate(wanted)])


def read_csv(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    """CSV with a header, plain or gzip, by the header's names. The schema is given, so that no pass infers it."""
    return read_named(spark, path, schema, **options)


def read_tree(spark: SparkSession, path: str, date_format: str = "yyyyMMdd", rename: Mapping[str, str] = {"dtyyyymmdd": "date"}) -> DataFrame:  # noqa: B006
    """ticker, date, close, volume of all CSV files below a folder, whose headers read <Name>, in any order."""

    def clean(cell: str) -> str:
        name = cell.strip().strip("<>").lower()
        return rename.get(name, name)

    x = read_named(spark, path, "ticker string, date string, close double, volume double", clean, recursiveFileLookup=True)
    return x.withColumn("date", F.to_date("date", date_format))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, text of every file below a folder, plain or gzip; the name is without folder and ending."""
    x = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt(\.gz)?$", "")
    return x.select(name.alias("name"), F.col("value").alias("text"))


def write_sections(df: DataFrame, path: str) -> None:
    """doc_id, section, text as Parquet by section, so that a reader of one section scans only it."""
    df.select("doc_id", "section", "text").write.partitionBy("section").mode("append").parquet(path)


def write_table(df: DataFrame, path: str, digits: int | None = None) -> None:
    """A result table as CSV with a header, doubles rounded to `digits` places."""
    kinds = dict(df.dtypes)
    shown = [F.round(f"`{c}`", digits).alias(c) if digits is not None and kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns]
    df.select(*shown).write.option("header", True).mode("overwrite").csv(path)


def append_new(df: DataFrame, path: str, key: str, text: str, **added: Column) -> DataFrame:
    """Appends to the log at `path` the rows whose (key, content hash) it lacks; returns the log.

    sha16 is 16 digits of the text's SHA-256. Rows that repeat within `df` are appended once. A run
    that is repeated after a failure appends nothing twice.
    """
    spark = df.sparkSession
    fresh = df.select(key, F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16).alias("sha16"), *[c.alias(n) for n, c in added.items()]).dropDuplicates([key, "sha16"])
    try:
        done = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001  the first run has no log; anything else is an error
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        fresh = fresh.join(done.select(key, "sha16"), [key, "sha16"], "left_anti")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


FACTS = "struct<facts: map<string, map<string, struct<units: map<string, array<struct<start: date, end: date, filed: date, val: double>>>>>>>"


def facts(df: DataFrame, key: str, json: str, taxonomy: str, tag: str) -> DataFrame:
    """key, start, end, filed, val of one tag of nested company facts: its first unit only. Companies
    without the tag have no rows; facts without a start have a null."""
    units = F.from_json(json, FACTS)["facts"][taxonomy][tag]["units"]
    return df.select(key, F.inline(F.get(F.map_values(units), F.lit(0))))


SUBMISSIONS = (
    "struct<cik: string, sic: string, pages: array<struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, "
    "acceptanceDateTime: array<string>, primaryDocument: array<string>, reportDate: array<string>>>>"
)
COLUMNS = ("accessionNumber", "form", "filingDate", "acceptanceDateTime", "primaryDocument", "reportDate")


def submissions(df: DataFrame, json: str, forms: Sequence[str], years: tuple[int, int]) -> DataFrame:
    """cik, sic and a row per filing of the wanted forms and years with a document, each accession once.

    The lists of a company's pages stand side by side; pages follow each other."""
    s = df.select(F.from_json(json, SUBMISSIONS).alias("s")).select("s.cik", "s.sic", F.explode("s.pages").alias("p"))
    rows = s.select("cik", "sic", F.inline(F.arrays_zip(*[F.col(f"p.{c}") for c in COLUMNS])))
    rows = rows.toDF("cik", "sic", "accession", "form", "filing_date", "acceptance", "document", "period")
    kept = rows.where(F.col("form").isin(*forms) & F.substring("filing_date", 1, 4).cast("int").between(*years) & (F.coalesce("document", F.lit("")) != ""))
    return kept.dropDuplicates(["accession"])


CATEGORIES = ("negative", "positive", "uncertainty", "litigious")


def flagged_words(table: DataFrame, rule: str = "positive") -> DataFrame:
    """term, category of a word list with a year flag per category, and category `master` for all words.

    rule: `positive` takes flags above 0, `nonzero` also negative ones (words taken out again)."""
    word = F.upper("Word").alias("term")
    met = [F.when(F.col(c.capitalize()) != 0 if rule == "nonzero" else F.col(c.capitalize()) > 0, F.lit(c)) for c in CATEGORIES]
    names = F.explode(F.array_compact(F.array(F.lit("master"), *met))).alias("category")
    return table.where("Word IS NOT NULL").select(word, names).distinct()


def sense_words(table: DataFrame) -> DataFrame:
    """term, category of a list whose entries may read WORD#2: negative and positive by a filled column."""
    term = F.upper(F.get(F.split("Entry", "#"), F.lit(0))).alias("term")
    met = F.array_compact(F.array(F.when(F.col("Negativ").isNotNull(), F.lit("negative")), F.when(F.col("Positiv").isNotNull(), F.lit("positive"))))
    return table.select(term, F.explode(met).alias("category")).distinct()


def phrase_words(table: DataFrame) -> DataFrame:
    """term, category of a list of phrases in normal form; other categories than the four are left out."""
    return table.where(F.col("category").isin(*CATEGORIES)).select(normal(F.col("word")).alias("term"), "category").distinct()


def scored_words(lines: DataFrame, threshold: float = 0.5) -> DataFrame:
    """term, category of tab-separated lines (column value): id, part of speech, positive and negative
    score, terms as first#1 second_word#2. Lines of fewer than five fields and comments are left out;
    a line counts where a score reaches the threshold and exceeds the other."""
    f = lines.select(F.split("value", "\t").alias("f"), F.col("value").startswith("#").alias("note")).where(~F.col("note") & (F.size("f") >= 5))
    score = lambda i: F.coalesce(F.col("f")[i].try_cast("double"), F.lit(0.0))
    f = f.select(score(2).alias("ps"), score(3).alias("ns"), F.col("f")[4].alias("terms"))
    kind = F.when((F.col("ns") >= threshold) & (F.col("ns") > F.col("ps")), "negative").when((F.col("ps") >= threshold) & (F.col("ps") > F.col("ns")), "positive")
    terms = f.select(kind.alias("category"), F.explode(F.split("terms", r"#\d+")).alias("term")).where("category IS NOT NULL")
    return terms.select(normal(F.replace("term", F.lit("_"), F.lit(" "))).alias("term"), "category").where("term <> ''").distinct()
