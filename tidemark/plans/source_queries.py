"""Queries over files that are written from the tables and read back: scans, nested data, word lists, sinks, a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sentences
from ..sources import files
from ..sources import tables as src
from .queries import query, r


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS day FROM orders")
def csv_scan(spark, sf_dir):
    """Compressed CSV with a header, read by schema."""
    path = files.work_dir(spark, "csv")
    o = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    o.write.options(header=True, compression="gzip").csv(path)
    return files.read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day date")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY ALL")
def csv_sink(spark, sf_dir):
    """A result table written with rounded doubles and read again."""
    path = files.work_dir(spark, "csv-sink")
    x = src.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"), F.avg("l_discount").alias("discount"))
    files.write_table(x, path, 4)
    return files.read_csv(spark, path, "l_returnflag string, l_linestatus string, n long, quantity double, discount double")


@query("SELECT event_id, event_type, (props ->> '$.k')::BIGINT AS k FROM events")
def json_scan(spark, sf_dir):
    """JSON lines with a nested object, read by schema."""
    path = files.work_dir(spark, "json")
    e = src.table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("props"))
    e.write.json(path)
    return spark.read.schema("event_id long, event_type string, props struct<k: long>").json(path).select("event_id", "event_type", "props.k")


@query("SELECT n_regionkey::VARCHAR AS ticker, l_shipdate::DATE AS date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS close, sum(l_quantity) AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def price_tree_scan(spark, sf_dir):
    """Price files in folders of folders, with headers in angle brackets and dates as digits; some have
    their columns in another order and one more."""
    path = files.work_dir(spark, "tree")
    px = src.prices(spark, sf_dir).select(F.col("ticker").cast("string").alias("<Ticker>"), F.date_format("date", "yyyyMMdd").alias("<DTYYYYMMDD>"), F.col("close").alias("<Close>"), F.col("volume").alias("<Volume>"), F.col("ticker").alias("part"))
    named = ["<Ticker>", "<DTYYYYMMDD>", "<Close>", "<Volume>"]
    px.where("part % 2 = 0").select(*named, "part").write.partitionBy("part").option("header", True).csv(f"{path}/even")
    px.where("part % 2 = 1").select("<Volume>", F.lit("x").alias("<Open>"), *named[:3], "part").write.partitionBy("part").option("header", True).csv(f"{path}/odd")
    return files.read_tree(spark, path)


@query("SELECT doc_id, 'full' AS section, length(text) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'lead', length(string_split(text, chr(10))[1]) FROM documents WHERE text IS NOT NULL")
def section_files(spark, sf_dir):
    """Texts stored by section."""
    path = files.work_dir(spark, "sections")
    d = src.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    for section, text in (("full", F.col("text")), ("lead", F.get(F.split("text", "\n"), F.lit(0)))):
        files.write_sections(d.select("doc_id", F.lit(section).alias("section"), text.alias("text")), path)
    return spark.read.parquet(path).select("doc_id", "section", F.length("text").cast("long").alias("n"))


@query("SELECT count(*) AS n_files, sum(length(t)) AS chars FROM (SELECT string_agg(o_orderkey::VARCHAR, '') AS t FROM orders GROUP BY o_orderpriority)")
def text_files(spark, sf_dir):
    """Compressed text files, one folder per priority and a line per order, read whole."""
    path = files.work_dir(spark, "texts")
    lines = src.table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderkey").cast("string").alias("text"))
    lines.repartition("o_orderpriority").write.partitionBy("o_orderpriority").option("compression", "gzip").text(path)
    x = files.read_texts(spark, path)
    return x.agg(F.count("name").alias("n_files"), F.sum(F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("chars"))


def _facts_json(spark, sf_dir):
    """A nested document per customer: shares for all, equity for those of even key."""
    o, day = src.table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    start = F.when(F.col("o_orderkey") % 3 > 0, F.date_sub(day, 395))
    fact = F.struct(start.alias("start"), F.date_sub(day, 30).alias("end"), day.alias("filed"), F.col("o_totalprice").alias("val"))
    units = lambda items, unit, other: F.create_map(F.lit(unit), items, F.lit(other), F.slice(items, 1, 1))
    tag = lambda items, unit, other: F.struct(units(items, unit, other).alias("units"))
    g = o.groupBy(F.col("o_custkey").alias("cik")).agg(F.sort_array(F.collect_list(fact)).alias("f"))
    shares = F.create_map(F.lit("Shares"), tag(F.col("f"), "shares", "pure"))
    equity = F.when(F.col("cik") % 2 == 0, F.create_map(F.lit("Equity"), tag(F.col("f"), "USD", "EUR")))
    return g.select("cik", F.to_json(F.struct(F.create_map(F.lit("dei"), shares, F.lit("us-gaap"), equity).alias("facts"))).alias("json"))


_fact = "SELECT o_custkey AS cik, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderdate::DATE - 395)::DATE END AS start, (o_orderdate::DATE - 30)::DATE AS \"end\", o_orderdate::DATE AS filed, o_totalprice AS val"


@query(f"{_fact}, 'shares' AS tag FROM orders UNION ALL {_fact}, 'equity' FROM orders WHERE o_custkey % 2 = 0")
def nested_facts(spark, sf_dir):
    """Facts of two tags out of nested JSON: the first unit alone, none for a company without the tag."""
    j = files.stored(_facts_json(spark, sf_dir), "facts")
    shares = files.facts(j, "cik", "json", "dei", "Shares").withColumn("tag", F.lit("shares"))
    return shares.unionByName(files.facts(j, "cik", "json", "us-gaap", "Equity").withColumn("tag", F.lit("equity")))


_acc = "lpad((o_orderkey // 2)::VARCHAR, 8, '0')"


@query(f"WITH f AS (SELECT o_custkey::VARCHAR AS cik, {_acc} AS accession, o_orderpriority AS form, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, CASE WHEN o_orderkey % 7 > 0 THEN 'd.htm' ELSE '' END AS document FROM orders) SELECT DISTINCT accession FROM f WHERE form IN ('1-URGENT', '2-HIGH') AND left(filing_date, 4)::INT BETWEEN 1996 AND 1999 AND document <> ''")
def filing_lists(spark, sf_dir):
    """Filings out of lists that stand side by side in pages, each accession once."""
    o = src.table(spark, sf_dir, "orders")
    item = F.struct(
        F.lpad(F.floor(F.col("o_orderkey") / 2).cast("string"), 8, "0").alias("accessionNumber"), F.col("o_orderpriority").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("acceptanceDateTime"), F.when(F.col("o_orderkey") % 7 > 0, "d.htm").otherwise("").alias("primaryDocument"), F.lit(None).cast("string").alias("reportDate"),
    )
    page = o.groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("page")).agg(F.collect_list(item).alias("i"))
    page = page.select("o_custkey", F.struct(*[F.col(f"i.{c}").alias(c) for c in files.COLUMNS]).alias("p"))
    j = page.groupBy("o_custkey").agg(F.collect_list("p").alias("pages")).select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.lit("7372").alias("sic"), "pages")).alias("json"))
    return files.submissions(j, "json", ["1-URGENT", "2-HIGH"], (1996, 1999)).select("accession")


FLAGS = "SELECT p_name AS w, p_size % 3 - 1 AS negative, p_size % 5 - 3 AS positive, p_size % 2 AS uncertainty, 0 AS litigious FROM part"


@query(
    f"WITH f AS ({FLAGS}) SELECT DISTINCT upper(w) AS term, 'master' AS category FROM f UNION SELECT upper(w), 'negative' FROM f WHERE negative > 0 UNION SELECT upper(w), 'positive' FROM f WHERE positive > 0 UNION SELECT upper(w), 'uncertainty' FROM f WHERE uncertainty > 0"
)
def lexicon_flags(spark, sf_dir):
    """A word list with year flags, written as CSV and loaded: words by category, and all words."""
    path = files.work_dir(spark, "flags")
    p = src.table(spark, sf_dir, "part")
    n = F.col("p_size")
    p.select(F.col("p_name").alias("Word"), (n % 3 - 1).alias("Negative"), (n % 5 - 3).alias("Positive"), (n % 2).alias("Uncertainty"), F.lit(0).alias("Litigious")).write.option("header", True).csv(path)
    return files.flagged_words(files.read_csv(spark, path, "Word string, Negative int, Positive int, Uncertainty int, Litigious int"))


@query("SELECT DISTINCT upper(p_type) AS term, CASE WHEN p_size % 2 = 0 THEN 'negative' ELSE 'positive' END AS category FROM part")
def lexicon_senses(spark, sf_dir):
    p = src.table(spark, sf_dir, "part")
    even = F.col("p_size") % 2 == 0
    entry = F.concat("p_type", F.lit("#"), F.col("p_partkey").cast("string"))
    return files.sense_words(p.select(entry.alias("Entry"), F.when(even, "Negativ").alias("Negativ"), F.when(~even, "Positiv").alias("Positiv")))


@query("SELECT DISTINCT lower(p_name) AS term, CASE p_size % 3 WHEN 0 THEN 'negative' ELSE 'positive' END AS category FROM part WHERE p_size % 3 < 2 UNION SELECT lower(p_type), CASE p_size % 3 WHEN 0 THEN 'negative' ELSE 'positive' END FROM part WHERE p_size % 3 < 2")
def lexicon_scores(spark, sf_dir):
    """Tab-separated senses with scores: a third negative, a third positive, a third undecided."""
    p = src.table(spark, sf_dir, "part")
    k = F.col("p_size") % 3
    score = lambda i: F.when(k == i, "0.75").otherwise("0.25")
    terms = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("#1 "), F.col("p_type"), F.lit("#2"))
    lines = p.select(F.concat_ws("\t", F.lit("a"), F.col("p_partkey").cast("string"), score(1), score(0), terms).alias("value"))
    return files.scored_words(lines.unionByName(spark.createDataFrame([("# a comment",), ("too\tshort",)], "value string")))


@query("""WITH s AS (SELECT doc_id, lang, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '\\S+')) BETWEEN 8 AND 80)[1:20] AS s FROM documents)
SELECT doc_id, substr(sha256(array_to_string(s, chr(10))), 1, 16) AS sha16, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS batch FROM s WHERE len(s) > 0""")
def append_log(spark, sf_dir):
    """The first 20 sentences of English texts are logged, then those of all texts: the second run adds only
    those that are new. Texts without a sentence have no row."""
    path = files.work_dir(spark, "log")
    d = src.table(spark, sf_dir, "documents").select("doc_id", "lang", sentences(F.col("text"), first=20).alias("s")).where(F.size("s") > 0)
    d = d.select("doc_id", "lang", F.array_join("s", "\n").alias("text"))
    files.append_new(d.where("lang = 'en'"), path, "doc_id", "text", batch=F.lit(1))
    return files.append_new(d, path, "doc_id", "text", batch=F.lit(2))
