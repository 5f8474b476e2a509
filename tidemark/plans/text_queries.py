"""Queries on text forms, sections, quality, versions and parsers, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import compare, parse, sections, spelling, unicode
from ..functions.text import character_error_rate, tokens_en
from ..operators import layout, phrases, stats, tone
from ..sources import tables as src
from .panel_queries import LONGEST, NEGATORS_VI, PHRASES
from .queries import DOCS, LEX, TOKENS, query, r

_space = r"trim(regexp_replace(lower(nfc_normalize({})), '\s+', ' ', 'g'))"
NORMAL = _space.format("text")
FOLD = f"strip_accents(replace({_space.format('coalesce(text, chr(32))')}, 'đ', 'd'))"


@query(f"SELECT doc_id, sha256({NORMAL}) AS sha FROM documents")
def normal_text(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", F.sha2(unicode.normal(F.col("text")), 256).alias("sha"))


@query(f"SELECT doc_id, sha256({FOLD}) AS sha FROM documents")
def folded_text(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", F.sha2(unicode.fold(F.coalesce("text", F.lit(" "))), 256).alias("sha"))


# Filings made of the documents: a heading with its number, a repeated heading, a bare heading, no end.
HEADS = ("PART II. ITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS", "ITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS (CONTINUED)", "MANAGEMENT’S DISCUSSION AND ANALYSIS", "ITEM 7. MANAGEMENTS DISCUSSION")
_words = lambda x: f"len(regexp_extract_all({x}, '\\S+'))"
_head = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{h.replace(chr(39), chr(39) * 2)}'" for i, h in enumerate(HEADS)) + " END"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 4 AS k, {_words(_head)} + {_words('text')} AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN k IN (0, 2) AND n BETWEEN 250 AND 100000 THEN n END::BIGINT AS n_words, CASE WHEN k = 0 AND n BETWEEN 250 AND 100000 THEN 'ok_t1_10k_item7' WHEN k = 2 AND n BETWEEN 250 AND 100000 THEN 'ok_t3_bare' ELSE 'no_match' END AS status FROM d""")
def discussion_sections(spark, sf_dir):
    """A table of contents, then the heading of each kind, the text and an end mark; the fourth kind has none."""
    d = src.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    head = F.element_at(F.lit(list(HEADS)), (F.col("doc_id") % 4 + 1).cast("int"))
    contents = F.lit("CONTENTS\nITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS\n12\nITEM 8. X\n15\n")
    end = F.when(F.col("doc_id") % 4 < 3, F.lit("\nITEM 7A. RISK\n")).otherwise(F.lit("\nEND\n"))
    x = d.select("doc_id", sections.extract_discussion(F.concat(contents, head, F.lit("\n"), F.upper("text"), end)).alias("s"))
    return x.select("doc_id", F.regexp_count("s.text", F.lit(r"\S+")).cast("long").alias("n_words"), "s.status")


@query(f"WITH d AS (SELECT doc_id, 4 + {_words('text')} AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN n >= 250 THEN n END::BIGINT AS n_words, CASE WHEN n >= 250 THEN 'ok' ELSE 'no_match' END AS status FROM d")
def risk_sections(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    filing = F.concat(F.lit("ITEM 1A. RISK FACTORS\n"), F.upper("text"), F.lit("\nITEM 1B. UNRESOLVED STAFF COMMENTS"))
    x = d.select("doc_id", sections.extract_risk_factors(filing).alias("s"))
    return x.select("doc_id", F.regexp_count("s.text", F.lit(r"\S+")).cast("long").alias("n_words"), "s.status")


# The tone-marked letters of the languages at hand and their plain forms; SQL has no decomposed form.
_MARKED, _BARE = "àáãảạèéẽẻẹìíĩỉịòóõỏọùúũủụỳýỹỷỵñ", "aaaaaeeeeeiiiiiooooouuuuuyyyyyn"
_punct = spelling.PUNCTUATION.replace("'", "''")
_class = "".join("\\" + c if c in "\\]^-[" else c for c in _punct)
QUALITY = f"""WITH t AS (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS x FROM documents), k AS (SELECT doc_id, x, regexp_extract_all(x, '\\S+') AS toks FROM t),
c AS (SELECT doc_id, trim(unnest(toks), '{_punct}') AS core FROM k WHERE len(toks) >= 20), p AS (SELECT doc_id, core, regexp_extract_all(core, '\\p{{L}}+') AS ws FROM c WHERE core <> '' AND NOT regexp_full_match(core, '[0-9.,%]+')),
b AS (SELECT doc_id, sum((len(ws) = 0 OR ws[1] <> core)::INT) AS bad FROM p GROUP BY doc_id), w AS (SELECT doc_id, lower(unnest(ws)) AS w FROM p),
v AS (SELECT doc_id, count(*) AS n, sum((length(w) = 1 AND NOT contains('{spelling.SINGLE}', w))::INT) AS single,
sum((regexp_full_match(translate(w, '{_MARKED}', '{_BARE}'), '{spelling.SYLLABLE}') AND length(regexp_replace(w, '[^{_MARKED}]', '', 'g')) <= 1)::INT) AS valid FROM w GROUP BY doc_id),
j AS (SELECT doc_id, least(1, (length(regexp_replace(x, '[\\p{{L}}\\p{{Nd}}\\s{_class}]', '', 'g')) + 5 * len(regexp_extract_all(x, '\\(cid:'))) / length(regexp_replace(x, '\\s', '', 'g'))) AS junk FROM k WHERE len(toks) >= 20),
m AS (SELECT k.doc_id, len(toks)::BIGINT AS n_tokens, coalesce(valid / greatest(n, 1), 0) AS valid, coalesce(junk, 0) AS junk, (coalesce(bad, 0) + coalesce(single, 0)) / greatest(coalesce(n, 0), 1) AS broken FROM k LEFT JOIN b USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN j USING (doc_id))
SELECT doc_id, n_tokens, round(valid, 6) AS valid, round(junk, 6) AS junk, round(broken, 6) AS broken, CASE WHEN n_tokens < 20 THEN 0.0 ELSE round(0.6 * valid + 0.2 * (1 - least(1, 10 * junk)) + 0.2 * (1 - least(1, 4 * broken)), 6) END::DOUBLE AS score FROM m"""


@query(QUALITY)
def text_quality_score(spark, sf_dir):
    x = src.table(spark, sf_dir, "documents").select("doc_id", spelling.text_quality(F.col("text"), digits=12).alias("q"))
    return x.select("doc_id", "q.n_tokens", *[r(F.col(f"q.{c}"), 6).alias(c) for c in ("valid", "junk", "broken", "score")])


@query("SELECT conv_id, round(sum(turn / 10.0 * greatest(len(regexp_extract_all(text, '\\S+')), 1)) / sum(greatest(len(regexp_extract_all(text, '\\S+')), 1)), 8) AS score FROM conversations GROUP BY conv_id")
def weighted_page_quality(spark, sf_dir):
    pages = src.table(spark, sf_dir, "conversations").withColumn("score", F.col("turn") / 10.0)
    return spelling.weighted_quality(pages, "conv_id", "score", "text").select("conv_id", r(F.col("score")).alias("score"))


START, CHAPTER, SIGNED = " the ", "^(.{0,40})( of | and )", " for "
LETTERS = f"""WITH p AS (SELECT conv_id, turn AS page, coalesce(text, '') AS text, {FOLD} AS n FROM conversations),
f AS (SELECT *, strpos(n, '{START}') AS place, regexp_matches(left(n, 400), '{layout.CONTENTS}') OR len(regexp_extract_all(n, '\\s[0-9]{{1,3}}\\s')) > 15 AS listing FROM p),
s AS (SELECT conv_id, min(page) FILTER (NOT listing AND place > 0 AND place - 1 < greatest(600, length(n) // 2)) AS a FROM f GROUP BY conv_id),
i AS (SELECT f.*, a FROM f JOIN s USING (conv_id) WHERE page >= a AND page < a + 6),
e AS (SELECT conv_id, a, least(max(page), min(page) FILTER (page > a AND regexp_matches(left(n, 200), '{CHAPTER}')) - 1, min(page) FILTER (contains(n, '{SIGNED}'))) AS b FROM i GROUP BY ALL),
w AS (SELECT conv_id, a, b, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS n_words FROM e JOIN i USING (conv_id, a) WHERE page <= b GROUP BY ALL)
SELECT conv_id, a AS start_page, b AS end_page, n_words, CASE WHEN a IS NULL THEN 'not_found' WHEN n_words < 60 THEN 'too_short' WHEN n_words > 400 THEN 'too_long' ELSE 'ok' END AS flag FROM s LEFT JOIN w USING (conv_id, a)"""


@query(LETTERS)
def letter_pages(spark, sf_dir):
    """Conversations as reports, turns as pages; the marks of start, chapter and signature are parameters."""
    pages = src.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text")
    found = layout.locate_letters(pages, "conv_id", start=START, chapter=CHAPTER, signed=SIGNED, words=(60, 400), scan=10_000)
    return found.select("conv_id", "start_page", "end_page", "n_words", "flag")


@query()
def page_reading_order(spark, sf_dir):
    """Orders as pages, line items as blocks placed by quantity, day and price; no SQL form of the recursion."""
    li = src.table(spark, sf_dir, "lineitem")
    x, y = F.floor(F.col("l_quantity") / 17) * 120.0, F.dayofmonth("l_shipdate") * 20.0
    block = F.struct(x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 15).alias("y1"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_linenumber").alias("no"), F.when(F.col("l_tax") > 0.07, 1).otherwise(0).alias("kind"))
    pages = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(block)).cast(layout.BLOCKS).alias("blocks"))
    return layout.reading_order(pages, "l_orderkey")


_tokens = "o_orderdate::DATE || CASE WHEN o_orderkey % 25 = 0 THEN ' of the year' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN ' a' ELSE '' END"
MACHINE = f"""WITH t AS (SELECT o_custkey % 20 AS id, string_agg({_tokens}, ' ' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1), k AS (SELECT id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM t),
h AS (SELECT id, i, i - lag(i) OVER (PARTITION BY id ORDER BY i) > 3 AS new FROM k WHERE regexp_full_match(w, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')), g AS (SELECT id, sum(coalesce(new, true)::INT) OVER (PARTITION BY id ORDER BY i) AS run FROM h),
c AS (SELECT id, run, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 20) SELECT t.id, count(c.n) AS n_runs, coalesce(sum(c.n), 0)::BIGINT AS items FROM t LEFT JOIN c USING (id) GROUP BY t.id"""


@query(MACHINE)
def machine_data_runs(spark, sf_dir):
    """Runs of machine tokens in texts made of order dates and a few words."""
    o = src.table(spark, sf_dir, "orders")
    word = F.concat(F.to_date("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 25 == 0, " of the year").otherwise(""), F.when(F.col("o_orderkey") % 4 == 0, " a").otherwise(""))
    parts = F.sort_array(F.collect_list(F.struct("o_orderkey", word.alias("w"))))
    t = o.groupBy((F.col("o_custkey") % 20).alias("id")).agg(F.array_join(F.transform(parts, lambda p: p["w"]), " ").alias("text"))
    x = t.select("id", layout.machine_runs(F.col("text")).alias("m"))
    return x.select("id", F.size("m").cast("long").alias("n_runs"), F.aggregate("m", F.lit(0).cast("long"), lambda n, z: n + z["items"]).alias("items"))


_word, _bare = "[\\p{L}\\p{Nl}\\p{No}]{2,}", "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
READABLE = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
f AS (SELECT *, regexp_matches(x, '{_word}') AS worded FROM l WHERE {_bare.format(x='x')} <> ''),
n AS (SELECT doc_id, count(*) FILTER (NOT worded AND before) AS n FROM (SELECT *, coalesce(lag(worded) OVER (PARTITION BY doc_id ORDER BY k), true) AS before FROM f) GROUP BY doc_id),
s AS (SELECT doc_id, x, k, lead(x) OVER w AS y, lead(k) OVER w AS j FROM f WHERE worded WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
c AS (SELECT doc_id, sum(j - k) AS n FROM s WHERE y IS NOT NULL AND NOT ({_bare.format(x='x')} = upper({_bare.format(x='x')}) AND len(regexp_extract_all(x, '{_word}')) <= 12)
AND NOT (regexp_matches(x, '[.!?:;…”"»)]\\s*$') AND regexp_matches(y, '^\\s*[A-ZÀ-Ỹ0-9\\-–•*(“"+]')) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_hidden, coalesce(c.n, 0)::BIGINT AS n_joined, true AS same_length FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


@query(READABLE)
def readable_documents(spark, sf_dir):
    """How much of a text, taken as Vietnamese, a reader is spared: hidden ranges and joined lines."""
    d = src.table(spark, sf_dir, "documents")
    x = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), layout.readable_view(F.col("text"), F.lit("vi")).alias("v"))
    lines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return x.select("doc_id", F.size("v.hidden").cast("long").alias("n_hidden"), (lines(F.col("text")) - lines(F.col("v.text"))).cast("long").alias("n_joined"), (F.length("v.text") == F.length("text")).alias("same_length"))


def _turns(spark, sf_dir):
    last = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return src.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", last.alias("last")).where("last IS NOT NULL AND text IS NOT NULL")


@query()
def turn_similarity(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", r(compare.similarity(F.col("last"), F.col("text"))).alias("similarity"))


@query()
def turn_differences(spark, sf_dir):
    x = _turns(spark, sf_dir).select("conv_id", "turn", compare.differences(F.col("last"), F.col("text")).alias("d"))
    return x.select("conv_id", "turn", F.size("d.old").alias("n_old"), F.size("d.new").alias("n_new"))


@query(
    "WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN 'text_fix' ELSE 'vision' END AS mode, (turn % 4) / 4.0 + 0.15 AS sim, (conv_id % 5) / 5.0 AS before, (turn % 3) / 3.0 AS after FROM conversations) "
    "SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'llm_empty' WHEN mode = 'text_fix' AND sim < 0.8 THEN 'rewrite_suspected' WHEN after < before THEN 'quality_not_improved' ELSE 'accepted' END AS decision FROM c"
)
def accept_rule(spark, sf_dir):
    c = src.table(spark, sf_dir, "conversations")
    t = F.col("turn")
    mode = F.when(t % 2 == 0, "text_fix").otherwise("vision")
    return c.select("conv_id", "turn", compare.accepted(mode, F.col("text"), (t % 4) / 4.0 + 0.15, (F.col("conv_id") % 5) / 5.0, (t % 3) / 3.0).alias("decision"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def fenced_json(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    n = F.col("event_id") % 3
    answer = F.when(n == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked"))).otherwise(F.col("props"))
    return e.select("event_id", parse.fenced_json(answer, "k long")["k"].alias("k"))


@query("WITH a AS (SELECT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 18, '0') AS a FROM orders) SELECT o_orderkey, left(a, 10) || '-' || a[11:12] || '-' || a[13:18] AS accession FROM a")
def accession_format(spark, sf_dir):
    o = src.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", parse.accession(F.lpad((F.col("o_orderkey") * 7919).cast("string"), 18, "0")).alias("accession"))


@query("SELECT c_custkey, round(c_acctbal / 1e5, 4) AS coef, round((c_custkey % 90) / 1e3, 4) AS se, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '*' WHEN 2 THEN '**' ELSE '***' END AS stars FROM customer")
def coefficient_cells(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer")
    star = F.element_at(F.lit(["", "*", "**", "***"]), (F.col("c_custkey") % 4 + 1).cast("int"))
    cell = F.concat(F.round(F.col("c_acctbal") / 1e5, 4).cast("decimal(18,4)").cast("string"), star, F.lit(" ("), F.round((F.col("c_custkey") % 90) / 1e3, 4).cast("decimal(18,4)").cast("string"), F.lit(")"))
    return c.select("c_custkey", parse.coefficient(cell).alias("c")).select("c_custkey", "c.coef", "c.se", "c.stars")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'vi' ELSE 'en' END AS lang FROM part")
def language_of_name(spark, sf_dir):
    p = src.table(spark, sf_dir, "part")
    end = F.element_at(F.lit(["_vn", " (EN)", " bản Tiếng Anh"]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", parse.language(F.concat("p_name", end)).alias("lang"))


@query("SELECT event_id, date_trunc('milliseconds', ts) + INTERVAL 7 HOUR AS local FROM events")
def epoch_stamps(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    stamp = F.concat(F.lit("/Date("), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit(")/"))
    return e.select("event_id", parse.epoch_date(stamp).alias("local"))


@query("SELECT event_id, ts::DATE AS event_date, hour(ts) >= 16 AS after_close FROM events")
def event_date_from_acceptance(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    day, late = parse.acceptance(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z")))
    return e.select("event_id", day.alias("event_date"), late.alias("after_close"))


@query("SELECT l_returnflag, round(sum(l_discount), 4) AS l_discount, round(sum(l_tax), 4) AS l_tax FROM lineitem GROUP BY 1")
def columns_by_pattern(spark, sf_dir):
    """The columns a pattern picks, of those that are there; one that is asked for and absent is passed over."""
    li = src.table(spark, sf_dir, "lineitem")
    picked = [c for c in [*stats.columns_like(li, "^l_(disc|tax)"), "l_absent"] if c in li.columns]
    return li.groupBy("l_returnflag").agg(*[r(F.sum(c), 4).alias(c) for c in picked])


@query("SELECT lang, arg_min(quality, doc_id) FILTER (quality IS NOT NULL) AS quality, arg_min(toxic, doc_id) FILTER (toxic IS NOT NULL) AS toxic, arg_min(source, doc_id) FILTER (source IS NOT NULL) AS source FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def first_known_values(spark, sf_dir):
    x = src.table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(src.table(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.first_known(x, ["lang"], "doc_id", ["quality", "toxic", "source"])


@query("SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':' || 42), doc_id LIMIT 30")
def seeded_sample(spark, sf_dir):
    return stats.sample(src.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 30, 42)


@query("WITH c AS (SELECT p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || '  X ', '\\s+', ' ', 'g'))) AS a, lower(p_type) AS b FROM part) SELECT p_partkey, round(levenshtein(a, b) / greatest(length(b), 1), 8) AS cer FROM c")
def cer_normal(spark, sf_dir):
    """Character error rate of texts that differ in case and spaces too."""
    p = src.table(spark, sf_dir, "part")
    return p.select("p_partkey", r(character_error_rate(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  X ")), F.col("p_type"))).alias("cer"))


MASTER = f"""WITH {LEX}, {DOCS}, tok AS (SELECT doc_id, {TOKENS} AS t FROM docs WHERE lang = 'en'), words AS (SELECT doc_id, unnest(t) AS term FROM tok), master AS (SELECT term FROM words GROUP BY term HAVING count(*) >= 3),
n AS (SELECT doc_id, count(*) AS n FROM words JOIN master USING (term) GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS ng FROM words JOIN lex USING (term) WHERE lexicon = 'fin' AND category = 'negative' GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(ng, 0) / greatest(coalesce(n, 0), 1), 8) AS neg FROM tok LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


@query(MASTER)
def en_tone_master(spark, sf_dir):
    """Shares of the words that a master list holds: here all words met three times or more."""
    d = src.english(spark, sf_dir).select("doc_id", "text")
    words = d.select(F.explode(tokens_en(F.col("text"))).alias("term"))
    master = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return tone.indices(d, src.lexicon(spark, "fin"), master=master).select("doc_id", "n_words", r(F.col("neg")).alias("neg"))


@query(f"""WITH {LEX}, {DOCS}, tok AS (SELECT doc_id, {TOKENS} AS t FROM docs WHERE lang = 'en' AND NOT regexp_matches(text, '[ßŉǰﬀ-ﬆ]')), w AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM tok),
f AS (SELECT *, coalesce(bool_or(term IN {src.NEGATORS}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS off FROM w),
c AS (SELECT doc_id, category, term, count(*) AS n FROM f JOIN lex USING (term) WHERE lexicon = 'fin' AND (category <> 'positive' OR NOT off) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY n DESC, term)::INT AS place FROM c) WHERE place <= 12""")
def span_top_words(spark, sf_dir):
    """The twelve most frequent terms of each category among a text's spans, negated positive ones left out."""
    spans = phrases.term_spans(src.english(spark, sf_dir).select("doc_id", "text"), src.lexicon(spark, "fin"), src.NEGATORS)
    return phrases.top_words(spans)


def _holds(category):
    return lambda span: F.array_contains(span["categories"], category)


@query(LONGEST)
def phrase_span_counts(spark, sf_dir):
    """Counts of the spans of longest phrases by category: those of `longest_match_counts`."""
    d = src.disclosures(spark, sf_dir).where("lang IN ('fr', 'es')").select("doc_id", "text")
    spans = phrases.phrase_spans(d, spark.createDataFrame(list(PHRASES), "term string, category string"), 3, NEGATORS_VI)
    n = {c: F.size(F.filter("spans", _holds(c))).cast("long") for c in phrases.CATEGORIES}
    words = d.select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ỹđ]+"), F.lit(0))).cast("long").alias("n_words"))
    return words.join(spans.select("doc_id", *[x.alias(c) for c, x in n.items()]), "doc_id")
