"""Queries over text functions and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..registry import query
from ..sources import corpus as src

# Fixed values of the test corpus: its classes and delimiters.
LETTER_CLASS, ENDS = tx.LETTERS, ".!?"
FOLD = {"ä": "a", "ö": "o", "ü": "u", "ß": "s", "é": "e", "è": "e", "ê": "e", "à": "a", "ç": "c", "ñ": "n", "ó": "o", "í": "i", "á": "a", "ú": "u"}
ARTICLES = ("the", "der", "die", "das", "la", "le", "el", "los", "les")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("clean_chars", r"SELECT doc_id, CAST(length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS BIGINT) AS n_letters, md5(regexp_replace(text, '[^\p{L}.!?]', '', 'g')) AS cleaned, CAST(length(regexp_replace(text, '[.,!?]', '', 'g')) AS BIGINT) AS n_unpunctuated FROM documents")
def clean_chars(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length(tx.keep_chars("text", LETTER_CLASS)).cast("long").alias("n_letters"), F.md5(tx.keep_chars("text", LETTER_CLASS, ENDS).cast("binary")).alias("cleaned"), F.length(tx.drop_chars("text", ".,!?")).cast("long").alias("n_unpunctuated"))


@query("variant_fold", f"SELECT doc_id, md5(translate(replace(text, 'sch', 'sh'), '{''.join(FOLD)}', '{''.join(FOLD.values())}')) AS folded FROM documents")
def variant_fold(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.normalize_variants("text", FOLD, [("sch", "sh")]).cast("binary")).alias("folded"))


@query("numerals", "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(doc_id % 10000 AS DOUBLE) AS value, doc_id % 10000 AS n FROM documents")
def numerals(spark, sf_dir):
    n = F.col("doc_id") % 10000
    return documents(spark, sf_dir).select("doc_id", tx.parse_numeral(tx.format_numeral(n)).alias("value"), n.alias("n"))


@query("title_fix", f"""WITH {src.CHAPTERS_SQL}, t AS (SELECT doc_id, chapter, regexp_extract('Chapter ' || chapter || ': ' || split_part(text, chr(10), 1), '^Chapter (\\d+): (.*)$', 2) AS raw FROM chapters),
    s AS (SELECT doc_id, trim(regexp_replace(raw, '[\\s]+', ' ', 'g')) AS t FROM t)
    SELECT doc_id, CASE WHEN length(t) < 6 OR regexp_matches(t, '[|\\[\\]]') THEN '' ELSE t END AS title FROM s""")
def title_fix(spark, sf_dir):
    ch = src.chapters(spark, sf_dir)
    headed = ch.select("doc_id", "chapter", F.concat(F.lit("Chapter "), F.col("chapter"), F.lit(": "), F.element_at(F.split("text", "\n"), 1)).alias("line"))
    title = tx.extract_title("line", "chapter", r"^Chapter (\d+): (.*)$", lambda c: c.cast("double"))
    return headed.select("doc_id", tx.fix_title(title).alias("title"))


@query("noise_lines", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^\s*\d+\s*$')), chr(10)) AS kept, md5(CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40)) = 0 THEN text ELSE array_to_string(list_slice(string_split(text, chr(10)), list_position(list_transform(string_split(text, chr(10)), lambda x: length(x) >= 40), true), len(string_split(text, chr(10)))), chr(10)) END) AS body FROM documents")
def noise_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.strip_noise_lines("text", r"^\s*\d+\s*$").alias("kept"), F.md5(tx.strip_body("text").cast("binary")).alias("body"))


@query("sentences", f"WITH {src.CHAPTERS_SQL} SELECT stream, chapter, CAST(len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: trim(s) <> '')) AS BIGINT) AS n, CAST(list_max(list_transform(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: trim(s) <> ''), lambda s: length(s))) AS BIGINT) AS longest FROM chapters")
def sentences(spark, sf_dir):
    s = src.chapters(spark, sf_dir).select("stream", "chapter", tx.split_sentences("text", ENDS).alias("s"))
    return s.select("stream", "chapter", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


_COUNT = " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) / {len(w)}" for w in ARTICLES)


@query("lexicon_density", f"SELECT doc_id, CAST({_COUNT.replace('/', '//')} AS BIGINT) AS n, round(CASE WHEN length(text) > 0 THEN ({_COUNT.replace('/', '//')}) * 1000.0 / length(text) ELSE 0 END, 6) AS per_1000 FROM documents")
def lexicon_density(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.lexicon_count("text", ARTICLES).alias("n"), F.round(tx.density("text", ARTICLES), 6).alias("per_1000"))


@query("class_density", "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (length(text) - length(translate(text, 'aeiou', ''))) / length(text) ELSE 1.0 END, 6) AS vowels FROM documents")
def class_density(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(tx.class_density("text", "aeiou", 1.0), 6).alias("vowels"))


@query("snippets", """WITH h AS (SELECT doc_id, text, instr(text, ' the ') AS p FROM documents WHERE contains(text, ' the '))
    SELECT doc_id, substring(text, greatest(p - 1 - 20, 0) + 1, p - 1 - greatest(p - 1 - 20, 0)) || '[' || substring(text, p, 5) || ']' || substring(text, p + 5, 20) AS hit,
           (CASE WHEN p - 1 - 15 > 0 THEN '…' ELSE '' END) || substring(text, greatest(p - 1 - 15, 0) + 1, 30) || (CASE WHEN greatest(p - 1 - 15, 0) + 30 < length(text) THEN '…' ELSE '' END) AS quote, right(text, 12) AS last FROM h""")
def snippets(spark, sf_dir):
    h = documents(spark, sf_dir).filter(F.contains("text", F.lit(" the "))).withColumn("at", F.instr("text", " the ") - 1)
    return h.select("doc_id", tx.snippet("text", "at", 5, 20, ("[", "]")).alias("hit"), tx.centred_quote("text", "at").alias("quote"), tx.tail("text", 12).alias("last"))


@query("truncated", r"""WITH c AS (SELECT doc_id, text, substring(text, 1, 200) AS cut, length(regexp_extract(substring(text, 1, 200), '(?s)^(.*[.!?])', 1)) AS last FROM documents)
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN last > 100 THEN substring(cut, 1, last) ELSE cut END AS short FROM c""")
def truncated(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.truncate_at_sentence("text", 200, ENDS).alias("short"))


@query("owner_chain", "SELECT p_partkey, split_part(p_name, ' ', 1) AS giver, p_brand AS holder, CAST(3 AS BIGINT) AS n FROM part")
def owner_chain(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    chain = F.concat(F.element_at(F.split("p_name", " "), 1), F.lit("→"), F.col("p_type"), F.lit("→"), F.col("p_brand"), F.lit("（by gift）"))
    parsed = part.select("p_partkey", tx.parse_chain(chain, alternatives="／").alias("c"))
    return parsed.select("p_partkey", F.col("c")[0][0].alias("giver"), F.element_at(F.element_at("c", -1), 1).alias("holder"), F.size("c").cast("long").alias("n"))


@query("chapter_ranges", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 50 >= l_partkey % 50 THEN l_suppkey % 50 - l_partkey % 50 + 1 ELSE 1 END AS n, l_partkey % 50 AS first FROM lineitem")
def chapter_ranges(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.concat(F.lit("no. "), (F.col("l_partkey") % 50).cast("string"), F.lit("-"), (F.col("l_suppkey") % 50).cast("string")).alias("r"))
    parsed = li.select("l_orderkey", "l_linenumber", tx.chapter_range("r").alias("c"))
    return parsed.select("l_orderkey", "l_linenumber", F.size("c").cast("long").alias("n"), F.col("c")[0].cast("long").alias("first"))


@query("rule_class", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'numeric' WHEN regexp_matches(text, '\|') THEN 'table' WHEN regexp_matches(text, '^[A-Z !.?]+$') THEN 'loud' ELSE 'prose' END AS label,
    array_to_string(CASE WHEN regexp_matches(text, '@|https?:') OR regexp_matches(text, 'und|der') THEN list_filter([CASE WHEN regexp_matches(text, '@|https?:') THEN 'contact' END, CASE WHEN regexp_matches(text, 'und|der') THEN 'german' END], lambda x: x IS NOT NULL) ELSE ['other'] END, ',') AS tags FROM documents""")
def rule_class(spark, sf_dir):
    rules = [("numeric", "[0-9]{3}"), ("table", r"\|"), ("loud", r"^[A-Z !.?]+$")]
    tags = tx.multi_tags("text", {"contact": ["@", "http:", "https:"], "german": ["und", "der"]}, "other")
    return documents(spark, sf_dir).select("doc_id", tx.classify("text", rules, "prose").alias("label"), F.concat_ws(",", tags).alias("tags"))


@query("page_text", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<style\b[^>]*>.*?</style\s*>|<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|table|section|article|nav|footer|ul|ol)\s*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS t FROM b)
    SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{2,}', chr(10), 'g'))) AS text_md5 FROM c""")
def page_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.md5(tx.html_to_text("html").cast("binary")).alias("text_md5"))


@query("chapter_rollup", f"WITH {src.CHAPTERS_SQL}, {src.BLOCKS_SQL} SELECT stream, chapter, min(seq) AS page_start, max(seq) AS page_end, count(*) FILTER (length(text) >= 40) AS n_main, count(*) FILTER (length(text) BETWEEN 12 AND 39) AS n_anno, count(*) FILTER (length(text) < 12) AS n_note FROM blocks GROUP BY ALL")
def chapter_rollup(spark, sf_dir):
    n = F.length("text")
    kind = F.when(n >= 40, src.MAIN).when(n >= 12, src.ANNOTATION).otherwise(src.NOTE)
    b = src.blocks(src.chapters(spark, sf_dir)).withColumn("kind", kind)
    return src.chapter_rollup(b, ("stream", "chapter"), "kind", "seq")


@query("pending_keys", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_keys(spark, sf_dir):
    return src.pending(documents(spark, sf_dir).select("doc_id", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])


@query("edition_manifest", f"WITH {src.CHAPTERS_SQL} SELECT stream, count(*) AS chapters, CAST(sum(length(text)) AS BIGINT) AS chars, sha256(string_agg(sha256(text), '' ORDER BY chapter)) AS sha256 FROM chapters GROUP BY stream")
def edition_manifest(spark, sf_dir):
    # Chapters ascend by doc_id, so digests are ordered by it and texts are not moved.
    return src.manifest(documents(spark, sf_dir).select(F.col("source").alias("stream"), "doc_id", "text"), chapter="doc_id")


@query("upsert_rows", "SELECT doc_id, 1 - quality AS quality, toxic FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id + 1000000000, quality, toxic FROM labels WHERE doc_id % 5 = 0")
def upsert_rows(spark, sf_dir):
    old = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    changed = old.filter("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality"))
    added = old.filter("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return src.upsert(old, changed.unionByName(added), ["doc_id"])


@query("multivalue", "SELECT page_id, trim(unnest(string_split(regexp_extract(url, '://([^/:?#]+)', 1), '.'))) AS label FROM pages")
def multivalue(spark, sf_dir):
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "://([^/:?#]+)", 1).alias("label"))
    return src.explode_multivalue(hosts, "label", r"\.", ("—",))


@query("corpus_stats", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'topics', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'events', count(*) FROM events")
def corpus_stats(spark, sf_dir):
    names = ("documents", "pages", "conversations", "events")
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    nested = tables["conversations"].groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("speeches"))
    return src.corpus_stats(tables | {"topics": nested.select("conv_id")})


@query("clauses", r"SELECT doc_id, CAST(len(c) AS BIGINT) AS n, CAST(list_sum(list_transform(c, lambda x: length(x))) AS BIGINT) AS total FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.,!?\n]'), lambda x: regexp_replace(x, '[^\p{L}]', '', 'g')), lambda x: length(x) > 0) AS c FROM documents)")
def clauses(spark, sf_dir):
    c = documents(spark, sf_dir).select("doc_id", tx.split_clauses("text", ".,!?\n", r"^([A-Z][a-z]+) said: ", "", None, LETTER_CLASS).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.when(F.size("c") > 0, F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["length"])).alias("total"))


@query("markers", "SELECT event_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' ELSE 'C' END || CASE WHEN user_id % 2 = 0 THEN ',D' ELSE '' END AS editions, CASE WHEN user_id % 3 = 0 THEN 'margin' WHEN user_id % 3 = 1 THEN 'side' ELSE 'line' END AS kind FROM events")
def markers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").otherwise("c")
    kind = F.element_at(F.array(F.lit("m"), F.lit("s"), F.lit("l")), (F.col("user_id") % 3 + 1).cast("int"))
    marker = F.concat(first, kind, F.when(F.col("user_id") % 2 == 0, "d").otherwise(""))
    got = e.select("event_id", tx.decode_markers(marker, {"a": "A", "b": "B", "c": "C", "d": "D"}, {"m": "margin", "s": "side", "l": "line"}).alias("m"))
    return got.select("event_id", F.concat_ws(",", "m.editions").alias("editions"), F.col("m.kind").alias("kind"))


@query("inline_notes", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Jia' ELSE 'Geng' END AS editions, role AS kind, trim(replace(replace(text, '【', ''), '】', '')) AS note FROM conversations")
def inline_notes(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    clean = F.translate("text", "【】", "")
    marked = F.concat(F.lit("x【"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Jia"), "role")).otherwise(F.col("role")), F.lit(":"), clean, F.lit("】y"))
    got = c.select("conv_id", "turn", F.explode(tx.harvest_annotations(marked, ["Jia", "Geng"], ["user", "assistant", "system"], "Geng")).alias("a"))
    return got.select("conv_id", "turn", F.concat_ws(",", "a.editions").alias("editions"), F.col("a.kind").alias("kind"), F.col("a.text").alias("note"))


@query("chapter_texts", f"WITH {src.CHAPTERS_SQL} SELECT doc_id, stream, chapter, md5(text) AS digest FROM chapters WHERE text IS NOT NULL")
def chapter_texts(spark, sf_dir):
    """Chapters put together again from their lines."""
    lines = src.blocks(src.chapters(spark, sf_dir))
    return src.concat_chapter(lines, ["doc_id", "stream", "chapter"], "seq").select("doc_id", "stream", "chapter", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("book_union", f"WITH {src.CHAPTERS_SQL} SELECT stream, chapter, doc_id, CASE WHEN chapter % 5 = 0 THEN 'later' ELSE 'main' END AS src, length(text) AS n FROM chapters")
def book_union(spark, sf_dir):
    """Every fifth chapter is in a later book, which overrides the main one."""
    ch = src.chapters(spark, sf_dir).select("stream", "chapter", "doc_id", F.length("text").cast("long").alias("n"))
    return src.book_union({"main": ch, "later": ch.filter("chapter % 5 = 0")}, ["stream", "chapter"])


@query("top_values", "WITH s AS (SELECT 'source' AS name, source AS value, count(*) AS n FROM documents GROUP BY source), l AS (SELECT 'lang' AS name, lang AS value, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT 'event' AS name, event_type AS value, count(*) AS n FROM events GROUP BY event_type), u AS (FROM s UNION ALL FROM l UNION ALL FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM u WHERE value IS NOT NULL) SELECT name, value, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def top_values(spark, sf_dir):
    docs, events = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/events.parquet")
    return src.top_values({"source": (docs, "source"), "lang": (docs, "lang"), "event": (events, "event_type")}, 3)


@query("nested_counts", "SELECT conv_id, count(*) AS n_turns, CAST(sum(len(list_filter(string_split(text, '. '), lambda x: x <> ''))) AS BIGINT) AS n_speeches FROM conversations GROUP BY conv_id")
def nested_counts(spark, sf_dir):
    """Speeches of every conversation, counted through two nested arrays."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.filter(F.split("text", r"\. "), lambda x: x != "").alias("speeches"))
    nested = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "speeches")).alias("turns"))
    return nested.select("conv_id", src.nested_count(["turns"]).alias("n_turns"), src.nested_count(["turns", "speeches"]).alias("n_speeches"))
