"""Queries over mention facts, annotations and their aggregates.

On the test corpus a stream is a source, a chapter the rank of a document in it, a block a line.  Names are a small
table of function words with a canonical name; notes are lines of 12 to 39 characters, their editions
derived from their place.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, ordered
from ..registry import query
from ..sources import corpus as src

# Fixed values of the test corpus: names and their aliases, images.
NAMES = [("art", "the"), ("art", "der"), ("art", "la"), ("prep", "of"), ("prep", "de"), ("prep", "von"), ("conj", "and"), ("conj", "und"), ("conj", "et"), ("pron", "that"), ("pron", "dans"), ("pron", "hat")]
IMAGES = [("en", "x"), ("er", "x"), ("s", "y"), ("an", "y"), ("ch", "z")]
HOLDERS = ["es", "st", "sch"]
MOODS = {"sad": "not|nicht|sin", "happy": "and|und|y "}

NAMES_SQL = "names(name, term) AS (VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in NAMES) + ")"
IMAGES_SQL = "images(term, category) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in IMAGES) + ")"
CH, BL = src.CHAPTERS_SQL, src.BLOCKS_SQL
FACTS_SQL = f"{CH}, {BL}, {NAMES_SQL}, facts AS (SELECT stream, chapter, seq, name, CAST(sum((length(text) - length(replace(text, term, ''))) // length(term)) AS BIGINT) AS n FROM blocks JOIN names ON contains(text, term) GROUP BY ALL)"
NOTES_SQL = f"{CH}, {BL}, notes AS (SELECT stream, chapter, seq, text, list_distinct(['E' || (seq % 3), 'E' || (length(text) % 5)]) AS editions, CASE WHEN length(text) % 2 = 0 THEN 'margin' ELSE 'side' END AS atype FROM blocks WHERE length(text) BETWEEN 12 AND 39)"


def chapters(spark, sf_dir):
    return src.chapters(spark, sf_dir)


def blocks(spark, sf_dir):
    return src.blocks(chapters(spark, sf_dir))


def names(spark):
    return spark.createDataFrame(NAMES, "name string, term string")


def images(spark):
    return spark.createDataFrame(IMAGES, "term string, category string")


def fact_table(spark, sf_dir):
    return facts.mentions(blocks(spark, sf_dir), names(spark), ["stream", "chapter", "seq"])


def notes(spark, sf_dir):
    b = blocks(spark, sf_dir).filter(F.length("text").between(12, 39))
    editions = F.array_distinct(F.array(F.concat(F.lit("E"), F.col("seq") % 3), F.concat(F.lit("E"), F.length("text") % 5)))
    return b.select("stream", "chapter", "seq", "text", editions.alias("editions"), F.when(F.length("text") % 2 == 0, "margin").otherwise("side").alias("atype"))


@query("mentions", f"WITH {FACTS_SQL} SELECT * FROM facts")
def mentions(spark, sf_dir):
    return fact_table(spark, sf_dir)


@query("mentions_large_dictionary", f"WITH {FACTS_SQL} SELECT * FROM facts")
def mentions_large_dictionary(spark, sf_dir):
    return facts.mentions(blocks(spark, sf_dir), names(spark), ["stream", "chapter", "seq"], block_rows=2)


@query("occurrences", f"WITH {CH}, {NAMES_SQL}, o AS (SELECT term, stream, chapter, CAST((length(text) - length(replace(text, term, ''))) // length(term) AS BIGINT) AS n, row_number() OVER (PARTITION BY term, stream ORDER BY chapter) AS k FROM chapters JOIN names ON contains(text, term)) SELECT term, stream, chapter, n FROM o WHERE k <= 12")
def occurrences(spark, sf_dir):
    return facts.occurrences(chapters(spark, sf_dir), names(spark), "stream", "chapter", 12)


@query("person_arc", f"WITH {FACTS_SQL} SELECT stream, chapter, CAST(sum(n) AS BIGINT) AS hits FROM facts WHERE name = 'art' GROUP BY ALL")
def person_arc(spark, sf_dir):
    return facts.arc(fact_table(spark, sf_dir), "art", ["stream", "chapter"])


@query("hot_list", f"WITH {FACTS_SQL} SELECT name, CAST(sum(n) AS BIGINT) AS total FROM facts GROUP BY name ORDER BY total DESC, name LIMIT 3")
def hot_list(spark, sf_dir):
    return facts.hot_list(fact_table(spark, sf_dir), 3)


@query("mention_span", f"WITH {FACTS_SQL} SELECT stream, name, min(chapter) AS first, max(chapter) AS last, count(DISTINCT chapter) AS chapters, CAST(sum(n) AS BIGINT) AS total FROM facts GROUP BY stream, name")
def mention_span(spark, sf_dir):
    return facts.mention_span(fact_table(spark, sf_dir), "chapter", ["stream"])


@query("cooccur", f"WITH {FACTS_SQL} SELECT b.name, CAST(sum(b.n) AS BIGINT) AS w FROM facts a JOIN facts b USING (stream, chapter) WHERE a.name = 'art' AND b.name <> 'art' GROUP BY b.name ORDER BY w DESC, b.name LIMIT 5")
def cooccur(spark, sf_dir):
    return facts.cooccur(fact_table(spark, sf_dir), "art", ["stream", "chapter"], 5)


@query("cooccur_normalized", f"WITH {FACTS_SQL}, c AS (SELECT DISTINCT stream, chapter FROM facts WHERE name = 'art') SELECT name, CAST(sum(n) AS BIGINT) AS w FROM facts JOIN c USING (stream, chapter) WHERE name <> 'art' GROUP BY name ORDER BY w DESC, name LIMIT 5")
def cooccur_normalized(spark, sf_dir):
    return facts.cooccur(fact_table(spark, sf_dir), "art", ["stream", "chapter"], 5, normalized=True)


@query("pair_cooccur", "WITH i AS (SELECT DISTINCT l_orderkey AS g, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT a.item AS a, b.item AS b, count(*) AS n FROM i a JOIN i b ON a.g = b.g AND a.item < b.item GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 70")
def pair_cooccur(spark, sf_dir):
    li, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    items = li.join(part, li["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("g"), F.col("p_brand").alias("item"))
    return facts.pair_cooccurrence(items, ["g"], "item", 2, 70)


@query("image_facts", f"WITH {CH}, {IMAGES_SQL} SELECT stream, chapter, term, category, CAST((length(text) - length(replace(text, term, ''))) // length(term) AS BIGINT) AS n FROM chapters JOIN images ON contains(text, term)")
def image_facts(spark, sf_dir):
    return facts.image_facts(chapters(spark, sf_dir), images(spark), ["stream", "chapter"])


_SUB = " + ".join(f"(length(text) - length(replace(text, '{h}', ''))) // {len(h)}" for h in HOLDERS)


@query("image_facts_exclusive", f"WITH {CH}, {IMAGES_SQL}, r AS (SELECT stream, chapter, term, category, CAST(greatest((length(text) - length(replace(text, term, ''))) // length(term) - CASE WHEN term = 's' THEN {_SUB} ELSE 0 END, 0) AS BIGINT) AS n FROM chapters JOIN images ON contains(text, term)) SELECT * FROM r WHERE n > 0")
def image_facts_exclusive(spark, sf_dir):
    held = spark.createDataFrame([(h,) for h in HOLDERS], "term string")
    return facts.image_facts(chapters(spark, sf_dir), images(spark), ["stream", "chapter"], held)


@query("imagery_by_stream", f"WITH {CH}, {IMAGES_SQL}, f AS (SELECT stream, term, CAST((length(text) - length(replace(text, term, ''))) // length(term) AS BIGINT) AS n FROM chapters JOIN images ON contains(text, term)), t AS (SELECT stream, term, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY n DESC, term) AS rank FROM t) SELECT stream, term, n, rank FROM k WHERE rank <= 3")
def imagery_by_stream(spark, sf_dir):
    f = facts.image_facts(chapters(spark, sf_dir), images(spark), ["stream", "chapter"]).groupBy("stream", "term").agg(F.sum("n").cast("long").alias("n"))
    return ordered.top_n(f, ["stream"], [F.desc("n"), F.col("term")], 3).withColumn("rank", F.col("rank").cast("long"))


@query("people_in", f"""WITH {CH}, {NAMES_SQL}, h AS (SELECT DISTINCT doc_id, term, name FROM chapters JOIN names ON contains(text, term)),
    k AS (SELECT doc_id, name, max(length(term)) AS size FROM h WHERE NOT EXISTS (SELECT 1 FROM h l WHERE l.doc_id = h.doc_id AND contains(l.term, h.term) AND length(l.term) > length(h.term)) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, name) AS k FROM k) SELECT doc_id, string_agg(name, ',' ORDER BY k) AS names FROM r WHERE k <= 3 GROUP BY doc_id""")
def people_in(spark, sf_dir):
    got = facts.people_in(chapters(spark, sf_dir), names(spark), ["doc_id"])
    return got.select("doc_id", F.concat_ws(",", "names").alias("names"))


@query("festival_ranges", f"WITH {CH}, ranges(festival, lo, hi) AS (VALUES ('spring', 3, 9), ('moon', 8, 20), ('frost', 21, 30)), r AS (SELECT festival, stream, chapter, row_number() OVER (PARTITION BY festival, stream ORDER BY chapter) AS k FROM chapters JOIN ranges ON chapter BETWEEN lo AND hi) SELECT festival, stream, chapter FROM r WHERE k <= 8")
def festival_ranges(spark, sf_dir):
    ranges = spark.createDataFrame([("spring", 3, 9), ("moon", 8, 20), ("frost", 21, 30)], "festival string, lo int, hi int")
    hit = facts.range_join(chapters(spark, sf_dir).select("stream", "chapter"), ranges, "chapter", "lo", "hi")
    return ordered.top_n(hit, ["festival", "stream"], [F.col("chapter")], 8).select("festival", "stream", "chapter")


@query("annotation_density", f"WITH {NOTES_SQL}, m AS (SELECT stream, chapter, count(*) FILTER (length(text) >= 40) AS n_main FROM blocks GROUP BY ALL), n AS (SELECT stream, chapter, count(*) AS n FROM notes GROUP BY ALL) SELECT stream, chapter, n, round(n * 1.0 / nullif(n_main, 0), 3) AS per_block FROM n JOIN m USING (stream, chapter) ORDER BY n DESC, stream, chapter LIMIT 20")
def annotation_density(spark, sf_dir):
    main = F.when(F.length("text") >= 40, src.MAIN).otherwise(src.NOTE)
    rolled = src.chapter_rollup(blocks(spark, sf_dir).withColumn("kind", main), ("stream", "chapter"), "kind", "seq")
    return facts.annotation_density(notes(spark, sf_dir), rolled, ["stream", "chapter"], 20)


@query("edition_dist", f"WITH {NOTES_SQL} SELECT e AS edition, count(*) AS n FROM (SELECT unnest(editions) AS e FROM notes) GROUP BY e")
def edition_dist(spark, sf_dir):
    return facts.edition_dist(notes(spark, sf_dir))


@query("edition_matrix", f"WITH {NOTES_SQL}, c AS (SELECT e AS edition, chapter, count(*) AS n FROM (SELECT unnest(editions) AS e, chapter FROM notes) GROUP BY ALL), t AS (SELECT edition, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY edition ORDER BY total DESC, edition LIMIT 3) SELECT edition, chapter, n, total FROM c JOIN t USING (edition)")
def edition_matrix(spark, sf_dir):
    return facts.edition_matrix(notes(spark, sf_dir), "chapter", 3)


@query("affinity", f"WITH {NOTES_SQL}, s AS (SELECT DISTINCT stream, atype, substring(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), 1, 8) AS sig, unnest(editions) AS e FROM notes), k AS (SELECT * FROM s WHERE length(sig) >= 4) SELECT x.e AS a, y.e AS b, count(*) AS n FROM k x JOIN k y USING (stream, atype, sig) GROUP BY ALL")
def affinity(spark, sf_dir):
    signature = F.substring(F.regexp_replace("text", r"[^\p{L}]", ""), 1, 8)
    return facts.edition_affinity(notes(spark, sf_dir), ["stream"], "atype", signature)


@query("annotator_stats", f"WITH {NOTES_SQL}, e AS (SELECT unnest(editions) AS edition, stream || '/' || chapter AS c, length(text) AS len FROM notes) SELECT edition, count(*) AS n, CAST(sum(len) AS BIGINT) AS chars, round(sum(len) / count(*), 6) AS mean_len, count(DISTINCT c) AS covered, round(count(*) * 1.0 / 80, 6) AS density FROM e GROUP BY edition")
def annotator_stats(spark, sf_dir):
    return facts.annotator_stats(notes(spark, sf_dir).withColumn("c", F.concat("stream", F.lit("/"), "chapter")), "c")


@query("annotator_axes", f"WITH {NOTES_SQL}, e AS (SELECT unnest(editions) AS edition, stream || '/' || chapter AS c, length(text) AS len FROM notes), s AS (SELECT edition, count(*) AS n, count(DISTINCT c) AS covered, sum(len) / count(*) AS mean_len FROM e GROUP BY edition) SELECT edition, round(n / max(n) OVER (), 6) AS n, round(covered / max(covered) OVER (), 6) AS covered, round(mean_len / max(mean_len) OVER (), 5) AS mean_len FROM s")
def annotator_axes(spark, sf_dir):
    stats = facts.annotator_stats(notes(spark, sf_dir).withColumn("c", F.concat("stream", F.lit("/"), "chapter")), "c")
    axes = facts.max_normalize(stats.select("edition", "n", "covered", "mean_len"), ["n", "covered", "mean_len"])
    return axes.select("edition", F.round("n", 6).alias("n"), F.round("covered", 6).alias("covered"), F.round("mean_len", 5).alias("mean_len"))


NOTE_MOODS = {"calm": ("the", "der"), "keen": ("tion", "keit")}


@query("annotator_types", f"WITH {NOTES_SQL} SELECT e AS edition, atype, count(*) AS n FROM (SELECT unnest(editions) AS e, atype FROM notes) GROUP BY ALL")
def annotator_types(spark, sf_dir):
    return facts.annotator_types(notes(spark, sf_dir), "atype")


@query("annotator_moods", f"WITH {NOTES_SQL}, e AS (SELECT unnest(editions) AS edition, length(text) AS n, (length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'der', ''))) // 3 AS calm, (length(text) - length(replace(text, 'tion', ''))) // 4 + (length(text) - length(replace(text, 'keit', ''))) // 4 AS keen FROM notes) SELECT edition, round(sum(calm) * 1000.0 / sum(n), 6) AS calm, round(sum(keen) * 1000.0 / sum(n), 6) AS keen FROM e GROUP BY edition")
def annotator_moods(spark, sf_dir):
    return facts.annotator_moods(notes(spark, sf_dir), NOTE_MOODS)


@query("annotator_samples", f"WITH {NOTES_SQL}, e AS (SELECT unnest(editions) AS edition, stream, chapter, seq, text FROM notes), s AS (SELECT 'longest' AS why, 3 AS n, length(text) AS s, * FROM e UNION ALL SELECT 'calm', 2, (length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'der', ''))) // 3, * FROM e UNION ALL SELECT 'keen', 2, (length(text) - length(replace(text, 'tion', ''))) // 4 + (length(text) - length(replace(text, 'keit', ''))) // 4, * FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY why, edition ORDER BY s DESC, stream, chapter, seq) AS k FROM s WHERE s > 0) SELECT edition, why, CAST(k AS INTEGER) AS rank, stream, chapter, seq, text FROM r WHERE k <= n")
def annotator_samples(spark, sf_dir):
    return facts.annotator_samples(notes(spark, sf_dir), ["stream", "chapter", "seq"], NOTE_MOODS)


@query("affect_curve", f"WITH {CH}, {BL} SELECT stream, chapter, CAST(sum(CASE WHEN regexp_matches(text, '{MOODS['sad']}') THEN 1 ELSE 0 END) AS BIGINT) AS sad, CAST(sum(CASE WHEN regexp_matches(text, '{MOODS['happy']}') THEN 1 ELSE 0 END) AS BIGINT) AS happy, count(*) AS blocks FROM blocks GROUP BY ALL")
def affect_curve(spark, sf_dir):
    return facts.affect_curve(blocks(spark, sf_dir), ["stream", "chapter"], MOODS)


@query("segments", f"WITH {FACTS_SQL}, seg(segment, lo, hi) AS (VALUES ('head', 1, 20), ('mid', 15, 35), ('tail', 36, 1000000)), k AS (SELECT segment, name, count(*) AS n FROM facts JOIN seg ON chapter BETWEEN lo AND hi GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, name) AS r FROM k), z AS (SELECT segment, sum(length(text)) AS chars FROM chapters JOIN seg ON chapter BETWEEN lo AND hi GROUP BY segment) SELECT segment, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds, round(count(*) * 10000.0 / any_value(chars), 6) AS kinds_per_10k, round(sum(n) FILTER (r <= 2) / sum(n), 6) AS concentration FROM r JOIN z USING (segment) GROUP BY segment")
def segments(spark, sf_dir):
    seg = spark.createDataFrame([("head", 1, 20), ("mid", 15, 35), ("tail", 36, 1000000)], "segment string, lo int, hi int")
    chars = chapters(spark, sf_dir).select("chapter", F.length("text").alias("chars"))
    return facts.segment_summary(fact_table(spark, sf_dir), seg, "chapter", "name", chars, 2)


@query("head_tail", f"WITH {CH}, x AS (SELECT stream, chapter, 'chars' AS metric, CAST(length(text) AS DOUBLE) AS v FROM chapters UNION ALL SELECT stream, chapter, 'lines', CAST(len(string_split(text, chr(10))) AS DOUBLE) FROM chapters) SELECT stream, metric, round(avg(v) FILTER (chapter <= 30), 6) AS head, round(avg(v) FILTER (chapter > 30 AND chapter <= 45), 6) AS tail, count(*) FILTER (chapter <= 30) AS n_head, count(*) FILTER (chapter > 30 AND chapter <= 45) AS n_tail FROM x GROUP BY stream, metric")
def head_tail(spark, sf_dir):
    c = chapters(spark, sf_dir).select("stream", "chapter", F.length("text").alias("chars"), F.size(F.split("text", "\n")).alias("lines"))
    return facts.head_tail_means(c, ["stream"], "chapter", ["chars", "lines"], 30, 45)


@query("quartiles", f"WITH {CH}, s AS (SELECT stream, list_sort(list(length(text))) AS v, count(*) AS n FROM chapters GROUP BY stream) SELECT stream, v[1] AS least, v[CAST(floor(0.25 * (n - 1) + 0.5) AS BIGINT) + 1] AS q1, v[CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT) + 1] AS median, v[CAST(floor(0.75 * (n - 1) + 0.5) AS BIGINT) + 1] AS q3, v[n] AS most, v[n // 2 + 1] AS upper_median FROM s")
def quartiles(spark, sf_dir):
    return facts.quartiles(chapters(spark, sf_dir).select("stream", F.length("text").cast("long").alias("chars")), ["stream"], "chars")


@query("speakers", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS topics, CAST(sum(length(text)) AS BIGINT) AS chars, min_by(text, conv_id * 1000 + turn) AS first_claim FROM conversations GROUP BY role")
def speakers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    each = c.groupBy("role", "conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min_by("text", "turn").alias("t"))
    return each.groupBy("role").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("topics"), F.sum("chars").cast("long").alias("chars"), F.min_by("t", "conv_id").alias("first_claim"))


@query("lane_stats", "WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, event_type, sum(n) AS n FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM t) SELECT e.user_id, CAST(sum(e.n) AS BIGINT) AS n, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, (SELECT string_agg(event_type, ',' ORDER BY k) FROM k WHERE k.user_id = e.user_id AND k <= 3) AS types FROM e GROUP BY e.user_id")
def lane_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    span = e.groupBy("user_id").agg(F.sum("n").cast("long").alias("n"), F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"))
    kinds = ordered.top_n(e.groupBy("user_id", "event_type").agg(F.sum("n").alias("n")), ["user_id"], [F.desc("n"), F.col("event_type")], 3)
    top = kinds.groupBy("user_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda x: x["event_type"])).alias("types"))
    return span.join(top, "user_id")


@query("pruned_edges", "SELECT c_custkey AS a, n_nationkey AS b FROM customer JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 WHERE c_custkey <> n_nationkey AND c_custkey IN (SELECT o_custkey FROM orders)")
def pruned_edges(spark, sf_dir):
    customer, nation, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "orders"))
    edges = customer.select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("b"))
    known = orders.select(F.concat(F.lit("c"), "o_custkey").alias("node")).unionByName(nation.filter("n_regionkey < 3").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))).distinct()
    keyed = edges.filter("a <> b").select("a", "b", F.concat(F.lit("c"), "a").alias("ka"), F.concat(F.lit("n"), "b").alias("kb"))
    return facts.prune_edges(known, keyed, "node", "ka", "kb").select("a", "b")


# Ordered operators.


@query("smoothed", f"WITH {CH} SELECT stream, chapter, round(avg(length(text)) OVER (PARTITION BY stream ORDER BY chapter ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM chapters")
def smoothed(spark, sf_dir):
    c = chapters(spark, sf_dir).select("stream", "chapter", F.length("text").alias("v"))
    return ordered.smooth(c, ["stream"], "chapter", "v", "s").select("stream", "chapter", F.round("s", 6).alias("smooth"))


@query("turning_points", f"""WITH {CH}, d AS (SELECT stream, chapter, lead(length(text), 2) OVER w - lag(length(text), 2) OVER w AS d FROM chapters WINDOW w AS (PARTITION BY stream ORDER BY chapter)),
    k AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY d, chapter) AS k FROM d WHERE d IS NOT NULL),
    r AS (SELECT stream, list_reduce(list_transform(list({{'k': k, 'at': chapter, 'd': d}} ORDER BY k), lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y['at'] - x[1]['at']) <= 6)) > 0 THEN acc ELSE list_concat(acc, x) END) AS r FROM k WHERE k <= 6 GROUP BY stream)
    SELECT stream, CAST(u['at'] AS INTEGER) AS chapter, CAST(u['d'] AS BIGINT) AS d FROM (SELECT stream, unnest(r) AS u FROM r)""")
def turning_points(spark, sf_dir):
    c = chapters(spark, sf_dir).select("stream", "chapter", F.length("text").cast("long").alias("v"))
    return ordered.turning_points(c, ["stream"], "chapter", "v")


@query("season_fill", f"WITH {CH}, s AS (SELECT stream, chapter, CASE WHEN contains(text, 'with') THEN 'w' WHEN contains(text, 'für') THEN 'f' END AS season FROM chapters) SELECT stream, chapter, last_value(season IGNORE NULLS) OVER (PARTITION BY stream ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS season FROM s")
def season_fill(spark, sf_dir):
    season = F.when(F.contains("text", F.lit("with")), "w").when(F.contains("text", F.lit("für")), "f")
    c = chapters(spark, sf_dir).select("stream", "chapter", season.alias("raw"))
    return ordered.fill_forward(c, ["stream"], "chapter", "raw", "season", block=16).select("stream", "chapter", "season")


@query("epochs", f"WITH {CH}, m AS (SELECT stream, chapter FROM chapters WHERE contains(text, 'that')), g AS (SELECT *, chapter - lag(chapter) OVER (PARTITION BY stream ORDER BY chapter) AS gap FROM m), i AS (SELECT *, sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY chapter) AS island FROM g) SELECT stream, CAST(island AS BIGINT) AS island, min(chapter) AS lo, max(chapter) AS hi, count(*) AS n FROM i GROUP BY stream, island")
def epochs(spark, sf_dir):
    m = chapters(spark, sf_dir).filter(F.contains("text", F.lit("that"))).select("stream", "chapter")
    got = ordered.islands(m, ["stream"], "chapter", 2).groupBy("stream", "island")
    return got.agg(F.min("chapter").alias("lo"), F.max("chapter").alias("hi"), F.count("*").alias("n")).withColumn("island", F.col("island").cast("long"))


@query("recurrence", "WITH d AS (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY ALL) SELECT event_type, user_id, first, CAST(row_number() OVER (PARTITION BY event_type ORDER BY first) AS BIGINT) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM d")
def recurrence(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))
    ranked = ordered.running_sum(d, ["event_type"], "first", F.lit(1).cast("long"), "place")
    return ranked.join(d.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")


@query("folds", f"WITH {CH}, n AS (SELECT stream, count(*) AS n FROM chapters GROUP BY stream) SELECT stream, chapter, CAST(floor((chapter - 1) / ceil(n / 8)) AS INTEGER) AS fold FROM chapters JOIN n USING (stream)")
def folds(spark, sf_dir):
    c = chapters(spark, sf_dir).select("stream", "chapter")
    sized = c.join(c.groupBy("stream").agg(F.count("*").alias("n")), "stream")
    return sized.select("stream", "chapter", ordered.fold_id("chapter", "n", 8).alias("fold"))


@query("block_means", f"WITH {CH} SELECT stream, CAST(floor((chapter - 1) / 10) AS BIGINT) AS decade, round(avg(length(text)), 6) AS mean, 'act ' || CAST(floor((min(chapter) - 1) / 5) AS BIGINT) AS act FROM chapters GROUP BY ALL")
def block_means(spark, sf_dir):
    c = chapters(spark, sf_dir).groupBy("stream", F.floor((F.col("chapter") - 1) / 10).alias("decade")).agg(F.avg(F.length("text")).alias("m"), F.min("chapter").alias("c"))
    return c.select("stream", "decade", F.round("m", 6).alias("mean"), F.concat(F.lit("act "), F.floor((F.col("c") - 1) / 5)).alias("act"))


@query("assigned_chapters", f"""WITH {CH}, h AS (SELECT stream, chapter AS id, CASE WHEN length(text) % 4 = 0 THEN length(text) % 30 END AS no FROM chapters),
    m AS (SELECT *, max(no) OVER (PARTITION BY stream ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM h)
    SELECT stream, id, CAST(coalesce(last_value(CASE WHEN no > coalesce(top, 0) THEN no END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS chapter FROM m""")
def assigned_chapters(spark, sf_dir):
    n = F.length("text")
    h = chapters(spark, sf_dir).select("stream", F.col("chapter").alias("id"), F.when(n % 4 == 0, n % 30).alias("no"))
    return ordered.assign_chapters(h, ["stream"], "id", "no").select("stream", "id", "chapter")
