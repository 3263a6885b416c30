"""Queries over poets, periods, evidence, kinship and owners.

On the test corpus a poem is a line of 12 to 39 characters; author, genre, rhyme and number of verses are derived from its place and length.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import facts, gates, graph, ledgers, verse
from ..registry import ORACLES, query
from ..sources import corpus as src
from .fact_queries import FACTS_SQL, IMAGES_SQL, MOODS, NAMES_SQL, NOTES_SQL, blocks, chapters, fact_table, images, names, notes
from .model_queries import LEXICONS, climate, spectrum

CH, BL = src.CHAPTERS_SQL, src.BLOCKS_SQL
POEMS_SQL = f"""{CH}, {BL}, poems AS (SELECT stream || '/' || chapter || '/' || seq AS id, stream, chapter, text, CAST(length(text) % 5 AS BIGINT) AS n_lines, (length(text) % 4) / 4.0 AS rhyme, ['song', 'riddle', 'verse'][length(text) % 3 + 1] AS genre,
    CASE WHEN seq % 5 = 0 THEN '' WHEN seq % 5 = 1 THEN '（' || stream || '）' ELSE stream END AS author FROM blocks WHERE length(text) BETWEEN 12 AND 39)"""
RANGES = [("front", 1, 15), ("back", 16, 30), ("all", 1, 100000)]
RANGES_SQL = "ranges(label, lo, hi) AS (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in RANGES) + ")"


def poems(spark, sf_dir):
    n = F.length("text")
    author = F.when(F.col("seq") % 5 == 0, "").when(F.col("seq") % 5 == 1, F.concat(F.lit("（"), "stream", F.lit("）"))).otherwise(F.col("stream"))
    genre = F.element_at(F.array(*map(F.lit, ("song", "riddle", "verse"))), n % 3 + 1)
    b = blocks(spark, sf_dir).filter(n.between(12, 39))
    return b.select(F.concat_ws("/", "stream", "chapter", "seq").alias("id"), "stream", "chapter", "text", (n % 5).cast("long").alias("n_lines"), ((n % 4) / 4.0).alias("rhyme"), genre.alias("genre"), author.alias("author"))


def ranges(spark):
    return spark.createDataFrame(RANGES, "label string, lo int, hi int")


@query("poem_ranges", f"""WITH {POEMS_SQL}, {RANGES_SQL}, s AS (SELECT chapter, sum(length(text)) AS chars, count(*) AS chapters FROM chapters GROUP BY chapter), n AS (SELECT chapter, count(*) AS poems, sum(greatest(n_lines, 1)) AS lines FROM poems GROUP BY chapter)
    SELECT label, CAST(coalesce(sum(poems), 0) AS BIGINT) AS poems, CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines, CAST(sum(chapters) AS BIGINT) AS chapters, round(coalesce(sum(poems), 0) * 10000.0 / greatest(sum(chars), 1), 6) AS per_10k FROM s LEFT JOIN n USING (chapter) JOIN ranges ON chapter BETWEEN lo AND hi GROUP BY label""")
def poem_ranges(spark, sf_dir):
    return verse.poem_ranges(poems(spark, sf_dir), chapters(spark, sf_dir), ranges(spark))


@query("poet_profiles", f"""WITH {POEMS_SQL}, p AS (SELECT author, chapter, greatest(n_lines, 1) AS l, length(text) AS t, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS z, length(text) - length(translate(text, 'aeiou', '')) AS soft, length(text) - length(translate(text, 'kt', '')) AS hard FROM poems WHERE genre <> 'riddle' AND author <> '')
    SELECT author, count(*) AS poems, CAST(sum(l) AS BIGINT) AS lines, round(sum(t) / sum(l), 6) AS mean_line_len, round(sum(soft) / greatest(sum(z), 1), 6) AS soft, round(sum(hard) / greatest(sum(z), 1), 6) AS hard, count(DISTINCT chapter) AS n_chapters, min(chapter) AS first, max(chapter) AS last
    FROM p GROUP BY author ORDER BY starts_with(author, '（'), poems DESC, lines DESC, author LIMIT 16""")
def poet_profiles(spark, sf_dir):
    return verse.poet_profiles(poems(spark, sf_dir), ["riddle"], {"soft": "[aeiou]", "hard": "[kt]"}, r"\p{L}")


@query("gatherings", f"""WITH {POEMS_SQL}, j AS (SELECT n_name AS gathering, poems.* FROM nation LEFT JOIN poems ON chapter = n_nationkey), p AS (SELECT gathering, count(id) AS poems, coalesce(string_agg(DISTINCT author, ',' ORDER BY author) FILTER (author <> ''), '') AS authors FROM j GROUP BY ALL),
    n AS (SELECT gathering, genre, count(*) AS n FROM j WHERE genre IS NOT NULL GROUP BY ALL), g AS (SELECT gathering, string_agg(genre, ',' ORDER BY n DESC, genre) AS genres FROM n GROUP BY ALL) SELECT gathering, poems, authors, coalesce(genres, '') AS genres FROM p LEFT JOIN g USING (gathering)""")
def gatherings(spark, sf_dir):
    """What was written in the chapter of each gathering; nations stand for gatherings."""
    g = read(spark, sf_dir, "nation").select(F.col("n_name").alias("gathering"), F.col("n_nationkey").alias("chapter"))
    return verse.salon_table(g, poems(spark, sf_dir)).select("gathering", "poems", F.concat_ws(",", "authors").alias("authors"), F.concat_ws(",", "genres").alias("genres"))


@query("poets_of_lines", f"""WITH {POEMS_SQL}, {IMAGES_SQL}, p AS (SELECT * FROM poems WHERE genre <> 'riddle' AND author <> ''), a AS (SELECT author, count(*) AS poems, CAST(sum(greatest(n_lines, 1)) AS BIGINT) AS lines, avg(rhyme) AS mean_rhyme FROM p GROUP BY ALL), i AS (SELECT author, term, sum((length(text) - length(replace(text, term, ''))) // length(term)) AS n FROM p JOIN images ON contains(text, term) GROUP BY ALL),
    b AS (SELECT author, string_agg(term, ',' ORDER BY n DESC, term) AS images FROM (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, term) <= 8) GROUP BY ALL)
    SELECT author, poems, lines, round(lines / poems, 6) AS mean_lines, round(mean_rhyme, 6) AS mean_rhyme, coalesce(images, '') AS images FROM a LEFT JOIN b USING (author) ORDER BY starts_with(author, '（'), poems DESC, author LIMIT 16""")
def poets_of_lines(spark, sf_dir):
    """The poets of the lines with their imagery."""
    p = poems(spark, sf_dir)
    return verse.poet_stats(p, facts.image_facts(p, images(spark), ["id"]), ["riddle"])


@query("own_chars", """WITH c AS (SELECT lang AS author, unnest(string_split(regexp_replace(text, '[^\\p{L}]', '', 'g'), '')) AS char FROM documents WHERE source <> 'src0' AND lang <> ''), n AS (SELECT author, char, count(*) AS n FROM c WHERE char <> '' AND char NOT IN ('a', 'e', 'i', 'o', 'u') GROUP BY ALL), s AS (SELECT char FROM n GROUP BY char HAVING count(*) = 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, char) AS r FROM n), k AS (SELECT author, char, n, CAST(row_number() OVER (PARTITION BY author ORDER BY n DESC, char) AS INTEGER) AS rank FROM f SEMI JOIN s USING (char) WHERE r <= 400 AND n >= 2) SELECT author, char, n, rank FROM k WHERE rank <= 10""")
def own_chars(spark, sf_dir):
    """Letters that only one language's documents have."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("author"), F.col("source").alias("genre"), "text")
    return verse.own_chars(d, ["src0"], r"\p{L}", "aeiou")


@query("rhyme_table", f"WITH {POEMS_SQL} SELECT id, substring(text, 1, 8) AS title, genre, rhyme FROM poems WHERE rhyme > 0")
def rhyme_table(spark, sf_dir):
    return verse.rhyme_table(poems(spark, sf_dir).withColumn("title", F.substring("text", 1, 8)), ["id"])


@query("segment_shares", f"""WITH {FACTS_SQL}, {RANGES_SQL}, i AS (SELECT label AS segment, name, stream, count(*) AS n FROM facts JOIN ranges ON chapter BETWEEN lo AND hi GROUP BY ALL), t AS (SELECT segment, sum(n) AS total FROM i GROUP BY ALL), c AS (SELECT segment, stream AS label, sum(n) AS n FROM i GROUP BY ALL), k AS (SELECT segment, name AS label, sum(n) AS n FROM i GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, label) AS r FROM k), e AS (SELECT segment, 'category' AS what, label, n FROM c UNION ALL SELECT segment, 'kind', label, n FROM r WHERE r <= 3) SELECT segment, what, label, CAST(n AS BIGINT) AS n, round(n / total, 6) AS share FROM e JOIN t USING (segment)""")
def segment_shares(spark, sf_dir):
    segments = ranges(spark).withColumnRenamed("label", "segment")
    return facts.segment_shares(fact_table(spark, sf_dir), segments, "chapter", "name", "stream", 3)


@query("stances", "WITH l AS (SELECT conv_id, role, max_by(substring(text, 1, 120), turn) AS said FROM conversations GROUP BY ALL) SELECT a.conv_id, a.role, b.role AS other, b.said FROM l a JOIN l b ON a.conv_id = b.conv_id AND a.role <> b.role")
def stances(spark, sf_dir):
    return facts.stance_digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "role", "turn")


@query("taken_up", f"WITH {FACTS_SQL} SELECT name, min(chapter) FILTER (stream = 'src0') AS at, bool_or(stream = 'src1') AS taken FROM facts WHERE stream IN ('src0', 'src1') GROUP BY name HAVING min(chapter) FILTER (stream = 'src0') IS NOT NULL")
def taken_up(spark, sf_dir):
    return facts.taken_up(fact_table(spark, sf_dir), "name", "stream", "chapter", "src0", "src1")


@query("associations", f"WITH {NAMES_SQL}, h AS (SELECT DISTINCT name, item_id FROM benchmark JOIN names ON contains(text, term)), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY item_id) AS r FROM h) SELECT name, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) FILTER (r <= 10) AS objects FROM r GROUP BY name")
def associations(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return facts.associations(names(spark), items, "item_id", "text").withColumn("objects", F.concat_ws(",", F.transform("objects", lambda x: x.cast("string"))))


@query("owner_lanes", """WITH o AS (SELECT p_partkey AS object, split_part(p_name, ' ', 1) AS a, 'Supplier#' || lpad(CAST(p_partkey % 20 AS VARCHAR), 9, '0') AS b FROM part), c AS (SELECT object, 0 AS pos, a AS name FROM o UNION ALL SELECT object, 1, b FROM o WHERE a <> b), l AS (SELECT s_name AS name, max(l_orderkey) AS last FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
    SELECT object, CAST(pos AS INTEGER) AS pos, name, n_name AS fate, 'region ' || n_regionkey AS role, last FROM c LEFT JOIN (SELECT s_name AS name, n_name, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) p USING (name) LEFT JOIN l USING (name)""")
def owner_lanes(spark, sf_dir):
    part, supplier, nation, item = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier", "nation", "lineitem"))
    chain = F.concat(F.element_at(F.split("p_name", " "), 1), F.lit("→Supplier#"), F.lpad((F.col("p_partkey") % 20).cast("string"), 9, "0"), F.lit("（gift）"))
    people = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.col("n_name").alias("fate"), F.concat(F.lit("region "), "n_regionkey").alias("role"))
    last = item.groupBy("l_suppkey").agg(F.max("l_orderkey").alias("last")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("name"), "last")
    return ledgers.owner_lanes(part.select(F.col("p_partkey").alias("object"), chain.alias("owner")), people, last)


_NOTE_RATE = lambda ws: " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in ws)
_CLIMATE = f"""WITH {NOTES_SQL}, c AS ({ORACLES['climate']}), s AS (SELECT doc_id, ppl FROM ({ORACLES['spectrum']})), a AS (SELECT stream, chapter, sum({_NOTE_RATE(LEXICONS['tear'])}) * 1000.0 / greatest(sum(length(text)), 1) AS note_sad, sum({_NOTE_RATE(LEXICONS['joy'])}) * 1000.0 / greatest(sum(length(text)), 1) AS note_joy FROM notes GROUP BY ALL),
    w AS (SELECT c.*, round(coalesce(note_sad, 0), 6) AS note_sad, round(coalesce(note_joy, 0), 6) AS note_joy, coalesce(ppl, 0) AS ppl FROM c JOIN chapters USING (stream, chapter) LEFT JOIN a USING (stream, chapter) LEFT JOIN s USING (doc_id))"""
_METRICS = (*LEXICONS, "tint", "gloom", "note_sad", "note_joy", "ppl")


def full_climate(spark, sf_dir):
    """The climate curve with densities of the notes and held-out perplexity."""
    c = climate(spark, sf_dir).join(chapters(spark, sf_dir).select("stream", "chapter", "doc_id"), ["stream", "chapter"])
    rate = lambda ws: F.round(F.sum(tx.lexicon_count("text", ws)) * 1000.0 / F.greatest(F.sum(F.length("text")), F.lit(1)), 6)
    a = notes(spark, sf_dir).groupBy("stream", "chapter").agg(rate(LEXICONS["tear"]).alias("note_sad"), rate(LEXICONS["joy"]).alias("note_joy"))
    full = c.join(a, ["stream", "chapter"], "left").join(spectrum(spark, sf_dir).select("doc_id", "ppl"), "doc_id", "left")
    return full.na.fill(0.0, ["note_sad", "note_joy", "ppl"]).drop("doc_id")


@query("climate_full", f"{_CLIMATE} SELECT * FROM w")
def climate_full(spark, sf_dir):
    return full_climate(spark, sf_dir)


@query("climate_periods", f"{_CLIMATE}, {RANGES_SQL} SELECT label, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)} FROM w JOIN ranges ON chapter BETWEEN lo AND hi GROUP BY label")
def climate_periods(spark, sf_dir):
    return facts.period_means(full_climate(spark, sf_dir), ranges(spark), "chapter", _METRICS)


@query("evidence_tables", f"""WITH {POEMS_SQL}, {NAMES_SQL}, f AS (SELECT stream, chapter, name, CAST(sum((length(text) - length(replace(text, term, ''))) // length(term)) AS BIGINT) AS n FROM chapters JOIN names ON contains(text, term) GROUP BY ALL),
    h AS (SELECT DISTINCT conv_id AS topic, name, term FROM conversations JOIN names ON contains(text, term) WHERE turn = 0), u AS (SELECT topic, name, max(length(term)) AS size FROM h WHERE NOT EXISTS (SELECT 1 FROM h l WHERE l.topic = h.topic AND contains(l.term, h.term) AND length(l.term) > length(h.term)) GROUP BY ALL), who AS (SELECT topic, name FROM u QUALIFY row_number() OVER (PARTITION BY topic ORDER BY size DESC, name) <= 2),
    arcs AS (SELECT name, chapter, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY name, chapter QUALIFY row_number() OVER (PARTITION BY name ORDER BY chapter DESC) <= 12),
    co AS (SELECT a.name AS anchor, b.name AS other, CAST(sum(b.n) AS BIGINT) AS w FROM f a JOIN f b ON a.stream = b.stream AND a.chapter = b.chapter AND a.name <> b.name WHERE a.name IN (SELECT name FROM who) GROUP BY a.name, b.name QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY sum(b.n) DESC, b.name) <= 6),
    mood AS (SELECT chapter, {', '.join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {m}" for m, p in MOODS.items())} FROM blocks WHERE chapter >= 5 GROUP BY chapter), note AS (SELECT unnest(list_distinct(['E' || (seq % 3), 'E' || (length(text) % 5)])) AS edition FROM blocks WHERE length(text) BETWEEN 12 AND 39)
    SELECT topic, 'arc' AS kind, name, CAST(chapter AS VARCHAR) AS label, n FROM who JOIN arcs USING (name) UNION ALL SELECT topic, 'cooccur', name, other, w FROM who JOIN co ON anchor = name
    {' '.join(f"UNION ALL SELECT NULL, 'affect', '{m}', CAST(chapter AS VARCHAR), {m} FROM mood" for m in MOODS)}
    UNION ALL (SELECT NULL, 'omen', '', CAST(chapter AS VARCHAR), count(*) AS n FROM poems WHERE genre = 'song' GROUP BY chapter ORDER BY n DESC, chapter LIMIT 5) UNION ALL (SELECT NULL, 'edition', '', edition, count(*) AS n FROM note GROUP BY edition ORDER BY n DESC, edition LIMIT 6)""")
def evidence_tables(spark, sf_dir):
    topics = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("turn = 0").select(F.col("conv_id").alias("topic"), "text")
    f = facts.mentions(chapters(spark, sf_dir), names(spark), ["stream", "chapter"])
    affect = facts.affect_curve(blocks(spark, sf_dir), ["chapter"], MOODS)
    omens = verse.genre_chapters(poems(spark, sf_dir), ["song"], ["chapter"])
    return gates.evidence_tables(topics, f, names(spark), ["stream", "chapter"], affect, omens, facts.edition_dist(notes(spark, sf_dir)), since=5)


RELATIONS = ("father of", "mother and child", "mother and daughter", "married", "maid of", "concubine", "grandparent", "friend")
_REL = "[" + ", ".join(f"'{r}'" for r in RELATIONS) + "]"
KIN_SQL = f"""g AS (SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'f' WHEN doc_id % 3 = 1 THEN 'm' END AS gender FROM documents), e AS (SELECT 'd' || doc_id // 3 AS source, 'd' || doc_id AS target, {_REL}[doc_id % 8 + 1] AS rel FROM documents WHERE doc_id > 0),
    k AS (SELECT source, target, rel, s.gender AS gs, t.gender AS gt, CASE rel WHEN 'father of' THEN 'parent' WHEN 'mother and child' THEN 'parent' WHEN 'mother and daughter' THEN 'parent' WHEN 'married' THEN 'spouse' WHEN 'maid of' THEN 'servant' WHEN 'concubine' THEN 'concubine' WHEN 'grandparent' THEN 'ancestor' ELSE 'collateral' END AS kind FROM e LEFT JOIN g s ON s.name = source LEFT JOIN g t ON t.name = target),
    d AS (SELECT *, CASE rel WHEN 'mother and child' THEN coalesce(gs = 'f', FALSE) WHEN 'mother and daughter' THEN NOT contains(target, '7') WHEN 'concubine' THEN coalesce(gt, '') <> 'm' ELSE TRUE END AS forward FROM k),
    kin AS (SELECT CASE WHEN forward THEN source ELSE target END AS a, CASE WHEN forward THEN target ELSE source END AS b, rel, kind FROM d)"""


def kin(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    node = lambda c: F.concat(F.lit("d"), c.cast("string"))
    people = d.select(node(F.col("doc_id")).alias("name"), F.when(F.col("doc_id") % 3 == 0, "f").when(F.col("doc_id") % 3 == 1, "m").alias("gender"))
    edges = d.filter("doc_id > 0").select(node(F.floor(F.col("doc_id") / 3)).alias("source"), node(F.col("doc_id")).alias("target"), F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("doc_id") % 8 + 1).cast("int")).alias("rel"))
    kinds = {"parent": ["father of"], "spouse": ["married"], "servant": ["maid of"], "concubine": ["concubine"], "ancestor": ["grandparent"]}
    return graph.kin_edges(edges, people, kinds, {"mother and child": "f"}, {"mother and daughter": ["7"]}, "m"), people


@query("kin_edges", f"WITH {KIN_SQL} SELECT a, b, rel, kind FROM kin")
def kin_edges(spark, sf_dir):
    return kin(spark, sf_dir)[0]


@query("kin_parents", f"""WITH {KIN_SQL}, c AS (SELECT b AS child, a AS parent, rel, kind = 'ancestor' AS far FROM kin WHERE kind IN ('parent', 'ancestor')), l AS (SELECT DISTINCT child FROM c WHERE NOT far), r AS (SELECT c.*, row_number() OVER (PARTITION BY c.child ORDER BY far, l.child IS NULL, coalesce(gender, '') <> 'm', CASE parent WHEN 'd0' THEN 1 WHEN 'd1' THEN 2 ELSE 9 END, parent) AS k FROM c LEFT JOIN l ON l.child = parent LEFT JOIN g ON name = parent)
    SELECT child, parent, rel FROM r WHERE k = 1""")
def kin_parents(spark, sf_dir):
    """The parent of each person: by priority of the claims, an ancestor only where nobody else claims the person."""
    edges, people = kin(spark, sf_dir)
    return facts.top_n(graph.kin_claims(edges, people, "m", ["d0", "d1"]), ["child"], [F.col("rank"), F.col("parent")], 1, "k").select("child", "parent", "rel")


# Relations of two kinds of neighbours, so that units meet in circles and children have several claims.
CROWD_SQL = KIN_SQL.replace("e AS (SELECT", "e AS (SELECT * FROM (SELECT", 1).replace("FROM documents WHERE doc_id > 0),", f"FROM documents WHERE doc_id > 0) UNION ALL SELECT 'd' || (doc_id * 7 + 3) % 200, 'd' || doc_id, {_REL}[doc_id // 8 % 3 + 1] FROM documents),", 1)
HOUSES_SQL = f"""{CROWD_SQL}, s AS (SELECT a AS x, b AS y FROM kin WHERE kind = 'spouse' UNION SELECT b, a FROM kin WHERE kind = 'spouse'), reach(node, seen) AS (SELECT x, x FROM s UNION SELECT reach.node, s.y FROM reach JOIN s ON s.x = reach.seen),
    unit AS (SELECT node, min(seen) AS unit FROM reach GROUP BY node), c AS (SELECT DISTINCT b AS child, a AS parent, rel, kind = 'ancestor' AS far FROM kin WHERE kind IN ('parent', 'ancestor')), l AS (SELECT DISTINCT child FROM c WHERE NOT far),
    m AS (SELECT c.*, coalesce(x.unit, c.child) AS ck, coalesce(y.unit, c.parent) AS hk FROM c LEFT JOIN unit x ON x.node = c.child LEFT JOIN unit y ON y.node = c.parent),
    o AS (SELECT m.*, row_number() OVER (ORDER BY far, l.child IS NULL, coalesce(gender, '') <> 'm', CASE parent WHEN 'd0' THEN 1 WHEN 'd1' THEN 2 ELSE 9 END, parent, m.child, rel) AS i FROM m LEFT JOIN l ON l.child = parent LEFT JOIN g ON name = parent WHERE ck <> hk),
    no AS (SELECT u, row_number() OVER (ORDER BY u) AS k FROM (SELECT ck AS u FROM o UNION SELECT hk FROM o)), p AS (SELECT o.*, a.k AS c, b.k AS h FROM o JOIN no a ON a.u = ck JOIN no b ON b.u = hk),
    walk(i, root, solid) AS (SELECT CAST(0 AS BIGINT), (SELECT list(k ORDER BY k) FROM no), FALSE UNION ALL
        SELECT p.i, CASE WHEN root[c] = c AND root[h] <> c THEN list_transform(root, lambda x: CASE WHEN x = c THEN root[h] ELSE x END) ELSE root END, root[c] = c AND root[h] <> c FROM walk JOIN p ON p.i = walk.i + 1)"""


def crowd(spark, sf_dir):
    """Kin edges, people, units of spouses and claims."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    node = lambda c: F.concat(F.lit("d"), c.cast("string"))
    rel = lambda c, n: F.element_at(F.array(*map(F.lit, RELATIONS)), (c % n + 1).cast("int"))
    people = d.select(node(F.col("doc_id")).alias("name"), F.when(F.col("doc_id") % 3 == 0, "f").when(F.col("doc_id") % 3 == 1, "m").alias("gender"))
    near = d.filter("doc_id > 0").select(node(F.floor(F.col("doc_id") / 3)).alias("source"), node(F.col("doc_id")).alias("target"), rel(F.col("doc_id"), 8).alias("rel"))
    far = d.select(node((F.col("doc_id") * 7 + 3) % 200).alias("source"), node(F.col("doc_id")).alias("target"), rel(F.floor(F.col("doc_id") / 8), 3).alias("rel"))
    kinds = {"parent": ["father of"], "spouse": ["married"], "servant": ["maid of"], "concubine": ["concubine"], "ancestor": ["grandparent"]}
    edges = graph.kin_edges(near.unionByName(far), people, kinds, {"mother and child": "f"}, {"mother and daughter": ["7"]}, "m")
    return edges, people, graph.households(edges.filter("kind = 'spouse'"), "a", "b"), graph.kin_claims(edges, people, "m", ["d0", "d1"])


@query("households_tree", f"WITH RECURSIVE {HOUSES_SQL} SELECT ck AS child_unit, hk AS parent_unit, child, parent, rel, solid FROM walk JOIN o USING (i)")
def households_tree(spark, sf_dir):
    """The parent of every household; displaced claims, and those that would close a circle, are dashed."""
    _, _, units, claims = crowd(spark, sf_dir)
    return graph.households_tree(claims, units)


@query("unit_members", f"""WITH RECURSIVE {HOUSES_SQL}, t AS (SELECT DISTINCT parent FROM walk JOIN o USING (i) WHERE solid), every AS (SELECT DISTINCT child FROM c),
    r AS (SELECT unit.unit, node AS name, row_number() OVER (PARTITION BY unit.unit ORDER BY every.child IS NULL, t.parent IS NULL, coalesce(gender, '') <> 'm', length(node), node) AS k FROM unit LEFT JOIN every ON every.child = node LEFT JOIN t ON t.parent = node LEFT JOIN g ON g.name = node)
    SELECT unit, CASE WHEN k = 1 THEN 'primary' ELSE 'consort' END AS part, name FROM r UNION ALL SELECT DISTINCT unit, kind, b FROM kin JOIN unit ON node = a WHERE kind IN ('concubine', 'servant')""")
def unit_members(spark, sf_dir):
    edges, people, units, claims = crowd(spark, sf_dir)
    return graph.unit_members(units, claims, graph.households_tree(claims, units), people, edges, "m")


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def abodes(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    persons = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 9 == 0, "—").when(F.col("c_custkey") % 10 == 0, "afloat").otherwise(F.col("n_name")).alias("residence"), F.col("c_mktsegment").alias("family"))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.concat(F.col("r_name"), F.lit(" / x")).alias("belongs")).unionByName(r.select(F.col("r_name").alias("name"), F.lit("").alias("belongs")))
    families = c.groupBy(F.col("c_mktsegment").alias("name")).agg(F.lit("（ASIA）,EUROPE, none").alias("seat"))
    return graph.abode_view(persons, places, families, ["—"])


ABODE_SQL = """h AS (SELECT c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN 'afloat' ELSE n_name END AS residence, c_mktsegment AS family FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 9 <> 0), pl AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region), n AS (SELECT residence, count(*) AS k FROM h GROUP BY residence)"""


@query("abode_nodes", f"WITH {ABODE_SQL} SELECT 'L:' || name AS node, 'place' AS kind, coalesce(k, 0) AS residents FROM pl LEFT JOIN n ON residence = name UNION ALL SELECT 'L:' || residence, 'unlisted', k FROM n WHERE residence NOT IN (SELECT name FROM pl) UNION ALL SELECT DISTINCT 'F:' || c_mktsegment, 'family', 0 FROM customer UNION ALL SELECT 'P:' || name, 'resident', 0 FROM h")
def abode_nodes(spark, sf_dir):
    return abodes(spark, sf_dir)[0]


@query("abode_links", f"""WITH {ABODE_SQL} SELECT 'L:' || n_name AS source, 'L:' || r_name AS target, 'belongs' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'F:' || f, 'L:' || r_name, 'seat' FROM (SELECT DISTINCT c_mktsegment AS f FROM customer), region WHERE r_name IN ('ASIA', 'EUROPE')
    UNION ALL SELECT 'P:' || name, 'L:' || residence, 'lives' FROM h UNION ALL SELECT 'P:' || name, 'F:' || family, 'family' FROM h""")
def abode_links(spark, sf_dir):
    return abodes(spark, sf_dir)[1]


CLUES = [("k1", "the storm", "Der thinks", "zuver"), ("k1", "the storm", "Der thinks", "thwh"), ("k2", "und", "", "nicht"), ("k3", "nobody", "", "quxz")]


def fates(spark, sf_dir):
    persons = spark.createDataFrame([("the", "first", ""), ("Der", "—", "gone"), ("und", "", None), ("La", None, "well")], "name string, registry string, fate string")
    docs, talk = read(spark, sf_dir, "documents"), read(spark, sf_dir, "conversations")
    poems = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("genre"), (F.col("doc_id") % 100).alias("chapter"), F.substring("text", 1, 12).alias("title"), "text")
    clues = spark.createDataFrame(sorted({c[:3] for c in CLUES}), "id string, clue string, meaning string")
    keys = spark.createDataFrame([(c[0], c[3]) for c in CLUES], "id string, term string")
    plan = talk.select((F.col("conv_id") * 10 + F.col("turn")).alias("chapter"), F.col("role").alias("title"), F.col("text").alias("brief"))
    return graph.fate_view(persons, poems, ["de", "fr"], 80, clues, keys, plan, docs.select(F.col("doc_id").alias("chapter"), "text"))


@query("fate_links", f"""WITH p(name, fated) AS (VALUES ('the', TRUE), ('Der', TRUE), ('und', FALSE), ('La', TRUE)), c(id, clue, meaning, term) AS (VALUES {", ".join(map(repr, CLUES))}),
    l AS (SELECT 'J:' || doc_id AS source, 'P:' || name AS target, 'poem' AS kind FROM documents JOIN p ON contains(substring(text, 1, 12) || chr(10) || text, name) WHERE lang IN ('de', 'fr') AND doc_id % 100 <= 80 AND fated
    UNION SELECT 'K:' || id, 'P:' || name, 'about' FROM c JOIN p ON contains(clue || chr(10) || meaning, name) WHERE fated UNION SELECT 'K:' || id, 'C:' || (conv_id * 10 + turn), 'planned' FROM c JOIN conversations ON contains(role || text, term)
    UNION SELECT 'K:' || id, 'W:' || doc_id, 'landed' FROM c JOIN documents ON contains(substring(text, 1, 4000), term)) SELECT * FROM l""")
def fate_links(spark, sf_dir):
    """Poems, clues, planned and written chapters linked to persons with a fate."""
    return fates(spark, sf_dir)[1]


@query("timeline_links", """WITH c AS (SELECT DISTINCT doc_id AS chapter FROM documents WHERE text <> ''), e AS (SELECT item_id AS name, item_id * 7 AS chapter FROM benchmark), p AS (SELECT DISTINCT source AS name FROM documents)
    SELECT 'C:' || chapter AS source, 'C:' || lead(chapter) OVER (ORDER BY chapter) AS target, 'next' AS kind FROM c QUALIFY lead(chapter) OVER (ORDER BY chapter) IS NOT NULL UNION ALL SELECT 'E:' || name, 'C:' || chapter, 'in' FROM e SEMI JOIN c USING (chapter)
    UNION ALL SELECT DISTINCT 'E:' || e.name, 'P:' || p.name, 'actor' FROM e JOIN p ON p.name IN ('src' || e.name, 'src' || (e.name + 1))""")
def timeline_links(spark, sf_dir):
    docs, bench = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    events = bench.select(F.col("item_id").alias("name"), (F.col("item_id") * 7).alias("chapter"), F.array(F.concat(F.lit("src"), F.col("item_id").cast("string")), F.concat(F.lit("src"), (F.col("item_id") + 1).cast("string"))).alias("actors"))
    return graph.timeline_view(docs.filter("text <> ''").select(F.col("doc_id").alias("chapter")), events, docs.select(F.col("source").alias("name")).distinct())[1]


@query("residents_listed", "WITH h AS (SELECT n_name AS residence, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey), r AS (SELECT residence, count(*) OVER (PARTITION BY residence) AS n, CAST(row_number() OVER (PARTITION BY residence ORDER BY name) AS INTEGER) AS rank, name FROM h) SELECT * FROM r WHERE rank <= 10")
def residents_listed(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return graph.residents(c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "n_name", 10)
