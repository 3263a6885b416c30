"""The registered queries of this subpackage, and their SQL where SQL can express them.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, language_id, lexical_search, line_dedup, merkle, near_dedup, pii, quality_rules, secrets, substring_dedup, token_counts, warc
from .common import sha256, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), owner="source", repository=("source", "lang"))
    return secrets.digests(found)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents")).drop("failed_rule")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.scan(table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = language_id.train(docs.filter(~held_out()))
    return language_id.identify(docs, content).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256(F.concat_ws(",", F.array_sort("items"))).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept")).alias("kept_sha256"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    made = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": F.translate("text", UPPER, LOWER)}, changed=changed)
    return merkle.check(made.proofs).withColumnRenamed("id", "doc_id")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 finds by the base rules alone."""
    return op5_quality_rules(spark, sf_dir).drop("kept")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 counts by the base patterns alone."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 counts by the base patterns alone."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_bpe": op7_bpe,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_lexical_search": op11_lexical_search,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
    "quality_base": quality_base,
    "pii_base": pii_base,
    "secret_base": secret_base,
}

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWERED.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""


def _written(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode({value})) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    numbers = [_written(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "n_chars")]
    return f"sha256({numbers[0]} || {_written('source')} || {_written('lang')} || {numbers[1]} || {_written(text)})"


def _levels(name: str, leaves: str) -> str:
    """Nodes of all levels over leaves (g, pos, h, n), and for each what stands left and right of it."""
    return f"""{name} AS (
            SELECT g, 0 AS lvl, pos, h, n FROM {leaves}
            UNION ALL SELECT g, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 16
        ), {name}_side AS (
            SELECT g, lvl, pos, n, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY g, lvl, pos // 16 ORDER BY pos)
        )"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
ORACLES: dict[str, str] = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS master FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND master <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND master <> page_id THEN master END AS refers_to
        FROM m
    """,
    "op2_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
        least_of AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_of USING (k) WHERE d < doc_id),
        word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op10_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_FOLDED} AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS ws FROM benchmark WHERE item_id IS NOT NULL),
        bm AS (SELECT item, ws, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0),
        bw AS (SELECT DISTINCT item, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS k FROM (SELECT item, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM bm)),
        sizes AS (SELECT DISTINCT m FROM bw),
        dw AS (SELECT doc_id, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS k FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes)),
        hit AS (SELECT doc_id, i, m, item FROM dw JOIN bw USING (m, k)),
        word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
        item AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
    """,
    "op11_lexical_search": f"""
        WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
        size AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS words FROM d WHERE len(ts) > 0),
        q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
        tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY doc_id, n, t),
        weight AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), size),
        s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
              FROM q JOIN tf USING (t) JOIN weight USING (t), size GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
    """,
    "op12_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        line AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS p FROM d),
        k AS (SELECT doc_id, p, x, {_LOWERED.format("trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM line),
        often AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (often.k IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN often USING (k) GROUP BY doc_id
    """,
    "op13_merkle_manifest": f"""
        WITH RECURSIVE base AS (
            SELECT doc_id, coalesce('=' || source, '-') AS g, {_leaf("text")} AS leaf,
                   CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_LOWERED.format("text"))} ELSE {_leaf("text")} END AS now
            FROM documents
        ), leaves AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n, doc_id, now FROM base
        ), {_levels("low", "leaves")
        }, subroots AS (SELECT g AS member, h AS subroot, 'top' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n FROM low WHERE n = 1
        ), {_levels("high", "subroots")
        }, walk AS (
            SELECT doc_id, leaf, g, 0 AS lvl, pos, '' AS proof, now AS folded FROM (SELECT doc_id, h AS leaf, g, pos, now FROM leaves)
            UNION ALL SELECT doc_id, leaf, g, lvl + 1, pos // 16, proof || l || r, sha256(l || folded || r) FROM walk JOIN low_side USING (g, lvl, pos)
        ), arrived AS (SELECT * FROM walk QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id)
        ), climb AS (
            SELECT doc_id, leaf, subroot, 0 AS lvl, s.pos, proof, folded FROM arrived a JOIN subroots s ON a.g = s.member
            UNION ALL SELECT doc_id, leaf, subroot, lvl + 1, pos // 16, proof || l || r, sha256(l || folded || r) FROM climb JOIN high_side USING (lvl, pos)
        )
        SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
               folded = (SELECT h FROM high WHERE n = 1) AS verified
        FROM climb QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id)
    """,
    "quality_base": f"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
        line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w),
        dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, x, count(*) AS n FROM line WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, x) GROUP BY doc_id),
        win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 7), ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
        inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
               CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(inside.n, 0) > 30 * len(ws) AS base_failed
        FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN inside USING (doc_id)
    """,
    "pii_base": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS (
            SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')) AS v FROM d
            UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(t, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')) FROM d
            UNION ALL SELECT doc_id, 'card', unnest(regexp_extract_all(t, '[0-9]([ -]?[0-9])+')) FROM d
            UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(t, '[+][0-9][ ().0-9-]+[0-9]')) FROM d
        ),
        g AS (SELECT doc_id, kind, v, {_DIGITS} AS digits FROM f),
        luhn AS (SELECT doc_id, kind, v, digits, sum(CASE WHEN (length(digits) - i) % 2 = 0 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END) AS s
            FROM (SELECT doc_id, kind, v, digits, r, unnest(range(1, length(digits) + 1)) AS i, CAST(unnest(string_split(digits, '')) AS INTEGER) AS x FROM (SELECT *, row_number() OVER () AS r FROM g WHERE kind = 'card' AND length(digits) BETWEEN 16 AND 19))
            GROUP BY doc_id, kind, v, digits, r),
        n AS (
            SELECT doc_id, kind FROM g WHERE kind = 'email' OR (kind = 'phone' AND length(digits) BETWEEN 8 AND 15)
                OR (kind = 'ip' AND regexp_full_match(v, '(0*([0-9]{{1,2}}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])[.]){{3}}0*([0-9]{{1,2}}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])'))
            UNION ALL SELECT doc_id, kind FROM luhn WHERE s % 10 = 0
        )
        SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone
        FROM d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
    """,
    "secret_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        a AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) AS v FROM d),
        k AS (SELECT doc_id, unnest(regexp_extract_all(t, 'AKIA[A-Z0-9]+')) AS v FROM d),
        h AS (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9a-f]+')) AS v FROM d),
        n AS (SELECT doc_id, 'assign' AS kind FROM a WHERE length(v) >= 8 UNION ALL SELECT doc_id, 'access' FROM k WHERE length(v) >= 16 UNION ALL SELECT doc_id, 'hex' FROM h WHERE length(v) >= 32)
        SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
        FROM d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
    """,
}
