"""Secret scans with corpus-wide ownership frequency, in Spark functions only.

Candidates are credential assignments, access keys and long hexadecimal strings.  Every candidate's value (less dots and
equal signs at its end) is hashed, and the hashes are counted over the whole corpus by distinct repositories and owners
(first per hash, owner and repository, then per hash, so that a hash which fills the corpus is summed before it is
shuffled).  A value that `copied_owners` owners or more, or `copied_repositories` repositories or more, hold is a widely copied
example; of the others one that mixes letters and digits and is no obvious placeholder is live-looking.

The method's own finds are of kind `bare`: runs of 8 or more of the characters that assigned values are made of, with a digit, outside all base
spans, whose hash is that of a live-looking value found as a candidate elsewhere; also the part of such a run after its last
equal sign or slash.

Defined results: null text counts as empty.  Null owner or repository counts as one more, empty, name.  Rows with equal
id and text get equal results, one row each.  Spans are in code points, end exclusive.  Columns besides the
named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import render, with_spans
from .common import checkpoint, maybe_among, measured, numbered, place, salted_join, sha256

# The base patterns (possessive where that changes nothing) and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
VALUE = "A-Za-z0-9+/_.=-"
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]++", "hex": r"[0-9a-f]{32,}+", "bare": rf"(?:\G|(?<![{VALUE}]))(?=[A-Za-z+/_.=-]*+[0-9])[{VALUE}]{{8,}}+"}
KINDS = ("assign", "access", "hex")
LEAST = 8
# What no live value holds: a placeholder's word by itself, or an obvious sequence.
PLACEHOLDERS = r"(?i)(?:^|[^a-z])(?:example|changeme|placeholder|password|your|dummy|sample)(?:[^a-z]|$)|x{4}|^0+$|12345678|abcdefgh"

BASE = "array<struct<start:int,kind_no:int,end:int,kind:string,hash:string,shape:boolean>>"
FOUND = "array<struct<start:int,kind_no:int,end:int,kind:string,verdict:string,n_owners:long,n_repositories:long>>"


def live_shape(value: Column) -> Column:
    """Letters and digits, no placeholder, not one character again and again."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDERS) & ~value.rlike(r"^(.)\1+$")


def core(value: Column) -> Column:
    return F.regexp_replace(value, "[.=]++$", "")


def _runs(s: Column) -> Column:
    """start, end and hash of a run and of its parts after the last equal sign and slash, where they look live."""
    whole = core(s["value"])
    parts = F.array_distinct(F.array(whole, F.substring_index(whole, "=", -1), F.substring_index(whole, "/", -1)))
    end = s["start"] + F.length(whole)
    good = F.filter(parts, lambda p: (F.length(p) >= LEAST) & live_shape(p))
    return F.transform(good, lambda p: F.struct((end - F.length(p)).alias("start"), end.alias("end"), sha256(p).alias("hash")))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: str, repository: Sequence[str]) -> DataFrame:
    """id, key (hash of the text), owner, repository, base (candidates by start, then kind) and bare runs, one row for each document."""
    name = lambda c: F.coalesce(place(docs, c).cast("string"), F.lit(""))
    rows = numbered(docs).select(place(docs, id_col).alias("id"), F.coalesce(place(docs, text_col), F.lit("")).alias("text"), name(owner).alias("owner"), F.array(*map(name, repository)).alias("repository"))
    found = with_spans(rows, "text", PATTERNS)

    def of_kind(no: int, kind: str, keep, value) -> Column:
        return F.transform(F.filter(F.col(kind), keep), lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), sha256(core(value(s))).alias("hash"), live_shape(core(value(s))).alias("shape")))

    second = lambda s: F.regexp_extract(s["value"], ASSIGN, 2)
    whole = lambda s: s["value"]
    base = F.array_sort(F.concat(of_kind(0, "assign", lambda s: F.length(second(s)) >= LEAST, second), of_kind(1, "access", lambda s: F.length(s["value"]) >= 16, whole), of_kind(2, "hex", lambda s: F.length(s["value"]) >= 32, whole)))
    out = found.select("id", F.xxhash64("text").alias("key"), "owner", "repository", base.cast(BASE).alias("base"), F.flatten(F.transform("bare", _runs)).alias("bare"))
    outside = F.filter("bare", lambda b: ~F.exists("base", lambda s: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn("bare", outside)


def ownership(found: DataFrame, copied_owners: int, copied_repositories: int) -> DataFrame:
    """hash, n_found, n_repositories, n_owners, verdict ('live', 'copied' or 'weak') of every candidate value."""
    each = found.filter(F.size("base") > 0).select("owner", "repository", F.explode("base").alias("s")).select("owner", "repository", "s.hash", "s.shape")
    by_repository = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"), F.max("shape").alias("shape"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"), F.max("shape").alias("shape"))
    total = by_owner.groupBy("hash").agg(F.sum("n").alias("n_found"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"), F.max("shape").alias("shape"))
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    verdict = F.when(copied, "copied").when(F.col("shape"), "live").otherwise("weak")
    return total.select("hash", "n_found", "n_repositories", "n_owners", verdict.alias("verdict"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repository: Sequence[str] = ("source",), copied_owners: int = 3, copied_repositories: int = 8) -> DataFrame:
    """id, key, base and spans (arrays of kind, start, end; spans also verdict, n_owners, n_repositories), one row for each document.

    `repository` names the columns that together tell repositories apart.
    """
    found, seen = measured(candidates(docs, id_col, text_col, owner, repository), base=F.sum(F.size("base")), bare=F.sum(F.size("bare")))
    known = checkpoint(ownership(found, copied_owners, copied_repositories))
    live, lives = measured(known.filter("verdict = 'live'").drop("n_found"), n=F.count(F.lit(1)))
    at = lambda s: [F.col(f"{s}.start").alias("start"), F.col(f"{s}.end").alias("end"), F.col(f"{s}.hash").alias("hash")]
    based = found.select("id", "key", F.explode("base").alias("s")).select("id", "key", F.col("s.kind_no").alias("kind_no"), F.col("s.kind").alias("kind"), *at("s"))
    runs = found.select("id", "key", F.explode("bare").alias("s")).select("id", "key", F.lit(len(KINDS)).alias("kind_no"), F.lit("bare").alias("kind"), *at("s"))
    bare = maybe_among(runs, "hash", live.select("hash"), lives["n"]).filter("__among").drop("__among")  # others are no live value
    # A value that fills the corpus is dealt to several tasks.
    judged = salted_join(based, known.drop("n_found"), ["hash"], seen["base"], counts=known.select("hash", F.col("n_found").alias("n")), salt=["id", "start"])
    judged = judged.unionByName(salted_join(bare, live, ["hash"], seen["bare"], salt=["id", "start"]))
    # Rows with equal id and text share a set of spans.
    per_text = judged.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "kind_no", "end", "kind", "verdict", "n_owners", "n_repositories"))).alias("spans"))
    left, right = found.select("id", "key", "base").alias("l"), per_text.alias("r")
    joined = left.join(right, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.key") == F.col("r.key")), "left")
    none = F.array().cast(FOUND)
    return joined.select(F.col("l.id").alias("id"), F.col("l.key").alias("key"), F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("base"), F.coalesce("spans", none).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 of the base spans, all spans, how many are live or copied, and the most owners and repositories of a value; one row for each of scanned."""
    of = lambda verdict: F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long")
    most = lambda field: F.coalesce(F.array_max(F.transform("spans", lambda s: s[field])), F.lit(0)).cast("long").alias(f"most_{field[2:]}")
    return scanned.select(F.col("id").alias(id_col), *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS], sha256(render(F.col("base"))).alias("base_sha256"), render(F.col("spans")).alias("spans"), of("live").alias("n_live"), of("copied").alias("n_copied"), most("n_owners"), most("n_repositories"))


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every live-looking span of the text replaced by `mask`; overlapping spans become one.

    Rows without such spans, null texts among them, stay as they are.  Only rows that may have one are shuffled.
    """
    live = F.filter("spans", lambda s: s["verdict"] == "live")
    marks, seen = measured(scanned.filter(F.size(live) > 0).select(F.col("id").alias("__id"), F.col("key").alias("__mark"), live.alias("__live")).dropDuplicates(["__id", "__mark"]), n=F.count(F.lit(1)))
    rows, text = numbered(docs), place(docs, text_col)
    flagged = maybe_among(rows.withColumn("__key", F.xxhash64(F.coalesce(text, F.lit("")))), "__key", marks.select("__mark"), seen["n"])
    joined = flagged.filter("__among").join(marks, place(docs, id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__mark")), "left")

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mask))).alias("out"))

    masked = F.aggregate("__live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    changed = joined.withColumn(rows.select(text).columns[0], F.when(F.col("__live").isNull(), text).otherwise(masked)).select(*rows.columns)
    return flagged.filter(~F.col("__among")).select(*rows.columns).unionByName(changed).toDF(*docs.columns)
