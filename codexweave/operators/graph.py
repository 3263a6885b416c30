"""Relation graphs: degrees, components, kinship trees, reachability, node and link views."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import classify
from .facts import prune_edges, term_hits
from .ordered import top_n
from .store import checkpoint, hot_keys, spread_join


def degree(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, degree by both ends."""
    ends = edges.select(F.explode(F.array(a, b)).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def neighbours(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, other, n: each pair of linked nodes from both sides, with the number of links between them."""
    ends = F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other")))
    return links.select(F.explode(ends).alias("x")).groupBy("x.node", "x.other").agg(F.count("*").alias("n"))


def relation_graph(edges: DataFrame, weights: DataFrame, kinds: Sequence[tuple[str, str]], default: str, labelled: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, degree, n_neighbours, weight, labelled), links (source, target, rel, kind) and neighbours (node, other, n).

    A node is labelled from that weight on.  Neighbours are rows: a hub's are never brought together, only counted.
    """
    links = edges.select("source", "target", "rel", classify("rel", kinds, default).alias("kind"))
    near = neighbours(links, "source", "target")
    nodes = near.groupBy("node").agg(F.sum("n").cast("long").alias("degree"), F.count("*").alias("n_neighbours")).join(weights.select("node", "weight"), "node", "left")
    return nodes.select("node", "degree", "n_neighbours", F.coalesce("weight", F.lit(0)).alias("weight"), (F.coalesce("weight", F.lit(0)) >= labelled).alias("labelled")), links, near


def households(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, unit: connected components; the unit is named by its least node.  Labels spread and jump until none changes.

    Nodes with very many neighbours, and units of very many nodes, are dealt to several tasks.
    """
    both = checkpoint(neighbours(links, a, b).select(F.col("node").alias("x"), F.col("other").alias("y")))
    first = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("unit"), F.count("*").alias("n"))
    labels = checkpoint(first)
    ends = labels.agg(F.sum("n")).first()[0] or 0
    hubs = hot_keys(labels.select(F.col("node").alias("y"), "n"), "y", ends)
    labels = labels.select("node", "unit")
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("y"), "unit"), "y", hubs).groupBy(F.col("x").alias("node")).agg(F.min("unit").alias("near"))
        spread = checkpoint(labels.join(near, "node").select("node", F.col("unit").alias("old"), F.least("unit", "near").alias("unit")))
        jump = labels.select(F.col("node").alias("unit"), F.col("unit").alias("next"))
        large = hot_keys(spread.groupBy("unit").agg(F.count("*").alias("n")), "unit", ends)
        new = checkpoint(spread_join(spread, jump, "unit", large).select("node", "old", F.least("unit", "next").alias("unit")))
        if new.filter("unit <> old").isEmpty():
            return new.select("node", "unit")
        labels = new.select("node", "unit")


def kin_edges(edges: DataFrame, people: DataFrame, kinds: Mapping[str, Sequence[str]], by_gender: Mapping[str, str], by_mark: Mapping[str, Sequence[str]], male: str) -> DataFrame:
    """a, b, rel, kind of every relation (source, target, rel): kind 'parent' (a is the parent), 'concubine' (a is the master), or that of `kinds`.

    `kinds` maps a kind (such as parent, spouse, servant, ancestor, concubine) to its relations; what is named nowhere is collateral.  Relations of
    `by_gender` hold between parent and child without saying which is which: the source is the parent if it has the gender given.  In those of
    `by_mark` the target is the parent if its name holds one of the marks.  A male target of a concubine relation is the master.
    """
    gender = people.select(F.col("name").alias("__n"), F.coalesce("gender", F.lit("")).alias("__g"))
    e = edges.select("source", "target", "rel")
    for end in ("source", "target"):
        e = e.join(gender.select(F.col("__n").alias(end), F.col("__g").alias(f"__{end}")), end, "left")
    kind, forward = F.lit("collateral"), F.lit(True)
    for k, rels in kinds.items():
        kind = F.when(F.col("rel").isin(list(rels)), F.lit(k)).otherwise(kind)
    for rel, g in by_gender.items():
        kind = F.when(F.col("rel") == rel, F.lit("parent")).otherwise(kind)
        forward = F.when(F.col("rel") == rel, F.coalesce(F.col("__source") == g, F.lit(False))).otherwise(forward)
    for rel, marks in by_mark.items():
        kind = F.when(F.col("rel") == rel, F.lit("parent")).otherwise(kind)
        forward = F.when(F.col("rel") == rel, ~F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(F.col("target"), m))).otherwise(forward)
    forward = F.when(kind == "concubine", F.coalesce(F.col("__target") != male, F.lit(True))).otherwise(forward)
    return e.select(F.when(forward, F.col("source")).otherwise(F.col("target")).alias("a"), F.when(forward, F.col("target")).otherwise(F.col("source")).alias("b"), "rel", kind.alias("kind"))


def kin_claims(kin: DataFrame, people: DataFrame, male: str, roots: Sequence[str] = ()) -> DataFrame:
    """child, parent, rel, rank: claims for kinship_tree in order of rank: parents who have parents themselves, men, the order of `roots`; ancestors only
    where nobody else claims the child."""
    parents = kin.filter(F.col("kind").isin("parent", "ancestor")).select(F.col("b").alias("child"), F.col("a").alias("parent"), "rel", (F.col("kind") == "ancestor").alias("__far"))
    lineage = parents.filter(~F.col("__far")).select(F.col("child").alias("parent")).distinct().withColumn("__in", F.lit(True))
    known = people.select(F.col("name").alias("parent"), (F.coalesce("gender", F.lit("")) == male).alias("__male"))
    place = F.array_position(F.array(*map(F.lit, roots)), F.col("parent")) if roots else F.lit(0)
    ranked = parents.join(lineage, "parent", "left").join(known, "parent", "left")
    rank = F.struct("__far", F.col("__in").isNull().alias("outside"), (~F.coalesce("__male", F.lit(False))).alias("not_male"), F.when(place > 0, place).otherwise(F.lit(1 << 30)).alias("place"))
    return ranked.select("child", "parent", "rel", rank.alias("rank"))


def kinship_tree(claims: DataFrame, priority: Sequence[Column]) -> DataFrame:
    """child, parent, solid: of the claims (child, parent, ...) on a child the first by priority is its parent; the others, and claims that would
    close a cycle (of each cycle that of its least node), stay as dashed edges.  Parents are followed upwards, doubling the distance each round."""
    kept = claims.filter("child <> parent")
    best = top_n(kept, ["child"], [*priority, F.col("parent")], 1).select("child", F.col("parent").alias("__best"))
    ranked = kept.select("child", "parent").distinct().join(best, "child").withColumn("first", F.col("parent") == F.col("__best"))
    chosen = checkpoint(ranked.filter("first").select("child", "parent"))
    up = chosen.select(F.col("child").alias("node"), F.col("parent").alias("top"), F.col("child").alias("least")).withColumn("moved", F.lit(True))
    for _ in range(chosen.count().bit_length() + 1):
        step = up.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("least").alias("below"))
        up = checkpoint(up.join(step, "top", "left").select("node", F.coalesce("next", "top").alias("top"), F.least("least", F.coalesce("below", "least")).alias("least"), F.col("next").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            break
    # After more steps than there are nodes, whoever still moves is led into a cycle, and the places reached are the cycles' nodes.
    on_cycle = up.filter("moved").select(F.col("top").alias("node")).distinct()
    opened = up.join(on_cycle, "node", "left_semi").filter("least = node").select(F.col("node").alias("child"), F.lit(True).alias("opened"))
    return ranked.join(opened, "child", "left").select("child", "parent", (F.col("first") & F.col("opened").isNull()).alias("solid"))


def households_tree(claims: DataFrame, units: DataFrame, family: int = 100_000) -> DataFrame:
    """child_unit, parent_unit, child, parent, rel, solid: one parent for each unit, from claims of persons on persons.

    `claims` are (child, parent, rel, rank), `units` (node, unit); a person without a unit is one.  Claims inside a unit are none.  The rest are taken in order of
    (rank, parent, child, rel): a claim is solid if its child's unit has no parent yet and is not above the parent's unit already, else it stays dashed, and the
    child's next claim is tried.

    Units that claims do not connect have nothing to do with each other.  So families of up to `family` claims are each settled in one task, one claim
    after the other; the claims of larger ones in batches of as many, over all these families at once.
    """
    unit_of = lambda c, name: units.select(F.col("node").alias(c), F.col("unit").alias(name))
    met = claims.select("child", "parent", "rel", "rank").dropDuplicates(["child", "parent", "rel"]).join(unit_of("child", "ck"), "child", "left").join(unit_of("parent", "hk"), "parent", "left")
    met = met.withColumns({"ck": F.coalesce("ck", "child"), "hk": F.coalesce("hk", "parent")}).filter("ck <> hk")
    every = checkpoint(met.withColumn("at", F.struct("rank", "parent", "child", "rel")))
    if every.isEmpty():
        return every.select(F.col("ck").alias("child_unit"), F.col("hk").alias("parent_unit"), "child", "parent", "rel", F.lit(True).alias("solid"))
    label = households(every, "ck", "hk").select(F.col("node").alias("ck"), F.col("unit").alias("family"))
    labelled = checkpoint(every.join(label, "ck"))
    large = checkpoint(labelled.groupBy("family").agg(F.count("*").alias("n")).filter(F.col("n") > family).select("family"))
    taken = _in_families(labelled.join(large, "family", "left_anti"))
    if not large.isEmpty():
        taken = taken.unionByName(_in_batches(labelled.join(large, "family", "left_semi").select("ck", "hk", "at"), family))
    solid = taken.withColumn("solid", F.lit(True))
    return every.join(solid, ["ck", "at"], "left").select(F.col("ck").alias("child_unit"), F.col("hk").alias("parent_unit"), "child", "parent", "rel", F.coalesce("solid", F.lit(False)).alias("solid"))


def _settle(claims: Iterable[tuple[Hashable, Hashable, int]]) -> tuple[dict, list[tuple]]:
    """Claims (unit, claimed unit, number) one after the other: a unit above each that has a parent, and (unit, number) of the claims taken."""
    above: dict = {}
    taken = []
    for ck, hk, no in claims:
        top, way = hk, []
        while top in above:
            way.append(top)
            top = above[top]
        for x in way:  # the way up is kept short; solid edges are those in `taken`
            above[x] = top
        if ck not in above and top != ck:
            above[ck] = top
            taken.append((ck, no))
    return above, taken


def _in_families(labelled: DataFrame) -> DataFrame:
    """(ck, at) of the claims that are taken, of families small enough for a task each."""
    kind = labelled.schema["ck"].dataType.simpleString()
    ordered = labelled.withColumn("no", F.row_number().over(Window.partitionBy("family").orderBy("at")))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        _, taken = _settle(rows.sort_values("no")[["ck", "hk", "no"]].itertuples(index=False))
        return pd.DataFrame([(rows["family"].iat[0], no) for _, no in taken], columns=["family", "no"])

    chosen = ordered.select("family", "ck", "hk", "no").groupBy("family").applyInPandas(settle, f"family {kind}, no int")
    return ordered.join(chosen, ["family", "no"]).select("ck", "at")


def _in_order(claims: DataFrame, by: str, name: str) -> DataFrame:
    """claims with their places by the column `by`, from 0, written down.  Ranges are sorted each for itself; only their sizes pass through the driver."""
    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = checkpoint(claims.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("__id", F.monotonically_increasing_id()))
    part, before, start = F.shiftright("__id", 33), 0, []
    for p, n in sorted(map(tuple, ranges.groupBy(part).count().collect())):
        start += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += n
    return ranges.withColumn(name, F.create_map(*start)[part] + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


def _in_batches(claims: DataFrame, batch: int) -> DataFrame:
    """(ck, at) of the claims (ck, hk, at) that are taken, up to `batch` of them at a time in the order of `at`.

    The first claims are settled in one task, one after the other.  Then the rest follow: claims of units that have a parent now are gone, a claimed unit
    gives way to the one at the top of its tree, where a unit that meets itself is refused.  Of a unit's claims on one top only the first stays: where it is
    not taken, the unit has a parent or is that top's top itself, which holds for the later ones too.
    """
    numbered = _in_order(claims, "at", "no")
    kind = claims.schema["ck"].dataType.simpleString()
    left = numbered.select("ck", "hk", "no")
    n = left.count()
    width = max(1, min(batch, max(batch // 16, n // 4096)))
    chosen, bound = None, 0

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        above, taken = _settle(rows.sort_values("no")[["ck", "hk", "no"]].itertuples(index=False))
        for unit in above:
            top, way = unit, []
            while top in above:
                way.append(top)
                top = above[top]
            for x in way[:-1]:
                above[x] = top
        return pd.DataFrame([(ck, above[ck], no) for ck, no in taken], columns=["unit", "top", "no"])

    while True:
        here = 0
        for k, size in sorted(map(tuple, left.groupBy(F.floor(F.col("no") / width)).count().collect())):
            if here and here + size > batch:
                break
            here, bound = here + size, (k + 1) * width
        if not here:
            return numbered.join(chosen, "no").select("ck", "at")
        first = left.filter(F.col("no") < bound).groupBy(F.floor(F.col("no") / bound)).applyInPandas(settle, f"unit {kind}, top {kind}, no long")
        done = F.broadcast(checkpoint(first))
        chosen = done.select("no") if chosen is None else chosen.unionByName(done.select("no"))
        rest = left.filter(F.col("no") >= bound).join(done.select(F.col("unit").alias("ck")), "ck", "left_anti")
        raised = rest.join(done.select(F.col("unit").alias("hk"), "top"), "hk", "left").select("ck", F.coalesce("top", "hk").alias("hk"), "no")
        left = checkpoint(raised.filter("ck <> hk").groupBy("ck", "hk").agg(F.min("no").alias("no")))


def unit_members(units: DataFrame, claims: DataFrame, tree: DataFrame, people: DataFrame, kin: DataFrame, male: str, attached: Sequence[str] = ("concubine", "servant")) -> DataFrame:
    """unit, part, name: members of each unit, as rows: one 'primary', the others 'consort'; and who is attached to a member, by kind.

    Primary is who has a claim of a parent, is the head of a solid edge, is male, has the shortest name; of equals the first by name.
    """
    member = units.select("unit", F.col("node").alias("name"))
    of = lambda df, c, flag: df.select(F.col(c).alias("name")).distinct().withColumn(flag, F.lit(True))
    known = member.join(of(claims, "child", "has"), "name", "left").join(of(tree.filter("solid"), "parent", "head"), "name", "left").join(people.select("name", "gender"), "name", "left")
    flags = [F.coalesce("has", F.lit(False)), F.coalesce("head", F.lit(False)), F.coalesce(F.col("gender") == male, F.lit(False))]
    key = F.struct(*[(~f).alias(f"f{i}") for i, f in enumerate(flags)], F.length("name").alias("size"), "name")
    first = known.groupBy("unit").agg(F.min(key).alias("k")).select("unit", F.col("k.name").alias("name"), F.lit(True).alias("first"))
    own = member.join(first, ["unit", "name"], "left").select("unit", F.when(F.col("first"), "primary").otherwise("consort").alias("part"), "name")
    others = kin.filter(F.col("kind").isin(list(attached))).select(F.col("a").alias("node"), F.col("kind").alias("part"), F.col("b").alias("name")).distinct()
    return own.unionByName(others.join(units, "node").select("unit", "part", "name").distinct())


def subtree(edges: DataFrame, roots: DataFrame, parent: str, child: str, merge: int = 16) -> DataFrame:
    """root, node, depth: everything below each root; a node counts once, at its least depth.

    Each level is written once, and what is new is told by the levels written so far; every `merge` levels these are made one table.
    """
    frontier = checkpoint(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")))
    whole, levels = frontier, 1
    while True:
        down = frontier.join(edges.select(F.col(parent).alias("node"), F.col(child).alias("next")), "node").select("root", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = checkpoint(down.join(whole.select("root", "node"), ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            return whole
        whole, levels = whole.unionByName(frontier), levels + 1
        if levels % merge == 0:
            whole = checkpoint(whole)


def roots(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Nodes that have children and no parent."""
    return edges.select(F.col(parent).alias("root")).distinct().join(edges.select(F.col(child).alias("root")), "root", "left_anti")


def graph_view(nodes: Mapping[str, DataFrame], links: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Node table (node, kind) and link table (source, target, kind) from one table per kind; links whose ends are unknown or equal drop."""
    n = None
    for kind, df in nodes.items():
        part = df.select("node", F.lit(kind).alias("kind"))
        n = part if n is None else n.unionByName(part)
    e = None
    for kind, df in links.items():
        part = df.select("source", "target", F.lit(kind).alias("kind"))
        e = part if e is None else e.unionByName(part)
    n = n.dropDuplicates(["node"])
    return n, prune_edges(n, e, "node", "source", "target")


def residents(persons: DataFrame, name: str, residence: str, k: int, nowhere: Sequence[str] = ()) -> DataFrame:
    """residence, n, rank, name: how many persons live in each place, and the first k of them by name, as rows.  Null, empty and `nowhere` are no places."""
    known = persons.select(F.col(residence).alias("residence"), F.col(name).alias("name")).filter(F.col("residence").isNotNull() & ~F.col("residence").isin("", *nowhere))
    n = known.groupBy("residence").agg(F.count("*").alias("n"))
    return top_n(known, ["residence"], [F.col("name")], k).join(n, "residence").select("residence", "n", "rank", "name")


def _key(kind: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))


def abode_view(persons: DataFrame, places: DataFrame, families: DataFrame, nowhere: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Families, places and residents as nodes (node, kind, residents) and links (source, target, kind).

    persons are (name, residence, family), places (name, belongs), families (name, seat).  A residence that is no known place becomes one of kind 'unlisted'.  A place
    belongs to a place or family of the first name in `belongs` (parted by /), a family has its seats in the places named in `seat` (parted by commas).
    """
    home = persons.filter(F.col("residence").isNotNull() & ~F.col("residence").isin("", *nowhere)).select("name", "residence", "family")
    count = home.groupBy("residence").agg(F.count("*").alias("residents"))
    known = places.select("name").join(count, F.col("name") == F.col("residence"), "left").select(_key("L", "name").alias("node"), F.lit("place").alias("kind"), F.coalesce("residents", F.lit(0)).alias("residents"))
    other = count.join(places.select(F.col("name").alias("residence")), "residence", "left_anti").select(_key("L", "residence").alias("node"), F.lit("unlisted").alias("kind"), "residents")
    rest = families.select(_key("F", "name").alias("node"), F.lit("family").alias("kind")).unionByName(home.select(_key("P", "name").alias("node"), F.lit("resident").alias("kind"))).withColumn("residents", F.lit(0).cast("long"))
    nodes = known.unionByName(other).unionByName(rest).dropDuplicates(["node"])
    owner = F.trim(F.split("belongs", "/")[0])
    belongs = places.filter(F.coalesce(F.col("belongs"), F.lit("")) != "").select("name", owner.alias("owner"))
    in_place = belongs.join(places.select(F.col("name").alias("owner")).distinct(), "owner").select(_key("L", "name").alias("source"), _key("L", "owner").alias("target"))
    in_family = belongs.join(places.select(F.col("name").alias("owner")), "owner", "left_anti").join(families.select(F.col("name").alias("owner")).distinct(), "owner").select(_key("L", "name").alias("source"), _key("F", "owner").alias("target"))
    seat = families.select("name", F.explode(F.split("seat", "[,，、]")).alias("s")).withColumn("s", F.regexp_replace(F.trim("s"), "^[（()）]+|[（()）]+$", ""))
    seats = seat.join(places.select(F.col("name").alias("s")).distinct(), "s").select(_key("F", "name").alias("source"), _key("L", "s").alias("target"))
    lives = home.select(_key("P", "name").alias("source"), _key("L", "residence").alias("target"))
    kin = home.join(families.select(F.col("name").alias("family")).distinct(), "family").select(_key("P", "name").alias("source"), _key("F", "family").alias("target"))
    return nodes, _tagged({"belongs": in_place.unionByName(in_family), "seat": seats, "lives": lives, "family": kin})


def fate_view(persons: DataFrame, poems: DataFrame, genres: Sequence[str], until: int, clues: DataFrame, clue_keys: DataFrame, plan: DataFrame, landed: DataFrame, head: int = 4000) -> tuple[DataFrame, DataFrame]:
    """Persons with a fate, poems about them, lost clues, planned and written chapters as nodes (node, kind) and links (source, target, kind).

    persons are (name, registry, fate), poems (id, genre, chapter, title, text), clues (id, clue, meaning), clue_keys (id, term), plan (chapter, title, brief) and
    landed (chapter, text).  A poem of one of `genres` up to chapter `until` links to the persons it names; a clue to the persons it names, to the planned chapters whose title
    or brief holds one of its terms, and to the written chapters that hold one in their first `head` characters.
    """
    fated = persons.filter((~F.coalesce("registry", F.lit("")).isin("", "—")) | (~F.coalesce("fate", F.lit("")).isin("", "—"))).select("name")
    verses = poems.filter(F.col("genre").isin(list(genres)) & (F.col("chapter") <= until))
    named = term_hits(verses.select("id", F.concat_ws("\n", "title", "text").alias("text")), persons.select("name"), term="name", keep=["id"])
    said = term_hits(clues.select("id", F.concat_ws("\n", "clue", "meaning").alias("text")), persons.select("name"), term="name", keep=["id"])
    planned = term_hits(plan.select("chapter", F.concat("title", "brief").alias("text")), clue_keys, keep=["chapter"])
    written = term_hits(landed.select("chapter", F.substring("text", 1, head).alias("text")), clue_keys, keep=["chapter"])
    link = lambda df, a, ka, b, kb: df.select(_key(ka, a).alias("source"), _key(kb, b).alias("target"))
    links = {"poem": link(named, "id", "J", "name", "P"), "about": link(said, "id", "K", "name", "P"), "planned": link(planned, "id", "K", "chapter", "C"), "landed": link(written, "id", "K", "chapter", "W")}
    nodes = {"person": fated.select(_key("P", "name").alias("node")), "poem": verses.select(_key("J", "id").alias("node")), "clue": clues.select(_key("K", "id").alias("node")), "plan": plan.select(_key("C", "chapter").alias("node")), "written": landed.select(_key("W", "chapter").alias("node"))}
    return graph_view(nodes, {k: v.distinct() for k, v in links.items()})


def timeline_view(chapters: DataFrame, key_events: DataFrame, persons: DataFrame, block: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """Chapters in order, key events and their actors as nodes and links: 'next' to the following chapter there is, 'in' from an event to its chapter, 'actor'
    to each known person.  chapters are (chapter), key_events (name, chapter, actors), persons (name).  Chapters are
    put in order block by block; only one row of each block is ordered as a whole."""
    one = chapters.select("chapter").distinct().withColumn("__b", F.floor(F.col("chapter") / block))
    step = one.withColumn("next", F.lead("chapter").over(Window.partitionBy("__b").orderBy("chapter")))
    ahead = one.groupBy("__b").agg(F.min("chapter").alias("__first")).select("__b", F.lead("__first").over(Window.orderBy("__b")).alias("__first"))  # a row for each block
    order = step.join(ahead, "__b").select("chapter", F.coalesce("next", "__first").alias("next")).filter("next is not null")
    nodes = {"chapter": chapters.select(_key("C", "chapter").alias("node")).distinct(), "event": key_events.select(_key("E", "name").alias("node")), "person": persons.select(_key("P", "name").alias("node"))}
    acts = key_events.select("name", F.explode("actors").alias("who"))
    links = {"next": order.select(_key("C", "chapter").alias("source"), _key("C", "next").alias("target")), "in": key_events.select(_key("E", "name").alias("source"), _key("C", "chapter").alias("target")), "actor": acts.select(_key("E", "name").alias("source"), _key("P", "who").alias("target")).distinct()}
    return graph_view(nodes, links)


def _tagged(links: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for kind, df in links.items():
        part = df.select("source", "target", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out
