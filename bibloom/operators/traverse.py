"""Budgeted citation traversal from many seeds at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions.storage import cut, forget, written

FORWARD_SHARE = 0.35


def _itself() -> Column:
    """The seed as a paper; an alias of a grouping column breaks the checkpoint of a union in Spark 4.1."""
    return F.explode(F.array("seed_id")).alias("paper_id")


def id_class(raw: Column) -> Column:
    """Order in which identifiers are resolved: work ids, then DOIs, then others."""
    return F.when(raw.rlike("^[Ww][0-9]+$"), 0).when(raw.rlike("^10\\.[0-9]"), 1).otherwise(2)


def _steps(edges: DataFrame, aliases: DataFrame | None) -> dict[str, DataFrame]:
    """Edges to walk along, (at, next, seq) a direction; with aliases, ends are their papers and seq begins with the class of the next one's id."""
    ends = {"backward": ("source", "target"), "forward": ("target", "source")}
    if aliases is None:
        return {way: edges.select(F.col(a).alias("at"), F.col(b).alias("next"), "seq") for way, (a, b) in ends.items()}
    end = lambda c: aliases.select(F.col("alias").alias(c), F.col("paper_id").alias(f"{c}_paper"))
    held = cut(edges.join(end("source"), "source").join(end("target"), "target").filter("source_paper <> target_paper"))
    return {way: held.select(F.col(f"{a}_paper").alias("at"), F.col(f"{b}_paper").alias("next"), F.struct(id_class(F.col(b)).alias("class"), "seq").alias("seq")) for way, (a, b) in ends.items()}


def traverse(seeds: DataFrame, edges: DataFrame, backward: int = 2, forward: int = 1, max_papers: int = 100, aliases: DataFrame | None = None) -> DataFrame:
    """(seed_id, paper_id, direction, depth, place): papers in the order in which each seed's walk reaches them.

    seeds: seed_id; edges: source, target, seq. Levels go backward (to cited papers) and
    forward (to citing ones) in turn. Forward may spend int(0.35 * (max_papers - 1)) papers,
    backward the rest; what a finished direction leaves goes to the other. Within a level,
    neighbours come by the smallest seq of their edges, then by id. With aliases (alias,
    paper_id; an alias once) both ends are resolved first: records of one paper spend its
    budget once, ids that nothing resolves spend none, and work ids come before DOIs and others.
    """
    budget = max(max_papers - 1, 0)
    share = {"backward": budget if forward <= 0 else 0 if backward <= 0 else budget - int(budget * FORWARD_SHARE)}
    share["forward"] = budget - share["backward"]
    depths = {"backward": backward, "forward": forward}
    step = _steps(edges, aliases)
    # tables, whose size joins know: a small frontier is sent to the edges, which stay where they are
    known = written(seeds.select("seed_id").distinct().select("seed_id", _itself(), F.lit("seed").alias("direction"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place")))
    for depth in range(max(backward, forward)):
        for way, other in (("backward", "forward"), ("forward", "backward")):
            if depth >= depths[way]:
                continue
            at = lambda w, d: known.filter((F.col("direction") == w) & (F.col("depth") == d)) if d else known.filter("depth = 0")
            frontier = at(way, depth)
            spent = known.groupBy("seed_id").agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col("direction") == way).alias("own"))
            # the other direction still runs where it has a frontier and levels left
            ahead = at(other, depth + 1 if other == "backward" else depth).select("seed_id").distinct().withColumn("waits", F.lit(True))
            if depth >= depths[other]:
                ahead = ahead.limit(0)
            left = spent.join(ahead, "seed_id", "left")
            room = F.when(F.col("waits"), F.least(F.lit(share[way]) - F.col("own"), F.lit(max_papers) - F.col("held"))).otherwise(F.lit(max_papers) - F.col("held"))
            left = left.select("seed_id", "held", room.alias("room"))
            near = frontier.select("seed_id", F.col("paper_id").alias("at")).join(step[way], "at").groupBy("seed_id", F.col("next").alias("paper_id")).agg(F.min("seq").alias("seq"))
            fresh = near.join(known.select("seed_id", "paper_id"), ["seed_id", "paper_id"], "left_anti").join(left, "seed_id")
            order = Window.partitionBy("seed_id").orderBy("seq", "paper_id")
            # the constant lets every task keep max_papers rows a seed at most before rows meet; the seed's own room then cuts exactly
            fresh = fresh.withColumn("r", F.row_number().over(order)).filter((F.col("r") <= max_papers) & (F.col("r") <= F.col("room")))
            fresh = fresh.select("seed_id", "paper_id", F.lit(way).alias("direction"), F.lit(depth + 1).alias("depth"), (F.col("held") + F.col("r") - 1).alias("place"))
            before, known = known, written(known.unionByName(fresh))
            forget(before)
    return known


def components(edges: DataFrame) -> DataFrame:
    """A table (paper_id, component) of all ends of edges (source, target): the smallest id that each is connected with.

    Contraction, each link held once: every root hangs on the neighbour that comes first in a hashed order if that comes before itself,
    pointers jump until they reach a root, and edges between roots remain. The hashed order keeps chains short, so
    a third of a chain's roots is left after a round, whatever its ids.
    """
    ordered = lambda df: df.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    ends = lambda df: df.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    both = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    links = written(ordered(both))
    labels = written(ends(both).select("u").distinct().select(F.col("u").alias("paper_id"), F.col("u").alias("root")))
    turn = 0
    while not links.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        least = ends(links).groupBy("u").agg(F.min(order("v")).alias("first"))
        up = written(least.select(F.col("u").alias("child"), F.least(F.col("first"), order("u"))["id"].alias("parent")))
        while True:
            above = up.select(F.col("child").alias("parent"), F.col("parent").alias("beyond"))
            higher = written(up.join(above, "parent").select("child", F.col("beyond").alias("parent"), (F.col("beyond") != F.col("parent")).alias("moved")))
            forget(up)
            up = higher.select("child", "parent")
            if higher.filter("moved").isEmpty():
                break
        end = lambda c: up.select(F.col("child").alias(c), F.col("parent").alias(f"{c}_root"))  # noqa: B023, E731
        fewer = written(ordered(links.join(end("u"), "u").join(end("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))))
        moved = written(labels.join(up.select(F.col("child").alias("root"), F.col("parent").alias("top")), "root", "left").select("paper_id", F.coalesce("top", "root").alias("root")))
        forget(links, labels, up)
        links, labels, turn = fewer, moved, turn + 1
    least = labels.groupBy("root").agg(F.min("paper_id").alias("component"))
    found = written(labels.join(written(least), "root").select("paper_id", "component"))
    forget(links, labels)
    return found


def seed_component(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed_id, paper_id): everything connected with a seed, whatever the direction. As many rows as seeds times their components; see component_summary."""
    held = components(edges)
    own = _seeds_in(seeds, held)
    around = own.join(held, "component").select("seed_id", "paper_id")
    return around.unionByName(own.filter("lone").select("seed_id", F.col("component").alias("paper_id")))


def _seeds_in(seeds: DataFrame, held: DataFrame) -> DataFrame:
    """(seed_id, component, lone): lone seeds have no edge."""
    joined = seeds.select("seed_id").distinct().join(held.withColumnRenamed("paper_id", "seed_id"), "seed_id", "left")
    return joined.select("seed_id", F.coalesce("component", "seed_id").alias("component"), F.col("component").isNull().alias("lone"))


def component_summary(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed_id, n, smallest) of each seed's component, which is counted once however many seeds it has."""
    held = components(edges)
    sizes = held.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    joined = _seeds_in(seeds, held).join(sizes, "component", "left")
    return joined.select("seed_id", F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.col("component").alias("smallest"))


def commit_edges(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with both ends resolved, no self-loops, the first of each (source, target). raw: source, target, seq; aliases: alias, paper_id."""
    end = lambda c: aliases.select(F.col("alias").alias(c), F.col("paper_id").alias(f"{c}_paper_id"))
    resolved = raw.join(end("source"), "source").join(end("target"), "target").filter("source_paper_id <> target_paper_id")
    first = resolved.groupBy("source_paper_id", "target_paper_id").agg(F.min("seq").alias("seq"))
    return first.withColumn("edge_id", F.concat_ws("_", "source_paper_id", F.lit("cites"), "target_paper_id"))


def duplicate_works(papers: DataFrame, key: str = "title_key") -> DataFrame:
    """(paper_id, duplicate_of): papers whose title key a record before them has, with the first such record, unless both years are known and differ."""
    held = papers.filter(F.col(key).isNotNull())
    first = held.groupBy(key).agg(F.min_by(F.struct("paper_id", "year"), "seq").alias("first"))
    joined = held.join(first, key).filter(F.col("paper_id") != F.col("first.paper_id"))
    clash = F.coalesce(F.col("year") != F.col("first.year"), F.lit(False))
    return joined.filter(~clash).select("paper_id", F.col("first.paper_id").alias("duplicate_of"))
