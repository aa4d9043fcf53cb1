"""Citation lineage: from classified citation sites to edges, foundations, tallies and the graph between works.

A site is a row (paper, key, stance, ordinal, weight, in_corpus): weight orders sections, ordinal the sites of a paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

#: The stances from strongest to weakest.
STANCES = ("contests", "extends", "inherits", "compares", "background")
LEAN, PUSH = ("inherits", "extends"), ("contests", "compares")


def rank(stance: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STANCES)), stance)


def strongest(sites: DataFrame) -> DataFrame:
    """One row for each paper and key: the site of the strongest stance, the first of equals."""
    others = [c for c in sites.columns if c not in ("paper", "key")]
    best = F.min_by(F.struct(*others), F.struct(rank(F.col("stance")), F.col("ordinal"), *[F.col(c) for c in others if c not in ("stance", "ordinal")]))
    return sites.groupBy("paper", "key").agg(best.alias("s")).select("paper", "key", "s.*")


def foundation(edges: DataFrame) -> DataFrame:
    """The edge that each paper stands on most: of those it inherits or extends, by section weight, inherits first, works at hand first, then order."""
    order = F.struct(F.col("weight"), (F.col("stance") != "inherits").cast("int"), (~F.col("in_corpus")).cast("int"), F.col("ordinal"), F.col("key"))
    return edges.where(F.col("stance").isin(*LEAN)).groupBy("paper").agg(F.min_by(F.struct("key", "stance", "weight", "in_corpus", "ordinal"), order).alias("s")).select("paper", "s.*")


def tally(edges: DataFrame) -> DataFrame:
    """Edges of each paper by stance, and how many lead to a work at hand."""
    return edges.groupBy("paper").agg(*[F.count_if(F.col("stance") == s).alias(s) for s in STANCES], F.count_if((F.col("stance") != "background") & F.col("in_corpus")).alias("walkable"))


def foundations(edges: DataFrame, least: int = 2, top: int = 8) -> DataFrame:
    """(key, papers): works that several papers inherit or extend."""
    found = edges.where(F.col("stance").isin(*LEAN)).groupBy("key").agg(F.count_distinct("paper").alias("papers")).where(F.col("papers") >= least)
    return found.orderBy(F.desc("papers"), "key").limit(top)


def degree(edges: DataFrame, top: int = 20) -> DataFrame:
    """(node, degree) of edges (src, dst), loops left out."""
    real = edges.where("src <> dst")
    ends = real.select(F.col("src").alias("node")).union(real.select("dst"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(top)


def cross_edges(edges: DataFrame, library: DataFrame) -> DataFrame:
    """Edges (src, dst) whose ends are both in library (id), without loops."""
    return edges.where("src <> dst").join(library.select(F.col("id").alias("src")), "src", "left_semi").join(library.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def survey(sites: DataFrame, have: DataFrame) -> DataFrame:
    """Works outside have (id): papers that cite each, and edges that take a stance on it."""
    votes = sites.groupBy("key").agg(F.count_distinct("paper").alias("cited"), F.count_if(F.col("stance") != "background").alias("stanced"))
    return votes.join(have.select(F.col("id").alias("key")), "key", "left_anti")


def candidates(votes: DataFrame, top: int = 40, stanced_only: bool = False) -> DataFrame:
    """The works most worth adding: most stances, then most citations, then id."""
    pool = votes.where("stanced > 0") if stanced_only else votes
    return pool.orderBy(F.desc("stanced"), F.desc("cited"), "key").limit(top)


def paths(edges: DataFrame, start: int, hops: int = 4) -> DataFrame:
    """(node, hops, path array<long>): for what can be reached from start over undirected edges (src, dst) within so many hops the shortest path, of equal ones the least.

    A frontier of new nodes at a time, written to the shared folder, so that a hop doesn't repeat those before it.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    both = staged(both, "lineage-edges")
    start_at = F.lit(start).cast("long")
    seen = frontier = edges.sparkSession.range(1).select(start_at.alias("node"), F.lit(0).alias("hops"), F.array(start_at).alias("path"))
    for hop in range(1, hops + 1):
        nearby = frontier.join(both, F.col("node") == F.col("src")).groupBy(F.col("dst").cast("long").alias("node")).agg(F.min(F.concat("path", F.array(F.col("dst").cast("long")))).alias("path"))
        frontier = staged(nearby.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), "path"), "lineage-frontier")
        seen = seen.unionByName(frontier)
    return seen


def reachable(edges: DataFrame, start: int, hops: int = 4) -> DataFrame:
    """(node, hops): what can be reached from start within so many hops."""
    return paths(edges, start, hops).select("node", "hops")


def connect(edges: DataFrame, start: int, end: int | None = None, hops: int = 4) -> DataFrame:
    """(node, hops, path): the shortest undirected path to end, or to every node in reach, as text; of equal ones the least by number."""
    found = paths(edges, start, hops)
    found = found if end is None else found.where(F.col("node") == end)
    return found.select("node", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Works that two papers both cite, (key, stance) each, in buckets: part ways, both lean, both push, both cite."""
    def sides(df: DataFrame, name: str) -> DataFrame:
        stances = F.collect_set("stance")
        has = lambda kinds: F.arrays_overlap(stances, F.array(*map(F.lit, kinds)))
        return df.groupBy("key").agg(has(LEAN).alias(f"lean_{name}"), has(PUSH).alias(f"push_{name}"))

    both = sides(a, "a").join(sides(b, "b"), "key")
    parts = (F.col("lean_a") & F.col("push_b") & ~F.col("lean_b")) | (F.col("lean_b") & F.col("push_a") & ~F.col("lean_a"))
    bucket = F.when(parts, "part ways").when(F.col("lean_a") & F.col("lean_b"), "both stand on").when(F.col("push_a") & F.col("push_b"), "both push").otherwise("both cite")
    return both.select("key", bucket.alias("bucket"))


def resolve_references(edges: DataFrame, references: DataFrame, titles: DataFrame) -> DataFrame:
    """Edges (paper, key) with the work each stands for: the reference's own id, else that of the folded title; without either, null."""
    named = edges.join(references, ["paper", "key"], "left").join(titles, "folded", "left")
    return named.withColumn("work", F.coalesce("own_id", "title_id"))


def by_cue(rows: DataFrame, cue: str = "cue") -> DataFrame:
    """(cue, n): readings by their cue, case folded, the largest group first."""
    return rows.groupBy(F.lower(F.trim(cue)).alias("cue")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cue")


def stance_share(edges: DataFrame) -> DataFrame:
    """(stance, n, percent): rounded to whole percents."""
    counts = edges.groupBy("stance").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))) + 0.5).cast("long"))


def contested(rows: DataFrame) -> DataFrame:
    """(paper, text, targets): contesting sentences, each with its targets in order."""
    pushed = rows.where("stance = 'contests'").groupBy("paper", "text").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "key"))), lambda x: x["key"])).alias("targets"))
    return pushed.withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ","))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def dense_grid(cells: DataFrame, columns: int) -> DataFrame:
    """(row, cells): sparse cells (row, column, raw) as full rows of text, blanks where there is none."""
    rows = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("column", "raw"))).alias("of"))
    return rows.select("row", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.coalesce(F.get(F.map_values(F.map_filter("of", lambda k, _: k == c)), F.lit(0)), F.lit(""))).alias("cells"))
