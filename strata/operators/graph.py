"""The entity graph: building, merging, seeding, traversal and grouping, over tables of entities and edges.

entities: key, name, type, ord. edges: src, dst, relation, chunk_id, ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.text import entity_key, is_enumeration, trimmed
from strata.operators.sized import kept, small

#: Words that a variant's canonical form may add to it.
GROWTH = 2
MAX_HOPS = 2


def edges_of(relations: DataFrame) -> DataFrame:
    """Edges of stated relations (from, to, relation, chunk_id, ord): enumerations, self-loops and empty names dropped; of repeats (whatever the case of the relation) the first stays."""
    named = relations.where(~is_enumeration(F.col("from")) & ~is_enumeration(F.col("to"))).select(
        entity_key(F.col("from")).alias("src"), entity_key(F.col("to")).alias("dst"), trimmed(F.col("relation")).alias("relation"), "chunk_id", "ord"
    )
    valid = named.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")) & (F.col("relation") != ""))
    return valid.groupBy("src", "dst", F.lower("relation").alias("_r"), "chunk_id").agg(F.min_by("relation", "ord").alias("relation"), F.min("ord").alias("ord")).select(
        "src", "dst", "relation", "chunk_id", "ord"
    )


def entities_of(entities: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Entities of stated names (name, type, ord) and of relations' endpoints, which carry no type; the first form seen stays, of equals a stated name."""
    named = entities.select("name", "type", "ord", F.lit(0).alias("end"))
    if relations is not None:
        good = relations.where(~is_enumeration(F.col("from")) & ~is_enumeration(F.col("to")) & (trimmed(F.col("relation")) != "") & (entity_key(F.col("from")) != entity_key(F.col("to"))))
        good = good.where((entity_key(F.col("from")) != "") & (entity_key(F.col("to")) != ""))
        ends = good.select(F.explode(F.array("from", "to")).alias("name"), F.lit("").alias("type"), "ord", F.lit(1).alias("end"))
        named = named.unionByName(ends)
    keyed = named.where(~is_enumeration(F.col("name"))).select(entity_key(F.col("name")).alias("key"), trimmed(F.col("name")).alias("name"), "type", "ord", "end").where("key <> ''")
    first = F.min_by(F.struct("name", "type"), F.struct("ord", "end", "name", "type")).alias("first")
    return keyed.groupBy("key").agg(first, F.min("ord").alias("ord")).select("key", "first.name", "first.type", "ord")


def merge_candidates(entities: DataFrame) -> DataFrame:
    """variant, canonical: an entity that is the ending of one other, longer by at most GROWTH words, and of no second one.

    A longer name offers its endings that lack 1 to GROWTH words; a variant
    meets them by equality, so names that share their last word alone don't meet.
    """
    words = entities.select("key", F.split("key", " ").alias("words"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(GROWTH)), lambda n: F.when(F.size("words") > n, F.array_join(F.slice("words", n + 1, F.size("words") - n), " ")))
    endings = words.select(F.col("key").alias("canonical"), F.explode(cut).alias("key")).where("key is not null")
    pairs = endings.join(entities.select("key"), "key")
    return pairs.groupBy(F.col("key").alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.min("canonical").alias("canonical")).where("n = 1").select("variant", "canonical")


def majority(votes: DataFrame, asked: int = 3) -> DataFrame:
    """pair ids whose yes votes (pair, same) are over half of the votes asked for; a failed vote (null) counts as no."""
    yes = F.sum(F.coalesce(F.col("same").cast("int"), F.lit(0)))
    return votes.groupBy("pair").agg(yes.alias("yes")).where(F.col("yes") * 2 > asked).select("pair")


def resolve(merges: DataFrame) -> DataFrame:
    """variant, canonical with chains followed to their end. Canonical names are longer than variants, so there is no cycle; each round doubles the reach."""
    current = kept(merges)
    while True:
        ahead = current.select(F.col("variant").alias("canonical"), F.col("canonical").alias("next"))
        current = current.join(ahead, "canonical", "left").select("variant", F.coalesce("next", "canonical").alias("canonical"), F.col("next").isNotNull().alias("moved"))
        current = kept(current)
        if current.where("moved").isEmpty():
            return current.select("variant", "canonical")
        current = current.select("variant", "canonical")


def canonicalize(entities: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, aliases) after confirmed merges (variant, canonical): variants go, edges are rewritten, self-loops and repeats (in the very same relation) dropped."""
    aliases = resolve(merges)
    stay = entities.join(aliases.select(F.col("variant").alias("key")), "key", "left_anti")
    a, b = aliases.select(F.col("variant").alias("src"), F.col("canonical").alias("s")), aliases.select(F.col("variant").alias("dst"), F.col("canonical").alias("d"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "relation", "chunk_id", "ord")
    rewritten = moved.where("src <> dst").groupBy("src", "dst", "relation", "chunk_id").agg(F.min("ord").alias("ord"))
    return stay, rewritten, aliases


def seeds(entities: DataFrame, queries: DataFrame, aliases: DataFrame | None = None, longest: int = 8) -> DataFrame:
    """query_id, key: entities named in a query, by key, alias or a person's unambiguous first name; names within longer named ones are left out.

    A query's runs of up to ``longest`` words are joined with the keys by
    equality; longer keys are matched by containment, apart.
    """
    asked = queries.select("query_id", entity_key(F.col("text")).alias("q"))
    words = asked.select("query_id", "q", F.split("q", " ").alias("w"))
    spans = words.select("query_id", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"), "w").select(
        "query_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.col("i") + n <= F.size("w"), F.array_join(F.slice("w", F.col("i") + 1, n), " ")))).alias("key")
    )
    spans = spans.where("key is not null").distinct()
    names = entities.select("key", F.col("key").alias("found"))
    people = entities.where("type = 'person'").select("key", F.split("key", " ").alias("w")).where(F.size("w") > 1)
    first = people.groupBy(F.col("w")[0].alias("first")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("found")).where("n = 1")
    names = names.unionByName(first.select(F.col("first").alias("key"), "found"))
    if aliases is not None:
        names = names.unionByName(aliases.select(F.col("variant").alias("key"), F.col("canonical").alias("found")))
    found = spans.join(names, "key").select("query_id", F.col("found").alias("key"))
    long = names.where(F.size(F.split("key", " ")) > longest)
    padded = F.concat(F.lit(" "), F.col("q"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("key"), F.lit(" ")))
    found = found.union(asked.join(small(long), padded).select("query_id", F.col("found").alias("key"))).distinct()
    other = found.select("query_id", F.col("key").alias("longer"))
    within = F.concat(F.lit(" "), F.col("longer"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("key"), F.lit(" ")))
    inside = found.join(other, "query_id").where((F.col("key") != F.col("longer")) & within).select("query_id", "key")
    return found.join(inside, ["query_id", "key"], "left_anti")


def traverse(edges: DataFrame, starts: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """query_id, src, dst, relation, chunk_id, hop: edges within max_hops of a query's starts (query_id, key), either way along them.

    An edge's hop is the least distance of its ends from a start, plus one.
    Each hop joins the new nodes with both directions of the edges.
    """
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select("dst", "src")).distinct()
    reached = starts.select("query_id", F.col("key").alias("node")).distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, max_hops):
        ahead = frontier.join(both, "node").select("query_id", F.col("next").alias("node")).distinct()
        frontier = ahead.join(reached, ["query_id", "node"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.union(frontier)
    if max_hops < 1:
        reached = reached.where(F.lit(False))
    touched = edges.select(F.explode(F.array("src", "dst")).alias("node"), "src", "dst", "relation", "chunk_id").join(reached, "node")
    return touched.groupBy("query_id", "src", "dst", "relation", "chunk_id").agg((F.min("hop") + 1).cast("int").alias("hop"))


def chunk_groups(hits: DataFrame, k: int = 5) -> DataFrame:
    """query_id, chunk_id, min_hop, score, paths, rank: traversed edges by the chunk that states them, nearest first.

    hits: query_id, chunk_id, hop, path (as rendered), src, relation, dst.
    """
    paths = F.transform(F.sort_array(F.collect_list(F.struct("hop", "src", "relation", "dst", "path"))), lambda s: s["path"])
    groups = hits.groupBy("query_id", "chunk_id").agg(F.min("hop").alias("min_hop"), paths.alias("paths"))
    best = Window.partitionBy("query_id").orderBy("min_hop", "chunk_id")
    return groups.withColumn("score", 1.0 / F.col("min_hop")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (k if k > 0 else 5))


def rendered(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """hits with path, "A —relation→ B" in display names."""
    a = entities.select(F.col("key").alias("src"), F.col("name").alias("_a"))
    b = entities.select(F.col("key").alias("dst"), F.col("name").alias("_b"))
    shown = lambda name, key: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name)).otherwise(F.col(key))
    path = F.concat(shown("_a", "src"), F.lit(" —"), F.col("relation"), F.lit("→ "), shown("_b", "dst"))
    return hits.join(a, "src", "left").join(b, "dst", "left").withColumn("path", path).drop("_a", "_b")


TABLES = ("entities", "edges", "excerpts", "aliases")


def save(path: str, *tables: DataFrame) -> None:
    """Entities, edges, excerpts (chunk_id, text) and aliases, in that order, as Parquet below path, which holds no graph yet."""
    for name, table in zip(TABLES, tables, strict=True):
        table.write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, ...]:
    """The saved entities, edges, excerpts and aliases."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in TABLES)


def retrieve(entities: DataFrame, edges: DataFrame, excerpts: DataFrame, queries: DataFrame, k: int = 5, max_hops: int = MAX_HOPS, aliases: DataFrame | None = None) -> DataFrame:
    """Evidence of the relational tier: the relations found, then the excerpt of their chunk."""
    hits = rendered(traverse(edges, seeds(entities, queries, aliases), max_hops), entities)
    groups = chunk_groups(hits, k).join(excerpts.select("chunk_id", F.col("text").alias("excerpt")), "chunk_id", "left")
    text = F.concat(F.lit("Relationships:\n"), F.array_join("paths", "\n"), F.when(F.coalesce(F.col("excerpt"), F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("excerpt"))).otherwise(""))
    meta = F.create_map(F.lit("hops"), F.col("min_hop").cast("string"), F.lit("edges"), F.size("paths").cast("string"))
    return groups.select("query_id", F.lit("relational").alias("tier"), F.col("chunk_id").alias("source_id"), text.alias("text"), "score", meta.alias("meta"), "rank")
