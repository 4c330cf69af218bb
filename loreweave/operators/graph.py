"""The temporal knowledge graph: valid times, duplicates, superseded states, and hops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import graph_terms, is_current_state, normalize_graph_text, normalize_relation, overlap
from loreweave.operators.search import top

def normalized(edges: DataFrame) -> DataFrame:
    cols = {"source_norm": normalize_graph_text(F.col("source")), "relation_norm": normalize_relation(F.col("relation")), "target_norm": normalize_graph_text(F.col("target"))}
    return edges.withColumns(cols)


def reconcile(edges: DataFrame) -> DataFrame:
    """Edges with superseded_by, superseded_reason and valid_until, all at once.

    First the newest of equal edges stays. Then, of open edges of a current state, the newest of a (project, source, relation)
    wins; those with another target are superseded and end where it begins, or when it was observed.
    """
    e = normalized(edges) if "source_norm" not in edges.columns else edges
    newest = F.struct(*[c for c in ("observed_at", "created_at", "edge_id") if c in e.columns])
    # The newest of a key is found by an aggregate and joined to its edges, so that an entity with very many edges is no single task.
    equal = ["project", "source_norm", "relation_norm", "target_norm", "_from"]
    e = e.withColumn("_from", F.coalesce("valid_from", F.lit("")))
    twice = e.groupBy(*equal).agg(F.max_by("edge_id", newest).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    e = _with(e, twice, equal)
    e = e.withColumn("_copy_of", F.when(F.col("edge_id") != F.col("_first"), F.col("_first")))
    state = F.col("_copy_of").isNull() & F.col("valid_until").isNull() & is_current_state(F.col("relation_norm"))
    key = ["project", "source_norm", "relation_norm"]
    won = F.struct("edge_id", "target_norm", F.coalesce("valid_from", F.col("observed_at").cast("string")).alias("start"))
    differ = e.where(state).groupBy(*key).agg(F.max_by(won, newest).alias("_won"), F.min("target_norm").alias("_a"), F.max("target_norm").alias("_b")).where("_a <> _b").drop("_a", "_b")
    e = _with(e, differ, key)
    e = e.withColumn("_lost", state & (F.col("target_norm") != F.col("_won.target_norm")))
    return e.withColumns(
        {
            "superseded_by": F.coalesce("_copy_of", F.when(F.col("_lost"), F.col("_won.edge_id"))),
            "superseded_reason": F.when(F.col("_copy_of").isNotNull(), "duplicate").when(F.col("_lost"), "current_state"),
            "valid_until": F.when(F.col("_lost"), F.col("_won.start")).otherwise(F.col("valid_until")),
        }
    ).drop("_from", "_first", "_copy_of", "_lost", "_won")


def _with(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """rows with the other columns of groups, one row a key; null keys are equal."""
    other = groups.toDF(*[f"_k_{c}" if c in key else c for c in groups.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key])
    return rows.join(other, same, "left").drop(*[f"_k_{c}" for c in key])


def insert_all(edges: DataFrame) -> DataFrame:
    """Edges after they were inserted one by one in the order of edge_id: each is superseded by the next that outdates it.

    A later equal edge outdates an edge; so does a later open edge of the same current state with another target, which
    also ends it.
    """
    e = normalized(edges) if "source_norm" not in edges.columns else edges
    later = Window.partitionBy("project", "source_norm", "relation_norm", "target_norm", F.coalesce("valid_from", F.lit(""))).orderBy("edge_id")
    copy = F.lead("edge_id").over(later)
    opens = is_current_state(F.col("relation_norm")) & F.col("valid_until").isNull()
    key = Window.partitionBy("project", "source_norm", "relation_norm")
    before = key.orderBy("edge_id").rowsBetween(Window.unboundedPreceding, -1)
    after = key.orderBy(F.desc("edge_id")).rowsBetween(Window.unboundedPreceding, -1)  # the last of these is the next edge
    e = e.withColumns({"_copy": copy, "_opens": opens, "_this": F.struct("edge_id", "target_norm", F.coalesce("valid_from", F.col("observed_at").cast("string")).alias("start"))})
    # The next open edge, unless it has the same target; then the first after it where open edges change their target.
    change = F.col("_opens") & ~F.col("target_norm").eqNullSafe(F.last(F.when(F.col("_opens"), F.col("target_norm")), ignorenulls=True).over(before))
    e = e.withColumn("_change", change).withColumn("_turn", F.last(F.when(F.col("_change"), F.col("_this")), ignorenulls=True).over(after))
    e = e.withColumn("_next", F.last(F.when(F.col("_opens"), F.struct("_this", "_turn")), ignorenulls=True).over(after))
    by = F.when(F.col("_next._this.target_norm") != F.col("target_norm"), F.col("_next._this")).otherwise(F.col("_next._turn"))
    e = e.withColumn("_by", F.when(is_current_state(F.col("relation_norm")), by))
    state = F.col("_by").isNotNull() & (F.col("_copy").isNull() | (F.col("_by.edge_id") < F.col("_copy")))
    return e.withColumns(
        {
            "superseded_by": F.when(state, F.col("_by.edge_id")).otherwise(F.col("_copy")),
            "superseded_reason": F.when(state, "current_state").when(F.col("_copy").isNotNull(), "duplicate"),
            "valid_until": F.when(state, F.col("_by.start")).otherwise(F.col("valid_until")),
        }
    ).drop("_copy", "_opens", "_this", "_change", "_turn", "_next", "_by")


def as_of(day: str) -> Column:
    """Valid on a day: from the first day on, and before the last; dates compare as text."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_until").isNull() | (F.lit(day) < F.col("valid_until")))


def for_entity(edges: DataFrame, entity: str, limit: int, project: str | None = None, day: str | None = None, history: bool = False) -> DataFrame:
    e = edges.where((F.col("source_norm") == entity) | (F.col("target_norm") == entity))
    e = e if project is None else e.where(F.col("project") == project)
    e = e if day is None else e.where(as_of(day))
    e = e if history or "superseded_by" not in edges.columns else e.where("superseded_by IS NULL")
    return e.orderBy(F.desc("observed_at"), F.desc("edge_id")).limit(limit)


def endpoints(edges: DataFrame) -> DataFrame:
    """Each edge under both its entities: the key of bulk look-ups."""
    return edges.withColumn("entity", F.explode(F.array_distinct(F.array("source_norm", "target_norm"))))


def window_stats(edges: DataFrame, limit: int = 180) -> DataFrame:
    """Nodes, active and superseded edges of each project, and whether a browser's window cuts them."""
    by = edges.groupBy("project").agg(F.count("*").alias("n_edges"), F.count_if(F.col("superseded_by").isNull()).alias("n_active"), F.count_if(F.col("superseded_by").isNotNull()).alias("n_superseded"))
    nodes = endpoints(edges).select("project", "entity").distinct().groupBy("project").agg(F.count("*").alias("n_nodes"))
    return by.join(nodes, "project").withColumn("capped", F.col("n_edges") > limit)


def browse(edges: DataFrame, needle: str, limit: int = 180, project: str | None = None) -> DataFrame:
    text = [F.col("source_norm"), F.replace(F.col("relation_norm"), F.lit("_"), F.lit(" ")), F.col("target_norm")]
    e = edges.where(reduce(lambda a, b: a | b, [c.contains(needle) for c in text]))
    e = e if project is None else e.where(F.col("project") == project)
    return e.orderBy(F.desc("observed_at"), F.desc("edge_id")).limit(min(max(limit, 1), 500))


def edge_score(terms: Column) -> Column:
    part = lambda c, w: overlap(terms, graph_terms(F.replace(F.col(c), F.lit("_"), F.lit(" ")))) * w
    return part("relation", 3.0) + part("source", 1.0) + part("target", 1.0) + F.greatest(F.least("confidence", F.lit(1.0)), F.lit(0.0))


def graph_paths(edges: DataFrame, asked: DataFrame, k: int, per_entity: int = 12, bridges: int = 16, per_bridge: int = 6) -> DataFrame:
    """(query_id, memory_id, score, path, rank0): graph_recall with the chain of evidence: the edges, in order, that lead from an
    entity of the query to the memory. Of paths with one score the newest, shortest one counts, then the one with the larger ids.

    asked: query_id, query, entities (normalised). A bridge is the other end of a found edge, reached by the newest such edge.
    """
    live = endpoints(edges.where("superseded_by IS NULL") if "superseded_by" in edges.columns else edges)
    newest = lambda *by: Window.partitionBy(*by).orderBy(F.desc("observed_at"), F.desc("edge_id"))
    own = asked.select("query_id", F.explode("entities").alias("entity"))

    def reached(keys: DataFrame, most: int) -> DataFrame:
        top_edges = live.join(keys.select("entity").distinct(), "entity").withColumn("_n", F.row_number().over(newest("entity"))).where(F.col("_n") <= most).drop("_n")
        return top_edges.join(keys, "entity")

    one = reached(own, per_entity)
    ends = one.select("query_id", "observed_at", "edge_id", F.explode(F.array("source_norm", "target_norm")).alias("entity")).join(own, ["query_id", "entity"], "left_anti")
    seen = ends.groupBy("query_id", "entity").agg(F.max(F.struct("observed_at", "edge_id")).alias("at"))
    front = top(seen, bridges, F.desc("at"), "entity").select("query_id", "entity", F.col("at.edge_id").alias("_via"))
    two = reached(front, per_bridge)
    words = asked.select("query_id", graph_terms(F.col("query")).alias("ts"))
    rows = one.withColumns({"decay": F.lit(1.0), "path": F.array("edge_id")}).unionByName(two.withColumns({"decay": F.lit(0.75), "path": F.array("_via", "edge_id")}).drop("_via")).join(words, "query_id")
    rows = rows.withColumn("score", edge_score(F.col("ts")) * F.col("decay"))
    best = rows.groupBy("query_id", "memory_id").agg(F.max(F.struct(F.round("score", 9).alias("score"), "observed_at", (-F.size("path")).alias("_short"), "path")).alias("b"))
    return top(best.select("query_id", "memory_id", "b.score", "b.observed_at", "b.path"), k, F.desc("score"), F.desc("observed_at"), "memory_id")


def graph_recall(edges: DataFrame, asked: DataFrame, k: int, per_entity: int = 12, bridges: int = 16, per_bridge: int = 6) -> DataFrame:
    """(query_id, memory_id, score, rank0): memories of the newest active edges of a query's entities, and of one hop more.

    asked: query_id, query, entities (normalised). A bridge is the other end of a found edge; its edges count three quarters.
    """
    return graph_paths(edges, asked, k, per_entity, bridges, per_bridge).drop("path")


def stale(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates (query_id, memory_id) all of whose edges are closed while another candidate has a live edge of the same state."""
    mine = candidates.join(edges.select("memory_id", "source_norm", "relation_norm", F.col("superseded_by").isNull().alias("open")), "memory_id")
    shut = mine.groupBy("query_id", "memory_id").agg(F.bool_or("open").alias("any")).where("NOT any").select("query_id", "memory_id")
    open_keys = mine.where("open").select("query_id", "source_norm", "relation_norm").distinct()
    return mine.join(shut, ["query_id", "memory_id"]).join(open_keys, ["query_id", "source_norm", "relation_norm"], "left_semi").select("query_id", "memory_id").distinct()


def relation_markers(rows: DataFrame, text: str) -> DataFrame:
    """RELATION: source | relation | target lines of a text, each once."""
    line = F.explode(F.transform(F.split(text, "\n"), lambda x: F.trim(x)))
    rows = rows.select("*", line.alias("_line")).where("_line LIKE 'RELATION:%'")
    parts = F.transform(F.split(F.substr("_line", F.lit(10)), r"\|"), lambda x: F.trim(x))
    rows = rows.withColumn("_p", parts).where((F.size("_p") == 3) & F.forall("_p", lambda x: (x != "") & (F.octet_length(x) <= 512)))
    rows = rows.select("*", F.col("_p")[0].alias("source"), F.col("_p")[1].alias("relation"), F.col("_p")[2].alias("target"), F.lit(1.0).alias("confidence"))
    return rows.where(F.col("relation").rlike("^[A-Za-z0-9_-]{1,64}$")).drop("_line", "_p", text).distinct()
