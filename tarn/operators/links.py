"""Links between notes as an edge table (src, dst, display, subpath, type, embed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIKI = r"(!?)\[\[([^\]|#]+)(?:#([^\]|]*))?(?:\|([^\]]*))?\]\]"


def extract_links(notes: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Edges of the ``[[target#part|shown]]`` links in the notes' bodies."""
    found = notes.select(F.col(path).alias("src"), F.posexplode(F.regexp_extract_all(body, F.lit(WIKI), F.lit(0))).alias("nth", "raw"))
    part = lambda g: F.nullif(F.regexp_extract("raw", WIKI, g), F.lit(""))
    subpath = part(3)
    kind = F.when(subpath.isNull(), "file").when(subpath.startswith("^"), "block").otherwise("header")
    return found.select("src", F.trim(part(2)).alias("dst"), part(4).alias("display"), subpath.alias("subpath"), kind.alias("type"), (F.regexp_extract("raw", WIKI, 1) == "!").alias("embed"), "nth")


def link_rows(edges: DataFrame, end: str = "dst") -> DataFrame:
    """(path, other): the distinct other ends of each note as rows, which no hub gathers in one place."""
    other = "src" if end == "dst" else "dst"
    return edges.select(F.col(end).alias("path"), F.col(other).alias("other")).distinct()


def listed(edges: DataFrame, end: str, name: str, most: int | None) -> DataFrame:
    rows = link_rows(edges, end)
    if most is not None:  # each task hands on the first ``most`` of a note only
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("other"))).where(F.col("nth") <= most)
    return rows.groupBy("path").agg(F.array_sort(F.collect_list("other")).alias(name))


def inlinks(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Sources of each target, sorted; with ``most`` the first so many, so that the list of a hub has a bound. :func:`link_rows` has all of them as rows."""
    return listed(edges, "dst", "inlinks", most)


def outlinks(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Targets of each source, like :func:`inlinks`."""
    return listed(edges, "src", "outlinks", most)


def degree(edges: DataFrame, end: str = "dst") -> DataFrame:
    """Links and distinct other ends of each note, without lists."""
    other = "src" if end == "dst" else "dst"
    return edges.groupBy(F.col(end).alias("path")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct(other).alias("others"))


def dereference(rows: DataFrame, link: str, notes: DataFrame, fields: list[str], key: str = "path") -> DataFrame:
    """Fields of the linked note beside each row; null where the target does not exist."""
    target = notes.select(F.col(key).alias("__key"), *(F.col(f).alias(f"{link}_{f}") for f in fields))
    return rows.join(target, F.col(link) == F.col("__key"), "left").drop("__key")


def unresolved(edges: DataFrame, notes: DataFrame, key: str = "path") -> DataFrame:
    """Edges to notes that do not exist."""
    return edges.join(notes.select(F.col(key).alias("__key")), F.col("dst") == F.col("__key"), "left_anti")


def unreferenced(files: DataFrame, edges: DataFrame, key: str = "path") -> DataFrame:
    """Files that no link points to."""
    return files.join(edges.select(F.col("dst").alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def linked_from(rows: DataFrame, edges: DataFrame, source: str, key: str = "path") -> DataFrame:
    """Rows that the source links to."""
    return rows.join(edges.where(F.col("src") == source).select(F.col("dst").alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def linking_to(rows: DataFrame, edges: DataFrame, target: str, key: str = "path") -> DataFrame:
    """Rows that link to the target."""
    return rows.join(edges.where(F.col("dst") == target).select(F.col("src").alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def lookup_summary(notes: DataFrame, related: DataFrame, value: str, key: str = "path", target: str = "target", more: dict[str, Column] | None = None) -> DataFrame:
    """Reverse references: for each note the number, non-empty count, sum, average, least and greatest value of the rows that refer to it, and what the
    aggregates in ``more`` make of them.
    Rows are summed up before the join, so a note that everything refers to is one row."""
    sums = related.groupBy(F.col(target).alias("__key")).agg(
        F.count(F.lit(1)).alias("count_all"), F.count(value).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("average"), F.max(value).alias("max"), F.min(value).alias("min"),
        *(c.alias(n) for n, c in (more or {}).items()),
    )
    joined = notes.join(sums, F.col(key) == F.col("__key"), "left").drop("__key")
    return joined.withColumn("count_all", F.coalesce("count_all", F.lit(0))).withColumn("count", F.coalesce("count", F.lit(0)))


def canvas_neighbours(nodes: DataFrame, edges: DataFrame, direction: str = "both", color: str | None = None, label: str | None = None, side: str | None = None) -> DataFrame:
    """(node, neighbour) on a canvas: edges (from_node, to_node, color, label, and from_side, to_side if a side is asked for), followed in, out or
    both ways. ``side`` is the side of the node at which the edge is fixed."""
    chosen = edges
    if color is not None:
        chosen = chosen.where(F.col("color") == color)
    if label is not None:
        chosen = chosen.where(F.col("label") == label)
    at = lambda end: chosen if side is None else chosen.where(F.col(end) == side)
    out = at("from_side").select(F.col("from_node").alias("node"), F.col("to_node").alias("neighbour"))
    into = at("to_side").select(F.col("to_node").alias("node"), F.col("from_node").alias("neighbour"))
    pairs = {"out": out, "in": into, "both": out.union(into)}[direction].distinct()
    return pairs.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
