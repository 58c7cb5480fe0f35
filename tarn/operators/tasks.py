"""Tasks and list items: extraction from note bodies, dates and priorities in their text, trees, and buckets by date."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.sources.tables import spread

ITEM = r"^(\s*)(?:[-*+]|\d+[.)])\s+(?:\[(.)\]\s+)?(.*)$"
#: Date marks in a task's text (fixed values) and the field each one sets.
DATE_MARKS = {"due": ("🗓️", "🗓", "📅"), "completion": ("✅",), "created": ("➕",), "start": ("🛫",), "scheduled": ("⏳",)}
#: Priority marks (fixed values); none of them is C.
PRIORITIES = (("⏫", "A"), ("🔼", "B"), ("🔽", "D"))


ITEM_LINE = re.compile(ITEM, re.ASCII)
HEADING = re.compile(r"^#{1,6}\s+(.*)$", re.ASCII)
#: Items of a batch that goes back to the JVM, unless one note has more.
BATCH_ITEMS = 10_000


def numbers(parents: list[int | None]) -> list[int]:
    """The number of the last item below each item, itself if there is none. Items are numbered in pre-order, and ``parents`` has the number of each one's parent."""
    last = list(range(len(parents)))
    for i in range(len(parents) - 1, -1, -1):
        if parents[i] is not None:
            last[parents[i]] = max(last[parents[i]], last[i])
    return last


def items_of(body: str) -> dict[str, list]:
    """The list items of one text in one pass: a stack holds the items that the next one may lie below."""
    line, indents, status, texts, sections, above, parents = ([] for _ in range(7))
    stack: list[tuple[int, int]] = []  # indent and number, indents rising
    section = None
    for at, row in enumerate(body.replace("\r\n", "\n").split("\n")):
        if row.startswith("#") and (heading := HEADING.match(row)):
            section = heading[1] or section
        found = ITEM_LINE.match(row)
        if not found:
            continue
        blanks, mark, rest = found.groups()
        indent = len(blanks.replace("\t", "    "))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        parent = stack[-1][1] if stack else None
        stack.append((indent, len(parents)))
        above.append(None if parent is None else line[parent])
        line.append(at)
        indents.append(indent)
        status.append(mark)
        texts.append(rest)
        sections.append(section)
        parents.append(parent)
    return {"line": line, "indent": indents, "status": status, "text": texts, "section": sections, "parent_line": above, "nth": list(range(len(line))), "last": numbers(parents)}


def item_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items of batches of (path, body); items of many notes go into one batch."""
    types = {"status": pa.string(), "text": pa.string(), "section": pa.string()}
    for batch in batches:
        owners: list[int] = []
        found: dict[str, list] = {}
        for i, body in enumerate(batch.column(1)):
            if text := body.as_py():
                own = items_of(text)
                owners += [i] * len(own["line"])
                for name, values in own.items():
                    found.setdefault(name, []).extend(values)
            if owners and (len(owners) >= BATCH_ITEMS or i == batch.num_rows - 1):
                columns = {n: pa.array(v, types.get(n, pa.int32())) for n, v in found.items()}
                yield pa.record_batch([batch.column(0).take(pa.array(owners)), *columns.values()], names=["path", *columns])
                owners, found = [], {}


def items(notes: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """One row for each list line: path, line, indent, task, status, checked, completed, text, section, the line of its parent, and its interval in the note's tree: ``nth``,
    its place among the items, and ``last``, the place of the last item below it. Notes are read one by one, in time linear in their lines; they are
    dealt to all cores first, as a small file with many notes is few partitions."""
    kind = notes.schema[path].dataType.simpleString()
    schema = f"path {kind}, line int, indent int, status string, text string, section string, parent_line int, nth int, last int"

    order = "path, line, indent, status, text, section, parent_line, nth, last".split(", ")
    found = spread(notes.select(F.col(path).alias("path"), F.col(body).alias("body"))).mapInArrow(item_batches, schema).select(*order)
    status = F.col("status")
    return found.select(
        "path", "line", "indent", status.isNotNull().alias("task"), "status", F.coalesce(status != " ", F.lit(False)).alias("checked"), F.coalesce(status.isin("x", "X"), F.lit(False)).alias("completed"),
        "text", "section", "parent_line", "nth", "last",
    )


def marked_date(text: Column, field: str) -> Column:
    marks = "|".join(DATE_MARKS[field])
    return F.try_to_date(F.nullif(F.regexp_extract(text, rf"(?:{marks})\s*(\d{{4}}-\d{{2}}-\d{{2}})", 1), F.lit("")))


def inline_date(text: Column, field: str) -> Column:
    """Date of ``[field:: yyyy-mm-dd]`` or ``(field:: ...)``."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, rf"[\[(]{field}::\s*(\d{{4}}-\d{{2}}-\d{{2}})", 1), F.lit("")))


def enrich(tasks: DataFrame, text: str = "text") -> DataFrame:
    """Adds due, completion, created, start, scheduled, priority and recurrence."""
    c = F.col(text)
    priority = F.lit("C")
    for mark, name in reversed(PRIORITIES):
        priority = F.when(F.contains(c, F.lit(mark)), F.lit(name)).otherwise(priority)
    repeat = F.nullif(F.trim(F.regexp_extract(c, "🔁([^🗓📅✅➕🛫⏳⏫🔼🔽]*)", 1)), F.lit(""))
    return tasks.select("*", *(F.coalesce(marked_date(c, f), inline_date(c, f)).alias(f) for f in DATE_MARKS), priority.alias("priority"), repeat.alias("recurrence"))


def buckets(tasks: DataFrame, day: datetime.date) -> DataFrame:
    """Adds ``buckets``: every class that a task falls into on the day."""
    on, done = F.lit(day), F.col("completed")
    rules = {
        "done": done & (F.col("completion") == on), "due": ~done & (F.col("due") == on), "overdue": ~done & (F.col("due") < on), "start": ~done & (F.col("start") == on),
        "scheduled": ~done & (F.col("scheduled") == on), "process": ~done & (F.col("start") < on) & (F.col("due") > on),
        "recurrence": ~done & F.col("recurrence").isNotNull() & (F.col("due") == on), "cancelled": F.coalesce(F.col("status") == "-", F.lit(False)),
    }
    return tasks.withColumn("buckets", F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items()))))


def happenings(tasks: DataFrame) -> DataFrame:
    """One row for each task, field and date on which something happens to it."""
    entries = F.array(*(F.struct(F.lit(f).alias("what"), F.col(f).alias("day")) for f in ("due", "completion", "start", "scheduled")))
    return tasks.withColumn("h", F.explode(F.filter(entries, lambda x: x["day"].isNotNull()))).select("*", "h.*").drop("h")


def timeline(tasks: DataFrame) -> DataFrame:
    """Tasks by day and what happens: counts for each pair."""
    return happenings(tasks).groupBy("day", "what").agg(F.count(F.lit(1)).alias("tasks"))


def numbered(found: DataFrame) -> DataFrame:
    """Items with their intervals ``nth`` and ``last``. Items of :func:`items` have them; others get them from ``parent_line``, note by note. Items that lie above themselves
    are an error."""
    if {"nth", "last"} <= set(found.columns):
        return found
    kind = found.schema["path"].dataType.simpleString()

    def number(table: pa.Table) -> pa.Table:
        lines, above = table["line"].to_pylist(), dict(zip(table["line"].to_pylist(), table["parent_line"].to_pylist()))
        below: dict[int | None, list[int]] = {}
        for line in sorted(lines, reverse=True):
            below.setdefault(above[line] if above[line] in above else None, []).append(line)
        nth, parents, stack = {}, [], [(line, None) for line in below.get(None, [])]
        while stack:
            line, parent = stack.pop()
            nth[line] = len(parents)
            parents.append(parent)
            stack += [(child, nth[line]) for child in below.get(line, [])]
        if len(nth) < len(above):
            raise ValueError("items lie above themselves")
        last = numbers(parents)
        return pa.table({"path": table["path"], "line": table["line"].cast(pa.int32()), "nth": pa.array([nth[x] for x in lines], pa.int32()), "last": pa.array([last[nth[x]] for x in lines], pa.int32())})

    ids = found.select("path", F.col("line").cast("int").alias("line"), F.col("parent_line").cast("int").alias("parent_line"))
    intervals = ids.groupBy("path").applyInArrow(number, f"path {kind}, line int, nth int, last int")
    renamed = intervals.select(F.col("path").alias("p"), F.col("line").alias("l"), "nth", "last")
    return found.join(renamed, F.col("path").eqNullSafe(F.col("p")) & (F.col("line") == F.col("l"))).drop("p", "l")


def expand(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """(path, root_line, …): each chosen item with every item below it, in any depth, as rows of ``found``. The interval of an item names its descendants, so the work is that of the
    result. Both sides are sorted and merged, as Spark guesses the size of items from the files of their notes and would gather millions of them on the driver."""
    roots = numbered(chosen).select(F.col("path").alias("p"), F.col("line").alias("root_line"), F.explode(F.sequence("nth", "last")).alias("n"))
    columns = [c for c in found.columns if c != "path"]
    joined = numbered(found).hint("merge").join(roots, F.col("path").eqNullSafe(F.col("p")) & (F.col("nth") == F.col("n")))
    return joined.select("path", "root_line", *columns)


def closure(found: DataFrame) -> DataFrame:
    """(path, ancestor, line, depth): every item with each item above it, itself at depth 0. As large as all chains together; the functions below do without it."""
    depth = F.row_number().over(Window.partitionBy("path", "line").orderBy(F.desc("root_line"))) - 1
    return expand(found, found).select("path", F.col("root_line").alias("ancestor"), "line", depth.alias("depth"))


def fully_completed(found: DataFrame) -> DataFrame:
    """(path, line, fully_completed): a task and all tasks below it are completed. Open tasks are counted along the note; an interval without any is completed."""
    open_ = (F.col("task") & ~F.col("completed")).cast("int")
    along = Window.partitionBy("path").orderBy("nth")
    rows = numbered(found).select("path", "line", "nth", "last", open_.alias("open")).withColumn("upto", F.sum("open").over(along))
    ends = rows.select(F.col("path").alias("p"), F.col("nth").alias("end"), F.col("upto").alias("end_upto"))
    joined = rows.join(ends, F.col("path").eqNullSafe(F.col("p")) & (F.col("last") == F.col("end")))
    return joined.select("path", "line", (F.col("end_upto") == F.col("upto") - F.col("open")).alias("fully_completed"))


def matching_with_children(found: DataFrame, test: Column) -> DataFrame:
    """Items that meet the test or lie below one that does. Intervals are nested, so an item lies in one of those before it exactly if the farthest of them reaches it."""
    reach = F.max(F.when(test, F.col("last"))).over(Window.partitionBy("path").orderBy("nth"))
    return numbered(found).withColumn("__reach", reach).where(F.col("__reach") >= F.col("nth")).select(*found.columns)


def with_children(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Items of ``found`` that are among the chosen or lie below one of them."""
    hit = chosen.select(F.col("path").alias("p"), F.col("line").alias("l"), F.lit(True).alias("__hit")).distinct()
    marked = found.join(hit, F.col("path").eqNullSafe(F.col("p")) & (F.col("line") == F.col("l")), "left").drop("p", "l")
    return matching_with_children(marked, F.coalesce("__hit", F.lit(False))).select(*found.columns)


#: Filters of task lists by name; each takes the task's columns and a date where it needs one.
FILTERS = {
    "not done": lambda day=None: ~F.col("completed"), "done": lambda day=None: F.col("completed"), "due before": lambda day: F.col("due") < F.lit(day), "due after": lambda day: F.col("due") > F.lit(day),
    "due on": lambda day: F.col("due") == F.lit(day), "no due date": lambda day=None: F.col("due").isNull(), "done on": lambda day: F.col("completion") == F.lit(day),
}


def task_query(tasks: DataFrame, types: list[str] | None = None, status: str = "due", start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
    """Tasks by type tag, kind of date and date range."""
    found = tasks
    if types:
        found = found.where(F.exists(F.array(*map(F.lit, types)), lambda t: F.contains(F.col("text"), F.concat(F.lit("#"), t))))
    column = {"due": "due", "done": "completion", "start": "start", "scheduled": "scheduled", "created": "created"}[status]
    if start is not None:
        found = found.where(F.col(column) >= F.lit(start))
    return found if end is None else found.where(F.col(column) <= F.lit(end))


def completion_rate(done: Column, due: Column) -> Column:
    """Percentage with two decimals; null where nothing is due."""
    return F.round(F.try_divide(done * 100.0, due), 2)
