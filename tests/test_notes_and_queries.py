"""Sources, sinks, templates, functions, commands and the query language."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import dates, durations, paths, values
from tarn.operators import commands, links, lookups, tasks
from tarn.plans.language import Engine, QueryError, read
from tarn.plans.templates import TemplateError, compile_template, load_template, load_templates, render
from tarn.sources import definitions, guards, notes, settings, sinks, tables

CLOCK = datetime.datetime(2024, 1, 17, 13, 30)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# ---- paths, guards, settings ----


@pytest.mark.parametrize("path, name, parent", [
    ("/vault/notes/contact.md", "contact", "/vault/notes"), ("/vault/notes/draft", "draft", "/vault/notes"), ("/vault/notes/archive.tar.gz", "archive.tar", "/vault/notes"), ("/vault/.obs/config", "config", "/vault/.obs"),
    ("readme.md", "readme", "."), ("/readme.md", "readme", "/"), ("", "", "."), (".md", "", "."),
])
def test_paths(spark, path, name, parent):
    assert one(spark, paths.basename(F.lit(path))) == name and one(spark, paths.folder(F.lit(path))) == parent


def test_path_guards():
    guards.check_directory("/v/a..b", "/v")
    guards.check_file("/v/a..b.json", ".json", "/v")
    for call in (lambda: guards.check_directory("/v/../x"), lambda: guards.check_directory("/vault2", "/vault"), lambda: guards.check_directory(" "), lambda: guards.check_file("/v/a.yaml", ".json"), lambda: guards.check_file("/w/a.json", ".json", "/v")):
        with pytest.raises(guards.PathError):
            call()


def test_settings(tmp_path):
    (tmp_path / "tarn.yaml").write_text("vaultPath: " + str(tmp_path) + "\nlogLevel: debug\ntemplatesDir: mine\n")
    s = settings.load([str(tmp_path)], {"TARN_LOG_LEVEL": "WARN"})
    assert (s.vault, s.templates, s.schemas, s.log_level) == (str(tmp_path), str(tmp_path / "mine"), str(tmp_path / "schemas"), "WARN")
    s.check()
    for bad in (settings.Settings.of(str(tmp_path / "gone")), settings.Settings.of(str(tmp_path / "tarn.yaml")), settings.Settings.of(str(tmp_path), log_level="loud")):
        with pytest.raises(settings.SettingsError):
            bad.check()


# ---- notes and definitions from files ----


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    files = {
        "a.md": "---\nfileClass: note\ntitle: First\ntags: [x, y]\nempty:\n---\nBody [[b|B]] ![[pic.png]] #proj/one\n",
        "sub/b.md": "no header\nKey:: v1\nKey:: v2\n[Inline Key:: z] (p:: q)\n",
        "sub/c.md": "---\n: : bad\n- x\n---\nbody",
        "d.md": "+++\ntitle = 'toml'\n+++\n",
        "e.md": "---\nfileClass: 7\n---\n",
        "x.txt": "not a note",
        "schemas/note.json": json.dumps({"name": "note", "properties": {"title": {"type": "string", "required": True}, "tags": {"type": "string", "array": True}, "ref": {"$ref": "#/properties/shared"}}}),
        "schemas/properties/bank.json": json.dumps({"properties": {"shared": {"type": "number", "min": 1}}}),
        "schemas/properties/more.json": json.dumps({"properties": {"shared": {"type": "number", "min": 2}}}),
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_notes(spark, vault):
    rows = {os.path.basename(r.path): r for r in notes.notes(spark, vault).withColumn("json", F.to_json("fields")).collect()}
    assert set(rows) == {"a.md", "b.md", "c.md", "d.md", "e.md"}
    assert rows["a.md"].file_class == "note" and json.loads(rows["a.md"].json)["tags"] == ["x", "y"] and rows["a.md"].body.startswith("Body")
    assert rows["b.md"].json == "{}" and rows["b.md"].body.startswith("no header") and rows["b.md"].folder.endswith("/sub")
    assert rows["c.md"].header_error and rows["d.md"].json == "{}" and rows["e.md"].file_class == ""
    assert notes.notes(spark, vault, ignore=("sub",)).count() == 3
    assert notes.scan(spark, vault, since=datetime.datetime(2100, 1, 1)).count() == 0
    assert notes.scan_bytes(spark, vault).where("mime_type = 'text/markdown'").count() == 5


def test_inline_fields_and_tags(spark, vault):
    df = notes.notes(spark, vault)
    got = {r.name: r["values"] for r in notes.inline_fields(df.where("basename = 'b'")).collect()}
    assert got == {"key": ["v1", "v2"], "inline-key": ["z"], "p": ["q"]}
    assert df.where("basename = 'a'").select(notes.tags("body").alias("t")).first().t == ["#proj", "#proj/one"]


def test_definitions_from_files(spark, vault):
    schemas, bank = definitions.load_schemas(spark, f"{vault}/schemas"), definitions.load_bank(spark, f"{vault}/schemas")
    assert [s.name for s in schemas] == ["note"] and bank.properties["shared"].min == 2
    with open(f"{vault}/schemas/broken.json", "w") as file:
        file.write('{"name": ')
    try:
        with pytest.raises(ValueError, match="malformed"):
            definitions.load_schemas(spark, f"{vault}/schemas")
        assert definitions.malformed(spark, f"{vault}/schemas").count() == 1
    finally:
        os.unlink(f"{vault}/schemas/broken.json")


def test_cache(spark, vault, tmp_path):
    df = notes.notes(spark, vault)
    tables.write_cache(df, str(tmp_path / "cache"))
    cached = tables.read_cache(spark, str(tmp_path / "cache"))
    assert cached.count() == 5 and cached.where("file_class = 'note'").select(F.try_variant_get("fields", "$.title", "string").alias("t")).first().t == "First"
    assert tables.forget(cached, cached.where("basename = 'a'")).count() == 4
    rows = spark.createDataFrame([("p", 1, "old"), ("q", 1, "x")], "path string, mod_time int, v string")
    assert {(r.path, r.v) for r in tables.merge(rows, rows.where("path = 'p'").withColumn("mod_time", F.lit(2)).withColumn("v", F.lit("new"))).collect()} == {("p", "new"), ("q", "x")}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "deep" / "f.md")
    sinks.write_file(path, b"one")
    sinks.write_file(path, b"two")
    assert open(path, "rb").read() == b"two" and os.listdir(tmp_path / "deep") == ["f.md"]
    sinks.write_rows_as_files(spark.createDataFrame([("n1", "t1"), ("n2", "t2")], "name string, content string"), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["n1.md", "n2.md"]
    sinks.save_registry({"a": 1}, str(tmp_path / "r.json"))
    assert sinks.load_registry(str(tmp_path / "r.json"), {"a": 0, "b": 2}) == {"a": 1, "b": 2}


def test_incremental_index(spark, tmp_path):
    from tarn.streaming.incremental import changed_files, keep_index, newest

    source = tmp_path / "in"
    source.mkdir()
    for text in ("first", "second"):
        (source / "n.md").write_text(text) if text == "first" else (source / "m.md").write_text(text)
        keep_index(changed_files(spark, str(source)), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination(60)
    rows = newest(spark.read.parquet(str(tmp_path / "index")).drop("batch")).collect()
    assert sorted(r.content for r in rows) == ["first", "second"]


# ---- templates ----


def test_templates(spark):
    df = spark.createDataFrame([("World", None, 3)], "title string, gone string, n int")
    text = 'Hi {{ .title | toUpper }}!{{- if .gone }} x{{ else }} {{ .n }}{{ end }} {{ .gone }} {{ now "2006-01-02" }} {{ printf "%v-%v" .title .n }}{{/* note */}}'
    assert render(df, text, F.lit(CLOCK)).first().rendered == "Hi WORLD! 3 <no value> 2024-01-17 World-3"
    assert one(spark, compile_template("plain {{ now }}", clock=F.lit(CLOCK))) == "plain 2024-01-17 13:30:00"
    for bad in ("", "  ", "{{ .a", "{{ nope .a }}", "{{ if .a }}x", "{{ end }}", "{{ .a | toUpper | 3 }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    with pytest.raises(TemplateError, match="line 2"):
        compile_template("a\n{{ nope .x }}")


def test_template_files(spark, tmp_path):
    (tmp_path / "t.md").write_text("# {{ .title }}")
    (tmp_path / "empty.md").write_text(" ")
    assert load_template(spark, str(tmp_path / "t.md")) == ("t", "# {{ .title }}")
    assert {r.name for r in load_templates(spark, str(tmp_path)).collect()} == {"t", "empty"}
    with pytest.raises(TemplateError):
        load_template(spark, str(tmp_path / "empty.md"))


# ---- functions ----


def test_text_functions(spark):
    text = F.lit
    checks = [
        (values.number(text("18 years")), 18.0), (values.number(text("-2.5kg")), -2.5), (values.number(text("hmm")), None), (values.pad(text("hello"), 7, "!"), "!!hello"), (values.pad(text("hello"), 3), "hello"),
        (values.pad(text("yes"), 5, "!", left=False), "yes!!"), (values.substring(text("hello"), 0, 2), "he"), (values.substring(text("hello"), 2), "llo"), (values.truncate(text("Hello there!"), 8), "Hello..."),
        (values.truncate(text("Hello there!"), 8, "/"), "Hello t/"), (values.truncate(text("Hello there!"), 80), "Hello there!"), (values.split(text("hello there world"), " ", 2), ["hello", "there"]),
        (values.split(text("hello there world"), r"(t?here)"), ["hello ", "there", " world"]), (values.regex_test(r"\w+", text("hello")), True), (values.regex_test("what", text("what's up dog?"), whole=True), False),
        (values.regex_replace(text("yes"), "[ys]", "a"), "aea"), (values.replace(text("The big dog"), F.lit("big"), F.lit("small")), "The small dog"), (values.contains_word(text("word"), "word"), True), (values.contains_word(text("words"), "word"), False),
        (values.title_case(text("the lord of the rings")), "The Lord of the Rings"), (values.cycle(["a", "b"], text("b")), "a"), (values.cycle(["a", "b"], text("a")), "b"), (values.cycle(["a", "b"], text("b"), True), None), (values.cycle(["a", "b"], F.lit(None).cast("string"), True), "a"),
        (values.link_text(values.link(text("P"), text("d"))), "[[P|d]]"), (values.external_link(text("u"), text("n")), "[n](u)"),
    ]
    for column, want in checks:
        assert one(spark, column) == want


def test_list_functions(spark):
    numbers_, strings = F.array(*map(F.lit, (3, 1, 2))), F.array(*map(F.lit, ("yes", "no")))
    empty, holed = F.array().cast("array<int>"), F.array(F.lit(1), F.lit(None).cast("int"))
    checks = [
        (values.total(numbers_), 6.0), (values.total(empty), None), (values.total(holed), None), (values.product(numbers_), 6.0), (values.average(numbers_), 2.0), (values.average(empty), None),
        (values.by_key(numbers_, lambda x: x), 1), (values.by_key(numbers_, lambda x: x, True), 3), (values.join(numbers_, "-"), "3-1-2"), (values.each(strings, F.upper, True), ["YES", "NO"]),
        (values.contains(strings, F.lit("yes"), T.ArrayType(T.StringType())), True), (values.contains(strings, F.lit("ye"), T.ArrayType(T.StringType())), False), (values.contains(strings, F.lit("ye"), T.ArrayType(T.StringType()), loose=True), True),
        (values.contains(F.lit("Hello"), F.lit("lo"), T.StringType()), True), (values.contains(F.lit("Hello"), F.lit("HE"), T.StringType(), fold=True), True), (values.all_of(numbers_, lambda x: x > 0), True), (values.any_of(numbers_, lambda x: x > 5), False),
        (values.default(holed, F.lit(9), True), [1, 9]),
    ]
    for column, want in checks:
        assert one(spark, column) == want


def test_date_functions(spark):
    now = F.lit(CLOCK)
    day = lambda *a: datetime.datetime(*a)
    checks = [
        (dates.keyword("today", now), day(2024, 1, 17)), (dates.keyword("sow", now), day(2024, 1, 15)), (dates.keyword("som", now), day(2024, 1, 1)), (dates.keyword("eom", now), day(2024, 1, 31, 23, 59, 59, 999000)), (dates.keyword("tomorrow", now), day(2024, 1, 18)),
        (dates.date(F.lit("2024-02-03")), day(2024, 2, 3)), (dates.date(F.lit("2024-02")), day(2024, 2, 1)), (dates.date(F.lit("soon")), None), (dates.date(F.lit("12/31/2022"), "MM/dd/yyyy"), day(2022, 12, 31)),
        (dates.part(now, "weekday"), 3), (dates.part(now, "year"), 2024), (dates.date_format(now, "yyyy-MM-dd"), "2024-01-17"), (dates.date_format(now, "x"), "1705498200000"), (dates.file_day(F.lit("2024-01-05 Meeting")), datetime.date(2024, 1, 5)),
        (durations.seconds(durations.duration(F.lit("1h 30m"))), 5400.0), (durations.duration(F.lit("1 yr, 2 mo")), (14, 0)), (durations.duration(F.lit("9 apples")), None), (durations.minutes_text(F.lit(95)), "1h 35m"), (durations.minutes_text(F.lit(60)), "1h"),
        (durations.plus(F.lit(day(2024, 1, 31, 8)), durations.duration(F.lit("1 mo 2h"))), day(2024, 2, 29, 10)), (durations.plus(now, durations.duration(F.lit("1d")), -1), day(2024, 1, 16, 13, 30)),
    ]
    for column, want in checks:
        assert one(spark, column) == want
    for text in ("1s", "2 hours", "6 hr7 min", "1d 2h, 3m", "3 weeks", "x"):
        got = one(spark, durations.duration(F.lit(text)))
        assert (tuple(got) if got else None) == durations.parse_text(text)


# ---- links, tasks, lookups ----


def test_links(spark, vault):
    edges = links.extract_links(notes.notes(spark, vault).select("basename", "body"), "basename")
    assert {(r.src, r.dst, r.display, r.embed) for r in edges.collect()} == {("a", "b", "B", False), ("a", "pic.png", None, True)}
    files = spark.createDataFrame([("b",), ("c",)], "path string")
    assert [r.dst for r in links.unresolved(edges, files).collect()] == ["pic.png"] and [r.path for r in links.unreferenced(files, edges).collect()] == ["c"]
    assert links.inlinks(edges).where("path = 'b'").first().inlinks == ["a"] and links.outlinks(edges).first().outlinks == ["b", "pic.png"]
    nodes = spark.createDataFrame([("x",), ("y",)], "id string")
    arrows = spark.createDataFrame([("x", "y", "red", "l"), ("y", "x", "blue", "m")], "from_node string, to_node string, color string, label string")
    assert links.canvas_neighbours(nodes, arrows, "out", color="red").collect()[0].neighbour == "y" and links.canvas_neighbours(nodes, arrows).count() == 2
    notes_, related = spark.createDataFrame([("b",), ("c",)], "path string"), spark.createDataFrame([("b", 1.0), ("b", None), ("b", 3.0)], "target string, v double")
    got = {r.path: (r.count_all, r["count"], r["sum"], r.average) for r in links.lookup_summary(notes_, related, "v").collect()}
    assert got == {"b": (3, 2, 4.0, 2.0), "c": (0, 0, None, None)}


BODY = "# Work\n- [ ] top 📅 2024-01-10 ⏫ 🔁 every week\n  - [x] child ✅ 2024-01-09\n    - [x] grandchild\n- plain\n## Home\n- [-] gone [due:: 2024-01-17]\n- [x] all\n\t- [x] below"


def test_tasks(spark):
    df = spark.createDataFrame([("n", BODY)], "path string, body string")
    items = tasks.items(df).cache()
    rows = {r.text.split(" ")[0]: r for r in items.collect()}
    assert (rows["child"].parent_line, rows["grandchild"].parent_line, rows["below"].parent_line, rows["top"].parent_line) == (rows["top"].line, rows["child"].line, rows["all"].line, None)
    assert rows["top"].section == "Work" and rows["gone"].section == "Home" and rows["gone"].checked and not rows["gone"].completed and not rows["plain"].task
    rich = tasks.enrich(items)
    got = {r.text.split(" ")[0]: r for r in tasks.buckets(rich, datetime.date(2024, 1, 17)).collect()}
    assert got["top"].priority == "A" and got["top"].recurrence == "every week" and got["top"].buckets == ["overdue"] and got["gone"].buckets == ["due", "cancelled"]
    done = {(r.line): r.fully_completed for r in tasks.fully_completed(items).collect()}
    assert done[rows["top"].line] is False and done[rows["child"].line] and done[rows["all"].line] and done[rows["plain"].line]
    kept = {r.text.split(" ")[0] for r in tasks.matching_with_children(items, F.col("text").startswith("top")).collect()}
    assert kept == {"top", "child", "grandchild"}
    assert tasks.timeline(rich).count() == 3 and rich.where(tasks.FILTERS["due before"](datetime.date(2024, 1, 11))).count() == 1


def test_trees_and_inheritance_of_any_depth(spark):
    n = 40
    df = spark.createDataFrame([("n", i, i - 1 if i else None, True, i < n - 1) for i in range(n)], "path string, line int, parent_line int, task boolean, completed boolean")
    assert not any(r.fully_completed for r in tasks.fully_completed(df).collect())
    assert tasks.closure(df).count() == n * (n + 1) // 2
    assert tasks.matching_with_children(df, F.col("line") == 0).count() == n
    from tarn.operators import inheritance

    chain = spark.createDataFrame([(f"s{i}", f"s{i - 1}" if i else None) for i in range(n)], "name string, extends string")
    assert inheritance.ancestors(chain).where("name = 's39'").count() == n


def test_lookups(spark):
    index = spark.createDataFrame([("p/a.md", "a", "p", "person"), ("q/b.md", "b", "q", "thing")], "path string, basename string, folder string, file_class string")
    rows = spark.createDataFrame([("p/a.md",), ("[[b]]",), ("[[a|A]]",), ("zzz",), (None,)], "v string")
    assert sorted(r.v for r in lookups.file_reference(rows, "v", index).collect()) == ["[[a|A]]", "[[b]]", "p/a.md"]
    assert [r.v for r in lookups.file_reference(rows, "v", index, file_class="^person").collect()] == ["[[b]]"]
    assert lookups.by_path(index, "p").count() == 1 and lookups.by_path(index, "q/b.md").count() == 1
    assert lookups.by_class_prefix(index.withColumn("status", F.lit("x")), "p/", "per", ["x"]).count() == 1
    with pytest.raises(ValueError):
        lookups.condition("a", "~", 1)


# ---- commands and the language ----


@pytest.fixture(scope="module")
def books(spark):
    rows = [("books/a.md", ["#book", "#book/sf"], "A", 5, ["x", "y"], datetime.datetime(2024, 1, 10), "open"), ("books/b.md", ["#book"], "B", 0, [], datetime.datetime(2024, 1, 20), "open"), ("notes/c.md", ["#note"], "C", None, None, None, "done"), ("notes/d.md", ["#booklet"], "D", 3, ["y"], datetime.datetime(2023, 1, 1), "done")]
    return spark.createDataFrame(rows, "path string, tags array<string>, title string, rating int, genres array<string>, day timestamp, status string")


@pytest.fixture(scope="module")
def engine(spark, books):
    edges = spark.createDataFrame([("books/a.md", "notes/c.md"), ("notes/d.md", "notes/c.md")], "src string, dst string")
    return Engine(books, links=edges, clock=F.lit(CLOCK).cast("timestamp"), this={"path": "notes/c.md", "rating": 4})


@pytest.mark.parametrize("text, want", [
    ("LIST WITHOUT ID title FROM #book", ["A", "B"]), ("LIST WITHOUT ID title FROM #book/sf or #note", ["A", "C"]), ('LIST WITHOUT ID title FROM "notes" and -#note', ["D"]), ('LIST WITHOUT ID title FROM "books/a"', ["A"]),
    ("LIST WITHOUT ID title FROM [[notes/c.md]]", ["A", "D"]), ("LIST WITHOUT ID title FROM outgoing([[books/a.md]])", ["C"]), ("LIST WITHOUT ID title FROM [[]] and #book", ["A"]),
    ("LIST WITHOUT ID title WHERE rating", ["A", "D"]), ("LIST WITHOUT ID title WHERE genres", ["A", "D"]), ("LIST WITHOUT ID title WHERE !rating", ["B", "C"]), ("LIST WITHOUT ID title WHERE rating > this.rating", ["A"]),
    ("LIST WITHOUT ID title WHERE contains(genres, \"y\") AND rating < 5", ["D"]), ("LIST WITHOUT ID title WHERE day >= date(som)", ["A", "B"]), ("LIST WITHOUT ID title WHERE day < date(today) - dur(\"30 days\")", ["D"]), ("LIST WITHOUT ID title WHERE rating = null", ["C"]),
    ("LIST WITHOUT ID title WHERE any(genres, (g) => g = \"x\")", ["A"]), ("LIST WITHOUT ID title WHERE day.year = 2023", ["D"]), ("LIST WITHOUT ID title WHERE regextest(\"^[AB]$\", title) LIMIT 5", ["A", "B"]),
    ("LIST WITHOUT ID g FLATTEN genres AS g WHERE g", ["x", "y", "y"]), ("LIST WITHOUT ID title + \"!\" WHERE rating = 5", ["A!"]), ("LIST WITHOUT ID choice(rating, \"yes\", \"no\")", ["no", "no", "yes", "yes"]), ("LIST WITHOUT ID length(genres) WHERE genres", [1, 2]),
    ("LIST WITHOUT ID upper(genres)[0] WHERE genres // comment", ["X", "Y"]), ("LIST WITHOUT ID default(rating, 9) WHERE status = \"done\"", [3, 9]), ("LIST WITHOUT ID typeof(genres) LIMIT 1", ["array"]),
])
def test_language(engine, text, want):
    assert sorted((r[0] for r in engine.query(text).collect()), key=str) == want


def test_language_groups(engine, spark):
    direct = engine.query("TABLE length(rows) AS n, sum(rows.rating) AS s, max(rows.title) AS m GROUP BY status SORT status")
    assert [tuple(r) for r in direct.collect()] == [("done", 2, None, "D"), ("open", 2, 5.0, "B")]
    assert "collect_list" not in direct._jdf.queryExecution().optimizedPlan().toString()
    lists = engine.query("TABLE rows.title AS t GROUP BY status SORT status")
    assert [(r.status, sorted(r.t)) for r in lists.collect()] == [("done", ["C", "D"]), ("open", ["A", "B"])]


def test_language_order_of_commands(engine):
    assert [r.title for r in engine.query("TABLE WITHOUT ID title SORT title DESC LIMIT 2 SORT title").collect()] == ["C", "D"]
    assert [r.title for r in engine.query("TABLE WITHOUT ID title SORT rating DESC, title").collect()] == ["A", "D", "B", "C"]
    assert {r.day: r.rows for r in engine.query("CALENDAR day").collect()}[datetime.date(2024, 1, 10)] == 1
    assert engine.query("TABLE title, rating AS \"Stars\"").columns == ["path", "title", "Stars"]


def test_language_values_and_errors(engine, books):
    assert engine.value("round(sum([1, 2, 3.55]), 1)", books).first().value == 6.6
    assert engine.value('join(map(filter([1, 2, 3], (x) => x > 1), (x) => x * 2), "-")', books).first().value == "4-6"
    for bad in ("SHOW x", "LIST a, b", "TABLE x FROM", "LIST FROM #a WHERE", "TABLE nope(x)", "LIST x WHERE (a", "LIST `x`"):
        result, error = engine.try_query(bad)
        assert result is None and error, bad
    assert read("TABLE a.b + 1 AS c").columns[0][1] == "c"
    with pytest.raises(QueryError):
        Engine(books).query("LIST FROM [[x]]")


def test_shapes(spark, books):
    total = commands.with_total(books.select("title", "rating"), "title").where("is_total").first()
    assert (total.title, total.rating) == ("Total", 8.0)
    assert commands.flatten(books.select("title", "genres"), F.col("genres"), "genres").count() == 5
    runs = spark.createDataFrame([("u", datetime.date(2024, 1, d)) for d in (1, 2, 3, 7, 8, 20)], "k string, day date")
    got = sorted((r.start.day, r.end.day, r.days, r.cycle_days) for r in commands.cycle_lengths(commands.day_runs(runs, ["k"], "day"), ["k"]).collect())
    assert got == [(1, 3, 3, 6), (7, 8, 2, 13), (20, 20, 1, None)]
