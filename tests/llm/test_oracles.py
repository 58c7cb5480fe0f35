"""The queries with SQL against DuckDB, on small tables with nulls, empty and repeated texts, hot sources, and pages that link to each other."""

import random

import pytest

from tarn.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    words = ["".join(rng.choice("aeioubcdlmnré") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(1, 120)) for _ in range(150)]
    texts += [rng.choice(texts) for _ in range(40)] + [rng.choice(texts)[rng.randint(0, 50) :] + "\n" + prose(20) for _ in range(40)]
    texts += [None, "", " \t\n", "x" * 250, "ab" * 200, "ab" * 200, "a\nb\na\nb\n\n" * 30, "### ".join(prose(60).split()), (prose(9) + " ") * 9, "UPPER CASE " * 20, prose(4000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot"] * 8 + ["b", "c", "d", "", None]), len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    hosts = [f"h{i}.{rng.choice(['net', 'example.net', 'org', 'com', 'example.com', 'info'])}" for i in range(40)]
    pages = []
    for i in range(200):
        linked = "".join(f"<a {rng.choice(['href', 'HREF'])}={rng.choice(chr(34) + chr(39))}{rng.choice(['https:', 'HTTP:', ''])}//{rng.choice(hosts).upper()}/x?y'>z</a>" for _ in range(rng.randint(0, 4)))
        pages.append((i, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'de', ''])}/{i}", linked + "<a href='/here'>"))
    pages += [(900, None, None), (901, "no scheme", "<a href='http://h1.net'>"), (902, "http://", ""), (903, pages[0][1], None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(6)]) for i in range(300)] + [(400, None), (420, [0.0] * 6), (440, [1.0, None]), (460, [float("nan")] * 6), (None, [2.0, 1.0, 2.0, -1.0, 0.0, 1.0]), (None, [2.0, 1.0, 2.0, -1.0, 0.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, folder, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = connection.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    plain = lambda values: tuple((x is None, str(x)) for x in values)
    want = sorted(plain(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert sorted(names) == columns and sorted(plain(row[c] for c in columns) for row in found.collect()) == want
    if name == "op8_urls":
        assert {("block", True), ("block", False), ("allow", True), ("allow", False)} <= {(r.verdict, r.rule is None) for r in found.collect()}
