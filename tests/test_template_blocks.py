"""Blocks, variables, nested calls and named templates."""

import pytest
from pyspark.sql import functions as F

from tarn.plans.templates import TemplateError, compile_template, render

SCHEMA = "title string, gone string, n int, zero int, yes boolean, tags array<string>, none array<string>, rows array<struct<a: string, b: struct<c: int>, l: array<int>>>, m map<string, int>, o struct<p: string, q: struct<r: int>>"
ROW = ("T", None, 3, 0, True, ["x", "y"], [], [("1", (10,), [1, 2]), ("2", (None,), [])], {"b": 2, "a": 1}, ("P", (7,)))


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([ROW], SCHEMA).repartition(1)


@pytest.mark.parametrize("text, want", [
    ("{{range .tags}}\n- #{{.}}\n{{end}}", "\n- #x\n\n- #y\n"), ("{{range .none}}a{{else}}b{{end}}{{range .gone}}{{end}}", None), ("{{ range $i, $t := .tags }}{{ $i }}={{ $t }};{{ end }}", "0=x;1=y;"), ("{{ range $t := .tags }}{{ $t }}{{ . }}{{ end }}", "xxyy"),
    ("{{ range .rows }}{{ .a }}:{{ .b.c }}[{{ range .l }}{{ . }}{{ $.title }}{{ end }}] {{ end }}", "1:10[1T2T] 2:<no value>[] "), ("{{ range $k, $v := .m }}{{ $k }}{{ $v }} {{ end }}", "a1 b2 "), ("{{ range .n }}{{ . }}{{ end }}{{ range 2 }}!{{ end }}", "012!!"),
    ("{{ with .o }}{{ .p }}{{ .q.r }}{{ $.title }}{{ end }}{{ with .gone }}x{{ else with .title }}{{ . }}{{ else }}z{{ end }}", "P7TT"), ("{{ with $x := .o.q }}{{ $x.r }}{{ .r }}{{ end }}", "77"), ("{{ $x := .title }}{{ range .tags }}{{ $x }}{{ $x := . }}{{ $x }}{{ end }}{{ $x }}", "TxTyT"),
    ("{{ $x := 1 }}{{ $x = 2 }}{{ $x }}", "2"), ("{{ if .zero }}a{{ else if .gone }}b{{ else if .yes }}c{{ else }}d{{ end }}", "c"), ("{{ if $x := .title }}{{ $x }}{{ end }}", "T"), ("{{ toUpper (printf \"%v-%v\" .o.p (len .tags)) }}", "P-2"), ("{{ (index .rows 1).a }}{{ index .m \"b\" }}{{ index .tags 9 }}", "22<no value>"),
    ("{{ if and .title (gt .n 2) (not .gone) }}y{{ end }}{{ or .gone .title }}{{ and .title .zero }}", "yT0"), ("{{ if or (eq .title \"a\" \"T\") false }}y{{ end }}{{ if le .n 3 }}z{{ end }}{{ if ge .n 4 }}w{{ end }}", "yz"), ("{{ (.title | toLower) | printf \"<%v>\" }}", "<t>"),
    ("{{ define \"d\" }}[{{ . }}]{{ end }}{{ template \"d\" .title }}{{ range .tags }}{{ template \"d\" . }}{{ end }}", "[T][x][y]"), ("{{ block \"b\" .o }}{{ .p }}{{ end }}", "P"), ("{{ len .tags }}{{ len .m }}{{ len .title }}{{ len \"abc\" }}{{ slice .title 0 1 }}{{ range slice .tags 1 }}{{ . }}{{ end }}", "2213Ty"),
    ("a  {{- range .tags -}}  {{ . }}  {{- end -}}  b", "axyb"), ("{{ print .title 1 }}{{ println .title .n }}", "T1T 3\n"), ("{{ $.o.q.r }}", "7"),
])
def test_rendered(df, text, want):
    if want is None:
        with pytest.raises(TemplateError, match="needs a list"):
            render(df, text)
        return
    assert render(df, text).first().rendered == want


@pytest.mark.parametrize("text, reason", [
    ("x\n{{ range .tags }}", "line 2: missing end"), ("{{ else }}", "unexpected else"), ("{{ if .n }}{{ else }}{{ else }}{{ end }}", "unexpected else"), ("{{ range .tags }}{{ else if .n }}{{ end }}", "unexpected else if"), ("{{ $x }}", "undefined variable"),
    ("{{ with .n }}{{ $y := 1 }}{{ end }}{{ $y }}", "undefined variable"), ("{{ $x := 1 }}{{ range .tags }}{{ $x = 2 }}{{ end }}", "new value inside range"), ("{{ template \"t\" }}", "not defined"), ("{{ define \"t\" }}{{ template \"t\" . }}{{ end }}{{ template \"t\" .n }}", "calls itself"),
    ("{{ (len .tags }}", "unclosed"), ("{{ len .tags) }}", r"unexpected \)"), ("{{ . }}", "name a field"), ("{{ range .title }}{{ end }}", "needs a list"), ("{{ range .tags }}{{ .a }}{{ end }}", "has no field"), ("{{ break }}", "not supported"), ("{{ index }}", "wrong arguments"), ("{{ .n .n }}", "not defined"), ("{{ | len }}", "missing value"),
])
def test_refused(df, text, reason):
    with pytest.raises(TemplateError, match=reason):
        render(df, text)


def test_no_rows_are_exploded(df):
    plan = render(df, "{{ range .rows }}{{ range .l }}{{ . }}{{ end }}{{ end }}")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortAggregate" not in plan and "ObjectHash" not in plan


def test_types_may_be_unknown(spark):
    df = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("t"), F.lit(None).cast("array<string>").alias("u"))
    assert df.select(compile_template("{{ range .t }}{{ . }}{{ end }}{{ range .u }}{{ else }}-{{ end }}")).first()[0] == "ab-"
