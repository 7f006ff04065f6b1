"""Identities, text functions, crawl predicates: literal cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from lorewell.functions import ids
from lorewell.functions import text as tx
from lorewell.operators import admin, cleaning, crawl, retrieval


@pytest.fixture
def of(spark):
    def run(fn, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]

    return run


def test_identities(of):
    urls = ["http://a.b:80/x/?q#f", "https://a.b", "https://a.b/", "https://a.b/c//"]
    assert of(ids.canonical_url, urls) == ["https://a.b:80/x", "https://a.b/", "https://a.b/", "https://a.b/c"]
    assert len(set(of(ids.doc_id, urls[1:3]))) == 1
    assert of(ids.object_key, ["https://A.b/x/y.html", "https://a.b/", "https://a.b/z.md"]) == ["a.b/x/y.html.md", "a.b/index.md", "a.b/z.md"]
    assert of(ids.sidecar_key, ["a/b.md"]) == ["a/b.meta.json"]
    assert of(ids.point_id, ["abc_0001", "é"]) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) for x in ("abc_0001", "é")]
    assert of(lambda v: ids.chunk_id(F.lit("d"), v), [3, 12345], "int") == ["d_0003", "d_12345"]


def test_tokens(of):
    assert of(tx.query_tokens, ["Who is the CS-3214 teacher?", "a the of", "", "ok, a!"]) == [["CS-3214", "teacher"], [], [], ["ok"]]
    assert of(tx.index_tokens, ["The CS-3214 x " + "y" * 21 + " éa"]) == [["the", "cs", "3214", "éa"]]
    assert of(tx.token_estimate, ["", "abc", "abcd", "é" * 9]) == [0, 0, 1, 2]
    assert of(tx.strip, ["  a b\n\t"]) == ["a b"]


def test_page_rules(of):
    assert of(tx.page_type, ["https://x/People/a", "https://x/courses/1", "https://x/labs/", "https://x/events/", "https://x/about", "https://x/y"]) == ["faculty", "course", "research", "news", "about", "general"]
    assert of(tx.is_error_page, ["# Resource at '/x' not found", "x\n#  Resource at 'a' not found", " # Resource at 'a' not found", "a" * 600 + "\n# Resource at 'a' not found"]) == [True, True, False, False]
    bodies = ["Friday, November 7, 2023", "Friday, Smarch 7, 2023", "none", "Monday, May 27, 2024"]
    assert of(lambda v: tx.is_stale(F.lit("https://x/News/Seminars/1"), v, F.to_date(F.lit("2024-06-01"))), bodies) == [True, False, False, False]
    assert of(lambda v: tx.is_stale(F.lit("https://x/other"), v, F.to_date(F.lit("2024-06-01"))), bodies[:1]) == [False]


def test_front_matter(of):
    doc = "---\ntitle: 'A: b'\nurl: \"u\"\ntitle: last\nno colon\n---\n\nbody"
    v = of(tx.front_matter_values, [doc, "plain"])
    assert v[0] == {"url": "u", "title": "last"} and v[1] is None
    assert of(tx.body_of, [doc, "plain", "---\nopen"]) == ["\n\nbody", "plain", "---\nopen"]


def test_contact(of):
    body = "# Ann Lee\nProfessor\n\nmail [ann@example.com](mailto:ann@example.com) call (540) 231-5555 Office: 12 Main Hall\n"
    got = of(tx.with_contact, [body, "no contact", "x bob@cs.example.com"])
    assert got[0].startswith("# Ann Lee\nProfessor\n\n\n**Contact Information:**\n- Email: ann@example.com\n- Phone: (540) 231-5555\n- Office: 12 Main Hall")
    assert got[1] == "no contact" and "- Email: bob@cs.example.com" in got[2] and got[2].endswith("x bob@cs.example.com")


def test_hosts(of):
    hosts = ["example.com", "a.b.example.com", "badexample.com", None, "", "login.example.com", "x.login.example.com"]
    assert of(crawl.host_allowed, hosts) == [True, True, False, False, False, False, False]


def test_links_out(of):
    assert of(tx.safe_url, ["HTTPS://x", "mailto:a@b", "javascript:1", 'http://x/"']) == ["HTTPS://x", "mailto:a@b", "#", "http://x/&quot;"]
    assert of(tx.html_from_markdown, ["## Hi\n**b** `c` [l](https://x) <i>"]) == ['<h2>Hi</h2><br><strong>b</strong> <code>c</code> <a href="https://x">l</a> &lt;i&gt;']
    html = "<html><nav>n</nav><h1>T</h1><p>a &amp; <a href=\"/x\">l</a></p><script>s</script></html>"
    assert of(tx.markdown_from_html, [html]) == ["# T\n\na & [l](/x)"]


def test_cleaner(spark):
    clean = "# Title\n\nText here.\n\n* [item](x)\n"
    chrome = "Site menu\n* [a](b)\n\n# Title\n\nText here.\nSearch this site\nx\n## Search filters\ny\n## Real\nBack to top\nz\n### Site footer\nfoot"
    df = spark.createDataFrame([(0, clean), (1, chrome)], "i int, body string")
    got = [r.body for r in cleaning.cleaned(df).orderBy("i").collect()]
    assert got == [clean, "# Title\n\nText here.\n## Real\nz"]


def test_cron_fields():
    assert admin.cron_fields("*/20 1-3 1,15 * 7")[0] == {0, 20, 40} and admin.cron_fields("0 0 * * 7")[4] == {0}
    for bad in ("* * * *", "61 * * * *", "a * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            admin.cron_fields(bad)


def test_embed_context(spark):
    row = spark.range(1).select(retrieval.embed_context(F.lit("T"), F.array(F.lit("A"), F.lit("B")), F.lit("x")).alias("a"), retrieval.embed_context(F.lit("T"), F.array().cast("array<string>"), F.lit("x")).alias("b")).first()
    assert row.a == "Title: T\nSection: B\nPath: A > B\n\nx" and row.b == "Title: T\n\nx"


def test_next_runs_of_many_schedules_are_made_once_an_expression(spark):
    """Nothing grows with days times schedules: no window or sort, and Python sees each expression once."""
    from datetime import datetime, timedelta

    crons = ["*/20 1-3 * * *", "5 0 31 * 1", "30 12 * * 1-5", "99 * * * *", None, "* * * * *", "0 0 29 2 *"]
    rows = spark.createDataFrame([(i, crons[i % 7], i % 5 != 0) for i in range(70)], "id long, cron string, enabled boolean")
    found = admin.cron_next_runs(rows, "2024-01-30 23:58:00", 4, 800)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan
    want, begin = [], datetime(2024, 1, 30, 23, 58)
    for i in range(70):
        if i % 5 and i % 7 not in (3, 4):
            m, h, d, mo, wd = admin.cron_fields(crons[i % 7])
            free = [p == "*" for p in crons[i % 7].split()]
            times = []
            for k in range(801):
                day = datetime(2024, 1, 30) + timedelta(days=k)
                on = (day.day in d, day.isoweekday() % 7 in wd)
                if day.month in mo and (any(on) if not free[2] and not free[4] else all(on)):
                    times += [t for t in (day + timedelta(hours=x, minutes=y) for x in sorted(h) for y in sorted(m)) if t > begin]
                if len(times) >= 4:
                    break
            want += [(i, k, t) for k, t in enumerate(times[:4], 1)]
    assert sorted(tuple(r) for r in found.select("id", "run", "run_at").collect()) == want


def test_python_strings_of_a_batch_are_few(spark):
    """Cleaner and embedder turn only a slice of an Arrow batch into Python strings; nulls and the order stay."""
    import numpy as np

    from lorewell.operators import index

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"Menu\nline {i}\nClose") for i in range(300)], "i int, v string").coalesce(1)
    found = rows.select("i", cleaning.without_chrome(F.col("v")).alias("x"))
    assert cleaning._PAGES < 300
    assert [r["x"] for r in found.orderBy("i").collect()] == [None if i % 7 == 0 else f"line {i}" for i in range(300)]
    one = index.embedder(lambda: lambda texts: np.array([[len(t), len(texts)] for t in texts], float), 2, 100)
    got = [tuple(r["x"]) for r in rows.select("i", one("v").alias("x")).orderBy("i").collect()]
    assert got == [(0.0 if i % 7 == 0 else float(len(f"Menu\nline {i}\nClose")), 100.0) for i in range(300)]
    none = rows.filter("i < 0").select(one("v").alias("x"), cleaning.without_chrome(F.col("v")).alias("y"))
    assert none.count() == 0
