"""Pages of a local server, read by tasks."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quillspark.sources import paged

N = 23


def work(i):
    return {"title": f"Work {i}", "publication_year": 2000 + i, "doi": None, "authorships": []}


@pytest.fixture()
def server():
    asked, broken = [], {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query, keep_blank_values=True).items()}
            asked.append(q)
            at = int(q["page"])
            if broken.get(at):
                broken[at] -= 1
                self.send_response(429 if broken.get("kind") == 429 else 500)
                self.end_headers()
                return
            low, high = int(q["from"] or 0) if "from" in q else 0, int(q["to"] or 9999) if "to" in q else 9999
            rows = [work(i) for i in range(N) if low <= 2000 + i <= high][at * 5 : at * 5 + 5]
            time.sleep(0.02 * (5 - at % 5))  # later pages answer first
            body = {"openalex": lambda: json.dumps({"results": rows}), "core": lambda: json.dumps({"results": [{"title": r["title"], "yearPublished": r["publication_year"]} for r in rows]}), "arxiv": lambda: "<feed>" + "".join(f"<entry><id>u</id><title>{r['title']}</title><published>{r['publication_year']}-01-01</published><summary>s</summary></entry>" for r in rows) + "</feed>"}[self.path.split("?")[0].strip("/")]()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", asked, broken
    httpd.shutdown()


def address(base, source):
    return base + f"/{source}?q={{query}}&page={{page}}&from={{year_from}}&to={{year_to}}"


def test_tasks_read_pages_in_order_with_years_in_the_request(spark, server):
    base, asked, _ = server
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = paged.scan(spark, "openalex", address(base, "openalex"), "a b", per_page=5, limit=40).where((F.col("year") >= 2003) & (F.col("year") < 2010))
    assert [json.loads(r.body)["results"][0]["title"] for r in sorted(found.collect(), key=lambda r: r.place)] == [f"Work {i}" for i in range(3, 10)]
    assert {q["from"] for q in asked} == {"2003"} and {q["to"] for q in asked} == {"2009"} and {q["q"] for q in asked} == {"a b"}
    assert sorted(int(q["page"]) for q in asked) == list(range(8))
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")  # without it the request is for all years, and the result the same
    found = paged.scan(spark, "openalex", address(base, "openalex"), "a b", per_page=5, limit=40).where("year >= 2003 AND year < 2010")
    assert found.count() == 7 and asked[-1]["from"] == ""


def test_search_over_sources(spark, server):
    base, asked, broken = server
    broken.update({2: 50})
    found, status = paged.search(spark, "x", {"openalex": address(base, "openalex"), "arxiv": address(base, "arxiv"), "core": None}, per_page=5, limit=20, attempts=0, delay=0)
    rows = found.orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    assert [r.title for r in rows] == [f"Work {i}" for i in range(10)] * 2  # what came before the page that failed, source by source
    said = {r.source: r.status for r in status.collect()}
    assert said["openalex"] == "ok (10 results)" and said["core"] == "skipped (no API key)" and list(said) == paged.SOURCES
    broken.update({2: 0, 0: 50})
    found, status = paged.search(spark, {"core": "x"}, {"core": address(base, "core")}, year_from=2001, per_page=5, limit=20, attempts=0, delay=0)
    assert found.isEmpty() and "error: OSError" in {r.source: r.status for r in status.collect()}["core"].replace("HTTPError", "OSError")
    broken.clear()
    found, _ = paged.search(spark, {"core": "x"}, {"core": address(base, "core")}, year_from=2001, year_to=2002, per_page=5, limit=20)
    assert [(r.title, r.year) for r in found.orderBy("ordinal").collect()] == [("Work 1", 2001), ("Work 2", 2002)]
    assert paged.search(spark, "x", {})[0].isEmpty()


def test_the_reader_tries_again_on_429(spark, server):
    base, asked, broken = server
    broken.update({1: 2, "kind": 429})
    assert paged.scan(spark, "openalex", address(base, "openalex"), "x", per_page=5, limit=10, attempts=3, delay=0).where("body IS NOT NULL").count() == 10
    assert sum(q["page"] == "1" for q in asked) == 3


def test_limits_cut_the_last_page(spark, server):
    assert paged.scan(spark, "openalex", address(server[0], "openalex"), "x", per_page=5, limit=7).count() == 7


def test_records_of_each_source():
    crossref = json.dumps({"message": {"items": [{"title": ["t"], "issued": {"date-parts": [[2020, 1]]}}, {"issued": {"date-parts": [[None]]}}, {}]}})
    assert [y for y, _ in paged.records("crossref", crossref)] == [2020, None, None]
    assert json.loads(paged.records("crossref", crossref)[0][1])["message"]["items"][0]["title"] == ["t"]
    assert paged.records("semantic_scholar", json.dumps({"data": None})) == [] and paged.records("openalex", "{}") == []


def test_stream_over_page_offsets(spark, server, tmp_path):
    base, _, _ = server
    spark.dataSource.register(paged.PageSource)
    rows = spark.readStream.format("paper_pages").option("source", "openalex").option("url", address(base, "openalex")).option("per_page", "5").option("limit", "40").option("pages_per_batch", "2").load()
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.place for r in got.collect()) == list(range(N))


def test_one_run_from_query_to_advice(spark, server, tmp_path):
    from quillspark.config import Config
    from quillspark.plans import pipelines as pl

    base, _, _ = server
    how = Config(results_per_source=20, retry_attempts=0, retry_delay=0.0, min_words=20, min_unique=5)
    asked = str(tmp_path / "asked")

    def fetch(url):
        with open(asked, "a") as out:
            out.write("x")
        return "Introduction\n" + " ".join(f"word{chr(97 + i % 26)} graph model accuracy" for i in range(40)) + "."

    run = pl.run_pipeline(spark, "graph work", {"arxiv": address(base, "arxiv"), "openalex": address(base, "openalex")}, str(tmp_path / "cache"), fetch, target=3, how=how, per_page=5)
    assert run.found.papers.count() == 3 and {r.source: r.status for r in run.sources.collect()}["arxiv"] == "ok (20 results)"
    assert run.found.validation.count() == 8 and len(open(asked).read()) <= 8  # one batch was judged, so no more was downloaded
    assert run.analysis.knowledge.count() == 3 and run.problems.status == "llm_unavailable" and run.compared.isEmpty() and run.advice.final.count() == 9
    none = pl.run_pipeline(spark, "x", {}, str(tmp_path / "cache"), fetch, how=how)
    assert none.found.papers.isEmpty() and none.analysis is None
