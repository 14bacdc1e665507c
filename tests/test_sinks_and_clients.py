"""Sinks by key and by fragments, and the HTTP client against a local server that fails, stalls and answers badly."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from rippletrace.operators import enrich
from rippletrace.plans.analyze import analyze, result, result_fragments
from rippletrace.sources import files as S

from . import fixture


def test_fragments_make_the_document(spark, tmp_path):
    tables = {k: v.cache() for k, v in analyze(*fixture.frames(spark)).items() if k in ("summary", "changes", "affected", "risks", "nodes", "edges")}
    want = {r.analysis_id: json.loads(r.body) for r in result(tables).collect()}
    pieces = result_fragments(tables)
    texts = {}
    for r in pieces.orderBy("analysis_id", "section", "place").collect():
        texts[r.analysis_id] = texts.get(r.analysis_id, "") + r.text
    assert {k: json.loads(t) for k, t in texts.items()} == want and max(len(r.text) for r in pieces.collect()) < 3000
    folder = str(tmp_path / "documents")
    for _ in range(2):
        S.save_fragments(pieces, folder)
    for key, document in want.items():
        at = f"{folder}/analysis_id={key}"
        text = "".join(open(f"{at}/{name}").read() for name in sorted(os.listdir(at)) if name.startswith("part-"))
        assert json.loads(text) == document


def test_fragments_of_empty_lists_and_heads(spark):
    head = spark.createDataFrame([("a", 1), ("b", None)], "analysis_id string, n int")
    rows = spark.createDataFrame([("b", 5, "x"), ("b", 7, None), ("c", 1, "y")], "analysis_id string, k int, v string")
    texts = {}
    for r in S.json_fragments(head, {"one": (rows, "k"), "two": (rows.where("false"), "k")}).orderBy("analysis_id", "section", "place").collect():
        texts[r.analysis_id] = texts.get(r.analysis_id, "") + r.text
    assert {k: json.loads(t) for k, t in texts.items()} == {"a": {"n": 1, "one": [], "two": []}, "b": {"n": None, "one": [{"k": 5, "v": "x"}, {"k": 7, "v": None}], "two": []}}
    bare = S.json_fragments(head.select("analysis_id"), {"one": (rows, "k")}).where("analysis_id = 'b'").orderBy("section", "place")
    assert json.loads("".join(r.text for r in bare.collect())) == {"one": [{"k": 5, "v": "x"}, {"k": 7, "v": None}]}


def test_keyed_tables_are_replaced_by_key(spark, tmp_path):
    folder = str(tmp_path)
    table = lambda *rows: {"t": spark.createDataFrame(rows, "analysis_id string, v int")}
    read = lambda: sorted((r.analysis_id, r.v) for r in spark.read.parquet(f"{folder}/t").collect())
    S.save_keyed(table(("a", 1), ("a", 2), ("b", 3)), folder)
    S.save_keyed(table(("b", 4), ("c", 5)), folder)
    assert read() == [("a", 1), ("a", 2), ("b", 4), ("c", 5)]
    bad = {"t": table(("a", 9), ("d", 9))["t"].withColumn("v", F.when(F.col("analysis_id") == "d", F.raise_error(F.lit("stopped")).cast("int")).otherwise(F.col("v")))}
    with pytest.raises(Exception, match="stopped"):
        S.save_keyed(bad, folder)
    assert read() == [("a", 1), ("a", 2), ("b", 4), ("c", 5)]
    for _ in range(2):  # run again
        S.save_keyed(table(("a", 9)), folder)
    assert read() == [("a", 9), ("b", 4), ("c", 5)]


def test_managed_and_plain_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "analysis_id string, v int")
    S.save_tables({"x": df, "y": df}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/y").collect() == df.collect()


@pytest.fixture
def server():
    """Answers by model; holds what was asked, and how many requests were open at once."""
    seen, now = [], {"open": 0, "most": 0}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            model, prompt = self.path.strip("/"), body["contents"][0]["parts"][0]["text"]
            with lock:
                seen.append((model, prompt, self.headers.get("Authorization")))
                now["open"] += 1
                now["most"] = max(now["most"], now["open"])
                times = sum(m == model and p == prompt for m, p, _ in seen)
            try:
                if model == "stalls":
                    time.sleep(1.5)
                code = {"fails": 500, "refuses": 400, "missing": 404}.get(model, 503 if model == "busy" and times < 3 else 200)
                text = {"bad": "no json", "blank": "  "}.get(model, json.dumps({"risks": [{"title": f"{model} on {prompt}", "severity": "high", "category": "type", "confidence": 0.5, "affectedSymbol": "s"}]}))
                if model == "slow":
                    time.sleep(0.2)
                answer = b"{" if model == "broken" else json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]} if model != "odd" else {"candidates": []}).encode()
                self.send_response(code)
                self.end_headers()
                self.wfile.write(answer)
            except OSError:
                pass  # the client went away
            finally:
                with lock:
                    now["open"] -= 1

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/{{model}}", seen, now
    http.shutdown()


def client(server, *models, **options):
    return enrich.HttpClient(server[0], list(models), **({"timeout": 0.5, "pause": 0.01} | options))


def test_models_are_asked_in_order(server):
    asked = lambda: [m for m, _, _ in server[1]]
    assert "good on p" in client(server, "refuses", "missing", "bad", "blank", "odd", "broken", "good", "never").analyze("p")
    assert asked() == ["refuses", "missing", "bad", "blank", "odd", "broken", "good"]  # none of these is asked twice
    server[1].clear()
    assert "busy on p" in client(server, "busy").enrich("p") and asked() == ["busy"] * 3
    server[1].clear()
    assert "good on p" in client(server, "fails", "stalls", "good", tries=2).analyze("p")
    assert asked() == ["fails"] * 2 + ["stalls"] * 2 + ["good"]
    assert client(server, "fails", "bad").analyze("p") == "" and enrich.HttpClient("http://127.0.0.1:9/{model}", ["x"], tries=2, pause=0).analyze("p") == ""


def test_keys_come_from_the_environment(server, monkeypatch):
    monkeypatch.setenv("OWN_KEY", "secret")
    assert client(server, "good", key_variable="OWN_KEY").analyze("p") and server[1][-1][2] == "Bearer secret"
    monkeypatch.delenv("OWN_KEY")
    with pytest.raises(ValueError, match="OWN_KEY"):
        client(server, "good", key_variable="OWN_KEY").analyze("p")


def test_asking_from_tasks_is_bounded_and_isolated(spark, server):
    prompts = spark.range(24).select(F.lit("a").alias("analysis_id"), F.col("id").alias("context_seq"), F.concat(F.lit("p"), "id").alias("prompt")).coalesce(1)
    rows = enrich.ask(prompts, client(server, "slow", at_once=3, timeout=5), "analyze").collect()
    assert [json.loads(r.answer)["risks"][0]["title"] for r in rows] == [f"slow on {r.prompt}" for r in rows] and server[2]["most"] == 3
    assert {r.answer for r in enrich.ask(prompts, client(server, "fails", tries=1), "enrich").collect()} == {""}
