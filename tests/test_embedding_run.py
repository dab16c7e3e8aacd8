import json

import pytest

from gneiss import cli, config, runtime
from gneiss.streaming import embedding as em


class Busy(Exception):
    status = 429
    retry_after = 5.0


def test_errors_and_policy():
    assert [em.error_kind(x) for x in (em.ProviderError("x", 429), em.ProviderError("x", 503), em.ProviderError("x", 404), TimeoutError("t"), ConnectionError("c"), ValueError("v"))] == ["rate_limit", "server_error", "http_error", "timeout", "network", "other"]
    waits, calls = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise Busy("wait")
        return [[1.0]] * len(texts)

    assert em.Policy(4, 0.5).call(flaky, ["a", "b"], waits.append) == ([[1.0], [1.0]], 3, None)
    assert waits == [5.0, 5.0]
    assert em.Policy(4).call(lambda t: [], ["a"], waits.append) == (None, 1, "other")


def test_run_goes_on_and_repeats(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", "bad" if i == 3 else f"text {i}", "x") for i in range(8)] + [("c1", "again", "x")], "chunk_id string, content string, vec string").repartition(1)

    def embed(texts):
        if "bad" in texts:
            raise em.ProviderError("no", 400)
        return [[float(len(t))] for t in texts]

    path = str(tmp_path / "vectors")
    first = em.embed_pending(spark, chunks, path, embed, "v1", batch=1).first().asDict()
    assert (first["n_pending"], first["n_embedded"], first["n_failed"], first["n_failed_batches"], first["errors"]) == (8, 7, 1, 1, ["http_error"])
    again = em.embed_pending(spark, chunks, path, lambda t: [[0.0]] * len(t), "v1").first()
    assert (again.n_pending, again.n_embedded, again.success_rate) == (1, 1, 1.0)
    assert em.embed_pending(spark, chunks, path, lambda t: [[0.0]] * len(t), "v1").first().n_pending == 0
    assert em.embed_pending(spark, chunks, path, lambda t: [[0.0]] * len(t), "v2").first().n_pending == 8


def test_query_vectors():
    now, asked = [0.0], []

    def embed(q):
        asked.append(q)
        if q == "down":
            raise ConnectionError
        return [1.0]

    held = em.QueryVectors(embed, most=2, seconds=10, clock=lambda: now[0])
    assert held.get("v", "a") == [1.0] and held.get("v", "a") == [1.0] and asked == ["a"]
    assert held.get("v", "down") is None
    now[0] = 11
    held.get("v", "a")
    held.get("v", "b"), held.get("v", "c")
    assert asked == ["a", "down", "a", "b", "c"] and ("v", "a") not in held.held
    assert held.rates()["hit_rate"] == round(1 / 6, 4)


def test_settings(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"chunk": {"target": 99}, "new": [1]}))
    got = config.load(str(file), {"chunk": {"overlap": 1}})
    assert (got["chunk"]["target"], got["chunk"]["overlap"], got["chunk"]["min_lines"], got["new"]) == (99, 1, 5, [1])
    assert config.DEFAULTS["chunk"]["target"] == 512
    assert config.fingerprint({"a": 1, "b": {"c": 2}}) == config.fingerprint({"b": {"c": 2}, "a": 1}) != config.fingerprint({"a": 1})
    rules = {"defaults": {"x": 1, "y": 1}, "s": {"x": 2}, "r@1": {"y": 3}, "r|1": {"y": 4}}
    assert config.overridden(rules, "s", "r", "1") == {"x": 2, "y": 4}


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        conf = sparkContext = Context()

    Context._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()
    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_dir(Session())


def test_command_line(spark, capsys, tmp_path):
    data = "/root/testdata/sf0.001"
    assert cli.main(["validate", "--data", data], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 5
    assert cli.main(["find-entity", "class", "lexer", "--data", data], spark) == 0
    assert cli.main(["query", "ledger", "--mode", "semantic", "--top-k", "3", "--data", data], spark) == 0
    assert 0 < len([x for x in capsys.readouterr().out.splitlines() if "result_id" in x]) <= 3
    assert cli.main(["chunk", "--data", data, "--out", str(tmp_path / "chunks")], spark) == 0 and spark.read.parquet(str(tmp_path / "chunks")).count() > 0
    assert cli.main(["build-code-graph", "--data", data, "--out", str(tmp_path / "g")], spark) == 0
    assert cli.main(["query-structure", "def_of", "--data", data], spark) == 2 and "symbol_id" in capsys.readouterr().err
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text("package p;\nclass A { void f() {} }\n")
    assert cli.main(["ingest", "--tree", str(tmp_path / "src"), "--out", str(tmp_path / "t")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "t" / "symbols.parquet")).count() == 2
