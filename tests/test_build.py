"""What a model adds to an index, with a scripted model, and the command line over all of it."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from strata import build, cli
from strata.operators import index
from strata.sources.providers import ModelError, ScriptedModel

# Workers can't import this module: what it scripts goes to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAPERS = [
    ("kelp.md", "Kelp Watch counts forests off Senja. Runa Dahl leads Kelp Watch."),
    ("fog.md", "The fog horn at Senja is owned by Kelp Watch Society."),
    ("bad.md", "Nothing can be read from this one."),
]


def reply(messages):
    system, user = messages[0]["content"], messages[-1]["content"]
    if system == build.EXTRACT:
        if "Nothing can" in user:
            raise ModelError("down")
        if "Runa" in user:
            return json.dumps({"entities": [{"name": "Runa Dahl", "type": "person"}, {"name": "Watch Society", "type": "org"}], "relations": [{"from": "Runa Dahl", "relation": "leads", "to": "Kelp Watch"}]})
        return json.dumps({"entities": [], "relations": [{"from": "Fog horn", "relation": "is owned by", "to": "Kelp Watch Society"}]})
    if system == build.SAME:
        return '{"same": true}'
    if system == build.NEEDLE:
        return json.dumps({"question": "What does this passage say?" if "Nothing" in user else "Who leads Kelp Watch?" if "Runa" in user else "Who owns the fog horn?"})
    if system == build.SUMMARY:
        return "Kelp and fog around Senja."
    if system == build.CONTEXT:
        return "About Senja."
    return '{"sufficient": true}' if "JSON" in system else messages[-1]["content"]


def make():
    return ScriptedModel(reply)


@pytest.fixture(scope="module")
def chunks(spark):
    return index.ingest(spark.createDataFrame(PAPERS, "doc_id string, text string"), 40, None).persist()


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "key string, value string")


def test_ordered_map():
    assert build.ordered_map(lambda x: x * x, range(20), 3) == [x * x for x in range(20)]


def test_graph_from_a_model(chunks, none):
    (entities, edges, excerpts, aliases), grown, figures = build.build_graph(chunks, none, make)
    assert {k: figures[k] for k in ("chunks", "cached", "calls", "skipped", "relations")} == {"chunks": 3, "cached": 0, "calls": 2, "skipped": 1, "relations": 2} and "down" in figures["error"]
    assert figures["merges"] == [("watch society", "kelp watch society")] and figures["entities"] == 4
    assert excerpts.count() == 2 and aliases.count() == 1
    grown = grown.persist()
    again = build.build_graph(chunks, grown.withColumn("value", F.when(F.col("value").contains("Runa"), "not json").otherwise(F.col("value"))), make)[2]
    assert (again["cached"], again["calls"]) == (1, 1) and build.build_graph(chunks, grown, make)[2]["cached"] == 2


def test_coreference_votes(spark, none):
    pairs = spark.createDataFrame([("dahl", "runa dahl")], "variant string, canonical string")
    script = lambda *said: lambda: ScriptedModel(list(said))
    verdict = lambda *said: build.confirmed(pairs, none, script(*said)).collect()[0]
    yes, no, bad = '{"same": true}', '{"same": false}', ModelError("x")
    assert verdict(yes, no, yes)["value"] == "true" and verdict(yes, bad, no)["value"] == "false" and verdict(yes, bad, bad)["value"] == "false"
    assert verdict(bad, bad, bad)["value"] is None and verdict(bad, bad, bad)["error"] == "x"


def test_needles(chunks, none):
    told = build.needles(chunks, none, make)
    figures, missed = build.needle_recall(told, lambda q, k: index.semantic(chunks, q, k), 2)
    assert figures == {"chunks": 3, "skipped": 1, "generated": 2, "cached": 0, "probes": 2, "at_1": 2, "at_k": 2} and missed.count() == 0
    old = build.learnt(none, told)
    assert build.needle_recall(build.needles(chunks, old, make), lambda q, k: index.semantic(chunks, q, k), 2)[0]["cached"] == 2


def test_tree_and_its_search(spark, chunks, tmp_path):
    known: dict = {}
    nodes, figures = build.build_tree(chunks, known, make(), branching=2)
    assert figures["leaves"] == 3 and figures["summaries"] == nodes.count() == figures["calls"] + figures["cached"] > 0
    assert build.build_tree(chunks, known, make(), branching=2)[1]["calls"] == 0
    build.save_tree(nodes, f"{tmp_path}/t", "m")
    with pytest.raises(index.UnusableIndex):
        build.load_tree(spark, f"{tmp_path}/t", "other")
    asked = spark.createDataFrame([("q", "fog around Senja")], "query_id string, text string")
    best = build.hierarchical(build.load_tree(spark, f"{tmp_path}/t", "m"), asked, 1).collect()[0]
    assert best["tier"] == "hierarchical" and best["text"] == "Kelp and fog around Senja." and best["source_id"].startswith("L")
    assert build.artifact("/a/b/main.idx", "graph") == "/a/b/main-graph" and index.entries(chunks).first()["doc_id"] == "bad.md"
    assert index.add(chunks, chunks.limit(1)).count() == 3


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(cli, "model", make)
    monkeypatch.chdir(tmp_path)
    (tmp_path / "notes").mkdir()
    for name, text in PAPERS:
        (tmp_path / "notes" / name).write_text(text)
    at = ["--index", f"{tmp_path}/main"]
    cli.main(["ingest", "--corpus", f"{tmp_path}/notes", *at, "--dry-run"])
    assert "'calls': 3" in capsys.readouterr().out
    cli.main(["ingest", "--corpus", f"{tmp_path}/notes", *at, "--graph", "--hierarchy", "--branching", "2"])
    assert "'skipped': 1" in capsys.readouterr().out
    cli.main(["ask", "Who leads Kelp Watch?", *at, "--retrieve-only", "-k", "2"])
    out = capsys.readouterr().out
    assert "[semantic:kelp.md#0]" in out and "[relational:kelp.md#0]" in out and "[hierarchical:L1-" in out and "About Senja." in out
    cli.main(["eval", "retrieval", *at, "-k", "2", "--v", "--questions", f"{tmp_path}/made"])
    assert "'skipped': 1" in capsys.readouterr().out and spark.read.json(f"{tmp_path}/made").count() == 2
    (tmp_path / "r.json").write_text(json.dumps([{"question": "Who owns it?", "expect": "relational"}]))
    cli.main(["eval", "routing", "--cases", f"{tmp_path}/r.json", "--router", "llm"])
    assert "'n': 1" in capsys.readouterr().out
    (tmp_path / "a.json").write_text(json.dumps([{"question": "Who leads Kelp Watch?", "must_include": ["Runa"], "expect_sources": ["kelp.md"]}]))
    cli.main(["eval", "answers", *at, "--cases", f"{tmp_path}/a.json", "--v", "--jobs", "1"])
    assert "'passed': 1" in capsys.readouterr().out
