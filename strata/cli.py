"""Command line: ingest, ask, eval."""

from __future__ import annotations

import argparse
import os
from pathlib import Path

from pyspark.sql import functions as F

from strata import build
from strata.loop import Loop, Memory, model_router, reranked, structured_retriever
from strata.operators import graph, index
from strata.operators.chunking import chunk
from strata.operators.evidence import scored, totals
from strata.operators.memory import archived
from strata.operators.router import accuracy
from strata.session import session
from strata.sources import cases, settings
from strata.sources.corpus import read_corpus
from strata.sources.providers import HttpModel, ScriptedModel, embedded_by, offline_embedded
from strata.sources.tables import load_csv_folder


def model():
    """The endpoint that the settings name, or a stand-in that quotes the evidence."""
    if url := os.environ.get("LLM_BASE_URL"):
        return HttpModel(url, os.environ.get("LLM_MODEL", ""), os.environ.get("EMBED_MODEL", ""), os.environ.get("LLM_API_KEY", ""))
    return ScriptedModel(lambda messages: '{"sufficient": true}' if "JSON" in messages[0]["content"] else messages[-1]["content"])


def embedding() -> tuple:
    """(embedder of a table, its name): the endpoint's embedding model where one is named, else hashing."""
    name = os.environ.get("EMBED_MODEL", "")
    if name and os.environ.get("LLM_BASE_URL"):
        return (lambda df: embedded_by(df, model)), name
    return offline_embedded, "hash-64"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strata")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, **numbers: int) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flag in flags:
            p.add_argument(f"--{flag}", action="store_true")
        for flag, value in numbers.items():
            p.add_argument("-k" if flag == "k" else f"--{flag.replace('_', '-')}", type=int, default=value)
        return p

    p = command("ingest", "dry-run", "no-context", "hierarchy", "graph", chunk_tokens=800, min_words=0, branching=5)
    p.add_argument("--corpus", required=True)
    p.add_argument("--exclude", default="")
    p.add_argument("--index", required=True)
    p = command("ask", "trace", "retrieve-only", "llm-router", "rerank", k=5, max_steps=3, max_hops=graph.MAX_HOPS)
    p.add_argument("question")
    p.add_argument("--index", required=True)
    p.add_argument("--remember", default="", help="folder of a memory that is read and written")
    p.add_argument("--sql-dir", default="")
    p = command("eval", "llm-router", "rerank", "v", k=5, max_steps=3, max_hops=graph.MAX_HOPS, limit=0, jobs=build.JOBS)
    p.add_argument("what", choices=["routing", "answers", "retrieval"])
    p.add_argument("--router", choices=["keywords", "llm"], default="keywords")
    p.add_argument("--cases", default="")
    p.add_argument("--index", default="")
    p.add_argument("--sql-dir", default="")
    p.add_argument("--questions", default="", help="folder for the generated cases")
    return top


def known_replies(spark, path: str):
    place = build.artifact(path, "replies")
    table = spark.read.parquet(place) if build.exists(spark, place) else spark.createDataFrame([], "key string, value string")
    return table.dropDuplicates(["key"])


def remember_replies(told, path: str) -> None:
    """Newly made replies are added beside the index; what is there stays."""
    told.where("fresh AND value is not null").select("key", "value").write.mode("append").parquet(build.artifact(path, "replies"))


def retrievers(spark, args, llm, memory: Memory | None = None) -> dict:
    """A tier for each artifact that stands beside the index, and for the tables and the memory that were asked for."""
    embed, name = embedding()
    chunks = index.load(spark, args.index, name)
    semantic = lambda q, k: index.semantic(chunks, q, k, embed)
    out = {"semantic": reranked(spark, semantic, llm) if args.rerank else semantic}
    if build.exists(spark, place := build.artifact(args.index, "graph")):
        entities, edges, excerpts, aliases = graph.load(spark, place)
        out["relational"] = lambda q, k: graph.retrieve(entities, edges, excerpts, q, k, args.max_hops, aliases)
    if build.exists(spark, place := build.artifact(args.index, "hierarchy")):
        nodes = build.load_tree(spark, place, name)
        out["hierarchical"] = lambda q, k: build.hierarchical(nodes, q, k, embed)
    if args.sql_dir:
        out["structured"] = structured_retriever(spark, load_csv_folder(spark, args.sql_dir), llm)
    if memory is not None and memory.archive:
        rows = spark.createDataFrame(memory.archive, "seq long, text string").withColumn("added", F.current_timestamp())
        kept = index.ingest(archived(rows), embed=embed)
        out["memory"] = lambda q, k: index.semantic(kept, q, k, embed, "memory")
    return out


def ingest(spark, args, llm) -> None:
    docs = read_corpus(spark, args.corpus, tuple(x for x in args.exclude.split(",") if x)).persist()
    if docs.isEmpty():
        raise SystemExit(f"no .md or .txt files below {args.corpus}")
    tag, told = os.environ.get("LLM_MODEL", "") or "offline", known_replies(spark, args.index).persist()
    pieces = chunk(docs, args.chunk_tokens, least_words=args.min_words)
    if args.dry_run:
        print(index.plan(docs, told, tag, args.chunk_tokens, least_words=args.min_words).collect()[0].asDict())
        return
    contexts = None
    if not args.no_context:
        made = build.contexts(pieces, docs, told, model, tag)
        remember_replies(made, args.index)
        contexts = made.select("key", "value")
    embed, name = embedding()
    index.save(index.ingest(docs, args.chunk_tokens, least_words=args.min_words, contexts=contexts, tag=tag, embed=embed), args.index, name)
    chunks = index.load(spark, args.index)
    print({"documents": docs.count(), "chunks": chunks.count()})
    if args.graph:
        tables, replies, figures = build.build_graph(chunks, told, model, tag)
        replies.join(told.select("key"), "key", "left_anti").write.mode("append").parquet(build.artifact(args.index, "replies"))
        graph.save(build.artifact(args.index, "graph"), *tables)
        print(figures)
    if args.hierarchy:
        known = {r["key"]: r["value"] for r in spark.read.json(place).collect()} if build.exists(spark, place := build.artifact(args.index, "summaries")) else {}
        nodes, figures = build.build_tree(chunks, known, llm, tag, args.branching, embed)
        if known:
            spark.createDataFrame(list(known.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(place)
        build.save_tree(nodes, build.artifact(args.index, "hierarchy"), name)
        print(figures)


def evaluate_answers(spark, args, llm) -> None:
    asked = cases.read_answers(spark, args.cases)
    found = retrievers(spark, args, llm)
    loop = Loop(spark, found, llm, model_router(spark, llm) if args.llm_router else None, steps=args.max_steps, k=args.k)

    def one(r) -> tuple:
        try:
            a = loop.run(r["question"])
            return (r["query_id"], a.text, None), [(r["query_id"], e.tier, e.source_id) for e in a.evidence]
        except Exception as e:  # noqa: BLE001  a case's failure is its result
            return (r["query_id"], None, str(e)), []

    told = build.ordered_map(one, asked.collect(), args.jobs)
    answers = spark.createDataFrame([a for a, _ in told], "query_id string, answer string, error string")
    scores = scored(asked, answers, spark.createDataFrame([e for _, es in told for e in es], "query_id string, tier string, source_id string"))
    if args.v:
        for r in scores.join(asked.select("query_id", "question"), "query_id").orderBy(F.col("query_id").cast("int")).collect():
            print(f"{r['status']:9} {r['facts_found']}/{r['facts_total']} {r['question']}")
    print(totals(scores).collect()[0].asDict())


def evaluate_retrieval(spark, args, llm) -> None:
    embed, name = embedding()
    chunks = index.load(spark, args.index, name)
    some = index.entries(chunks).limit(args.limit) if args.limit else chunks
    told = build.needles(some, known_replies(spark, args.index), model, os.environ.get("LLM_MODEL", "") or "offline", jobs=args.jobs)
    remember_replies(told, args.index)
    semantic = lambda q, k: index.semantic(chunks, q, k, embed)
    figures, missed = build.needle_recall(told, reranked(spark, semantic, llm) if args.rerank else semantic, args.k)
    if args.v:
        for r in missed.orderBy("source_id").collect():
            print(f"missed {r['source_id']}: {r['text'][:70]}")
    print(figures)
    if args.questions:
        rows = told.where("value is not null").select(F.col("value").alias("question"), F.array().cast("array<string>").alias("must_include"), F.array("doc_id").alias("expect_sources"), F.concat(F.lit("made from "), "chunk_id").alias("note"))
        cases.write_cases(rows, args.questions)


def evaluate_routing(spark, args, llm) -> None:
    asked = cases.read_routing(spark, args.cases)
    if args.router == "llm":
        routed = model_router(spark, llm)
        known = ["structured", "semantic", "relational", "hierarchical"]
        rows = build.ordered_map(lambda r: (r["question"], r["expect"], routed(r["question"], known)[0]), asked.collect(), args.jobs)
        asked = spark.createDataFrame(rows, "question string, expect string, chosen array<string>")
    else:
        from strata.operators.router import route

        asked = asked.withColumn("chosen", route(F.col("question")))
    if args.v:
        for r in asked.collect():
            print(f"{'ok' if r['chosen'][0] == r['expect'] else 'MISS':4} {r['expect']:12} {','.join(r['chosen'])} {r['question']}")
    print(accuracy(asked, F.col("chosen")).collect()[0].asDict())


def ask(spark, args, llm) -> None:
    memory = Memory.load(spark, args.remember) if args.remember else None
    found = retrievers(spark, args, llm, memory)
    if args.retrieve_only:
        asked = spark.createDataFrame([("q", args.question)], "query_id string, text string")
        for tier in found:
            for r in found[tier](asked, args.k).orderBy("rank").collect():
                print(f"[{r['tier']}:{r['source_id']}] {r['score']:.4f} {r['text'][:120]}")
        return
    router = model_router(spark, llm) if args.llm_router else None
    answer = Loop(spark, found, llm, router, memory, steps=args.max_steps, k=args.k, write_back=memory is not None).run(args.question)
    print(answer.text)
    if args.trace:
        print(answer.trace.render())
    if memory:
        memory.save(spark, args.remember)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings.load(Path(".env"))
    spark, llm = session(), model()
    if args.command == "ingest":
        ingest(spark, args, llm)
    elif args.command == "ask":
        ask(spark, args, llm)
    else:
        {"routing": evaluate_routing, "answers": evaluate_answers, "retrieval": evaluate_retrieval}[args.what](spark, args, llm)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
