"""Commands over files: python -m veriframe.cli COMMAND ...

build, stats, search, ask, eval, adjudicate, derive, enrich, verify-dfd, eval-dfd, verify-image, runs. ``ask``,
``generate``, ``extract`` and ``derive-image`` need a service or a parser from outside (see ``veriframe.boundary``); ask
prints the context that such a service would get.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.operators import metrics, raster, retrieval
from veriframe.operators.matching import match, unmatched
from veriframe.operators.validate import violations
from veriframe.plans import adapter
from veriframe.plans.evaluation import evaluate, evaluate_actions
from veriframe.session import session
from veriframe.sources import corpus, dfd, images, runs


def _show(df: DataFrame, n: int = 50) -> None:
    df.show(n, truncate=120)


def _chunks(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return corpus.corpus(spark, dict(x.split("=", 1) for x in a.corpus)).withColumn("kind", F.col("meta.kind"))


def _index(spark: SparkSession, a: argparse.Namespace) -> retrieval.Index:
    return retrieval.Index.load(spark, a.store, _chunks(spark, a), a.backend, key="id", section="section")


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    q = spark.createDataFrame([(0, a.query)], "query_id int, query string")
    index = _index(spark, a)
    hits = index.search(q, a.k, retrieval.keep(a.source, [None if x == "none" else x for x in a.exclude_kinds] or None))
    hits = hits.join(index.docs, "id").orderBy("rank")
    if a.command == "ask":
        print("\n\n".join(f"[{r['id']}] {r['section']}\n{r['text']}" for r in hits.collect()))
    else:
        _show(hits.select("rank", F.round("score", 4).alias("score"), "id", "section"))


def scenario(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    d = dfd.read_dfds(spark, a.dfd)
    return dfd.read_threats(spark, a.generated), dfd.read_gold(spark, a.gold), dfd.elements_of(d), dfd.flows_of(d)


def tree(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.format("text").option("wholetext", True).load(path)
    t = F.from_json("value", "threat_types map<string,struct<name:string,nodes:map<string,struct<title:string,description:string>>>>")["threat_types"]
    n = text.select(F.explode(t).alias("threat_type", "v")).select("threat_type", F.explode("v.nodes").alias("node_id", "n"))
    return n.select("threat_type", "node_id", "n.title", "n.description")


def run_eval(spark: SparkSession, a: argparse.Namespace) -> None:
    generated, gold, elements, flows = scenario(spark, a)
    nodes = tree(spark, a.trees)
    e = evaluate_actions(spark, generated, gold, elements, flows, nodes) if a.framework == "panoptic" else evaluate(spark, generated, gold, elements, flows, nodes, a.strict)
    print("\n".join(r["line"] for r in runs.report(e.scores).collect()))
    _show(e.citations)
    _show(e.reach)
    if a.by_node:
        _show(metrics.worst_nodes(e.nodes))


def _replaced(spark: SparkSession, path: str) -> None:
    """Puts ``path``.new in the place of ``path``."""
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{path}.new could not be renamed")


def adjudicate(spark: SparkSession, a: argparse.Namespace) -> None:
    generated, gold, _, flows = scenario(spark, a)
    pairs = match(generated, gold, flows)
    wrong = unmatched(generated, pairs).withColumn("label", F.lit(None).cast("string")).withColumn("note", F.lit(""))
    try:
        have = spark.read.json(a.worklist, schema=wrong.schema)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = wrong.limit(0)
    out = have if a.report_only else runs.topped_up(have, wrong, a.n, a.seed)
    if not a.report_only:
        # the old file is read while the new one is written beside it
        out.orderBy("gen_index").write.mode("overwrite").json(f"{a.worklist}.new")
        _replaced(spark, a.worklist)
        out = spark.read.json(a.worklist, schema=wrong.schema)
    _show(out.agg(*metrics.human_corrected(F.lit(pairs.count()), F.lit(wrong.count()))))


def derive(spark: SparkSession, a: argparse.Namespace) -> None:
    d = adapter.derive(spark, dfd.read_facts(spark, a.facts), a.out)
    if a.command == "derive":
        _show(d.elements.select("id", "type", "name"))
        _show(d.flows.select("id", "source", "destination", "description"))
    elif a.command == "enrich":
        _show(adapter.enrich(d.flows, d.elements, d.facts).select("id", "description"))
    elif a.command == "verify-dfd":
        _show(adapter.verify(d))
    else:
        hand = dfd.flows_of(dfd.read_dfds(spark, a.against))
        for df in adapter.score(spark, d, dfd.read_hand_keys(spark, a.keys), hand, a.out):
            _show(df)


def verify_image(spark: SparkSession, a: argparse.Namespace) -> None:
    d = dfd.read_dfds(spark, a.dfd)
    items = dfd.elements_of(d).select("id", "provenance").unionByName(dfd.flows_of(d).select("id", "provenance"))
    pictures = images.grey(images.read_images(spark, a.image)).select(F.lit("image").alias("image"), "width", "height", "grey")
    boxes = items.select(F.lit("image").alias("image"), F.col("id").alias("item"), F.explode("provenance").alias("p")).where("p.bbox is not null").select("image", "item", F.col("p.bbox").alias("box"))
    _show(raster.item_checks(items.select(F.lit("image").alias("image"), F.col("id").alias("item")), raster.box_checks(boxes, pictures, None if a.calibrate else 1.0)))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="veriframe", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    env = os.environ.get
    for name in ("build", "stats", "search", "ask"):
        s = sub.add_parser(name)
        if name in ("search", "ask"):
            s.add_argument("query")
        s.add_argument("--corpus", action="append", required=True, help="NAME=FOLDER")
        s.add_argument("--store", default="storage/index")
        s.add_argument("--backend", default=env("EMBEDDING_BACKEND", "bm25"))
        s.add_argument("--source")
        s.add_argument("-k", type=int, default=int(env("TOP_K", "0")))
        s.add_argument("--exclude-kinds", nargs="*", default=[x for x in env("RAG_EXCLUDE_KINDS", "").split(",") if x], help="none: untyped")
    for name in ("eval", "adjudicate"):
        s = sub.add_parser(name)
        for x in ("generated", "gold", "dfd"):
            s.add_argument(f"--{x}", required=True)
        if name == "eval":
            s.add_argument("--trees", required=True)
            s.add_argument("--framework", choices=("linddun", "panoptic"), default="linddun")
            s.add_argument("--strict", action="store_true")
            s.add_argument("--by-node", action="store_true")
        else:
            s.add_argument("--worklist", required=True)
            s.add_argument("--n", type=int)
            s.add_argument("--seed", type=int, default=42)
            s.add_argument("--report-only", action="store_true")
    for name in ("derive", "enrich", "verify-dfd", "eval-dfd"):
        s = sub.add_parser(name)
        s.add_argument("--facts", required=True)
        s.add_argument("--out", required=True)
        if name == "eval-dfd":
            s.add_argument("--against", required=True)
            s.add_argument("--keys", required=True)
    s = sub.add_parser("verify-image")
    s.add_argument("--dfd", required=True)
    s.add_argument("--image", required=True)
    s.add_argument("--calibrate", action="store_true")
    s = sub.add_parser("runs")
    s.add_argument("folder")
    a = p.parse_args(argv)
    spark = session("veriframe")
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "build":
        retrieval.Index.build(_chunks(spark, a), a.backend, key="id", section="section").save(a.store)
    elif a.command == "stats":
        _show(corpus.corpus_stats(_chunks(spark, a)))
    elif a.command in ("search", "ask"):
        search(spark, a)
    elif a.command == "eval":
        run_eval(spark, a)
    elif a.command == "adjudicate":
        adjudicate(spark, a)
    elif a.command == "verify-image":
        verify_image(spark, a)
    elif a.command == "runs":
        _show(runs.summary(runs.discover(runs.read_reports(spark, a.folder), a.folder), "scenario", "condition"))
    else:
        derive(spark, a)


def check(path: str, spark: SparkSession) -> list[str]:
    """Violations of diagram files, as text."""
    return [f"{r['rule']} {r['where']}: {r['message']}" for r in violations(dfd.read_dfds(spark, path)).collect()]


if __name__ == "__main__":
    main()
