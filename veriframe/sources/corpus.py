"""S-01 to S-04, S-12, T-01: files of a corpus as retrievable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.functions.text import heading
from veriframe.tables import CHUNK

SIZE, OVERLAP = 700, 100
DERIVED = "_derived"
#: Folders that a source scan leaves out, and the suffixes it takes.
SKIPPED = ("node_modules", ".git", "dist", "build", "coverage", "vendor", "venv", ".venv", "__pycache__", "target", "out", ".next")
SUFFIXES = tuple("c cc cpp cs css dart ex exs go graphql h hpp html java js json jsx kt kts lua m mjs php pl proto py r rb rs sass scala scss sh sql svelte swift tf toml ts tsx vue xml yaml yml".split())


def pieces(text: str | Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """T-01: array of (start, text). One piece up to ``size`` code points, else one each ``size - overlap``, while any is left."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.length(text)
    starts = F.when(n > size, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array(F.lit(0)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(text, s + 1, F.lit(size)).alias("text")))


def sections(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """S-02: (doc, section number, section, body) between lines that begin with ``# `` or ``## ``; blank bodies are left out.

    A document's lines are numbered inside its row and a window by document groups them, so no document meets another.
    """
    lines = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")).alias("n", "line"))
    mark = F.col("line").startswith("## ") | F.col("line").startswith("# ")
    order = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("mark", mark).withColumn("sec", F.sum(F.col("mark").cast("int")).over(order))
    body = F.array_sort(F.collect_list(F.when(~F.col("mark"), F.struct("n", "line"))))
    whole = placed.groupBy("doc", "sec").agg(F.max(F.when(F.col("mark"), heading("line"))).alias("section"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("body"))
    return whole.select("doc", "sec", F.coalesce("section", F.lit("")).alias("section"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("body")).where("body <> ''")


def markdown_chunks(docs: DataFrame, source: str | Column, doc: str = "doc", text: str = "text") -> DataFrame:
    """S-02 and W-01: chunks of Markdown documents; ids are ``source:doc:ordinal``."""
    source = F.lit(source) if isinstance(source, str) else source
    parts = sections(docs, doc, text).select("doc", "sec", "section", F.posexplode(pieces("body")).alias("k", "p"))
    ordinal = F.row_number().over(Window.partitionBy("doc").orderBy("sec", "k")) - 1
    out = parts.withColumn("ordinal", ordinal).withColumn("source", source)
    return out.select(F.concat_ws(":", "source", "doc", F.col("ordinal").cast("string")).alias("id"), F.col("p.text").alias("text"), "source", "doc", "section", F.lit(None).cast(_meta()).alias("meta"), "ordinal")


def _meta() -> str:
    return CHUNK[CHUNK.index("struct<") :]


_JSON = (
    "threat_types map<string,struct<name:string,definition:string,nodes:map<string,struct<title:string,description:string>>>>,"
    "interactions array<struct<source:string,destination:string,applicable_threats:map<string,array<string>>>>,"
    "invalid_interactions array<struct<source:string,destination:string,reason:string>>,"
    "privacy_activities array<struct<id:string,name:string,linddun_types:array<string>,sub_activities:array<struct<id:string,name:string,description:string>>>>,"
    "contextual_domains array<struct<id:string,name:string,description:string>>,"
    "threats array<struct<id:bigint,title:string,threat_type:string,tree_node:string,originator_id:string,interaction:string,dfd_source_id:string,dfd_destination_id:string,description:string,assumptions:string,severity:string,likelihood:string>>"
)
_KEYS = ("threat_types", "interactions", "privacy_activities", "threats")


def json_chunks(docs: DataFrame, source: str | Column, doc: str = "doc", text: str = "text") -> DataFrame:
    """S-03: one chunk for each item of a JSON document; the first known top-level key decides its shape, none gives the raw text.

    Chunks are built in each row's arrays, in the order of the document; map keys keep their order in the text.
    """
    source = F.lit(source) if isinstance(source, str) else source
    e = F.lit("")
    meta = lambda **k: F.struct(*(k.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split(":", 1) for x in ("kind:string", "threat_type:string", "tree_node:string", "src:string", "dst:string", "panoptic_id:string", "parent_activity:string", "threat_id:bigint", "linddun_types:array<string>"))))
    item = lambda text, section, m: F.struct(F.trim(text).alias("text"), section.alias("section"), m.alias("meta"))
    j = F.from_json(F.col(text), _JSON)
    parsed = docs.select(F.col(doc).alias("doc"), F.col(text).alias("raw"), j.alias("j"), F.json_object_keys(text).alias("keys"))
    none = F.expr("array()").cast(f"array<struct<text:string,section:string,meta:{_meta()}>>")

    def tree(x: Column) -> Column:
        k, v = x["key"], x["value"]
        name = F.coalesce(v["name"], k)
        first = F.array(item(F.concat(F.lit("LINDDUN threat type "), k, F.lit(" ("), name, F.lit("): "), F.coalesce(v["definition"], e)), F.concat_ws(" ", k, name), meta(kind=F.lit("type_definition"), threat_type=k)))
        nodes = F.transform(F.map_entries(v["nodes"]), lambda n: item(F.concat(F.lit("Threat tree node "), n["key"], F.lit(" — "), F.coalesce(n["value"]["title"], e), F.lit(": "), F.coalesce(n["value"]["description"], e), F.lit(" (LINDDUN type: "), name, F.lit(")")), F.concat(n["key"], F.lit(" "), F.coalesce(n["value"]["title"], e)), meta(kind=F.lit("tree_node"), threat_type=k, tree_node=n["key"])))
        return F.concat(first, F.coalesce(nodes, none))

    def row(x: Column) -> Column:
        parts = F.array_join(F.transform(F.map_entries(x["applicable_threats"]), lambda p: F.concat(p["key"], F.lit(" at "), F.array_join(p["value"], "/"))), ", ")
        return item(F.concat(F.lit("Mapping table: interaction "), x["source"], F.lit(" -> flow -> "), x["destination"], F.lit(". Applicable LINDDUN threat types and positions: "), parts, F.lit(".")), F.concat(x["source"], F.lit("->"), x["destination"]), meta(kind=F.lit("mapping_row"), src=x["source"], dst=x["destination"]))

    def invalid(x: Column) -> Column:
        return item(F.concat(F.lit("Invalid interaction "), x["source"], F.lit(" -> "), x["destination"], F.lit(": "), x["reason"]), F.concat(F.lit("invalid "), x["source"], F.lit("->"), x["destination"]), meta(kind=F.lit("mapping_invalid")))

    def domain(x: Column) -> Column:
        return item(F.concat(F.lit("PANOPTIC Contextual Domain "), x["id"], F.lit(" ("), x["name"], F.lit("): "), F.coalesce(x["description"], e)), F.concat_ws(" ", x["id"], x["name"]), meta(kind=F.lit("panoptic_contextual_domain"), panoptic_id=x["id"]))

    def activity(x: Column) -> Column:
        types = F.coalesce(F.array_join(x["linddun_types"], ", "), e)
        own = F.array(item(F.concat(F.lit("PANOPTIC Privacy Activity "), x["id"], F.lit(" ("), x["name"], F.lit("). LINDDUN types: "), types, F.lit(".")), F.concat_ws(" ", x["id"], x["name"]), meta(kind=F.lit("panoptic_activity"), panoptic_id=x["id"], linddun_types=x["linddun_types"])))
        subs = F.transform(x["sub_activities"], lambda s: item(F.concat(F.lit("PANOPTIC sub-activity "), s["id"], F.lit(" — "), s["name"], F.lit(": "), F.coalesce(s["description"], e), F.lit(" (under "), x["id"], F.lit(" "), x["name"], F.lit("; LINDDUN types: "), types, F.lit(")")), F.concat_ws(" ", s["id"], s["name"]), meta(kind=F.lit("panoptic_sub_activity"), panoptic_id=s["id"], parent_activity=x["id"], linddun_types=x["linddun_types"])))
        return F.concat(own, F.coalesce(subs, none))

    def threat(x: Column) -> Column:
        where = F.coalesce(F.nullif(x["interaction"], e), F.concat(F.coalesce(x["dfd_source_id"], F.lit("?")), F.lit("->"), F.coalesce(x["dfd_destination_id"], F.lit("?"))))
        s = lambda n: F.coalesce(x[n], e)
        text_of = F.concat(F.lit("[Gold threat #"), x["id"].cast("string"), F.lit("] "), s("title"), F.lit(" ("), s("threat_type"), F.lit(", node "), s("tree_node"), F.lit(", originator "), s("originator_id"), F.lit(", interaction "), where, F.lit("). "), s("description"), F.lit(" Assumptions: "), s("assumptions"), F.lit(" Severity "), s("severity"), F.lit(", Likelihood "), s("likelihood"), F.lit("."))
        return item(text_of, F.concat(F.lit("threat #"), x["id"].cast("string"), F.lit(" "), s("title")), meta(kind=F.lit("gold_threat"), threat_id=x["id"], threat_type=x["threat_type"], tree_node=x["tree_node"]))

    has = lambda k: F.coalesce(F.array_contains("keys", k), F.lit(False))
    items = (
        F.when(has("threat_types"), F.flatten(F.transform(F.map_entries("j.threat_types"), tree)))
        .when(has("interactions"), F.concat(F.transform("j.interactions", row), F.coalesce(F.transform("j.invalid_interactions", invalid), none)))
        .when(has("privacy_activities"), F.concat(F.coalesce(F.transform("j.contextual_domains", domain), none), F.flatten(F.transform("j.privacy_activities", activity))))
        .when(has("threats"), F.transform("j.threats", threat))
        .otherwise(F.array(item(F.col("raw"), F.col("doc"), meta(kind=F.lit("raw_json")))))
    )
    out = parsed.select("doc", F.posexplode(items).alias("ordinal", "c")).withColumn("source", source)
    return out.select(F.concat_ws(":", "source", "doc", F.col("ordinal").cast("string")).alias("id"), "c.text", "source", "doc", "c.section", "c.meta", "ordinal")


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(doc, text): the text files below a folder; doc is the path below it."""
    base = folder.rstrip("/") + "/"
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.select(F.url_decode(F.element_at(F.split("path", F.regexp_replace(F.lit(base), r"([\[\](){}.*+?^$|\\])", r"\\$1")), -1)).alias("doc"), F.col("value").alias("text"))


def kept(doc: str | Column = "doc", source: str | None = None) -> Column:
    """S-01, S-04: not a diagram, not below a folder that derived output is written to (of the scenarios)."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    ok = F.element_at(F.split(doc, "/"), -1) != "dfd.json"
    return ok & ~F.element_at(F.split(doc, "/"), 1).endswith(DERIVED) if source == "scenarios" else ok


def corpus(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """S-01: chunks of all Markdown, text and JSON files of the corpora, with ``pos``, the order of source, path and ordinal."""
    parts = []
    for source, folder in folders.items():
        docs = files(spark, folder).where(kept("doc", source))
        low = F.lower("doc")
        parts.append(markdown_chunks(docs.where(low.endswith(".md") | low.endswith(".txt")), source))
        parts.append(json_chunks(docs.where(low.endswith(".json")), source))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """S-12: (doc, text, n_lines) of source files; folders of ``skipped`` names are left out."""
    docs = files(spark, folder)
    suffix = F.lower(F.element_at(F.split("doc", r"\."), -1))
    return docs.where(suffix.isin(*suffixes) & ~F.exists(F.split("doc", "/"), lambda p: p.isin(*skipped))).withColumn("n_lines", F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")) - F.when(F.col("text") == "", 1).otherwise(0))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """A-18: number of chunks by source and by kind, an untyped one counted as ``prose``."""
    kind = F.coalesce("meta.kind", F.lit("prose"))
    return chunks.groupBy(F.lit("source").alias("by"), F.col("source").alias("value")).count().unionByName(chunks.groupBy(F.lit("kind").alias("by"), kind.alias("value")).count())
