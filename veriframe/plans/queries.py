"""The registered queries: operators applied to the tables of a folder, each with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.functions import text as X
from veriframe.functions.logic import verdict
from veriframe.operators import accept, align, crosswalk, facts, matching, metrics, retrieval, threats
from veriframe.sources import corpus, runs
from veriframe.streaming import incremental
from veriframe.tables import THREAT_TYPES, VALID_PAIRS, invalid_pairs, load, mapping, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_TOK = X.TOKEN
_D_TERMS = f"SELECT doc_id, lower(t) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOK}')) AS t FROM documents) WHERE lower(t) NOT IN {_STOP}"
_Q_TERMS = f"SELECT DISTINCT item_id AS query_id, lower(t) AS term FROM (SELECT item_id, unnest(regexp_extract_all(text, '{_TOK}')) AS t FROM benchmark) WHERE lower(t) NOT IN {_STOP}"
_BM25 = f"""
dt AS ({_D_TERMS}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS len FROM dt GROUP BY ALL),
n AS (SELECT count(*) AS n_docs, (SELECT count(*) FROM dt) / count(*) AS avg_len FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
idf AS (SELECT term, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf, n_docs, avg_len FROM df, n),
qt AS ({_Q_TERMS}),
s AS (SELECT query_id, tf.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
      FROM tf JOIN idf USING (term) JOIN len USING (doc_id) JOIN qt USING (term) GROUP BY ALL)"""
_TOP5 = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM full_) WHERE rank <= 5"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("""
SELECT doc_id, start::BIGINT AS start, length(substr(text, start + 1, 700))::BIGINT AS len, md5(substr(text, start + 1, 700)) AS digest
FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) > 700 THEN range(0, length(text), 600) ELSE [0] END) AS start FROM documents)
""")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """T-01, N15."""
    p = spread(load(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(corpus.pieces("text")).alias("p"))
    return p.select("doc_id", F.col("p.start").cast("bigint").alias("start"), F.length("p.text").cast("bigint").alias("len"), F.md5("p.text").alias("digest"))


@query("""
WITH lines AS (SELECT conv_id, turn, unnest(list_concat(['## ' || role], string_split(text, chr(10)))) AS line, generate_subscripts(list_concat(['## ' || role], string_split(text, chr(10))), 1) AS k FROM conversations),
m AS (SELECT *, (line LIKE '## %' OR line LIKE '# %')::INT AS mark FROM lines),
s AS (SELECT *, sum(mark) OVER (PARTITION BY conv_id ORDER BY turn, k ROWS UNBOUNDED PRECEDING) AS sec FROM m),
g AS (SELECT conv_id, sec, coalesce(max(CASE WHEN mark = 1 THEN trim(ltrim(line, '# ')) END), '') AS section,
             regexp_replace(string_agg(CASE WHEN mark = 0 THEN line END, chr(10) ORDER BY turn, k), '^\\s+|\\s+$', '', 'g') AS body FROM s GROUP BY conv_id, sec)
SELECT conv_id, sec::BIGINT AS sec, section, length(body)::BIGINT AS len, md5(body) AS digest FROM g WHERE body <> ''
""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    """S-02, W-08, F-01: a conversation as a document whose headings are the roles."""
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    s = corpus.sections(c, "conv_id")
    return s.select(F.col("doc").alias("conv_id"), F.col("sec").cast("bigint").alias("sec"), "section", F.length("body").cast("bigint").alias("len"), F.md5("body").alias("digest"))


@query(f"""WITH {_BM25}, full_ AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM s UNION ALL SELECT item_id, doc_id, 0 FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10)) GROUP BY ALL) {_TOP5}""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """R-01 to R-04, J-33, W-03, N17."""
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return _found(retrieval.Index.build(docs).search(_asked(spark, d), hybrid=False))


_TFIDF = f"""
w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN {_STOP}) AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 20000),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS x FROM tf JOIN v USING (term)),
dn AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM dw GROUP BY ALL),
q0 AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN {_STOP}) AS w FROM benchmark),
qg AS (SELECT query_id, unnest(w) AS term FROM q0 UNION ALL SELECT query_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM q0),
qw AS (SELECT query_id, term, (1 + ln(count(*))) * any_value(idf) AS x FROM qg JOIN v USING (term) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(x * x)) AS norm FROM qw GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(dw.x / dn.norm * qw.x / qn.norm) AS score FROM dw JOIN dn USING (doc_id) JOIN qw USING (term) JOIN qn USING (query_id) GROUP BY ALL)"""


@query(f"""WITH {_TFIDF}, full_ AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM s UNION ALL SELECT item_id, doc_id, 0 FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10)) GROUP BY ALL) {_TOP5}""")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """R-05, W-03."""
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return _found(retrieval.Index.build(docs, "tfidf").search(_asked(spark, d), hybrid=False))


_KW = f"""
qk AS (SELECT DISTINCT item_id AS query_id, lower(t) AS token FROM (SELECT item_id, unnest(regexp_extract_all(text, '{_TOK}')) AS t FROM benchmark)),
dk AS (SELECT DISTINCT doc_id, lower(t) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOK}')) AS t FROM documents)),
kw AS (SELECT query_id, doc_id, count(*) / any_value(n) AS kw FROM dk JOIN qk USING (token) JOIN (SELECT query_id, count(*) AS n FROM qk GROUP BY ALL) USING (query_id) GROUP BY ALL)"""


@query(f"""WITH {_KW} SELECT query_id, doc_id, round(kw, 6) AS kw FROM kw""")
def keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    """R-07: all pairs that share a token."""
    kw = retrieval.keyword_overlap(spread(load(spark, d, "documents").select("doc_id", "text")), _asked(spark, d), few=True)
    return kw.select("query_id", "doc_id", F.round("kw", 6).alias("kw"))


@query(f"""WITH {_BM25}, {_KW}, p AS (SELECT query_id, max(score) AS peak FROM s GROUP BY ALL),
b AS (SELECT query_id, doc_id, sum(x) AS score FROM (SELECT query_id, doc_id, 0.8 * CASE WHEN peak > 0 THEN score / peak ELSE score END AS x FROM s JOIN p USING (query_id) UNION ALL SELECT query_id, doc_id, 0.2 * kw FROM kw) GROUP BY ALL),
e AS (SELECT * FROM documents WHERE lang = 'en'),
full_ AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT b.* FROM b JOIN e USING (doc_id) UNION ALL SELECT item_id, doc_id, 0 FROM benchmark, (SELECT doc_id FROM e ORDER BY doc_id LIMIT 10)) GROUP BY ALL) {_TOP5}""")
def hybrid_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """R-08, W-02, P-05, N11: the peak is over all documents, the filter after it."""
    docs = spread(load(spark, d, "documents").select("doc_id", "text", "lang"))
    return _found(retrieval.Index.build(docs).search(_asked(spark, d), where=F.col("lang").eqNullSafe("en")))


@query("""
SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5
""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """R-06: the queries are the vectors whose id is divisible by 20."""
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    out = retrieval.cosine_top_k(v, v.where("vec_id % 20 = 0"))
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("""
SELECT 'source' AS "by", source AS value, count(*) AS count FROM documents GROUP BY source
UNION ALL SELECT 'kind', CASE WHEN lang = 'en' THEN 'prose' ELSE lang END, count(*) FROM documents GROUP BY 2
""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """A-18: documents as chunks whose kind is the language, English untyped."""
    return corpus.corpus_stats(load(spark, d, "documents").select("source", F.struct(F.when(F.col("lang") != "en", F.col("lang")).alias("kind")).alias("meta")))


@query(f"""WITH {_BM25.split("qt AS")[0].rstrip().rstrip(",")} SELECT term, df, round(idf, 6) AS idf, round(avg_len, 6) AS avg_len FROM idf""")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    """A-19."""
    return retrieval.bm25_statistics(spread(load(spark, d, "documents").select("doc_id", "text"))).select("term", "df", F.round("idf", 6).alias("idf"), F.round("avg_len", 6).alias("avg_len"))


# events as threats: the first half of the month is the catalog, the second what was generated
_TYPES = {"click": "L", "view": "I", "purchase": "Nr", "error": "D", "signup": "Dd"}
_TYPE_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items()) + " END"
_GG = f"""
e AS (SELECT event_id, ts, user_id, {_TYPE_SQL} AS threat_type, {_TYPE_SQL} || '.' || (event_id % 3) AS tree_node FROM events),
gold AS (SELECT * FROM e WHERE ts < '2024-01-16'), gen AS (SELECT * FROM e WHERE ts >= '2024-01-16'),
pairs AS (SELECT a.event_id AS gen_index, b.event_id AS gold_id FROM
  (SELECT *, row_number() OVER (PARTITION BY threat_type, user_id ORDER BY event_id) AS n FROM gen) a JOIN
  (SELECT *, row_number() OVER (PARTITION BY threat_type, user_id ORDER BY event_id) AS n FROM gold) b USING (threat_type, user_id, n)),
out_ AS (SELECT threat_type, tree_node, (gold_id IS NOT NULL)::INT AS tp, (gold_id IS NULL)::INT AS fp, 0 AS fn FROM gen LEFT JOIN pairs ON event_id = gen_index
  UNION ALL SELECT threat_type, tree_node, 0, 0, 1 FROM gold WHERE event_id NOT IN (SELECT gold_id FROM pairs))"""
_PRF = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


def _type_of(c: str = "event_type") -> Column:
    out = F.lit(None).cast("string")
    for a, b in _TYPES.items():
        out = F.when(F.col(c) == a, b).otherwise(out)
    return out


def _threats(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, d, "events").withColumn("threat_type", _type_of()).withColumn("tree_node", F.concat("threat_type", F.lit("."), (F.col("event_id") % 3).cast("string")))
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    gold = e.where(~late).select(F.col("event_id").alias("id"), F.col("event_id").alias("pos"), "threat_type", "tree_node", F.concat(F.lit("user ["), F.lit("DF"), F.col("user_id").cast("string"), F.lit("]")).alias("interaction"), *(F.lit(None).cast("string").alias(c) for c in ("dfd_source_id", "dfd_destination_id")))
    gen = e.where(late).select(F.col("event_id").alias("gen_index"), "threat_type", "tree_node", F.concat(F.lit("DF"), F.col("user_id").cast("string")).alias("flow_id"))
    return gen, gold


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("category", *(F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_GG} SELECT * FROM pairs")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """J-05, J-06, F-02, P-18, W-07, N9."""
    return matching.match(*_threats(spark, d))


@query(f"WITH {_GG.replace('PARTITION BY threat_type, user_id', 'PARTITION BY threat_type, user_id, tree_node').replace('USING (threat_type, user_id, n)', 'USING (threat_type, user_id, tree_node, n)')} SELECT gen_index, gold_id FROM pairs")
def greedy_match_strict(spark: SparkSession, d: str) -> DataFrame:
    """J-06, strict."""
    return matching.match(*_threats(spark, d), strict=True)


@query(f"WITH {_GG} SELECT event_id AS gen_index, threat_type, tree_node, 'DF' || user_id AS flow_id FROM gen WHERE event_id NOT IN (SELECT gen_index FROM pairs)")
def false_positives(spark: SparkSession, d: str) -> DataFrame:
    """J-08."""
    gen, gold = _threats(spark, d)
    return matching.unmatched(gen, matching.match(gen, gold))


@query(f"""WITH {_GG}, c AS (SELECT t.threat_type AS category, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn
  FROM (SELECT unnest({list(THREAT_TYPES)}) AS threat_type) t LEFT JOIN out_ USING (threat_type) GROUP BY ROLLUP (t.threat_type))
SELECT coalesce(category, 'ALL') AS category, tp, fp, fn, {_PRF} FROM c""")
def confusion_by_type(spark: SparkSession, d: str) -> DataFrame:
    """A-01, A-04, A-05, N1, N7: over the fixed domain of seven types, two of which have no row."""
    gen, gold = _threats(spark, d)
    return _rounded(metrics.by_type(gen, gold, matching.match(gen, gold)))


@query(f"WITH {_GG}, c AS (SELECT tree_node AS category, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM out_ GROUP BY ALL) SELECT *, {_PRF} FROM c")
def confusion_by_node(spark: SparkSession, d: str) -> DataFrame:
    """A-02."""
    gen, gold = _threats(spark, d)
    return _rounded(metrics.by_node(gen, gold, matching.match(gen, gold)))


@query(f"WITH {_GG}, c AS (SELECT tree_node AS category, sum(fn)::BIGINT AS fn FROM out_ GROUP BY ALL) SELECT * FROM c WHERE fn > 0 ORDER BY fn DESC, category LIMIT 10")
def worst_nodes(spark: SparkSession, d: str) -> DataFrame:
    """O-05: a top ten."""
    gen, gold = _threats(spark, d)
    return metrics.worst_nodes(metrics.by_node(gen, gold, matching.match(gen, gold))).select("category", F.col("fn").cast("bigint").alias("fn"))


# the fold of each user's events: the list of gold rows taken so far goes from one generated row to the next
_GREEDY = f"""
o AS (SELECT *, list_position(['D', 'Dd', 'I', 'L', 'Nr'], threat_type) AS a FROM (SELECT event_id, ts, user_id, {_TYPE_SQL} AS threat_type FROM events)),
gl AS (SELECT user_id, list({{'id': event_id, 'a': a, 'b': a % 5 + 1}} ORDER BY event_id) AS gold FROM o WHERE ts < '2024-01-16' GROUP BY ALL),
gn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM o WHERE ts >= '2024-01-16'),
walk AS (
  SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS gen_index, NULL::BIGINT AS gold_id FROM gl
  UNION ALL
  SELECT user_id, k, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, event_id, hit
  FROM (SELECT w.user_id, gn.k, w.used, gn.event_id, list_filter(gold, lambda x: (x.a = gn.a OR x.b = gn.a) AND NOT list_contains(w.used, x.id))[1].id AS hit
        FROM walk w JOIN gn ON gn.user_id = w.user_id AND gn.k = w.k + 1 JOIN gl ON gl.user_id = w.user_id))"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT gen_index, gold_id FROM walk WHERE gold_id IS NOT NULL")
def greedy_match_actions(spark: SparkSession, d: str) -> DataFrame:
    """J-07, U-05: membership matching; a user's events are the flow, the catalog's actions two neighbouring types."""
    gen, gold = _threats(spark, d)
    names = F.array(*(F.lit(x) for x in ("D", "Dd", "I", "L", "Nr")))
    at = F.array_position(names, F.col("threat_type")).cast("int")
    gold = gold.withColumn("panoptic_actions", F.array(F.col("threat_type"), F.element_at(names, at % 5 + 1)))
    flows = load(spark, d, "events").select(F.concat(F.lit("DF"), F.col("user_id").cast("string")).alias("id"), F.lit(0).alias("pos"), F.lit("").alias("source"), F.lit("").alias("destination")).distinct()
    return matching.match_actions(gen.withColumn("panoptic_action", F.col("threat_type")), gold, flows)


@query(f"""WITH c AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS category, count(*) FILTER (n_chars > 1000 AND toxic = 1) AS tp, count(*) FILTER (n_chars > 1000 AND toxic = 0) AS fp, count(*) FILTER (n_chars <= 1000 AND toxic = 1) AS fn
FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT *, {_PRF} FROM c""")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    """A-01, A-04: a length rule against labels; documents without a label drop out."""
    j = load(spark, d, "documents").select("doc_id", "n_chars").join(load(spark, d, "labels"), "doc_id")
    long, toxic = F.col("n_chars") > 1000, F.col("toxic") == 1
    c = j.groupBy(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("category")).agg(F.count_if(long & toxic).alias("tp"), F.count_if(long & ~toxic).alias("fp"), F.count_if(~long & toxic).alias("fn"))
    return _rounded(metrics.scored(c))


# customers, orders and suppliers as a diagram
_ELEMENT = "CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'Process' WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'ExternalEntity' ELSE 'DataStore' END"
_DFD = f"""
el AS (SELECT 'C' || c_custkey AS id, c_name AS name, {_ELEMENT} AS type FROM customer),
fl AS (SELECT 'F' || o_orderkey AS id, o_orderkey AS pos, 'C' || o_custkey AS source, 'C' || (o_custkey * 7 + o_orderkey % 5) % (SELECT count(*) + 3 FROM customer) AS destination FROM orders),
ends AS (SELECT fl.*, s.type AS source_type, t.type AS dest_type FROM fl LEFT JOIN el s ON s.id = source LEFT JOIN el t ON t.id = destination),
valid AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in VALID_PAIRS)}) v(source_type, dest_type)),
ctx AS (SELECT ends.*, v.source_type IS NOT NULL AS valid FROM ends LEFT JOIN valid v ON v.source_type = ends.source_type AND v.dest_type = ends.dest_type)"""


def _diagram(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = load(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), "Process").when(F.col("c_mktsegment").isin("AUTOMOBILE", "FURNITURE"), "ExternalEntity").otherwise("DataStore")
    el = c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), kind.alias("type"), F.col("c_custkey").alias("pos"))
    n = c.count() + 3
    o = load(spark, d, "orders")
    fl = o.select(F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("C"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 5) % n).cast("string")).alias("destination"))
    return el, fl


@query(f"WITH {_DFD} SELECT id, source_type, dest_type, valid, CASE WHEN valid THEN 21 ELSE 0 END AS n_places FROM ctx")
def interaction_gate(spark: SparkSession, d: str) -> DataFrame:
    """J-01, J-02, P-06, R-09: every flow's interaction, and how many type-position pairs the mapping lists for it."""
    el, fl = _diagram(spark, d)
    c = threats.contexts(threats.with_endpoints(fl, el), mapping(spark), invalid_pairs(spark))
    places = F.aggregate(F.map_values("applicable"), F.lit(0), lambda s, p: s + F.size(p))
    return c.select("id", "source_type", "dest_type", "valid", F.coalesce(places, F.lit(0)).alias("n_places"))


_GOLD_AT = f"""{_DFD},
g AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey * 8 + l_linenumber AS pos, o.source AS s, CASE WHEN l_linenumber = 1 THEN 'nowhere' ELSE o.destination END AS t FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l JOIN fl o ON o.pos = l.l_orderkey),
byends AS (SELECT source, destination, arg_min(id, pos) AS flow FROM fl GROUP BY ALL),
loc AS (SELECT g.id, b.flow FROM g LEFT JOIN byends b ON b.source = g.s AND b.destination = g.t)"""


def _located_gold(spark: SparkSession, d: str, fl: DataFrame) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(fl.select(F.col("pos").alias("l_orderkey"), "source", "destination"), "l_orderkey")
    n = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(n.alias("id"), n.alias("pos"), F.lit(None).cast("string").alias("interaction"), F.col("source").alias("dfd_source_id"), F.when(F.col("l_linenumber") == 1, "nowhere").otherwise(F.col("destination")).alias("dfd_destination_id"))


@query(f"WITH {_GOLD_AT} SELECT id, flow FROM loc")
def gold_flow_resolution(spark: SparkSession, d: str) -> DataFrame:
    """J-05, N10: by end points, to the first of parallel flows."""
    _, fl = _diagram(spark, d)
    return matching.located(_located_gold(spark, d, fl), fl).select("id", "flow")


@query(f"""WITH {_GOLD_AT}, k AS (SELECT CASE WHEN flow IS NULL OR source_type IS NULL OR dest_type IS NULL THEN 'u' WHEN valid THEN 'm' ELSE 's' END AS k FROM loc LEFT JOIN ctx ON ctx.id = loc.flow)
SELECT 0::BIGINT AS matched, count(*) FILTER (k = 'm') AS reachable_but_missed, count(*) FILTER (k = 's') AS structurally_unreachable, count(*) FILTER (k = 'u') AS unresolved_location, 0.0::DOUBLE AS raw_recall, 0.0::DOUBLE AS reachable_recall FROM k""")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    """J-32, A-09: nothing matched yet."""
    el, fl = _diagram(spark, d)
    return threats.breakdown(threats.reachability(_located_gold(spark, d, fl), el, fl, mapping(spark), invalid_pairs(spark)))


_CHECKED = f"""{_DFD},
th AS (SELECT event_id, 'F' || (event_id * 3) AS flow_id, 'C' || user_id AS oid, {_TYPE_SQL} AS tt, {_TYPE_SQL} || '.' || (event_id % 5) AS node, [NULL, '', 'S', 'D', 'fl', 'X'][1 + event_id % 6] AS position FROM events),
j AS (SELECT th.*, ctx.id AS fid, ctx.source, ctx.destination, source_type, dest_type, coalesce(valid, false) AS valid, el.id AS eid FROM th LEFT JOIN ctx ON ctx.id = flow_id LEFT JOIN el ON el.id = oid),
k AS (SELECT event_id, event_id % 5 < 3 AS node_valid, fid IS NOT NULL AND valid AS type_applicable,
  CASE WHEN fid IS NULL THEN false WHEN coalesce(position, '') = '' THEN eid IS NOT NULL OR oid IN (source, destination)
       ELSE coalesce(oid = CASE position WHEN 'S' THEN source WHEN 'D' THEN destination WHEN 'fl' THEN fid END, false) END AS location_valid,
  CASE WHEN fid IS NOT NULL AND coalesce(position, '') <> '' AND valid THEN position IN ('S', 'D', 'fl') END AS position_applicable FROM j)"""


def _verified(spark: SparkSession, d: str) -> DataFrame:
    el, fl = _diagram(spark, d)
    e = load(spark, d, "events").withColumn("threat_type", _type_of())
    position = F.element_at(F.array(F.lit(None).cast("string"), *(F.lit(x) for x in ("", "S", "D", "fl", "X"))), (F.col("event_id") % 6 + 1).cast("int"))
    t = e.select(F.col("event_id").alias("gen_index"), F.concat(F.lit("F"), (F.col("event_id") * 3).cast("string")).alias("flow_id"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("originator_id"), "threat_type", F.concat("threat_type", F.lit("."), (F.col("event_id") % 5).cast("string")).alias("tree_node"), position.alias("position"))
    nodes = spark.createDataFrame([(t, f"{t}.{i}") for t in THREAT_TYPES for i in range(3)], "threat_type string, node_id string")
    return threats.verified(t, el, fl, nodes, mapping(spark), invalid_pairs(spark))


@query(f"WITH {_CHECKED} SELECT event_id AS gen_index, node_valid, type_applicable, location_valid, position_applicable FROM k")
def verify_threats(spark: SparkSession, d: str) -> DataFrame:
    """J-04, N4."""
    return _verified(spark, d).select("gen_index", "node_valid", "type_applicable", "location_valid", "position_applicable")


@query(f"""WITH {_CHECKED} SELECT round(avg(node_valid::INT), 6) AS node_valid_rate, round(avg(type_applicable::INT), 6) AS type_applicable_rate, round(avg(location_valid::INT), 6) AS location_valid_rate,
round(avg(position_applicable::INT), 6) AS position_applicable_rate, count(position_applicable) AS n_position_cited, round(avg((node_valid AND type_applicable AND location_valid AND coalesce(position_applicable, true))::INT), 6) AS all_valid_rate, count(*) AS n FROM k""")
def citation_rates(spark: SparkSession, d: str) -> DataFrame:
    """A-06."""
    r = metrics.citation_rates(_verified(spark, d))
    return r.select(*(F.round(c, 6).alias(c) if c.endswith("rate") else c for c in r.columns))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 > 0 THEN o_orderkey IS NOT NULL END AS a, CASE WHEN l_linenumber % 2 > 0 THEN p_size > 5 END AS b, CASE WHEN l_linenumber = 5 THEN s_acctbal > 0 END AS c
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey),
v AS (SELECT l_linenumber, CASE WHEN a IS FALSE OR b IS FALSE OR c IS FALSE THEN false WHEN a IS NULL AND b IS NULL AND c IS NULL THEN NULL ELSE true END AS v, a, b, c FROM c)
SELECT l_linenumber, count(*) AS n, count(v) AS n_checked, CASE WHEN count(v) = 0 THEN 'NaN'::DOUBLE ELSE round(avg(v::INT), 6) END AS rate FROM v GROUP BY ALL
""")
def verdict_rates(spark: SparkSession, d: str) -> DataFrame:
    """A-07, A-32, N2: checks that don't run for every line."""
    j = load(spark, d, "lineitem").join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("_o")), "l_orderkey", "left").join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey", "left").join(load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal"), "l_suppkey", "left")
    n = F.col("l_linenumber")
    v = verdict(F.when(n % 3 > 0, F.col("_o").isNotNull()), F.when(n % 2 > 0, F.col("p_size") > 5), F.when(n == 5, F.col("s_acctbal") > 0))
    from veriframe.functions.logic import rate

    return j.select("l_linenumber", v.alias("v")).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_checked"), F.round(rate(F.col("v")), 6).alias("rate"))


@query("""
SELECT 'duplicate key' AS rule, l_orderkey AS key, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'no order', l_orderkey, l_linenumber, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY ALL
UNION ALL SELECT 'no part', l_orderkey, l_linenumber, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY ALL
""")
def referential_violations(spark: SparkSession, d: str) -> DataFrame:
    """V-4, V-9 on keys: repeats and references to nothing."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    count = lambda df, rule: df.groupBy(F.lit(rule).alias("rule"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    lost = li.join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    bare = li.join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")
    return count(li, "duplicate key").where("n > 1").unionByName(count(lost, "no order")).unionByName(count(bare, "no part"))


_ROUTES = [("r1", "GET", "/en/:id", "/en/{p}", 1), ("r2", "GET", "/fr/:id", "/fr/{p}", 2), ("r3", "GET", "/:lang/:id", "/{p}/{p}", 3), ("r4", "GET", "/de/7", "/de/7", 4), ("r5", "POST", "/es/:id", "/es/{p}", 5)]


@query(rf"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
w AS (SELECT page_id, '/' || trim(path, '/') AS path, string_split(trim(path, '/'), '/') AS s FROM p),
r AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{m}', '{c}', {n})" for a, m, _, c, n in _ROUTES)}) r(route_id, method, canon, line)),
m AS (SELECT page_id, arg_min(route_id, line) AS route_id FROM w JOIN r ON method = 'GET' AND len(s) = len(string_split(trim(canon, '/'), '/'))
  AND list_bool_and([string_split(trim(canon, '/'), '/')[i] = '{{p}}' OR string_split(trim(canon, '/'), '/')[i] = s[i] for i in range(1, len(s) + 1)]) GROUP BY ALL)
SELECT page_id, path, route_id FROM w LEFT JOIN m USING (page_id)
""")
def first_match_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """J-10, W-05, F-08: page paths against a table of routes, the first that fits."""
    table = spark.createDataFrame([(a, m, "routes.js", "/", p, n) for a, m, p, _, n in _ROUTES], "id string, method string, file string, mount_path string, full_path string, line int")
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    p = load(spark, d, "pages").select("page_id", path.alias("path"), F.lit("get").alias("method"))
    return facts.dispatched(p, table, "page_id").select("page_id", X.canonical_path("path").alias("path"), "route_id")


@query(r"""
SELECT page_id, rtrim(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1), '/') AS base,
  '/' || trim(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1), '[0-9]+', ':id', 'g'), ':[A-Za-z_][A-Za-z0-9_]*', '{p}', 'g'), '/') AS canon FROM pages
""")
def canonical_paths(spark: SparkSession, d: str) -> DataFrame:
    """F-08, F-09."""
    return load(spark, d, "pages").select("page_id", X.url_base("url").alias("base"), X.canonical_path(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)$", 1), "[0-9]+", ":id")).alias("canon"))


@query("""
WITH s AS (SELECT user_id, event_id AS a, event_id + 200 + event_id % 700 AS b FROM events WHERE event_type = 'purchase'),
p AS (SELECT user_id, event_id FROM events WHERE event_type <> 'purchase')
SELECT event_id, span_id FROM p LEFT JOIN (SELECT event_id, arg_min(a, (b - a) * 1000000000 + a) AS span_id FROM p JOIN s USING (user_id) WHERE event_id BETWEEN a AND b GROUP BY ALL) USING (event_id)
""")
def enclosing_span(spark: SparkSession, d: str) -> DataFrame:
    """J-13, W-06: each event in the shortest span that a purchase of its user opens."""
    e = load(spark, d, "events")
    s = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span"), F.col("event_id").alias("a"), (F.col("event_id") + 200 + F.col("event_id") % 700).alias("b"))
    return facts.enclosing(e.where("event_type <> 'purchase'").select("user_id", "event_id"), s, "event_id", ["user_id"], "event_id", "a", "b", "span").select("event_id", "span_id")


@query(r"""
WITH k AS (SELECT page_id, trim(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS key FROM pages),
h AS (SELECT DISTINCT regexp_extract(key, '^([^/]+/[^/]+)', 1) AS key FROM k)
SELECT page_id AS item, min(h.key) AS hand FROM k JOIN h ON k.key = h.key OR starts_with(k.key, h.key || '/') WHERE h.key <> '' GROUP BY ALL
""")
def prefix_align(spark: SparkSession, d: str) -> DataFrame:
    """J-15, F-10: pages under the first two segments of their address."""
    k = load(spark, d, "pages").select(F.col("page_id").alias("item"), F.lit("fs_path").alias("kind"), F.btrim(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), F.lit("/")).alias("key"))
    h = k.select("kind", F.regexp_extract("key", "^([^/]+/[^/]+)", 1).alias("key")).where("key <> ''").distinct().withColumn("element_id", F.col("key"))
    return align.align_elements(k, h).select(F.col("derived").alias("item"), "hand")


@query("""
WITH n AS (SELECT page_id, row_number() OVER (PARTITION BY length(url) % 9 ORDER BY page_id) AS n, 'k' || length(url) % 9 AS key FROM pages),
h AS (SELECT label AS l, 'k' || label AS key, vec_id AS element_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)
SELECT page_id AS derived, element_id AS hand FROM n JOIN h USING (key, n)
""")
def exact_align(spark: SparkSession, d: str) -> DataFrame:
    """J-15: exact kinds one to one in the order of ids."""
    k = load(spark, d, "pages").select(F.col("page_id").alias("item"), F.lit("x").alias("kind"), F.concat(F.lit("k"), (F.length("url") % 9).cast("string")).alias("key"))
    h = load(spark, d, "embeddings").select(F.lit("x").alias("kind"), F.concat(F.lit("k"), F.col("label").cast("string")).alias("key"), F.col("vec_id").alias("element_id"))
    return align.align_elements(k, h)


@query("""
WITH p AS (SELECT p_partkey, p_type || '.' || replace(p_brand, '#', '.') || '.' || p_size AS node FROM part),
k AS (SELECT DISTINCT p_type || '.' || replace(p_brand, '#', '.') AS node_id FROM part WHERE p_size > 49 UNION SELECT DISTINCT p_type FROM part WHERE p_type < 'P')
SELECT p_partkey, node, (SELECT arg_max(node_id, length(node_id)) FROM k WHERE node = node_id OR starts_with(node, node_id || '.')) AS resolved FROM p
""")
def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """J-22: dotted ids made of type, brand and size, against the few that are known."""
    brand = F.replace("p_brand", F.lit("#"), F.lit("."))
    p = load(spark, d, "part")
    known = p.where("p_size > 49").select(F.concat_ws(".", "p_type", brand).alias("node_id")).union(p.where("p_type < 'P'").select("p_type")).distinct()
    return crosswalk.nearest_ancestor(p.select("p_partkey", F.concat_ws(".", "p_type", brand, F.col("p_size").cast("string")).alias("node")), known).select("p_partkey", "node", "resolved")


@query("""
WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ('the','a','an','to','of','and','or','for','in','on','from','with','by'))) AS t FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard FROM b x JOIN b y ON x.item_id < y.item_id WHERE len(list_intersect(x.t, y.t)) > 0
""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """T-07, F-11: pairs of benchmark items that share a token, found by an equi-join on tokens."""
    b = load(spark, d, "benchmark").select("item_id", X.align_tokens("text").alias("t"))
    each = b.select("item_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    x, y = each.toDF("a", "na", "token"), each.toDF("b", "nb", "token")
    shared = x.join(y, "token").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    return shared.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("jaccard"))


@query("""
WITH f AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS token FROM benchmark),
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS token FROM documents),
n AS (SELECT item_id, doc_id, count(*) AS overlap FROM f JOIN t USING (token) WHERE token NOT IN ('the','and','for','with','from','into','that','this','http','https','api') GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM (SELECT item_id AS flow_id, doc_id AS fact, overlap, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM n) WHERE rank <= 4
""")
def token_overlap_top4(spark: SparkSession, d: str) -> DataFrame:
    """J-28, O-04, F-12."""
    f = load(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("context"))
    return accept.attach_facts(f, load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("flow_id", "fact", "overlap", F.col("rank").cast("bigint").alias("rank"))


# orders as repeated runs: priority is the condition, status the scenario, year the run
_RUNS = "r AS (SELECT o_orderpriority AS arm, o_orderstatus AS block, year(o_orderdate) AS run, count(*) / 7.0 AS value FROM orders GROUP BY ALL)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("block"), F.year("o_orderdate").alias("run")).agg((F.count(F.lit(1)) / 7.0).alias("value"))


@query(f"WITH {_RUNS} SELECT arm, block, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(min(value), 4) AS min, round(max(value), 4) AS max FROM r GROUP BY ALL")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    """A-13, A-14."""
    return metrics.run_stats(_runs(spark, d), ["arm", "block"], "value").drop("values")


@query(f"""WITH {_RUNS}, c AS (SELECT arm, block, avg(value) AS m FROM r GROUP BY ALL), w AS (SELECT block, max(m) FILTER (arm = '1-URGENT') - max(m) FILTER (arm = '5-LOW') AS d FROM c GROUP BY ALL)
SELECT count(*) AS n, round(avg(d), 4) AS mean_diff, round(stddev_samp(d), 4) AS sd_diff, count(*) FILTER (d > 0) AS wins FROM w WHERE d IS NOT NULL HAVING count(*) >= 2""")
def paired_contrast(spark: SparkSession, d: str) -> DataFrame:
    """A-15, J-30."""
    c = _runs(spark, d).groupBy("arm", "block").agg(F.avg("value").alias("m"))
    return metrics.paired(c, "block", "arm", "m", "1-URGENT", "5-LOW").select("n", F.round("mean_diff", 4).alias("mean_diff"), F.round("sd_diff", 4).alias("sd_diff"), "wins")


@query(f"WITH {_RUNS}, m AS (SELECT arm, block, avg(value) AS m FROM r GROUP BY ALL) SELECT arm, round(avg(m), 4) AS mean, count(*) AS blocks FROM m GROUP BY ALL")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    """Z-22."""
    return metrics.mean_of_means(_runs(spark, d), "block", "value", "arm").select("arm", F.round("mean", 4).alias("mean"), "blocks")


@query("SELECT user_id, count(*) FILTER (p = 'S') AS \"S\", count(*) FILTER (p = 'fl') AS fl, count(*) FILTER (p = 'D') AS \"D\", count(*) FILTER (p NOT IN ('S', 'fl', 'D')) AS unset FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 'S' WHEN 'view' THEN 'fl' WHEN 'error' THEN 'D' ELSE '' END AS p FROM events) GROUP BY ALL")
def position_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A-16."""
    p = F.when(F.col("event_type") == "click", "S").when(F.col("event_type") == "view", "fl").when(F.col("event_type") == "error", "D").otherwise("")
    return metrics.position_counts(load(spark, d, "events").withColumn("position", p), ["user_id"])


@query(f"WITH e AS (SELECT user_id, {_TYPE_SQL} AS t FROM events) SELECT user_id, " + ", ".join(f"round(100 * count(*) FILTER (t = '{t}') / count(*), 6) AS \"{t}_share\"" for t in THREAT_TYPES) + " FROM e GROUP BY ALL")
def type_share(spark: SparkSession, d: str) -> DataFrame:
    """A-17."""
    s = metrics.type_share(load(spark, d, "events").withColumn("t", _type_of()), ["user_id"], "t", THREAT_TYPES)
    return s.select("user_id", *(F.round(t, 6).alias(f"{t}_share") for t in THREAT_TYPES))


@query("""
WITH r AS (SELECT DISTINCT l_partkey, c_mktsegment FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT l_partkey, count(*) AS n_groups, count(*) = (SELECT count(DISTINCT c_mktsegment) FROM r) AS everywhere FROM r GROUP BY ALL
""")
def division_common(spark: SparkSession, d: str) -> DataFrame:
    """A-24, T-04: parts that every market segment has ordered."""
    li = load(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("o_orderkey"))
    o, c = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return metrics.common_to_all(li.join(o, "o_orderkey").join(c, "c_custkey"), "l_partkey", "c_mktsegment")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::BIGINT % 10 AS d, sha256(event_type || '|' || props) AS digest, length(props)::BIGINT AS len FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """F-25, F-26."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return load(spark, d, "events").select("event_id", k.alias("k"), (k % 10).alias("d"), F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("digest"), F.length("props").cast("bigint").alias("len"))


@query("SELECT md5(text) AS digest, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """W-04: of equal texts the smallest id."""
    docs = load(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    return matching.first_by(docs, ["digest"], ["doc_id"]).select("digest", "doc_id", "source")


@query("SELECT user_id AS source, event_type AS intent, arg_min(event_id::VARCHAR || ' ' || event_type, event_id) AS description, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS fact_ids FROM events GROUP BY ALL")
def flow_dedup_provenance(spark: SparkSession, d: str) -> DataFrame:
    """A-21: one row a key, the first description, ids in the order of arrival."""
    e = load(spark, d, "events")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return e.groupBy(F.col("user_id").alias("source"), F.col("event_type").alias("intent")).agg(F.min_by(F.concat_ws(" ", F.col("event_id").cast("string"), "event_type"), "event_id").alias("description"), ids.alias("fact_ids"))


_EDGES = """
f AS (SELECT r_name AS a, n_name AS b FROM nation JOIN region ON r_regionkey = n_regionkey),
k AS (SELECT n_name AS b, r_name AS a FROM nation JOIN region ON r_regionkey = CASE WHEN n_nationkey % 8 = 7 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END)"""


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    f = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"))
    other = F.when(F.col("n_nationkey") % 8 == 7, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    return f, n.join(r, F.col("r_regionkey") == other).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))


@query(f"WITH {_EDGES} SELECT a, string_agg(b, ',' ORDER BY b) AS partners FROM (SELECT a, b FROM f UNION SELECT a, b FROM k) GROUP BY ALL")
def crosswalk_union(spark: SparkSession, d: str) -> DataFrame:
    """T-02."""
    return crosswalk.sides(crosswalk.both_readings(*_edges(spark, d)), "a", "b").select("a", F.array_join("partners", ",").alias("partners"))


@query(f"""WITH {_EDGES}, x AS (SELECT a, b, 1 AS w FROM (SELECT a, b FROM f EXCEPT SELECT a, b FROM k) UNION ALL SELECT a, b, 2 FROM (SELECT a, b FROM k EXCEPT SELECT a, b FROM f))
SELECT a, coalesce(string_agg(b, ',' ORDER BY b) FILTER (w = 1), '') AS only_forward, coalesce(string_agg(b, ',' ORDER BY b) FILTER (w = 2), '') AS only_back FROM x GROUP BY ALL""")
def crosswalk_asymmetries(spark: SparkSession, d: str) -> DataFrame:
    """T-03."""
    return crosswalk.asymmetries(*_edges(spark, d)).select("a", F.array_join("only_forward", ",").alias("only_forward"), F.array_join("only_back", ",").alias("only_back"))


@query("""
WITH a AS (SELECT DISTINCT user_id FROM events WHERE ts < '2024-01-03'), b AS (SELECT DISTINCT user_id FROM events WHERE ts >= '2024-01-29')
SELECT user_id, 'left' AS side FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT user_id, 'right' FROM b WHERE user_id NOT IN (SELECT user_id FROM a)
""")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    """T-05, T-06: users of the first or the last two days only."""
    e, at = load(spark, d, "events"), lambda s: F.lit(s).cast("timestamp_ntz")
    return crosswalk.symmetric_difference(e.where(F.col("ts") < at("2024-01-03")), e.where(F.col("ts") >= at("2024-01-29")), "user_id")


@query("WITH n AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL) SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS k FROM n) WHERE k = 1")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """A-22: ties go to the smallest."""
    return metrics.majority(load(spark, d, "events"), ["user_id"], "event_type")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE '' END AS l_returnflag, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN 'high' ELSE 'low' END AS confidence FROM lineitem GROUP BY ALL")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    """A-23."""
    return metrics.consensus(load(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("""
WITH w AS (SELECT lang, CASE WHEN quality = 0 AND toxic = 1 THEN 'borderline' WHEN toxic = 1 THEN 'spurious' WHEN quality = 0 THEN 'valid_uncatalogued' END AS label FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT lang, count(label) AS n, count(*) FILTER (label = 'spurious') AS s, count(*) FILTER (label = 'valid_uncatalogued') AS v, count(*) FILTER (label = 'borderline') AS b, count(*) AS fp FROM w GROUP BY ALL)
SELECT lang, n AS n_labeled, s AS spurious, v AS valid_uncatalogued, b AS borderline, CASE WHEN n > 0 THEN round(50 / (50 + fp), 6) END AS precision_raw,
  CASE WHEN n > 0 THEN round((50 + (v + b * 0.5) * (fp / n)) / (50 + (v + b * 0.5) * (fp / n) + (s + b * 0.5) * (fp / n)), 6) END AS precision_corrected, CASE WHEN n > 0 THEN n = fp END AS is_full_review FROM c
""")
def adjudication_estimate(spark: SparkSession, d: str) -> DataFrame:
    """A-12: 50 hits and the documents as false positives, some of them labelled."""
    lab = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "borderline").when(F.col("toxic") == 1, "spurious").when(F.col("quality") == 0, "valid_uncatalogued")
    w = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id", "left").withColumn("label", lab)
    out = w.groupBy("lang").agg(*metrics.human_corrected(F.lit(50), F.count(F.lit(1))))
    return out.select("lang", "n_labeled", "spurious", "valid_uncatalogued", "borderline", F.round("precision_raw", 6).alias("precision_raw"), F.round("precision_corrected", 6).alias("precision_corrected"), "is_full_review")


@query("""
WITH have AS (SELECT doc_id AS gen_index FROM labels WHERE toxic = 1), new AS (SELECT doc_id AS gen_index FROM documents WHERE doc_id NOT IN (SELECT gen_index FROM have))
SELECT gen_index, 'old' AS origin FROM have UNION ALL SELECT gen_index, 'new' FROM (SELECT * FROM new ORDER BY md5('42:' || gen_index) LIMIT greatest(0, 100 - (SELECT count(*) FROM have)))
""")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """O-06, S-21, X-02: a worklist of the labelled rows topped up to 100; a sampling operator."""
    have = load(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("gen_index"), F.lit("old").alias("origin"))
    return runs.topped_up(have, load(spark, d, "documents").select(F.col("doc_id").alias("gen_index"), F.lit("new").alias("origin")), 100)


@query("SELECT s.l_suppkey, s.run FROM (SELECT s_suppkey AS l_suppkey, unnest(range(1, 8))::INT AS run FROM supplier) s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.l_suppkey AND l.l_linenumber = s.run AND l.l_returnflag = 'R')")
def pending_cells(spark: SparkSession, d: str) -> DataFrame:
    """S-24, X-01, Z-19: planned cells (supplier, run) that the state lacks."""
    planned = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("run"))
    done = load(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", F.col("l_linenumber").alias("run"))
    return runs.pending(planned, done, ["l_suppkey", "run"])


@query("""
WITH t AS (SELECT o_orderkey, 'n_generated=' || o_custkey || ' n_gold=' || (o_orderkey % 50) || chr(10) || 'ALL   ' || (o_orderkey % 90) || '  ' || (o_custkey % 80) || ' 7 0.5 0.25 ' || (o_orderkey % 100) / 100 || chr(10) || '  unresolved_location   ' || (o_custkey % 60) AS text FROM orders)
SELECT o_orderkey, (o_orderkey % 90)::INT AS tp, n::INT AS fp, g::INT AS n_gold, g > 0 AND u >= g AS unscorable FROM (SELECT o_orderkey, regexp_extract(text, 'ALL\\s+\\d+\\s+(\\d+)', 1)::INT AS n, regexp_extract(text, 'n_gold=(\\d+)', 1)::INT AS g, regexp_extract(text, 'location\\s+(\\d+)', 1)::INT AS u FROM t)
""")
def report_parse(spark: SparkSession, d: str) -> DataFrame:
    """S-17, P-15: reports written from orders, and read."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    text = F.concat(F.lit("n_generated="), s(c), F.lit(" n_gold="), s(k % 50), F.lit("\nALL   "), s(k % 90), F.lit("  "), s(c % 80), F.lit(" 7 0.5 0.25 "), s((k % 100) / 100), F.lit("\n  unresolved_location   "), s(c % 60))
    return load(spark, d, "orders").select("o_orderkey", *runs.parse_report(text)).select("o_orderkey", "tp", "fp", "n_gold", "unscorable")


@query(r"""
SELECT page_id, scenario, condition, run, arm FROM (SELECT page_id, host AS scenario, 'dfd_' || host || '_' || host || '_m' AS condition, try_cast(n AS INT) AS run, host || '_' || host AS arm
FROM (SELECT page_id, regexp_extract(url, '://([a-z]+)', 1) AS host, regexp_extract(url, '/(\d+)', 1) AS n FROM pages)) WHERE run IS NOT NULL AND run % 2 = 0
""")
def run_discovery(spark: SparkSession, d: str) -> DataFrame:
    """S-16, F-05, O-09: paths of runs; those without a number are left out."""
    host, n = F.regexp_extract("url", "://([a-z]+)", 1), F.regexp_extract("url", r"/(\d+)", 1)
    folder = F.when(n.try_cast("int") % 2 == 0, F.concat(F.lit("run"), n)).otherwise("runs")
    p = load(spark, d, "pages").select("page_id", F.concat_ws("/", host, F.concat(F.lit("dfd_"), host, F.lit("_"), host, F.lit("_m")), folder, F.lit("dfd.json")).alias("path"))
    return runs.discover(p).select("page_id", "scenario", "condition", "run", "arm")


@query("SELECT user_id, coalesce(max((json_extract_string(props, '$.k'))::INT), 0) + 1 AS next_run FROM events GROUP BY ALL")
def next_run(spark: SparkSession, d: str) -> DataFrame:
    """A-31."""
    return runs.next_run(load(spark, d, "events").withColumn("run", F.get_json_object("props", "$.k").cast("int")), "user_id")


@query(r"""
SELECT p_partkey, slug, CASE WHEN length(t) <= 12 THEN t ELSE regexp_replace(substr(t, 1, 12), '\s\S*$', '') || '…' END AS title, CASE WHEN length(t) <= 14 THEN t ELSE substr(t, 1, 11) || '...' END AS phrase, parent, flow
FROM (SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'none') AS slug, p_name || ' ' || p_type AS t,
  CASE WHEN p_size >= 10 THEN 'PA' || p_size ELSE '?' END AS parent, nullif(regexp_extract('x [DF' || p_size || '] [DF1/DF2]', '\[([A-Za-z]*\d+)\]', 1), '') AS flow FROM part)
""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """F-02 to F-04, F-15."""
    t = F.concat_ws(" ", "p_name", "p_type")
    size = F.col("p_size").cast("string")
    return load(spark, d, "part").select("p_partkey", X.slug(F.concat("p_brand", F.lit(" / "), "p_name")).alias("slug"), X.title_of(t, 12).alias("title"), X.phrase_of(t, 14).alias("phrase"), X.parent_category(F.concat(F.lit("PA"), size, F.lit(".01"))).alias("parent"), X.flow_id(F.concat(F.lit("x [DF"), size, F.lit("] [DF1/DF2]"))).alias("flow"))


@query("""SELECT p_partkey, 'F' || substr(sha256('part|' || p_name || '|' || p_size || '|{"brand": "' || p_brand || '", "type": "' || p_type || '"}'), 1, 8) AS fact_id FROM part""")
def fact_ids(spark: SparkSession, d: str) -> DataFrame:
    """F-16: sorted keys, a space behind comma and colon."""
    fields = X.json_object(F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand"))
    return load(spark, d, "part").select("p_partkey", X.fact_id(F.lit("part"), "p_name", "p_size", fields).alias("fact_id"))


@query("""
SELECT p_partkey, CASE WHEN name IN ('fish', 'news', 'rice') THEN name WHEN regexp_matches(name, '(x|ch|ss|sh)$') THEN name || 'es' WHEN regexp_matches(name, '[^aeiouy]y$') THEN regexp_replace(name, 'y$', 'ies') WHEN name LIKE '%s' THEN name ELSE name || 's' END AS collection
FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'box' WHEN 1 THEN 'policy' WHEN 2 THEN 'fish' WHEN 3 THEN 'users' WHEN 4 THEN 'news' ELSE split_part(p_name, ' ', 2) END AS name FROM part)
""")
def plural_names(spark: SparkSession, d: str) -> DataFrame:
    """F-06."""
    n = F.col("p_size") % 6
    name = F.when(n == 0, "box").when(n == 1, "policy").when(n == 2, "fish").when(n == 3, "users").when(n == 4, "news").otherwise(F.element_at(F.split("p_name", " "), 2))
    return load(spark, d, "part").select("p_partkey", X.pluralize(name)["collection"].alias("collection"))


@query("""
WITH f AS (SELECT o_orderkey AS file, count(*) * 3 AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 9 > 0 GROUP BY ALL),
c AS (SELECT l_linenumber, CASE WHEN n_lines IS NULL THEN 'u' WHEN l_quantity::INT BETWEEN 1 AND n_lines THEN 'k' ELSE 'o' END AS s FROM lineitem LEFT JOIN f ON file = l_orderkey)
SELECT l_linenumber, count(*) AS n_citations, count(*) FILTER (s = 'k') AS n_resolvable, count(*) FILTER (s = 'u') AS n_unknown_file, count(*) FILTER (s = 'o') AS n_line_out_of_range, round(avg((s = 'k')::INT), 4) AS validity FROM c GROUP BY ALL
""")
def location_validity(spark: SparkSession, d: str) -> DataFrame:
    """J-18, A-27."""
    li = load(spark, d, "lineitem")
    f = li.join(load(spark, d, "orders").where("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("doc")).agg((F.count(F.lit(1)) * 3).alias("n_lines"))
    return accept.open_validity(accept.location_check(li.select("l_linenumber", F.col("l_orderkey").alias("file"), F.col("l_quantity").cast("int").alias("line")), f), "l_linenumber")


@query(f"WITH {_DFD} SELECT e.event_id AS id, CASE 'C' || e.user_id WHEN source THEN 'S' WHEN destination THEN 'D' END AS position FROM events e LEFT JOIN fl ON fl.id = 'F' || e.event_id")
def positions(spark: SparkSession, d: str) -> DataFrame:
    """P-21, J-31."""
    _, fl = _diagram(spark, d)
    g = load(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("[F"), F.col("event_id").cast("string"), F.lit("]")).alias("interaction"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("originator_id"))
    return matching.positions(g, fl).select("id", "position")


@query("""
WITH r AS (SELECT event_id AS pos, 'U' || user_id AS id, CASE WHEN event_type = 'error' THEN 'Unknown' ELSE 'Process' END AS type, event_type AS name, [event_id % 40, event_id % 300] AS ids FROM events),
k AS (SELECT *, CASE WHEN type = 'Unknown' THEN 'malformed' WHEN ids[1] >= 25 AND ids[2] >= 25 THEN 'cites no resolvable fact' END AS bad FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY id, bad IS NULL ORDER BY pos) AS k FROM k)
SELECT pos, id, coalesce(bad, CASE WHEN k > 1 THEN 'duplicate' END) AS reason, ((ids[1] < 25)::INT + (ids[2] < 25)::INT)::INT AS n_cited FROM n
""")
def accept_elements(spark: SparkSession, d: str) -> DataFrame:
    """P-09, N5: candidates that repeat ids, have a bad type, or cite ids that don't resolve."""
    e = F.col("event_id")
    raw = load(spark, d, "events").select(e.alias("pos"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("event_type") == "error", "Unknown").otherwise("Process").alias("type"), F.col("event_type").alias("name"), F.array((e % 40).cast("string"), (e % 300).cast("string")).alias("fact_ids"))
    known = spark.range(25).select(F.col("id").cast("string").alias("id"))
    return accept.accept_elements(raw, known).select("pos", "id", "reason", F.size("cited_ids").alias("n_cited"))


@query("""
WITH k AS (SELECT unnest(['MEDIUM.1', 'SMALL.2', 'ECONOMY', 'PROMO.7.1']) AS n),
c AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Not applicable' WHEN 1 THEN p_type || '.' || p_size % 9 WHEN 2 THEN lower(p_type) || '.' || p_size % 9 ELSE p_type || '.' || p_size % 9 || '.3' END AS node FROM part)
SELECT p_partkey, CASE WHEN node = 'Not applicable' THEN 'not_an_id' WHEN node IN (SELECT n FROM k) THEN 'exact' WHEN lower(node) IN (SELECT lower(n) FROM k) THEN 'case_only' WHEN lower(regexp_replace(node, '\\.?[^.]*$', '')) IN (SELECT lower(n) FROM k) THEN 'below_our_kb' ELSE 'unresolvable' END AS class FROM c
""")
def node_classes(spark: SparkSession, d: str) -> DataFrame:
    """A-28, F-22."""
    n, dotted = F.col("p_size") % 4, F.concat(F.lit("."), (F.col("p_size") % 9).cast("string"))
    node = F.when(n == 0, "Not applicable").when(n == 1, F.concat("p_type", dotted)).when(n == 2, F.concat(F.lower("p_type"), dotted)).otherwise(F.concat("p_type", dotted, F.lit(".3")))
    known = spark.createDataFrame([("MEDIUM.1",), ("SMALL.2",), ("ECONOMY",), ("PROMO.7.1",)], "node_id string")
    return metrics.classified_nodes(load(spark, d, "part").select("p_partkey", node.alias("node")), known).select("p_partkey", "class")


@query("SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY ALL")
def contiguous_ids(spark: SparkSession, d: str) -> DataFrame:
    """A-30."""
    return metrics.contiguous(load(spark, d, "lineitem"), "l_linenumber", "l_orderkey")


@query("SELECT 'GF' || row_number() OVER (ORDER BY first) AS id, source, destination, first FROM (SELECT o_custkey AS source, year(o_orderdate) AS destination, min(o_orderkey) AS first FROM orders GROUP BY ALL)")
def first_flows(spark: SparkSession, d: str) -> DataFrame:
    """Z-12: one flow for each pair of end points, numbered by arrival."""
    return crosswalk.first_flows(load(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "o_custkey", "year", "o_orderkey")


@query("""
WITH g AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'L' WHEN 'view' THEN 'I' ELSE 'Nr' END AS t, CASE WHEN event_id % 4 = 0 THEN [] ELSE ['PA' || lpad((user_id % 13 + 1)::VARCHAR, 2, '0') || '.01'] END AS a FROM events),
x AS (SELECT 'PA' || lpad(i::VARCHAR, 2, '0') AS c, CASE i % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'I' ELSE 'Nr' END AS t FROM range(1, 14) r(i))
SELECT id, CASE WHEN len(a) = 0 THEN 'no_actions' WHEN EXISTS (SELECT 1 FROM x WHERE x.c = substr(a[1], 1, 4) AND x.t = g.t) THEN 'consistent' ELSE 'inconsistent' END AS bucket FROM g
""")
def mapping_audit(spark: SparkSession, d: str) -> DataFrame:
    """J-24."""
    cat = F.concat(F.lit("PA"), F.lpad((F.col("user_id") % 13 + 1).cast("string"), 2, "0"), F.lit(".01"))
    g = load(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "L").when(F.col("event_type") == "view", "I").otherwise("Nr").alias("threat_type"), F.when(F.col("event_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(cat)).alias("panoptic_actions"))
    x = spark.createDataFrame([(f"PA{i:02d}", ("L", "I", "Nr")[i % 3]) for i in range(1, 14)], "category string, threat_type string")
    return crosswalk.audit(g, x).select("id", "bucket")


@query("""
WITH RECURSIVE n AS (SELECT source, lpad(doc_id::VARCHAR, 12, '0') AS file, n_chars, row_number() OVER (PARTITION BY source ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS k FROM documents),
walk AS (
  SELECT DISTINCT source, NULL::VARCHAR AS file, 0::BIGINT AS k, 50000::BIGINT AS room, false AS taken FROM documents
  UNION ALL
  SELECT n.source, n.file, n.k, CASE WHEN coalesce(n_chars, 0) <= room THEN room - coalesce(n_chars, 0) ELSE room END, coalesce(n_chars, 0) <= room
  FROM walk w JOIN n ON n.source IS NOT DISTINCT FROM w.source AND n.k = w.k + 1)
SELECT source, file, taken FROM walk WHERE k > 0
""")
def budget_fill(spark: SparkSession, d: str) -> DataFrame:
    """W-09, U-05: documents of each source that fit into a budget, in order, later smaller ones too."""
    docs = load(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file"), "n_chars")
    return accept.budget_fill(docs, ["source"], "file", "n_chars", 50_000)


_ALIGN = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ('" + "', '".join(X.ALIGN_STOP) + "')))"


# each step takes the best pair of a group whose two sides are free
@query(f"""
WITH RECURSIVE h AS (SELECT 'H' || lpad(item_id::VARCHAR, 6, '0') AS h, item_id % 20 AS g, {_ALIGN} AS t FROM benchmark),
d AS (SELECT 'D' || lpad(conv_id::VARCHAR, 6, '0') || '.' || lpad(turn::VARCHAR, 3, '0') AS d, conv_id % 20 AS g, {_ALIGN} AS t FROM conversations),
s AS (SELECT g, h, d, CASE WHEN len(h.t) + len(d.t) = 0 THEN 0.0 ELSE len(list_intersect(h.t, d.t))::DOUBLE / len(list_distinct(list_concat(h.t, d.t))) END AS score FROM h JOIN d USING (g)),
p AS (SELECT g, list({{'h': h, 'd': d}} ORDER BY score DESC, h, d) AS pairs, count(DISTINCT h) AS n FROM s GROUP BY ALL),
walk AS (SELECT g, []::VARCHAR[] AS hands, []::VARCHAR[] AS taken, NULL::STRUCT(h VARCHAR, d VARCHAR) AS hit FROM p
  UNION ALL SELECT g, list_append(hands, hit.h), list_append(taken, hit.d), hit
  FROM (SELECT w.g, w.hands, w.taken, list_filter(pairs, lambda x: NOT list_contains(w.hands, x.h) AND NOT list_contains(w.taken, x.d))[1] AS hit FROM walk w JOIN p ON p.g = w.g AND p.n > 1) WHERE hit IS NOT NULL),
won AS (SELECT hit.d AS derived, hit.h AS hand, true AS ambiguous FROM walk WHERE hit IS NOT NULL)
SELECT * FROM won
UNION ALL SELECT d, max({{'s': score, 'h': s.h}}).h, false FROM s JOIN p USING (g) WHERE d NOT IN (SELECT derived FROM won) GROUP BY d
""")
def ambiguous_flow_alignment(spark: SparkSession, d: str) -> DataFrame:
    """J-16, O-07, U-05: benchmark items (hand) and documents (derived) of the same group, told apart by their tokens."""
    hand = load(spark, d, "benchmark").select(F.concat(F.lit("H"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("id"), F.col("text").alias("description"), (F.col("item_id") % 20).cast("string").alias("source"), F.lit("t").alias("destination"))
    derived = load(spark, d, "conversations").select(F.concat(F.lit("D"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit("."), F.lpad(F.col("turn").cast("string"), 3, "0")).alias("id"), F.col("text").alias("description"), F.concat(F.lit("d"), (F.col("conv_id") % 20).cast("string")).alias("source"), F.lit("dt").alias("destination"))
    el = spark.createDataFrame([(f"d{i}", str(i)) for i in range(20)] + [("dt", "t")], "derived string, hand string")
    return align.align_flows(derived, hand, el)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: tumbling windows of an hour, in batch."""
    w = incremental.windows(load(spark, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
SELECT s_suppkey, l_quantity, n FROM (SELECT l_suppkey AS s_suppkey, l_quantity::INT AS l_quantity, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity::INT) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1
""")
def modal_value(spark: SparkSession, d: str) -> DataFrame:
    """A-26: the most frequent value, ties to the smallest."""
    return metrics.majority(load(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_quantity").cast("int").alias("l_quantity")), ["s_suppkey"], "l_quantity").withColumnRenamed("votes", "n")


@query("""
WITH c AS (SELECT o_orderkey, o_custkey, o_orderpriority, round(CASE o_orderpriority WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.7 ELSE 0.4 END * CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.6 END, 3) AS computed FROM orders)
SELECT o_orderkey, computed FROM c
""")
def ranking(spark: SparkSession, d: str) -> DataFrame:
    """F-17, F-18."""
    combos = spark.createDataFrame([(p, "x", 0.9 if p[0] == "1" else 0.7 if p[0] == "2" else 0.4) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")], "feasibility string, difficulty string, combo double")
    weights = spark.createDataFrame([("F", 1.0), ("O", 0.6), ("P", 0.6)], "threat_type string, weight double")
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("feasibility"), F.lit("x").alias("difficulty"), F.col("o_orderstatus").alias("threat_type"))
    return facts.ranking(o, combos, weights).select("o_orderkey", "computed")


@query("SELECT region, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT r_name AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY ALL")
def region_share(spark: SparkSession, d: str) -> DataFrame:
    """A-17 in its long form: each region's share of the suppliers."""
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = s.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
