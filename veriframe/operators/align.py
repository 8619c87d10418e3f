"""J-14 to J-16, A-10, A-11, A-22: aligning a derived diagram with a hand-made one by what both are evidence of."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.logic import ratio
from veriframe.functions.text import align_tokens, jaccard, path_prefixes
from veriframe.operators.facts import fields_of, list_of

#: Kinds of keys of which a longer path stands for the shorter one's element.
PREFIX_KINDS = ("fs_path",)
NO_KEY = "none"


def cited(items: DataFrame, facts: DataFrame) -> DataFrame:
    """J-14: (item, n, construct, file, line, fields, fact): facts that items cite, by id or by the place they stand at.

    items: (id, provenance). n is the order of the citations; those by id come before those by place.
    """
    p = items.select(F.col("id").alias("item"), F.posexplode("provenance").alias("n", "p"))
    f = facts.select(F.col("id").alias("fact"), "construct", "file", "line", "fields")
    by_id = p.where("p.fact_id is not null").join(f, F.col("p.fact_id") == F.col("fact")).select("item", F.col("n"), "construct", "file", "line", "fields", "fact")
    open_ = p.where("p.fact_id is null and p.file is not null and p.line is not null").select("item", (F.col("n") + 1_000_000).alias("n"), F.col("p.file").alias("_f"), F.col("p.line").alias("_l"))
    by_place = open_.join(f, (F.col("_f") == F.col("file")) & (F.col("_l") == F.col("line"))).select("item", "n", "construct", "file", "line", "fields", "fact")
    return by_id.unionByName(by_place)


def element_keys(items: DataFrame, facts: DataFrame) -> DataFrame:
    """A-22: (item, kind, key): what an element's cited facts say it is, read as its type claims; elements without a key have no row.

    Stores: a collection, else a path, else a browser store. Processes: a mount, else the mount of most cited routes (of
    equals the smallest). External entities: the first role.
    """
    c = cited(items, facts).join(items.select(F.col("id").alias("item"), "type"), "item")
    mounts = fields_of(facts, "express_mount", "router_file", "mount_path").where("router_file is not null").groupBy(F.col("router_file").alias("_rf")).agg(F.max_by("mount_path", F.struct("pos", "id")).alias("_m"))
    c = c.join(mounts, (F.col("construct") == "express_route") & (F.col("file") == F.col("_rf")), "left")
    f = lambda n: F.try_element_at("fields", F.lit(n))
    roles = F.array_sort(list_of(f("roles")))
    kind = F.col("type")
    k = lambda order, name, value: F.struct(F.lit(order).alias("o"), F.lit(name).alias("kind"), value.alias("key"))
    key = (
        F.when((kind == "DataStore") & (F.col("construct") == "mongo_collection"), k(1, "mongo_collection", f("collection")))
        .when((kind == "DataStore") & (F.col("construct") == "fs_location"), k(2, "fs_path", f("fs_path")))
        .when((kind == "DataStore") & (F.col("construct") == "web_storage_access"), k(3, "web_storage", f("store")))
        .when((kind == "Process") & (F.col("construct") == "express_mount"), k(1, "route_mount", f("mount_path")))
        .when((kind == "Process") & F.col("_m").isNotNull(), k(2, "route_mount", F.col("_m")))
        .when((kind == "ExternalEntity") & (F.col("construct") == "role_check") & (F.size(roles) > 0), k(1, "actor_role", F.get(roles, F.lit(0))))
    )
    votes = c.withColumn("k", key).where("k is not null").withColumn("voted", (F.col("k.o") == 2) & (F.col("type") == "Process"))
    n = F.count(F.lit(1)).over(Window.partitionBy("item", "k"))
    votes = votes.withColumn("votes", F.when(F.col("voted"), n).otherwise(0))
    best = votes.groupBy("item").agg(F.min_by("k", F.struct("k.o", -F.col("votes"), F.when(F.col("voted"), F.col("k.key")), "n", "fact")).alias("k"))
    return best.select("item", "k.kind", "k.key")


def align_elements(derived: DataFrame, hand: DataFrame) -> DataFrame:
    """J-15, T-05: (derived, hand) from derived (item, kind, key) and hand (element_id, kind, key).

    Exact kinds match one to one in the order of ids; paths match many to one, the first hand element in id order whose
    path is a leading part. A path is looked up by its own prefixes, so no pairs are compared.
    """
    h = hand.where(F.col("kind") != NO_KEY)
    exact = lambda df: df.where(~F.col("kind").isin(*PREFIX_KINDS))
    d1 = exact(derived).withColumn("n", F.row_number().over(Window.partitionBy("kind", "key").orderBy("item")))
    h1 = exact(h).select("kind", "key", F.col("element_id"), F.row_number().over(Window.partitionBy("kind", "key").orderBy("element_id")).alias("n"))
    one = d1.join(h1, ["kind", "key", "n"]).select(F.col("item").alias("derived"), F.col("element_id").alias("hand"))
    d2 = derived.where(F.col("kind").isin(*PREFIX_KINDS)).select("item", "kind", F.explode(path_prefixes("key")).alias("_p"))
    h2 = h.where(F.col("kind").isin(*PREFIX_KINDS)).select("kind", F.btrim("key", F.lit("/")).alias("_p"), "element_id")
    many = d2.join(h2, ["kind", "_p"]).groupBy(F.col("item").alias("derived")).agg(F.min("element_id").alias("hand"))
    return one.unionByName(many)


def _best_first(scored: DataFrame) -> DataFrame:
    """(derived, hand, ambiguous) of (s, t, neg, hand, derived): of each (s, t), pairs from best to worst whose sides are free.

    A leftover joins its best; of equal scores the largest hand id. What is taken depends on all before it, so a pair of
    end points is walked in one task, its rows sorted and passing by; only ids are remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hands, taken, best = None, set(), set(), {}

        def out(rows: list[tuple[str, str, bool]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], names=["derived", "hand", "ambiguous"])

        for b in batches:
            rows = []
            for s, t, neg, hand, derived in zip(*(c.to_pylist() for c in b.columns)):
                if (s, t) != group:
                    rows += [(d, h, False) for d, (_, h) in best.items() if d not in taken]
                    group, hands, taken, best = (s, t), set(), set(), {}
                if derived not in best or best[derived][0] == neg:
                    best[derived] = neg, max(hand, best.get(derived, (neg, hand))[1])
                if hand not in hands and derived not in taken:
                    hands.add(hand)
                    taken.add(derived)
                    rows.append((derived, hand, True))
            yield out(rows)
        yield out([(d, h, False) for d, (_, h) in best.items() if d not in taken])

    return scored.repartition("s", "t").sortWithinPartitions("s", "t", "neg", "hand", "derived").mapInArrow(run, "derived string, hand string, ambiguous boolean")


def align_flows(derived: DataFrame, hand: DataFrame, elements: DataFrame) -> DataFrame:
    """J-16, O-07: (derived, hand, ambiguous): derived flows projected by the elements' alignment onto the hand flows' end points.

    One hand flow between two elements takes all its candidates. Several are told apart by the shared share of the
    descriptions' tokens: best first one to one, then each leftover to its best. Each pair of end points is walked alone.
    """
    e = elements.select(F.col("derived").alias("_d"), F.col("hand").alias("_h"))
    s, t = e.toDF("_ds", "_hs"), e.toDF("_dt", "_ht")
    p = derived.join(s, F.col("source") == F.col("_ds")).join(t, F.col("destination") == F.col("_dt")).select(F.col("id").alias("d"), F.col("description").alias("dd"), F.col("_hs").alias("s"), F.col("_ht").alias("t"))
    h = hand.select(F.col("id").alias("h"), F.col("description").alias("hd"), F.col("source").alias("s"), F.col("destination").alias("t"))
    h = h.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("s", "t")))
    both = p.join(h, ["s", "t"])
    plain = both.where("n = 1").select(F.col("d").alias("derived"), F.col("h").alias("hand"), F.lit(False).alias("ambiguous"))
    score = jaccard(align_tokens("hd"), align_tokens("dd"))
    scored = both.where("n > 1").select("s", "t", (-score).alias("neg"), F.col("h").alias("hand"), F.col("d").alias("derived"))
    return plain.unionByName(_best_first(scored))


def derivability(items: DataFrame, aligned: DataFrame, underivable: Column, unresolved: Column, *by: str) -> DataFrame:
    """A-10: counts of hand items: matched, else underivable, else without a key, else missed; raw and adjusted recall."""
    hit = aligned.select(F.col("hand").alias("_m")).distinct()
    kind = F.when(F.col("_m").isNotNull(), "matched").when(underivable, "structurally_underivable").when(unresolved, "unresolved_key").otherwise("derivable_but_missed")
    k = items.join(hit, F.col("id") == F.col("_m"), "left").withColumn("_k", kind)
    n = k.groupBy(*by).agg(*(F.count_if(F.col("_k") == v).alias(v) for v in ("matched", "derivable_but_missed", "structurally_underivable", "unresolved_key")), F.count(F.lit(1)).alias("total"))
    return n.withColumn("raw_recall", ratio(F.col("matched"), F.col("total"))).withColumn("derivable_recall", ratio(F.col("matched"), F.col("matched") + F.col("derivable_but_missed")))


def element_derivability(hand: DataFrame, aligned: DataFrame) -> DataFrame:
    """A-10 for elements: (element_id, kind, implemented)."""
    items = hand.withColumn("id", F.col("element_id"))
    return derivability(items, aligned, ~F.coalesce("implemented", F.lit(True)), F.col("kind") == NO_KEY)


def flow_derivability(flows: DataFrame, hand: DataFrame, aligned: DataFrame) -> DataFrame:
    """A-10 for flows: underivable if an end point is not implemented, without a key if one has none."""
    h = hand.select("element_id", (~F.coalesce("implemented", F.lit(True))).alias("u"), (F.coalesce("implemented", F.lit(True)) & (F.col("kind") == NO_KEY)).alias("k"))
    s, d = h.toDF("_s", "_su", "_sk"), h.toDF("_d", "_du", "_dk")
    items = flows.join(s, F.col("source") == F.col("_s"), "left").join(d, F.col("destination") == F.col("_d"), "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return derivability(items, aligned, no("_su") | no("_du"), no("_sk") | no("_dk"))


def adapter_scores(derived_elements: DataFrame, derived_flows: DataFrame, elements: DataFrame, flows: DataFrame) -> DataFrame:
    """A-11: one row: sizes, raw precisions, derived items per matched hand item, number of ambiguous hand flows."""
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = size(derived_elements, "n_elements").crossJoin(size(derived_flows, "n_flows"))
    out = out.crossJoin(elements.agg(F.count_distinct("derived").alias("me"), F.count_distinct("hand").alias("he"))).crossJoin(flows.agg(F.count_distinct("derived").alias("mf"), F.count_distinct("hand").alias("hf"), F.count_distinct(F.when(F.col("ambiguous"), F.col("hand"))).alias("n_ambiguous")))
    c = F.col
    return out.select("n_elements", "n_flows", c("me").alias("matched_elements"), c("mf").alias("matched_flows"), ratio(c("me"), c("n_elements")).alias("element_precision_raw"), ratio(c("mf"), c("n_flows")).alias("flow_precision_raw"), ratio(c("me"), c("he")).alias("element_granularity"), ratio(c("mf"), c("hf")).alias("flow_granularity"), "n_ambiguous")
