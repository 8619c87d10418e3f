"""Text functions: tokens, ids, paths, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token rules and word lists of the retrieval and alignment operators.
TOKEN = r"[A-Za-z]+\.[0-9.]+[0-9]|[A-Za-z0-9]+"
ALIGN_STOP = ("the", "a", "an", "to", "of", "and", "or", "for", "in", "on", "from", "with", "by")
ENRICH_STOP = ("the", "and", "for", "with", "from", "into", "that", "this", "http", "https", "api")
#: Our own list of English function words for retrieval; callers may pass another.
STOP_WORDS = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing "
    "down during each either else few for from further had has have having he her here hers him his how i if in into is it its just me more most must my "
    "neither no nor not now of off on once one only or other our ours out over own per same she should so some such than that the their theirs them then "
    "there these they this those through to too under until up upon us very was we were what when where which while who whom whose why will with within "
    "without would yet you your yours".split()
)
UNCOUNTABLE = tuple("advice energy excretion digestion cooperation health justice labour machinery equipment information pollution sewage paper money species series rice fish sheep moose deer news".split())
#: Plural rules in order, the first that matches applies: pattern, replacement.
PLURALS = (
    ("(m)en$", "$1en"),
    ("(pe)ople$", "$1ople"),
    ("(child)ren$", "$1ren"),
    ("([ti])a$", "$1a"),
    ("((a)naly|(b)a|(d)iagno|(p)arenthe|(p)rogno|(s)ynop|(t)he)sis$", "$1ses"),
    ("(hive)$", "$1s"),
    ("(buffal|tomat|txt|carg|her|potat|mosquit)o$", "$1oes"),
    ("^(m|l)ouse$", "$1ice"),
    ("(matr|vert|ind|d)(ix|ex)$", "$1ices"),
    ("(x|ch|ss|sh)$", "$1es"),
    ("([^aeiouy]|qu)y$", "$1ies"),
    ("(?:([^f])fe|([lr])f)$", "$1$2ves"),
    ("sis$", "ses"),
    ("([ti])um$", "$1a"),
    ("(bu)s$", "$1ses"),
    ("(alias|status)$", "$1es"),
    ("(octop|vir)us$", "$1i"),
    ("(gen)us$", "$1era"),
    ("(ax|test)is$", "$1es"),
    ("s$", "s"),
    ("$", "s"),
)
#: Rules too plain to doubt; any other lowers the confidence of a plural.
PLAIN_PLURALS = ("$", "s$")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(text: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(pattern), F.lit(0))


def tokens(text: str | Column) -> Column:
    """R-01: tokens with their case; ids such as ``Dd.1.1`` stay whole, ``D.1`` gives two."""
    return _words(text, TOKEN)


def terms(text: str | Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """R-02: lower-case tokens without stop words, repeats kept."""
    low = F.transform(tokens(text), F.lower)
    return F.filter(low, lambda t: ~t.isin(*stop)) if stop else low


def token_set(text: str | Column) -> Column:
    """Distinct lower-case tokens, stop words kept."""
    return F.array_distinct(F.transform(tokens(text), F.lower))


def ngram_terms(text: str | Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """R-05: words of two or more letters or digits (any script), lowered, without stop words, and their bigrams."""
    words = _words(F.lower(F.coalesce(_col(text), F.lit(""))), r"(?U)\b\w\w+\b")
    words = F.filter(words, lambda t: ~t.isin(*stop)) if stop else words
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.array_compact(F.zip_with(words, after, lambda x, y: F.when(y.isNotNull(), F.concat(x, F.lit(" "), y))))
    return F.concat(words, pairs)


def align_tokens(text: str | Column) -> Column:
    """F-11: distinct lower-case tokens of two or more signs without the alignment stop words."""
    return F.array_distinct(F.filter(_words(F.lower(_col(text)), "[a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(*ALIGN_STOP)))


def enrich_tokens(text: str | Column) -> Column:
    """F-12: distinct lower-case tokens of three or more signs without the enrichment stop words."""
    return F.array_distinct(F.filter(_words(F.lower(_col(text)), "[a-z0-9]{3,}"), lambda t: ~t.isin(*ENRICH_STOP)))


def jaccard(a: Column, b: Column) -> Column:
    """T-07: shared share of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(union == 0, 1).otherwise(union))


def heading(line: str | Column) -> Column:
    """F-01: a heading line without its leading marks and outer spaces."""
    return F.trim(F.ltrim(_col(line), F.lit("# ")))


def flow_id(text: str | Column, wide: bool = False) -> Column:
    """F-02: the id in the first bracket of optional letters and digits, else null. wide (J-31): any word characters."""
    return F.nullif(F.regexp_extract(F.coalesce(_col(text), F.lit("")), r"\[(\w+)\]" if wide else r"\[([A-Za-z]*\d+)\]", 1), F.lit(""))


def parent_category(action: str | Column, unknown: str | None = "?") -> Column:
    """F-03: ``PA`` and two digits at the beginning, else ``unknown``."""
    found = F.nullif(F.regexp_extract(F.coalesce(_col(action), F.lit("")), r"^(PA\d{2})", 1), F.lit(""))
    return F.coalesce(found, F.lit(unknown).cast("string"))


def slug(text: str | Column) -> Column:
    """F-04: lower case, runs of other signs as ``-``, none outside; nothing left: ``none``."""
    out = F.btrim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("none"))


def condition_key(source: str | Column, arm: str | Column, model: str | Column) -> Column:
    """F-05: ``<input>_<arm>_<model>``, input and model as slugs."""
    return F.concat_ws("_", slug(source), _col(arm), slug(model))


def condition_parts(key: str | Column) -> Column:
    """F-05 back: struct of input, arm (which may hold ``_``) and model; null with fewer than three parts."""
    parts = F.split(_col(key), "_")
    n = F.size(parts)
    return F.when(n >= 3, F.struct(F.element_at(parts, 1).alias("input"), F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), "_").alias("arm"), F.element_at(parts, -1).alias("model")))


def pluralize(name: str | Column) -> Column:
    """F-06: struct of the collection name of a model name and the rule that gave it."""
    name = _col(name)
    out = F.when(F.lower(name).isin(*UNCOUNTABLE), F.struct(F.lower(name).alias("collection"), F.lit("uncountable").alias("rule")))
    for pattern, replacement in PLURALS:
        out = out.when(name.rlike(f"(?i){pattern}"), F.struct(F.lower(F.regexp_replace(name, f"(?i){pattern}", replacement)).alias("collection"), F.lit(pattern).alias("rule")))
    return out


def _folded(segments: Column, start: Column) -> Column:
    return F.aggregate(segments, start, lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))


def resolve_path(raw: str | Column, file: str | Column) -> Column:
    """F-07: a path with ``.`` and ``..`` folded; ``@dirname`` at its head stands for the file's folder. Empty: null."""
    raw = F.nullif(_col(raw), F.lit(""))
    parts, own = F.split(raw, "/"), F.split(_col(file), "/")
    at = F.element_at(parts, 1) == "@dirname"
    folder = F.filter(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")
    start = F.when(at, folder).otherwise(none)
    return F.when(raw.isNotNull(), F.array_join(_folded(F.when(at, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts), start), "/"))


def canonical_path(path: str | Column) -> Column:
    """F-08: ``${..}`` and ``:name`` as ``{p}``, one slash before and none behind."""
    p = F.regexp_replace(F.regexp_replace(_col(path), r"\$\{[^}]*\}", "{p}"), ":[A-Za-z_][A-Za-z0-9_]*", "{p}")
    return F.concat(F.lit("/"), F.btrim(p, F.lit("/")))


def url_base(url: str | Column) -> Column:
    """F-09: the path behind the host without slashes at its end, else empty."""
    return F.rtrim(F.regexp_extract(_col(url), r"^[a-z]+://[^/]+(/.*)$", 1), F.lit("/"))


def path_prefix(path: str | Column, prefix: str | Column) -> Column:
    """F-10: whether whole leading segments of ``path`` are ``prefix``."""
    p, q = F.btrim(_col(path), F.lit("/")), F.btrim(_col(prefix), F.lit("/"))
    return (p == q) | p.startswith(F.concat(q, F.lit("/")))


def path_prefixes(path: str | Column) -> Column:
    """All prefixes by whole segments, the path itself first: what a prefix join probes instead of comparing pairs."""
    parts = F.split(F.btrim(_col(path), F.lit("/")), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def dotted_prefixes(node: str | Column) -> Column:
    """The prefixes of a dotted id, the id itself first."""
    parts = F.split(_col(node), r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def node_id(node: str | Column) -> Column:
    """F-13: ``DD`` at the head of a node id as ``Dd``."""
    return F.regexp_replace(F.trim(_col(node)), r"^DD(?=\.|$)", "Dd")


def comma_list(text: str | Column) -> Column:
    """F-14: parts between commas, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_col(text), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def title_of(text: str | Column, most: int = 90) -> Column:
    """F-15: at most ``most`` signs, cut at a word with an ellipsis."""
    text = _col(text)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s\S*$", ""), F.lit("…")))


def phrase_of(text: str | Column, most: int = 110) -> Column:
    """F-15: at most ``most`` signs, the last three as dots where cut."""
    text = _col(text)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def json_object(fields: str | Column) -> Column:
    """A map<string,string> as JSON with sorted keys, ``", "`` and ``": "`` between: the form that fact ids digest."""
    entries = F.array_sort(F.map_entries(_col(fields)))
    quoted = lambda s: F.to_json(F.array(s))
    inner = lambda s: F.substr(quoted(s), F.lit(2), F.length(quoted(s)) - 2)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(inner(e["key"]), F.lit(": "), F.when(e["value"].isNull(), F.lit("null")).otherwise(inner(e["value"])))), ", "), F.lit("}"))


def fact_id(construct: str | Column, file: str | Column, line: str | Column, fields_json: str | Column) -> Column:
    """F-16: ``F`` and eight hex digits of the SHA-256 of construct, file, line and fields."""
    return F.concat(F.lit("F"), F.substring(F.sha2(F.concat_ws("|", _col(construct), _col(file), _col(line).cast("string"), _col(fields_json)), 256), 1, 8))


def label_items(text: str | Column) -> Column:
    """F-20: items that begin behind a full stop and a space with ``Name:``, as structs of name and text."""
    parts = F.split(F.trim(_col(text)), r"(?<=[.!?])\s+(?=[A-Z][A-Za-z /-]{0,40}: )")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(F.nullif(F.regexp_extract(x, r"^([A-Z][A-Za-z /-]{0,40}): ", 1), F.lit("")).alias("name"), F.regexp_replace(x, r"^[A-Z][A-Za-z /-]{0,40}: ", "").alias("text")))


def retry_after(message: str | Column, header: str | Column, most: float = 65.0) -> Column:
    """F-23: seconds a service asks to wait, from ``try again in`` of a message, else a header; at most ``most``."""
    n = F.regexp_extract(F.lower(F.coalesce(_col(message), F.lit(""))), r"try again in ([0-9.]+)\s*(ms|s)", 1)
    unit = F.regexp_extract(F.lower(F.coalesce(_col(message), F.lit(""))), r"try again in ([0-9.]+)\s*(ms|s)", 2)
    told = F.try_divide(n.try_cast("double"), F.when(unit == "ms", 1000.0).otherwise(1.0))
    return F.least(F.coalesce(told, _col(header).try_cast("double")), F.lit(most))
