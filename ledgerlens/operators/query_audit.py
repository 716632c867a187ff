"""Audit of a column of OData query strings: syntax, safety, limits, cost and verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import spread_lookup


@dataclass
class AuditConfig:
    max_top: int = 1000
    warn_top: int = 500
    max_expand: int = 3
    max_complexity: int = 100
    max_cost: int = 80
    warn_cost: int = 60
    allow_batch: bool = False
    require_top: bool = True
    estimate_cost: bool = True
    complexity_critical: bool = False
    flat_cost: bool = False

    @classmethod
    def production(cls, **changes) -> "AuditConfig":
        return cls(**{"max_top": 500, "warn_top": 250, "max_expand": 2, "max_complexity": 50, **changes})


# Options, words and patterns the checks look for.
OPTIONS = ["$select", "$filter", "$orderby", "$top", "$skip", "$count", "$expand", "$search", "$apply", "$compute", "$index"]
MUTATIONS = ["DELETE", "UPDATE", "INSERT", "MERGE", "PATCH", "CREATE", "DROP", "ALTER", "TRUNCATE"]
INJECTIONS = [r"';.*--", r"union\s+select", r";\s*drop\s+table", r";\s*exec\s*\(", r"xp_cmdshell", r"<script.*?>", r"javascript:"]
SCRIPTS = ["<script", "javascript:", "onerror=", "onload="]
LOGIC = {" and ": 2, " or ": 2, " not ": 1}
COMPARISONS = ["eq", "ne", "gt", "ge", "lt", "le"]
FUNCTIONS = ["contains", "startswith", "endswith", "length", "substring", "tolower", "toupper", "trim", "year", "month",
             "day", "hour", "minute", "second"]
# Warning and maximum row limit per entity size, and the words of a temporal key.
LIMITS = {"small": (1000, 5000), "medium": (500, 1000), "large": (200, 500), "transaction": (100, 500)}
TEMPORAL = "date|time|period|year|month"


def _occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _issue(severity: str, category: str, message: Column | str, segment: Column | str | None = None,
           suggestion: Column | str | None = None) -> Column:
    def col(x):
        return x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), col(message).alias("message"),
                    col(segment).alias("segment"), col(suggestion).alias("suggestion"))


def split_query(df: DataFrame, col: str = "query") -> DataFrame:
    """Add the part before ``?``, the parameters in order, their distinct names, and the entity name."""
    q = F.coalesce(F.col(col), F.lit(""))
    text = F.trim(F.regexp_replace(q, r"^\s+|\s+$", ""))
    has_mark = F.contains(q, F.lit("?"))
    tail = F.when(has_mark, F.regexp_extract(q, r"(?s)^[^?]*\?(.*)$", 1)).otherwise(q)
    pairs = F.filter(F.split(tail, "&"), lambda p: F.contains(p, F.lit("=")))
    params = F.transform(pairs, lambda p: F.struct(
        F.regexp_extract(p, r"(?s)^([^=]*)=", 1).alias("name"), F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1).alias("value")))
    out = df.withColumns({"__q": q, "__text": text, "__params": params})
    out = out.withColumn("__head", F.when(has_mark, F.regexp_extract("__text", r"(?s)^([^?]*)\?", 1)).otherwise(F.col("__text")))
    entity = F.trim("__head")
    named = has_mark & entity.rlike(r"^[A-Za-z_]")
    return out.withColumns({"__names": F.array_distinct(F.transform("__params", lambda p: p["name"])),
                            "entity": F.when(named, entity)})


def option(name: str) -> Column:
    """Value of a parameter; the last one wins."""
    hits = F.filter("__params", lambda p: p["name"] == name)
    return F.get(hits, F.size(hits) - 1)["value"]


def expand_depth(expand: Column) -> Column:
    return 1 + _occurrences(expand, "$expand")


def filter_complexity(expr: Column) -> Column:
    low = F.lower(expr)
    parts = [_occurrences(low, word) * weight for word, weight in LOGIC.items()]
    parts += [_occurrences(low, f" {op} ") for op in COMPARISONS]
    parts += [_occurrences(low, f"{f}(") * 3 for f in FUNCTIONS]
    return sum(parts[1:], parts[0]) + _occurrences(expr, "(") * 2


def entity_profiles(properties: DataFrame) -> DataFrame:
    """Size class, limits and row width per entity from (entity, property, is_key[, is_navigation]) rows."""
    nav = F.col("is_navigation") if "is_navigation" in properties.columns else F.lit(False)
    temporal = F.col("is_key") & F.lower("property").rlike(TEMPORAL)
    g = properties.groupBy("entity").agg(
        F.count_if(~nav).alias("property_count"), F.count_if(F.col("is_key")).alias("key_count"),
        F.count_if(nav).alias("nav_property_count"), F.coalesce(F.bool_or(temporal), F.lit(False)).alias("has_temporal_key"))
    n = F.col("property_count")
    size = (F.when(F.col("has_temporal_key") & (F.col("key_count") >= 3), "transaction").when(n > 40, "large")
            .when(n >= 15, "medium").otherwise("small"))
    out = g.withColumn("size", size)
    warn = top = None
    for name, (w, m) in LIMITS.items():
        is_it = F.col("size") == name
        warn = F.when(is_it, w) if warn is None else warn.when(is_it, w)
        top = F.when(is_it, m) if top is None else top.when(is_it, m)
    width = F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.5), n / 25.0)), 2)
    return out.withColumns({"warn_top_threshold": warn, "max_top_limit": top, "width_factor": width})


def audit_queries(df: DataFrame, col: str = "query", cfg: AuditConfig = AuditConfig(),
                  profiles: DataFrame | None = None) -> DataFrame:
    """Add is_valid, issues (critical first), cost score, estimated rows, expand depth and filter complexity."""
    out = split_query(df, col)
    if profiles is not None:
        limits = profiles.select("entity", "size", "warn_top_threshold", "max_top_limit", "width_factor")
        out = spread_lookup(out, limits, ["entity"])
    else:
        out = out.withColumns({"size": F.lit(None).cast("string"), "warn_top_threshold": F.lit(None).cast("int"),
                               "max_top_limit": F.lit(None).cast("int"), "width_factor": F.lit(None).cast("double")})
    options = {"top": "$top", "filter": "$filter", "expand": "$expand", "orderby": "$orderby", "count": "$count"}
    out = out.withColumns({f"__{k}": option(v) for k, v in options.items()})
    whole = F.regexp_extract("__top", r"^\s*([+-]?\d+)\s*$", 1)
    out = out.withColumns({
        "__n": F.when(whole != "", whole.try_cast("decimal(38,0)")),
        "expand_depth": F.when(F.col("__expand").isNotNull(), expand_depth(F.col("__expand"))),
        "filter_complexity": F.when(F.col("__filter").isNotNull(), filter_complexity(F.col("__filter"))),
        "__max": F.coalesce("max_top_limit", F.lit(cfg.max_top)), "__warn": F.coalesce("warn_top_threshold", F.lit(cfg.warn_top)),
        "__hint": F.when(F.col("size").isNotNull(), F.concat(F.lit(" for "), "entity", F.lit(" ("), "size", F.lit(" entity)"))).otherwise(""),
    })
    has_top, n = F.col("__top").isNotNull(), F.col("__n")
    shown = n.cast("string")

    cost = F.lit(0.0)
    if cfg.flat_cost:
        cost += F.when(~has_top, 40.0).when(n.isNotNull(), F.least(F.lit(30.0), n.cast("double") / 100 * 3)).otherwise(0.0)
    else:
        width = F.coalesce("width_factor", F.lit(1.0))
        cost += F.when(~has_top, F.least(F.lit(50.0), 30 * width)).when(
            n.isNotNull(), F.least(F.lit(40.0), n.cast("double") / F.when(F.col("__warn") > 0, F.col("__warn")).otherwise(500) * 20 * width)).otherwise(0.0)
    cost += F.coalesce(F.col("expand_depth") * 15, F.lit(0))
    cost += F.when(F.col("__filter").isNotNull(), F.least(F.lit(25.0), F.col("filter_complexity") / 4)).otherwise(0.0)
    cost += F.when(F.col("__orderby").isNotNull(), 10).otherwise(0) + F.when(F.lower("__count") == "true", 5).otherwise(0)
    empty = F.col("__text") == ""
    out = out.withColumn("cost_score", F.when(empty | F.lit(not cfg.estimate_cost), None).otherwise(F.least(F.lit(100.0), cost)))

    head, q = F.col("__head"), F.col("__q")
    bad_start = ~head.rlike(r"^[A-Za-z_$]")
    spaced = ~F.contains(q, F.lit("?")) & ~F.startswith("__text", F.lit("$")) & head.rlike(r"\s")
    opens, closes = _occurrences(F.col("__filter"), "("), _occurrences(F.col("__filter"), ")")
    filter_text = F.concat(F.lit("$filter="), "__filter")
    start = F.array_compact(F.array(
        F.when(bad_start, _issue("critical", "syntax", "Query does not begin with a valid entity set name or OData parameter",
                                 F.substring(head, 1, 50), "Start with an entity set name or a $ parameter")),
        F.when(~bad_start & spaced, _issue("critical", "syntax", "Entity set name contains whitespace", head,
                                           "Entity set names cannot contain spaces"))))
    unknown = F.transform(
        F.filter("__names", lambda p: F.startswith(p, F.lit("$")) & ~p.isin(OPTIONS)),
        lambda p: _issue("critical", "syntax", F.concat(F.lit("Unknown OData system query option: "), p), p,
                         f"Valid options: {', '.join(sorted(OPTIONS))}"))

    def blank(p: Column) -> Column:
        hits = F.filter("__params", lambda x: x["name"] == p)
        return F.get(hits, F.size(hits) - 1)["value"].rlike(r"^\s*$")

    blanks = F.transform(F.filter("__names", blank), lambda p: _issue(
        "critical", "syntax", F.concat(F.lit("Empty value for parameter: "), p), F.concat(p, F.lit("=")),
        F.concat(F.lit("Provide a value for "), p, F.lit(" or remove the parameter"))))
    paren = F.array_compact(F.array(F.when(opens != closes, _issue(
        "critical", "syntax", "Unmatched parentheses in $filter expression", filter_text, "Balance the parentheses"))))
    syntax = F.when(F.size(start) > 0, start).otherwise(F.concat(paren, unknown, blanks))

    safety = [F.when(F.upper(q).rlike(rf"\b{w}\b"), _issue("critical", "safety", f"Detected unsafe operation keyword: {w}", w,
                                                            "Only read operations are allowed")) for w in MUTATIONS]
    if not cfg.allow_batch:
        safety.append(F.when(F.contains(F.lower(q), F.lit("$batch")), _issue(
            "critical", "safety", "$batch operations are disabled", "$batch", "Execute queries individually")))
    safety += [F.when(q.rlike(f"(?i){p}"), _issue("critical", "security", "Detected potential SQL injection pattern", p,
                                                  "Remove suspicious patterns from query")) for p in INJECTIONS]
    safety += [F.when(F.contains(F.lower("__filter"), F.lit(p)), _issue(
        "critical", "security", f"Detected potential script injection: {p}", filter_text,
        "Remove script-like patterns from filter")) for p in SCRIPTS]

    top_text = F.concat(F.lit("$top="), "__top")
    limits = []
    if cfg.require_top:
        limits.append(F.when(~has_top, _issue("warning", "limits", F.concat(F.lit("Query does not specify $top limit"), "__hint"), None,
                                              F.concat(F.lit("Add $top parameter (max: "), F.col("__max").cast("string"), F.lit(")")))))
    limits.append(
        F.when(has_top & n.isNull(), _issue("critical", "limits", F.concat(
            F.lit("Invalid $top value: "), "__top", F.lit(" (must be an integer)")), top_text, "Use a numeric value for $top"))
        .when(n <= 0, _issue("critical", "limits", F.concat(F.lit("Invalid $top value: "), shown, F.lit(" (must be positive)")),
                             top_text, "Use a positive integer for $top"))
        .when(n > F.col("__max"), _issue("critical", "limits", F.concat(
            F.lit("$top value "), shown, F.lit(" exceeds maximum allowed"), "__hint", F.lit(": "), F.col("__max").cast("string")),
            top_text, F.concat(F.lit("Reduce $top to "), F.col("__max").cast("string"), F.lit(" or less"))))
        .when(n > F.col("__warn"), _issue("warning", "limits", F.concat(
            F.lit("$top value "), shown, F.lit(" is high"), "__hint", F.lit(" (threshold: "), F.col("__warn").cast("string"), F.lit(")")),
            top_text, "Consider reducing the limit for better performance")))
    depth, complexity, score = F.col("expand_depth"), F.col("filter_complexity"), F.col("cost_score")
    level = "critical" if cfg.complexity_critical else "warning"
    costs = [
        F.when(depth > cfg.max_expand, _issue("critical", "cost", F.concat(
            F.lit("$expand depth "), depth.cast("string"), F.lit(f" exceeds maximum: {cfg.max_expand}")),
            F.concat(F.lit("$expand="), "__expand"), f"Reduce nesting depth to {cfg.max_expand} or less")),
        F.when(complexity > cfg.max_complexity, _issue(level, "cost", F.concat(
            F.lit("Filter complexity score "), complexity.cast("string"),
            F.lit(f" exceeds recommended maximum: {cfg.max_complexity}")), filter_text,
            "Simplify the filter expression or break into multiple queries")),
        F.when(score > cfg.max_cost, _issue("critical", "cost", F.concat(
            F.lit("Query cost score "), F.format_string("%.1f", score), F.lit(f"/100 exceeds maximum allowed ({cfg.max_cost})")),
            None, "Consider adding filters, reducing $top, or limiting $expand depth"))
        .when(score > cfg.warn_cost, _issue("warning", "cost", F.concat(
            F.lit("Query has moderate cost: "), F.format_string("%.1f", score), F.lit(f"/100 (limit: {cfg.max_cost})")),
            None, "Monitor performance and consider optimizations if slow")),
    ]
    found = F.concat(syntax, F.array_compact(F.array(*safety)), F.array_compact(F.array(*limits)), F.array_compact(F.array(*costs)))
    nothing = F.array(_issue("critical", "generation", "No OData query was generated", None, "Check query generation"))
    # Every row counts as seen; a filter on the issues would else be moved below and repeat all the text work many times over.
    seen = F.monotonically_increasing_id() >= 0
    out = out.withColumn("__found", F.when(seen & empty, nothing).otherwise(found))
    critical = F.filter("__found", lambda i: i["severity"] == "critical")
    others = F.filter("__found", lambda i: i["severity"] != "critical")
    out = out.withColumns({
        "issues": F.concat(critical, others), "n_critical": F.size(critical), "is_valid": (F.size(critical) == 0).cast("int"),
        "estimated_rows": F.when(~empty, n.try_cast("long"))})
    return out.select(*df.columns, "entity", "is_valid", "n_critical", F.size("issues").alias("n_issues"), "cost_score",
                      "estimated_rows", "expand_depth", "filter_complexity", "issues")


def audit_report(audited: DataFrame) -> DataFrame:
    """Issues per entity, category and severity."""
    long = audited.select(F.coalesce("entity", F.lit("")).alias("entity"), F.inline("issues"))
    return long.groupBy("entity", "category", "severity").agg(F.count(F.lit(1)).alias("n"))
