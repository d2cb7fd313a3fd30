"""URL filter with a tree of path templates, in DataFrame functions only.

Listed rules decide first: the longest rule whose host is the url's host or a parent domain of it and
whose path starts the url's path. All other urls are judged by templates. The path is split into
segments; numbers and hexadecimal values are variable, any other value stays literal if enough urls of the same
host and template so far have it, else it becomes a wildcard by its shape (file with an extension, any). On every
level of the tree, branches of one parent whose labelled purity doesn't differ statistically from their siblings' are
merged into one wildcard. A template is rejected if its share of bad labels, smoothed towards its
host's and the corpus', is high. Urls are counted by host and path first, so the tree is built from counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from ._common import DataFrame, F, SparkSession, is_small, let, stored, tables


@dataclass(frozen=True)
class Settings:
    literal_rows: int = 5  # urls that keep a segment literal
    merge_z: float = 1.96  # branches with a smaller standardised difference of purity are merged
    prior: float = 20.0  # labelled urls that a host's or the corpus' rate counts as
    reject: float = 0.5  # smoothed share of bad labels from which a template is blocked
    least: int = 3  # labelled urls without which no template is blocked


#: (verdict, host, path) of the listed rules; "com" stands for itself and all its subdomains.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    # lower() would also change letters outside ASCII
    low = F.when(raw.rlike(r"^[\x00-\x7f]*$"), F.lower(raw)).otherwise(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.coalesce(low, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path) and its verdict; nulls if none fits. Of equally long rules the first wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _variable(s: Column) -> Column:
    """The wildcard of a segment that is variable by itself, else the segment."""
    return (
        F.when(s.rlike(r"^[0-9]+$"), "<number>")
        .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("<number>."), F.substring_index(s, ".", -1)))
        .when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), "<hex>")
        .otherwise(s)
    )


def _wildcard(s: Column) -> Column:
    """The wildcard of a rare segment."""
    return F.when(s.rlike(r"^<(number|hex)"), s).when(s.rlike(r"^.+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("<name>."), F.substring_index(s, ".", -1))).otherwise("<any>")


def shaped(path: Column) -> Column:
    """The segments of a path, variable ones as their wildcards."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), _variable)


def _side(table: DataFrame, limit: int = 200_000) -> DataFrame:
    return F.broadcast(table) if is_small(table, limit) else table


def _named_whole(s: Column) -> Column:
    return F.transform(s, _wildcard)


def tree(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, shaped, n (labelled urls), bad, t (template, an array) per distinct shaped path.

    ``pages``: host, shaped, bad (0, 1 or null). Urls of a host with the same template so far are a group. One of too few
    urls has only wildcards from there on. The others take over, in one step, all segments that their paths share, and
    then count the next one, where they branch; so there are as many rounds as a path has branches, not segments.
    """
    paths = pages.groupBy("host", "shaped").agg(F.count("*").alias("urls"), F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    rows, _ = stored(paths.withColumns({"t": F.array().cast("array<string>"), "rest": F.col("shaped"), "_done": F.size("shaped") == 0}), "paths")
    parts = []
    while True:
        parts.append(rows.where("_done"))
        now = rows.where("not _done").drop("_done")
        group, _ = stored(now.groupBy("host", "t").agg(F.sum("urls").alias("c"), F.min("rest").alias("_lo"), F.max("rest").alias("_hi")).where(F.col("c") >= settings.literal_rows).drop("c"), "groups")
        if not group.head(1):
            parts.append(now.withColumns({"t": F.concat("t", _named_whole(F.col("rest"))), "rest": F.array().cast("array<string>")}))
            break
        # what the first and the last path in order share, all between share too
        differs = F.array_position(F.zip_with("_lo", "_hi", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        shared = F.when(differs > 0, differs - 1).otherwise(F.least(F.size("_lo"), F.size("_hi"))).cast("int")
        now = now.join(_side(group.select("host", "t", shared.alias("_k"))), ["host", "t"], "left")
        few = F.col("_k").isNull()
        taken = F.when(few, _named_whole(F.col("rest"))).otherwise(F.slice("rest", 1, F.col("_k")))
        left = F.when(few, F.array().cast("array<string>")).otherwise(F.slice("rest", F.col("_k") + 1, F.size("rest")))
        now, _ = stored(now.select("host", "shaped", "urls", "n", "bad", F.concat("t", taken).alias("t"), left.alias("rest")).withColumn("_s", F.get("rest", F.lit(0))), "shared")
        counts = now.where("_s is not null").groupBy("host", "t", "_s").agg(F.sum("urls").alias("c")).where(F.col("c") >= settings.literal_rows)
        literal, _ = stored(counts.select("host", "t", "_s", F.lit(True).alias("_lit")), "literals")
        own = F.when(F.col("_lit"), F.col("_s")).otherwise(_wildcard(F.col("_s")))
        stepped = now.join(_side(literal), ["host", "t", "_s"], "left")
        ended = F.col("_s").isNull()
        stepped = stepped.withColumns({"t": F.when(ended, F.col("t")).otherwise(F.array_append("t", own)), "rest": F.when(ended, F.col("rest")).otherwise(F.slice("rest", 2, F.size("rest")))})
        rows, _ = stored(stepped.drop("_s", "_lit").withColumn("_done", F.size("rest") == 0), "paths")
    out = None
    for part in parts:
        part = part.select("host", "shaped", "n", "bad", "t")
        out = part if out is None else out.unionByName(part)
    return out


def merged(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``m``, the template after merging branches; rows as ``tree`` gives them.

    A branch is compared with its siblings, all under the parent of that template. Merging deeper or higher branches
    changes neither, so all levels are judged at once. A parent is known by a chained 128-bit hash of its segments.
    """
    now, _ = stored(rows, "tree")
    chain = F.aggregate("t", F.array(F.lit("")), lambda acc, x: F.array_append(acc, F.md5(F.concat(F.element_at(acc, -1), F.lit("/"), x))))
    spots = let(chain, lambda c: F.transform("t", lambda x, i: F.struct(i.alias("i"), F.get(c, i).alias("p"), x.alias("o"))))
    spread = now.select("host", "shaped", "n", "bad", F.explode(spots).alias("e")).select("host", "shaped", "n", "bad", "e.*")
    node, _ = stored(spread.groupBy("host", "p", "o").agg(F.sum("n").alias("nn"), F.sum("bad").alias("nb")), "nodes")
    whole = node.groupBy("host", "p").agg(F.sum("nn").alias("pn"), F.sum("nb").alias("pb"), F.count("*").alias("sibs")).where("sibs > 1")
    both = node.join(whole, ["host", "p"])
    n1, b1, n2, b2 = F.col("nn"), F.col("nb"), F.col("pn") - F.col("nn"), F.col("pb") - F.col("nb")
    # standardised difference between a branch and its siblings, with one pseudo-label of each kind
    p1, p2 = (b1 + 1) / (n1 + 2), (b2 + 1) / (n2 + 2)
    z = F.abs(p1 - p2) / F.sqrt(p1 * (1 - p1) / (n1 + 2) + p2 * (1 - p2) / (n2 + 2))
    alike, _ = stored(both.where(z < settings.merge_z).select("host", "p", "o"), "alike")
    places = spread.join(_side(alike), ["host", "p", "o"]).groupBy("host", "shaped").agg(F.collect_set("i").alias("_at"))
    own = F.transform("t", lambda x, i: F.when(F.array_contains("_at", i), F.lit("<merged>")).otherwise(x))
    return now.join(places, ["host", "shaped"], "left").withColumn("m", F.when(F.col("_at").isNull(), F.col("t")).otherwise(own)).drop("_at")


def template_rates(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, shaped, template, n, bad (labelled urls of the template), rate (smoothed)."""
    now, _ = stored(merged(rows, settings), "merged")
    base = now.agg((F.sum("bad") + 1) / (F.sum("n") + 2)).first()[0]
    base = 0.0 if base is None else float(base)
    host = now.groupBy("host").agg(((F.sum("bad") + settings.prior * base) / (F.sum("n") + settings.prior)).alias("host_rate"))
    rates = now.groupBy("host", "m").agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb")).join(host, "host")
    rate = (F.col("tb") + settings.prior * F.col("host_rate")) / (F.col("tn") + settings.prior)
    rates = rates.select("host", "m", "tn", "tb", rate.alias("rate"))
    return now.select("host", "shaped", "m").join(rates, ["host", "m"]).select("host", "shaped", F.concat(F.lit("/"), F.array_join("m", "/")).alias("template"), F.col("tn").alias("n"), F.col("tb").alias("bad"), "rate")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", bad: str = "bad", rules: list[tuple[str, str, str]] = RULES, settings: Settings = Settings()) -> DataFrame:
    """``key``, host, path, rule, verdict, template, n_labels and rate, one row per input row.

    ``bad`` is 1 or 0 for labelled rows, else null. A null url or one without ``://`` has empty host and path,
    fits no rule and has the empty template of the empty host. Without labels only rules block. Paths of any length are
    followed to their end; repeated rows are judged each.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(bad).cast("int").alias("bad"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows, _ = stored(rows.withColumns({"rule": rule, "listed": verdict, "shaped": shaped(F.col("path"))}), "urls")
    rates, _ = stored(template_rates(tree(rows, settings), settings), "rates")
    own = F.when((F.col("n") >= settings.least) & (F.col("rate") >= settings.reject), "block").otherwise("allow")
    out = rows.drop("bad").join(_side(rates, 100_000), ["host", "shaped"], "left")
    return out.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("listed", own).alias("verdict"), "template", F.col("n").alias("n_labels"), "rate")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path: bad if toxic or of low quality."""
    pages = tables(spark, sf_dir, "pages").select("page_id", "url")
    labels = tables(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    labels = labels.groupBy("number").agg(F.max("bad").alias("bad"))
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    keyed = pages.withColumn("number", F.when(number != "", number).cast("long"))
    return judge(keyed.join(labels, "number", "left"))
