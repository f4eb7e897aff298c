r"""Judge URLs by a tree of path templates per host.

A path is cut at `/` into segments; each segment is a node below its parents. A segment that is a number (an
extension may follow) is variable at once; other segments become a wildcard where their parent has many
children of which most are rare. What remains is the host's template tree, e.g. `/en/{n}.html`. Wildcards are
decided from the root down: once children become one, their subtrees are joined before the next level is counted.

Host rules label the pages they fit. Labels are counted per template, and similar branches of a host's tree are merged, level
by level under merged parents: the children of a node are put in order of their shares of blocked pages, and neighbours
whose shares do not differ significantly (chi-square of two samples) become one branch. Children without labels join if all
labelled ones are one branch. So a thin branch borrows the labels of its similar siblings. The smoothed share of blocked
pages, (blocked + STRENGTH * parent) / (labelled + STRENGTH), goes from all pages over the template, which several hosts may
share, to the host's own merged branch, where that differs significantly; the method blocks where it reaches REJECT.

Counts are taken per (host, template) before anything is joined, and what is joined back to pages is one
verdict per (host, template). Hot hosts are dealt over SALTS keys.

Nulls, urls without `://`: host and path are empty, they form a template of their own. Repeated rows and equal
urls get equal verdicts; empty tables give empty results; very long paths are cut into as many segments as
they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.llm.common import Scratch

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
WIDE = 20
RARE_SHARE = 0.05
STRENGTH = 4.0
REJECT = 0.5
CHI_SQUARE = 3.841
SALTS = 16


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, form, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, form, 2)


def fitting_rule(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def lexed(path: Column) -> Column:
    """Segments of a path, numbers as {n}."""
    return F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, r"^[0-9]+(\.[A-Za-z0-9]+)?$", "{n}$1"))


def chained(segments: Column) -> Column:
    """For each segment (parent, segment): parent is a hash of all segments above it, see above()."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<parent:bigint,segment:string>>").alias("out"))
    return F.aggregate(
        segments,
        start,
        lambda acc, s: F.struct(
            F.xxhash64(acc["at"], s).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("parent"), s.alias("segment")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def above(segments: Column, at: int) -> Column:
    """The parent that chained() gives segment `at`."""
    return F.aggregate(F.slice(segments, 1, at), F.lit(0).cast("bigint"), lambda acc, s: F.xxhash64(acc, s))


def wildcards(pages: DataFrame, settled: int = -1, wide: int = WIDE, rare_share: float = RARE_SHARE) -> DataFrame:
    """(host, at, parent, segment) that become a wildcard: rare children of nodes with more than `wide` children.

    Only segments after number `settled` are looked at. Children are counted first, so a hot node brings one row per
    child and task to the shuffle.
    """
    nodes = pages.select("host", F.posexplode(chained(F.col("segments"))).alias("at", "node")).filter(F.col("at") > settled)
    children = nodes.groupBy("host", "at", "node.parent", "node.segment").agg(F.count(F.lit(1)).alias("n"))
    parents = children.groupBy("host", "at", "parent").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"))
    wide_ones = parents.filter(F.col("kinds") > wide)
    return (
        children.join(wide_ones, ["host", "at", "parent"])
        .filter((F.col("n") < F.lit(rare_share) * F.col("total")) & ~F.col("segment").startswith("{"))
        .select("host", "at", "parent", "segment")
    )


def rewritten(pages: DataFrame, wild: DataFrame, at: int) -> DataFrame:
    """`pages` with segment number `at` as {*} where `wild` has it."""
    dealt = wild.select("host", "parent", "segment", F.lit(True).alias("_wild"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    placed = pages.withColumns({"parent": above(F.col("segments"), at), "segment": F.get("segments", F.lit(at)), "salt": F.col("_row") % SALTS})
    shown = F.transform("segments", lambda s, i: F.when(i == at, F.lit("{*}")).otherwise(s))
    joined = placed.join(dealt, ["host", "parent", "segment", "salt"], "left")
    return joined.withColumn("segments", F.when(F.col("_wild"), shown).otherwise(F.col("segments"))).select(*pages.columns)


def with_templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Add `template`, the path with its variable segments as {n} or {*}. Needs host, path and a unique _row.

    Each round settles the paths down to the next level that has wildcards, so levels without any cost nothing.
    """
    cut = pages.withColumn("segments", lexed(F.col("path")))
    settled = -1
    while True:
        wild = scratch(wildcards(cut, settled), "wildcards")
        settled = wild.agg(F.min("at")).first()[0]
        if settled is None:
            return cut.withColumn("template", F.array_join("segments", "/")).drop("segments")
        cut = scratch(rewritten(cut, wild.filter(F.col("at") == settled), settled), "segments")


def smoothed(blocked: str, labelled: str, prior: Column, strength: float) -> Column:
    return (F.col(blocked) + F.lit(strength) * prior) / (F.col(labelled) + F.lit(strength))


def product(first: Column, *others: Column) -> Column:
    """Product of whole numbers as a double, taken exactly while it has at most 38 digits; it never overflows."""
    whole, rough = first.cast("decimal(38,0)"), first.cast("double")
    for other in others:
        whole, rough = F.try_multiply(whole, other.cast("decimal(38,0)")), rough * other.cast("double")
    return F.coalesce(whole.cast("double"), rough)


def shares_differ(b: Column, l: Column, pb: Column, pl: Column) -> Column:
    """Whether b of l and pb of pl differ by chi-square of two samples; counts of any size."""
    wide = lambda c: c.cast("decimal(19,0)")
    gap, both, all_ = wide(b) * wide(pl) - wide(pb) * wide(l), wide(b) + wide(pb), wide(l) + wide(pl)
    return product(gap, gap, all_) > F.lit(CHI_SQUARE) * product(both, all_ - both, l, pl)


def similar_siblings(counts: DataFrame, settled: int = -1) -> DataFrame:
    """(host, at, parent, segment, branch): children of one node that merge, and the number of the branch they become.

    Needs host, segments, blocked and labelled. A node has few children that are no wildcards: wide ones keep those that are
    not rare.
    """
    nodes = counts.select("host", "blocked", "labelled", F.posexplode(chained(F.col("segments"))).alias("at", "node")).filter(F.col("at") > settled)
    plain = nodes.filter(~F.col("node.segment").startswith("{"))
    children = plain.groupBy("host", "at", "node.parent", "node.segment").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    node = ["host", "at", "parent"]
    by_share = Window.partitionBy(*node).orderBy("share", "segment")
    told = children.filter("l > 0").withColumn("share", F.col("b") / F.col("l"))
    told = told.withColumns({"pb": F.lag("b").over(by_share), "pl": F.lag("l").over(by_share)})
    differ = shares_differ(F.col("b"), F.col("l"), F.col("pb"), F.col("pl"))
    begins = F.when(F.col("pb").isNull() | differ, 1).otherwise(0)
    grouped = told.withColumn("branch", F.sum(begins).over(by_share.rowsBetween(Window.unboundedPreceding, 0)))
    lone = grouped.groupBy(*node).agg(F.max("branch").alias("branch")).filter("branch = 1")
    joined = children.filter("l = 0").join(lone, node)
    every = grouped.select(*node, "segment", "branch").unionByName(joined.select(*node, "segment", "branch"))
    sizes = every.groupBy(*node, "branch").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return every.join(sizes, [*node, "branch"]).select(*node, "segment", "branch")


def merged_branches(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """Add `segments`, the template's segments with merged branches as {=number}; counts have one row per (host, template)."""
    cut = counts.withColumn("segments", F.split("template", "/"))
    settled = -1
    while True:
        same = scratch(similar_siblings(cut, settled), "siblings")
        settled = same.agg(F.min("at")).first()[0]
        if settled is None:
            return cut
        level = same.filter(F.col("at") == settled).select("host", "parent", "segment", F.concat(F.lit("{="), "branch", F.lit("}")).alias("_branch"))
        placed = cut.withColumns({"parent": above(F.col("segments"), settled), "segment": F.get("segments", F.lit(settled))})
        joined = placed.join(level, ["host", "parent", "segment"], "left")
        shown = F.transform("segments", lambda s, i: F.when(i == settled, F.col("_branch")).otherwise(s))
        named = F.when(F.col("_branch").isNotNull(), shown).otherwise(F.col("segments"))
        cut = scratch(joined.withColumn("segments", named).select(*cut.columns), "branches")


def template_purity(pages: DataFrame, scratch: Scratch, strength: float = STRENGTH) -> DataFrame:
    """(host, template, impurity): smoothed share of blocked pages of each host's template.

    Needs host, template and said (allow, block or null).
    """
    counts = pages.groupBy("host", "template").agg(
        F.count(F.when(F.col("said") == "block", 1)).alias("blocked"), F.count("said").alias("labelled")
    )
    counts = scratch(counts, "templates")
    cut = merged_branches(counts, scratch)
    whole = counts.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    prior = F.broadcast(whole.select(((F.coalesce("b", F.lit(0)) + 1) / (F.coalesce("l", F.lit(0)) + 2)).alias("base")))
    shapes = (
        counts.groupBy("template")
        .agg(F.sum("blocked").alias("shape_blocked"), F.sum("labelled").alias("shape_labelled"))
        .join(prior)
        .withColumn("shape", smoothed("shape_blocked", "shape_labelled", F.col("base"), strength))
    )
    branches = cut.groupBy("host", "segments").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    named = cut.select("host", "template", "segments").join(branches, ["host", "segments"]).join(shapes.select("template", "shape"), "template")
    expected = F.col("l") * F.col("shape")
    strange = (F.col("b") - expected) * (F.col("b") - expected) > CHI_SQUARE * expected * (1 - F.col("shape"))
    own = F.when((F.col("l") > 0) & strange, smoothed("b", "l", F.col("shape"), strength))
    return named.select("host", "template", F.coalesce(own, F.col("shape")).alias("impurity"))


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """key, host, path, rule, verdict, template and impurity of each row of `pages`."""
    host, path = split_url(url)
    rule, said = fitting_rule(rules)
    parsed = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumns({"rule": rule, "said": said, "_row": F.monotonically_increasing_id()})
    scratch = Scratch(pages.sparkSession, "url-templates")
    templated = scratch(with_templates(scratch(parsed, "urls"), scratch), "paths")
    verdicts = template_purity(templated, scratch)
    dealt = verdicts.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    judged = templated.withColumn("salt", F.col("_row") % SALTS).join(dealt, ["host", "template", "salt"], "left")
    method = F.when(F.col("impurity") >= REJECT, "block").otherwise("allow")
    return scratch.finish(
        judged.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", "impurity")
    )
