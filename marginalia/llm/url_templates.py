"""URL filtering by rules and by path templates; DataFrame functions only.

1. A URL gives host and path. Rules (host and path, allow or block) fit a host with all its subdomains and the
   paths that start alike; the longest fitting rule decides.
2. What no rule decides is judged by its host's path-template tree. Segments with digits and very long ones are
   variable (`*`); a node with more than `max_branches` different segments has a variable segment there, and so on below, where the
   branches meet. Pages are first counted by host and shape; a shape's prefixes stand for the nodes, all levels in one sum, so that
   deep paths take no more steps than short ones and no host's pages have to meet in one task. A node of one shape is a leaf:
   the rest of its path stands as one segment.
3. Similar siblings become one branch, at all levels at once, until nothing merges. A sibling is similar to all siblings together if
   the pages below are spread alike over what follows it in their paths (shares in common at least `merge_overlap`), and its share
   of bad labelled pages doesn't differ (z below `merge_z`). One without labelled pages isn't if labels stand in one sibling
   alone: these say nothing of the others.
4. A template is rejected when its purity, bad labelled pages over labelled pages, reaches `reject`. It is smoothed
   from all pages by domain (the last two names of the host), host and each node of the tree down to the branch:
   each purity has a Beta prior of the same weight (`prior_bad` + `prior_good`) centred on that of its parent, the first
   one by `prior_bad` and `prior_good`. A parent whose labels stand in one branch alone (of all pages: one domain; of a domain:
   one first segment) is passed over, so that a rule for one path doesn't block its host. So a template without labelled pages has the purity of the nearest
   parent that has some in two branches. The labels are the rules' own verdicts, unless the caller gives a label column (1 bad, 0 good, null or
   another number unknown).

Null URLs and URLs without "://" have empty host and path, fit no rule, have no template and no purity, and are allowed.
Very long URLs are judged whole. Repeated URLs are judged alike and count each; columns of other names do not
matter. Ties of rules (equal length) go to block. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.workspace import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TemplateRules:
    max_branches: int = 12
    max_segment: int = 40
    merge_z: float = 1.96
    merge_overlap: float = 0.5
    prior_bad: float = 1.0
    prior_good: float = 2.0
    reject: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def fitting_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def path_shape(path: Column, rules: TemplateRules) -> Column:
    """The segments of a path, variable ones as '*'."""
    segments = F.split(path, "/")
    return F.transform(F.slice(segments, 2, F.size(segments)), lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > rules.max_segment), "*").otherwise(s))


_NODE = ["host", "branch"]


def _nodes(rows: DataFrame, path: str, *columns: str, ends: bool = False) -> DataFrame:
    """A row for each row and segment of its path: the columns, level (from 0), parent (hash of what stands before), own (the segment).

    With ends, one more for where the path ends, without a segment. All levels at once: depth adds rows, no further steps."""
    last = F.size(path) if ends else F.size(path) - 1
    levels = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    exploded = rows.select(path, *[c for c in columns if c != path], F.explode(levels).alias("level"))
    return exploded.select(path, *[c for c in columns if c != path], "level", F.expr(f"xxhash64(slice({path}, 1, level))").alias("parent"), F.get(path, F.col("level")).alias("own"))


def _generalised(shapes: DataFrame, rules: TemplateRules) -> DataFrame:
    """shapes: host, shape, and counts. Adds `branch`, the template's segments.

    Nodes with many different segments get a variable one, everywhere at once; below these, branches meet and may become wide in turn, so this goes on until
    no node is. There are as many rounds as variable segments found this way stand in one path. Then a node of one shape is a leaf."""
    tree = written(shapes.withColumn("branch", F.col("shape")), "url-shapes")
    while True:
        nodes = _nodes(tree, "branch", "host", "shape").withColumn("written", F.get("shape", F.col("level")))
        # Segments count as they were written, for a variable one stands for many.
        wide = nodes.groupBy("host", "level", "parent").agg(F.countDistinct("written").alias("n"), F.bool_or(F.col("own") != "*").alias("open"))
        wide = wide.where((F.col("n") > rules.max_branches) & F.col("open")).select("host", "level", "parent")
        wide = written(nodes.join(wide, ["host", "level", "parent"]).groupBy("host", "shape").agg(F.collect_set("level").alias("levels")), "url-wide")
        if wide.isEmpty():
            break
        starred = F.transform("branch", lambda s, i: F.when(F.array_contains("levels", i), "*").otherwise(s))
        tree = written(tree.join(wide, ["host", "shape"], "left").withColumn("branch", F.when(F.col("levels").isNull(), F.col("branch")).otherwise(starred)).drop("levels"), "url-shapes")
    # Nodes that one shape alone goes through; the topmost of them is its leaf.
    alone = _nodes(tree, "branch", "host", "shape", ends=True).groupBy("host", "level", "parent").agg(F.count(F.lit(1)).alias("n"), F.any_value("shape").alias("shape")).where("n = 1")
    leaf = alone.groupBy("host", "shape").agg(F.min("level").alias("leaf"))
    cut = F.concat(F.slice("branch", F.lit(1), F.col("leaf")), F.array(F.array_join(F.expr("slice(shape, leaf + 1, size(shape))"), "/")))
    joined = tree.join(leaf, ["host", "shape"], "left")
    return written(joined.withColumn("branch", F.when(F.col("leaf") < F.size("shape"), cut).otherwise(F.col("branch"))).drop("leaf"), "url-tree")


def _merged(templates: DataFrame, rules: TemplateRules) -> DataFrame:
    """templates: host, template (segments), pages, labelled, bad. Adds `branch`: similar siblings under one name.

    Siblings of all levels are compared at once; what has merged makes others alike, so this goes on until nothing merges. Each round takes names away."""
    out = written(templates.withColumn("branch", F.col("template")), "url-branches")
    node = ["host", "level", "parent"]
    while True:
        below = _nodes(out, "branch", "host", "template", "pages", "labelled", "bad").withColumn("after", F.expr("xxhash64(slice(branch, level + 2, size(branch)))"))
        # Counts by sibling and by what follows; the same for all siblings of a node.
        spread = below.groupBy(*node, "own", "after").agg(F.sum("pages").alias("m"), F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
        every = spread.groupBy(*node, "after").agg(F.sum("m").alias("m_all"))
        sibling = spread.groupBy(*node, "own").agg(F.sum("m").alias("m_own"), F.sum("n").alias("n"), F.sum("b").alias("b"))
        of_node = sibling.groupBy(node).agg(F.sum("m_own").alias("m_node"), F.sum("n").alias("n_node"), F.sum("b").alias("b_node"), F.count(F.lit(1)).alias("siblings"), F.count_if(F.col("n") > 0).alias("told"))
        sibling = sibling.join(of_node.where("siblings > 1"), node)
        common = F.sum(F.least(F.col("m") / F.col("m_own"), F.col("m_all") / F.col("m_node"))).alias("overlap")
        overlap = spread.join(every, [*node, "after"]).join(sibling.select(*node, "own", "m_own", "m_node"), [*node, "own"]).groupBy(*node, "own").agg(common)
        p = F.try_divide(F.col("b_node"), F.col("n_node"))
        deviation = F.sqrt(F.try_divide(p * (1 - p), F.col("n")))
        as_labelled = F.when(F.col("n") == 0, F.col("told") != 1).otherwise(F.abs(F.try_divide(F.col("b"), F.col("n")) - p) <= rules.merge_z * deviation)
        same = as_labelled & (F.col("overlap") >= rules.merge_overlap - 1e-9) & (F.col("own") != "~")
        names = sibling.join(overlap, [*node, "own"]).where(same).select(*node, "own")
        found = written(below.join(names, [*node, "own"]).groupBy("host", "template").agg(F.collect_set("level").alias("levels")), "url-merges")
        if found.isEmpty():
            return out
        renamed = F.transform("branch", lambda s, i: F.when(F.array_contains("levels", i), "~").otherwise(s))
        out = written(out.join(found, ["host", "template"], "left").withColumn("branch", F.when(F.col("levels").isNull(), F.col("branch")).otherwise(renamed)).drop("levels"), "url-branches")


def domain_of(host: Column) -> Column:
    """The last two names of a host."""
    return F.substring_index(host, ".", -2)


def _smoothed(merged: DataFrame, rules: TemplateRules) -> DataFrame:
    """merged: host, template, branch, labelled, bad. The purity of each host's branches, smoothed from all pages by domain, host and node down.

    A level counts as a prior only if labels stand in two of its branches at least: those of one branch say nothing of the others."""
    weight = rules.prior_bad + rules.prior_good
    sums = (F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    rows = merged.withColumns({"domain": domain_of(F.col("host")), "first": F.coalesce(F.get("template", F.lit(0)), F.lit(""))})
    told = lambda column: F.countDistinct(F.when(F.col("labelled") > 0, F.col(column))).alias("told")
    # One row: the counts of all labelled pages.
    every = rows.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n_all"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b_all"), told("domain").alias("told_all"))
    domains = rows.groupBy("domain").agg(*sums, told("first"))
    levels = F.sequence(F.lit(0), F.greatest(F.size("branch") - 1, F.lit(0)))
    at = rows.select("host", "domain", "branch", "template", "labelled", "bad", F.explode(levels).alias("level"))
    at = written(at.withColumns({"parent": F.expr("xxhash64(slice(branch, 1, level))"), "own": F.get("template", F.col("level"))}), "url-levels")
    nodes = at.groupBy("host", "level", "parent").agg(*sums, told("own"))
    chain = at.select("host", "domain", "branch", "level", "parent").distinct().join(nodes, ["host", "level", "parent"])
    steps = chain.groupBy("host", "domain", "branch").agg(F.array_sort(F.collect_list(F.struct("level", "n", "b", "told"))).alias("chain"))
    own = merged.groupBy(_NODE).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    centred = lambda b, n, parent: (b + weight * parent) / (n + weight)
    first = F.lit(rules.prior_bad / weight)
    start = F.when(F.col("told_all") > 1, centred(F.col("b_all"), F.col("n_all"), first)).otherwise(first)
    passed = F.when(F.col("told") > 1, centred(F.col("b"), F.col("n"), start)).otherwise(start)
    through = F.aggregate("chain", F.col("prior"), lambda p, c: F.when(c["told"] > 1, centred(c["b"], c["n"], p)).otherwise(p))
    priors = domains.join(F.broadcast(every)).select("domain", passed.alias("prior"))
    last = steps.join(priors, "domain").join(own, _NODE)
    return last.select("host", "branch", centred(F.col("bad"), F.col("labelled"), through).alias("purity"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, options: TemplateRules = TemplateRules()) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the template with its smoothed purity."""
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), F.when(label.isin(0, 1), label).alias("_label"))
    text, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
    ruled = parsed.withColumn("rule", text).withColumn("_ruled", verdict)
    judged = ruled.where("host <> ''").withColumn("shape", path_shape(F.col("path"), options))
    bad = F.coalesce("_label", F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0))
    shapes = judged.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count(bad).alias("labelled"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
    tree = _generalised(shapes, options)
    templates = tree.groupBy("host", F.col("branch").alias("template")).agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "bad")))
    merged = _merged(templates, options)
    purity = _smoothed(merged, options)
    by_template = merged.select("host", "template", "branch").join(purity, _NODE).select("host", F.col("template").alias("branch"), "purity")
    by_shape = tree.select("host", "shape", "branch").join(by_template, _NODE).select("host", "shape", F.concat(F.lit("/"), F.array_join("branch", "/")).alias("template"), "purity")
    out = judged.join(by_shape, ["host", "shape"], "left").drop("shape")
    # Without a host there is nothing to look up: these rows don't meet under one key.
    out = out.unionByName(ruled.where("host = ''").withColumns({"template": F.lit(None).cast("string"), "purity": F.lit(None).cast("double")}))
    by_method = F.when(F.col("purity") >= options.reject, "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_ruled", by_method).alias("verdict"), "template", "purity")
