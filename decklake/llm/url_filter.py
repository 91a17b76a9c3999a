"""URL filters by a path-template tree, with Spark's own functions only.

Under each host a path's segments are the steps from node to node of a tree. Level by level, the light children of a node
(each with a small share of its pages) become one wildcard where there are many; numbers and long tokens are wildcards
from the start. Children whose labelled purity does not differ from their parent's by more than chance merge into one branch.
A node's purity is smoothed toward its parent's, a host's root toward the same tree over all hosts, and templates whose
purity says so are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.llm.common import bound, hot_join, stored

#: Rules as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Light children from which they become a wildcard, share of a node's pages (one page aside) from which a child is not light,
#: weight of the parent in a smoothed purity, deviations within which branches are alike, and share of
#: blocked pages from which a template is rejected.
VARIES, SHARE, WEIGHT, ALIKE, REJECT = 8, 0.05, 8.0, 2.0, 0.5
_VARIABLE = r"^(\d+|[0-9a-f]{8,}|.*\d{3,}.*)(\.[a-z]{2,5})?$"
_ROOT = 0


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent domain, and whose path the url's starts with; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The steps of a path: its segments, those that are numbers or long tokens as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(F.lower(s).rlike(_VARIABLE), "*").otherwise(s))


def _next(node: Column, step: Column) -> Column:
    return F.xxhash64(node, step)


def _decisions(live: DataFrame) -> DataFrame:
    """(host, node, line) of the nodes of ``live(host, node, at, steps, pages)`` with more than ``VARIES`` paths below: what becomes of each
    further place, as long as the node's paths stay together, and of the one at which they part.

    A place's children are counted over all the node's paths, which holds until these part; so a chain of places, be its steps the
    same everywhere or all variable, takes one round. ``fixed`` are a place's steps that stay where others become wildcards.
    """
    rest = F.slice("steps", F.col("at") + 1, F.size("steps"))
    kids = live.select("host", "node", "pages", F.posexplode(rest).alias("place", "step")).groupBy("host", "node", "place", "step").agg(F.count(F.lit(1)).alias("paths"), F.sum("pages").alias("n"))
    kids = stored(kids, "url-children")
    whole = stored(kids.groupBy("host", "node", "place").agg(F.sum("paths").alias("all_paths"), F.sum("n").alias("all")).where((F.col("place") > 0) | (F.col("all_paths") > VARIES)), "url-places")
    known = hot_join(kids, whole, ["host", "node", "place"], F.col("step")).where("all is not null")
    star = F.col("step") == "*"
    heavy = ((F.col("n") - 1) >= SHARE * F.col("all")) | star
    places = known.groupBy("host", "node", "place").agg(F.first("all_paths").alias("all_paths"), F.count_if(~heavy).alias("light"), F.count_if(heavy & ~star).alias("heavy"), F.max(star).alias("star"), F.collect_set(F.when(heavy, F.col("step"))).alias("fixed"))
    varies = F.col("light") > VARIES
    # one child only, once light ones are a wildcard
    together = (F.col("heavy") + F.when(varies, 0).otherwise(F.col("light")) + (F.col("star") | varies).cast("int") == 1) & (F.col("all_paths") > VARIES)
    line = places.groupBy("host", "node").agg(F.array_sort(F.collect_list(F.struct("place", together.alias("together"), F.when(varies, F.col("fixed")).alias("fixed")))).alias("line"))
    parts = F.array_position(F.transform("line", lambda x: x["together"]), False)
    cut = F.when(parts > 0, F.slice("line", F.lit(1), parts)).otherwise(F.col("line"))
    # a node whose first place is missing here has few paths
    return line.where(F.col("line")[0]["place"] == 0).select("host", "node", cut.alias("line"))


def templates(paths: DataFrame) -> DataFrame:
    """(host, steps, template) of ``paths(host, steps, pages)``: the steps, those that vary as ``*``.

    Decided from the root down, until no node has more than ``VARIES`` paths below it: none of its children can become a wildcard
    then, so deeper steps stay as they are. A child is light if it has, one page aside, less than ``SHARE`` of its node's pages. A round
    takes each node to the place at which its paths part, and only paths of nodes that may still vary go on to the next, so that
    rounds follow the branches on a path, not its length.
    """
    live = stored(paths.select("host", "steps", "pages", F.lit(_ROOT).cast("bigint").alias("node"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("template")), "url-paths")
    done = []
    while True:
        lines = stored(_decisions(live), "url-decisions")
        if lines.isEmpty():
            done.append(live)
            break
        rows = stored(hot_join(live, lines, ["host", "node"], F.col("steps")), "url-paths")
        done.append(rows.where("line is null"))
        new = F.transform("line", lambda x: bound(F.get(F.col("steps"), F.col("at") + x["place"]), lambda s: F.when(x["fixed"].isNotNull() & ~F.array_contains(x["fixed"], s), "*").otherwise(s)))
        rows = rows.where("line is not null").withColumn("new", F.array_compact(new))
        node = F.aggregate("new", F.col("node"), lambda node, step: _next(node, step))
        rows = rows.select("host", "steps", "pages", node.alias("node"), (F.col("at") + F.size("new")).alias("at"), F.concat("template", "new").alias("template"))
        live = stored(rows.where(F.col("at") < F.size("steps")), "url-paths")
        done.append(rows.where(F.col("at") >= F.size("steps")))
    rest = F.slice("steps", F.size("template") + 1, F.size("steps"))
    out = [x.select("host", "steps", F.concat("template", rest).alias("template")) for x in done]
    return reduce(DataFrame.unionByName, out)


def _chain(template: Column) -> Column:
    """The nodes from the root to a template's end."""
    root = F.array(F.lit(_ROOT).cast("bigint"))
    return F.aggregate(template, root, lambda nodes, step: F.concat(nodes, F.array(_next(F.element_at(nodes, -1), step))))


def purities(counted: DataFrame) -> DataFrame:
    """(host, template, purity) of ``counted(host, template, n, bad)``: labelled pages and those of them that are blocked.

    From all pages' share down the tree over all hosts, then down the host's own: at each node the counts (merged with those of
    its siblings that are alike) are added to ``WEIGHT`` pages of the parent's purity. Nodes without labels change nothing.
    """
    counted = stored(counted.withColumn("key", F.sha2(F.to_json(F.struct("host", "template")), 256)), "url-counted")
    every = counted.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    prior = ((every.bad or 0) + 0.5) / ((every.n or 0) + 1.0)
    chain = _chain(F.col("template"))
    # a long template stands in one row, its nodes have its key
    steps = counted.select("host", "key", "n", "bad", F.posexplode(F.arrays_zip(chain, F.concat(F.array(F.lit(None).cast("bigint")), chain))).alias("depth", "at"))
    steps = stored(steps.select("host", "key", "n", "bad", "depth", F.col("at")["0"].alias("node"), F.col("at")["1"].alias("parent")).where("node is not null"), "url-nodes")
    trees = []
    for keys in ([], ["host"]):
        nodes = stored(steps.where("n > 0").groupBy(*keys, "node", "parent").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-tree")
        whole = stored(nodes.select(*keys, F.col("node").alias("parent"), ((F.col("bad") + 0.5) / (F.col("n") + 1)).alias("p")), "url-parents")
        kids = hot_join(nodes, whole, [*keys, "parent"], F.col("node"))
        alike = F.coalesce(F.abs(F.col("bad") / F.col("n") - F.col("p")) <= ALIKE * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")), F.lit(False))
        kids = stored(kids.withColumn("alike", alike).drop("p"), "url-children")
        pool = stored(kids.where("alike").groupBy(*keys, "parent").agg(F.sum("n").alias("pool_n"), F.sum("bad").alias("pool_bad")), "url-branches")
        kids = hot_join(kids, pool, [*keys, "parent"], F.col("node"))
        one = lambda c: F.when(F.col("alike"), F.col(f"pool_{c}")).otherwise(F.col(c)).alias(c)
        trees.append(stored(kids.select(*keys, "node", F.struct(one("n"), one("bad")).alias("own" if keys else "any")), "url-merged"))
    found = hot_join(steps.select("host", "key", "depth", "node"), trees[0], "node", F.col("key"))
    found = hot_join(stored(found, "url-found"), trees[1], ["host", "node"], F.col("key"))
    lines = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("depth", "any", "own"))).alias("line"))

    def down(p: Column, name: str) -> Column:
        return F.aggregate("line", p, lambda p, x: F.when(x[name].isNull(), p).otherwise((x[name]["bad"] + WEIGHT * p) / (x[name]["n"] + WEIGHT)))

    purity = lines.select("key", down(down(F.lit(prior), "any"), "own").alias("purity"))
    return counted.select("key", "host", "template").join(purity, "key").drop("key")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of ``pages(page_id, url)``.

    The verdict is the rule's; for pages that no rule fits it is the template's: block if its smoothed purity, the share of
    blocked pages, is over ``REJECT``. Labels are the rules' verdicts. Null urls and those without ``://``
    have empty host and path, and share one template. Repeated rows each give a row; other columns are left out.
    """
    verdicts = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdicts = F.when(F.col("rule") == rule, verdict).otherwise(verdicts)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("label", verdicts).withColumn("steps", segments(F.col("path")))
    rows = stored(rows, "urls")
    paths = stored(rows.groupBy("host", "steps").agg(F.count("label").alias("n"), F.count_if(F.col("label") == "block").alias("bad"), F.count(F.lit(1)).alias("pages")), "url-steps")
    named = stored(templates(paths), "url-templates")
    counted = paths.join(named, ["host", "steps"]).groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    purity = stored(purities(counted), "url-purity")
    judgement = stored(hot_join(named, purity, ["host", "template"], F.col("steps")), "url-judgement")
    out = hot_join(rows, judgement, ["host", "steps"], F.col("page_id"))
    verdict = F.coalesce("label", F.when(F.col("purity") > REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
