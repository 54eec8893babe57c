"""URL filters: allow and block rules, and a tree of path templates of each host for what no rule decides.

*Rules.*  A rule (host, path) fits its host and all subdomains where the URL's path starts with the rule's; the longest
one wins.  URLs that a rule decides are the labels that templates learn from.

*Wildcards.*  A path's segments become forms first: runs of digits are ``{n}``, long hexadecimal names ``{id}``, and what
lies deeper than ``DEPTH`` is ``**``.  Where a host has more than ``FANOUT`` segments at a depth, those with less than
1/``FANOUT`` of its pages there are variable and become ``*``; so a node has a bounded number of branches.

*Merging.*  Branches of one node are judged together with those siblings that a Hoeffding test at level ``DELTA`` cannot
tell from them, by what follows them in paths and by the share of blocked URLs among the labelled ones.

*Purity.*  A node's share of blocked URLs is smoothed with ``PRIOR`` URLs of its parent's share, a host's with the share
of all labelled URLs.  A template is rejected where its smoothed share is above ``REJECT``.

All steps are DataFrame operations.  Pages are counted by host and form before any other shuffle; joins with
one row a key go through ``join_unique``, so that a host with a third of all pages is not one task.
"""

from __future__ import annotations

from math import log, sqrt
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_unique, written

#: (verdict, host, path), fixed by the contract of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEPTH = 5
FANOUT = 16
DELTA = 0.05
PRIOR = 2
REJECT = 0.6
FORMS = ("end", "slash", "number", "id", "any", "deep", "numbered", "word")
#: Of a share over n rows: how far it may lie from the true one, times sqrt(n).
REACH = sqrt(0.5 * log(2 / DELTA))


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    named = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(named) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(named, ascii_uppercase, ascii_lowercase), path


def longest(rules: tuple[tuple[str, str, str], ...]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))


def fitting(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(the longest fitting rule as text, its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in reversed(longest(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """A path's segments as forms, at most DEPTH of them."""
    named = lambda s: F.when(s.rlike(r"^[0-9A-Fa-f-]{16,}\z"), F.lit("{id}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))
    cut = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1))
    deep = F.concat(F.transform(F.slice(cut, 1, DEPTH - 1), named), F.array(F.lit("**")))
    return F.when(F.size(cut) > DEPTH, deep).otherwise(F.transform(cut, named))


def form(segment: Column) -> Column:
    known = {"": "slash", "{n}": "number", "{id}": "id", "*": "any", "**": "deep"}
    out = F.when(segment.isNull(), F.lit("end"))
    for s, name in known.items():
        out = out.when(segment == s, F.lit(name))
    return out.when(segment.contains("{n}"), F.lit("numbered")).otherwise(F.lit("word"))


def with_templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, segs, n, ...) with t, the segments in which variable ones are wildcards."""
    kids = paths.select("host", "n", F.posexplode("segs").alias("k", "seg")).groupBy("host", "k", "seg").agg(F.sum("n").alias("n"))
    kids = written(kids, "kids")
    wide = kids.groupBy("host", "k").agg(F.count("*").alias("kids"), F.sum("n").alias("total")).where(F.col("kids") > FANOUT)
    # the segments that stay are at most FANOUT of each host and depth, so that a host's map has a bounded size
    often = join_unique(kids, wide, ["host", "k"], kids.groupBy("host", "k").agg(F.count("*").alias("c")))
    stay = F.collect_set(F.when((F.col("n") * FANOUT >= F.col("total")) | (F.col("seg") == "**"), F.col("seg")))
    kept = often.where("kids is not null").groupBy("host", "k").agg(stay.alias("stay"))
    tree = kept.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("k", "stay"))).alias("tree"))
    joined = join_unique(paths, written(tree, "tree"), ["host"], paths.groupBy("host").agg(F.count("*").alias("c")))
    stays = lambda s, i: F.coalesce(F.array_contains(F.try_element_at("tree", i), s), F.lit(True))
    return joined.withColumn("t", F.transform("segs", lambda s, i: F.when(stays(s, i), s).otherwise(F.lit("*")))).drop("tree")


def similar(a: Column, b: Column) -> Column:
    """Whether the test can't tell two branches apart (structs of form, n, labelled, blocked, next)."""
    near = lambda x, m, y, n: F.abs(x / m - y / n) < F.lit(REACH) / F.sqrt(m) + F.lit(REACH) / F.sqrt(n)
    alike = F.forall(F.sequence(F.lit(0), F.lit(len(FORMS) - 1)), lambda i: near(F.get(a["next"], i), a["n"], F.get(b["next"], i), b["n"]))
    unlike = (a["labelled"] > 0) & (b["labelled"] > 0) & ~near(a["blocked"], F.greatest(a["labelled"], F.lit(1)), b["blocked"], F.greatest(b["labelled"], F.lit(1)))
    return (a["form"] == b["form"]) & alike & ~unlike


def purities(templates: DataFrame) -> DataFrame:
    """(host, t, purity) of ``templates`` (host, t, n, labelled, blocked)."""
    at = templates.select("*", F.explode(F.sequence(F.lit(0), F.size("t"))).alias("k"))
    nexts = form(F.get("t", F.col("k")))
    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    following = F.array(*[F.sum(F.when(nexts == f, F.col("n")).otherwise(0)) for f in FORMS]).alias("next")
    nodes = written(at.groupBy("host", F.slice("t", F.lit(1), F.col("k")).alias("node")).agg(*counts, following), "nodes")
    last = F.element_at("node", -1)
    branch = F.struct(last.alias("seg"), form(last).alias("form"), "n", "labelled", "blocked", "next")
    # a node has at most FANOUT branches besides its wildcards
    families = nodes.where(F.size("node") > 0).groupBy("host", F.slice("node", F.lit(1), F.size("node") - 1).alias("parent")).agg(F.collect_list(branch).alias("all"))

    def merged(name: str) -> Column:
        return F.transform("all", lambda a: F.aggregate(F.filter("all", lambda b: similar(a, b)), F.lit(0).cast("long"), lambda x, b: x + b[name]))

    pooled = families.select("host", "parent", F.explode(F.arrays_zip(F.transform("all", lambda a: a["seg"]).alias("seg"), merged("labelled").alias("labelled"), merged("blocked").alias("blocked"))).alias("x"))
    pooled = written(pooled.select("host", "parent", "x.seg", "x.labelled", "x.blocked"), "branches")
    whole = templates.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("l")).first()
    share = (whole["b"] + 1) / (whole["l"] + 2)
    smoothed = lambda up: (F.col("blocked") + PRIOR * up) / (F.col("labelled") + PRIOR)
    level = nodes.where(F.size("node") == 0).select("host", F.col("node").alias("t"), smoothed(F.lit(share)).alias("purity"))
    every = level
    for k in range(DEPTH):
        up = level.select("host", F.col("t").alias("parent"), F.col("purity").alias("up"))
        level = pooled.where(F.size("parent") == k).join(up, ["host", "parent"])
        level = level.select("host", F.concat("parent", F.array("seg")).alias("t"), smoothed(F.col("up")).alias("purity"))
        every = every.unionByName(level)
    return every


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each row of ``pages`` (page_id, url).

    A null URL or one without ``://`` has an empty host and path: no rule fits, and all such rows share one
    template without labels, which has the share of all labelled URLs.  Very long paths are read whole; their template ends in
    ``**``.  Repeated rows count and are returned each; null page ids stay null; of rules of one length the first by verdict
    wins; other columns are not read.  Without any label no template is rejected; an empty table gives no rows.
    """
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"), segments(F.col("path")).alias("segs"))
    counted = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked"))
    paths = written(with_templates(written(counted, "paths")), "templates")
    templates = paths.groupBy("host", "t").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    found = written(purities(written(templates, "templates")), "purities")
    per_path = join_unique(paths, found, ["host", "t"], paths.groupBy("host", "t").agg(F.count("*").alias("c")))
    per_path = written(per_path.select("host", "segs", "t", "purity"), "judged")
    judged = join_unique(rows, per_path, ["host", "segs"], paths.select("host", "segs", F.col("n").alias("c")))
    template = F.concat("host", F.array_join(F.transform("t", lambda s: F.concat(F.lit("/"), s)), ""))
    verdict = F.coalesce("said", F.when(F.col("purity") > REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), template.alias("template"), F.round("purity", 9).alias("purity"))


def _fits(h: str, p: str) -> str:
    return f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"


def _form_sql(s: str) -> str:
    return f"CASE WHEN {s} IS NULL THEN 'end' WHEN {s} = '' THEN 'slash' WHEN {s} = '{{n}}' THEN 'number' WHEN {s} = '{{id}}' THEN 'id' WHEN {s} = '*' THEN 'any' WHEN {s} = '**' THEN 'deep' WHEN contains({s}, '{{n}}') THEN 'numbered' ELSE 'word' END"


def _near_sql(x: str, m: str, y: str, n: str) -> str:
    return f"abs({x} / {m} - {y} / {n}) < {REACH!r} / sqrt({m}) + {REACH!r} / sqrt({n})"


def sql(rules: tuple[tuple[str, str, str], ...] = RULES) -> str:
    """The same rows in DuckDB's SQL, where siblings are compared by a plain join."""
    cases = lambda value: "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in longest(rules)) + " END"
    levels = "".join(
        f""", r{k} AS (SELECT m.host, list_append(m.parent, m.seg) AS t, (m.blocked + {PRIOR} * r.purity) / (m.labelled + {PRIOR}) AS purity
  FROM merged m JOIN r{k - 1} r ON m.host = r.host AND m.parent = r.t WHERE len(m.parent) = {k - 1})"""
        for k in range(1, DEPTH + 1)
    )
    hist = ", ".join(f"coalesce(sum(n) FILTER (WHERE f = '{f}'), 0) AS f_{f}" for f in FORMS)
    alike = " AND ".join(_near_sql(f"a.f_{f}", "a.n", f"b.f_{f}", "b.n") for f in FORMS)
    labels = f"(a.labelled = 0 OR b.labelled = 0 OR {_near_sql('a.blocked', 'greatest(a.labelled, 1)', 'b.blocked', 'greatest(b.labelled, 1)')})"
    every = " UNION ALL ".join(f"SELECT host, t, purity FROM r{k}" for k in range(DEPTH + 1))
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS s FROM pages),
h AS (SELECT page_id, s, regexp_extract(s, '^[^/?#]*') AS named FROM a),
p AS (SELECT page_id, translate(named, '{ascii_uppercase}', '{ascii_lowercase}') AS host, regexp_extract(substr(s, length(named) + 1), '^[^?#]*') AS path FROM h),
c AS (SELECT *, CASE WHEN path = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(substr(path, 2), '/') END AS cut FROM p),
d AS (SELECT *, CASE WHEN len(cut) > {DEPTH} THEN list_append(cut[1:{DEPTH - 1}], '**') ELSE cut END AS kept FROM c),
page AS (SELECT page_id, host, path, {cases(lambda v, h, p: h + p)} AS rule, {cases(lambda v, h, p: v)} AS said,
  list_transform(kept, lambda x: CASE WHEN regexp_full_match(x, '[0-9A-Fa-f-]{{16,}}') THEN '{{id}}' ELSE regexp_replace(x, '[0-9]+', '{{n}}', 'g') END) AS segs FROM d),
path AS (SELECT host, segs, count(*) AS n, count(said) AS labelled, count(*) FILTER (WHERE said = 'block') AS blocked FROM page GROUP BY ALL),
place AS (SELECT host, segs, n, unnest(range(1, len(segs) + 1)) AS k FROM path),
kid AS (SELECT host, k, segs[k] AS seg, sum(n) AS n FROM place GROUP BY ALL),
kind AS (SELECT host, k, seg, CASE WHEN count(*) OVER w > {FANOUT} AND n * {FANOUT} < sum(n) OVER w AND seg <> '**' THEN '*' ELSE seg END AS g FROM kid WINDOW w AS (PARTITION BY host, k)),
made AS (SELECT place.host, place.segs, list(g ORDER BY place.k) AS t FROM place JOIN kind ON place.host = kind.host AND place.k = kind.k AND place.segs[place.k] = kind.seg GROUP BY ALL),
pt AS (SELECT path.*, coalesce(made.t, CAST([] AS VARCHAR[])) AS t FROM path LEFT JOIN made ON path.host = made.host AND path.segs = made.segs),
step AS (SELECT host, t[1:k] AS node, {_form_sql("t[k + 1]")} AS f, n, labelled, blocked FROM (SELECT *, unnest(range(0, len(t) + 1)) AS k FROM pt)),
node AS (SELECT host, node, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, {hist} FROM step GROUP BY host, node),
kin AS (SELECT *, node[1:len(node) - 1] AS parent, node[len(node)] AS seg, {_form_sql("node[len(node)]")} AS form FROM node WHERE len(node) > 0),
merged AS (SELECT a.host, a.parent, a.seg, sum(b.labelled) AS labelled, sum(b.blocked) AS blocked FROM kin a JOIN kin b ON a.host = b.host AND a.parent = b.parent AND a.form = b.form
  AND {alike} AND {labels} GROUP BY ALL),
r0 AS (SELECT host, node AS t, (blocked + {PRIOR} * (SELECT (sum(blocked) + 1) / (sum(labelled) + 2) FROM path)) / (labelled + {PRIOR}) AS purity FROM node WHERE len(node) = 0){levels},
every AS ({every})
SELECT page.page_id, page.host, page.path, page.rule, coalesce(said, CASE WHEN purity > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
  page.host || array_to_string(list_transform(pt.t, lambda x: '/' || x), '') AS template, round(purity, 9) AS purity
FROM page JOIN pt ON page.host = pt.host AND page.segs = pt.segs JOIN every ON pt.host = every.host AND pt.t = every.t
"""
