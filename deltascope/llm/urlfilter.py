"""URL filters: listed rules first, then a path-template tree for each host.

A url's path becomes a template: its segments, in which hexadecimal names and digit runs are
wildcards already. The tree is built level by level, as deep as the paths are: below a node,
segments that are many and rare, or that have no labelled url, become the branch `*`. Then
statistically similar branches are merged: they are put in the order of their share of
blocked urls, and each joins the set before it if its share does not differ significantly
from that of the whole set, so that no chain of small steps ties unlike branches together. A
set is one branch, whose subtrees grow on together. A branch's purity is its share of blocked among labelled urls,
smoothed towards its parent's, up to the prior of all hosts. A branch is not divided further
if it has fewer than LEAST labelled urls or only one kind of label, as nothing below it can
then differ significantly. A template is rejected if the purity of its last branch reaches
PURITY.

Only DataFrame functions; what is joined back to the urls is one row a template. Urls that a
listed rule decides are the labelled ones.

A null url or one without `://` has an empty host and path and is judged by the tree like
any other; paths may be of any length; rows of equal urls get equal verdicts; branches with
equal shares are in the order of their names; an empty table gives no rows. Columns besides
page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, drop_dir

#: Fixed values: (rule, verdict); a rule fits its host, all subdomains and paths it begins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: A segment is variable if its parent has more than MANY of them and it has less than one in RARE urls.
MANY, RARE = 20, 50
#: Normal deviate of the test for similar branches, least labelled urls of a branch that is
#: divided, weight of the parent, least purity to reject.
DEVIATE, LEAST, WEIGHT, PURITY = 1.96, 10, 4, 0.8
#: Levels that the SQL below is written out for; the tree itself has no such limit.
SQL_LEVELS = 8


def parts(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, v in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments after its first slash, generalised."""

    def general(x: Column) -> Column:
        return F.when(x.rlike("^[0-9a-f-]{16,}$"), "<h>").otherwise(F.regexp_replace(x, "[0-9]+", "<n>"))

    return F.transform(F.slice(F.split(path, "/", -1), 2, F.size(F.split(path, "/", -1))), general)


def templates(urls: DataFrame) -> DataFrame:
    """host, template, n, labelled and blocked; urls has host, template and label."""
    label = F.col("label")
    return urls.groupBy("host", "template").agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.count_if(label == "block").alias("blocked"))


def smooth(blocked: Column, labelled: Column, parent: Column) -> Column:
    return (blocked + WEIGHT * parent) / (labelled + WEIGHT)


def divisible(blocked: Column, labelled: Column) -> Column:
    return (labelled >= LEAST) & (blocked > 0) & (blocked < labelled)


def differ(b1: Column, l1: Column, b2: Column, l2: Column) -> Column:
    """Whether two shares b / l differ significantly (two proportions, pooled)."""
    p = (b1 + b2) / (l1 + l2)
    return F.abs(b1 / l1 - b2 / l2) > DEVIATE * F.sqrt(p * (1 - p) * (1 / l1 + 1 / l2))


def similar_sets(branches: DataFrame) -> DataFrame:
    """host, node, branch and the number of the set that the branch is merged into: a fold
    over a node's branches in the order of their shares, which keeps the running set's sums.
    A node has at most MANY or RARE branches and *, so its list is short."""
    order = F.struct((F.col("labelled") == 0).alias("none"), F.try_divide("blocked", "labelled").alias("share"), "branch", "labelled", "blocked")
    nodes = branches.groupBy("host", "node").agg(F.array_sort(F.collect_list(order)).alias("list"))
    start = F.struct(F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("set"), F.array().cast("array<int>").alias("sets"))

    def step(held: Column, x: Column) -> Column:
        apart = (held["l"] == 0) | (x["labelled"] == 0) | F.coalesce(differ(held["b"], held["l"], x["blocked"], x["labelled"]), F.lit(False))
        number = held["set"] + apart.cast("int")
        keep = lambda c: F.when(apart, F.lit(0)).otherwise(held[c])
        return F.struct((keep("l") + x["labelled"]).alias("l"), (keep("b") + x["blocked"]).alias("b"), number.alias("set"), F.array_append(held["sets"], number).alias("sets"))

    folded = nodes.withColumn("sets", F.aggregate("list", start, step, lambda held: held["sets"]))
    return folded.select("host", "node", F.explode(F.zip_with("list", "sets", lambda x, n: F.struct(x["branch"].alias("branch"), n.alias("set")))).alias("x")).select("host", "node", "x.branch", "x.set")


def level(tree: DataFrame, k: int) -> DataFrame:
    """The templates whose node has been divided by their k-th segment (from 0): node,
    purity and whether to go on are those of the new branch."""
    seg = F.coalesce(F.get(F.split("template", "/", -1), F.lit(k)), F.lit(""))
    open_ = tree.where("open").withColumn("seg", seg)
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    children = open_.groupBy("host", "node", "seg").agg(*sums, F.first("purity").alias("parent"))
    all_ = children.groupBy("host", "node").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"))
    variable = (F.col("kids") > MANY) & (F.col("n") * RARE < F.col("all_n"))
    named = children.join(all_, ["host", "node"]).withColumn("branch", F.when(variable | (F.col("labelled") == 0), "*").otherwise(F.col("seg")))
    named = named.select("host", "node", "seg", "branch", "labelled", "blocked", "parent")
    branches = named.groupBy("host", "node", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.first("parent").alias("parent"))
    ranked = branches.join(similar_sets(branches), ["host", "node", "branch"])
    sets = Window.partitionBy("host", "node", "set")
    merged = ranked.select("host", "node", "branch", F.min("branch").over(sets).alias("name"), F.sum("labelled").over(sets).alias("labelled"), F.sum("blocked").over(sets).alias("blocked"), "parent")
    merged = merged.select("host", "node", "branch", "name", smooth(F.col("blocked"), F.col("labelled"), F.col("parent")).alias("pure"), divisible(F.col("blocked"), F.col("labelled")).alias("more"))
    own = named.select("host", "node", "seg", "branch").join(merged, ["host", "node", "branch"])
    deeper = F.size(F.split("template", "/", -1)) > k + 1
    out = open_.drop("purity", "open").join(own, ["host", "node", "seg"])
    return out.select("host", "template", F.concat("node", F.lit("/"), "name").alias("node"), "n", "labelled", "blocked", F.col("pure").alias("purity"), (F.col("more") & deeper).alias("open"))


def purities(tree: DataFrame, prior: float) -> DataFrame:
    """host, template and purity."""
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    hosts = hosts.select("host", smooth(F.col("b"), F.col("l"), F.lit(prior)).alias("purity"), divisible(F.col("b"), F.col("l")).alias("open"))
    now = cut(tree.join(hosts, "host").select("host", "template", F.lit("").alias("node"), "n", "labelled", "blocked", "purity", (F.col("open") & (F.col("template") != "")).alias("open")), "url-level")
    done, k = [], 0
    while True:
        done.append(now.where("not open").select("host", "template", "purity"))
        if now.where("open").isEmpty():
            break
        now, k = cut(level(now, k), "url-level"), k + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict."""
    host, path = parts(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "label": verdict, "template": F.array_join(segments(F.col("path")), "/")})
    tree = cut(templates(urls), "url-templates")
    all_ = tree.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).first()
    prior = ((all_.b or 0) + 1.0) / ((all_.l or 0) + 2.0)
    found = cut(purities(tree, prior), "url-purities")
    drop_dir(tree)
    out = urls.join(found, ["host", "template"], "left")
    by_tree = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", by_tree).alias("verdict"))


def oracle() -> str:
    """The same in DuckDB SQL, for paths of at most SQL_LEVELS divided segments."""
    fits = "(host = '{h}' or host like '%.{h}') and starts_with(path, '/{p}')"
    cases = {"rule": "", "label": ""}
    for rule, v in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        cases["rule"] += f" when {fits.format(h=h, p=p)} then '{rule}'"
        cases["label"] += f" when {fits.format(h=h, p=p)} then '{v}'"
    general = "case when regexp_matches(x, '^[0-9a-f-]{16,}$') then '<h>' else regexp_replace(x, '[0-9]+', '<n>', 'g') end"
    template = f"coalesce(array_to_string(list_transform(string_split(path, '/')[2:], lambda x: {general}), '/'), '')"
    more = f"l >= {LEAST} and b > 0 and b < l"
    sql = f"""with parsed as (
  select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
urls as (select *, case{cases["rule"]} end as rule, case{cases["label"]} end as label, {template} as template from parsed),
tree as (select host, template, count(*) as n, count(label) as labelled, count(*) filter (label = 'block') as blocked from urls group by all),
prior as (select (coalesce(sum(blocked), 0) + 1.0::double) / (coalesce(sum(labelled), 0) + 2.0::double) as v from tree),
hosts as (select host, sum(labelled) as l, sum(blocked) as b from tree group by host),
t0 as (select host, template, '' as node, n, labelled, blocked, (b + {WEIGHT} * (select v from prior)) / (l + {WEIGHT}) as purity, {more} and template <> '' as open from tree join hosts using (host))"""
    for k in range(SQL_LEVELS):
        sql += f""",
o{k} as (select *, coalesce(string_split(template, '/')[{k + 1}], '') as seg from t{k} where open),
c{k} as (select host, node, seg, sum(n) as n, sum(labelled) as l, sum(blocked) as b, any_value(purity) as parent from o{k} group by all),
n{k} as (select *, case when (count(*) over w > {MANY} and n * {RARE} < sum(n) over w) or l = 0 then '*' else seg end as branch from c{k} window w as (partition by host, node)),
b{k} as (select host, node, branch, sum(l) as l, sum(b) as b, any_value(parent) as parent from n{k} group by all),
r{k} as (select host, node, list(branch order by l = 0, b / l nulls first, branch) as branches,
  list({{'l': l::bigint, 'b': b::bigint, 'set_': 0, 'sets': [0]}} order by l = 0, b / l nulls first, branch) as held from b{k} group by all),
f{k} as (select host, node, branches, list_reduce(held, lambda a, x: case
  when x.l = 0 or abs(a.b / a.l - x.b / x.l) > {DEVIATE} * sqrt((a.b + x.b) / (a.l + x.l) * (1 - (a.b + x.b) / (a.l + x.l)) * (1 / a.l + 1 / x.l))
  then {{'l': x.l, 'b': x.b, 'set_': a.set_ + 1, 'sets': list_append(a.sets, a.set_ + 1)}} else {{'l': a.l + x.l, 'b': a.b + x.b, 'set_': a.set_, 'sets': list_append(a.sets, a.set_)}} end).sets as sets from r{k}),
s{k} as (select b{k}.*, set_ from b{k} join (select host, node, unnest(branches) as branch, unnest(sets) as set_ from f{k}) using (host, node, branch)),
m{k} as (select host, node, branch, min(branch) over w as name, sum(l) over w as l, sum(b) over w as b, parent from s{k} window w as (partition by host, node, set_)),
t{k + 1} as (select host, template, node || '/' || name as node, o{k}.n, labelled, blocked, (m{k}.b + {WEIGHT} * m{k}.parent) / (m{k}.l + {WEIGHT}) as purity,
  m{k}.l >= {LEAST} and m{k}.b > 0 and m{k}.b < m{k}.l and len(string_split(template, '/')) > {k + 1} as open
  from o{k} join n{k} using (host, node, seg) join m{k} using (host, node, branch))"""
    done = " union all ".join(f"select host, template, purity from t{k}" + (" where not open" if k < SQL_LEVELS else "") for k in range(SQL_LEVELS + 1))
    return sql + f"""
select page_id, host, path, rule, coalesce(label, case when purity >= {PURITY} then 'block' else 'allow' end) as verdict
from urls left join ({done}) using (host, template)"""
