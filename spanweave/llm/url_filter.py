"""URL filter: host and path rules, and for other URLs a character language-model ratio. DataFrame operations only.

Rules come first: a rule like `example.net/en/` fits its host and all subdomains where the path starts with the
rule's; the longest that fits decides. URLs that a rule decides are the accepted and rejected URLs from which the two
models learn, and so are URLs whose host has one of the seed words as a label or between hyphens (rejected), unless a
rule decides them: weak labels, as a word says little of a page.

Model: characters of host and path, folded to 40 symbols, with up to three characters of context. Witten-Bell
smoothing mixes each order with the next shorter one by the number of different continuations; an unseen context
falls back wholly, so the order varies. The score of a URL is the mean difference of the log-likelihoods (rejected
minus accepted). It is calibrated on the labelled URLs, each scored by a model without its own half of the URLs: the
logistic curve of two normal densities with common variance. A probability of rejection over one half blocks.

The counts of 4-grams are one table of at most 41^4 (2.8 million) rows for each model by construction, however many
URLs there are; it is written once, and so are the scores. Sums by shorter grams and by contexts are aggregates of it
(at most 41^3 rows for each model) that are broadcast; the scored 4-grams are broadcast if their number, which is
checked, is at most `BROADCAST_ROWS`, else joined by key. All counts cover all URLs.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and is allowed (it has no
characters); without accepted and rejected URLs to learn from all other URLs are allowed; equal rows are judged
apart; URLs of any length are read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# The rules and their verdicts; words in hosts that mark unwanted URLs.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SEEDS = ["ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER, SYMBOLS = 3, 40
#: Most scored 4-grams that are broadcast (some 50 bytes each).
BROADCAST_ROWS = 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        ok = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        fits.append(F.when(ok, F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _labelled(pages: DataFrame, rules: dict[str, str], seeds: list[str], id_col: str, url_col: str) -> DataFrame:
    """page_id, host, path, rule, y (1 rejected, 0 accepted, else null), fold, chars (folded, with context before them)."""
    host, path = host_and_path(F.col(url_col))
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    df = df.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(*(F.when(F.col("rule") == r, F.lit(int(v == "block"))) for r, v in rules.items())) if rules else F.lit(None).cast("int")
    seed = F.when(F.col("host").rlike(rf"(?:^|[.-])(?:{'|'.join(seeds)})(?:[.-]|$)"), F.lit(1)) if seeds else F.lit(None).cast("int")
    text = F.concat("host", "path")
    chars = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^a-z0-9./-]", "*")
    fold = F.ascii(F.substring(F.md5(text), 1, 1)) % 2
    return df.withColumns({"y": F.coalesce(verdict, seed), "fold": fold, "chars": F.concat(F.lit("^" * ORDER), chars)}).withColumn("row", F.monotonically_increasing_id())


def _grams(df: DataFrame, *cols: str) -> DataFrame:
    """A row for each character: g, its context and itself."""
    size = F.length("chars") - ORDER
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return df.select(*cols, "chars", F.explode(places).alias("i")).select(*cols, F.expr(f"substring(chars, i, {ORDER + 1})").alias("g"))


def model(labelled: DataFrame) -> DataFrame:
    """g, m, llr: for each 4-gram of the URLs the difference of log-likelihoods under model m (0 and 1: without that fold; 2: all)."""
    n = lambda y, f: F.count(F.when((F.col("y") == y) & (F.col("fold") == f), 1))
    counts = _grams(labelled, "y", "fold").groupBy("g").agg(n(0, 0).alias("a0"), n(0, 1).alias("a1"), n(1, 0).alias("r0"), n(1, 1).alias("r1"))
    kinds = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(y).alias("y"), F.expr(e).alias("n")) for m, y, e in ((0, 0, "a1"), (1, 0, "a0"), (2, 0, "a0 + a1"), (0, 1, "r1"), (1, 1, "r0"), (2, 1, "r0 + r1"))))
    t = staged(counts.select("g", F.explode(kinds).alias("k")).select("g", "k.m", "k.y", "k.n"), "url-grams")
    out = t
    for order in range(ORDER + 1):
        # n{order}: count of context and character; h{order}, t{order}: count and different continuations of the context
        gram = F.expr(f"substring(g, {ORDER - order + 1}, {order + 1})")
        sums = t.groupBy("m", "y", gram.alias("gram")).agg(F.sum("n").alias(f"n{order}"))
        context = sums.groupBy("m", "y", F.expr(f"substring(gram, 1, {order})").alias("context")).agg(F.sum(f"n{order}").alias(f"h{order}"), F.sum(F.when(F.col(f"n{order}") > 0, 1).otherwise(0)).alias(f"t{order}"))
        out = out.withColumn("gram", gram).withColumn("context", F.expr(f"substring(gram, 1, {order})"))
        if order < ORDER:  # at most 6 * 41^3 rows
            out = out.join(F.broadcast(sums), ["m", "y", "gram"])
        else:  # a whole 4-gram is its own sum
            out = out.withColumn(f"n{order}", F.col("n"))
        out = out.join(F.broadcast(context), ["m", "y", "context"]).drop("gram", "context")  # at most 6 * 41^3 rows
    p = (F.col("n0") + 1.0) / (F.col("h0") + float(SYMBOLS + 1))
    for order in range(1, ORDER + 1):
        mixed = (F.col(f"n{order}") + F.col(f"t{order}") * p) / (F.col(f"h{order}") + F.col(f"t{order}"))
        p = F.when(F.col(f"h{order}") > 0, mixed).otherwise(p)
    return out.withColumn("lp", F.log(p)).groupBy("g", "m").agg(F.sum(F.when(F.col("y") == 1, F.col("lp")).otherwise(-F.col("lp"))).alias("llr"))


def judge(pages: DataFrame, rules: dict[str, str] | None = None, seeds: list[str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (mean log-likelihood difference; null without characters), probability of rejection."""
    rules, seeds = RULES if rules is None else rules, SEEDS if seeds is None else seeds
    labelled = _labelled(pages, rules, seeds, id_col, url_col)
    table = staged(model(labelled).groupBy("g").pivot("m", [0, 1, 2]).agg(F.first("llr")).select("g", F.struct(F.col("0").alias("l0"), F.col("1").alias("l1"), F.col("2").alias("l2")).alias("l")), "url-model")
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    keys = ["row", "page_id", "host", "path", "rule", "y"]
    # an own model for labelled URLs; the half that a URL is in is not in its model
    own = F.when(F.col("y").isNull(), F.col("l.l2")).when(F.col("fold") == 0, F.col("l.l0")).otherwise(F.col("l.l1"))
    scored = _grams(labelled, *keys, "fold").join(table, "g").groupBy(*keys).agg(F.avg(own).alias("score"))
    bare = labelled.where(F.length("chars") <= ORDER).select(*keys, F.lit(None).cast("double").alias("score"))
    rows = staged(scored.unionByName(bare), "url-scores")
    # one row of means and variances, as a scalar subquery
    part = rows.where("y is not null and score is not null").agg(*(f(F.when(F.col("y") == y, F.col("score"))).alias(f"{n}{y}") for y in (0, 1) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))))
    spread = F.greatest((F.col("n0") * F.col("var0") + F.col("n1") * F.col("var1")) / (F.col("n0") + F.col("n1")), F.lit(1e-6))
    line = part.select(F.struct(((F.col("mean1") - F.col("mean0")) / spread).alias("slope"), ((F.col("mean0") + F.col("mean1")) / 2).alias("middle")).alias("line")).scalar()
    logit = F.col("slope") * (F.col("score") - F.col("middle"))
    out = rows.withColumn("line", line).select("*", "line.slope", "line.middle").withColumn("probability", F.when(F.col("slope") > 0, 1 / (1 + F.exp(-logit))))
    by_rule = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items())) if rules else F.lit(None).cast("string")
    verdict = F.coalesce(by_rule, F.when((F.col("slope") > 0) & (F.col("score") > F.col("middle")), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "probability")


#: The same in DuckDB's SQL, with the default rules and seeds.
ORACLE = r"""
with a as (select page_id, row_number() over () as row, coalesce(url, '') as u from pages),
b as (select page_id, row, case when strpos(u, '://') > 0 then substr(u, strpos(u, '://') + 3) else '' end as rest from a),
c as (select page_id, row, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from b),
d as (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                     when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                     when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                     when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from c),
e as (select *, case when rule in ('net/', 'example.com/de/') then 1 when rule is not null then 0
                     when regexp_matches(host, '(?:^|[.-])(?:ads|adult|bets|casino|pills|porn|spam|xxx)(?:[.-]|$)') then 1 end as y,
             ascii(substr(md5(host || path), 1, 1)) % 2 as fold,
             '^^^' || regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9./-]', '*', 'g') as chars from d),
f as (select row, y, fold, substr(chars, i, 4) as g from (select row, y, fold, chars, unnest(range(1, length(chars) - 2)) as i from e)),
counts as (select g, count(case when y = 0 and fold = 0 then 1 end) as a0, count(case when y = 0 and fold = 1 then 1 end) as a1,
                  count(case when y = 1 and fold = 0 then 1 end) as r0, count(case when y = 1 and fold = 1 then 1 end) as r1 from f group by g),
t as (select g, 0 as m, 0 as y, a1 as n from counts union all select g, 1, 0, a0 from counts union all select g, 2, 0, a0 + a1 from counts
      union all select g, 0, 1, r1 from counts union all select g, 1, 1, r0 from counts union all select g, 2, 1, r0 + r1 from counts),
s as (select *, sum(n) over (partition by m, y, substr(g, 4, 1)) as n0, sum(n) over (partition by m, y) as h0,
             sum(n) over (partition by m, y, substr(g, 3, 2)) as n1, sum(n) over (partition by m, y, substr(g, 3, 1)) as h1,
             sum(n) over (partition by m, y, substr(g, 2, 3)) as n2, sum(n) over (partition by m, y, substr(g, 2, 2)) as h2,
             n as n3, sum(n) over (partition by m, y, substr(g, 1, 3)) as h3,
             row_number() over (partition by m, y, substr(g, 3, 2) order by g) as k1, row_number() over (partition by m, y, substr(g, 2, 3) order by g) as k2 from t),
w as (select *, sum(case when k1 = 1 and n1 > 0 then 1 else 0 end) over (partition by m, y, substr(g, 3, 1)) as t1,
             sum(case when k2 = 1 and n2 > 0 then 1 else 0 end) over (partition by m, y, substr(g, 2, 2)) as t2,
             sum(case when n3 > 0 then 1 else 0 end) over (partition by m, y, substr(g, 1, 3)) as t3 from s),
p0 as (select *, (n0 + 1.0::double) / (h0 + 41.0::double) as q0 from w),
p1 as (select *, case when h1 > 0 then (n1 + t1 * q0) / (h1 + t1) else q0 end as q1 from p0),
p2 as (select *, case when h2 > 0 then (n2 + t2 * q1) / (h2 + t2) else q1 end as q2 from p1),
p3 as (select *, case when h3 > 0 then (n3 + t3 * q2) / (h3 + t3) else q2 end as q3 from p2),
llr as (select g, m, sum(case when y = 1 then ln(q3) else -ln(q3) end) as llr from p3 group by g, m),
scored as (select f.row, avg(llr.llr) as score from f join llr on f.g = llr.g and llr.m = (case when f.y is null then 2 else f.fold end) group by f.row),
r as (select e.*, scored.score from e left join scored on e.row = scored.row),
v as (select avg(case when y = 0 then score end) as mean0, avg(case when y = 1 then score end) as mean1 from r where y is not null and score is not null)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when mean1 > mean0 and score > (mean0 + mean1) / 2 then 'block' else 'allow' end as verdict
from r, v
"""
