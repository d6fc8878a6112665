"""URL filters by rules and by trust that spreads over links between hosts. DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written

TOLERANCE = 1e-4
#: (verdict, host and path of the rule).
Rule = tuple[str, str]
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
LINKED_HOST = r"(?i)^(?:https?:)?//([^/?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to /, ?, # or the end; from there up to ? or #. No :// or null: both empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a domain above it, and the path's start; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, tail = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{tail}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def link_edges(pages: DataFrame) -> DataFrame:
    """Rows (src, dst, n) of absolute links from (host, html) to other hosts. Relative links stay on their host."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    to = lower_ascii(F.regexp_extract("link", LINKED_HOST, 1))
    return links.select("src", to.alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE, block: int = 5) -> DataFrame:
    """Personalised PageRank of trust along (src, dst, n), and of distrust against it.

    seeds: (host, trust, distrust), what each host restarts with. Returns the same columns. Both kinds move in one
    table, a join and an aggregate a round; sums combine before the shuffle, so a host with many links is no hot spot.
    Goes on, `block` rounds at a time, until no host's value changes by more than tolerance in a round; as the mass that
    moves falls by damping each time, that is sure to come.
    """

    def share(frm: str, to: str, kind: str) -> DataFrame:
        total = edges.groupBy(frm).agg(F.sum("n").alias("all"))
        return edges.join(total, frm).select(F.lit(kind).alias("kind"), F.col(frm).alias("host"), F.col(to).alias("to"), (damping * F.col("n") / F.col("all")).alias("w"))

    moves = Written(share("src", "dst", "trust").unionByName(share("dst", "src", "distrust")), "url-moves").df
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "score")).where("score > 0")
    start = Written(start.select("kind", "host", "score", F.lit(0.0).alias("before")), "url-seeds").df
    state = last = None
    while not moves.isEmpty():
        rows = start if state is None else state.df
        for _ in range(block):
            sent = rows.join(moves, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("w")).alias("score"), F.lit(0.0).alias("before"))
            had = rows.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before"))
            rows = start.unionByName(sent).unionByName(had).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before"))
        last, state = state, Written(rows, "url-state")
        if last is not None:
            last.drop()
        if (state.df.agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) <= tolerance:
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return (start if state is None else state.df).groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], least_distrust: float = 0.25, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (page_id, url, host, path, rule, verdict, trust, distrust) for every page.

    A page that a rule fits has the longest rule's verdict. The others have their host's: a host restarts with the
    shares of its pages that allow and block rules fit, both spread over the links, and it is blocked where distrust
    is least_distrust or more and above trust. Of equally long rules that fit, which have the same text then, the last
    given counts. Null or odd urls have an empty host, which no rule fits, no link reaches, and which is allowed; very
    long ones are read whole. Repeated rows and null ids are judged each; null html has no links; an empty table gives
    no rows; other columns aren't read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumns({"host": host, "path": path})
    found = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    fits = lambda v: F.avg(F.when(F.col("found.verdict") == v, 1.0).otherwise(0.0))
    seeds = found.where("host != ''").groupBy("host").agg(fits("allow").alias("trust"), fits("block").alias("distrust"))
    by_host = propagate(link_edges(rows.select("host", "html")), seeds, damping, tolerance)
    judged = found.drop("html").join(by_host, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    bad = (F.col("distrust") >= least_distrust) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("found.verdict", F.when(bad, "block").otherwise("allow"))
    return judged.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


def sql(rules: Sequence[Rule], least_distrust: float = 0.25, damping: float = 0.85, tolerance: float = TOLERANCE) -> str:
    """The same in DuckDB's SQL. Rounds are unrolled, as many as it takes until less than tolerance of a host's mass is
    still under way."""
    rounds = math.ceil(math.log(tolerance) / math.log(damping))
    cases = "\n".join(
        f"when (host = '{at}' or ends_with(host, '.{at}')) and starts_with(path, '/{tail}') then {{'rule': '{rule}', 'verdict': '{verdict}'}}"
        for verdict, rule in sorted(rules, key=lambda r: -len(r[1]))
        for at, _, tail in [rule.partition("/")]
    )
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = "".join(
        f"""s{k} as (select kind, host, sum(score) as score from (select kind, host, score from s0 union all
            select s.kind, m.t as host, s.score * m.w from s{k - 1 if k > 1 else 0} s join moves m on s.kind = m.kind and s.host = m.host) group by all),\n"""
        for k in range(1, rounds + 1)
    )
    return rf"""
    with cut as (select page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') as rest from pages),
    split as (select page_id, html, {low("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
    found as (select *, case {cases} else null end as f from split),
    seeds as (select host, avg(case when f.verdict = 'allow' then 1.0 else 0.0 end) as trust, avg(case when f.verdict = 'block' then 1.0 else 0.0 end) as distrust
              from found where host != '' group by host),
    links as (select host as src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1)) as link from split),
    edges as (select src, dst, count(*) as n from (select src, {low("regexp_extract(link, '(?i)^(?:https?:)?//([^/?#]*)', 1)")} as dst from links)
              where src != '' and dst != '' and src != dst group by all),
    moves as (select 'trust' as kind, src as host, dst as t, {damping} * n / sum(n) over (partition by src) as w from edges union all
              select 'distrust', dst, src, {damping} * n / sum(n) over (partition by dst) from edges),
    s0 as (select 'trust' as kind, host, trust::double as score from seeds where trust > 0 union all
           select 'distrust', host, distrust::double from seeds where distrust > 0),
    {steps}
    by_host as (select host, coalesce(sum(score) filter (kind = 'trust'), 0) as trust, coalesce(sum(score) filter (kind = 'distrust'), 0) as distrust from s{rounds} group by host)
    select page_id, a.host, path, a.f.rule as rule,
           coalesce(a.f.verdict, case when b.distrust >= {least_distrust} and b.distrust > b.trust then 'block' else 'allow' end) as verdict
    from found a left join by_host b on a.host = b.host"""
