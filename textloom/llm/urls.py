"""URL filter: allow and block rules, and host reputations by empirical Bayes, in DataFrame expressions only.

A rule is a host with a path ('example.com/de/'): it fits the host and all of its subdomains where the url's path starts with the rule's
path. The longest fitting rule decides a page.

Pages with a known outcome teach what becomes of the others. Bad outcomes are counted by host, registered domain and suffix. Each level is
shrunk towards the level above by a beta-binomial prior: its mean is the shrunk mean of the parent, its strength is fitted by moments to how
far the parent's children differ (Kleinman's estimate with the counts as weights, kept within STRENGTH; PRIOR where fewer than two
children or only one outcome tell nothing). The root has the prior Beta(1, 1). A host is blocked if the lower bound of its posterior
(mean less Z standard deviations) is over LIMIT; a host without outcomes has the posterior of its domain's prior.

Outcomes are given as a column (1 bad, 0 good, null unknown); without one, the pages that a rule decides are the labelled ones.

Defined results: a null url or one without '://' has an empty host and path, which no rule fits; it shares the reputation of the empty
host. Repeated rows count and are judged as often as they occur; page_id is only carried, null or not. Columns other than page_id and
url (and the outcome) are not read and may have any name. An empty table gives no rows.

A page is read once for the counts and once to be judged; only counts of hosts are shuffled. The table of hosts is stored and counted:
up to BROADCAST_HOSTS it is broadcast, beyond that it is joined by host, where Spark splits a hot host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stored

#: (rule, action) of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Suffixes of more than one label; every other suffix is the last label. Users give their own list.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")
LIMIT, Z = 0.5, 1.645
PRIOR, STRENGTH = 10.0, (1.0, 1000.0)
BROADCAST_HOSTS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(raw, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, action) of the longest rule that fits, or null; of equally long ones that first in the alphabet."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for rule, action in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the last that fits wins
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def domain_and_suffix(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without user and port; an address of numbers is its own domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    suffix = F.when(two.isin(list(long_suffixes)), two).otherwise(F.element_at(labels, -1)) if long_suffixes else F.element_at(labels, -1)
    n = F.size(F.split(suffix, r"\."))
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n, F.lit(1)), n + 1), ".")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def _strength() -> Column:
    """Strength of the prior of the grouped children (k bad of n each)."""
    told = F.col("n") > 0
    total, bad, groups = F.sum("n"), F.sum("k"), F.count(F.when(told, 1))
    p = bad / total
    spread = F.sum(F.when(told, F.col("k") * F.col("k") / F.col("n"))) - bad * bad / total
    own = groups - 1
    rho = (spread / (p * (1 - p)) - own) / (total - F.sum(F.col("n") * F.col("n")) / total - own)
    strength = F.when(rho <= 0, STRENGTH[1]).otherwise(F.least(F.greatest(1 / rho - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])))
    return F.when((groups < 2) | (bad == 0) | (bad == total) | rho.isNull() | F.isnan(rho), PRIOR).otherwise(F.round(strength, 6))


def _level(children: DataFrame, parent: str) -> DataFrame:
    """Counts of the parents of a level, and the strength of the prior for the children."""
    return children.groupBy(parent).agg(F.sum("n").alias("parent_n"), F.sum("k").alias("parent_k"), _strength().alias("s"))


def reputations(pages: DataFrame, long_suffixes: Sequence[str] = LONG_SUFFIXES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """(host, n, k, a, b, bound, bad) of every host of ``pages(host, outcome)``; a and b are its posterior's parameters."""
    outcome = F.col("outcome").cast("double")
    hosts = pages.groupBy("host").agg(F.count("outcome").cast("double").alias("n"), F.coalesce(F.sum(outcome), F.lit(0.0)).alias("k"))
    domain, suffix = domain_and_suffix(F.col("host"), long_suffixes)
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    by_domain = _level(hosts, "domain").join(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix")), "domain")
    domains = by_domain.select("domain", "suffix", F.col("parent_n").alias("n"), F.col("parent_k").alias("k"), F.col("s").alias("host_s"))
    suffixes = _level(domains, "suffix").select("suffix", F.col("parent_n").alias("n"), F.col("parent_k").alias("k"), F.col("s").alias("domain_s"), F.lit(1).alias("all"))
    root = _level(suffixes, "all").select("all", F.col("s").alias("suffix_s"), ((F.col("parent_k") + 1) / (F.col("parent_n") + 2)).alias("m"))

    def shrunk(df: DataFrame, s: str) -> DataFrame:
        return df.withColumn("m", (F.col("m") * F.col(s) + F.col("k")) / (F.col(s) + F.col("n")))

    top = shrunk(suffixes.join(F.broadcast(root), "all"), "suffix_s").select("suffix", "domain_s", "m")
    middle = shrunk(domains.join(top, "suffix"), "domain_s").select("domain", "host_s", "m")
    own = hosts.join(middle, "domain").withColumns({"a": F.col("m") * F.col("host_s") + F.col("k"), "b": (1 - F.col("m")) * F.col("host_s") + F.col("n") - F.col("k")})
    a, b = F.col("a"), F.col("b")
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return own.select("host", "n", "k", "a", "b", bound.alias("bound"), (bound > limit).alias("bad"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, outcome: str | None = None, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), (F.col(outcome) if outcome else F.lit(None)).cast("int").alias("outcome"))
    ruled = read.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if outcome is None:
        ruled = ruled.withColumn("outcome", F.when(F.col("r.action") == "block", 1).when(F.col("r.action") == "allow", 0))
    known = stored(reputations(ruled.select("host", "outcome")).select("host", "bad"), "hosts")
    if known.count() <= broadcast_hosts:
        known = F.broadcast(known)
    by_method = F.when(F.col("bad"), "block").otherwise("allow")
    return ruled.join(known, "host").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", by_method).alias("verdict"))


def _sql_strength(parent: str, table: str) -> str:
    return f"""
    select {parent}, n, k, case when g < 2 or k = 0 or k = n or rho is null or isnan(rho) then {PRIOR} when rho <= 0 then {STRENGTH[1]}
        else round(least(greatest(1 / rho - 1, {STRENGTH[0]}), {STRENGTH[1]}), 6) end as s
    from (select *, case when g < 2 or k = 0 or k = n then null else ((q - k * k / n) / (k / n * (1 - k / n)) - (g - 1)) / (n - nn / n - (g - 1)) end as rho
        from (select {parent}, sum(n) as n, sum(k) as k, count(*) filter (n > 0) as g, sum(case when n > 0 then k * k / n end) as q, sum(n * n) as nn from {table} group by {parent}))"""


ORACLE = rf"""
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
page as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
),
fit as (
    select *, case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
        when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
        when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
        when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
    from page
),
ruled as (select *, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end as action from fit),
named as (select distinct host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') as labels from ruled),
split as (select host, labels, case when list_contains([{", ".join(f"'{s}'" for s in LONG_SUFFIXES)}], array_to_string(labels[-2:], '.')) then 2 else 1 end as t from named),
hosts as (
    select host, count(action) :: double as n, count(*) filter (action = 'block') :: double as k,
        array_to_string(any_value(labels)[greatest(len(any_value(labels)) - any_value(t), 1) :], '.') as domain, array_to_string(any_value(labels)[greatest(len(any_value(labels)) - any_value(t) + 1, 1) :], '.') as suffix
    from ruled join split using (host) group by host
),
domains as (select x.*, suffix from ({_sql_strength("domain", "hosts")}) as x join (select distinct domain, suffix from hosts) using (domain)),
suffixes as (select *, 1 as one from ({_sql_strength("suffix", "domains")})),
root as (select one, s as suffix_s, (k + 1) / (n + 2) as m from ({_sql_strength("one", "suffixes")})),
top as (select suffix, s, (m * suffix_s + k) / (suffix_s + n) as m from suffixes join root using (one)),
middle as (select domain, d.s, (m * top.s + d.k) / (top.s + d.n) as m from domains as d join top using (suffix)),
posterior as (select host, m * s + k as a, (1 - m) * s + n - k as b from hosts join middle using (domain))
select page_id, host, path, rule, coalesce(action, case when a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT} then 'block' else 'allow' end) as verdict
from ruled join posterior using (host)
"""
