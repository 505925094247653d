"""URL filter by host reputation, with explicit rules before it.

Labelled page outcomes (1 good, 0 bad) are counted for each host, registered domain
and public suffix. Beta-binomial priors shrink them downwards: the suffix's rate is
drawn to the overall rate, the domain's to its suffix's, the host's to its domain's;
each level's prior strength is the method-of-moments estimate of how alike its groups
are. A host passes if the lower bound of its posterior rate (mean less z standard
deviations) is at least `least`. Only counts are shuffled, summed on the map side
first; pages meet their host's row in an equi-join that adaptive execution splits for a hot host.

Defined results: a null url, or one without `://`, has the empty host and path, an
empty domain and suffix, and is judged by what is known of that host; null page ids
are kept; outcomes that are null or of unknown pages count for nothing; without any outcome the overall
rate is 1/2; repeated pages are judged each, an outcome counts once for each pair of page and label rows; urls of any length are read whole; of two rules of one
length the later one in the order of (rule, verdict) wins; an empty table gives no rows; extra columns are kept, except that host, path, rule, verdict, posterior_mean and posterior_bound are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.llm.common import fresh, lower_ascii, table

#: (verdict, host, start of path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Suffixes of two labels that a registered domain stands below; an argument for other lists.
TWO_LABELS = ["ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]
WEAKEST, STRONGEST = 1.0, 1000.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, A-Z lowered, and path up to `?` or `#`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_domain(host: Column, suffixes: list[str] = TWO_LABELS) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host, a port taken off.

    suffixes: rules as public lists write them: `co.uk`, `*.ck` for any label before ck, `!www.ck` for what `*.ck` doesn't cover; the longest rule wins, and one label is a suffix without any."""
    name = F.regexp_replace(host, r":\d*$", "")
    tail = lambda k: F.substring_index(name, ".", -k)
    plain, wild, kept = ([x.lstrip("!").removeprefix("*.") for x in suffixes if test(x)] for test in (lambda x: x[0] not in "*!", lambda x: x[0] == "*", lambda x: x[0] == "!"))
    of = lambda rules, k: [x for x in rules if x.count(".") == k - 1]
    length, n = F.lit(1), F.size(F.split(name, r"\."))
    most = max((x.count(".") + 2 for x in suffixes), default=1)
    for k in range(2, most + 1):
        if of(plain, k):
            length = F.when(tail(k).isin(of(plain, k)), k).otherwise(length)
        if of(wild, k - 1):
            length = F.when((n >= k) & tail(k - 1).isin(of(wild, k - 1)), k).otherwise(length)
        if of(kept, k):
            length = F.when(tail(k).isin(of(kept, k)), k - 1).otherwise(length)
    suffix, domain = tail(1), tail(2)
    for k in range(2, most + 1):
        suffix, domain = F.when(length == k, tail(k)).otherwise(suffix), F.when(length == k, tail(k + 1)).otherwise(domain)
    return suffix, domain


def read_suffixes(spark: SparkSession, path: str) -> list[str]:
    """The rules of a public suffix list: one a line, up to white space; `//` starts a comment. Some ten thousand at most, so they are collected."""
    lines = spark.read.text(path).select(F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1)).alias("rule")).where("rule != '' and not startswith(rule, '//')")
    return [r["rule"] for r in lines.distinct().orderBy("rule").limit(100_000).collect()]


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct<length, rule, verdict>; null if none does."""
    hits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*hits)) if hits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def _strength(groups: DataFrame) -> float:
    """Prior strength by moments from the groups' n, k and the rate of their parents: 1 / rho - 1, rho the likeness within a group beyond its parent's rate. One row reaches the driver."""
    within = F.col("prior") * (1 - F.col("prior"))
    off = F.col("k") - F.col("n") * F.col("prior")
    spread, alone, more = groups.agg(F.sum(off * off / F.col("n")), F.sum(within), F.sum(within * (F.col("n") - 1))).first()
    rho = (spread - alone) / more if more else 0
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


def _shrunk(groups: DataFrame, name: str) -> DataFrame:
    """groups with their rate shrunk to that of their parents (`prior`)."""
    s = _strength(groups)
    return groups.withColumn(name, (F.col("k") + s * F.col("prior")) / (F.col("n") + s))


def host_reputation(outcomes: DataFrame, z: float = 1.64, suffixes: list[str] = TWO_LABELS) -> tuple[DataFrame, dict]:
    """outcomes: host, outcome. Returns hosts with their prior's and posterior's figures, and the levels' tables for hosts never seen.

    Each level's strength is measured around its parents' shrunk rates, so what a suffix explains is not counted again below it."""
    suffix, domain = suffix_domain(F.col("host"), suffixes)
    hosts = (
        outcomes.where("outcome in (0, 1) and host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("outcome").cast("long").alias("k"))
        .withColumn("suffix", suffix).withColumn("domain", domain)
    )
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix_counts = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = suffix_counts.agg(F.sum("n"), F.sum("k")).first()
    rate = k / n if n else 0.5
    by_suffix = _shrunk(suffix_counts.withColumn("prior", F.lit(rate)), "suffix_rate").select("suffix", "suffix_rate")
    domains = _shrunk(domains.join(by_suffix, "suffix").withColumn("prior", F.col("suffix_rate")), "domain_rate").select("domain", "domain_rate")
    strength = _strength(hosts.join(domains, "domain").withColumn("prior", F.col("domain_rate")))
    return hosts.drop("suffix"), {"rate": rate, "suffixes": by_suffix, "domains": domains, "strength": strength, "z": z}


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = 0.6, z: float = 1.64, suffixes: list[str] = TWO_LABELS) -> DataFrame:
    """pages with host, path, rule, verdict, and the host's posterior mean and bound. outcomes: url, outcome."""
    seen, levels = host_reputation(outcomes.select(host_path(F.col("url"))[0].alias("host"), "outcome"), z, suffixes)
    host, path = host_path(F.col("url"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    suffix, domain = suffix_domain(F.col("host"), suffixes)
    hosts = pages.select("host").distinct().withColumn("suffix", suffix).withColumn("domain", domain)
    hosts = hosts.join(seen.select("host", "n", "k"), "host", "left").join(levels["domains"], "domain", "left").join(levels["suffixes"], "suffix", "left")
    prior = F.coalesce("domain_rate", "suffix_rate", F.lit(levels["rate"]))
    n, k, s = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0)), levels["strength"]
    a, b = k + s * prior, n - k + s * (1 - prior)
    mean = a / (a + b)
    hosts = hosts.select("host", mean.alias("posterior_mean"), (mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("posterior_bound"))
    # A caller's columns of these names give way, all others stay.
    out = pages.drop("posterior_mean", "posterior_bound").join(hosts, "host")
    hit = fresh(out, "hit")
    out = out.withColumn(hit, rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col(f"{hit}.verdict"), F.when(F.col("posterior_bound") >= least, "allow").otherwise("block"))
    return out.withColumn("rule", F.col(f"{hit}.rule")).withColumn("verdict", verdict).drop(hit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a page: the quality label of the document with its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("outcome"))
    outcomes = pages.join(labels, "page_id").select("url", "outcome")
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _sql(least: float = 0.6, z: float = 1.64) -> str:
    two = ", ".join(f"'{x}'" for x in TWO_LABELS)
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    strength = lambda t, rate: f"""(SELECT CASE WHEN more > 0 AND spread > alone THEN least({STRONGEST}, greatest({WEAKEST}, more / (spread - alone) - 1)) ELSE {STRONGEST} END FROM (
      SELECT sum((k - n * r) * (k - n * r) / n) AS spread, sum(r * (1 - r)) AS alone, sum(r * (1 - r) * (n - 1)) AS more FROM (SELECT n, k, {rate} AS r FROM {t})))"""  # noqa: E731
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
x AS (SELECT host, string_split(regexp_replace(host, ':\\d*$', ''), '.') AS parts FROM (SELECT DISTINCT host FROM p)),
y AS (SELECT host, parts, array_to_string(parts[greatest(1, len(parts) - 1):], '.') AS two FROM x),
h AS (
  SELECT host, CASE WHEN two IN ({two}) THEN two ELSE parts[len(parts)] END AS suffix,
    CASE WHEN two IN ({two}) THEN array_to_string(parts[greatest(1, len(parts) - 2):], '.') ELSE two END AS domain FROM y),
hosts AS (
  SELECT host, suffix, domain, count(*) AS n, sum(quality)::BIGINT AS k
  FROM p JOIN labels l ON l.doc_id = p.page_id JOIN h USING (host) WHERE quality IN (0, 1) GROUP BY ALL),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
overall AS (SELECT coalesce(sum(k)::DOUBLE / sum(n), 0.5) AS r FROM suffixes),
ss AS (SELECT {strength("suffixes, overall", "overall.r")} AS ss),
sr AS (SELECT suffix, (k + ss * r) / (n + ss) AS suffix_rate FROM suffixes, ss, overall),
sd AS (SELECT {strength("domains JOIN sr USING (suffix)", "suffix_rate")} AS sd),
dr AS (SELECT domain, (k + sd * suffix_rate) / (n + sd) AS domain_rate FROM domains JOIN sr USING (suffix), sd),
s AS (SELECT {strength("hosts JOIN dr USING (domain)", "domain_rate")} AS sh),
ab AS (
  SELECT h.host, coalesce(k, 0) + sh * coalesce(domain_rate, suffix_rate, r) AS a, coalesce(n, 0) - coalesce(k, 0) + sh * (1 - coalesce(domain_rate, suffix_rate, r)) AS b
  FROM h LEFT JOIN hosts USING (host) LEFT JOIN dr ON dr.domain = h.domain LEFT JOIN sr ON sr.suffix = h.suffix, s, overall),
rules AS (SELECT * FROM (VALUES {rules}) AS r(v, rh, rp)),
hit AS (
  SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, p.host, p.path, rule,
  coalesce(v, CASE WHEN a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {least} THEN 'allow' ELSE 'block' END) AS verdict
FROM p JOIN ab USING (host) LEFT JOIN hit ON hit.host = p.host AND hit.path = p.path
"""


SQL = _sql()
