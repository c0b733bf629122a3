"""URL filter by rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's bad rate is drawn to its
parent's by a beta prior whose strength is the level's own overdispersion (method of moments), from the global
rate down to the host. A page is blocked when the lower quantile (`TAIL`) of its host's beta posterior is above a limit.
An explicit rule goes before reputation.

The registered domain is the host's public suffix and one label more. A suffix is a host's last label, or one of `SUFFIXES` (a parameter) if it has
several; user names and ports are no part of either, and a host that is a number (IPv4, or IPv6 in brackets) is its own domain.

The quantile is that of the posterior's log-odds on a grid of `STEPS` steps (where the density of a beta has no poles), by summing and interpolating; tests hold it
against exact values. It is computed once for each distinct host.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged as the host ``''``; an empty table gives an empty result; very
long urls are taken whole; a null or repeated label row: nulls are skipped, a page is bad if any of its labels says so; rows that repeat a page_id have an outcome
each; a null page_id has none; hosts without labels take their domain's, suffix's or the global estimate; without any label the global rate is 0 (nothing blocked).
Columns other than page_id and url may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import table

#: Fixed values: (verdict, host, path) of the query's rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of a prior's strength, in pseudo-pages; the posterior's share below the bound; the limit on the bad rate.
LEAST_STRENGTH, MOST_STRENGTH, TAIL, LIMIT = 1.0, 1000.0, 0.05, 0.6
#: Steps of the grid, its half width in deviations of the log-odds, and the least parameter of a beta.
STEPS, WIDE, LEAST_BETA = 480, 12.0, 0.05
#: Some public suffixes of more than one label; a full list is a parameter.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr",
    "com.tw", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.cn", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.uk", "or.jp", "or.kr", "org.au",
    "org.br", "org.cn", "org.nz", "org.uk",
)
#: A host without user name and port; what is a number.
BARE = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)"
NUMBER = r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, null where none fits; at equal length a block goes first."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The public suffix; of a number itself."""
    bare = F.regexp_extract(host, BARE, 1)
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(NUMBER), bare).when(two.isin(*suffixes) if suffixes else F.lit(False), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The public suffix and the label before it; of a number itself."""
    bare = F.regexp_extract(host, BARE, 1)
    several = F.substring_index(bare, ".", -2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(bare.rlike(NUMBER), bare).when(several, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def _counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _strength(groups: DataFrame, level: str) -> DataFrame:
    """One row: what the moment estimate of a level's prior needs; sums of whole numbers and of squares over n."""
    return groups.agg(
        F.lit(level).alias("level"),
        F.count("*").alias("k"),
        F.sum("n").alias("all_n"),
        F.sum("bad").alias("all_bad"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2n"),
    )


def prior_strength(k: int, n: int, bad: int, n2: int, b2n: float) -> float:
    """Beta strength from overdispersion; the most where the groups vary no more than by chance."""
    if not n or k < 2 or bad in (0, n):
        return MOST_STRENGTH
    p = bad / n
    var = p * (1 - p)
    rest = var * (n - n2 / n - (k - 1))
    rho = (b2n - n * p * p - var * (k - 1)) / rest if rest > 0 else 0.0
    return MOST_STRENGTH if rho <= 1 / (1 + MOST_STRENGTH) else max(LEAST_STRENGTH, 1 / rho - 1)


def reputation(outcomes: DataFrame, suffixes_=SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """From (host, bad 0/1): tables by host, domain and suffix with the posterior mean, and the scalars used."""
    hosts = (
        outcomes.groupBy("host")
        .agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
        .withColumn("domain", domain_of(F.col("host"), suffixes_))
        .withColumn("suffix", suffix_of(F.col("host"), suffixes_))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _counts(domains, "suffix")
    # three rows, one a level
    found = {
        r["level"]: r
        for r in reduce(DataFrame.unionByName, [_strength(hosts, "host"), _strength(domains, "domain"), _strength(suffixes, "suffix")]).collect()
    }
    s = {k: prior_strength(r["k"], r["all_n"] or 0, r["all_bad"] or 0, r["n2"] or 0, r["b2n"] or 0.0) for k, r in found.items()}
    n, bad = (found["host"]["all_n"] or 0), (found["host"]["all_bad"] or 0)
    s["rate"] = bad / n if n else 0.0

    def shrunk(level: str, parent: Column) -> Column:
        return (F.col("bad") + F.lit(s[level]) * parent) / (F.col("n") + F.lit(s[level]))

    suffixes = suffixes.select("suffix", shrunk("suffix", F.lit(s["rate"])).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk("domain", F.col("suffix_mean")).alias("domain_mean"))
    hosts = hosts.join(domains, "domain").select("host", "n", shrunk("host", F.col("domain_mean")).alias("host_mean"))
    return hosts, domains, suffixes, s


def quantile_sql(a: str, b: str, tail: float = TAIL) -> str:
    """The lower quantile of a beta distribution with parameters a and b (SQL expressions)."""
    mid, dev = f"ln({a} / {b})", f"sqrt(1 / {a} + 1 / {b} + 1 / ({a} * {a}) + 1 / ({b} * {b}))"
    # log-odds of the grid; the density of log-odds u is proportional to exp(a * u) / (1 + exp(u)) ** (a + b), here over its value at the middle
    u = f"({mid} + ({WIDE} * 2 / {STEPS} * i - {WIDE}) * {dev})"
    log_of = lambda u: f"({a} * {u} - ({a} + {b}) * (CASE WHEN {u} > 0 THEN {u} + ln(1 + exp(-{u})) ELSE ln(1 + exp({u})) END))"
    density = f"transform(sequence(0, {STEPS}), i -> exp({log_of(u)} - {log_of(mid)}))"
    # the sum up to each step; where it passes the tail, between two steps
    need = f"({tail} * aggregate(w, 0D, (s, x) -> s + x))"
    walk = f"aggregate(w, named_struct('s', 0D, 'k', 0D), (t, x) -> named_struct('s', t.s + x, 'k', t.k + CASE WHEN t.s + x <= {need} THEN 1D WHEN t.s < {need} THEN ({need} - t.s) / x ELSE 0D END)).k"
    # a step's mass lies around it
    at = f"({mid} + ({WIDE} * 2 / {STEPS} * ({walk} - 0.5D) - {WIDE}) * {dev})"
    return f"transform(array({density}), w -> 1 / (1 + exp(-{at})))[0]"


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, suffixes=SUFFIXES) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, labelled (the host's labelled pages), bad_low (the bound)."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = (
        labels.filter(F.col("doc_id").isNotNull())
        .select("doc_id", ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("long").alias("bad"))
        .groupBy("doc_id")
        .agg(F.max("bad").alias("bad"))
    )
    outcomes = parts.join(bad, parts["page_id"] == bad["doc_id"]).select("host", "bad")
    hosts, by_domain, by_suffix, s = reputation(outcomes, suffixes)
    # every distinct host of the pages gets its estimate once; the pages then join by host
    seen = parts.select("host").distinct().withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    known = (
        seen.join(hosts, "host", "left")
        .join(by_domain, "domain", "left")
        .join(by_suffix, "suffix", "left")
        .select(
            "host",
            F.coalesce("n", F.lit(0)).alias("labelled"),
            F.coalesce("host_mean", "domain_mean", "suffix_mean", F.lit(s["rate"])).alias("mean"),
        )
        .withColumn("_a", F.greatest(F.col("mean") * (F.col("labelled") + F.lit(s["host"])), F.lit(LEAST_BETA)))
        .withColumn("_b", F.greatest((1 - F.col("mean")) * (F.col("labelled") + F.lit(s["host"])), F.lit(LEAST_BETA)))
        .select("host", "labelled", F.expr(quantile_sql("_a", "_b")).alias("bad_low"))
    )
    rule, told = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("bad_low") > limit, "block").otherwise("allow")
    return parts.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(told, judged).alias("verdict"), "labelled", "bad_low"
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return told.withColumn("bad_low", F.round("bad_low", 6))


def _sql() -> str:
    def strength(level: str) -> str:
        return f"""(SELECT CASE WHEN n = 0 OR k < 2 OR bad = 0 OR bad = n OR rho <= 1.0 / (1 + {MOST_STRENGTH}) THEN {MOST_STRENGTH}
            ELSE greatest({LEAST_STRENGTH}, 1 / rho - 1) END FROM (SELECT *, CASE WHEN rest > 0 THEN (b2n - n * p * p - p * (1 - p) * (k - 1)) / rest ELSE 0 END AS rho
            FROM (SELECT *, p * (1 - p) * (n - n2 / n - (k - 1)) AS rest FROM (SELECT *, CASE WHEN n > 0 THEN bad::DOUBLE / n ELSE 0 END AS p
            FROM (SELECT count(*) AS k, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, sum(n * n)::DOUBLE AS n2, sum(bad * bad / n::DOUBLE) AS b2n FROM {level})))))"""

    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in rules]
    rule = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, rules)) + " END"
    told = "CASE " + " ".join(f"{f} '{k}'" for f, (k, _, _) in zip(fits, rules)) + " END"
    bare, several = f"regexp_extract(host, '{BARE}', 1)", ", ".join(f"'{x}'" for x in SUFFIXES)
    last = lambda n: f"array_to_string(list_slice(string_split({bare}, '.'), -{n}, -1), '.')"
    suffix = f"CASE WHEN regexp_matches({bare}, '{NUMBER}') THEN {bare} WHEN {last(2)} IN ({several}) THEN {last(2)} ELSE {last(1)} END"
    domain = f"CASE WHEN regexp_matches({bare}, '{NUMBER}') THEN {bare} WHEN {last(2)} IN ({several}) THEN {last(3)} ELSE {last(2)} END"
    log_of = lambda u: f"(a * {u} - (a + b) * (CASE WHEN {u} > 0 THEN {u} + ln(1 + exp(-{u})) ELSE ln(1 + exp({u})) END))"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
lab AS (SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, {domain} AS domain, {suffix} AS suffix, count(*) AS n, sum(bad) AS bad FROM parts JOIN lab ON page_id = doc_id GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s AS (SELECT {strength('hosts')} AS sh, {strength('domains')} AS sd, {strength('suffixes')} AS ss, coalesce((SELECT sum(bad)::DOUBLE / sum(n) FROM hosts), 0) AS rate),
sm AS (SELECT suffix, (bad + ss * rate) / (n + ss) AS m FROM suffixes, s),
dm AS (SELECT domain, (d.bad + sd * sm.m) / (d.n + sd) AS m FROM domains d JOIN sm USING (suffix), s),
hm AS (SELECT host, n, (h.bad + sh * dm.m) / (h.n + sh) AS m FROM hosts h JOIN dm USING (domain), s),
seen AS (SELECT DISTINCT host, {domain} AS domain, {suffix} AS suffix FROM parts),
known AS (SELECT seen.host, coalesce(hm.n, 0) AS labelled, coalesce(hm.m, dm.m, sm.m, rate) AS mean, sh FROM seen LEFT JOIN hm ON seen.host = hm.host LEFT JOIN dm ON seen.domain = dm.domain LEFT JOIN sm ON seen.suffix = sm.suffix, s),
ab AS (SELECT host, labelled, greatest(mean * (labelled + sh), {LEAST_BETA}) AS a, greatest((1 - mean) * (labelled + sh), {LEAST_BETA}) AS b FROM known),
md AS (SELECT *, ln(a / b) AS mid, sqrt(1 / a + 1 / b + 1 / (a * a) + 1 / (b * b)) AS dev FROM ab),
grid AS (SELECT *, mid + ({WIDE * 2 / STEPS} * i - {WIDE}) * dev AS u FROM md, range(0, {STEPS + 1}) t(i)),
dens AS (SELECT *, exp({log_of('u')} - {log_of('mid')}) AS w FROM grid),
cum AS (SELECT *, sum(w) OVER (PARTITION BY host ORDER BY i) AS c, {TAIL} * sum(w) OVER (PARTITION BY host) AS need FROM dens),
low AS (SELECT host, any_value(labelled) AS labelled, any_value(mid) AS mid, any_value(dev) AS dev, sum(CASE WHEN c <= need THEN 1.0::DOUBLE WHEN c - w < need THEN (need - (c - w)) / w ELSE 0 END) AS k FROM cum GROUP BY host),
bound AS (SELECT host, labelled, 1 / (1 + exp(-(mid + ({WIDE * 2 / STEPS} * (k - 0.5) - {WIDE}) * dev))) AS bad_low FROM low)
SELECT page_id, host, path, {rule} AS rule, coalesce({told}, CASE WHEN bad_low > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, labelled, round(bad_low, 6) AS bad_low
FROM parts JOIN bound USING (host)"""


SQL = _sql()
