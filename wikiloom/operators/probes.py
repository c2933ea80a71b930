"""Harvested links to verified endpoints, from a log of probed URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions.urls import DISABLED, host_label, host_of, https_form, is_well_formed
from wikiloom.operators.containment import contained
from wikiloom.session import staged

# Where the two kinds of wiki keep their interface.
GENERIC_SUFFIXES = ["/api.php", "/w/api.php", "/wiki/api.php"]
WIKIA_SUFFIXES = ["/api/v1"]

OK = 200


def known_hosts(candidates: DataFrame, endpoints: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct hosts of the candidates that the loaded endpoints cover.

    A host is covered if it is contained in an endpoint URL, wherever it stands there;
    ``exact=True`` asks for equal hosts.
    """
    hosts = candidates.select(host_of(F.col("url")).alias("host")).distinct()
    if exact:
        covered = endpoints.select(host_of(F.col("endpoint")).alias("host")).distinct()
        return staged(hosts.join(covered, "host", "left_semi"), "hosts")
    found = contained(
        hosts.withColumnRenamed("host", "needle"),
        endpoints.select(F.col("endpoint").alias("haystack")),
    )
    return staged(found.withColumnRenamed("needle", "host"), "hosts")


def drop_known_hosts(candidates: DataFrame, endpoints: DataFrame, exact: bool = False) -> DataFrame:
    """Candidates of hosts that the loaded endpoints do not cover; malformed ones stay."""
    hosts = known_hosts(candidates, endpoints, exact)
    return (
        candidates.withColumn("host", host_of(F.col("url")))
        .join(hosts, "host", "left_anti")
        .select(*candidates.columns)
    )


def probe_plan(candidates: DataFrame, suffixes: Sequence[str] = GENERIC_SUFFIXES) -> DataFrame:
    """URLs to probe per candidate, in order.

    Step 0 is the link, step 1 its https form; the suffixes follow, with ``retry_url``
    for the case that the https form had to be used.
    """
    link, secure = F.col("url"), https_form(F.col("url"))
    steps = F.array(
        F.struct(link.alias("url"), F.lit(None).cast("string").alias("retry_url")),
        F.struct(secure.alias("url"), F.lit(None).cast("string").alias("retry_url")),
        *[
            F.struct(
                F.concat(link, F.lit(s)).alias("url"), F.concat(secure, F.lit(s)).alias("retry_url")
            )
            for s in suffixes
        ],
    )
    return candidates.select("cand_id", F.posexplode(steps).alias("step", "probe")).select(
        "cand_id", "step", "probe.url", "probe.retry_url"
    )


def _first_endpoint(base: Column, statuses: Sequence[Column], suffixes: Sequence[str]) -> Column:
    """Base plus the first suffix with status 200; an exception ends the search."""
    chain = F.lit(None).cast("string")
    for status, suffix in reversed(list(zip(statuses, suffixes))):
        chain = (
            F.when(status == OK, F.concat(base, F.lit(suffix)))
            .when(status.isNotNull(), chain)
            .otherwise(F.lit(None))
        )
    return chain


def _verified(
    link: Column,
    first: Column,
    retry: Column,
    on_link: Sequence[Column],
    on_https: Sequence[Column],
    suffixes: Sequence[str],
) -> Column:
    """The endpoint a link leads to, or NULL.

    A NULL status stands for an exception and counts only if its step is reached: the
    https form only after another status than 200, a suffix only while none fits.
    """
    direct = _first_endpoint(link, on_link, suffixes)
    secured = _first_endpoint(https_form(link), on_https, suffixes)
    return F.when(
        is_well_formed(link),
        F.when(first == OK, direct).when(first.isNotNull() & (retry == OK), secured),
    )


def resolve_by_step(
    candidates: DataFrame, probes: DataFrame, suffixes: Sequence[str] = GENERIC_SUFFIXES
) -> DataFrame:
    """Verified endpoints from a log with one status per candidate and step."""
    count = 2 + len(suffixes)
    by_candidate = (
        probes.filter(F.col("step") < count)
        .groupBy("cand_id")
        .agg(*[F.max(F.when(F.col("step") == i, F.col("status"))).alias(f"s{i}") for i in range(count)])
    )
    later = [F.col(f"s{i}") for i in range(2, count)]
    endpoint = _verified(F.col("url"), F.col("s0"), F.col("s1"), later, later, suffixes)
    return (
        candidates.join(by_candidate, "cand_id")
        .withColumn("endpoint", endpoint)
        .filter(F.col("endpoint").isNotNull())
        .select(*candidates.columns, "endpoint")
    )


def resolve_by_url(
    candidates: DataFrame, log: DataFrame, suffixes: Sequence[str] = GENERIC_SUFFIXES
) -> DataFrame:
    """Verified endpoints from a log ``url, status`` with one row per URL.

    Each distinct link is resolved once; a URL missing from the log was not reached.
    """
    links = candidates.select("url").filter(is_well_formed(F.col("url"))).distinct()
    secure = https_form(F.col("url"))
    slots = {"s0": F.col("url"), "s1": secure}
    for i, suffix in enumerate(suffixes):
        slots[f"a{i}"] = F.concat("url", F.lit(suffix))
        slots[f"b{i}"] = F.concat(secure, F.lit(suffix))
    wanted = F.array(*[F.struct(F.lit(k).alias("slot"), v.alias("probed")) for k, v in slots.items()])
    statuses = (
        links.select("url", F.inline(wanted))
        .join(log.select(F.col("url").alias("probed"), "status"), "probed")
        .groupBy("url")
        .agg(*[F.max(F.when(F.col("slot") == k, F.col("status"))).alias(k) for k in slots])
    )
    indexes = range(len(suffixes))
    endpoint = _verified(
        F.col("url"),
        F.col("s0"),
        F.col("s1"),
        [F.col(f"a{i}") for i in indexes],
        [F.col(f"b{i}") for i in indexes],
        suffixes,
    )
    verified = statuses.select("url", endpoint.alias("endpoint")).filter("endpoint IS NOT NULL")
    return candidates.join(staged(verified, "verified"), "url").select(
        *candidates.columns, "endpoint"
    )


def named_endpoints(verified: DataFrame, resolver: str, auto_enable: bool = True) -> DataFrame:
    """Catalogue rows for verified endpoints, named after their host."""
    name = host_label(F.col("endpoint")) if auto_enable else F.lit(DISABLED)
    return verified.withColumns(
        {
            "referenceid": name,
            "resolverid": F.lit(resolver),
            "color": F.lit(None).cast("int"),
        }
    )


def funnel(
    dump: DataFrame,
    endpoints: DataFrame,
    probes: DataFrame,
    language: str,
    suffixes: Sequence[str] = GENERIC_SUFFIXES,
) -> DataFrame:
    """Rows left after each stage of a harvest, from one pass over flags.

    ``dump`` has ``id, lang, statsurl, http``; ``probes`` is keyed by ``id`` as
    ``cand_id``.
    """
    from wikiloom.operators.harvest import has_language, statsurl_link

    flagged = dump.withColumn("in_language", has_language(F.col("lang"), language)).withColumn(
        "url", F.when(F.col("in_language"), statsurl_link(F.col("statsurl"), F.col("http")))
    )
    links = flagged.filter(F.col("url").isNotNull()).select(F.col("id").alias("cand_id"), "url")
    covered = known_hosts(links, endpoints).withColumn("covered", F.lit(True))
    verified = resolve_by_step(links, probes, suffixes).select(
        F.col("cand_id").alias("id"), "endpoint"
    )
    is_link = F.col("url").isNotNull()
    is_new = is_link & F.col("covered").isNull()
    return (
        # Rows without a host get a key of their own, as NULL would gather them in one task.
        flagged.withColumn("host", F.coalesce(host_of(F.col("url")), F.concat(F.lit("\0"), F.col("id").cast("string"))))
        .join(covered, "host", "left")
        .join(verified, "id", "left")
        .agg(
            F.count("*").alias("found"),
            F.count_if("in_language").alias("in_language"),
            F.count_if(is_link).alias("links"),
            F.count_if(is_new).alias("unknown_hosts"),
            F.count_if(is_new & F.col("endpoint").isNotNull()).alias("verified"),
        )
    )
