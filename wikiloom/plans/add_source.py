"""Sources of wikis to an extended catalogue.

Each pipeline finds candidate links, drops those of known hosts, verifies the others
against the probe log, names them and appends what the catalogue lacks. What differs between kinds of sources
is in ``retrievers``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wikiloom.operators import catalog as catalogs
from wikiloom.operators import harvest, probes
from wikiloom.plans.retrievers import REGISTRY, Request, Retriever
from wikiloom.session import staged

# Fixed value: the word that leaves new endpoints disabled.
DISABLING_WORD = "noauto"


def _verified_into(
    catalog: DataFrame,
    links: DataFrame,
    log: DataFrame,
    suffixes: Sequence[str],
    resolver: str,
    auto_enable: bool,
    distinct: bool,
) -> DataFrame:
    """``links`` has ``url`` and its order ``source, seq, pos``."""
    links = staged(links, "links")
    fresh = probes.drop_known_hosts(links, catalogs.load(catalog))
    verified = probes.resolve_by_url(fresh, log, suffixes)
    named = probes.named_endpoints(verified, resolver, auto_enable)
    return catalogs.extend(catalog, named, distinct)


def add_source_dump(
    catalog: DataFrame,
    bodies: DataFrame,
    display_pages: DataFrame,
    log: DataFrame,
    language: str = "english",
    auto_enable: bool = True,
    distinct: bool = False,
) -> DataFrame:
    links = harvest.dump_links(bodies, display_pages, language)
    return _verified_into(
        catalog, links, log, probes.GENERIC_SUFFIXES, "generic", auto_enable, distinct
    )


def add_source_directory(
    catalog: DataFrame,
    crawl: DataFrame,
    seeds: DataFrame,
    log: DataFrame,
    auto_enable: bool = True,
    distinct: bool = False,
) -> DataFrame:
    links = harvest.directory_links(crawl, seeds)
    return _verified_into(
        catalog, links, log, probes.GENERIC_SUFFIXES, "generic", auto_enable, distinct
    )


def add_source_search(
    catalog: DataFrame,
    crawl: DataFrame,
    searches: DataFrame,
    languages: DataFrame | None,
    log: DataFrame,
    family: str,
    auto_enable: bool = True,
    distinct: bool = False,
) -> DataFrame:
    links = harvest.search_links(crawl, searches, languages, family)
    return _verified_into(
        catalog, links, log, probes.WIKIA_SUFFIXES, "wikia", auto_enable, distinct
    )


@dataclass(frozen=True)
class Command:
    """A readable source command: ``<retriever>:<source> <language> [noauto]``."""

    name: str
    retriever: Retriever
    request: Request
    auto_enable: bool


def read_command(command: str, registry: Mapping[str, Retriever] = REGISTRY) -> Command | None:
    """Only the retriever must be named. None if no retriever is, or its source is unreadable."""
    target, *words = command.split() or [""]
    name, *source = target.split(":")
    if name not in registry or len(source) > 1 or source == [""]:
        return None
    retriever = registry[name]
    request = Request(
        source[0] if source else retriever.default_source, words[0] if words else retriever.default_language
    )
    return Command(name, retriever, request, DISABLING_WORD not in words[1:2])


def add_source(
    catalog: DataFrame,
    tables: Mapping[str, DataFrame],
    command: str,
    registry: Mapping[str, Retriever] = REGISTRY,
    distinct: bool = False,
) -> DataFrame | None:
    """The catalogue after a source command; None if the command is not readable, which changes nothing.

    ``tables`` has the probe log as ``log``, and what the retriever reads by the names it gives.
    """
    read = read_command(command, registry)
    if read is None:
        return None
    return _verified_into(
        catalog, read.retriever.found_links(tables, read.request), tables["log"],
        read.retriever.suffixes, read.retriever.resolver, read.auto_enable, distinct,
    )


def source_errors(
    tables: Mapping[str, DataFrame], commands: Sequence[str], registry: Mapping[str, Retriever] = REGISTRY
) -> DataFrame:
    """``retriever, source, language, error`` of the commands that find nothing because what they ask for does not exist.

    The result beside that of ``add_source``, which leaves the catalogue as it is in these cases. Unreadable
    commands have no row.
    """
    spark = next(iter(tables.values())).sparkSession
    found = [
        read.retriever.found_errors(spark, tables, read.request).select(F.lit(read.name).alias("retriever"), "source", "language", "error")
        for read in (read_command(c, registry) for c in commands)
        if read is not None
    ]
    if not found:
        return spark.createDataFrame([], "retriever string, source string, language string, error string")
    return reduce(DataFrame.unionByName, found)
