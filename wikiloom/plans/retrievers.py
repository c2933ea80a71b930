"""Kinds of sources, as functions from tables to candidate links.

A retriever says which sources it lists, what it takes if a command leaves something out, which tables it
reads, how its links are found and verified, and which errors it reports. ``REGISTRY`` maps names to retrievers; another
one is added by passing a larger mapping.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wikiloom.operators import harvest, probes
from wikiloom.operators.languages import with_language_code

# What the errors are called.
NO_SOURCE = "source not found"
NO_LANGUAGE = "unknown language"

ERRORS = "source string, language string, error string"


@dataclass(frozen=True)
class Request:
    """What a command asks of a retriever."""

    source: str
    language: str


Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Retriever:
    """``links`` gives ``url`` and its order ``source, seq, pos``; ``errors`` gives ``source, language, error``.

    ``tables`` names the columns of each table that both may read; a table that is missing or lacks one is refused
    before anything runs. Those in ``optional`` may be missing.
    """

    tables: Mapping[str, str]
    links: Callable[[Tables, Request], DataFrame]
    resolver: str
    suffixes: Sequence[str]
    default_source: str
    default_language: str = "english"
    sources: Sequence[str] = ()
    errors: Callable[[Tables, Request], DataFrame] | None = None
    optional: Mapping[str, str] = MappingProxyType({})

    def checked(self, tables: Tables) -> Tables:
        """The tables it reads, with the columns it reads."""
        found = {}
        for name, schema in {**self.tables, **self.optional}.items():
            if name in self.optional and name not in tables:
                continue
            wanted = T.StructType.fromDDL(schema).fieldNames()
            lacking = [c for c in wanted if name not in tables or c not in tables[name].columns]
            if lacking:
                raise ValueError(f"table {name} lacks {', '.join(lacking)}")
            found[name] = tables[name].select(*wanted)
        return found

    def found_links(self, tables: Tables, request: Request) -> DataFrame:
        return self.links(self.checked(tables), request)

    def found_errors(self, spark: SparkSession, tables: Tables, request: Request) -> DataFrame:
        if self.errors is None:
            return spark.createDataFrame([], ERRORS)
        return self.errors(self.checked(tables), request)


def _dump_tables(tables: Tables, request: Request) -> tuple[DataFrame, DataFrame]:
    return (
        tables["bodies"].filter(F.col("source") == request.source),
        tables["display_pages"].filter(F.col("project") == request.source),
    )


def _dump_links(tables: Tables, request: Request) -> DataFrame:
    bodies, pages = _dump_tables(tables, request)
    return harvest.dump_links(bodies, pages, request.language)


def _dump_errors(tables: Tables, request: Request) -> DataFrame:
    bodies, _ = _dump_tables(tables, request)
    return missing_sources(bodies, request.language)


def missing_sources(bodies: DataFrame, language: str) -> DataFrame:
    """An error for each dump that says that its project does not exist."""
    return harvest.missing_sources(bodies).select("source", F.lit(language).alias("language"), F.lit(NO_SOURCE).alias("error"))


def _directory_links(tables: Tables, request: Request) -> DataFrame:
    return harvest.directory_links(tables["crawl"], tables["seeds"])


# The word for all search results, and what a link of this family holds.
ALL_RESULTS = "all"
FAMILY = "fandom"


def _searches(spark: SparkSession, request: Request) -> DataFrame:
    term = "" if request.source == ALL_RESULTS else request.source
    return spark.range(1).select(F.lit(term).alias("term"), F.lit(request.language).alias("language"))


def _search_links(tables: Tables, request: Request) -> DataFrame:
    searches = _searches(tables["crawl"].sparkSession, request)
    return harvest.search_links(tables["crawl"], searches, tables.get("languages"), FAMILY)


def _search_errors(tables: Tables, request: Request) -> DataFrame:
    searches = _searches(tables["crawl"].sparkSession, request)
    return unknown_languages(searches, tables.get("languages"))


def unknown_languages(searches: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """An error for each search ``term, language`` in a language that is not known."""
    coded = with_language_code(searches.select("term", "language"), languages)
    return coded.filter(F.col("code").isNull()).select(F.col("term").alias("source"), "language", F.lit(NO_LANGUAGE).alias("error"))


# Names of the retrievers, in order of registration, with the names of their sources and
# what they take if a command does not say it. The sources of the first are those on its index page.
REGISTRY: Mapping[str, Retriever] = {
    "wikistats": Retriever(
        tables={"bodies": "source string, body string", "display_pages": "project string, html string"},
        links=_dump_links,
        errors=_dump_errors,
        resolver="generic",
        suffixes=probes.GENERIC_SUFFIXES,
        default_source="wikipedias",
    ),
    "gamepedia": Retriever(
        tables={"crawl": "url string, html string", "seeds": "seed string"},
        links=_directory_links,
        resolver="generic",
        suffixes=probes.GENERIC_SUFFIXES,
        default_source="gamepedia",
        sources=("gamepedia",),
    ),
    "fandom": Retriever(
        tables={"crawl": "term string, lang string, page_no int, html string"},
        optional={"languages": "ord int, name string, code string"},
        links=_search_links,
        errors=_search_errors,
        resolver="wikia",
        suffixes=probes.WIKIA_SUFFIXES,
        default_source=ALL_RESULTS,
        sources=("<single word search or all>",),
    ),
}


def registered_sources(registry: Mapping[str, Retriever] = REGISTRY) -> dict[str, list[str]]:
    return {name: list(retriever.sources) for name, retriever in registry.items()}
