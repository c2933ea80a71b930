"""URL filter: host and path rules in a sorted array of 64-bit digests.

The rules are hashed with xxhash, sorted, and written as one file of digests and one of
strings, which Spark ships to the executors. There they are memory-mapped, so all
workers of a machine share the pages. A URL is probed with every suffix of its host at a
dot, together with every prefix of its path that is as long as some rule's path: one
vectorised binary search for a batch of URLs. A digest that is found counts only if
the stored string is the probed one, so equal digests of different strings decide nothing.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from wikiloom.llm.common import arrow_map, fields, url_host, url_path
from wikiloom.session import scratch_path

#: Rules in one file. More rules make more files, each fetched and written by itself.
SHARD_RULES = 2_000_000


class DigestArray:
    """A memory-mapped set of (rule, verdict)."""

    def __init__(self, folder: str, name: str):
        self.keys = np.memmap(os.path.join(folder, f"{name}.keys"), dtype=np.uint64, mode="r")
        self.ends = np.memmap(os.path.join(folder, f"{name}.ends"), dtype=np.int64, mode="r")
        self.strings = np.memmap(os.path.join(folder, f"{name}.strings"), dtype=np.uint8, mode="r")
        with open(os.path.join(folder, f"{name}.lengths"), "rb") as file:
            self.path_lengths, self.empty = pickle.load(file)

    @staticmethod
    def files(rules: list[tuple[str, str, str]]) -> dict[str, bytes]:
        """Contents by ending for rules (host, path, verdict); of equal rules a block counts."""
        verdicts: dict[str, str] = {}
        for host, path, verdict in sorted(rules, key=lambda r: r[2] == "block"):
            verdicts[host + path] = "allow" if verdict == "allow" else "block"
        entries = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in verdicts.items())
        stored = [f"{v[0]}{k}".encode() for _, k, v in entries]
        return {
            "keys": np.array([e[0] for e in entries] or [0], dtype=np.uint64).tobytes(),
            "ends": np.cumsum([0, *map(len, stored)], dtype=np.int64).tobytes(),
            "strings": b"".join(stored) or b"\0",
            "lengths": pickle.dumps((sorted({len(p) for _, p, _ in rules}), not entries)),
        }

    def probe(self, texts: list[str]) -> list[str | None]:
        """Per probed string the verdict stored for it."""
        found: list[str | None] = [None] * len(texts)
        if self.empty or not texts:
            return found
        digests = np.fromiter(map(xxhash.xxh64_intdigest, texts), dtype=np.uint64, count=len(texts))
        first = np.searchsorted(self.keys, digests, side="left")
        last = np.searchsorted(self.keys, digests, side="right")
        for i in np.flatnonzero(last > first):
            wanted = texts[i].encode()
            for entry in range(first[i], last[i]):
                stored = self.strings[self.ends[entry] : self.ends[entry + 1]].tobytes()
                if stored[1:] == wanted:
                    found[i] = "allow" if stored[:1] == b"a" else "block"
        return found


def _ship(spark: SparkSession, rules: DataFrame, shard_rules: int) -> list[str]:
    """Write the rules shard by shard and hand the files to Spark; their names."""
    rules = rules.select(
        F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).filter("host IS NOT NULL")
    shards = max(1, -(-rules.count() // shard_rules))
    names = []
    for shard in range(shards):
        part = rules.filter(F.pmod(F.xxhash64("host", "path"), F.lit(shards)) == shard)
        path = scratch_path(spark, "url-rules")
        for ending, data in DigestArray.files([tuple(r) for r in part.toLocalIterator()]).items():
            _write(spark, f"{path}.{ending}", data)
            spark.sparkContext.addFile(f"{path}.{ending}")
        names.append(os.path.basename(path))
    return names


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in the shared folder, whatever store that is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()


def _judged(host: str, path: str, lengths: list[int]) -> list[str]:
    """Strings to probe for one URL, the longest first."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    paths = [path[:n] for n in lengths if n <= len(path)]
    return sorted((h + p for h in hosts for p in paths), key=len, reverse=True)


def filter_urls(
    urls: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", shard_rules: int = SHARD_RULES
) -> DataFrame:
    """``urls`` with ``host, path, rule, verdict``; other columns of these names are replaced.

    ``rules`` has ``host, path, verdict`` (block or allow). A rule fits its host and all
    subdomains if the URL's path starts with the rule's; the longest rule decides, block before
    allow for equal rules. ``rule`` is its host and path, NULL if none fits, when the verdict is
    ``otherwise``. A NULL url or one without ``://`` has an empty host and path, which no rule
    fits. Rows are neither dropped nor merged; no rules at all let everything pass.
    """
    spark = urls.sparkSession
    names = _ship(spark, rules, shard_rules)
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    prepared = urls.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    schema = fields(prepared.schema, "rule string, verdict string")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # SparkFiles places each file in the executor's own copy of the shipped files.
        arrays = [DigestArray(os.path.dirname(SparkFiles.get(f"{n}.keys")), n) for n in names]
        for batch in batches:
            hosts = batch.column(batch.num_columns - 2).to_pylist()
            paths = batch.column(batch.num_columns - 1).to_pylist()
            rules_found: list[str | None] = [None] * len(hosts)
            verdicts = [otherwise] * len(hosts)
            for array in arrays:
                probes = [_judged(h, p, array.path_lengths) for h, p in zip(hosts, paths)]
                answers = iter(array.probe([s for row in probes for s in row]))
                for i, row in enumerate(probes):
                    for text, verdict in [(s, next(answers)) for s in row]:
                        if verdict and len(text) > len(rules_found[i] or ""):
                            rules_found[i], verdicts[i] = text, verdict
            columns = [*batch.columns, pa.array(rules_found, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "rule", "verdict"])

    return arrow_map(prepared, judge, schema)
