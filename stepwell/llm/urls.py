"""URL filters: rules on host and path, and a list of blocked hosts, in sorted digest arrays.

An entry is ``(host, path, verdict)``. It fits its host and all subdomains when the url's path
starts with the entry's path. Entries are stored as one file: their 64-bit xxHash keys in order,
then the strings. Spark hands the file to every executor, whose workers memory-map it, probe it
with a vectorised binary search, and confirm the stored string, so a collision of keys never
decides. A url is probed with its parent domains of each number of labels, and its path's beginnings
of each length, that occur among the entries.

The longest fitting rule wins (host and path together; of equal ones the longer host). Where no
rule fits, the method itself decides: block if the host or a parent of it is on the blocked list,
else allow.

The file is made on the driver and copied to every executor, so its size is checked
(``MAX_BYTES``). Longer lists take :func:`judge_by_join`, which finds the same rows by shuffled
joins on the candidates' digests.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule, and verdict
allow. Repeated rows and ids give a row each; ties are decided as above; html and other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = tuple[str, str, str]

#: Driver and every executor keep one copy of the file; beyond this use ``judge_by_join``.
MAX_BYTES = 256 << 20


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{path}".encode("utf-8", "surrogatepass"))


class DigestArray:
    """Sorted 64-bit keys with their strings, in one memory-mapped file."""

    def __init__(self, file: str):
        with open(file, "rb") as start:
            self.count, n_lengths, n_labels = np.frombuffer(start.read(24), "<u8").tolist()
            self.path_lengths = np.frombuffer(start.read(8 * n_lengths), "<u8").tolist()
            self.label_counts = np.frombuffer(start.read(8 * n_labels), "<u8").tolist()
        at = 8 * (3 + n_lengths + n_labels)
        if self.count:
            self.keys = np.memmap(file, "<u8", "r", at, (self.count,))
            self.ends = np.memmap(file, "<u8", "r", at + 8 * self.count, (self.count + 1,))
            self.body = np.memmap(file, np.uint8, "r", at + 8 * (2 * self.count + 1))

    @staticmethod
    def to_bytes(entries: Sequence[Rule]) -> bytes:
        last = {(h.lower(), p): v for h, p, v in entries}
        rows = sorted((_key(h, p), json.dumps([h, p, v]).encode()) for (h, p), v in last.items())
        lengths = sorted({len(p) for _, p in last})
        labels = sorted({h.count(".") + 1 for h, _ in last})
        parts = [
            np.array([len(rows), len(lengths), len(labels)], "<u8"),
            np.array(lengths, "<u8"),
            np.array(labels, "<u8"),
            np.array([k for k, _ in rows], "<u8"),
            np.cumsum([0, *(len(s) for _, s in rows)], dtype=np.int64).astype("<u8"),
        ]
        return b"".join(p.tobytes() for p in parts) + b"".join(s for _, s in rows)

    def find(self, wanted: Sequence[tuple[str, str]]) -> list[str | None]:
        """The verdict stored for each (host, path), or None."""
        if not self.count or not wanted:
            return [None] * len(wanted)
        probes = np.array([_key(h, p) for h, p in wanted], np.uint64)
        at = np.searchsorted(self.keys, probes)
        hit = self.keys[np.minimum(at, self.count - 1)] == probes
        out: list[str | None] = [None] * len(wanted)
        for i in np.flatnonzero(hit):
            k = int(at[i])
            while k < self.count and self.keys[k] == probes[i]:
                host, path, verdict = json.loads(bytes(self.body[int(self.ends[k]) : int(self.ends[k + 1])]))
                if (host, path) == tuple(wanted[i]):
                    out[i] = verdict
                k += 1
        return out


def ship(spark: SparkSession, entries: Sequence[Rule]) -> str:
    """Hand the entries' file to all executors, also to those that join later; its name."""
    data = DigestArray.to_bytes(entries)
    if len(data) > MAX_BYTES:
        raise ValueError(f"{len(data)} bytes of entries: over {MAX_BYTES}, use judge_by_join")
    name = f"digests-{hashlib.sha256(data).hexdigest()[:24]}"
    folder = os.path.join(SparkFiles.getRootDirectory(), "shipped")  # the driver's, until it stops
    os.makedirs(folder, exist_ok=True)
    file = os.path.join(folder, name)
    if not os.path.exists(file):
        with open(file, "wb") as out:
            out.write(data)
    spark.sparkContext.addFile(file)
    return name


@lru_cache(maxsize=8)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def candidates(
    host: str, path: str, path_lengths: Sequence[int], label_counts: Sequence[int]
) -> list[tuple[str, str]]:
    """Every (parent domain, path prefix) that an entry could have, best first."""
    last = host.rsplit(".", max(label_counts, default=0)) if host else []
    whole = host.count(".") + 1  # labels; the first item of ``last`` may hold several
    parents = [host if n == whole else ".".join(last[-n:]) for n in label_counts if last and n <= whole]
    lengths = [n for n in path_lengths if n <= len(path)]
    pairs = [(p, path[:n]) for p in parents for n in lengths]
    return sorted(pairs, key=lambda x: (len(x[0]) + len(x[1]), len(x[0])), reverse=True)


def judge(pages: DataFrame, rules: Sequence[Rule], blocked_hosts: Sequence[str]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    rule_file = ship(spark, rules)
    list_file = ship(spark, [(host, "", "block") for host in blocked_hosts])

    @F.pandas_udf("rule string, verdict string")
    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rule_array, host_array = _opened(rule_file), _opened(list_file)
        owner, asked, host_owner, host_asked = [], [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            tried = candidates(host, path, rule_array.path_lengths, rule_array.label_counts)
            owner += [i] * len(tried)
            asked += tried
            parents = candidates(host, "", [0], host_array.label_counts)
            host_owner += [i] * len(parents)
            host_asked += parents
        rule: list[str | None] = [None] * len(hosts)
        verdict = ["allow"] * len(hosts)
        for i, found in zip(host_owner, host_array.find(host_asked), strict=True):
            if found:
                verdict[i] = found
        for i, (host, path), found in zip(owner, asked, rule_array.find(asked), strict=True):
            if found and rule[i] is None:  # the best candidate comes first
                rule[i], verdict[i] = host + path, found
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = at.withColumn("_j", decide("host", "path"))
    return judged.select("page_id", "host", "path", "_j.rule", "_j.verdict")


def judge_by_join(pages: DataFrame, rules: DataFrame, blocked_hosts: DataFrame) -> DataFrame:
    """The rows of :func:`judge` for lists of any size: ``rules`` (host, path, verdict), each
    (host, path) once, and ``blocked_hosts`` (host). Distinct (host, path) pairs are expanded to
    their candidates, which meet the entries in a shuffled join; only the distinct path lengths and
    numbers of labels of the entries reach the driver, at most the longest entry's length."""
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    entry_hosts = rules.select("host").unionByName(blocked_hosts.select("host"))
    counts = sorted(r[0] for r in entry_hosts.select(F.size(F.split("host", r"\."))).distinct().collect())
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.filter(F.array(*[F.lit(n) for n in counts] or [F.lit(1)]), lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    pairs = at.select("host", "path").distinct().filter("host != ''")
    tried = pairs.select("host", "path", F.explode(parents).alias("parent"))
    prefix = F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)])).alias("n")
    fits = (
        tried.select("*", prefix).filter(F.length("path") >= F.col("n"))
        .withColumn("prefix", F.expr("substring(path, 1, n)"))
        .join(
            rules.select(
                F.lower("host").alias("parent"), F.col("path").alias("prefix"), F.col("verdict").alias("by_rule")
            ),
            ["parent", "prefix"],
        )
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct(F.concat("parent", "prefix").alias("rule"), "by_rule"),
                F.struct(F.length("parent") + F.length("prefix"), F.length("parent")),
            ).alias("best")
        )
    )
    listed = (
        tried.join(blocked_hosts.select(F.lower("host").alias("parent")).distinct(), "parent", "left_semi")
        .select("host", "path", F.lit(True).alias("listed")).distinct()
    )
    return (
        at.join(fits, ["host", "path"], "left").join(listed, ["host", "path"], "left")
        .select(
            "page_id", "host", "path", "best.rule",
            F.coalesce("best.by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        )
    )
