"""URL filters: a sorted array of 64-bit digests, memory-mapped by every task.

A rule is a host and a path; it fits its host and all subdomains, if the url's path starts with the rule's. The
longest fitting rule (host and path together; of equal ones that of the longer host) gives the verdict. Where no
rule fits, the list of bad hosts does: a url of a listed host, or a subdomain of one, is blocked, others are allowed.

Method. Rules and listed hosts are strings whose xxhash digests are sorted into one array in a file, beside the
strings and their actions. For a batch of urls all candidates (suffixes of the host times the lengths of path that
rules have) are hashed, found by one vectorised binary search, and confirmed against the stored strings, so a
collision of digests can't decide. The file goes to the shared folder and from there to each executor, which maps
it: tasks of one machine share its pages, and a lost executor fetches it again.

Defined cases. Null urls and urls without `://` have an empty host and path, which no rule fits: allowed. Rules are
compared as given, with the host in lower case; the later of two equal rules counts. Rows are judged one by one, so
repeated rows, ties and empty tables need no care; extra columns pass through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _path, scratch, table

ALLOW, BLOCK, LISTED = 0, 1, 2

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BAD_HOSTS = tuple(f"{name}.example.{top}" for name in ("casino-win", "free-bets", "cheap-pills", "spam-farm", "adult-x", "ads-track") for top in ("com", "net", "org"))

_HEAD = struct.Struct("<QQQQ")
#: The largest file that is handed to executors.
MAX_BYTES = 2 << 30


def packed(rules: Iterable[tuple[str, str, str]], bad_hosts: Iterable[str] = ()) -> bytes:
    """The file: counts, the most labels that a host has, path lengths, sorted digests, ends of the strings, actions, strings."""
    entries: dict[str, int] = {host: LISTED for host in bad_hosts}
    lengths, labels = set(), max((host.count(".") + 1 for host in entries), default=0)
    for verdict, host, path in rules:
        if not path.startswith("/") or "/" in host:
            raise ValueError(f"not a rule: {host!r} {path!r}")
        entries[host.lower() + path] = {"allow": ALLOW, "block": BLOCK}[verdict]
        lengths.add(len(path))
        labels = max(labels, host.count(".") + 1)
    keys = sorted(((xxhash.xxh3_64_intdigest(k), k.encode(), a) for k, a in entries.items()))
    ends = np.cumsum([0, *(len(k) for _, k, _ in keys)], dtype=np.uint64)
    return b"".join(
        (
            _HEAD.pack(len(keys), len(lengths), int(ends[-1]), labels),
            np.array(sorted(lengths), "<u8").tobytes(),
            np.array([d for d, _, _ in keys], "<u8").tobytes(),
            ends.astype("<u8").tobytes(),
            np.array([a for _, _, a in keys], "<u1").tobytes(),
            b"".join(k for _, k, _ in keys),
        )
    )


@dataclass
class DigestArray:
    """A mapped file of `packed`."""

    labels: int
    lengths: list[int]
    digests: np.ndarray
    ends: np.ndarray
    actions: np.ndarray
    strings: np.ndarray

    @classmethod
    def open(cls, path: str) -> DigestArray:
        data = np.memmap(path, np.uint8, "r")
        n, k, size, labels = _HEAD.unpack(data[: _HEAD.size].tobytes())
        at = _HEAD.size
        parts = []
        for count, kind in ((k, "<u8"), (n, "<u8"), (n + 1, "<u8"), (n, "<u1"), (size, "<u1")):
            end = at + count * np.dtype(kind).itemsize
            parts.append(data[at:end].view(kind))
            at = end
        return cls(labels, parts[0].tolist(), *parts[1:])

    def probe(self, keys: list[str]) -> np.ndarray:
        """The entry of each key, or -1: binary search by digest, then the strings themselves."""
        out = np.full(len(keys), -1)
        if not len(self.digests) or not keys:
            return out
        raw = [k.encode("utf-8", "surrogatepass") for k in keys]
        wanted = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        at = np.searchsorted(self.digests, wanted)
        hit = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == wanted))
        for i in hit:
            j = at[i]
            while j < len(self.digests) and self.digests[j] == wanted[i]:
                if self.strings[self.ends[j] : self.ends[j + 1]].tobytes() == raw[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, hosts: Iterable[str], paths: Iterable[str]) -> tuple[list[str | None], list[str]]:
        """(rule, verdict) of each url."""
        keys, owner, rank = [], [], []
        hosts = list(hosts)
        for i, (host, path) in enumerate(zip(hosts, paths)):
            # No listed host has more labels, so a longer suffix can't fit: work is in proportion to the url.
            last = host.rsplit(".", self.labels) if self.labels else []
            for k in range(min(len(last), self.labels), 0, -1):
                suffix = ".".join(last[-k:])
                if not suffix:
                    continue
                for n in self.lengths:
                    if n <= len(path):
                        keys.append(suffix + path[:n])
                        owner.append(i)
                        rank.append((len(suffix) + n, len(suffix)))
                keys.append(suffix)
                owner.append(i)
                rank.append((0, len(suffix)))
        best: list[tuple | None] = [None] * len(hosts)
        found = self.probe(keys)
        for c in np.flatnonzero(found >= 0):
            i = owner[c]
            if best[i] is None or rank[c] > best[i][0]:
                best[i] = (rank[c], keys[c], int(self.actions[found[c]]))
        rules = [b[1] if b and b[2] != LISTED else None for b in best]
        return rules, ["block" if b and b[2] != ALLOW else "allow" for b in best]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def publish(spark: SparkSession, data: bytes) -> str:
    """Writes the file to the shared folder and hands it to all executors; the name to open there. Refused over MAX_BYTES."""
    if len(data) > MAX_BYTES:
        raise ValueError(f"{len(data)} bytes of rules and hosts are more than {MAX_BYTES}")
    folder = scratch(spark)
    name = f"urls-{folder.rpartition('-')[2]}"  # a session takes a file's name once
    path, fs = _path(spark, f"{folder}/{name}")
    out = fs.create(path)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def judge_urls(pages: DataFrame, rules=RULES, bad_hosts=BAD_HOSTS, url_col: str = "url") -> DataFrame:
    """All columns of `pages` as the struct `row`, with host, path, rule and verdict."""
    name = publish(pages.sparkSession, packed(rules, bad_hosts))

    @F.pandas_udf("rule string, verdict string")
    def run(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rule, verdict = DigestArray.open(SparkFiles.get(name)).judge(hosts, paths)
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    url = F.col(url_col)
    split = pages.select(F.struct("*").alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    return split.withColumn("judged", run("host", "path")).select("row", "host", "path", "judged.rule", "judged.verdict")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return done.select("row.page_id", "host", "path", "rule", "verdict")
