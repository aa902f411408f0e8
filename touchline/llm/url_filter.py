"""URL rules in a sorted digest array.

Each rule's (host, path) is a 64-bit xxhash key in one sorted array, beside its full string. Executors map
that array into memory, look up the keys of a URL's host suffixes and path beginnings by vectorised binary
search, and compare the full strings of what is found, so that a colliding key cannot decide a URL.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, quoted, table

#: (verdict, host, path); a rule holds for its host and all subdomains, for paths that start with its path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: The array is broadcast: more entries than this are refused.
MAX_RULES = 5_000_000


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty for null and for strings without ://. All other
    columns stay, whatever their names."""
    u = quoted(url)
    rest = F.coalesce(F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))), F.lit(""))
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(raw_host, UPPER, UPPER.lower()), "path": path})


class DigestArray:
    """Rules by key, as bytes that can be mapped: count, keys, ends of the strings, verdicts, strings."""

    @staticmethod
    def key(host: str, path: str) -> int:
        return xxhash.xxh64_intdigest(f"{host}\0{path}")

    @classmethod
    def build(cls, rules: Iterable[tuple[str, str, str]]) -> bytes:
        """rules: (verdict, host, path); the last of equal (host, path) holds."""
        by_name = {(h, p): v for v, h, p in rules}
        if len(by_name) > MAX_RULES:
            raise ValueError(f"{len(by_name)} rules; the array holds {MAX_RULES}")
        rows = sorted((cls.key(h, p), h, p, v) for (h, p), v in by_name.items())
        names = [f"{h}\0{p}".encode() for _, h, p, _ in rows]
        keys = np.array([r[0] for r in rows], dtype="<u8")
        ends = np.cumsum([len(x) for x in names], dtype="<i8") if rows else np.zeros(0, "<i8")
        block = np.array([r[3] == "block" for r in rows], dtype="u1")
        return np.array([len(rows)], "<i8").tobytes() + keys.tobytes() + ends.tobytes() + block.tobytes() + b"".join(names)

    def __init__(self, blob: bytes):
        # An unlinked scratch file of this process, so that the pages are the file cache's.
        self._file = tempfile.TemporaryFile()
        self._file.write(blob)
        self._file.flush()
        self._map = mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self._map, "<i8", 1)[0])
        self.keys = np.frombuffer(self._map, "<u8", n, 8)
        self.ends = np.frombuffer(self._map, "<i8", n, 8 + 8 * n)
        self.block = np.frombuffer(self._map, "u1", n, 8 + 16 * n)
        self._at = 8 + 17 * n
        names = [self.name(i).split("\0", 1) for i in range(n)]
        self.host_max = max((len(h) for h, _ in names), default=0)
        self.path_lengths = sorted({len(p) for _, p in names})

    def name(self, i: int) -> str:
        start = int(self.ends[i - 1]) if i else 0
        return self._map[self._at + start : self._at + int(self.ends[i])].decode()

    def candidates(self, host: str, path: str) -> Iterator[tuple[str, str]]:
        """Host suffixes at label boundaries, as long as any rule's host, with beginnings of the path."""
        begins = [path[:n] for n in self.path_lengths if n <= len(path)]
        at = 0
        while True:
            if len(host) - at <= self.host_max:
                for p in begins:
                    yield host[at:], p
            dot = host.find(".", at)
            if dot < 0:
                return
            at = dot + 1

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """Per URL the longest rule that fits, as host + path, and its verdict."""
        owner, text = [], []
        for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            for host, path in self.candidates(h, p):
                owner.append(k)
                text.append(f"{host}\0{path}")
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(hosts)
        if not text or not len(self.keys):
            return out
        probe = np.fromiter((xxhash.xxh64_intdigest(x) for x in text), "<u8", len(text))
        lo, hi = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        best = [(-1, "")] * len(hosts)
        for j in np.flatnonzero(hi > lo):
            for i in range(lo[j], hi[j]):
                if self.name(i) == text[j]:
                    rule, k = text[j].replace("\0", ""), owner[j]
                    if (len(rule), rule) > best[k]:
                        best[k] = (len(rule), rule)
                        out[k] = (rule, "block" if self.block[i] else "allow")
        return out


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict.

    Of the rules that fit the longest (host and path together) wins; without one rule is null and verdict is
    `default`. A null or malformed URL has an empty host and path, so no rule. Columns of df named host,
    path, rule or verdict are replaced; the others, repeated rows included, stay. URLs of any length are judged
    whole; of rules that tie in length the last by name wins; an empty table gives no rows. At most MAX_RULES
    rules.
    """
    spark = df.sparkSession
    blob = spark.sparkContext.broadcast(DigestArray.build(rules))
    held: dict[str, DigestArray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = held.setdefault("array", DigestArray(blob.value))
        for b in batches:
            found = array.judge(b.column("host").to_pylist(), b.column("path").to_pylist())
            cols = [*b.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "rule", "verdict"])

    split = split_url(df.drop("rule", "verdict"), url)
    return split.mapInArrow(run, T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), s AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT s.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id, s.host, s.path ORDER BY length(r.rhost || r.rpath) DESC) AS k
  FROM s LEFT JOIN r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
