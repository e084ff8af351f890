"""URL verdicts from a sorted array of 64-bit digests that every task maps into memory.

Rules name a host and the start of a path (``example.net/en/``); a rule fits its host and all of
its subdomains, and the longest rule that fits decides (of rules equally long, the one with the
longer host). Where none fits, an address (host and path) that stands on the list is blocked and
any other is allowed.

Rules and list make one file: xxhash64 digests in order, the strings they were made of, and what
each means. Spark hands the file to every executor, which maps it. For every page the starts of its
host's labels and the path lengths that rules have give the candidates, and they and the whole
address are searched for all at once, by binary search. Equal digests prove nothing: the stored
string is compared, and where it differs the next entry with that digest is looked at.

A list of over LIST_BYTES is not mapped whole: the list and the distinct addresses of the pages are
dealt by hash into parts of at most about that size, each part makes its own array and searches it
the same way, and what it found is joined with the pages. The verdicts are the same.

Defined results: the host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the
end, with A to Z in lower case, ports and users included; the path goes on to ``?``, ``#`` or the
end. A null url, or one without ``://``, has neither and is allowed. Repeated pages, null or equal
page ids are judged row by row; other columns are not read; the empty table gives no rows, and an
empty list or no rules at all are fine. A url may be as long as a row may be.
"""

from __future__ import annotations

import re
import string
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cotflow.llm.batches import arrow_schema
from cotflow.llm.frames import staged
from cotflow.session import shared_dir

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Bytes of listed addresses (with their digests) that are mapped as one file.
LIST_BYTES = 32_000_000
JUDGED = "page_id long, host string, path string, rule string, verdict string"
RULE, ADDRESS = 0, 1
DOT = ord(".")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class SortedDigests:
    """Strings by their digest: ``find`` gives the meaning stored with a string, or none.

    The parts lie one after the other in a buffer: the number of entries, digests, ends of the
    strings, meanings, strings.
    """

    def __init__(self, buffer: np.ndarray):
        n = int(buffer[:8].view(np.uint64)[0])
        self.digests = buffer[8 : 8 + 8 * n].view(np.uint64)
        self.ends = buffer[8 + 8 * n : 8 + 16 * n].view(np.int64)
        self.meanings = buffer[8 + 16 * n : 8 + 24 * n].view(np.int64)
        self.strings = buffer[8 + 24 * n :]

    @staticmethod
    def pack(entries: list[tuple[int, bytes, int]], digest=xxhash.xxh64_intdigest) -> bytes:
        """The buffer for entries (kind, string, meaning)."""
        digests = np.array([digest(text, seed=kind) for kind, text, _ in entries], np.uint64)
        order = np.argsort(digests, kind="stable")
        texts = [bytes([entries[i][0]]) + entries[i][1] for i in order]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        meanings = np.array([entries[i][2] for i in order], np.int64)
        return b"".join([np.uint64(len(texts)).tobytes(), digests[order].tobytes(), ends.tobytes(), meanings.tobytes(), *texts])

    @classmethod
    def mapped(cls, path: str) -> SortedDigests:
        return cls(np.memmap(path, np.uint8, "r"))

    def string(self, at: int) -> bytes:
        return self.strings[self.ends[at - 1] if at else 0 : self.ends[at]].tobytes()

    def find(self, kind: int, texts: list, digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """Per string the place of its entry, -1 if it has none."""
        found = np.full(len(texts), -1)
        if not len(texts) or not len(self.digests):
            return found
        wanted = np.fromiter((digest(t, seed=kind) for t in texts), np.uint64, len(texts))
        place = np.searchsorted(self.digests, wanted)
        look = np.flatnonzero(place < len(self.digests))
        while len(look):
            look = look[self.digests[place[look]] == wanted[look]]
            same = np.array([self.string(place[i]) == bytes([kind]) + bytes(texts[i]) for i in look], bool)
            found[look[same]] = place[look[same]]
            look = look[~same] if len(look) else look
            place[look] += 1
            look = look[place[look] < len(self.digests)]
        return found


class Rules:
    """Rules from the weakest to the strongest, and the shapes (labels of the host, bytes of the path) they have."""

    def __init__(self, rules):
        self.rules = sorted(rules, key=lambda r: (len(r[0]), len(r[0].split("/", 1)[0])))
        names = [r for r, _ in self.rules]
        if len(set(names)) < len(names) or any(v not in ("allow", "block") for _, v in self.rules):
            raise ValueError("rules are distinct and allow or block")
        if any(r.startswith("/") or not r for r in names):
            raise ValueError("a rule begins with a host")
        self.shapes: dict[int, set[int]] = {}
        for name in names:
            host, path = re.fullmatch(r"(?s)([^/]*)(.*)", name).groups()
            self.shapes.setdefault(host.count("."), set()).add(len(path.encode()))

    def entries(self) -> list[tuple[int, bytes, int]]:
        return [(RULE, name.encode(), at) for at, (name, _) in enumerate(self.rules)]

    def candidates(self, address: bytes, host_bytes: int):
        """The parts of an address that could be a rule that fits it."""
        starts = [0] if host_bytes else []
        starts += [i + 1 for i in range(host_bytes) if address[i] == DOT]
        for dots, start in enumerate(reversed(starts)):
            for length in self.shapes.get(dots, ()):
                if host_bytes + length <= len(address):
                    yield address[start : host_bytes + length]


def _judge(rules: Rules, name: str, batches):
    """Verdicts by rule and by list for (page_id, host, path) batches, with the mapped array."""
    array = SortedDigests.mapped(SparkFiles.get(name))
    for batch in batches:
        hosts = [h.encode() for h in batch.column(1).to_pylist()]
        addresses = [h + p.encode() for h, p in zip(hosts, batch.column(2).to_pylist(), strict=True)]
        parts = [list(rules.candidates(a, len(h))) for h, a in zip(hosts, addresses, strict=True)]
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        places = array.find(RULE, [text for part in parts for text in part])
        best = np.full(len(parts), -1)
        hit = places >= 0
        np.maximum.at(best, of[hit], array.meanings[places[hit]])
        listed = np.zeros(len(parts), bool)
        open_rows = np.flatnonzero((best < 0) & np.array([len(h) > 0 for h in hosts], bool))
        listed[open_rows] = array.find(ADDRESS, [addresses[i] for i in open_rows]) >= 0
        names = [rules.rules[b][0] if b >= 0 else None for b in best]
        verdicts = [rules.rules[b][1] if b >= 0 else "block" if on else "allow" for b, on in zip(best, listed, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(names, pa.string()), pa.array(verdicts, pa.string())], schema=arrow_schema(JUDGED)
        )


def _search_part(key, pages: pa.Table, listed: pa.Table) -> pa.Table:
    """The addresses of one part that its list has."""
    array = SortedDigests(
        np.frombuffer(SortedDigests.pack([(ADDRESS, a.encode(), 0) for a in listed.column("address").to_pylist()]), np.uint8)
    )
    wanted = pages.column("address").to_pylist()
    found = array.find(ADDRESS, [a.encode() for a in wanted]) >= 0
    return pa.table({"address": pa.array([a for a, f in zip(wanted, found, strict=True) if f], pa.string())})


def hand_out(spark: SparkSession, data: bytes) -> str:
    """Write a file of bounded size to the shared folder and have Spark copy it to every executor."""
    name = f"url-digests-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_dir(spark)}/{name}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(store.makeQualified(path).toString())
    return name


def judge_urls(
    pages: DataFrame, listed: DataFrame | None = None, rules=RULES,
    id_col: str = "page_id", url_col: str = "url", list_bytes: int = LIST_BYTES,
) -> DataFrame:
    """One row per page: page_id, host, path, rule (null where none fits), verdict.

    ``listed`` has one column ``address``; null, repeated and hostless addresses in it do no harm.
    """
    spark = pages.sparkSession
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = Rules(rules)
    entries = known.entries()
    found = None
    if listed is not None:
        listed = staged(listed.select("address").dropna().distinct(), "url-list")
        size = listed.agg(F.sum(F.octet_length("address") + 25)).first()[0] or 0
        if size <= list_bytes:
            entries += [(ADDRESS, r["address"].encode(), 0) for r in listed.toLocalIterator()]
        else:
            found = _found_in_parts(rows, listed, list_bytes)
    name = hand_out(spark, SortedDigests.pack(entries))
    judged = rows.mapInArrow(partial(_judge, known, name), JUDGED)
    if found is None:
        return judged
    joined = judged.withColumn("address", F.concat("host", "path")).join(found.withColumn("on_list", F.lit(True)), "address", "left")
    blocked = F.col("rule").isNull() & (F.col("host") != "") & F.coalesce("on_list", F.lit(False))
    return joined.select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise(F.col("verdict")).alias("verdict"))


def _found_in_parts(rows: DataFrame, listed: DataFrame, list_bytes: int) -> DataFrame:
    """The distinct addresses of the pages that stand on the list, searched part by part."""
    wanted = staged(rows.select(F.concat("host", "path").alias("address")).distinct(), "url-addresses")
    sizes = [df.agg(F.sum(F.octet_length("address") + 25)).first()[0] or 0 for df in (wanted, listed)]
    parts = max(sizes) // list_bytes + 1
    dealt = [df.withColumn("part", F.pmod(F.xxhash64("address"), F.lit(parts))).groupBy("part") for df in (wanted, listed)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(_search_part, "address string")


def listing_addresses(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Addresses that stand on two or more pages: pages of lists and feeds, which only their query tells apart."""
    url = pages[url_col].cast("string")
    addresses = pages.select(F.concat(host_of(url), path_of(url)).alias("address"), host_of(url).alias("host")).where("host <> ''")
    return addresses.groupBy("address").count().where("count > 1").select("address")
