"""Terms of a text, and a burst trie that counts them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import staged

TERM = re.compile(r"[a-z0-9]{2,}")
#: Distinct terms that a container holds before it bursts into one container for each next character.
CAPACITY = 2048
#: Longest routing prefix; prefixes are as long as the terms need.
DEPTH = 64
#: Most routes that the driver gathers to align the tries of different workers. If there are more, terms are merged one by one.
ROUTES = 200_000
#: Distinct terms a worker holds before it hands its trie on and begins another.
HELD = 400_000

TRIE_SCHEMA = "route string, suffixes array<string>, occurrences array<long>, records array<long>"


def terms_of(text: str) -> list[str]:
    """The terms of a text: runs of at least two of a-z and 0-9 after lower-casing."""
    return TERM.findall(text.lower())


class BurstTrie:
    """Counters of terms, kept in containers that are reached by a prefix and burst when they grow full."""

    def __init__(self, capacity: int = CAPACITY, depth: int = DEPTH):
        self.capacity, self.depth = capacity, depth
        self.root: dict = {}
        self.leaf = True
        self.size = 0

    def add_all(self, occurrences: dict[str, int], records: dict[str, int]) -> None:
        for term, n in occurrences.items():
            self.add(term, n, records[term])

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self, 0
        while not node.leaf:
            step = term[at : at + 1]
            child = node.root.get(step)
            if child is None:
                child = node.root[step] = BurstTrie(self.capacity, self.depth)
            if not step:
                node = child
                break
            node, at = child, at + 1
        entry = node.root.get(term[at:])
        if entry is None:
            node.root[term[at:]] = [occurrences, records]
            self.size += 1
            if len(node.root) > node.capacity and at < node.depth:
                node._burst()
        else:
            entry[0] += occurrences
            entry[1] += records

    def _burst(self) -> None:
        entries, self.root, self.leaf = self.root, {}, False
        for suffix, entry in entries.items():
            child = self.root.get(suffix[:1])
            if child is None:
                child = self.root[suffix[:1]] = BurstTrie(self.capacity, self.depth)
            child.root[suffix[1:]] = entry

    def containers(self, prefix: str = "") -> Iterator[tuple[str, dict]]:
        if self.leaf:
            if self.root:
                yield prefix, self.root
        else:
            for step, child in self.root.items():
                yield from child.containers(prefix + step)


def _subtrees(trie: BurstTrie, total: int | None) -> pa.RecordBatch:
    routes, suffixes, occ, rec = [], [], [], []
    for route, entries in trie.containers():
        keys = sorted(entries)
        routes.append(route)
        suffixes.append(keys)
        occ.append([entries[k][0] for k in keys])
        rec.append([entries[k][1] for k in keys])
    if total is not None:
        routes.append(None)
        suffixes.append([])
        occ.append([])
        rec.append([total])
    return pa.RecordBatch.from_arrays(
        [pa.array(routes, pa.string()), pa.array(suffixes, pa.list_(pa.string())), pa.array(occ, pa.list_(pa.int64())), pa.array(rec, pa.list_(pa.int64()))],
        names=["route", "suffixes", "occurrences", "records"],
    )


def _texts(capacity: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = BurstTrie(capacity, depth), 0
        for batch in batches:
            occurrences: Counter = Counter()
            records: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text and (terms := TERM.findall(text.lower())):
                    total += 1
                    occurrences.update(terms)
                    records.update(set(terms))
            trie.add_all(occurrences, records)
            if trie.size > HELD:
                yield _subtrees(trie, None)
                trie = BurstTrie(capacity, depth)
        yield _subtrees(trie, total)

    return run


def _counted(capacity: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(capacity, depth)
        for batch in batches:
            occurrences: Counter = Counter()
            records: Counter = Counter()
            for term, n, r in zip(*(c.to_pylist() for c in batch.columns)):
                occurrences[term] += n
                records[term] += r
            trie.add_all(occurrences, records)
            if trie.size > HELD:
                yield _subtrees(trie, None)
                trie = BurstTrie(capacity, depth)
        yield _subtrees(trie, None)

    return run


def _split(shared):
    """Moves the entries of a container down to where some worker's trie had burst, so that equal subtrees meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = shared.value
        for batch in batches:
            out: dict[str, list] = {}
            for route, suffixes, occ, rec in zip(*(c.to_pylist() for c in batch.columns)):
                if route not in inner:
                    part = out.setdefault(route, [[], [], []])
                    part[0] += suffixes
                    part[1] += occ
                    part[2] += rec
                    continue
                for suffix, o, r in zip(suffixes, occ, rec):
                    to, rest = route, suffix
                    while to in inner and rest:
                        to, rest = to + rest[0], rest[1:]
                    part = out.setdefault(to, [[], [], []])
                    part[0].append(rest)
                    part[1].append(o)
                    part[2].append(r)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(out), pa.string()),
                    pa.array([p[0] for p in out.values()], pa.list_(pa.string())),
                    pa.array([p[1] for p in out.values()], pa.list_(pa.int64())),
                    pa.array([p[2] for p in out.values()], pa.list_(pa.int64())),
                ],
                names=["route", "suffixes", "occurrences", "records"],
            )

    return run


def trie_counts(
    df: DataFrame, text: str | None = None, term: str | None = None, n: str | None = None, r: str | None = None, capacity: int = CAPACITY, depth: int = DEPTH, limit: int = ROUTES
) -> tuple[DataFrame, int | None]:
    """Occurrences and records of every distinct term, and the number of records that have a term.

    Either `text` names a column with one text for each record, or `term`, `n` and `r` name a term, occurrences of it and
    the records that these are of (the number of all records is then None). Null texts and terms are ignored; an empty
    table gives no rows and 0.

    Every worker counts into a burst trie: adaptive prefixes lead to containers of suffixes, and a container that grows
    past `capacity` bursts. Containers are sent as one row each. Where one worker's trie had burst and another's had not,
    the entries of the second are first moved down, so that matching subtrees have equal routes; these are then merged by
    route. As containers burst wherever terms crowd, no route holds much more than others. The driver gathers at most `limit`
    routes for this, one for about a thousand distinct terms; if there are more, the entries are merged by whole terms.
    """
    if text is not None:
        local = df.select(text).mapInArrow(_texts(capacity, depth), TRIE_SCHEMA)
    else:
        local = df.filter(F.col(term).isNotNull()).select(term, F.col(n).cast("long"), F.col(r).cast("long")).mapInArrow(_counted(capacity, depth), TRIE_SCHEMA)
    local = staged(local, "trie")
    total = local.filter("route is null").agg(F.sum(F.element_at("records", 1))).first()[0] or 0 if text is not None else None
    tries = local.filter("route is not null")
    entry = F.explode(F.arrays_zip("suffixes", "occurrences", "records")).alias("e")
    sums = [F.sum("e.occurrences").alias("occurrences"), F.sum("e.records").alias("records")]
    routes = [r[0] for r in tries.select("route").distinct().limit(limit + 1).collect()]
    if len(routes) > limit:
        merged = tries.select("route", entry).groupBy(F.concat("route", "e.suffixes").alias("term")).agg(*sums)
        return merged, total
    inner = {route[:k] for route in routes for k in range(len(route))}
    if any(route in inner for route in routes):
        tries = tries.mapInArrow(_split(df.sparkSession.sparkContext.broadcast(inner)), TRIE_SCHEMA)
    merged = tries.repartition("route").select("route", entry).groupBy("route", F.col("e.suffixes").alias("suffix")).agg(*sums)
    return merged.select(F.concat("route", "suffix").alias("term"), "occurrences", "records"), total
