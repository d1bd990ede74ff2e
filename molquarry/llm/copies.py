"""Problem 4: duplicates hidden by formatting differences.

Recursive radix partitioning on canonical bytes: buckets are byte prefixes; a bucket holding too many
different strings is split by further bytes until each fits, and each bucket is then counted in a trie
whose nodes carry terminal counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.functions.smiles import canonical_text
from molquarry.operators.skew import attach_heads
from molquarry.session import materialise, spread

#: Bytes of the first prefix, and those by which an oversized bucket is split further; these double with
#: each level, so that long common prefixes take few levels.
STRIDE = 2
#: Bytes of one trie edge.
EDGE = 8


def canonical_rows(rows: DataFrame, scope: str, row_id: str, text: str) -> DataFrame:
    """(scope, id, canon, text) of the rows that have a canonical string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = {s: canonical_text(s) for s in pdf["text"].unique() if isinstance(s, str)}
            pdf["canon"] = pdf["text"].map(known)
            yield pdf[pdf["canon"].notna()][["scope", "id", "canon"]]

    kind = dict(rows.dtypes)[row_id]
    src = rows.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(
        F.col(scope).alias("scope"), F.col(row_id).alias("id"), F.col(text).alias("text")
    )
    return spread(src).mapInPandas(run, f"scope string, id {kind}, canon string")


def radix_buckets(partial: DataFrame, capacity: int) -> DataFrame:
    """``partial`` with its bucket: a prefix short enough to be shared and long enough to fit.

    A prefix is oversized if it holds more than ``capacity`` partial rows of different strings, so at most
    rows / capacity prefixes are carried to the next level, and only these are broadcast. Only rows of
    oversized buckets are written again for it. It ends when every bucket fits or holds one string.
    """
    data = partial.withColumn("bytes", F.encode("canon", "utf-8"))
    open_, done = data.withColumn("bucket", F.concat_ws("|", "scope", F.hex(F.substring("bytes", 1, STRIDE)))), None
    depth, stride = STRIDE, STRIDE
    large = _oversized(open_, capacity)
    while large:
        marks = F.broadcast(open_.sparkSession.createDataFrame([(b,) for b in large], "bucket string").withColumn("split", F.lit(True)))
        marked = open_.join(marks, "bucket", "left")
        fits = marked.filter("split is null").drop("split")
        done = fits if done is None else done.unionByName(fits)
        finer = F.concat("bucket", F.hex(F.substring("bytes", depth + 1, stride)))
        open_ = materialise(marked.filter("split").withColumn("bucket", finer).drop("split"), "copies-oversized")
        large = _oversized(open_.filter(F.length("bytes") > depth), capacity)
        depth, stride = depth + stride, 2 * stride
    return (open_ if done is None else done.unionByName(open_)).drop("bytes")


def _oversized(data: DataFrame, capacity: int) -> list[str]:
    """Buckets over capacity that hold more than one string; at most rows / capacity of them."""
    many = data.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    return [r[0] for r in many.filter((F.col("n") > capacity) & (F.col("lo") != F.col("hi"))).select("bucket").collect()]


class CountingTrie:
    """A trie over byte strings with edges of EDGE bytes; terminals hold (copies, smallest id)."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, n: int, first) -> None:
        node = self.root
        for i in range(0, len(key), EDGE):
            node = node.setdefault(key[i : i + EDGE], {})
        end = node.get(None)
        node[None] = (n, first) if end is None else (end[0] + n, min(end[1], first))

    def items(self) -> Iterator[tuple[bytes, int, object]]:
        todo = [(b"", self.root)]
        while todo:
            prefix, node = todo.pop()
            for edge, child in node.items():
                if edge is None:
                    yield prefix, child[0], child[1]
                else:
                    todo.append((prefix + edge, child))


def collapse(canon: DataFrame, capacity: int = 100_000) -> DataFrame:
    """One record for each string: (scope, canon, copies, first_id).

    ``canon`` has (scope, id, canon), as from ``canonical_rows``. Copies are counted in each batch
    before anything is shuffled, so a string that holds a third of all rows sends one partial row a
    batch. Buckets go to tasks by hash and come there one after the other, so that a
    task holds one trie, and a bucket of one string never needs more than its one terminal.
    """
    kind = dict(canon.dtypes)["id"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.groupby(["scope", "canon"], sort=False)["id"].agg(n="size", first="min").reset_index()

    def counted(scope: str, trie: CountingTrie) -> Iterator[pd.DataFrame]:
        got = [(scope, k.decode(), n, first) for k, n, first in trie.items()]
        for at in range(0, len(got), 50_000):
            yield pd.DataFrame(got[at : at + 50_000], columns=["scope", "canon", "copies", "first_id"])

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, of, trie = None, None, CountingTrie()
        for pdf in pdfs:
            for scope, text, n, first, bucket in zip(pdf["scope"], pdf["canon"], pdf["n"], pdf["first"], pdf["bucket"]):
                if bucket != at:
                    yield from counted(of, trie)
                    at, of, trie = bucket, scope, CountingTrie()
                trie.add(text.encode(), n, first)
        yield from counted(of, trie)

    part = materialise(canon.mapInPandas(partial, f"scope string, canon string, n long, first {kind}"), "copies-partial")
    bucketed = radix_buckets(part, capacity)
    return bucketed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(count, f"scope string, canon string, copies long, first_id {kind}")


def copies(canon: DataFrame, groups: DataFrame) -> DataFrame:
    """(first_id, copy_id): each row that is a copy of another of its scope, but the first of its set."""
    heads = groups.filter("copies > 1").select("scope", "canon", "copies", "first_id")
    joined = attach_heads(canon, heads, ["scope", "canon"], "copies")
    return joined.filter(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id"))


def collapse_formatting(rows: DataFrame, scope: str, row_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(records, copies) of a table of SMILES within each ``scope``.

    Strings are copies if they are equal without white space, invisible signs, punctuation around them,
    letter case where only one reading is a valid element, and the order of dot-separated parts.
    Null, empty and blank strings are in no set. Exact repeats count as copies. Rows that share an id
    (repeated rows) add to the counts; copies() lists those with another id than the first. Any length
    of string is used in full, and other columns of ``rows`` aren't read. An empty table gives empty
    results.
    """
    canon = materialise(canonical_rows(rows, scope, row_id, text), "copies-canon")
    groups = materialise(collapse(canon), "copies-groups")
    return groups, copies(canon, groups)
