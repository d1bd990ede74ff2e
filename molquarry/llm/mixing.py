"""Problem 9: mixing sources to target weights.

Tokens are summed for each source, repetition rates derived, and each document is emitted
floor(rate) times plus once more with probability equal to the fraction, by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.tokens import count_tokens
from molquarry.session import materialise, spread

#: mix_targets has one row for each source; more rows than this are refused rather than broadcast.
MOST_SOURCES = 100_000


def document_tokens(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n): tokens of each document of a source with a target; each text is encoded once."""
    wanted = docs.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "source", "text")
    wanted = wanted.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    return spread(wanted).select("doc_id", "source", count_tokens(F.col("text"), path).alias("n"))


def source_tokens(counted: DataFrame) -> DataFrame:
    """(source, docs, tokens) from document_tokens(); partial sums before the shuffle."""
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, rate) for each target.

    Without ``total_tokens`` the mix is as large as it can be with every present source on target: the
    source that runs out first is used max_repeats times. A source without tokens gets rate 0, and the
    targets of the others are scaled up to sum 1. With ``total_tokens`` rates are capped at max_repeats
    and a source that runs out falls short, as report() states.
    """
    if targets.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    t = targets.select("source", "target_share", "max_repeats").join(F.broadcast(sizes), "source", "left").na.fill(0, ["docs", "tokens"])
    live = F.col("tokens") > 0
    one = t.agg(
        F.sum(F.when(live, F.col("target_share"))).alias("live_share"),
        F.min(F.when(live & (F.col("target_share") > 0), F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).alias("most"),
    )
    size = F.lit(float(total_tokens)) if total_tokens is not None else F.col("most") * F.col("live_share")
    share = F.col("target_share") / F.col("live_share")
    rate = F.when(live, F.least(F.col("max_repeats").cast("double"), share * size / F.col("tokens"))).otherwise(F.lit(0.0))
    return t.crossJoin(F.broadcast(one)).select("source", "target_share", "max_repeats", "docs", "tokens", rate.alias("rate"))


def draw(docs: DataFrame, rated: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, source, copy): copy runs from 1; deterministic by doc_id and seed. No shuffle.

    Documents of no target source, and null and empty texts, are not drawn.
    """
    d = times(docs.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "source"), rated, seed)
    return d.filter("times > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))


def times(docs: DataFrame, rated: DataFrame, seed: int) -> DataFrame:
    """``docs`` of the rated sources with ``times``: floor(rate), and one more by the hash of doc_id."""
    d = docs.join(F.broadcast(rated.select("source", "rate")), "source")
    luck = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    whole = F.floor(F.col("rate") + 1e-9)
    return d.withColumn("times", (whole + (luck < F.greatest(F.col("rate") - whole, F.lit(0.0))).cast("long")).cast("int")).drop("rate")


class Mix:
    """Documents drawn so that each source's share of all tokens meets its target.

    Null sources have no target. Repeated rows are drawn alike, as the draw hashes doc_id. An empty
    table gives an empty mix, and a report of zero shares.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, path: str | None = None, seed: int = 11):
        self.seed = seed
        self.counted = materialise(document_tokens(docs, targets, path), "mix-tokens")
        sizes = materialise(source_tokens(self.counted), "mix-sizes")
        self.rates = materialise(rates(sizes, targets, total_tokens), "mix-rates")
        self.drawn = draw(docs, self.rates, seed)

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, tokens_drawn, docs_drawn, max_copies, rate) as drawn.

        From the tokens counted for the rates; rows that share a doc_id count each by its own text.
        """
        per = times(self.counted, self.rates, self.seed).groupBy("source").agg(
            F.sum(F.col("n") * F.col("times")).alias("tokens_drawn"), F.sum("times").alias("docs_drawn"), F.max("times").alias("max_copies")
        )
        total = per.agg(F.sum("tokens_drawn").alias("all_tokens"))
        r = self.rates.join(F.broadcast(per), "source", "left").na.fill(0, ["tokens_drawn", "docs_drawn", "max_copies"]).crossJoin(F.broadcast(total))
        actual = F.coalesce(F.col("tokens_drawn") / F.expr("nullif(all_tokens, 0)"), F.lit(0.0))
        return r.select("source", "target_share", actual.alias("actual_share"), "tokens_drawn", "docs_drawn", "max_copies", "max_repeats", "rate")
