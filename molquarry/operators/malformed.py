"""Separating rows that fail to parse from a table of delimited lines, with the reason."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.functions.smiles import parse
from molquarry.session import spread

#: A sound line of two fields; quotes stand around whole fields only.
_SOUND = re.compile(r'(?:"((?:[^"]|"")*)"|([^",]*)),(?:"((?:[^"]|"")*)"|([^",]*))\Z')
_NUMBER = re.compile(r"[ \t]*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[ \t]*\Z", re.A)

_START, _BARE, _QUOTED, _CLOSED = range(4)


def _cheapest(line: str, joined: bool) -> tuple[tuple[int, int], list[str]]:
    """(cost, edits) by dynamic programming over the characters.

    States are the place within a field (its start, bare text, quoted text, after a closing quote) and
    whether the first delimiter has passed. Inserting or deleting a quote costs (1, 0), a delimiter (0, 1).
    With ``joined`` a deleted delimiter joins its fields, costs compare by their sum and the edits make the
    line sound; without, it still ends a field, and costs compare quotes first.
    """
    rank = (lambda c: (c[0] + c[1], c[0])) if joined else (lambda c: c)
    best = {(_START, 1): ((0, 0), None)}

    def put(to, key, cost, trail):
        if key not in to or rank(cost) < rank(to[key][0]):
            to[key] = (cost, trail)

    for i, c in enumerate(line):
        # a quote inserted before this character
        for (s, f), (cost, trail) in list(best.items()):
            to = {_START: _QUOTED, _QUOTED: _CLOSED, _CLOSED: _QUOTED}.get(s)
            if to is not None:
                put(best, (to, f), (cost[0] + 1, cost[1]), (trail, "insert quote", i))
        step: dict = {}
        for (s, f), (cost, trail) in best.items():
            if c == '"':
                if s in (_START, _CLOSED):
                    put(step, (_QUOTED, f), cost, trail)
                elif s == _QUOTED:
                    put(step, (_CLOSED, f), cost, trail)
                put(step, (s, f), (cost[0] + 1, cost[1]), (trail, "delete quote", i))
            elif c == "," and s != _QUOTED:
                if f == 1:
                    put(step, (_START, 2), cost, trail)
                if f == 2 or joined:
                    put(step, (s if joined else _START, f), (cost[0], cost[1] + 1), (trail, "delete delimiter", i))
            elif s == _QUOTED:
                put(step, (s, f), cost, trail)
            elif s != _CLOSED:
                put(step, (_BARE, f), cost, trail)
        best = step
    ends: dict = {}
    for (s, f), (c, t) in best.items():
        if s == _QUOTED:
            c, t = (c[0] + 1, c[1]), (t, "insert quote", len(line))
        if f == 1:
            c, t = (c[0], c[1] + 1), (t, "insert delimiter", len(line))
        put(ends, 0, c, t)
    cost, trail = ends[0]
    edits = []
    while trail is not None:
        trail, what, at = trail
        edits.append(f"{what} at {at}")
    return cost, edits[::-1]


def error_parse(line: str) -> tuple[int, int, list[str]]:
    """(quote edits, delimiter edits, repair) of a line meant to have two fields.

    The two numbers compare quotes first, with every delimiter ending a field: delimiters are at fault only
    in so far as sound quoting leaves a wrong number of fields. The repair is the cheapest list of edits
    after which the line is sound.
    """
    (quotes, delimiters), _ = _cheapest(line, joined=False)
    return quotes, delimiters, _cheapest(line, joined=True)[1] if quotes or delimiters else []


def judge(line: str | None, low: float, high: float) -> tuple[str | None, float | None, str | None, str | None]:
    """(smiles, value, reason, edits) of one line; reason is None for a valid one."""
    line = "" if line is None else line
    if line.endswith("\r"):
        line = line[:-1]
    m = _SOUND.match(line)
    if m is None:
        quotes, delimiters, edits = error_parse(line)
        return None, None, "quoting" if quotes else "columns", "; ".join(edits)
    smiles = m.group(2) if m.group(1) is None else m.group(1).replace('""', '"')
    value = m.group(4) if m.group(3) is None else m.group(3).replace('""', '"')
    if parse(smiles) is None:
        return None, None, "smiles", None
    if not value.strip(" \t"):
        return smiles, None, None, None
    if not _NUMBER.match(value) or not low <= float(value) <= high:
        return None, None, "expt", None
    return smiles, float(value), None, None


def parse_lines(lines: DataFrame, id_col: str = "line_id", line_col: str = "line", low: float = -50.0, high: float = 50.0) -> DataFrame:
    """Each line as (id, smiles, expt, reason, edits): valid rows have no reason.

    Every line is parsed at least cost: a line that needs no edit and whose fields have valid types
    loads; otherwise the edits, or the field that has no valid type, state the reason, the first of
    ``quoting``, ``columns``, ``smiles``, ``expt``. One pass without shuffle.

    A null line counts as an empty one (``columns``). An empty value is a missing one. Repeated lines
    are judged alike, each on its own; an empty table gives an empty result; other columns of the
    input, whatever their names, are not read.
    """
    kind = dict(lines.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [judge(x if isinstance(x, str) else None, low, high) for x in pdf["line"]]
            got = pd.DataFrame(out, columns=["smiles", "expt", "reason", "edits"], dtype=object)
            got["expt"] = got["expt"].astype(float).astype(object).where(got["expt"].notna(), None)
            got.insert(0, "line_id", pdf["line_id"].to_numpy())
            yield got

    src = spread(lines.select(F.col(id_col).alias("line_id"), F.col(line_col).alias("line")))
    return src.mapInPandas(run, f"line_id {kind}, smiles string, expt double, reason string, edits string")


def rejected(parsed: DataFrame) -> DataFrame:
    """The rejected lines (line_id, reason)."""
    return parsed.filter("reason is not null").select("line_id", "reason")


def loaded(parsed: DataFrame) -> DataFrame:
    """The valid rows (line_id, smiles, expt)."""
    return parsed.filter("reason is null").select("line_id", "smiles", "expt")


def report(parsed: DataFrame) -> DataFrame:
    """Lines by reason; valid ones under ``valid``."""
    return parsed.groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
