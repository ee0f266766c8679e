"""Exact quantiles of many columns in at most two scans behind a sketch.

``percentile`` keeps all distinct values of a column in one task. Here a quantile sketch
of every column, merged from all tasks, brackets each wanted rank between two values.
One scan counts what lies below and up to each bracket, which proves or refutes it; a
second one counts only the values inside, a few thousandths of the rows, before any
shuffle. Brackets of one value need no second scan. A refuted bracket is replaced by the
side of it that holds the rank, so results are exact whatever the sketch says.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scale import cut_lineage

# Size of a sketch, and the rank error its brackets allow for: over three times the
# error it keeps with 99 % certainty.
SKETCH_SIZE = 8192
RANK_ERROR = 0.0012
# A bracket with more rows is divided into this many slices before it is ordered.
FEW_ROWS = 1_000_000
SLICES = 1024
# Values beyond this are put at the ends, so that slice widths stay finite.
LARGEST = 8e307


@dataclass(frozen=True)
class Facts:
    """Count, minimum and maximum of a column of numbers, and its sketch where it is known."""

    count: int
    low: float | None
    high: float | None
    sketch: bytes | None = None


@dataclass
class _Bracket:
    """Two values of a column, the rows below the first, and the wanted ranks between them."""

    column: int
    low: float
    high: float
    ranks: list[int]
    below: int = 0
    rows: int = 0


def sketch(v: Column) -> Column:
    """Aggregate: the quantile sketch of ``v``, for callers that scan the column anyway."""
    return F.kll_sketch_agg_double(v, F.lit(SKETCH_SIZE))


def number_facts(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, Facts]:
    """Facts of several columns in one aggregation."""
    names = list(columns)
    if not names:
        return {}
    aggs = []
    for i, n in enumerate(names):
        c = columns[n].cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), sketch(c).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {n: Facts(row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], row[f"s{i}"]) for i, n in enumerate(names)}


def quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float],
    facts: Mapping[str, Facts] | None = None,
    few_rows: int = FEW_ROWS,
    rank_error: float = RANK_ERROR,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of double expressions; None without numbers.

    ``facts`` saves a pass when they are known already. ``few_rows`` bounds the values
    that one task orders, ``rank_error`` the width of the brackets; neither changes a result.
    """
    names = list(columns)
    if not names:
        return {}
    if facts is None:
        facts = number_facts(df, columns)
    narrow = df.select(*[columns[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])

    places = {}
    wanted: dict[int, set[int]] = {}
    found: dict[tuple[int, int], float] = {}
    for i, n in enumerate(names):
        count = facts[n].count
        for j, p in enumerate(probabilities if count else ()):
            at = p * (count - 1)
            places[i, j] = (math.floor(at) + 1, math.ceil(at) + 1, at - math.floor(at))
            for rank in places[i, j][:2]:
                # The ends are known, and so is a column of one value.
                if rank == 1 or facts[n].low == facts[n].high:
                    found[i, rank] = facts[n].low
                elif rank == count:
                    found[i, rank] = facts[n].high
                else:
                    wanted.setdefault(i, set()).add(rank)
    if wanted:
        known = {i: facts[names[i]] for i in wanted}
        brackets = _checked(narrow, _bracketed(narrow, known, wanted, rank_error), known)
        open_ones = []
        for b in brackets:
            if b.low == b.high:
                found.update({(b.column, rank): b.low for rank in b.ranks})
            else:
                open_ones.append(b)
        if open_ones:
            found.update(_read_off(narrow, open_ones, few_rows))

    result: dict[str, list[float | None]] = {}
    for i, n in enumerate(names):
        values: list[float | None] = []
        for j in range(len(probabilities)):
            if (i, j) not in places:
                values.append(None)
                continue
            low_rank, high_rank, part = places[i, j]
            low, high = found[i, low_rank], found[i, high_rank]
            values.append(low if low == high else low + (high - low) * part)
        result[n] = values
    return result


def _bracketed(
    narrow: DataFrame, facts: Mapping[int, Facts], wanted: Mapping[int, set[int]], rank_error: float
) -> list[_Bracket]:
    """Brackets of the wanted ranks, neighbours together, from the sketches."""
    missing = [i for i in wanted if facts[i].sketch is None]
    held = {i: facts[i].sketch for i in wanted}
    if missing:
        row = narrow.agg(*[sketch(F.col(f"v{i}")).alias(f"s{i}") for i in missing]).first()
        held.update({i: row[f"s{i}"] for i in missing})
    brackets: list[_Bracket] = []
    asked: list[Column] = []
    for i, ranks in wanted.items():
        groups: list[list[int]] = []
        for rank in sorted(ranks):
            if groups and rank == groups[-1][-1] + 1:
                groups[-1].append(rank)
            else:
                groups.append([rank])
        for group in groups:
            low = min(max((group[0] - 1) / facts[i].count - rank_error, 0.0), 1.0)
            high = max(min(group[-1] / facts[i].count + rank_error, 1.0), low)
            brackets.append(_Bracket(i, 0.0, 0.0, group))
            ends = F.array(F.lit(low), F.lit(high))
            asked.append(F.kll_sketch_get_quantile_double(F.col(f"s{i}"), ends).alias(f"q{len(asked)}"))
    schema = ", ".join(f"s{i} binary" for i in held)
    row = narrow.sparkSession.createDataFrame([tuple(bytes(x) for x in held.values())], schema).select(*asked).first()
    for b, (low, high) in zip(brackets, row):
        b.low, b.high = low, high
    return brackets


def _layers(brackets: Sequence[_Bracket]) -> list[list[int]]:
    """Positions of brackets in lists of one column whose members do not overlap, in ascending order."""
    layers: list[list[int]] = []
    for k in sorted(range(len(brackets)), key=lambda k: (brackets[k].column, brackets[k].low)):
        for layer in layers:
            last = brackets[layer[-1]]
            if last.column == brackets[k].column and last.high < brackets[k].low:
                layer.append(k)
                break
        else:
            layers.append([k])
    return layers


def _each(narrow: DataFrame, brackets: Sequence[_Bracket], part: Callable[[DataFrame, list[int]], DataFrame]) -> DataFrame:
    """``part`` of every layer, one below the other: each reads its one column, all in one job."""
    parts = [part(narrow.selectExpr(f"v{brackets[layer[0]].column} AS v"), layer) for layer in _layers(brackets)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


def _literal(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _checked(narrow: DataFrame, brackets: list[_Bracket], facts: Mapping[int, Facts]) -> list[_Bracket]:
    """Brackets with exact counts; a rank that a bracket misses gets the side that holds it."""
    spots: dict[int, tuple[int, int]] = {}

    def segments(values: DataFrame, layer: list[int]) -> DataFrame:
        """Values below the first bracket, in it, between it and the second one, and so on."""
        cases = []
        for at, k in enumerate(layer):
            spots[k] = (layer[0], at)
            cases.append(f"WHEN v < {_literal(brackets[k].low)} THEN {2 * at} WHEN v <= {_literal(brackets[k].high)} THEN {2 * at + 1}")
        segment = f"CASE {' '.join(cases)} ELSE {2 * len(layer)} END AS segment"
        return values.where("v IS NOT NULL").selectExpr(f"{layer[0]} AS layer", segment).groupBy("layer", "segment").count()

    counts = {(r["layer"], r["segment"]): r["count"] for r in _each(narrow, brackets, segments).collect()}
    out: list[_Bracket] = []
    for k, b in enumerate(brackets):
        layer, at = spots[k]
        below = sum(counts.get((layer, s), 0) for s in range(2 * at + 1))
        upto, count = below + counts.get((layer, 2 * at + 1), 0), facts[b.column].count
        sides = [
            _Bracket(b.column, facts[b.column].low, math.nextafter(b.low, -math.inf), [], 0, below),
            _Bracket(b.column, b.low, b.high, [], below, upto - below),
            _Bracket(b.column, math.nextafter(b.high, math.inf), facts[b.column].high, [], upto, count - upto),
        ]
        for side in sides:
            side.ranks = [r for r in b.ranks if side.below < r <= side.below + side.rows]
            if side.ranks:
                out.append(side)
    return out


def _inside(b: _Bracket) -> str:
    return f"v BETWEEN {_literal(b.low)} AND {_literal(b.high)}"


def _read_off(narrow: DataFrame, brackets: Sequence[_Bracket], few_rows: int) -> dict[tuple[int, int], float]:
    """Values at the wanted ranks, from one scan that counts the values inside the brackets."""
    def held(values: DataFrame, layer: list[int]) -> DataFrame:
        cases = " ".join(f"WHEN {_inside(brackets[k])} THEN {k}" for k in layer)
        return values.where(" OR ".join(_inside(brackets[k]) for k in layer)).selectExpr(f"CASE {cases} END AS k", "v")

    counted = _each(narrow, brackets, held).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    if any(b.rows > few_rows for b in brackets):
        counted = cut_lineage(counted)
    found: dict[tuple[int, int], float] = {}
    left = list(enumerate(brackets))
    while left:
        wide = [(k, b) for k, b in left if b.rows > few_rows and b.low < b.high and _width(b) > 0]
        few = [(k, b) for k, b in left if (k, b) not in wide]
        if few:
            found.update(_ordered(counted, few))
        left = _sliced(counted, wide) if wide else []
    return found


def _chosen(counted: DataFrame, brackets: Sequence[tuple[int, _Bracket]], mark: Callable[[int, _Bracket], str]) -> DataFrame:
    """The counted values of some brackets, with ``mark`` of the one that holds a value.

    Brackets of one ``k`` do not overlap.
    """
    cases = " ".join(f"WHEN k = {k} AND {_inside(b)} THEN {mark(at, b)}" for at, (k, b) in enumerate(brackets))
    return counted.withColumn("at", F.expr(f"CASE {cases} END")).where("at IS NOT NULL")


def _ordered(counted: DataFrame, brackets: Sequence[tuple[int, _Bracket]]) -> dict[tuple[int, int], float]:
    """Values at the wanted ranks of brackets that hold few rows."""
    chosen = _chosen(counted, brackets, lambda at, b: str(at))
    running = chosen.withColumn("upto", F.sum("n").over(Window.partitionBy("at").orderBy("v")))
    hits = []
    for at, (_, b) in enumerate(brackets):
        here = " OR ".join(f"upto >= {r - b.below} AND upto - n < {r - b.below}" for r in b.ranks)
        hits.append(f"WHEN {at} THEN {here}")
    found: dict[tuple[int, int], float] = {}
    # At most one row per wanted rank.
    for row in running.where(f"CASE at {' '.join(hits)} END").collect():
        _, b = brackets[row["at"]]
        for rank in b.ranks:
            if row["upto"] - row["n"] < rank - b.below <= row["upto"]:
                found[b.column, rank] = row["v"]
    return found


def _sliced(counted: DataFrame, brackets: Sequence[tuple[int, _Bracket]]) -> list[tuple[int, _Bracket]]:
    """The slices that hold the wanted ranks. Collects at most SLICES rows a bracket."""
    chosen = _chosen(counted, brackets, lambda at, b: f"{at * SLICES} + {_slice(b)}")
    sums = chosen.groupBy("at").agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    by_bracket: dict[int, list] = {}
    for row in sorted(sums.collect(), key=lambda x: x["at"]):
        by_bracket.setdefault(row["at"] // SLICES, []).append(row)
    out: list[tuple[int, _Bracket]] = []
    for at, (k, b) in enumerate(brackets):
        below = b.below
        for row in by_bracket[at]:
            ranks = [r for r in b.ranks if below < r <= below + row["n"]]
            if ranks:
                out.append((k, _Bracket(b.column, row["low"], row["high"], ranks, below, row["n"])))
            below += row["n"]
    return out


def _clamped(x: float) -> float:
    return max(-LARGEST, min(LARGEST, x))


def _width(b: _Bracket) -> float:
    return (_clamped(b.high) - _clamped(b.low)) / SLICES


def _slice(b: _Bracket) -> str:
    """Slice of a value; never falls as the value rises."""
    bounded = f"greatest({_literal(-LARGEST)}, least({_literal(LARGEST)}, v))"
    index = f"floor(({bounded} - {_literal(_clamped(b.low))}) / {_literal(_width(b))})"
    return f"CAST(greatest(0, least({SLICES - 1}, {index})) AS INT)"
