"""Headers and targets as an assignment: all targets at once, each header used at most once, at the least cost.

A header that is the best of two targets goes to one of them, and the other gets its next one. Costs are found by
column functions, a few headers for each target; only these few numbers reach the Python step that assigns them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.operators.mapping import _normal, allowed_distance, named, normal_name


def cheapest(costs: Sequence[Mapping[int, int]]) -> list[int | None]:
    """For each target the place of its header, or None, given the cost of each place that it allows.

    As many targets as possible have a header; among such assignments the total cost is least, and among these the first
    target has its earliest place, then the second, and so on. Found by shortest augmenting paths.
    """
    first = [min(c.items(), key=lambda x: (x[1], x[0]))[0] if c else None for c in costs]
    taken = [p for p in first if p is not None]
    if len(taken) == len(set(taken)):  # nobody wants what another wants
        return first
    places = sorted({p for c in costs for p in c})
    n, base = len(costs), len(places) + len(costs) + 1
    top = max((v for c in costs for v in c.values()), default=0) + 1
    tail = base**n  # room for the order of the places of all targets
    none = (n * top + 1) * tail  # what a target without a header costs, and more for its place after all others
    # Column 0 is no column; each target has a column of its own that means no header.
    columns = len(places) + n
    huge = none * (n + 2) * 2

    def cost(t: int, column: int) -> int:
        if column <= len(places):
            given = costs[t].get(places[column - 1])
            return huge if given is None else given * tail + column * base ** (n - 1 - t)
        return none + (base - 1) * base ** (n - 1 - t) if column - len(places) - 1 == t else huge

    u, v, row_of, way = [0] * (n + 1), [0] * (columns + 1), [0] * (columns + 1), [0] * (columns + 1)
    for row in range(1, n + 1):
        row_of[0], at = row, 0
        least, used = [None] * (columns + 1), [False] * (columns + 1)
        while row_of[at]:
            used[at] = True
            here, step, nxt = row_of[at], None, 0
            for column in range(1, columns + 1):
                if used[column]:
                    continue
                slack = cost(here - 1, column) - u[here] - v[column]
                if least[column] is None or slack < least[column]:
                    least[column], way[column] = slack, at
                if step is None or least[column] < step:
                    step, nxt = least[column], column
            for column in range(columns + 1):
                if used[column]:
                    u[row_of[column]] += step
                    v[column] -= step
                elif column:
                    least[column] -= step
            at = nxt
        while at:
            row_of[at], at = row_of[way[at]], way[at]
    out: list[int | None] = [None] * n
    for column in range(1, len(places) + 1):
        if row_of[column]:
            out[row_of[column] - 1] = places[column - 1]
    return out


def header_costs(norms: str, targets: Sequence[str], synonyms: Mapping[str, str] | None, max_distance: int) -> list[Column]:
    """For each target its best headers, at most as many as there are targets: array of ``(score, position)``.

    A target never needs more: if all of these serve other targets, there are none left that lack one.
    """
    meanings: dict[str, list[str]] = {t: [] for t in targets}
    for word, target in (synonyms or {}).items():
        meanings[target].append(_normal(word))

    def score(norm: Column, target: str) -> Column:
        word = _normal(target)
        out = F.when(norm == word, F.lit(0))
        if meanings[target]:
            out = out.when(norm.isin(*meanings[target]), F.lit(1))
        if most := allowed_distance(word, max_distance):
            close = F.length(norm).between(len(word) - most, len(word) + most)
            distance = F.when(close, F.nullif(F.levenshtein(norm, F.lit(word), most), F.lit(-1)))
            out = out.otherwise(F.when(distance <= F.floor(F.length(norm) / 5), distance + 1))
        return out.cast("int")

    def best(target: str) -> Column:
        pairs = F.transform(norms, lambda n, p: F.struct(score(n, target).alias("score"), p.alias("position")))
        return F.slice(F.array_sort(F.filter(pairs, lambda x: x["score"].isNotNull())), 1, len(targets))

    return [best(t) for t in targets]


def assign_headers(df: DataFrame, headers: str, targets: Sequence[str], synonyms: Mapping[str, str] | None = None, max_distance: int = 2) -> DataFrame:
    """Adds ``matches``: array of ``(target, header, position, score)``, the cheapest assignment of the headers of each row.

    ``headers`` names an array column. Scores are those of :func:`veriform.operators.mapping.match_frame`: 0 an equal
    name, 1 a synonym, above that 1 + edit distance. The most targets that can have a header have one; of all ways to do
    so, the one with the least sum of scores; of equals, the one with the earliest positions, target by target.
    """
    # Each step is computed once; a filter further on must not compute it again.
    rated = df.withColumn("_norms", F.transform(headers, normal_name))
    costs = F.array(*header_costs("_norms", targets, synonyms, max_distance))
    rated = rated.withColumn("_costs", costs).drop("_norms")
    small = T.ArrayType(T.IntegerType())

    @F.arrow_udf(small)
    def assigned(column: pa.Array) -> pa.Array:
        out = []
        for per_target in column.to_pylist():
            way = cheapest([{x["position"]: x["score"] for x in one or ()} for one in per_target])
            out.append([-1 if p is None else p for p in way])
        return pa.array(out, pa.list_(pa.int32()))

    placed = rated.withColumn("_places", assigned(F.col("_costs")))

    def match(i: int, target: str) -> Column:
        place = F.get("_places", F.lit(i))
        pair = F.get(F.filter(F.get("_costs", F.lit(i)), lambda x: x["position"] == place), F.lit(0))
        return F.when(place >= 0, F.struct(F.lit(target).alias("target"), F.get(named(headers), place).alias("header"), place.alias("position"), pair["score"].alias("score")))

    found = [match(i, t) for i, t in enumerate(targets)]
    return placed.withColumn("matches", F.array_compact(F.array(*found))).select(*[named(c) for c in df.columns], "matches")
