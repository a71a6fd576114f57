"""Mapping source columns to a target layout, and the row filters of a conversion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.functions.values import is_marker


def named(name: str) -> Column:
    """Column by literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def project_to_target(df: DataFrame, mapping: Mapping[str, str | Column | None], target: Sequence[str]) -> DataFrame:
    """Exactly the target columns in their order; a target without a source is null; no row is lost."""
    out = []
    for name in target:
        source = mapping.get(name)
        if source is None:
            out.append(F.lit(None).cast("string").alias(name))
        else:
            out.append((named(source) if isinstance(source, str) else source).alias(name))
    return df.select(*out)


def normal_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _normal(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch.isascii() and ch.isalnum())


def allowed_distance(word: str, most: int) -> int:
    """Changed letters that still make the same name: none below five letters, then one for every five."""
    return min(most, len(word) // 5)


def match_frame(
    df: DataFrame, headers: str, targets: Sequence[str], synonyms: Mapping[str, str] | None = None, max_distance: int = 2
) -> DataFrame:
    """Adds ``matches``, the best source header of each target: array of ``(target, header, position, score)``.

    ``headers`` names an array column, one row per file, so the match needs no shuffle and no join.
    Score 0 is an equal name after normalising, 1 a synonym, above that 1 + edit distance, which may
    be as large as the shorter of both names allows (:func:`allowed_distance`). Each
    header serves its best target only; ties go to the earlier target and the earlier position.
    Targets without a header are absent from the result.
    """
    meanings: dict[str, list[str]] = {t: [] for t in targets}
    for word, target in (synonyms or {}).items():
        meanings[target].append(_normal(word))

    def best_target(norm: Column) -> Column:
        # Score and target in one number, so that the smaller number is the better target.
        n = len(targets)
        known = F.lit(None).cast("int")
        for score in (1, 0):
            for i in reversed(range(n)):
                words = [_normal(targets[i])] if score == 0 else meanings[targets[i]]
                if words:
                    known = F.when(norm.isin(*words), F.lit(score * n + i)).otherwise(known)
        near = []
        for i, target in enumerate(targets):
            word = _normal(target)
            most = allowed_distance(word, max_distance)
            if not most:
                continue
            # Names whose lengths differ by more than the distance allowed are not compared.
            close = F.length(norm).between(len(word) - most, len(word) + most)
            distance = F.when(close, F.nullif(F.levenshtein(norm, F.lit(word), most), F.lit(-1)))
            near.append(F.when(distance <= F.floor(F.length(norm) / 5), distance) * n + (n + i))
        if not near:
            return known
        return F.coalesce(known, F.least(*near) if len(near) > 1 else near[0])

    # Columns are added step by step: each step is computed once, not once per target.
    named_rows = df.withColumn("_norms", F.transform(headers, normal_name))
    rated = named_rows.withColumn("_rated", F.transform("_norms", best_target))

    def first_of(i: int) -> Column:
        # Score and position of the headers whose best target is this one; the smallest pair wins.
        pairs = F.transform("_rated", lambda n, p: F.when(n % len(targets) == i, F.struct(F.floor(n / len(targets)).cast("int").alias("score"), p.alias("position"))))
        return F.array_min(pairs)

    picked = rated.withColumns({f"_p{i}": first_of(i) for i in range(len(targets))})
    found = [
        F.when(
            F.col(f"_p{i}").isNotNull(),
            F.struct(
                F.lit(t).alias("target"), F.get(F.col(headers), F.col(f"_p{i}.position")).alias("header"),
                F.col(f"_p{i}.position").alias("position"), F.col(f"_p{i}.score").alias("score"),
            ),
        )
        for i, t in enumerate(targets)
    ]
    return picked.withColumn("matches", F.array_compact(F.array(*found))).select(*[named(c) for c in df.columns], "matches")


def matches_long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per match: ``(keys..., target, header, position, score)``."""
    # The outer form keeps Catalyst from filtering on the array first, which would match every header twice.
    return df.select(*[named(k) for k in keys], F.inline_outer("matches")).filter("target is not null")


def mapping_for(df: DataFrame, targets: Sequence[str], synonyms: Mapping[str, str] | None = None,
                max_distance: int = 2) -> dict[str, str]:
    """Target to source column names of one table (reads only its header)."""
    one = df.sparkSession.createDataFrame([(df.columns,)], "headers array<string>")
    row = match_frame(one, "headers", targets, synonyms, max_distance).select("matches").first()
    return {m["target"]: m["header"] for m in row["matches"]}


def missing_targets(matches: Column, required: Sequence[str]) -> Column:
    """Required targets that found no header, as an array."""
    found = F.transform(matches, lambda m: m["target"])
    return F.array_except(F.array(*[F.lit(t) for t in required]), found)


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def exclude_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Drops rows that hold the value; rows with null stay."""
    return df.filter(~named(column).eqNullSafe(F.lit(value)))


def keep_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(named(column).isin(*values))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Drops rows whose value is null or a marker for a missing value."""
    c = named(column)
    present = c.isNotNull()
    if isinstance(df.schema[column].dataType, T.StringType):
        present = present & ~is_marker(c)
    return df.filter(present)


def between_dates(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Inclusive on both days, whatever the time of day. Written on the bare column so that it is pushed to the scan."""
    c = named(column)
    return df.filter((c >= F.lit(first).cast("date")) & (c < F.date_add(F.lit(last).cast("date"), 1)))


def last_days(df: DataFrame, column: str, days: int, as_of: str) -> DataFrame:
    """Rows of the ``days`` days up to ``as_of``."""
    c = named(column)
    end = F.lit(as_of).cast("date")
    return df.filter((c >= F.date_sub(end, days)) & (c < F.date_add(end, 1)))


def flatten(df: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    """Nested fields as flat columns: output name to dotted path."""
    return df.select(*[F.col(path).alias(name) for name, path in paths.items()])


def explode_then_flatten(df: DataFrame, array_path: str, paths: Mapping[str, str]) -> DataFrame:
    """One row per element of a nested list; paths start at ``item`` or at a column of the parent."""
    return flatten(df.withColumn("item", F.explode_outer(F.col(array_path))), paths)


def subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[named(c) for c in columns])
