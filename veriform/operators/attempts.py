"""Conversion attempts, the choice among them, and the final status of a document.

With column rules all attempts of a document are columns of its row: later attempts are evaluated
only where the earlier ones were rejected, and nothing is shuffled or written between them.
:mod:`veriform.operators.respond` has the loop for converters and voters that are calls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriform.functions.text import parse_output
from veriform.operators import voting
from veriform.operators.mapping import named

# A converter gives the answer for an attempt number and the notes of the attempt before.
Converter = Callable[[int, Column], Column]
# Validators give the three votes on a converted output.
Validators = Callable[[Column], Sequence[Column]]


def _settled(flag: Column) -> Column:
    """The flag itself, marked so that Catalyst computes it once.

    A filter on the result would otherwise be pushed below the attempts by writing their whole
    expressions out again, level by level, which grows exponentially. Positions are never negative.
    """
    return flag & (F.monotonically_increasing_id() >= 0)


def convert_with_retry(
    df: DataFrame, converter: Converter, validators: Validators, max_retries: int = 3, ready: Column | None = None
) -> DataFrame:
    """Adds ``attempts`` (array), ``status``, ``retries``, ``output`` and ``notes``.

    Status is ``success`` (first attempt with two votes), ``conversion_error`` (no output section;
    not tried again), ``vote_error`` (first or second vote unreadable) or ``failed``. Rows where
    ``ready`` is false are left alone, all added columns null.
    """
    work = df.withColumn("_open", F.coalesce(ready, F.lit(False)) if ready is not None else F.lit(True))
    for i in range(max_retries):
        # Plain columns step by step: each is computed once and only for the rows still open.
        out, notes = f"_out{i}", F.col(f"_feedback{i - 1}") if i else F.lit("")
        work = work.withColumn(out, F.when(F.col("_open"), parse_output(converter(i, notes))))
        # Not wrapped in a condition: rules over null are cheap, and only what is computed
        # unconditionally is shared between a vote and its message.
        work = voting.ask(work, validators(F.col(out)), "_v")
        outcome = (
            F.when(~F.col("_open"), F.lit(None).cast("string"))
            .when(F.col(out).isNull(), F.lit("conversion_error"))
            .when(voting.unreadable("_v"), F.lit("vote_error"))
            .when(voting.passed("_v"), F.lit("success"))
            .otherwise(F.lit("rejected"))
        )
        voted = F.col(out).isNotNull()
        work = work.withColumns({
            f"_outcome{i}": outcome, f"_approved{i}": F.when(voted, voting.approved("_v")).otherwise(F.lit(0)),
            f"_total{i}": F.when(voted, voting.asked("_v")).otherwise(F.lit(0)), f"_feedback{i}": F.when(voted, voting.feedback("_v")).otherwise(F.lit("")),
            "_open": _settled(F.coalesce(outcome == "rejected", F.lit(False))),
        })

    def over(pick: Callable[[int], Column]) -> Column:
        """Value of the last attempt made."""
        return F.coalesce(*[F.when(F.col(f"_outcome{i}").isNotNull(), pick(i)) for i in reversed(range(max_retries))])

    last = over(lambda i: F.col(f"_outcome{i}"))
    made = [
        F.when(
            F.col(f"_outcome{i}").isNotNull(),
            F.struct(
                F.lit(i).alias("attempt"), F.col(f"_out{i}").alias("output"), F.col(f"_approved{i}").alias("approved"),
                F.col(f"_total{i}").alias("total"), F.col(f"_feedback{i}").alias("feedback"), F.col(f"_outcome{i}").alias("outcome"),
            ),
        )
        for i in range(max_retries)
    ]
    return work.select(
        *[named(c) for c in df.columns], F.array_compact(F.array(*made)).alias("attempts"),
        F.when(last == "rejected", F.lit("failed")).otherwise(last).alias("status"),
        over(lambda i: F.when(F.col(f"_outcome{i}") == "rejected", F.lit(i + 1)).otherwise(F.lit(i))).alias("retries"),
        F.when(last == "success", over(lambda i: F.col(f"_out{i}"))).alias("output"), over(lambda i: F.col(f"_feedback{i}")).alias("notes"),
    )


def generate_with_retry(
    df: DataFrame, generator: Converter, extract: Callable[[Column], Column], validators: Validators, retry_limit: int = 3
) -> DataFrame:
    """Attempts that are repeated on an error or a missing block too, and whose last result is kept even when rejected.

    Adds ``status`` (``success`` or ``failed``), ``attempts`` (how many), ``passed``, ``block`` and ``notes``.
    """
    work = df.withColumns({
        "_open": F.lit(True), "_notes": F.lit(""), "_block": F.lit(None).cast("string"), "_passed": F.lit(False), "_used": F.lit(0),
    })
    for i in range(1, retry_limit + 1):
        block = F.nullif(extract(F.when(F.col("_open"), generator(i, F.col("_notes")))), F.lit(""))
        work = work.withColumn("_now", block)
        work = voting.ask(work, validators(F.col("_now")), "_v")
        fine = F.coalesce(voting.decide(voting.approved("_v"), voting.asked("_v")), F.lit(False))
        done = F.col("_open") & F.col("_now").isNotNull() & (fine | F.lit(i == retry_limit))
        note = F.when(F.col("_now").isNull(), F.lit(f"Attempt {i} failed: Could not extract YAML from result")).otherwise(voting.retry_note(i, "_v"))
        work = work.withColumns({"_done": done, "_fine": fine, "_note": note})
        work = work.withColumns({
            "_block": F.when(F.col("_done"), F.col("_now")).otherwise(F.col("_block")),
            "_passed": F.when(F.col("_done"), F.col("_fine")).otherwise(F.col("_passed")),
            "_used": F.when(F.col("_open"), F.lit(i)).otherwise(F.col("_used")),
            "_notes": F.when(F.col("_open") & ~F.col("_done") & F.lit(i < retry_limit), F.col("_note")).otherwise(F.col("_notes")),
            "_open": _settled(F.col("_open") & ~F.col("_done")),
        }).drop("_now", "_done", "_fine", "_note")
    status = F.when(F.col("_block").isNotNull(), F.lit("success")).otherwise(F.lit("failed"))
    return work.select(
        *[named(c) for c in df.columns], status.alias("status"), F.col("_used").alias("attempts"), F.col("_passed").alias("passed"),
        F.col("_block").alias("block"), F.col("_notes").alias("notes"),
    )


def attempts_long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[named(k) for k in keys], F.inline_outer("attempts")).filter("outcome is not null")


def select_attempt(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First approved attempt per document from a table of attempts; one slot per group, combined map-side."""
    good = attempts.filter(F.col("outcome") == "success")
    best = good.groupBy(*[named(k) for k in keys]).agg(F.min(F.struct("attempt", "output", "approved", "total")).alias("a"))
    return best.select(*[named(k) for k in keys], "a.attempt", "a.output", "a.approved", "a.total")


def run_documents(
    df: DataFrame, value: str, verifiers: Sequence[Column], converter: Converter, validators: Validators, max_retries: int = 3
) -> DataFrame:
    """Verify, convert, validate: adds ``status``, ``retries``, ``output``, ``attempts`` and the verifier votes.

    Status also covers ``load_error`` (no text) and ``pre-verification_failed``.
    """
    loaded = F.col(value).isNotNull()
    verified = voting.ask(df, verifiers, "pre")
    gate = (
        F.when(~loaded, F.lit("load_error")).when(voting.unreadable("pre"), F.lit("vote_error"))
        .when(~voting.passed("pre"), F.lit("pre-verification_failed"))
    )
    gated = verified.withColumn("_gate", gate)
    done = convert_with_retry(gated, converter, validators, max_retries, F.col("_gate").isNull())
    return done.withColumn("status", F.coalesce("_gate", "status")).drop("_gate")


def run_summary(results: DataFrame) -> DataFrame:
    """Documents and mean retries per status."""
    return results.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("retries", F.lit(0))) / F.count(F.lit(1)), 4).alias("mean_retries")
    )
