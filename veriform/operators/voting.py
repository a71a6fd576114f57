"""Votes and their decision.

A vote is a struct ``(isvalid, invalid_msg)``; ``isvalid`` is null when the voter's answer could not
be read. The votes of a document are spread into columns of its row, so asking, deciding and
explaining need no shuffle; the third is evaluated only where the first two differ. Tables of votes with one
row per vote are decided with hash aggregates of fixed size per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriform.functions.text import parse_verdict
from veriform.operators.mapping import named

VOTERS = 3
RULES = ("2_of_3", "unanimous", "majority")


def vote_of(checked: Column) -> Column:
    """Vote from a check struct ``(ok, reason)``."""
    return F.struct(checked["ok"].alias("isvalid"), checked["reason"].alias("invalid_msg"))


# The wording of votes and notes that is read again by people and by the next attempt.
AGENT_ERROR = "Agent error: "
NO_REASON = "Unknown reason"


def vote_of_message(content: Column, error: Column | None = None) -> Column:
    """Vote from a voter's answer; an error of the voter is a vote against."""
    read = parse_verdict(F.coalesce(content, F.lit("")))
    if error is None:
        return read
    failed = F.struct(F.lit(False).alias("isvalid"), F.concat(F.lit(AGENT_ERROR), error).alias("invalid_msg"))
    return F.when(error.isNotNull(), failed).otherwise(read)


def _three(votes: Sequence[Column]) -> None:
    if len(votes) != VOTERS:
        raise ValueError(f"expected {VOTERS} voters, got {len(votes)}")


def ask(df: DataFrame, votes: Sequence[Column], name: str = "vote") -> DataFrame:
    """Adds ``{name}_ok_i``, ``{name}_msg_i`` and ``{name}_asked``.

    The third vote is evaluated only where the first two were read and differ. The votes are plain
    columns rather than structs, because Catalyst copies the expressions inside a struct to every
    place that reads a field; what it copies of a plain column is shared again within a stage.
    """
    _three(votes)
    two = df.withColumns(_pair(votes[0], name, 0) | _pair(votes[1], name, 1))
    return _add_third(two, votes[2], name, F.col(f"{name}_ok_0") != F.col(f"{name}_ok_1"))


def ask_all(df: DataFrame, votes: Sequence[Column], name: str = "vote") -> DataFrame:
    """All three votes, without early exit."""
    _three(votes)
    two = df.withColumns(_pair(votes[0], name, 0) | _pair(votes[1], name, 1))
    return _add_third(two, votes[2], name, F.lit(True))


def _pair(vote: Column, name: str, i: int) -> dict[str, Column]:
    return {f"{name}_ok_{i}": vote["isvalid"], f"{name}_msg_{i}": vote["invalid_msg"]}


def _add_third(two: DataFrame, vote: Column, name: str, wanted: Column) -> DataFrame:
    need = F.coalesce(wanted, F.lit(False))
    third = {k: F.when(need, v) for k, v in _pair(vote, name, 2).items()}
    return two.withColumns({**third, f"{name}_asked": F.when(need, F.lit(3)).otherwise(F.lit(2))})


def _oks(name: str) -> list[Column]:
    return [F.col(f"{name}_ok_{i}") for i in range(VOTERS)]


def _was_asked(name: str, i: int) -> Column:
    return F.lit(True) if i < 2 else F.col(f"{name}_asked") == 3


def asked(name: str = "vote") -> Column:
    """Number of votes cast."""
    return F.col(f"{name}_asked")


def approved(name: str = "vote") -> Column:
    """Number of votes in favour; an unreadable vote is not one."""
    out = F.lit(0)
    for ok in _oks(name):
        out = out + F.coalesce(ok, F.lit(False)).cast("int")
    return out


def unreadable(name: str = "vote") -> Column:
    """True where the first or the second vote could not be read, which ends the document's run."""
    return F.col(f"{name}_ok_0").isNull() | F.col(f"{name}_ok_1").isNull()


def decide(in_favour: Column, total: Column, rule: str = "2_of_3") -> Column:
    if rule == "2_of_3":
        return in_favour >= 2
    if rule == "unanimous":
        return (in_favour == total) & (total > 0)
    if rule == "majority":
        return in_favour * 2 > total
    raise ValueError(f"unknown rule {rule}; known are {', '.join(RULES)}")


def passed(name: str = "vote", rule: str = "2_of_3") -> Column:
    return decide(approved(name), asked(name), rule) & ~unreadable(name)


def feedback(name: str = "vote") -> Column:
    """Messages of the votes against, in voter order; an unreadable vote is not against."""
    against = [
        F.when(~F.coalesce(ok, F.lit(True)), F.coalesce(F.col(f"{name}_msg_{i}"), F.lit(""))) for i, ok in enumerate(_oks(name))
    ]
    return F.concat_ws("\n\n", *against)


def retry_note(attempt: Column | int, name: str = "vote") -> Column:
    """Note for the next generation attempt; here an unreadable vote is against."""
    against = [
        F.when(_was_asked(name, i) & ~F.coalesce(ok, F.lit(False)), F.coalesce(F.col(f"{name}_msg_{i}"), F.lit(NO_REASON)))
        for i, ok in enumerate(_oks(name))
    ]
    # Fixed value: the layout of the note.
    number = attempt.cast("string") if isinstance(attempt, Column) else F.lit(str(attempt))
    return F.concat(
        F.lit("Attempt "), number, F.lit(" validation failed ("), approved(name).cast("string"), F.lit("/"), asked(name).cast("string"),
        F.lit(" approved).  Issues: "), F.concat_ws("; ", *against),
    )


def to_long(df: DataFrame, keys: Sequence[str], name: str = "vote") -> DataFrame:
    """One row per vote cast: ``(keys..., agent_idx, isvalid, invalid_msg)``."""
    cast = [
        F.when(
            _was_asked(name, i),
            F.struct(F.lit(i).alias("agent_idx"), F.col(f"{name}_ok_{i}").alias("isvalid"), F.col(f"{name}_msg_{i}").alias("invalid_msg")),
        )
        for i in range(VOTERS)
    ]
    # The outer form keeps Catalyst from filtering on the array first, which would compute every vote twice.
    return df.select(*[named(k) for k in keys], F.inline_outer(F.array_compact(F.array(*cast))))


def consensus(votes: DataFrame, keys: Sequence[str], rule: str = "2_of_3") -> DataFrame:
    """``(keys..., approved, total, passed)`` of a table of votes; combined map-side, two counters per group."""
    counted = votes.groupBy(*[named(k) for k in keys]).agg(F.count_if("isvalid").alias("approved"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("passed", decide(F.col("approved"), F.col("total"), rule))


def tally(votes: DataFrame, keys: Sequence[str], rule: str = "2_of_3") -> DataFrame:
    """:func:`consensus` and the vote of each voter, in voter order; three slots per group, nothing is collected."""
    aggs = [F.count_if("isvalid").alias("approved"), F.count(F.lit(1)).alias("total")]
    for i in range(VOTERS):
        mine = F.when(F.col("agent_idx") == i, F.struct("agent_idx", "isvalid", "invalid_msg"))
        aggs.append(F.max(mine).alias(f"r{i}"))
    grouped = votes.groupBy(*[named(k) for k in keys]).agg(*aggs)
    results = F.array_compact(F.array(*[F.col(f"r{i}") for i in range(VOTERS)]))
    return grouped.select(*[named(k) for k in keys], "approved", "total", decide(F.col("approved"), F.col("total"), rule).alias("passed"), results.alias("results"))


def agreement(votes: DataFrame) -> DataFrame:
    """Votes of each kind per voter: ``(agent_idx, isvalid, n)``."""
    return votes.groupBy("agent_idx", "isvalid").agg(F.count(F.lit(1)).alias("n"))


def majority_accuracy(p: Column) -> Column:
    """Chance that two or three of three independent voters are right, each with chance ``p``."""
    return p * p * (3 - 2 * p)
