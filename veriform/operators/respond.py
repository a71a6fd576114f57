"""Converters and voters that are calls: a function given by the user, run in batches by Spark.

Answers may cost time and money and may differ from call to call, so every step is materialised
before it is used: no later action, and no executor lost after a step, asks again for rows already
answered. A task that fails within a step asks again for the rows of its partition, so
``rows_per_task`` bounds what one failure can repeat. With a ``store`` nothing that was answered is asked again, by the
same run or a later one: answers are written as they come (:mod:`veriform.operators.answers`).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.functions import text as tx
from veriform.functions.text import has_placeholders, parse_output
from veriform.operators import agents as ag
from veriform.operators import answers, voting
from veriform.operators.mapping import named
from veriform.session import materialise

# Takes (request, instructions) and returns the text of the answer; may raise.
Responder = Callable[[str, str], str]

META = T.StructType([
    T.StructField("elapsed_time", T.DoubleType()), T.StructField("retry_count", T.IntegerType()), T.StructField("failed", T.BooleanType()),
])


def call(responder: Responder, request: str, instructions: str, tries: int, backoff: float, sleep: Callable[[float], None]) -> tuple:
    """``(content, error, seconds, retries, failed)`` of one call with repeats; never raises."""
    start, error = time.monotonic(), "no tries"
    for attempt in range(tries):
        try:
            return responder(request, instructions), None, round(time.monotonic() - start, 2), attempt, False
        except Exception as exc:  # any failure of the call counts
            error = str(exc) or type(exc).__name__
            if attempt < tries - 1:
                sleep(backoff**attempt)
    return None, error, round(time.monotonic() - start, 2), tries, True


def _with_columns(part: pa.RecordBatch, rows: list, meta: list, names: list[str]) -> pa.RecordBatch:
    """The rows of a batch, which are left as they are, with the answer, the error and the settings of each call beside them."""
    kinds = {"elapsed_time": pa.float64(), "retry_count": pa.int32(), "failed": pa.bool_()}
    told = [f.name for f in AGENT_META if f.name in (meta[0] if meta else META.names)]
    kind = pa.struct([(n, kinds.get(n, pa.float64() if n == "temperature" else pa.string())) for n in told])
    new = [pa.array([r and r[0] for r in rows], pa.string()), pa.array([r and r[1] for r in rows], pa.string()), pa.array(meta, kind)]
    return pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])


def respond(
    df: DataFrame, request: str, instructions: str, responder: Responder, tries: int = 3, backoff: float = 2, concurrency: int | None = None,
    sleep: Callable[[float], None] = time.sleep, keep: bool = True, store: str | None = None, save_every: int = 20,
) -> DataFrame:
    """Adds ``content``, ``error`` and ``meta``; one call per row, repeated on failure with growing waits.

    ``concurrency`` bounds how many calls run at once, whatever the size of the cluster. With
    ``keep`` the answers are checkpointed. With a ``store``, a folder that stays, there is one call per different request and
    instructions, and none for those that the store answers.
    """
    if store is not None:
        def ask(asked: str) -> tuple:
            return call(responder, *json.loads(asked), tries, backoff, sleep)

        asked = df.withColumn("_asked", F.to_json(F.array(named(request), named(instructions)), {"ignoreNullFields": "false"}))
        out = _with_answers(asked, ask, store, concurrency, save_every).withColumnsRenamed({"_answer": "content", "_error": "error", "_meta": "meta"})
        return materialise(out) if keep else out
    work = df if concurrency is None else df.repartition(concurrency)
    schema = T.StructType([*work.schema.fields, T.StructField("content", T.StringType()), T.StructField("error", T.StringType()), T.StructField("meta", META)])

    def run(batches):
        for part in (part for batch in batches for part in answers.parts(batch, request)):
            asked = zip(part.column(request).to_pylist(), part.column(instructions).to_pylist(), strict=True)
            rows = [call(responder, r, i, tries, backoff, sleep) for r, i in asked]
            yield _with_columns(part, rows, [{"elapsed_time": r[2], "retry_count": r[3], "failed": r[4]} for r in rows], ["content", "error", "meta"])

    out = work.mapInArrow(run, schema)
    return materialise(out) if keep else out


def _with_answers(df: DataFrame, ask: Callable[[str], tuple], store: str, concurrency: int | None, save_every: int) -> DataFrame:
    """``_answer``, ``_error``, ``_meta`` joined to the rows that ask for them in ``_asked``, a column that is taken off; rows that ask for nothing have none."""
    tasks = concurrency or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = answers.ask_once(df, "_asked", ask, store, tasks, save_every)
    meta = F.struct(F.col("elapsed").alias("elapsed_time"), F.col("retries").alias("retry_count"), F.col("failed").alias("failed"))
    told = told.select(F.col("key").alias("_key"), F.col("content").alias("_answer"), F.col("error").alias("_error"), meta.alias("_meta"))
    joined = df.withColumn("_key", F.sha2("_asked", 256)).join(told, "_key", "left")
    return joined.select(*[named(c) for c in df.columns if c != "_asked"], "_answer", "_error", "_meta")


# Fixed value: the error of a request in which template markers are left.
MARKERS_LEFT = "Unreplaced placeholders in request"

# Takes the JSON payload of a request and the settings of its agent; returns the JSON answer; may raise.
Transport = Callable[[str, Mapping[str, str]], str]


@dataclass(frozen=True)
class Agent:
    """A voter or converter: who it is, what it is told, and the settings that are not left to its provider."""

    name: str
    role: str
    instructions: str
    request: str
    provider: str | None = None
    model: str | None = None
    temperature: float | None = None


AGENT_META = T.StructType([
    T.StructField("agent_name", T.StringType()), T.StructField("agent_role", T.StringType()), T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("temperature", T.DoubleType()), *META.fields,
])


@dataclass(frozen=True)
class Calls:
    """How calls are made: the transport, the providers, the repeats, how many rows a task asks for, and where answers stay."""

    transport: Transport
    providers: Mapping[str, Mapping[str, str | None]]
    default_provider: str = ag.DEFAULT_PROVIDER
    default_model: str = ag.DEFAULT_MODEL
    default_temperature: float = ag.DEFAULT_TEMPERATURE
    tries: int = 3
    backoff: float = 2
    sleep: Callable[[float], None] = time.sleep
    concurrency: int | None = None
    rows_per_task: int | None = None
    store: str | None = None
    save_every: int = 20

    def dealt(self, df: DataFrame, again: bool = False) -> DataFrame:
        """The rows in partitions that are asked for together. What was dealt before and only lost rows since is within ``rows_per_task``."""
        if self.concurrency is not None:
            return df.repartition(self.concurrency)
        return df if self.rows_per_task is None or again else df.repartition(df.count() // self.rows_per_task + 1)


def ask_agent(df: DataFrame, agent: Agent, request: Column, calls: Calls, name: str, wanted: Column | None = None) -> DataFrame:
    """Adds ``{name}_content``, ``{name}_error`` and ``{name}_meta``: one call per row where ``wanted``.

    Settings are resolved, the request is put in the layout of the provider, and the text is taken from its answer.
    A request with markers left and an agent whose provider is unknown are errors and are not sent.
    """
    settings = {"provider": F.lit(agent.provider).cast("string"), "model": F.lit(agent.model).cast("string"), "temperature": F.lit(agent.temperature).cast("double")}
    resolved = ag.resolve_agents(
        df.sparkSession.range(1).select(*[c.alias(k) for k, c in settings.items()]), calls.providers, calls.default_provider, calls.default_model, calls.default_temperature
    ).first()
    layout, unknown, model, temperature = resolved["request_format"], resolved["error"], resolved["use_model"], resolved["use_temperature"]
    told = {"agent_name": agent.name, "agent_role": agent.role, "provider": resolved["use_provider"], "model": model, "temperature": temperature}
    work = df.withColumns({"_request": request, "_wanted": F.coalesce(wanted, F.lit(False)) if wanted is not None else F.lit(True)})
    early = F.when(F.lit(unknown is not None), F.lit(unknown)).when(has_placeholders(F.col("_request")), F.lit(MARKERS_LEFT))
    payload = ag.to_request(F.lit(layout), F.lit(model), F.lit(temperature), F.lit(agent.instructions), F.col("_request"))
    work = work.withColumn("_early", F.when(F.col("_wanted"), early)).withColumn("_payload", F.when(F.col("_wanted") & F.col("_early").isNull(), payload)).drop("_request")
    transport, tries, backoff, sleep = calls.transport, calls.tries, calls.backoff, calls.sleep
    if calls.store is not None:
        def ask(asked: str) -> tuple:
            settings, payload = json.loads(asked)
            return call(transport, payload, json.loads(settings), tries, backoff, sleep)

        asked = F.when(F.col("_payload").isNotNull(), F.to_json(F.array(F.lit(json.dumps(told)), F.col("_payload"))))
        answered = _with_answers(work.withColumn("_asked", asked), ask, calls.store, calls.concurrency, calls.save_every)
        none = F.struct(F.lit(0.0).alias("elapsed_time"), F.lit(0).alias("retry_count"), F.lit(True).alias("failed"))
        took = F.coalesce("_meta", none)
        meta = F.struct(*[F.lit(v).alias(k) for k, v in told.items()], *[took[f.name].alias(f.name) for f in META.fields])
        answered = answered.withColumn("_meta", meta.cast(AGENT_META))
    else:
        schema = T.StructType([*work.schema.fields, T.StructField("_answer", T.StringType()), T.StructField("_error", T.StringType()), T.StructField("_meta", AGENT_META)])

        def run(batches):
            for part in (part for batch in batches for part in answers.parts(batch, "_payload")):
                rows = [call(transport, p, told, tries, backoff, sleep) if p is not None else None for p in part.column("_payload").to_pylist()]
                meta = [told | {"elapsed_time": r[2] if r else 0.0, "retry_count": r[3] if r else 0, "failed": r[4] if r else True} for r in rows]
                yield _with_columns(part, rows, meta, ["_answer", "_error", "_meta"])

        answered = work.mapInArrow(run, schema)

    content = ag.from_response(F.col("_answer"), F.lit(layout))
    return answered.withColumns({
        f"{name}_content": content, f"{name}_error": F.coalesce("_early", "_error"), f"{name}_meta": F.when(F.col("_wanted"), F.col("_meta")),
    }).drop("_wanted", "_early", "_payload", "_answer", "_error", "_meta")


def respond_votes(df: DataFrame, agents: Sequence[Agent], requests: Sequence[Column], calls: Calls, name: str = "vote", again: bool = False) -> DataFrame:
    """Votes of three called voters with early exit, in the columns of :func:`veriform.operators.voting.ask`, and their ``{name}_meta_i``.

    Two rounds: voters one and two for all rows, voter three only for the rows where they differ. A failed call, and a
    request that cannot be sent, is a vote against. Without a store a partition goes through both rounds in one task. ``again``:
    the rows are dealt already.
    """
    if len(agents) != voting.VOTERS or len(requests) != voting.VOTERS:
        raise ValueError(f"expected {voting.VOTERS} voters")

    def one(frame: DataFrame, i: int, wanted: Column | None = None) -> DataFrame:
        asked = ask_agent(frame, agents[i], requests[i], calls, "_a", wanted)
        vote = voting.vote_of_message(F.col("_a_content"), F.col("_a_error"))
        here = F.col("_a_meta").isNotNull()
        return asked.withColumns({
            f"{name}_ok_{i}": F.when(here, vote["isvalid"]), f"{name}_msg_{i}": F.when(here, vote["invalid_msg"]), f"{name}_meta_{i}": F.col("_a_meta"),
        }).drop("_a_content", "_a_error", "_a_meta")

    two = one(one(calls.dealt(df, again), 0), 1)
    if calls.store is not None:  # its third voter reads the rows more than once
        two = materialise(two)
    differ = F.coalesce(F.col(f"{name}_ok_0") != F.col(f"{name}_ok_1"), F.lit(False))
    three = one(two.withColumn("_differ", differ), 2, F.col("_differ"))
    return materialise(three.withColumn(f"{name}_asked", F.when(F.col("_differ"), F.lit(3)).otherwise(F.lit(2))).drop("_differ"))


def run_with_calls(
    df: DataFrame, key: str, value: str, verifiers: Sequence[Agent], converter: Agent, validators: Sequence[Agent], calls: Calls, now: str, max_retries: int = 3,
) -> DataFrame:
    """The whole run with called agents: ``(key, status, retries, output, notes)``, one row per row of ``df``.

    Status: ``load_error`` (no text), ``pre-verification_failed``, ``conversion_error`` (the request has markers left, the
    call failed, or the answer has no output section), ``vote_error`` (one of the first two votes cannot be read),
    ``success`` or ``failed``. Each agent has its own request and instructions; the notes of rejected attempts go into
    the next request. Each round handles only the documents still open and is checkpointed, so a document is asked
    once per attempt; there are at most ``max_retries`` rounds, whatever the number of documents.
    """
    data = named(value)

    def requests(agents: Sequence[Agent], extra: Mapping[str, Column]) -> list[Column]:
        return [tx.render_template(a.request, {tx.DATA: data, **extra, tx.DATE_TIME: F.lit(now)}) for a in agents]

    def ended(rows: DataFrame, status: Column | str, retries: Column, output: Column, notes: Column) -> DataFrame:
        status = F.lit(status) if isinstance(status, str) else status
        return rows.select(named(key), status.alias("status"), retries.cast("int").alias("retries"), output.cast("string").alias("output"), notes.alias("notes"))

    none, blank = F.lit(None), F.lit("")
    finished = ended(df.filter(data.isNull()), "load_error", none, none, blank)
    checked = respond_votes(df.filter(data.isNotNull()).select(named(key), data), verifiers, requests(verifiers, {}), calls, "pre")
    stopped = F.when(voting.unreadable("pre"), "vote_error").when(~voting.passed("pre"), "pre-verification_failed")
    finished = finished.unionByName(ended(checked.filter(stopped.isNotNull()), stopped, none, none, voting.feedback("pre")))
    pending = checked.filter(stopped.isNull()).select(named(key), data, blank.alias("_notes"))
    for i in range(max_retries):
        request = tx.render_template(converter.request, {tx.DATA: data, tx.RUN_INDEX: F.lit(i), tx.DATE_TIME: F.lit(now), tx.PREVIOUS_NOTES: F.col("_notes")})
        sent = materialise(ask_agent(calls.dealt(pending, True), converter, request, calls, "_c"))
        sent = sent.withColumn("_out", F.when(F.col("_c_error").isNull(), parse_output(F.col("_c_content"))))
        broken = sent.filter("_out is null")
        finished = finished.unionByName(ended(broken, "conversion_error", F.lit(i), none, F.coalesce("_c_error", F.lit("No output section"))))
        judged = sent.filter("_out is not null").select(named(key), data, "_out")
        voted = respond_votes(judged, validators, requests(validators, {tx.OUTPUT: F.col("_out")}), calls, "_v", True)
        outcome = F.when(voting.unreadable("_v"), "vote_error").when(voting.passed("_v"), "success").when(F.lit(i == max_retries - 1), "failed")
        done = voted.filter(outcome.isNotNull())
        tried = F.when(outcome == "failed", F.lit(i + 1)).otherwise(F.lit(i))
        finished = finished.unionByName(ended(done, outcome, tried, F.when(outcome == "success", F.col("_out")), voting.feedback("_v")))
        pending = voted.filter(outcome.isNull()).select(named(key), data, voting.feedback("_v").alias("_notes"))
    return finished
