"""Settings of voters and converters, and the layouts of their requests and answers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriform.functions.values import base_name
from veriform.sinks.json_text import KEEP_NULLS

# Used where neither the agent nor its provider nor the settings say otherwise.
DEFAULT_PROVIDER = "local"
DEFAULT_MODEL = "openai/gpt-oss-20b"
DEFAULT_TEMPERATURE = 1.0
# Answer lengths asked for by two of the layouts.
MAX_TOKENS = 10000
MAX_OUTPUT_TOKENS = 8192


def resolve_agents(
    agents: DataFrame, providers: Mapping[str, Mapping[str, str | None]], default_provider: str = DEFAULT_PROVIDER,
    default_model: str = DEFAULT_MODEL, default_temperature: float = DEFAULT_TEMPERATURE,
) -> DataFrame:
    """Adds ``use_provider``, ``use_model``, ``use_temperature``, ``request_format`` and ``error``.

    ``providers`` is a settings table of a few entries, so it becomes an expression, not a join.
    """
    provider = F.coalesce("provider", F.lit(default_provider))

    def lookup(key: str) -> Column:
        out = F.lit(None).cast("string")
        for name, settings in providers.items():
            if settings.get(key) is not None:
                out = F.when(F.col("use_provider") == name, F.lit(settings[key])).otherwise(out)
        return out

    known = F.col("use_provider").isin(*providers)
    return agents.withColumn("use_provider", provider).withColumns({
        "use_model": F.coalesce("model", lookup("default_model"), F.lit(default_model)),
        "use_temperature": F.coalesce("temperature", F.lit(default_temperature)),
        "request_format": F.when(known, F.coalesce(lookup("request_format"), F.lit("openai"))),
        "error": F.when(~known, F.concat(F.lit("Provider '"), F.col("use_provider"), F.lit("' not configured"))),
    })


def to_request(fmt: Column, model: Column, temperature: Column, instructions: Column, request: Column) -> Column:
    """JSON request in the layout ``openai``, ``anthropic`` or ``google``."""
    name = base_name(model)

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    def part(content: Column) -> Column:
        return F.struct(F.lit("user").alias("role"), F.array(F.struct(content.alias("text"))).alias("parts"))

    anthropic = F.struct(
        name.alias("model"), F.lit(MAX_TOKENS).alias("max_tokens"), temperature.alias("temperature"), instructions.alias("system"),
        F.array(message("user", request)).alias("messages"),
    )
    google = F.struct(
        F.array(part(instructions), part(request)).alias("contents"),
        F.struct(temperature.alias("temperature"), F.lit(MAX_OUTPUT_TOKENS).alias("maxOutputTokens")).alias("generationConfig"),
    )
    openai = F.struct(
        name.alias("model"), temperature.alias("temperature"), F.lit(False).alias("stream"),
        F.array(message("system", instructions), message("user", request)).alias("messages"),
    )
    return (
        F.when(fmt == "anthropic", F.to_json(anthropic, KEEP_NULLS)).when(fmt == "google", F.to_json(google, KEEP_NULLS))
        .otherwise(F.to_json(openai, KEEP_NULLS))
    )


def from_response(response: Column, fmt: Column) -> Column:
    """Text of an answer in the given layout; null when it is not there."""
    return (
        F.when(fmt == "anthropic", F.get_json_object(response, "$.content[0].text"))
        .when(fmt == "google", F.get_json_object(response, "$.candidates[0].content.parts[0].text"))
        .otherwise(F.get_json_object(response, "$.choices[0].message.content"))
    )
