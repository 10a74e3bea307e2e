"""Scoring backends: the rule analyser, an outside judge behind the evidence gate, and their blend.

A judge is a function from a DataFrame of gated evidence (version_id, dimension, chunk_id, page_idx, text_raw) to one of scores
(version_id, dimension, score, risk_level); how it decides, by a language model or otherwise, is its own affair.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from decimal import Decimal
from typing import Any
from uuid import UUID

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring

Judge = Callable[[DataFrame], DataFrame]


@dataclass
class Scored:
    """Dimension results (version_id, dimension, score, risk_level, risks, benefits, chunks_found), the citations behind them, and warning codes."""

    results: DataFrame
    citations: DataFrame
    warnings: tuple[str, ...] = ()


def evidence(chunks: DataFrame, dimensions: tuple[scoring.Dimension, ...], overrides: dict[str, list[str]] | None = None, cap: int = 50) -> DataFrame:
    """The candidate chunks of all dimensions with what the gate says of each."""
    out = None
    for d in dimensions:
        one = scoring.candidate_chunks(chunks, d, cap, overrides)
        out = one if out is None else out.unionByName(one)
    return scoring.gate(out)


def cited(gated: DataFrame) -> DataFrame:
    """Citations: the gated chunks that may be used, each once a dimension."""
    return gated.where("verifiable").select(F.col("version_id").alias("run_id"), "version_id", "dimension", "chunk_id", "page_idx", "bbox").dropDuplicates(["version_id", "dimension", "chunk_id", "page_idx"])


def analyzer(chunks: DataFrame, dimensions: tuple[scoring.Dimension, ...] = scoring.DIMENSIONS, overrides: dict[str, list[str]] | None = None) -> Scored:
    """The rule analyser."""
    columns = ("version_id", "dimension", "score", "risk_level", "risks", "benefits", "chunks_found")
    return Scored(scoring.analyze(chunks, dimensions, overrides=overrides).select(*columns), cited(evidence(chunks, dimensions, overrides)))


def agent(chunks: DataFrame, judge: Judge | None, dimensions: tuple[scoring.Dimension, ...] = scoring.DIMENSIONS, overrides: dict[str, list[str]] | None = None) -> Scored:
    """An outside judge over evidence that passes the gate; without a judge, or disabled, the analyser with a warning."""
    if judge is None or os.environ.get("AGENT_SCORING_DISABLED") == "1":
        fallback = analyzer(chunks, dimensions, overrides)
        return Scored(fallback.results, fallback.citations, ("scoring_backend_agent_mcp_fallback",))
    gated = evidence(chunks, dimensions, overrides)
    usable = gated.where("verifiable").select("version_id", "dimension", "chunk_id", "page_idx", "text_raw")
    names = F.explode(F.array(*(F.lit(d.name) for d in dimensions))).alias("dimension")
    expected = chunks.select("version_id").distinct().select("version_id", names)
    safe = scoring.normalize_agent(expected, judge(usable), usable)
    zero = F.lit(0).cast("long")
    return Scored(safe.select("version_id", "dimension", "score", "risk_level", zero.alias("risks"), zero.alias("benefits"), F.col("citations").alias("chunks_found")), cited(gated))


def hybrid(chunks: DataFrame, judge: Judge | None, dimensions: tuple[scoring.Dimension, ...] = scoring.DIMENSIONS, overrides: dict[str, list[str]] | None = None, weight: float | None = None) -> Scored:
    """The judge's and the analyser's results blended; the judge's weight comes from the argument, HYBRID_PRIMARY_WEIGHT, or is 0.7."""
    weight = hybrid_weight(weight)
    first, second = agent(chunks, judge, dimensions, overrides), analyzer(chunks, dimensions, overrides)
    both = first.citations.unionByName(second.citations).dropDuplicates(["version_id", "dimension", "chunk_id", "page_idx"])
    return Scored(scoring.blend(first.results, second.results, weight), both, tuple(dict.fromkeys([*first.warnings, *second.warnings])))


def hybrid_weight(given: float | None = None) -> float:
    """A weight within 0..1."""
    value = given if given is not None else float(os.environ.get("HYBRID_PRIMARY_WEIGHT", "0.7"))
    if not 0 <= value <= 1:
        raise ValueError("the weight must be within 0..1")
    return value


def backend(name: str, judge: Judge | None = None, weight: float | None = None) -> Callable[[DataFrame], Scored]:
    """A backend by name: analyzer, agent-mcp or hybrid."""
    made = {"analyzer": analyzer, "agent-mcp": lambda c, *a: agent(c, judge, *a), "hybrid": lambda c, *a: hybrid(c, judge, *a, weight=weight)}
    if name not in made:
        raise ValueError(f"scoring_backend_unknown: {name}")
    return made[name]


# -- a judge behind a model -----------------------------------------------------------------------


def plain(value: Any) -> Any:
    """A value as JSON has it: ids as strings, whole decimals as ints, others as floats, members likewise."""
    if isinstance(value, UUID):
        return str(value)
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def parse_reply(text: str) -> list[dict[str, Any]]:
    """The dimensions (name, score, risk_level) of a model's reply: JSON, bare, fenced or amid other text; a list, or an object under ``dimensions``."""
    inside = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    body = inside[1] if inside else text
    for opening, closing in sorted((("{", "}"), ("[", "]")), key=lambda x: (body.find(x[0]) < 0, body.find(x[0]))):
        begin, end = body.find(opening), body.rfind(closing)
        if 0 <= begin < end:
            try:
                data = json.loads(body[begin : end + 1])
                break
            except json.JSONDecodeError:
                continue
    else:
        raise ValueError("the reply holds no JSON")
    rows = data.get("dimensions", data) if isinstance(data, dict) else data
    if isinstance(rows, dict):
        rows = [{"name": k, **(v if isinstance(v, dict) else {"score": v})} for k, v in rows.items()]
    return [{"name": str(r.get("name") or r.get("dimension")), "score": r.get("score"), "risk_level": r.get("risk_level")} for r in rows if isinstance(r, dict) and (r.get("name") or r.get("dimension"))]


def converse(complete: Callable[[list[dict]], dict], prompt: str, tools: Mapping[str, Callable[..., Any]], max_turns: int = 8) -> str:
    """A model's final text: ``complete`` maps messages to {"text"} or {"calls": [{"id", "name", "arguments"}]}; calls are answered until there are none."""
    messages: list[dict] = [{"role": "user", "content": prompt}]
    for _ in range(max_turns):
        said = complete(messages)
        if not said.get("calls"):
            return said.get("text") or ""
        messages.append({"role": "assistant", "calls": said["calls"]})
        for call in said["calls"]:
            try:
                if call["name"] not in tools:
                    raise KeyError(f"unknown tool {call['name']}")
                result = plain(tools[call["name"]](**(call.get("arguments") or {})))
            except Exception as e:  # the model is told, and may do better
                result = {"error": f"{type(e).__name__}: {e}"}
            messages.append({"role": "tool", "id": call.get("id"), "content": json.dumps(result, ensure_ascii=False)})
    raise TimeoutError(f"no answer within {max_turns} turns")


def model_judge(complete: Callable[[list[dict]], dict], policy: str = "", max_turns: int = 8) -> Judge:
    """A judge that asks a model once a version, in a task; the evidence of each dimension (the analyser's cap bounds it) is read by a tool.  A reply that cannot be read gives no rows."""

    def judge(usable: DataFrame) -> DataFrame:
        def of_version(rows):
            by = {d: g[["chunk_id", "page_idx", "text_raw"]].astype(object).where(g[["chunk_id", "page_idx", "text_raw"]].notna(), None).to_dict("records") for d, g in rows.groupby("dimension")}
            prompt = f"{policy}\nScore these dimensions from their evidence: {', '.join(sorted(by))}".strip()
            try:
                parsed = parse_reply(converse(complete, prompt, {"evidence": lambda dimension: by[dimension]}, max_turns))
            except (ValueError, TimeoutError):
                parsed = []
            out = [(rows["version_id"].iloc[0], p["name"], None if p["score"] is None else str(p["score"]), p["risk_level"]) for p in parsed if p["name"] in by]
            return type(rows)(out, columns=["version_id", "dimension", "score", "risk_level"])

        return usable.groupBy("version_id").applyInPandas(of_version, "version_id string, dimension string, score string, risk_level string")

    return judge
