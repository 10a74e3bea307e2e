"""Configuration read on the driver: rules, vocabularies, policy packs and question packs.

These are a few small files of a deployment; they become Python values that parametrise the operators.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from ..operators.scoring import DIMENSIONS, Dimension

MODES = ("hybrid", "vector", "keyword")


class ConfigError(ValueError):
    """A configuration that breaks its contract."""


def read_yaml(path: str | Path) -> dict[str, Any]:
    """A YAML file that holds a mapping."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: a mapping is expected")
    return data


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Mappings merge key by key, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def retrieval_vocabulary(path: str | Path | None) -> dict[str, Any]:
    """Stop words and field keywords; empty if there is no readable file."""
    try:
        data = read_yaml(path) if path else {}
    except ConfigError:
        data = {}
    return {"stopwords": data.get("stopwords") or [], "field_keywords": data.get("field_keywords") or {}}


def _working_pattern(p: str) -> str:
    """Rule files may escape their backslashes twice, and match nothing then; such patterns are taken once."""
    return p.replace("\\\\", "\\")


def dimensions(path: str | Path | None = None) -> tuple[Dimension, ...]:
    """Scoring dimensions of a rule file (an argument, then SCORING_RULES_PATH), or the defaults where it has none that is valid."""
    path = path or os.environ.get("SCORING_RULES_PATH")
    if not path:
        return DIMENSIONS
    try:
        listed = read_yaml(path).get("dimensions") or {}
    except ConfigError:
        return DIMENSIONS
    out = []
    for name, d in listed.items():
        keywords = d.get("keywords") if isinstance(d, dict) else None
        if not isinstance(keywords, list) or not all(isinstance(k, str) and k for k in keywords):
            continue
        try:
            weight = float(d["weight"])
        except (KeyError, TypeError, ValueError):
            continue
        patterns = tuple(_working_pattern(p) for p in d.get("extract_patterns") or [] if isinstance(p, str))
        out.append(Dimension(name, str(d.get("display_name") or name), weight, tuple(keywords), patterns, dict(d.get("risk_thresholds") or {})))
    return tuple(out) or DIMENSIONS


# -- policy ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """A validated policy; ``data`` is the merged mapping."""

    pack: str
    overlay: str | None
    data: dict[str, Any]

    @property
    def thresholds(self) -> dict[str, dict[str, float]]:
        """Least values of metrics by method."""
        return self.data["retrieval"].get("evaluation_thresholds") or {}

    def options(self, dimension: str, mode: str | None = None, top_k: int | None = None) -> tuple[str, int]:
        """Mode and top_k of a dimension: its own, then the arguments, then the defaults."""
        r = self.data["retrieval"]
        own = (r.get("dimension_overrides") or {}).get(dimension) or {}
        return own.get("mode") or mode or r["default_mode"], own.get("top_k") or top_k or r["default_top_k"]


def _need(data: dict[str, Any], path: str, kind, test=lambda v: True) -> Any:
    value: Any = data
    for part in path.split("."):
        if not isinstance(value, dict) or part not in value:
            raise ConfigError(f"{path} is missing")
        value = value[part]
    if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool or not test(value):
        raise ConfigError(f"{path} is not valid: {value!r}")
    return value


def validate_policy(data: dict[str, Any]) -> dict[str, Any]:
    """The mapping itself, or an error that names the first rule it breaks."""
    numbers = (int, float)
    words = lambda v: all(isinstance(x, str) and x.strip() for x in v)
    pair = lambda v: len(v) == 2 and all(isinstance(x, numbers) for x in v) and v[0] <= v[1]
    _need(data, "constraints", list, words)
    _need(data, "workflow.tool_calling_required", bool)
    _need(data, "workflow.max_turns_default", int, lambda v: v >= 1)
    _need(data, "workflow.required_tools", list, words)
    for name in ("baseline_score", "min_score", "max_score"):
        _need(data, f"scoring.{name}", numbers)
    for name in ("positive_evidence_delta_range", "risk_evidence_delta_range"):
        _need(data, f"scoring.{name}", list, pair)
    for level in ("high", "medium", "low"):
        _need(data, f"risk_rules.{level}", str, str.strip)
    _need(data, "output.strict_json", bool)
    _need(data, "output.schema_hint", str)
    _need(data, "retrieval.default_mode", str, MODES.__contains__)
    _need(data, "retrieval.default_top_k", int, lambda v: 1 <= v <= 100)
    for name, own in (data["retrieval"].get("dimension_overrides") or {}).items():
        if own.get("mode") not in (None, *MODES) or not (own.get("top_k") is None or isinstance(own["top_k"], int) and 1 <= own["top_k"] <= 100):
            raise ConfigError(f"retrieval.dimension_overrides.{name} is not valid")
    for method, metrics in (data["retrieval"].get("evaluation_thresholds") or {}).items():
        if not isinstance(metrics, dict) or not all(isinstance(v, numbers) and v >= 0 for v in metrics.values()):
            raise ConfigError(f"retrieval.evaluation_thresholds.{method} is not valid")
    _need(data, "evidence_gate.default_min_citations", int, lambda v: v >= 0)
    for name in ("require_page_idx", "require_bbox", "require_quote"):
        _need(data, f"evidence_gate.{name}", bool)
    return data


def load_policy(pack: str, overlay: str | None = None, root: str | Path | None = None) -> Policy:
    """A pack's base with an overlay that its manifest declares."""
    folder = Path(root or os.environ.get("POLICY_PACKS_ROOT", "config/policy/packs")) / pack
    manifest = read_yaml(folder / "manifest.yaml")
    declared = manifest.get("overlays") or []
    names = set(declared if isinstance(declared, list) else declared)
    data = read_yaml(folder / "base.yaml")
    if overlay:
        if overlay not in names and f"{overlay}.yaml" not in {Path(str(n)).name for n in names}:
            raise ConfigError(f"overlay {overlay!r} is not declared")
        data = merge(data, read_yaml(folder / "overlays" / f"{overlay}.yaml"))
    return Policy(pack, overlay, validate_policy(data))


def policy_artifact(policy: Policy) -> dict[str, Any]:
    """The policy with its prompt and the SHA-256 of its canonical JSON."""
    canonical = json.dumps({"pack": policy.pack, "overlay": policy.overlay, "policy": policy.data}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return {"policy_hash": hashlib.sha256(canonical.encode()).hexdigest(), "policy": policy.data, "pack": policy.pack, "overlay": policy.overlay, "prompt": policy_prompt(policy)}


def read_policy_artifact(path: str | Path) -> Policy:
    """The policy of a compiled artifact, validated; an artifact whose hash does not fit its policy is an error."""
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"no policy artifact at {path}: {e}") from e
    if not isinstance(given, dict) or not isinstance(given.get("policy"), dict):
        raise ConfigError(f"{path} holds no policy")
    policy = Policy(given.get("pack") or "", given.get("overlay"), validate_policy(given["policy"]))
    if policy_artifact(policy)["policy_hash"] != given.get("policy_hash"):
        raise ConfigError(f"the policy of {path} is not the one that was compiled")
    return policy


def policy_prompt(policy: Policy) -> str:
    """The policy's rules as lines of text."""
    d = policy.data
    lines = ["# Constraints", *(f"- {c}" for c in d["constraints"]), "# Scoring", f"- {d['scoring']['min_score']}..{d['scoring']['max_score']}, from {d['scoring']['baseline_score']}", "# Risk", *(f"- {k}: {v}" for k, v in d["risk_rules"].items()), "# Output", d["output"]["schema_hint"]]
    return "\n".join(lines)


def prompt_gaps(policy: Policy, prompt: str) -> list[str]:
    """Constraints, tools and risk rules that a prompt does not contain."""
    wanted = [*policy.data["constraints"], *policy.data["workflow"]["required_tools"], *policy.data["risk_rules"].values()]
    return [w for w in wanted if w not in prompt]


# -- questions ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Question:
    """An active question of a pack."""

    question_id: str
    dimension: str
    text: str
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class QuestionPack:
    """The active questions of a pack, and its overlay's policy."""

    pack: str
    questions: tuple[Question, ...]
    overlay: dict[str, Any]

    def keywords(self) -> dict[str, list[str]]:
        """Distinct keywords of each dimension, in order."""
        out: dict[str, dict[str, None]] = {}
        for q in self.questions:
            out.setdefault(q.dimension, {}).update(dict.fromkeys(k.strip() for k in q.keywords if k.strip()))
        return {d: list(k) for d, k in out.items()}


_ID = re.compile(r"^[A-Za-z0-9_.-]+$")


def load_questions(pack: str, overlay: str | None = None, root: str | Path | None = None, known: tuple[str, ...] = tuple(d.name for d in DIMENSIONS)) -> QuestionPack:
    """All dimension files of a pack: ids unique, dimensions known, only active questions kept."""
    folder = Path(root or os.environ.get("QUESTION_BANK_ROOT", "config/question_bank/packs")) / pack
    manifest = read_yaml(folder / "manifest.yaml")
    names = overlay or manifest.get("default_overlay")
    out, seen = [], set()
    for path in sorted((folder / "dimensions").glob("*.yaml")):
        data = read_yaml(path)
        dimension = data.get("dimension")
        if dimension not in known:
            raise ConfigError(f"{path.name}: unknown dimension {dimension!r}")
        for q in data.get("questions") or []:
            missing = [k for k in ("question_id", "keywords", "status") if k not in q]
            if missing:
                raise ConfigError(f"{path.name}: {missing} missing")
            if not _ID.match(str(q["question_id"])) or q["question_id"] in seen:
                raise ConfigError(f"{path.name}: question id {q['question_id']!r} is not unique or not valid")
            seen.add(q["question_id"])
            if q["status"] == "active":
                out.append(Question(q["question_id"], dimension, str(q.get("question") or q.get("title") or ""), tuple(q["keywords"])))
    policy: dict[str, Any] = {}
    if names:
        at = folder / "overlays" / (names if str(names).endswith(".yaml") else f"{names}.yaml")
        policy = read_yaml(at) if at.exists() else {}
        if overlay and not policy:
            raise ConfigError(f"overlay {overlay!r} is not there")
    return QuestionPack(pack, tuple(out), policy)


def settings(names: tuple[str, ...], prefix: str = "") -> dict[str, str | None]:
    """Settings of the environment."""
    return {n: os.environ.get(prefix + n) for n in names}


def redact(parameters: dict[str, Any], longest: int = 100) -> dict[str, Any]:
    """Parameters fit for a log: secrets hidden, long strings cut."""
    hide = re.compile(r"(?i)key|token|secret|password")
    cut = lambda v: v[:longest] + "..." if isinstance(v, str) and len(v) > longest else v
    return {k: "***" if hide.search(k) else cut(v) for k, v in parameters.items()}
