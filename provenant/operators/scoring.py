"""Scoring: insights, extracted values, dimension and overall scores, blending and ranking.

Rules and dimensions are data (lists of Python values) turned into column expressions, so a version's chunks are
looked through once for all dimensions, those that any dimension takes are scored dimension by dimension, and versions are the grouping key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.text import clamp, is_bbox, like_any, numbers, worst_risk
from .order import global_rank

# Keyword groups in order, with label and level.
RISKS = (
    ("deadline", ("天", "小时", "工作日", "日内", "个月内", "周内"), "时限承诺", "high"),
    ("financial", ("万元", "元", "费用", "免费", "收费", "付款"), "财务条款", "medium"),
    ("compliance", ("承诺", "保证", "必须", "应当", "不得"), "合规承诺", "low"),
    ("vague", ("尽力", "尽快", "合理", "适当", "可能"), "模糊条款", "high"),
)
BENEFITS = (
    ("warranty", ("年保修", "终生维修", "质保期", "免费维修"), "质保优势"),
    ("response", ("小时响应", "到场", "2小时", "24小时"), "响应优势"),
    ("training", ("培训", "技术指导", "操作培训"), "培训支持"),
)
#: Titles and texts of insights ({}: the number or topic), the texts around a group's name and keyword, words that some ask for, and the parts of an annotation.
SAID = {
    "long_warranty": ("长期质保", "承诺{}年质保，优于行业标准。重点强调此优势。"),
    "short_warranty": ("质保期偏短", "质保期仅{}年，可能存在竞争劣势。建议确认是否可延长。"),
    "lifelong": ("终身质保", "发现终身质保承诺，这是强有力的竞争优势。"),
    "whole": ("质保范围", "承诺整机质保，覆盖范围较广。"),
    "fast": ("快速响应", "承诺{}小时内响应，响应速度较快。"),
    "slow": ("响应较慢", "响应时间{}小时，可能影响紧急情况处理。"),
    "on_site": ("现场服务", "包含现场/上门服务承诺。"),
    "much_training": ("充足培训", "提供{}天培训，培训内容较全面。"),
    "operation": ("操作培训", "包含设备操作培训。"),
    "upkeep": ("维护培训", "包含设备维护保养培训。"),
    "general": ("内容标记", "已标记{}相关内容，建议进一步详细评审。"),
}
SAID_OF = {"risk": (("检测到", "关键词：'"), "'。需确认具体数值和条件。"), "benefit": (("发现", "：'"), "'。可作为评分优势。")}
WORDS_FOR = {"lifelong": ("终生", "终身", "永久"), "whole": ("整机",), "on_site": ("现场", "上门"), "operation": ("操作", "使用"), "upkeep": ("维护", "保养")}
MARKS, ORIGINAL = {"risk": "⚠️", "benefit": "✅", "info": "ℹ️"}, "\n\n原文: "
#: Recommendations for a dimension of high risk, for one without a chunk, and for a version without either.
ADVICE = {"warranty": "[质保] 质保期偏短，建议确认是否可延长或增加服务承诺", "delivery": "[交付] 响应时间较慢，建议确认紧急情况处理流程", "training": "[培训] 培训时间不足，建议增加实操培训天数", "financial": "[商务] 付款条件较为严格，建议评估资金压力"}
LACKING = {"warranty": "[质保] 文档未找到质保条款，需补充", "delivery": "[交付] 文档未明确交付时间，需确认"}
ALL_WELL = "投标文档整体较为完整，建议按常规流程评审"
LEVEL_NAMES = {"high": "高风险", "medium": "中风险", "low": "低风险"}
INSIGHT = "struct<category:string,title:string,content:string,risk_level:string>"


@dataclass(frozen=True)
class Dimension:
    """A scoring dimension: thresholds are lower bounds with their bonus, or upper bounds if ``low_is_good``."""

    name: str
    display_name: str
    weight: float
    keywords: tuple[str, ...]
    patterns: tuple[str, ...] = ()
    thresholds: dict[str, list[float]] = field(default_factory=dict, hash=False)


# The default dimensions.
DIMENSIONS = (
    Dimension("warranty", "质保售后", 0.25, ("质保", "保修", "免费维修", "终身服务", "售后服务"), (r"(\d+)\s*年", r"(\d+)\s*个月"), {"excellent": [5, 999], "good": [3, 5], "medium": [2, 3], "poor": [0, 2]}),
    Dimension("delivery", "交付响应", 0.25, ("交货", "交付", "响应时间", "小时内", "到场", "上门"), (r"(\d+)\s*小时", r"(\d+)\s*天"), {"excellent": [0, 2], "good": [2, 8], "medium": [8, 24], "poor": [24, 999]}),
    Dimension("training", "培训支持", 0.20, ("培训", "技术指导", "操作培训", "维护培训"), (r"(\d+)\s*[天日]", r"(\d+)\s*人"), {"excellent": [5, 999], "good": [3, 5], "medium": [1, 3], "poor": [0, 1]}),
    Dimension("financial", "商务条款", 0.20, ("付款", "预付", "尾款", "保证金", "违约金", "报价"), (r"(\d+)%", r"(\d+)\s*万元"), {"high_prepayment": [50, 999], "medium_prepayment": [30, 50], "low_prepayment": [0, 30]}),
    Dimension("technical", "技术方案", 0.10, ("技术参数", "规格", "性能指标", "技术方案", "功能")),
    Dimension("compliance", "合规承诺", 0.10, ("承诺", "保证", "必须", "应当", "符合", "满足")),
)


# -- insights -------------------------------------------------------------------------------------


def _insight(category: str, title: Column | str, content: Column | str, level: str | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(category).alias("category"), lit(title).alias("title"), lit(content).alias("content"), F.lit(level).cast("string").alias("risk_level"))


def first_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    """The first of the keywords, in their order, that occurs; null if none does."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords))


def _said(name: str, category: str, value: Column | None = None, level: str | None = None) -> Column:
    """An insight of the table, its text with the value in it."""
    title, text = SAID[name]
    before, _, after = text.partition("{}")
    return _insight(category, title, F.concat(F.lit(before), value, F.lit(after)) if value is not None else text, level)


def _topic_rules(text: Column, topic: str) -> list[Column]:
    has = lambda *words: like_any(text, list(words), raw=False)
    none = F.lit(None).cast(INSIGHT)
    if topic == "warranty":
        years = F.array_max(numbers(text, r"(\d+)\s*年"))
        return [
            F.when(years >= 5, _said("long_warranty", "benefit", years)).when(years < 3, _said("short_warranty", "risk", years, "medium")).otherwise(none),
            F.when(has(*WORDS_FOR["lifelong"]), _said("lifelong", "benefit")),
            F.when(has(*WORDS_FOR["whole"]), _said("whole", "info")),
        ]
    if topic == "delivery":
        hours = F.array_min(numbers(text, r"(\d+)\s*小时"))
        return [F.when(hours <= 2, _said("fast", "benefit", hours)).when(hours > 24, _said("slow", "risk", hours, "medium")).otherwise(none), F.when(has(*WORDS_FOR["on_site"]), _said("on_site", "info"))]
    if topic == "training":
        days = F.aggregate(numbers(text, r"(\d+)\s*[天日]"), F.lit(0).cast("long"), lambda a, d: a + F.coalesce(d, F.lit(0)))
        return [F.when(days >= 5, _said("much_training", "benefit", days)), F.when(has(*WORDS_FOR["operation"]), _said("operation", "info")), F.when(has(*WORDS_FOR["upkeep"]), _said("upkeep", "info"))]
    return []


def insights(text: Column, topic: str, risks=RISKS, benefits=BENEFITS) -> Column:
    """Insights of a text: at most one of each group, then the topic's own, else one general; none for an empty text."""
    out = []
    for groups, category in ((risks, "risk"), (benefits, "benefit")):
        (head, middle), tail = SAID_OF[category]
        for _, keywords, label, *level in groups:
            k = first_keyword(text, keywords)
            out.append(F.when(k.isNotNull(), _insight(category, label, F.concat(F.lit(f"{head}{label}{middle}"), k, F.lit(tail)), *level)))
    found = F.array_compact(F.array(*(c.cast(INSIGHT) for c in [*out, *_topic_rules(text, topic)])))
    title, said = SAID["general"]
    general = F.array(_insight("info", title, said.replace("{}", topic)).cast(INSIGHT))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(f"array<{INSIGHT}>")).when(F.size(found) > 0, found).otherwise(general)


def annotation(text: Column, topic: str, longest: int = 200) -> Column:
    """The text of an annotation: the weightiest insight (risks by level, then benefits, then others) and a preview."""
    weight = lambda i: F.when(i["category"] == "risk", 0).when(i["category"] == "benefit", 1).otherwise(2) * 10 + F.when(i["risk_level"] == "high", 0).when(i["risk_level"] == "medium", 1).when(i["risk_level"] == "low", 2).otherwise(3)
    every = insights(text, topic)
    first = F.get(F.array_sort(F.transform(every, lambda i, n: F.named_struct(F.lit("w"), weight(i), F.lit("n"), n, F.lit("i"), i))), F.lit(0))["i"]
    mark = F.when(first["category"] == "risk", MARKS["risk"]).when(first["category"] == "benefit", MARKS["benefit"]).otherwise(MARKS["info"])
    level = F.create_map(*(F.lit(x) for kv in LEVEL_NAMES.items() for x in kv))
    head = F.concat_ws(" | ", mark, first["title"], F.when(first["risk_level"].isNotNull(), F.concat(F.lit("("), F.element_at(level, first["risk_level"]), F.lit(")"))))
    shown = F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)
    whole = F.concat(head, F.lit("\n"), first["content"], F.lit(ORIGINAL), shown)
    plain = F.concat(F.lit(f"【{topic}】"), F.substring(text, 1, longest - 10), F.lit("..."))
    return F.when(F.size(every) == 0, plain).when(F.length(whole) > longest, F.concat(F.substring(whole, 1, longest - 3), F.lit("..."))).otherwise(whole)


# -- dimensions -----------------------------------------------------------------------------------


def candidate_chunks(chunks: DataFrame, dimension: Dimension, cap: int = 50, overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """Chunks of each version in which a keyword occurs; the first ``cap`` by position (the analyser's own limit)."""
    keywords = (overrides or {}).get(dimension.name) or list(dimension.keywords)
    hits = chunks.where(like_any("text_raw", keywords)).withColumn("dimension", F.lit(dimension.name))
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy("version_id").orderBy("chunk_index"))).where(F.col("nth") <= cap).drop("nth")


def candidates(chunks: DataFrame, dimensions: tuple[Dimension, ...], cap: int = 50, overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """``candidate_chunks`` of all dimensions: each text is lower-cased and looked through once."""
    words = lambda d: (overrides or {}).get(d.name) or list(d.keywords)
    inside = lambda d: reduce(Column.__or__, (F.contains("low", F.lit(k.lower())) for k in words(d)), F.lit(False))
    found = F.array_compact(F.array(*(F.when(inside(d), F.lit(d.name)) for d in dimensions)))
    # an outer explode, as no filter then looks through the texts a second time
    hits = chunks.withColumn("low", F.lower("text_raw")).withColumn("found", found).drop("low").select(*chunks.columns, F.explode_outer("found").alias("dimension")).where("dimension IS NOT NULL")
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy("version_id", "dimension").orderBy("chunk_index"))).where(F.col("nth") <= cap).drop("nth")


def extracted(candidates: DataFrame, dimension: Dimension) -> DataFrame:
    """version_id, pattern, values, lowest, highest and count of the last chunk in which each pattern matches."""
    parts = []
    for i, p in enumerate(dimension.patterns):
        found = candidates.select("version_id", "chunk_index", numbers("text_raw", p).alias("values")).where("size(values) > 0")
        last = found.groupBy("version_id").agg(F.max_by("values", "chunk_index").alias("values"))
        parts.append(last.select("version_id", F.lit(i).alias("pattern"), "values", F.array_min("values").alias("lowest"), F.array_max("values").alias("highest"), F.size("values").alias("count")))
    if not parts:
        return candidates.select("version_id", F.lit(0).alias("pattern"), F.array().cast("array<int>").alias("values"), F.lit(0).alias("lowest"), F.lit(0).alias("highest"), F.lit(0).alias("count")).where("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bonus(name: str, highest: Column, lowest: Column, total: Column) -> Column:
    """The bonus of the extracted values: warranty by the highest, delivery by the lowest, training by the sum of each pattern's highest."""
    if name == "warranty":
        return F.when(highest >= 5, 20).when(highest >= 3, 10).when(highest < 2, -20).otherwise(0)
    if name == "delivery":
        return F.when(lowest <= 2, 20).when(lowest <= 8, 10).when(lowest > 24, -20).otherwise(0)
    if name == "training":
        return F.when(total >= 5, 20).when(total >= 3, 10).otherwise(0)
    return F.lit(0)


def dimension_score(benefits: Column, high: Column, medium: Column, other: Column, extra: Column) -> Column:
    """50, +10 a benefit, -15 / -5 / -2 a high / medium / other risk, and the bonus, within 0..100."""
    return clamp((50 + 10 * benefits - 15 * high - 5 * medium - 2 * other + extra).cast("double"), 0.0, 100.0)


def dimension_risk(high: Column, risks: Column, benefits: Column) -> Column:
    """high with any high risk, medium with more risks than benefits, else low."""
    return F.when(high > 0, "high").when(risks > benefits, "medium").otherwise("low")


def overall_risk(benefits: Column, risks: Column) -> Column:
    """By benefits per risk: 2 and more low, 1 and more medium, else high."""
    ratio = benefits / F.greatest(F.lit(1), risks)
    return F.when(ratio >= 2, "low").when(ratio >= 1, "medium").otherwise("high")


def score_dimension(chunks: DataFrame, dimension: Dimension, cap: int = 50, overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each version of ``chunks``: the dimension's result, versions without a chunk included."""
    return _result(candidate_chunks(chunks, dimension, cap, overrides), chunks.select("version_id").distinct(), dimension)


def _result(found: DataFrame, versions: DataFrame, dimension: Dimension) -> DataFrame:
    """The dimension's result for each version, from its candidates."""
    each = found.select("version_id", F.explode(insights(F.col("text_raw"), dimension.name)).alias("i"))
    risk = F.col("i.category") == "risk"
    counts = each.groupBy("version_id").agg(
        F.count_if(risk).alias("risks"), F.count_if(F.col("i.category") == "benefit").alias("benefits"), F.count_if(F.col("i.category") == "info").alias("infos"), F.count_if(risk & (F.col("i.risk_level") == "high")).alias("high"),
        F.count_if(risk & (F.col("i.risk_level") == "medium")).alias("medium"),
    )
    sizes = found.groupBy("version_id").agg(F.count("*").alias("chunks_found"))
    values = extracted(found, dimension).groupBy("version_id").agg(F.max("highest").alias("highest"), F.min("lowest").alias("lowest"), F.sum("highest").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", F.struct("values", "lowest", "highest", "count"))))).alias("extracted_values"))
    out = versions.join(sizes, "version_id", "left").join(counts, "version_id", "left").join(values, "version_id", "left")
    out = out.fillna(0, ["chunks_found", "risks", "benefits", "infos", "high", "medium"])
    extra = F.coalesce(bonus(dimension.name, F.col("highest"), F.col("lowest"), F.col("total")), F.lit(0)) if dimension.thresholds else F.lit(0)
    extra = F.when(F.col("highest").isNull(), 0).otherwise(extra)
    other = F.col("risks") - F.col("high") - F.col("medium")
    score = dimension_score(F.col("benefits"), F.col("high"), F.col("medium"), other, extra)
    return out.select(
        "version_id", F.lit(dimension.name).alias("dimension"), F.lit(dimension.display_name).alias("display_name"), F.lit(float(dimension.weight)).alias("weight"), "chunks_found", "risks", "benefits", "infos", score.alias("score"),
        dimension_risk(F.col("high"), F.col("risks"), F.col("benefits")).alias("risk_level"), "extracted_values",
    )


def analyze(chunks: DataFrame, dimensions: tuple[Dimension, ...] = DIMENSIONS, cap: int = 50, overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """The results of all dimensions of all versions; the candidates, at most ``cap`` a version and dimension, are cut into the shared folder, so that texts are read once."""
    found, versions = cut(candidates(chunks, dimensions, cap, overrides)), cut(chunks.select("version_id").distinct())
    return reduce(DataFrame.unionByName, (_result(found.where(F.col("dimension") == d.name), versions, d) for d in dimensions))


def overall(results: DataFrame) -> DataFrame:
    """One row a version: weighted mean score (50 without weights), totals and risk."""
    agg = results.groupBy("version_id").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"), F.sum("risks").alias("total_risks"), F.sum("benefits").alias("total_benefits"), F.sum("chunks_found").alias("chunks_analyzed"))
    score = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(50.0)
    return agg.select("version_id", score.alias("overall_score"), "total_risks", "total_benefits", overall_risk(F.col("total_benefits"), F.col("total_risks")).alias("risk_level"), "chunks_analyzed")


def recommendations(results: DataFrame) -> DataFrame:
    """version_id and its list of recommendations, in order of the dimensions."""
    look = lambda table: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("dimension"))
    order = F.element_at(F.create_map(*(x for i, d in enumerate(DIMENSIONS) for x in (F.lit(d.name), F.lit(i)))), F.col("dimension"))
    said = F.array_compact(F.array(F.when(F.col("risk_level") == "high", look(ADVICE)), F.when(F.col("chunks_found") == 0, look(LACKING))))
    each = results.select("version_id", F.struct(order.alias("o"), said.alias("said")).alias("x")).groupBy("version_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["said"])).alias("said"))
    return each.select("version_id", F.when(F.size("said") > 0, F.col("said")).otherwise(F.array(F.lit(ALL_WELL))).alias("recommendations"))


# -- comparison -----------------------------------------------------------------------------------


def rank_bidders(totals: DataFrame) -> DataFrame:
    """Ranks from 1 by overall score; equals by version id."""
    ranked = global_rank(totals, [F.col("overall_score").desc_nulls_last(), F.col("version_id")])
    return ranked.withColumn("overall_score", F.round("overall_score", 1))


def rank_dimensions(results: DataFrame) -> DataFrame:
    """Ranks of versions within each dimension."""
    w = Window.partitionBy("dimension").orderBy(F.round("score", 1).desc(), F.col("version_id"))
    return results.withColumn("rank", F.row_number().over(w)).withColumn("score", F.round("score", 1))


def comparison_summary(totals: DataFrame) -> DataFrame:
    """One row of the overall results: bidders, winner (the first id of equals), its score, mean score, and how many are of high risk."""
    best = F.min_by("version_id", F.struct((-F.col("overall_score")).alias("s"), F.col("version_id").alias("v")))
    return totals.agg(F.count("*").alias("total_bidders"), best.alias("winner"), F.round(F.max("overall_score"), 1).alias("winner_score"), F.round(F.avg("overall_score"), 1).alias("avg_score"), F.count_if(F.col("risk_level") == "high").alias("high_risk_count"))


def bidder_name(title: Column, version_id: Column) -> Column:
    """The first company name in a title, else a stand-in from the version id."""
    found = F.regexp_extract(title, r"(?U)([一-龥A-Za-z0-9（）()]+?(?:公司|集团|企业|医院|中心))", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.concat(F.lit("投标方"), F.substring(version_id, 1, 8)))


def blend(primary: DataFrame, secondary: DataFrame, weight: float = 0.7) -> DataFrame:
    """Two results of the same dimensions as one: weighted score to two places, the worse risk, the greater counts; a dimension of one side stays."""
    p = primary.select("version_id", "dimension", F.struct("score", "risk_level", "risks", "benefits", "chunks_found").alias("p"))
    s = secondary.select("version_id", "dimension", F.struct("score", "risk_level", "risks", "benefits", "chunks_found").alias("s"))
    both = p.join(s, ["version_id", "dimension"], "full_outer")
    score = F.round(F.col("p.score") * weight + F.col("s.score") * (1 - weight), 2)
    most = lambda c: F.greatest(F.coalesce(F.col(f"p.{c}"), F.lit(0)), F.coalesce(F.col(f"s.{c}"), F.lit(0))).alias(c)
    risk = F.when(F.col("p").isNull(), F.col("s.risk_level")).when(F.col("s").isNull(), F.col("p.risk_level")).otherwise(worst_risk("p.risk_level", "s.risk_level"))
    return both.select("version_id", "dimension", F.coalesce(score, F.col("p.score"), F.col("s.score")).alias("score"), risk.alias("risk_level"), most("risks"), most("benefits"), most("chunks_found"))


def normalize_agent(expected: DataFrame, given: DataFrame, citations: DataFrame) -> DataFrame:
    """An outside judge's results made safe: dimensions that are missing or without citations are neutral, others clamped."""
    cited = citations.groupBy("version_id", "dimension").agg(F.count("*").alias("n"))
    g = given.select("version_id", "dimension", F.col("score").alias("raw_score"), F.col("risk_level").alias("raw_risk"), F.lit(True).alias("given"))
    both = expected.select("version_id", "dimension").join(g, ["version_id", "dimension"], "left").join(cited, ["version_id", "dimension"], "left")
    missing, bare = F.col("given").isNull(), F.col("n").isNull()
    neutral = missing | bare
    score = F.when(neutral, 50.0).otherwise(clamp(F.coalesce(F.col("raw_score").try_cast("double"), F.lit(50.0)), 0.0, 100.0))
    risk = F.when(neutral | ~F.coalesce(F.col("raw_risk").isin("low", "medium", "high"), F.lit(False)), "medium").otherwise(F.col("raw_risk"))
    code = F.when(missing, F.concat(F.lit("agent_mcp_dimension_missing:"), F.col("dimension"))).when(bare, F.concat(F.lit("agent_mcp_dimension_no_verifiable_evidence:"), F.col("dimension")))
    return both.select("version_id", "dimension", score.alias("score"), risk.alias("risk_level"), F.when(neutral, 0).otherwise(F.col("n")).alias("citations"), code.alias("warning"))


# -- evidence gate --------------------------------------------------------------------------------


def gate(chunks: DataFrame) -> DataFrame:
    """Chunks with verifiable and the codes of what keeps them from scoring: status, box, page, quote."""
    codes = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("evidence_status").isin("verified", "verified_with_warnings"), F.lit(False)), F.lit("unverifiable_evidence_for_scoring")),
            F.when(~is_bbox("bbox"), F.lit("missing_bbox")),
            F.when(F.col("page_idx").isNull(), F.lit("missing_page_idx")),
            F.when(F.trim(F.coalesce("text_raw", F.lit(""))) == "", F.lit("missing_quote_text")),
        )
    )
    return chunks.withColumn("gate_codes", codes).withColumn("verifiable", F.size("gate_codes") == 0)
