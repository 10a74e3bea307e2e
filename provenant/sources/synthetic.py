"""Deterministic content lists with judgments, for evaluating retrieval without private documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Topics with the sentence that answers them and words that only fill.
TOPICS = (("warranty", "整机质保{n}年，终身维修"), ("delivery", "{n}小时内响应并到场"), ("training", "提供操作培训{n}天"), ("financial", "预付{n}0%，余款验收后付清"))
FILLERS = ("本章说明项目概况", "设备参数见附表", "售后网点覆盖全国", "以下为一般条款")


def generate(spark: SparkSession, scenarios: int = 3, pages: int = 120, per_page: int = 10) -> tuple[DataFrame, DataFrame]:
    """Items of every scenario and graded judgments of every topic (3: the answer, 1: a page that names the topic)."""
    n = F.col("id")
    at = spark.range(scenarios * pages * per_page).select(F.concat(F.lit("scenario_"), F.floor(n / (pages * per_page)).cast("string")).alias("version_id"), (n % (pages * per_page)).cast("int").alias("pos"), n)
    page = F.floor(F.col("pos") / per_page).cast("int")
    first = F.col("pos") % per_page == 0
    kind = F.when(F.col("pos") % per_page == per_page - 1, "page_number").otherwise("text")
    topic = F.floor(F.col("pos") / (pages * per_page / len(TOPICS))).cast("int")
    answer = F.col("pos") % (pages * per_page // len(TOPICS)) == per_page + 3
    size = (F.xxhash64("version_id") % 5 + 5).cast("string")
    said = F.element_at(F.array(*(F.lit(t) for _, t in TOPICS)), topic + 1)
    name = F.element_at(F.array(*(F.lit(k) for k, _ in TOPICS)), topic + 1)
    filler = F.element_at(F.array(*map(F.lit, FILLERS)), F.pmod(F.xxhash64("pos"), F.lit(len(FILLERS))).cast("int") + 1)
    text = F.when(kind == "page_number", page.cast("string")).when(first, F.concat(F.lit("第"), page.cast("string"), F.lit("节 "), name)).when(answer, F.replace(said, F.lit("{n}"), size)).otherwise(filler)
    y = (F.col("pos") % per_page * 100).cast("double")
    none = F.lit(None).cast("array<string>")
    items = at.select(
        "version_id", "pos", kind.alias("type"), page.alias("page_idx"), F.array(F.array(F.lit(50.0), y, F.lit(950.0), y + 80)).alias("bbox"), text.alias("text"), F.when(first, 1).alias("text_level"), F.lit(None).cast("string").alias("table_body"),
        *(none.alias(c) for c in ("table_caption", "table_footnote", "image_caption", "image_footnote", "list_items")), F.lit(None).cast("string").alias("img_path"), F.lit(None).cast("string").alias("source_element_id"),
    )
    graded = at.where(answer | first).select("version_id", name.alias("query_id"), F.format_string("chunk_%04d", "pos").alias("source_id"), F.when(answer, 3).otherwise(1).alias("relevance"))
    return items, graded


def check(items: DataFrame, qrels: DataFrame) -> dict[str, int]:
    """How many items and judgments there are, and how many judgments name no item."""
    ids = items.select("version_id", F.format_string("chunk_%04d", "pos").alias("source_id"))
    return {"items": items.count(), "qrels": qrels.count(), "unresolved": qrels.join(ids, ["version_id", "source_id"], "left_anti").count()}


#: Own questions: id, kind, question, keywords, the sentence that answers it ({n}: a number of the scenario), one that helps, and one that only touches it ('' for none).
QUESTIONS = (
    ("q01", "factual", "how many years of warranty does the scanner have", ["warranty", "scanner"], "the scanner carries a warranty of {n} years", "warranty claims for the scanner go to the service desk", ""),
    ("q02", "factual", "within how many hours do engineers arrive on site", ["engineers", "arrive"], "engineers arrive on site within {n} hours of a call", "engineers who arrive carry spare parts", ""),
    ("q03", "factual", "how many days of operator training are offered", ["operator", "training"], "operator training lasts {n} days at the hospital", "operator training follows a written plan", ""),
    ("q04", "factual", "what share is paid in advance", ["advance", "payment"], "an advance payment of {n}0 percent is due at signing", "the advance payment is secured by a bank guarantee", ""),
    ("q05", "factual", "when is the equipment delivered", ["delivery", "weeks"], "delivery takes place {n} weeks after signing", "delivery is announced two weeks before", ""),
    ("q06", "factual", "who stocks spare parts", ["spare", "depot"], "a depot in the region keeps {n}00 spare parts", "the spare depot is open all year", ""),
    ("q07", "factual", "which certificate does the maker hold", ["certificate", "maker"], "the maker holds certificate number {n}4711 for medical devices", "the certificate of the maker is enclosed", ""),
    ("q08", "keyword_critical", "model XR-900 tube voltage", ["XR-900", "voltage"], "model XR-900 has a tube voltage of 1{n}0 kilovolt", "the voltage of model XR-900 is set at the console", ""),
    ("q09", "keyword_critical", "standard IEC60601 conformity", ["IEC60601"], "conformity with IEC60601 is declared in annex {n}", "annex lists IEC60601 test reports", ""),
    ("q10", "keyword_critical", "interface DICOM3 worklist", ["DICOM3", "worklist"], "the worklist is read over DICOM3 with {n} connections", "DICOM3 worklist settings are made by the vendor", ""),
    ("q11", "keyword_critical", "firmware V7 update", ["firmware", "V7"], "firmware V7 is updated {n} times a year", "the firmware V7 notes are online", ""),
    ("q12", "keyword_critical", "cable set K12 length", ["K12", "cable"], "cable set K12 is {n} metres long", "", "cable ducts are laid by the customer"),
    ("q13", "keyword_critical", "filter HEPA14 replacement", ["HEPA14"], "filter HEPA14 is replaced every {n} months", "", "filters are part of the kit"),
    ("q14", "semantic", "what happens if the machine stands still", ["downtime", "compensation"], "for each day of downtime a compensation of {n} percent is paid", "", "downtime is recorded by the system"),
    ("q15", "semantic", "is patient data kept safe", ["encrypted", "records"], "patient records are encrypted with keys of {n}56 bits", "", "records are kept for ten years"),
    ("q16", "semantic", "can the device grow with the clinic", ["upgrade", "modules"], "up to {n} modules can be added in a later upgrade", "", "modules have a common frame"),
    ("q17", "semantic", "how loud is the room", ["noise", "decibel"], "noise stays below 5{n} decibel in the room", "", "noise is measured at one metre"),
    ("q18", "numeric_reasoning", "total energy use per year", ["energy", "kilowatt"], "energy use is {n}000 kilowatt hours a year", "", "energy meters are calibrated"),
    ("q19", "numeric_reasoning", "sum of all licence fees", ["licence", "fees"], "licence fees add up to {n}00 a month", "", "fees are listed without tax"),
    ("q20", "conflict_resolution", "which response time is binding", ["binding", "response"], "the binding response time is {n} hours", "", "response times are targets unless agreed"),
    ("q21", "conflict_resolution", "which price list prevails", ["prevails", "price"], "the price list of annex {n} prevails", "", "price lists change every spring"),
    ("q22", "negation", "what is not covered by the contract", ["excluded", "contract"], "consumables are excluded from the contract after {n} months", "", "the contract is renewed in writing"),
)


def evaluation(spark: SparkSession, scenarios: int = 3, pages: int = 120, per_page: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of every scenario, the questions to each, and 45 graded judgments a scenario (3: the answer, 2: what helps, 1: what only touches it, 0: one that looks alike)."""
    total, versions = pages * per_page, [f"scenario_{s}" for s in range(scenarios)]
    planted, qrels = [], []
    for s, version in enumerate(versions):
        at = [(i * 53 + 7 * s) % total for i in range(3 * len(QUESTIONS))]  # distinct, as 53 does not divide the total
        for i, (qid, _, _, _, answer, helps, touches) in enumerate(QUESTIONS):
            for k, (text, grade) in enumerate(((answer.format(n=s + 2), 3), (helps, 2), (touches, 1))):
                if text:
                    planted.append((version, at[3 * i + k], text))
                    qrels.append((qid, version, f"chunk_{at[3 * i + k]:04d}", grade))
        decoy = (at[-1] + 1) % total
        planted.append((version, decoy, "the old contract named no excluded parts"))
        qrels.append(("q22", version, f"chunk_{decoy:04d}", 0))
    said = spark.createDataFrame(planted, "version_id string, pos int, said string")
    filler = F.concat_ws(" ", *(F.element_at(F.array(*map(F.lit, ("general terms", "drawings", "site plan", "terms of the tender", "parts in the annex", "the price of the hour", "days of the year", "list of rooms"))), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)).cast("int") + 1) for k in range(4)))
    every = spark.range(scenarios * total).select(F.concat(F.lit("scenario_"), F.floor(F.col("id") / total).cast("string")).alias("version_id"), (F.col("id") % total).cast("int").alias("pos"), filler.alias("filler"))
    source = F.format_string("chunk_%04d", "pos")
    chunks = every.join(F.broadcast(said), ["version_id", "pos"], "left").select("version_id", source.alias("source_id"), F.concat_ws(":", "version_id", source).alias("chunk_id"), F.col("pos").alias("chunk_index"), F.floor(F.col("pos") / per_page).cast("int").alias("page_idx"), F.coalesce("said", "filler").alias("text_raw"))
    queries = spark.createDataFrame([(f"{v}/{q[0]}", v, q[0], q[1], q[2], q[3]) for v in versions for q in QUESTIONS], "query_id string, version_id string, question_id string, query_type string, query string, keywords array<string>")
    return chunks, queries, spark.createDataFrame([(f"{v}/{q}", v, c, g) for q, v, c, g in qrels], "query_id string, version_id string, source_id string, relevance int")
