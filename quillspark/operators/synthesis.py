"""Deterministic synthesis without a language model (L4-L10, K2-K3 fallbacks, C9-C10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NOT_REPORTED
from ..functions import text as tx

COVERAGE_FIELDS = ["Dataset", "Optimizer", "Loss Function", "Hyperparameters", "Hardware", "Evaluation Metrics"]
METRIC_COLUMNS = ["Accuracy", "F1 Score", "Precision", "Recall", "AUC", "mAP"]
METRIC_FAMILY = "Any Evaluation Metric (Accuracy/Precision/Recall/F1/AUC/mAP)"
GENERAL_PRACTICE = "General AI Best Practice"

# Field, problem, suggested improvement, expected benefit, reason.
BEST_PRACTICES = [
    ("Dataset", "No Public Benchmark Dataset Reported", "Evaluate the proposed method on a standard, publicly available benchmark dataset for this domain.", "Improved reproducibility and fair comparison with existing methods.", "Public datasets let other researchers reproduce results and compare methods on equal footing."),
    ("Optimizer", "Training Optimizer Not Reported", "Use AdamW as the training optimizer.", "More stable convergence and better generalization.", "AdamW is widely adopted in modern deep learning for stable convergence."),
    ("Loss Function", "Loss Function Not Reported", "Report and justify the loss function used for training.", "Improved transparency and reproducibility of the training procedure.", "The loss function materially affects convergence and results, and should be disclosed."),
    ("Hyperparameters", "Hyperparameter Selection Not Reported", "Use Bayesian Optimization or Optuna for hyperparameter search instead of manual tuning.", "Improved model performance and reproducibility.", "Manual hyperparameter selection is difficult to reproduce and often suboptimal."),
    ("Hardware", "Hardware/Compute Environment Not Reported", "Report the hardware and compute budget used (GPU/TPU type, memory, training time).", "Enables fair comparison of computational cost across methods.", "Compute cost is often as important as accuracy when judging practical applicability."),
    ("Evaluation Metrics", "Evaluation Metrics Not Reported", "Report standard evaluation metrics explicitly (Accuracy, Precision, Recall, F1-score).", "A more complete, comparable picture of model performance.", "Unreported evaluation criteria make it impossible to compare against other work."),
    (METRIC_FAMILY, "Weak or Missing Performance Metrics", "Evaluate the model using Accuracy, Precision, Recall, F1-score and ROC-AUC rather than a single metric.", "A more comprehensive, comparable evaluation that reveals failure modes a single metric hides.", "Recent research consistently reports multiple complementary metrics rather than accuracy alone."),
]

# Outcome codes and what they say.
STATUS_MESSAGES = {
    "success": "",
    "insufficient_evidence": "Related evidence was found, but not enough to report a confident result here. This is a valid outcome, not a failure.",
    "llm_unavailable": "No language model is configured - this section requires one and cannot run.",
    "daily_quota_exceeded": "The daily token quota is exhausted for today. This section will populate once the quota resets - no data was lost, and already-cached results are unaffected.",
    "retrieval_failure": "No relevant text could be retrieved from the selected paper(s) - they may only have an abstract available, or their PDF could not be downloaded.",
    "extraction_failure": "The AI extraction step failed or returned an unusable response. This is worth investigating further - check the application logs.",
    "invalid_input": "No valid papers were provided to analyze.",
}
NO_ABSTRACT = "No abstract available from the source API."
NO_CLAIMS = "The LLM call succeeded, but found no checkable scientific claims in the retrieved evidence for any selected paper - often because only an abstract was available."
NO_SHARED_TOPIC = "Claims were extracted successfully, but none discussed a similar enough topic across the selected papers to compare - a valid result, not a failure."
NO_EXTRACTED_CLAIMS = "No checkable scientific claims could be extracted from the selected papers."
NOTHING_TO_SAY = "Insufficient evidence to recommend an improved solution."
# Fields of the model's recommendations and improvements.
ADVICE = ["current_approach", "suggested_improvement", "why_better", "expected_benefit"]
IMPROVEMENT = ["problem", "current_observation", "suggested_improvement", "expected_benefit", "reason"]
NO_REASON = "AI relevance explanation unavailable (no LLM API key configured, or daily quota exhausted)."

_DATASET = BEST_PRACTICES[0][2]
_METRICS = BEST_PRACTICES[5][2]
# Fields of the final recommendation: name in the model's answer, label, category whose most common value comes second, default.
FINAL_FIELDS = [
    ("recommended_ai_technique", "Recommended AI Technique", "Most Used AI Technique", "Use the best-supported AI technique identified in the literature."),
    ("recommended_ai_model", "Recommended AI Model", "Most Used AI Model", "Select a model that is reproducible and supported by the reported evidence."),
    ("recommended_dataset", "Recommended Dataset", "Most Used Dataset", _DATASET),
    ("recommended_framework", "Recommended Framework", "Most Used Framework", "Use a reproducible, openly documented machine-learning framework."),
    ("recommended_evaluation_metrics", "Recommended Evaluation Metrics", "Most Used Evaluation Metric", _METRICS),
    ("recommended_experimental_setup", "Recommended Experimental Setup", None, "Report the dataset, train/test split, baselines, hardware, hyperparameters, training procedure, and evaluation protocol."),
    ("suggested_research_title", "Suggested Research Title", None, "Evidence-Grounded Research Innovation from Scientific Contradiction Analysis"),
    ("expected_advantages", "Expected Advantages", None, "Improved reproducibility, fairer comparison, and more complete evaluation than the currently reported approaches."),
    ("possible_risks", "Possible Risks", None, "Results may be affected by incomplete paper reporting, unavailable full text, API limitations, and domain shift."),
]
#: Fields whose most common value says nothing where no paper reports them: the coverage field that tells.
ALL_MISSING = {"Recommended Dataset": "Dataset", "Recommended Evaluation Metrics": "Evaluation Metrics"}


def practices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BEST_PRACTICES, "field string, problem string, improvement string, benefit string, reason string")


def best_practice_floor(coverage: DataFrame) -> DataFrame:
    """A row for every field that half of the papers or more miss. Seven templates: broadcast."""
    weak = coverage.where((F.col("total") > 0) & (F.col("missing") / F.col("total") >= 0.5))
    return weak.join(F.broadcast(practices(coverage.sparkSession)), "field").select("field", "problem", "improvement", "benefit", "reason", F.format_string("%d of %d papers", "missing", "total").alias("evidence"))


def floor_rows(coverage: DataFrame) -> DataFrame:
    """L4 in the columns of the improvement table."""
    said = F.format_string("%d of %d papers do not report this (%s).", "missing", "total", "field")
    weak = coverage.where((F.col("total") > 0) & (F.col("missing") / F.col("total") >= 0.5)).join(F.broadcast(practices(coverage.sparkSession)), "field")
    return weak.select("problem", said.alias("current_observation"), F.col("improvement").alias("suggested_improvement"), F.col("benefit").alias("expected_benefit"), "reason", F.lit(GENERAL_PRACTICE).alias("evidence"))


def verified_citations(cited: DataFrame, papers: DataFrame, title: str) -> DataFrame:
    """Citations of titles that exist, case-insensitively, with `known`, the title as it is written there."""
    own = papers.groupBy(F.lower(F.col(title)).alias("_k")).agg(F.min(title).alias("known"))
    return cited.join(own, F.lower(tx.strip(F.col("cited"))) == F.col("_k")).drop("_k")


def evidence(cited: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """Verified titles per row in the order of citation (column at), or the general practice."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "known"))), lambda x: x["known"])
    got = verified.groupBy(key).agg(F.array_join(listed, ", ").alias("evidence"))
    return cited.select(key).distinct().join(got, key, "left").fillna({"evidence": GENERAL_PRACTICE})


def final_recommendation(given: DataFrame, overall: DataFrame, coverage: DataFrame) -> DataFrame:
    """Field, value of the nine fields, in order `at`: the given value if usable, else the most common one of its
    category, else the default. Where no paper reports the field, or none was counted, the most common one does not count.

    given: key, given; overall: category, common; coverage: field, missing, total.
    """
    spark = given.sparkSession
    fields = spark.createDataFrame([(i, *f, ALL_MISSING.get(f[1])) for i, f in enumerate(FINAL_FIELDS)], "at int, key string, field string, category string, default string, told string")
    hidden = coverage.groupBy(F.col("field").alias("told")).agg(F.max(F.col("missing")).alias("m"), F.max(F.col("total")).alias("n"))
    made = fields.join(given.select("key", "given"), "key", "left").join(overall.groupBy("category").agg(F.first("common").alias("common")), "category", "left").join(hidden, "told", "left")
    gone = F.col("told").isNotNull() & (F.coalesce("m", F.lit(0)) == F.coalesce("n", F.lit(0)))
    value = tx.usable_or(F.col("given"), F.when(gone, F.col("default")).otherwise(tx.usable_or(F.col("common"), F.col("default"))))
    return made.select("at", "field", tx.strip(value).alias("value"))


def normalise_recommendation(rows: DataFrame, columns: list[str]) -> DataFrame:
    """L7."""
    return rows.select(*[F.coalesce(F.nullif(tx.strip(F.col(c)), F.lit("")), F.lit(NOT_REPORTED)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def context_json(rows: DataFrame, columns: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows as one JSON array."""
    top = rows.orderBy(*order).limit(most)
    return top.agg(F.to_json(F.array_agg(F.struct(*columns))).alias("context"))


def resolve_status(comparisons: Column, claim_status: Column) -> Column:
    """What came before decides, if it failed; an empty comparison of good claims lacks evidence."""
    return F.when(comparisons > 0, "success").when(claim_status != "success", claim_status).otherwise("insufficient_evidence")


def status_message(code: Column) -> Column:
    """L10."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_MESSAGES.items() for x in kv]), code)


def summary_fallback(abstract: Column) -> Column:
    """K2 without a model."""
    return F.when(F.coalesce(abstract, F.lit("")) == "", NO_ABSTRACT).otherwise(tx.truncate(abstract, 300))


def status_strip(rows: DataFrame) -> DataFrame:
    """totals of a validation report."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "VALID").alias("valid"), F.count_if(F.col("status") == "INVALID").alias("invalid"))
