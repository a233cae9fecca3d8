"""The query router: how specific a query is, how clear a probe of the index is, and the tier that follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as T


@dataclass(frozen=True)
class Thresholds:
    specificity: float = 3.5
    margin: float = 0.08
    entropy: float = 1.3
    temperature: float = 0.15


def tier(specificity: Column, margin: Column, entropy: Column, t: Thresholds = Thresholds()) -> Column:
    direct = (specificity >= t.specificity) | ((margin >= t.margin) & (entropy <= t.entropy))
    return F.when(direct, F.lit("direct")).when((entropy > t.entropy) & (margin < t.margin), F.lit("hyde")).otherwise(F.lit("multi_query"))


def probe_scores(hits: DataFrame, probe: int = 5) -> DataFrame:
    """qid, scores: the best ``probe`` scores of each query, falling."""
    best = hits.where(F.col("rank") <= probe).groupBy("qid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    return best


def route(queries: DataFrame, hits: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``queries``: qid, query. Returns the decision of each with its reason; no model is called here."""
    found = queries.join(probe_scores(hits), "qid", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<double>")))
    found = found.withColumn("specificity_score", T.specificity("query")).withColumn("score_margin", T.probe_margin(F.col("scores"))).withColumn("entropy", T.probe_entropy(F.col("scores"), t.temperature))
    s, m, e = F.col("specificity_score"), F.col("score_margin"), F.col("entropy")
    found = found.withColumn("tier", tier(s, m, e, t))
    reason = (
        F.when(F.col("tier") == "direct", F.format_string("High query specificity (%.2f) or strong probe confidence (margin=%.2f, entropy=%.2f).", s, m, e))
        .when(F.col("tier") == "hyde", F.format_string("High retrieval ambiguity (entropy=%.2f, margin=%.2f). Generating synthetic HyDE passage.", e, m))
        .otherwise(F.format_string("Moderate query complexity (%.2f). Expanding into sub-queries.", s))
    )
    return found.select("qid", "query", "tier", "specificity_score", "score_margin", "entropy", reason.alias("reason"))


def sub_queries(text: Column, most: int = 3) -> Column:
    """Lines of a model's reply without blanks and numbering."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")
    return F.slice(F.transform(lines, lambda x: F.regexp_replace(x, r"^\d+[.)]\s*", "")), 1, most)
