"""Scores of records about publications (title, abstract, year, citation_count, source, url, flags).

Years and citations may be dirty text; what isn't a finite number counts as absent. Scores take the
year they are made for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

# Weights, tiers and word lists.
CREDIBILITY = {"currency": 0.15, "relevance": 0.30, "authority": 0.20, "accuracy": 0.20, "purpose": 0.15}
SOURCE_TIERS = {
    "arxiv": 0.9, "arxiv_cs_ai": 0.9, "arxiv_cs_cl": 0.9, "arxiv_cs_ir": 0.9, "semantic_scholar": 0.9, "papers_with_code": 0.85, "openreview": 0.85, "acl_anthology": 0.9, "github": 0.5,
    "github_trending": 0.5, "pypi": 0.4, "pypi_new": 0.4, "hf_daily_papers": 0.6, "hacker_news": 0.3, "hn": 0.3, "reddit": 0.3, "blog": 0.3,
}
TRIAGE_TIERS = {
    "arxiv_cs_ai": 0.90, "arxiv_cs_cl": 0.80, "arxiv_cs_ir": 0.90, "arxiv_cs_se": 0.80, "arxiv_cs_lg": 0.85, "semantic_scholar": 0.90, "papers_with_code": 0.85, "openreview": 0.80, "acl_anthology": 0.85,
    "github_trending": 0.50, "pypi_new": 0.40, "hf_daily_papers": 0.75, "hacker_news": 0.30, "reddit": 0.25, "deepmind_blog": 0.60, "ms_research_blog": 0.60, "connected_papers": 0.70,
}
ACADEMIC_URLS = ("arxiv", "acl", "neurips", "openreview", "icml", "iclr", "aaai", "aclweb")
CODE_URLS = ("github", "pypi", "gitlab", "huggingface")
OPINION_URLS = ("blog", "medium", "substack", "wordpress", "dev.to")
SIGNAL_WORDS = ("novel", "state-of-the-art", "sota", "breakthrough", "surpass", "outperform", "self-improving", "self-learning", "retrieval augmented", "rag", "meta-learning", "evolutionary", "benchmark", "empirical")
METHOD_WORDS = ("systematic review", "meta-analysis", "survey", "framework", "methodology", "pipeline", "architecture", "ablation", "reproducible", "open source", "replication")
NOVELTY_WEIGHTS = {
    "self-improving": 0.08, "self-learning": 0.08, "retrieval augmented": 0.06, "rag": 0.06, "code generation": 0.05, "evolutionary": 0.05, "curriculum": 0.04, "meta-learning": 0.04,
    "reflection": 0.03, "corrective": 0.03, "adversarial": 0.03, "self-play": 0.03, "prompt optimization": 0.04, "quality diversity": 0.03,
}
TITLE_WORDS = ("breakthrough", "novel", "state-of-the-art", "sota", "surpass")


def whole(x: Column, default: int = 0) -> Column:
    """A dirty number as an integer; NaN, infinities, words and nulls give the default."""
    d = x.cast("string").try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < 1e15)
    return F.when(ok, F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d))).otherwise(default).cast("long")


def _tier(source: Column, tiers: dict[str, float], default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv]), source), F.lit(default))


def words(text: Column, low: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(\w{{{low},}})"), 1))


def credibility(query: Column, year: int) -> Column:
    """(currency, relevance, authority, accuracy, purpose, composite) of a record against a query."""
    y, cites = whole(F.col("year")), F.greatest(F.lit(0), whole(F.col("citation_count")))
    url = F.lower(F.coalesce("url", F.lit("")))
    asked = words(query)
    age = F.lit(year) - y
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    parts = {
        "currency": F.when(age <= 0, 1.0).when(age == 1, 0.85).when(age == 2, 0.7).when(age == 3, 0.5).when(age == 4, 0.3).otherwise(0.1),
        "relevance": F.coalesce(F.try_divide(F.size(F.array_intersect(asked, words(F.concat_ws(" ", "title", "abstract")))), F.size(asked)), F.lit(0.0)),
        "authority": F.least(F.lit(1.0), _tier(F.lower("source"), SOURCE_TIERS, 0.4) + F.least(F.lit(0.3), cites / 1000) + F.when(url.contains(".edu") | url.contains(".gov"), 0.1).when(url.contains(".org"), 0.05).otherwise(0.0)),
        "accuracy": 0.3 + flag("has_refs") * 0.3 + flag("has_code") * 0.2 + flag("peer_reviewed") * 0.2,
        "purpose": F.when(T.has_any(url, ACADEMIC_URLS), 0.9).when(T.has_any(url, CODE_URLS), 0.7).when(T.has_any(url, OPINION_URLS), 0.4).otherwise(0.5),
    }
    total = T.clamp(sum((v * CREDIBILITY[k] for k, v in parts.items()), F.lit(0.0)))
    return F.struct(*[F.round(T.clamp(v), 4).alias(k) for k, v in parts.items()], F.round(total, 4).alias("composite"))


def satellite_score(query: Column, year: int) -> Column:
    """The first, cheap score of triage."""
    cites = whole(F.col("citation_count"))
    age = F.greatest(F.lit(0), F.lit(year) - F.when(whole(F.col("year")) == 0, 2020).otherwise(whole(F.col("year"))))
    title = F.lower(F.coalesce("title", F.lit("")))
    both = F.concat(title, F.lit(" "), F.lower(F.substring(F.coalesce("abstract", F.lit("")), 1, 300)))
    asked = words(query, 3)
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, words(both, 3))), F.size(asked)), F.lit(0.0))
    score = F.greatest(F.lit(0.0), 0.25 - age * 0.06) + _tier(F.col("source"), TRIAGE_TIERS, 0.5) * 0.20
    score += F.least(F.lit(0.20), F.size(F.array_intersect(words(title, 3), F.array(*[F.lit(w) for w in SIGNAL_WORDS]))) * 0.07)
    score += F.least(F.lit(0.10), T.hits(both, METHOD_WORDS) * 0.04) + overlap * 0.15 + F.when(cites > 0, F.least(F.lit(0.10), cites / 500 * 0.10)).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def triage(papers: DataFrame, query: Column, year: int, low: float = 0.3, high: float = 0.5, deep: int = 5, score: Column | None = None) -> DataFrame:
    """Scores in two steps and the best few for a closer look; ``score`` is a costlier second score for survivors, else the first serves again."""
    first = papers.withColumn("satellite", satellite_score(query, year))
    second = F.when(F.col("satellite") >= low, F.col("satellite") if score is None else score)
    scored = first.withColumn("drone", second).withColumn("drone_pass", F.coalesce(F.col("drone") >= high, F.lit(False)))
    best = scored.where("drone_pass").orderBy(F.round("drone", 9).desc(), "paper_id").limit(deep).select("paper_id", F.lit(True).alias("deep_dive"))
    return scored.join(best, "paper_id", "left").withColumn("deep_dive", F.coalesce("deep_dive", F.lit(False))).withColumn("satellite_pass", F.col("satellite") >= low)


def record_key(title: Column, abstract: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit(":"), F.substring(F.coalesce(abstract, F.lit("")), 1, 200)), 256), 1, 16)


def novelty(papers: DataFrame, known: DataFrame, year: int, learned: DataFrame | None = None) -> DataFrame:
    """Novelty of records (paper_id, ...); 0 for a known key, and for all but the first record of one key.

    ``learned`` terms (term, weight), of which the 15 heaviest count, take the place of the fixed word weights.
    """
    keyed = papers.withColumn("key", record_key(F.col("title"), F.col("abstract")))
    seen = keyed.join(known.select("key").distinct().withColumn("known", F.lit(True)), "key", "left").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("paper_id")))
    y, cites = whole(F.col("year")), whole(F.col("citation_count"))
    age = F.greatest(F.lit(0), F.lit(year) - y)
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    if learned is None:
        weight = sum((F.when(text.contains(k), v).otherwise(0.0) for k, v in NOVELTY_WEIGHTS.items()), F.lit(0.0))
    else:
        weight = T.hits(text, [r["term"] for r in learned.orderBy(F.col("weight").desc(), "term").limit(15).collect()]) * 0.07
    months = F.greatest(F.lit(1), (F.lit(year) - y) * 12 + 6)
    velocity = F.when((y >= year - 1) & (cites > 0), F.least(F.lit(0.2), cites / months * 0.02)).when(cites > 50, 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 0.3 - age * 0.1) + F.least(F.lit(0.4), weight) + velocity + F.when(T.has_any(F.lower("title"), TITLE_WORDS), 0.05).otherwise(0.0)
    fresh = F.col("known").isNull() & (F.col("nth") == 1)
    return seen.select("paper_id", "key", F.when(fresh, F.least(F.lit(1.0), score)).otherwise(0.0).alias("novelty"))


def weigh(evidence: DataFrame, year: int) -> DataFrame:
    """Weights of the sources of each claim (claim, composite, year, citation_count, relevance) that add up to 1; equal ones if all are 0."""
    y = F.when(whole(F.col("year")) == 0, year).otherwise(whole(F.col("year")))
    raw = F.col("composite") * F.greatest(F.lit(0.1), 1.0 - (F.lit(year) - y) * 0.15) * F.least(F.lit(1.5), 1.0 + F.greatest(F.lit(0), whole(F.col("citation_count"))) / 500)
    of = Window.partitionBy("claim")
    e = evidence.withColumn("_raw", raw).withColumn("_total", F.sum("_raw").over(of)).withColumn("_n", F.count(F.lit(1)).over(of))
    return e.withColumn("weight", F.when(F.col("_total") > 0, F.col("_raw") / F.col("_total")).otherwise(1 / F.col("_n"))).drop("_raw", "_total", "_n")


def weighted_claims(weighed: DataFrame) -> DataFrame:
    return weighed.groupBy("claim").agg(F.sum(F.col("weight") * F.col("composite")).alias("confidence"), F.avg((F.col("relevance") > 0.5).cast("double")).alias("agreement"))


def evidence_summary(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count(F.lit(1)).alias("claims"), F.avg("confidence").alias("confidence"), F.count_if(F.col("confidence") > 0.7).alias("high"), F.count_if(F.col("agreement") < 0.6).alias("contested"))
