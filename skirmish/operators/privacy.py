"""Personal-data scans of text, verdicts, and link harvest from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of personal data and secrets by category, and of placeholders.
PATTERNS = {
    "api_key": r"\b(?:RGAPI|sk|ghp|AKIA)[-_]?[A-Za-z0-9-]{16,}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b",
    "phone": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
    "token": r"\b[0-9a-f]{40}\b",
    "user_path": r"(?:/home/|/Users/|C:\\Users\\)[A-Za-z0-9._-]+",
    "uuid": r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
}
PLACEHOLDER = r"(?i)xxxx|name#tag|example@|noreply"


def pii_scan(docs: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, source, category, value, placeholder) for each find."""

    def finds(category: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(category).alias("category"), v.alias("value")))

    found = F.flatten(F.array(*[finds(c, p) for c, p in sorted((patterns or PATTERNS).items())]))
    rows = docs.where("text is not null").select("doc_id", "source", F.explode(found).alias("x")).select("doc_id", "source", "x.*")
    return rows.withColumn("placeholder", F.col("value").rlike(PLACEHOLDER))


def pii_verdict(findings: DataFrame) -> DataFrame:
    """By source and category: finds, real ones, and LEAKED, SUSPICIOUS or CLEAN; with one find, masked."""
    rows = findings.groupBy("source", "category").agg(F.count("*").alias("finds"), F.count_if(~F.col("placeholder")).alias("real"), F.min("value").alias("_v"))
    hard = F.col("category").isin("api_key", "token", "email")
    verdict = F.when((F.col("real") > 0) & hard, "LEAKED").when(F.col("real") > 0, "SUSPICIOUS").otherwise("CLEAN")
    return rows.select("source", "category", "finds", "real", verdict.alias("verdict"), F.concat(F.substring("_v", 1, 2), F.lit("***")).alias("sample"))


def raw_markers(docs: DataFrame, markers: list[str], least: int) -> DataFrame:
    """How often each marker stands in texts of at least ``least`` characters."""
    each = F.array(*[F.struct(F.lit(m).alias("marker"), F.regexp_count("text", F.lit(m)).alias("n")) for m in markers])
    return docs.where(F.length("text") >= least).select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.marker", F.col("x.n").cast("long").alias("n")).where("n > 0")


def extract_profile_slugs(pages: DataFrame, pattern: str, cap: int | None = None) -> DataFrame:
    """(slug, page_id, position): distinct links that match, where first seen; a cap if asked for."""
    rows = pages.where("html is not null").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("position", "slug"))
    rows = rows.groupBy("slug").agg(F.min(F.struct("page_id", "position")).alias("at")).select("slug", "at.page_id", "at.position")
    return rows.orderBy("page_id", "position", "slug").limit(cap) if cap else rows
