"""Page and document triage: whether a text layer can be used, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

#: Thresholds of the rules, and the order of strategies and confidences in reports.
LEAST_CHARS, IMAGE_SHARE, INDIC_SHARE, ENGLISH_RATE, FAULT_RATE, CONSENSUS = 32, 0.5, 0.5, 0.12, 1.0, 0.8
STRATEGY_RANK = {"unicode-text": 0, "scanned": 1, "broken-encoding": 2, "legacy-text": 3, "mixed": 4, "unknown": 5}
CANDIDATE_RANK = {"unicode-text": 0, "legacy-text": 1, "broken-encoding": 2, "scanned": 3, "mixed": 4, "unknown": 5}
CONFIDENCE_RANK = {"high": 0, "medium": 1, "low": 2}
LEAST_SAMPLED = 3
LEGACY_FAMILIES = (
    "shreeguj", "shreelipi", "gopika", "terafont", "lmg", "avantika", "bhashabharti", "saumil", "ekatra", "gujaratitimes",
    "gujaratisaral", "harikrishna", "ghanshyam", "sulekh", "vakil", "akshargujarati", "krutidev", "devlys", "chanakya", "aps-dv",
    "apsdv", "shreedev", "kiran", "yogeshweb", "walkman",
)
PLAIN_ENCODINGS = ("WinAnsiEncoding", "MacRomanEncoding", "MacExpertEncoding", "StandardEncoding", "PDFDocEncoding")


def strategy(profile: Column, image_share: Column, english_rate: Column, faults: Column) -> Column:
    """The strategy of a page: rules in order."""
    indic = profile["dominant"].isin("gujr", "deva") & (profile["share"] >= INDIC_SHARE)
    return (
        F.when(image_share >= IMAGE_SHARE, "scanned")
        .when(profile["total"] < LEAST_CHARS, "blank")
        .when(indic, F.when(faults > FAULT_RATE, "broken-encoding").otherwise("unicode-text"))
        .when((profile["dominant"] == "latn") & (english_rate >= ENGLISH_RATE), "unicode-text")
        .otherwise("legacy-text")
    )


def classify_pages(pages: DataFrame, text: str = "text", image_share: str | None = None) -> DataFrame:
    """Adds chars, dominant, share, english_rate, fault_rate and strategy to pages; the text is read a few times, nothing is shuffled."""
    col = F.coalesce(F.col(text), F.lit(""))
    faults = F.when(F.col("_p.dominant") == "gujr", t.orthography(col, "gujr")["rate"]).when(F.col("_p.dominant") == "deva", t.orthography(col, "deva")["rate"]).otherwise(0.0)
    english = F.when(F.col("_p.dominant") == "latn", t.english_word_rate(col)).otherwise(0.0)
    share = F.col(image_share) if image_share else F.lit(0.0)
    out = pages.withColumn("_p", t.script_profile(col)).withColumn("english_rate", english).withColumn("fault_rate", faults)
    out = out.withColumn("strategy", strategy(F.col("_p"), share, F.col("english_rate"), F.col("fault_rate")))
    return out.withColumn("chars", F.col("_p.total")).withColumn("dominant", F.col("_p.dominant")).withColumn("share", F.col("_p.share")).drop("_p")


def triage_documents(pages: DataFrame, group: list[str], order: str) -> DataFrame:
    """The verdict of each document over its pages (strategy): the leading strategy if it holds 80 % of the pages that aren't blank."""
    tally = pages.groupBy(*group, "strategy").agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    sums = tally.groupBy(*group).agg(F.sum("n").alias("pages"), F.sum(F.when(F.col("strategy") != "blank", F.col("n")).otherwise(0)).alias("evidence"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "seen")
    lead = tally.where("strategy <> 'blank'").withColumn("r", F.row_number().over(w)).where("r = 1").select(*group, F.col("strategy").alias("lead_strategy"), F.col("n").alias("lead_pages"))
    out = sums.join(lead, group, "left")
    verdict = F.when(F.col("evidence") == 0, "unknown").when(F.col("lead_pages") / F.col("evidence") >= CONSENSUS, F.col("lead_strategy")).otherwise("mixed")
    return out.withColumn("verdict", verdict).withColumn("needs_ocr", F.col("verdict") != "unicode-text")


def legacy_families(name: Column) -> Column:
    """The legacy font families that a font's name shows."""
    folded = F.regexp_replace(F.lower(name), "[\\s_.]", "")
    return F.filter(F.array(*map(F.lit, LEGACY_FAMILIES)), lambda f: F.contains(folded, f))


def unmappable(used: Column, has_map: Column, encoding: Column) -> Column:
    """Fonts in use whose codes can't be read as characters."""
    return used & ~has_map & (encoding.isNull() | ~encoding.isin(*PLAIN_ENCODINGS))


def inventory_summary(verdicts: DataFrame) -> DataFrame:
    """One row: documents by verdict (zero where there is none), those that need recognition, and all."""
    return verdicts.agg(*(F.count_if(F.col("verdict") == s).alias(f"n_{s.replace('-', '_')}") for s in STRATEGY_RANK), F.count_if("needs_ocr").alias("needing_ocr"), F.count("*").alias("total"))


def confidence_of(verdict: Column, consensus: Column, sampled: Column, corroborated: Column) -> Column:
    """How sure a verdict is: high where all sampled pages agree (a legacy text needs a legacy font too), medium from the consensus share on."""
    return (
        F.when(verdict.isin("mixed", "unknown") | (sampled < LEAST_SAMPLED), "low")
        .when((consensus == 1) & ((verdict != "legacy-text") | corroborated), "high")
        .when(consensus >= CONSENSUS, "medium")
        .otherwise("low")
    )


def rank_candidates(verdicts: DataFrame, key: str) -> DataFrame:
    """Documents (verdict, confidence, pages) by how soon they can be worked on: strategy, confidence, then fewest pages; unknown ones are left out."""
    rank = F.create_map(*(F.lit(x) for kv in CANDIDATE_RANK.items() for x in kv))
    sure = F.create_map(*(F.lit(x) for kv in CONFIDENCE_RANK.items() for x in kv))
    rows = verdicts.where("verdict <> 'unknown'").withColumn("rank", rank[F.col("verdict")]).withColumn("confidence_rank", sure[F.col("confidence")])
    return rows.orderBy("rank", "confidence_rank", F.col("pages").asc_nulls_last(), key)
