"""Comments of code, plain manuals to markdown, nested settings, and an English filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

# Frequent words that tell four languages apart.
FREQUENT = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "are", "this", "from", "on", "by"),
    "de": ("der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "nicht", "ein", "eine", "auf", "dem"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "pour", "sur", "est"),
    "es": ("el", "los", "las", "de", "y", "que", "en", "un", "una", "por", "con", "para", "del", "se", "al", "su"),
}


def english_or_unknown(text: Column, threshold: float = 0.8) -> Column:
    """False if a language other than English has ``threshold`` or more of the hits on frequent words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)
    hits = {g: F.size(F.filter(words, _among(v))) for g, v in FREQUENT.items()}
    total = sum(hits.values(), F.lit(0))
    other = F.greatest(*[h for g, h in hits.items() if g != "en"])
    return F.when(text.isNull() | (F.trim(text) == ""), False).otherwise(F.coalesce(F.try_divide(other, total) < threshold, F.lit(True)))


def _among(values):
    def test(w: Column) -> Column:
        return w.isin(*values)

    return test


def comments(code: Column, most: int = 200) -> Column:
    """Line and block comments and docstrings after definitions, without markup, English or unknown, the first ``most``."""
    found = F.concat(
        F.regexp_extract_all(code, F.lit(r"(?m)(?:^|\s)//\s*(.+)$"), 1), F.regexp_extract_all(code, F.lit(r"(?m)(?:^|\s)#\s*(.+)$"), 1),
        F.regexp_extract_all(code, F.lit(r"(?s)/\*+(.*?)\*/"), 1), F.regexp_extract_all(code, F.lit(r'(?s)(?:def|class)\s[^\n]*:\s*"""(.*?)"""'), 1),
    )
    clean = F.filter(F.transform(found, T.strip_markup), lambda x: (x != "") & english_or_unknown(x))
    return F.slice(F.array_distinct(clean), 1, most)


def text_to_markdown(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, markdown): page footers and headers dropped, numbered or underlined headings marked. Lines are told apart by a window over one document."""
    lines = df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "l"))
    w = Window.partitionBy(id_col).orderBy("line")
    lines = lines.withColumn("next", F.lead("l").over(w))
    footer = F.col("l").rlike(r"^\S.*\[Page \d+\]\s*$|^RFC \d+\s.*\d{4}\s*$|^\f")
    underline = F.col("l").rlike(r"^([=\-~])\1{2,}\s*$")
    numbered = F.regexp_extract("l", r"^((?:\d+\.)+)\s+\S", 1)
    depth = F.size(F.split(F.regexp_replace(numbered, r"\.$", ""), r"\."))
    shown = (
        F.when(footer | underline, F.lit(None)).when(F.coalesce("next", F.lit("")).rlike(r"^={3,}\s*$") & F.col("l").rlike(r"^\S"), F.concat(F.lit("# "), F.trim("l")))
        .when(F.coalesce("next", F.lit("")).rlike(r"^-{3,}\s*$") & F.col("l").rlike(r"^\S"), F.concat(F.lit("## "), F.trim("l")))
        .when(numbered != "", F.concat(F.repeat(F.lit("#"), depth + 1), F.lit(" "), F.trim("l"))).otherwise(F.col("l"))
    )
    kept = lines.select(id_col, "line", shown.alias("m")).where("m IS NOT NULL")
    return kept.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "m"))), lambda x: x["m"]), "\n").alias("markdown"))


def config_features(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, feature, value): settings of a JSON object as numbers; truth is 1 or 0, texts and lists count their length."""
    pairs = df.select(id_col, F.explode(F.from_json(json_col, "map<string,string>")).alias("feature", "v"))
    number = F.col("v").try_cast("double")
    value = F.when(F.lower("v").isin("true", "false"), (F.lower("v") == "true").cast("double")).when(number.isNotNull(), number).when(F.col("v").startswith("["), F.json_array_length("v").cast("double")).otherwise(F.length("v").cast("double"))
    return pairs.select(id_col, "feature", value.alias("value"))
