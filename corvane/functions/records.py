"""Records to text: templates, dialogues, query variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T


def fields_to_text(df: DataFrame, fields: list[str], sep: str = "\n\n") -> Column:
    """The given fields that exist and hold something, joined."""
    have = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields if f in df.columns]
    return F.concat_ws(sep, *have)


def render(template: list[tuple[str, str | Column, str | None]], sep: str = "\n\n") -> Column:
    """Labelled parts of a record in one text; a part is (label, column, language of its code fence or None), empty ones are left out."""
    parts = []
    for label, column, fence in template:
        value = F.col(column) if isinstance(column, str) else column
        body = value if fence is None else F.concat(F.lit(f"```{fence}\n"), value, F.lit("\n```"))
        parts.append(F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: " if label else ""), body)))
    return F.concat_ws(sep, *parts)


SPEAKERS = {"user": "Human", "human": "Human", "assistant": "Assistant", "gpt": "Assistant"}


def flatten_turns(df: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One text for each conversation, turns in order, each after its speaker; a conversation's turns are bounded by nature."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv]), F.lower(role)), F.lit("System"))
    turns = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(name, F.lit(": "), F.coalesce(F.col(text), F.lit(""))).alias("t"))))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(turns, lambda x: x["t"]), "\n\n").alias("dialogue"))


def expand_queries(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, variant, query): the keyword form, parts, critical suffixes and claim forms of each query."""
    text = F.col(text_col)
    keyword = T.keyword_query(text)

    def named(name: str, queries: Column) -> Column:
        return F.transform(queries, lambda q: F.struct(F.lit(name).alias("variant"), q.alias("query")))

    variants = F.concat(
        named("keywords", F.when(keyword != "", F.array(keyword)).otherwise(F.array().cast("array<string>"))),
        named("part", T.subqueries(text)), named("critical", T.counter_queries(text)), named("claim", T.claim_queries(text)),
    )
    return df.select(id_col, F.explode(variants).alias("v")).select(id_col, "v.variant", "v.query")
