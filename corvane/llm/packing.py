"""Length buckets with the least padding, and batches under a token budget inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.plans.ranking import global_rank
from corvane.plans.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, and one for its end; a null text counts as empty."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """Upper bounds of at most ``k`` buckets over the sorted ``lengths`` that pad the fewest tokens.

    Exact dynamic programming over all distinct lengths: with C and S the running counts and token
    sums, best[j] = min over i of prev[i] + L_j (C_j - C_i) - (S_j - S_i). For a fixed i this is a
    line in L_j, and slopes fall as i grows, so a pointer along the lower hull finds each layer in
    linear time. Of equal choices the smallest i wins. Numbers stay Python integers.
    """
    m = len(lengths)
    if m <= k:
        return list(lengths)
    total, tokens = [0], [0]
    for size, n in zip(lengths, counts, strict=True):
        total.append(total[-1] + n)
        tokens.append(tokens[-1] + size * n)
    prev: list[int | None] = [0] + [None] * m
    back: list[list[int]] = []
    for _ in range(k):
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i)
        best: list[int | None] = [None] * (m + 1)
        choice, at = [0] * (m + 1), 0
        for j in range(1, m + 1):
            if prev[j - 1] is not None:
                new = (-total[j - 1], prev[j - 1] + tokens[j - 1], j - 1)
                while len(hull) > at + 1 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - new[0]) > (new[1] - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append(new)
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            if at < len(hull):
                slope, start, i = hull[at]
                best[j], choice[j] = slope * x + start + x * total[j] - tokens[j], i
        back.append(choice)
        prev = best
    bounds, j = [], m
    for choice in reversed(back):
        bounds.append(lengths[j - 1])
        j = choice[j]
    return bounds[::-1]


def pack(df: DataFrame, k: int = 8, budget: int = 16_384, id_col: str = "doc_id", length: Column | None = None) -> DataFrame:
    """Places every row in a length bucket, a batch and a slot of the batch.

    Bucket bounds minimise the padding of all rows together: the histogram of the whole table is
    gathered (one row for each distinct length; D distinct lengths need D^2 / 2 tokens, so there
    are at most sqrt(2 x tokens) of them) and cut by dynamic programming. In a bucket of padded
    length p, rows in the order of length and id fill batches of max(1, budget // p) rows; a row
    longer than the budget is a batch of its own. Only the id and the length are sorted, by range,
    so a bucket that holds a third of all rows is spread over tasks.

    ``length`` defaults to the words of ``text``, which stand for its tokens, plus one end token; give the counts of a tokenizer where there are any. Null and empty texts have
    length 1. Rows alike in length and id (null ids first) share their places in any order. An
    empty table stays empty. Columns: id_col, n_tokens, bucket, bucket_len, batch, slot, pad.
    """
    length = word_count(F.col("text")) if length is None else length
    sized = cut(df.select(F.col(id_col), length.cast("long").alias("n_tokens")), "lengths")  # texts are read once
    histogram = sorted((r["n_tokens"], r["n"]) for r in sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = best_boundaries([x for x, _ in histogram], [n for _, n in histogram], k)
    return batches(sized, bounds, budget, id_col)


def batches(sized: DataFrame, bounds: list[int], budget: int, id_col: str = "doc_id") -> DataFrame:
    """``pack`` for given bucket bounds; every length must be within the last of them."""
    upper = F.array(*[F.lit(int(b)).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(upper, lambda b: b < F.col("n_tokens"))).cast("int")
    placed = sized.withColumn("bucket", bucket)
    ranked = global_rank(placed, [F.col("n_tokens").asc(), F.col(id_col).asc_nulls_first()], "_rank", ["bucket"])
    ranked = ranked.withColumn("bucket_len", F.element_at(upper, F.col("bucket") + 1))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")))
    return ranked.select(
        id_col, "n_tokens", "bucket", "bucket_len", F.floor(F.col("_rank") / room).cast("long").alias("batch"),
        F.pmod("_rank", room).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("pad"),
    )


def oracle(k: int = 8, budget: int = 16_384) -> str:
    """The same buckets and batches in SQL: one step of the dynamic programme a layer."""
    layers = ",\n".join(
        f"""d{t} AS (SELECT h.j, min(p.best + h.len * (h.c - p.c) - (h.s - p.s)) AS best,
          arg_min(p.j, (p.best + h.len * (h.c - p.c) - (h.s - p.s)) * 1000000 + p.j) AS i, any_value(h.len) AS len, any_value(h.c) AS c, any_value(h.s) AS s
          FROM h JOIN {f"d{t - 1}" if t > 1 else "d0"} p ON p.j < h.j GROUP BY h.j)"""
        for t in range(1, k + 1)
    )
    path = f"b{k} AS (SELECT len, i FROM d{k} ORDER BY j DESC LIMIT 1)" + "".join(
        f",\nb{t} AS (SELECT d.len, d.i FROM d{t} d JOIN b{t + 1} n ON d.j = n.i)" for t in range(k - 1, 0, -1)
    )
    picked = " UNION ALL ".join(f"SELECT len FROM b{t}" for t in range(1, k + 1))
    return f"""WITH sized AS (
      SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS BIGINT) AS n_tokens FROM documents),
    hist AS (SELECT n_tokens AS len, count(*) AS n FROM sized GROUP BY 1),
    h AS (SELECT len, row_number() OVER (ORDER BY len) AS j, CAST(sum(n) OVER (ORDER BY len) AS BIGINT) AS c,
          CAST(sum(n * len) OVER (ORDER BY len) AS BIGINT) AS s FROM hist),
    d0 AS (SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS best, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS s),
    {layers},
    {path},
    bounds AS (SELECT len, row_number() OVER (ORDER BY len) - 1 AS bucket FROM ({picked})),
    placed AS (SELECT s.doc_id, s.n_tokens, min(b.bucket) AS bucket, min(b.len) AS bucket_len
               FROM sized s JOIN bounds b ON b.len >= s.n_tokens GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n_tokens, doc_id) - 1 AS r,
               greatest(1, {budget} // bucket_len) AS room FROM placed)
    SELECT doc_id, n_tokens, CAST(bucket AS INTEGER) AS bucket, bucket_len, CAST(r // room AS BIGINT) AS batch,
           CAST(r % room AS BIGINT) AS slot, bucket_len - n_tokens AS pad FROM ranked"""
