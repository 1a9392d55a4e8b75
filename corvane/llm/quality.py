"""Regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.textbatch import joined, mix, pieces, span_hashes, texts_of, word_edges

_CLASS = np.full(256, 8, np.uint8)  # other signs
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-", b"#$%&*|!<>=@^~\\{}[]_+/")):
    _CLASS[list(_chars)] = _i
_CLASS[0x80:] = 7
_CLASSES = 9
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True

#: Order of the statistics.
NAMES = (
    "log_words", "log_bytes_per_word", "word_length_spread", "lower", "upper", "digit", "newline", "stop", "sign", "high", "other",
    "short_words", "signed_words", "loud_words", "bare_words", "distinct_words", "repeated_pairs", "repeated_lines", "log_words_per_stop", "byte_entropy",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The log odds of a share, drawn in by one half count on either side."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _repeats(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: how many items, and how many different ones."""
    key = np.lexsort((hashes, doc))
    d, h = doc[key], hashes[key]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(doc, minlength=n), np.bincount(d[first], minlength=n)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics for each whole text; empty texts give the values of no words."""
    data, begins = joined(texts)
    n = len(texts)
    doc_of = np.repeat(np.arange(n), np.diff(begins))
    body = data[begins[0] :]
    kinds = np.bincount(doc_of * _CLASSES + _CLASS[body], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    kinds[:, 3] -= 1  # the blank after each text
    size = kinds.sum(1)
    by_byte = np.bincount(doc_of * 256 + body, minlength=n * 256).reshape(n, 256).astype(float)
    by_byte[:, 0x20] -= 1
    p = by_byte / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(1)

    starts, ends = word_edges(data)
    doc = np.searchsorted(begins, starts, "right") - 1
    lengths = (ends - starts).astype(float)
    words = np.bincount(doc, minlength=n).astype(float)
    mean = np.bincount(doc, lengths, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, lengths**2, n) / np.maximum(words, 1) - mean**2, 0))
    run = lambda k: np.concatenate([[0], np.cumsum(_CLASS[data] == k)])
    inside = {k: (r := run(k))[ends] - r[starts] for k in (0, 1, 6, 7)}
    letters = inside[0] + inside[1] + inside[7]
    count = lambda mask: np.bincount(doc[mask], minlength=n).astype(float)
    hashes = span_hashes(data, starts, ends)
    _, different = _repeats(doc, hashes, n)
    same = doc[1:] == doc[:-1]
    pairs, different_pairs = _repeats(doc[1:][same], mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same], n)
    rows = data.copy()
    rows[0] = rows[begins[1:] - 1] = 0x0A  # lines end with their texts
    ls, le = word_edges(rows, _LINE)
    lines, different_lines = _repeats(np.searchsorted(begins, ls, "right") - 1, span_hashes(rows, ls, le), n)
    stop = by_byte[:, ord(".")] + by_byte[:, ord("?")]
    columns = [
        np.log1p(words), np.log((size + 1) / (words + 1)), np.log1p(spread), *[_share(kinds[:, k], size) for k in (0, 1, 2, 4, 5, 6, 7, 8)],
        _share(count(lengths <= 3), words), _share(count(inside[6] > 0), words), _share(count((inside[1] > 1) & (inside[0] == 0)), words),
        _share(count(letters == 0), words), _share(different.astype(float), words), _share((pairs - different_pairs).astype(float), pairs.astype(float)),
        _share((lines - different_lines).astype(float), lines.astype(float)), np.log((words + 1) / (stop + 1)), entropy,
    ]
    return np.stack(columns, 1)


def with_statistics(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``x``, the statistics of the text, of every row.

    Null and empty texts have the statistics of nothing, which are numbers like others, so they get a
    score. A text of any length is held once, with about 60 bytes for each of its bytes; repeated
    rows are rows like others. Columns besides ``keep`` aren't read, whatever their names; one of
    ``keep`` must not be called ``x``. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text"):
            x = statistics(texts_of(piece, "_text"))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], rows], [*keep, "x"])

    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{ddl}, x array<double>")


@dataclass
class Model:
    """Class means, inverse Cholesky factors of the shrunk covariances, and what is constant in each log density."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    fallback: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of statistics."""
        if self.fallback is not None:
            return np.full(len(x), self.fallback)
        z = (x - self.centre) / self.scale
        logs = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def moments(labelled: DataFrame) -> dict[int, np.ndarray]:
    """For labels 0 and 1 of (y, x): the sum of [1 x][1 x]' over all rows, added up in Spark entry by entry."""
    d = len(NAMES) + 1
    rows, cols = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(-1, d - 1)
            one = np.concatenate([np.ones((len(x), 1)), x], 1)
            for k in (0, 1):
                total[k] += one[y == k].T @ one[y == k]
        for k in (0, 1):
            if total[k, 0, 0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k)), pa.array(rows), pa.array(cols), pa.array(total[k][rows, cols])], ["y", "i", "j", "v"])

    sums = labelled.select("y", "x").mapInArrow(run, "y long, i long, j long, v double").groupBy("y", "i", "j").agg(F.sum("v").alias("v"))
    out = {k: np.zeros((d, d)) for k in (0, 1)}
    for r in sums.collect():  # 2 x d x (d + 1) / 2 numbers, whatever the input
        out[r["y"]][r["i"], r["j"]] = out[r["y"]][r["j"], r["i"]] = r["v"]
    return out


def fit(labelled: DataFrame, to_pooled: float = 0.5, to_diagonal: float = 0.25) -> Model:
    """Fits on all rows of (y, x) with y 0 or 1; other labels and nulls don't count.

    Each class covariance is drawn by ``to_pooled`` towards the pooled one, itself drawn by
    ``to_diagonal`` towards its diagonal. If a class has fewer than two rows, every score is the
    share of label 1, drawn towards one half by one count on either side.
    """
    sums = moments(labelled.where(F.col("y").isin(0, 1)).select(F.col("y").cast("long").alias("y"), "x"))
    n = [sums[k][0, 0] for k in (0, 1)]
    d = len(NAMES)
    if min(n) < 2:
        return Model(np.zeros(d), np.ones(d), [], [], [], (n[1] + 1) / (sum(n) + 2))
    means = [sums[k][0, 1:] / n[k] for k in (0, 1)]
    within = [sums[k][1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * within[0] + n[1] * within[1]) / sum(n)
    scale, centre = np.sqrt(np.maximum(np.diag(pooled), 1e-9)), (means[0] + means[1]) / 2
    norm = np.outer(scale, scale)
    pooled = pooled / norm
    target = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    model = Model(centre, scale, [], [], [])
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - to_pooled) * within[k] / norm + to_pooled * target)
        model.means.append((means[k] - centre) / scale)
        model.factors.append(np.linalg.inv(lower))
        model.constants.append(float(np.log(n[k] / sum(n)) - np.log(np.diag(lower)).sum()))
    return model


def held_out(id_col: Column, modulus: int = 3, remainder: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id doesn't."""
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == remainder, F.lit(False))


def with_scores(stats: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and ``score`` of a table with statistics ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pc.list_flatten(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(model.scores(x))], [*keep, "score"])

    ddl = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep)
    return stats.select(*keep, "x").mapInArrow(run, f"{ddl}, score double")


def keep_good(df: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, unchanged, whose text scores ``threshold`` or more.

    Null and empty texts are scored too. All columns stay as they are, whatever their names; repeated
    rows have one fate. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            yield piece.filter(pa.array(model.scores(statistics(texts_of(piece, text_col))) >= threshold))

    return df.mapInArrow(run, df.schema)


def training_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(y, x) of the labelled documents outside the held-out fold. Repeated labels of one id count each time."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("_id")))
    return stats.join(known, F.col(id_col) == F.col("_id")).select("y", "x")
