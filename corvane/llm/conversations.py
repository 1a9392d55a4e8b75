"""Conversation repair: cheapest edits to a legal order of roles, by a rank-convergence parallel Viterbi over chunks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.plans.ranking import global_rank
from corvane.plans.scratch import cut

#: Rows of a chunk.
CHUNK = 256
#: White space of the rules; all else counts as content.
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States: nothing yet, after s, after u, after a. Roles must spell (s?(ua)+)?, so 0 and 3 may end.
#: Where an inserted or rerolled row leads from each state, and its role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Where a row leads that is kept: by the initial of its role, from each state; -1: it can't be kept.
KEPT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "x": (-1, -1, -1, -1)}
#: Costs from the end of a conversation: what must be inserted there.
END = [0, 2 * INSERT, INSERT, 0]
#: What a chunk starts from that doesn't know what follows.
GUESS = [0, 0, 0, 0]


# --- damage, as the query asks for ---


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with some rows dropped, emptied, without stops, repeated, or of role user, by the checksum of ``conv_id:turn``; nulls in text and role become a space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))), F.lit(20))
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(word("role"))
    made = df.select("conv_id", "turn", "role", "text", code.alias("_code")).where("_code <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "_code")
    return made.withColumn("_copy", F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_code", "_copy")


# --- costs ---


def backward(codes: str, right: list[int]) -> list[list[int]]:
    """Costs from every row of a chunk to the end, for each state, given those behind its last row.

    A code is b or d for a row that must go, else s, u, a or x for its role's initial, in upper case if the text is cut off.
    """
    out = [list(right)]
    for code in reversed(codes):
        after = out[-1]
        if code in "bd":
            out.append([x + DELETE for x in after])
            continue
        kept, extra = KEPT[code.lower()], TRUNCATED if code.isupper() else 0
        own = [min(after[s] + DELETE, after[NEXT[s]] + REROLE + extra, *([after[kept[s]] + extra] if kept[s] >= 0 else [])) for s in range(4)]
        out.append(closed(own))
    return out[::-1]


def closed(own: list[int]) -> list[int]:
    """Costs with insertions before the next row allowed."""
    two, three = min(own[2], own[3] + INSERT), min(own[3], own[2] + INSERT)
    return [min(own[0], two + INSERT), min(own[1], two + INSERT), two, three]


def parallel(a: list[int], b: list[int]) -> bool:
    """Whether two cost vectors differ by a constant only."""
    return len({x - y for x, y in zip(a, b, strict=True)}) == 1


def _relaxed(state: DataFrame) -> DataFrame:
    """One pass over chunks (conv, stretch, chunk, codes, right, left, incoming), the last of a stretch first.

    A chunk that has no ``left`` yet, or whose right side differs from what comes in by more than a
    constant, is run. What comes in is its successor's left side, of this pass if that is in the
    same stretch, else of the pass before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple = (None, None, None, None)
        for batch in batches:
            rights, lefts = [], []
            for conv, stretch, chunk, codes, right, left, incoming in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before[:3] == (conv, stretch, chunk + 1):
                    incoming = before[3]
                if left is None or (incoming is not None and not parallel(incoming, right)):
                    right = incoming or right
                    left = backward(codes, right)[0]
                before = (conv, stretch, chunk, left)
                rights.append(right)
                lefts.append(left)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rights, kind), pa.array(lefts, kind)], [*batch.schema.names[:4], "right", "left"])

    ddl = f"conv {state.schema['conv'].dataType.simpleString()}, stretch long, chunk long, codes string, right array<long>, left array<long>"
    return state.select("conv", "stretch", "chunk", "codes", "right", "left", "incoming").mapInArrow(run, ddl)


def stitched(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, codes, right): for each chunk (conv, chunk, codes), costs behind its last row, right up to a constant.

    All chunks run at once, the last of a conversation from the true end, others from a guess. Then
    each compares what it started from with what its successor arrived at; where they differ by
    more than a constant it runs again, until none does. Costs that differ by a constant lead to the
    same edits. In pass p, stretches of 2^p chunks hand their vectors on within one task, so a chain
    of chunks on which vectors don't converge is done after a logarithmic number of passes.
    Every pass is written to the shared folder; it holds one code a row, no text.
    """
    end, guess = (F.array(*[F.lit(x).cast("long") for x in v]) for v in (END, GUESS))
    follows = chunks.where("chunk > 0").select(F.col("conv").alias("_c"), (F.col("chunk") - 1).alias("_n"), F.lit(True).alias("more"))
    at = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_n"))
    state = chunks.join(follows, at, "left").select("conv", F.col("chunk").alias("stretch"), "chunk", "codes", F.when(F.coalesce("more", F.lit(False)), guess).otherwise(end).alias("right"))
    none = F.lit(None).cast("array<long>")
    state = cut(_relaxed(state.withColumns({"left": none, "incoming": none})), "chunk_costs")
    alone = state.groupBy("conv").agg(F.max("chunk").alias("m")).where("m = 0").select(F.col("conv").alias("_c"))
    long = cut(state.join(alone, F.col("conv").eqNullSafe(F.col("_c")), "left_anti"), "chunk_chains")
    short = state.join(alone, F.col("conv").eqNullSafe(F.col("_c")), "left_semi")
    width = 2
    while True:
        lefts = long.select(F.col("conv").alias("_c"), (F.col("chunk") - 1).alias("_n"), F.col("left").alias("incoming"))
        seen = long.drop("incoming").join(lefts, at, "left").select("conv", "chunk", "codes", "right", "left", "incoming")
        seen = cut(seen, "chunk_seen")
        if seen.where(F.size(F.array_distinct(F.zip_with("right", "incoming", lambda x, y: x - y))) > 1).isEmpty():
            break
        dealt = seen.withColumn("stretch", F.floor(F.col("chunk") / width).cast("long")).repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", F.col("chunk").desc())
        long = cut(_relaxed(dealt), "chunk_costs")
        width *= 2
    return short.select("conv", "chunk", "codes", "right").unionByName(long.select("conv", "chunk", "codes", "right"))


# --- edits ---


class _Walk:
    """Counts, edits and digest of one conversation whose rows come in order, chunk by chunk."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.cost, self.illegal = conv, 0, 0, 0
        self.turns, self.turn, self.first, self.initial = 0, None, None, None
        self.seen, self.audit, self.hash, self.any = {"b": 0, "d": 0, "t": 0}, [], hashlib.sha256(), False
        self.codes, self.costs, self.at = "", [], 0

    def chunk(self, codes: str, right: list[int]) -> None:
        self.codes, self.costs, self.at = codes, backward(codes, right), 0

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def _insert(self) -> None:
        self._put(ROLE[self.state], "")
        self.audit.append("I")
        self.state, self.cost = NEXT[self.state], self.cost + INSERT

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.first, self.turn = (turn if self.first is None else self.first), turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        code, here, after = self.codes[self.at], self.costs[self.at], self.costs[self.at + 1]
        self.seen["t" if code.isupper() else code] = self.seen.get("t" if code.isupper() else code, 0) + 1
        extra, kept = TRUNCATED if code.isupper() else 0, KEPT.get(code.lower(), KEPT["x"])
        while True:  # the least letter among the cheapest: D, I, K, R
            s = self.state
            if after[s] + DELETE == here[s]:
                self.audit.append("D")
                self.cost += DELETE
                break
            if here[NEXT[s]] + INSERT == here[s]:
                self._insert()
                continue
            if kept[s] >= 0 and after[kept[s]] + extra == here[s]:
                self.audit.append("K")
                self._put(role, text)
                self.state, self.cost = kept[s], self.cost + extra
                break
            self.audit.append("R")
            self._put(ROLE[s], text)
            self.state, self.cost = NEXT[s], self.cost + REROLE + extra
            break
        self.at += 1

    def result(self) -> tuple:
        while END[self.state]:
            self._insert()
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.seen["b"], self.seen["d"], self.seen["t"], int(self.illegal), self.cost, "".join(self.audit), self.hash.hexdigest()


def repair(df: DataFrame, original: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation in ``original``, from the rows of ``df``.

    Rows are taken by turn, nulls first; of one turn, by role and text. A row is blank, else a
    duplicate of an earlier one, else cut off, else sound. Edits cost: keep 0 (K), rerole to user or
    assistant 3 (R), delete 4 (D), which blank rows and duplicates need, insert an empty user or
    assistant row 3 (I); a row that is cut off and stays adds 3. Of the cheapest edits to roles that
    spell (s?(ua)+)? the least audit in ASCII order is taken; it decides the repaired rows, whose
    ``role:text`` lines are digested.

    Rows are numbered by a range sort, so one long conversation lies in many tasks; chunks of
    ``chunk`` rows find their costs at once (``stitched``). First occurrences of (role, text) are
    found by digest and least number, with no join on a hot key. The last step streams each
    conversation through one task in order, as a digest over all its rows asks for: it holds a chunk
    of costs, a batch of rows, the hash state and the audit, which is a string of the result.

    Null texts and roles are one space. A role that is empty or has another initial than s, u or a
    can't stay. Null conversation ids are one conversation. A conversation without rows in ``df`` has
    zeros, an empty audit and the digest of nothing; empty tables give an empty one. Repeated rows
    are duplicates. A very long text is held once, in its batch. Other columns are not read.
    """
    word = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), word(role_col).alias("role"), word(text_col).alias("text"))
    ranked = global_rank(rows, [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], "nth", ["conv"])
    ranked = cut(ranked.withColumn("chunk", F.floor(F.col("nth") / chunk).cast("long")), "turns")

    solid = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    stop = F.substring(solid, -1, 1).isin(".", "!", "?")
    code = F.when(solid == "", "b").when(stop, letter).otherwise(F.upper(letter))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    narrow = cut(ranked.select("conv", "chunk", "nth", code.alias("code"), said.alias("said")), "turn_codes")
    first = narrow.groupBy("conv", "said").agg(F.min("nth").alias("nth")).select(F.col("conv").alias("_c"), F.col("nth").alias("_n"))
    marked = narrow.join(first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("nth") == F.col("_n")), "left")
    coded = marked.select("conv", "chunk", "nth", F.when((F.col("code") == "b") | F.col("_n").isNotNull(), F.col("code")).otherwise("d").alias("code"))
    strings = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "code"))), lambda x: x["code"]), "")
    chunks = cut(coded.groupBy("conv", "chunk").agg(strings.alias("codes")), "chunks")
    costs = stitched(chunks)

    null = lambda kind: F.lit(None).cast(kind)
    all_ = original.select(F.col(conv_col).alias("conv")).distinct()
    stream = (
        ranked.select("conv", "chunk", "nth", "turn", "role", "text", null("string").alias("codes"), null("array<long>").alias("right"))
        .unionByName(costs.select("conv", "chunk", F.lit(-1).cast("long").alias("nth"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), "codes", "right"))
        .unionByName(all_.select("conv", F.lit(-1).cast("long").alias("chunk"), F.lit(-1).cast("long").alias("nth"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), null("string").alias("codes"), null("array<long>").alias("right")))
    )
    kind = rows.schema["conv"].dataType
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: _Walk | None = None
        for batch in batches:
            done = []
            for conv, at, nth, turn, role, text, codes, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at < 0:  # a conversation begins
                    if walk:
                        done.append(walk.result())
                    walk = _Walk(conv)
                elif nth < 0:
                    walk.chunk(codes, right)
                else:
                    walk.row(turn, role, text)
            yield _table(done)
        yield _table([walk.result()] if walk else [])

    def _table(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], ["conv", *names])

    dealt = stream.repartition("conv").sortWithinPartitions("conv", "chunk", "nth")
    ddl = f"conv {kind.simpleString()}, {', '.join(f'{n} long' for n in names[:6])}, audit string, repaired_sha256 string"
    return dealt.mapInArrow(run, ddl).select(F.col("conv").alias(conv_col), *names)
