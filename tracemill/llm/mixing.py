"""Mixing sources to target weights, by entropy balancing.

Every document starts with one use. The uses that come closest to that, by
relative entropy, while each source makes up its share of all tokens, are
exponential in the document's tokens: exp(lambda * tokens / mean), cut off at the
most uses its source allows. The multipliers lambda solve the convex dual; Newton's
method finds them from sums over the documents that each step computes distributed,
over the counts of documents by source and tokens, which hold all that matters.
Uses are rounded to whole copies so that the errors of a source cancel: from
long documents to short ones, each group of equal length takes over what the one
before left, down to half the shortest document. Which documents of a group get
one copy more is decided by their hash: whole hash buckets, and a rank within one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.wordhash import slices
from tracemill.llm.tokens import RANKS, tokenizer
from tracemill.session import cut

#: Hash buckets of a group of documents of one source and length; a rank is taken within one of them at most.
SALTS = 1024
#: Sources that can be mixed.
MOST_SOURCES = 10_000


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS, keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """``doc_id``, the columns of ``keep`` and ``n_tokens``; a null or empty text has 0."""
    picked = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), *keep, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(ranks).count
        for whole in batches:
            for batch in slices(whole, "text"):
                n = pa.array([count(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "n_tokens"])

    schema = ", ".join(f"{c} {t}" for c, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, schema + ", n_tokens bigint")


class Mixture:
    """``copies()`` of documents and ``shares()`` reached.

    ``targets`` has ``source``, ``weight`` and ``max_repeats``, a row per source and
    few of them. ``total`` is the tokens wanted; without it, or if it is more than
    the caps allow, the most they allow. A source without tokens gives its weight to
    the others. Documents of other or null sources, with a null id or without
    tokens, are not used. A document given twice is two documents. The same rows
    and seed give the same copies.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: float | None = None, ranks: str = RANKS, seed: int = 0, most_steps: int = 60):
        rows = targets.where("weight > 0 and max_repeats > 0 and source is not null").limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError("too many sources")
        wanted = {r["source"]: (float(r["weight"]), int(r["max_repeats"])) for r in rows}
        known = documents.join(F.broadcast(targets.sparkSession.createDataFrame([(s,) for s in wanted], "source string")), "source", "left_semi")
        self._seed = seed
        self.documents = cut(count_tokens(known, ranks=ranks).where("n_tokens > 0 and doc_id is not null"), "counted")
        self._groups = cut(self.documents.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "groups")
        held = self._groups.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("n")).collect()
        whole = sum(wanted[r["source"]][0] for r in held) or 1.0
        self.sources = {
            r["source"]: {"weight": wanted[r["source"]][0] / whole, "cap": wanted[r["source"]][1], "tokens": int(r["tokens"]), "mean": r["tokens"] / r["n"]}
            for r in held
        }
        most = min((x["cap"] * x["tokens"] / x["weight"] for x in self.sources.values()), default=0.0)
        self.total = most if total is None else min(float(total), most)
        self.lambdas = self._newton(most_steps)

    def _used(self, lambdas: dict[str, float | None]) -> DataFrame:
        """The groups of some sources with ``use`` per document, ``mean`` and ``cap``; a multiplier of None is the cap itself."""
        rows = [(s, v, float(self.sources[s]["mean"]), float(self.sources[s]["cap"])) for s, v in lambdas.items()]
        table = self._groups.sparkSession.createDataFrame(rows, "source string, multiplier double, mean double, cap double")  # a row per source
        tilted = F.exp(F.least(F.lit(700.0), F.col("multiplier") * F.col("n_tokens") / F.col("mean")))
        return self._groups.join(F.broadcast(table), "source").withColumn("use", F.coalesce(F.least("cap", tilted), "cap"))

    def _newton(self, most_steps: int, tolerance: float = 1e-10) -> dict[str, float | None]:
        """Each source's multiplier; a step is one aggregation over all groups.

        Raises RuntimeError if a source is not within the tolerance after the last step.
        """
        goal = {s: x["weight"] * self.total for s, x in self.sources.items()}
        at: dict[str, float | None] = {s: None if goal[s] >= x["cap"] * x["tokens"] * (1 - 1e-12) else 0.0 for s, x in self.sources.items()}
        low, high = {s: -np.inf for s in at}, {s: np.inf for s in at}
        open_ = {s for s, v in at.items() if v is not None}
        for _ in range(most_steps):
            if not open_:
                break
            tokens = F.col("n") * F.col("n_tokens") * F.col("use")
            slope = F.when(F.col("use") < F.col("cap"), tokens * F.col("n_tokens") / F.col("mean")).otherwise(0.0)
            sums = self._used({s: at[s] for s in sorted(open_)}).groupBy("source").agg(F.sum(tokens).alias("f"), F.sum(slope).alias("d"))
            for r in sums.collect():  # a row per source
                s, f, d = r["source"], r["f"], r["d"]
                v = at[s]
                spent = np.isfinite(high[s] - low[s]) and high[s] - low[s] <= 4e-16 * max(abs(low[s]), abs(high[s]))  # no number between
                if abs(f / goal[s] - 1) < tolerance or spent:
                    open_.discard(s)
                    continue
                if f < goal[s]:
                    low[s] = v
                else:
                    high[s] = v
                # Newton's step on the logarithm, kept within what is known to enclose the root
                step = np.log(goal[s] / f) * f / d if d > 0 and f > 0 else np.inf * np.sign(goal[s] - f)
                new = v + float(np.clip(step, -8, 8))
                if not low[s] < new < high[s]:
                    new = (low[s] + high[s]) / 2 if np.isfinite(low[s] + high[s]) else v + 8 * float(np.sign(goal[s] - f))
                at[s] = new
        if open_:
            raise RuntimeError(f"no solution after {most_steps} steps for {sorted(open_)[:10]}")
        return at

    def _rounded(self) -> DataFrame:
        """Whole copies of each group: ``base`` for all its documents, one more for ``extra`` of them."""

        def spread(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("n_tokens", ascending=False)
            base = np.floor(pdf["use"] + 1e-9)
            part = np.clip(pdf["use"] - base, 0, None).to_numpy()
            carry, extra = 0.0, np.zeros(len(pdf), np.int64)
            for i, (t, n, p) in enumerate(zip(pdf["n_tokens"].tolist(), pdf["n"].tolist(), part.tolist())):
                if p <= 1e-9:
                    continue
                want = p * n * t + carry
                extra[i] = k = min(n, max(0, round(want / t)))
                carry = want - k * t
            return pdf[["source", "n_tokens"]].assign(base=base.astype(np.int64), extra=extra)

        # a source has one row per length here, however many documents: lengths are bounded by the longest document
        return self._used(self.lambdas).groupBy("source").applyInPandas(spread, "source string, n_tokens bigint, base bigint, extra bigint")

    def copies(self) -> DataFrame:
        """``doc_id, source, n_tokens, copies`` of the documents used at least once."""
        bucket = ["source", "n_tokens", "salt"]
        salted = self.documents.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(self._seed)), F.lit(SALTS)).cast("int"))
        before = F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
        filled = salted.groupBy(*bucket).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))  # SALTS rows a group at most
        more = filled.join(self._rounded(), ["source", "n_tokens"]).select(*bucket, "base", (F.col("extra") - F.col("before")).alias("more"))
        rank = F.row_number().over(Window.partitionBy(*bucket).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
        copies = (F.col("base") + (F.col("rank") <= F.col("more")).cast("int")).cast("int")
        return salted.withColumn("rank", rank).join(more, bucket).select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")

    def shares(self) -> DataFrame:
        """Per source: documents used, tokens, ``target_share`` and ``share`` of all tokens."""
        spark = self.documents.sparkSession
        goal = spark.createDataFrame([(s, x["weight"], x["tokens"], x["cap"]) for s, x in sorted(self.sources.items())], "source string, target_share double, tokens_held bigint, max_repeats int")
        sums = self.copies().groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("uses"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
        whole = sums.agg(F.sum("tokens").alias("all_tokens"))
        return goal.join(sums, "source", "left").join(F.broadcast(whole)).select("source", "target_share", (F.col("tokens") / F.col("all_tokens")).alias("share"), "tokens_held", "tokens", "documents", "uses", "max_repeats")
