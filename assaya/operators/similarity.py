"""Nearest units of a specification by cosine (J11, X42): whole sides against each other, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of one side that meet a block of the other at once.
BLOCK = 4096


def _unit(column: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(x, np.float64) for x in column])
    size = np.sqrt((rows**2).sum(1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def similarity_maxima(units: DataFrame, spec: DataFrame, shift: float = 0.0, over: float = 1.0, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """For each unit (doc, unit, vec) its nearest ``spec`` unit (spec_id, vec), and for each document each specification unit's nearest.

    The first table has doc, unit, spec_id, sim and n_over, how many specification
    units are nearer than ``over``; the second doc, spec_id, sim. Ties go to the
    smaller spec_id. Only maxima of a block leave it, never pairs; ``shift`` is added
    to every similarity.
    """
    key = dict(units.dtypes)[doc]
    n_blocks, n_chunks = max(1, -(-spec.count() // BLOCK)), max(1, -(-units.count() // BLOCK))
    ours = units.select(doc, "unit", "vec", F.pmod(F.xxhash64("unit"), F.lit(n_chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    theirs = spec.select("spec_id", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))).alias("chunk"), F.pmod(F.xxhash64("spec_id"), F.lit(n_blocks)).cast("int").alias("block"))

    def meet(both: pd.DataFrame) -> pd.DataFrame:
        own = both["spec_id"].isna()
        a, b = both[own], both[~own]
        if not len(a) or not len(b):
            return pd.DataFrame({doc: [], "unit": [], "spec_id": [], "sim": [], "n_over": []})
        a, b = a.sort_values(doc, kind="stable").reset_index(drop=True), b.astype({"spec_id": "int64"}).sort_values("spec_id").reset_index(drop=True)
        sims = _unit(a["vec"]) @ _unit(b["vec"]).T + shift
        best = sims.argmax(1)
        rows = pd.DataFrame({doc: a[doc], "unit": a["unit"], "spec_id": b["spec_id"].to_numpy()[best], "sim": sims[np.arange(len(a)), best], "n_over": (sims > over).sum(1)})
        starts = np.flatnonzero(a[doc].ne(a[doc].shift()).to_numpy())
        tops = np.maximum.reduceat(sims, starts, axis=0)
        names = a[doc].to_numpy()[starts]
        columns = pd.DataFrame({doc: np.repeat(names, len(b)), "unit": None, "spec_id": np.tile(b["spec_id"].to_numpy(), len(starts)), "sim": tops.ravel(), "n_over": None})
        out = pd.concat([rows.astype({"unit": "object", "n_over": "object"}), columns])
        return out

    both = ours.unionByName(theirs, allowMissingColumns=True)
    found = both.groupBy("chunk", "block").applyInPandas(meet, f"{doc} {key}, unit {dict(units.dtypes)['unit']}, spec_id long, sim double, n_over long")
    nearest = F.max(F.struct("sim", (-F.col("spec_id")).alias("back")))
    rows = found.filter("unit IS NOT NULL").groupBy(doc, "unit").agg(nearest.alias("x"), F.sum("n_over").alias("n_over")).select(doc, "unit", (-F.col("x.back")).alias("spec_id"), F.col("x.sim").alias("sim"), "n_over")
    return rows, found.filter("unit IS NULL").groupBy(doc, "spec_id").agg(F.max("sim").alias("sim"))
