"""Mixing sources to target weights: iterative proportional fitting of token weights to three marginals."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, words, written_table

DIMENSIONS = ("source", "lang", "topic")
#: Rounds of fitting; each scales the weights to the three marginals in turn.
ROUNDS = 30
#: Without given targets, a value's share of the tokens is proportional to its tokens to this power.
TEMPERATURE = 0.7
#: Share of the corpus's tokens that the mixture keeps.
BUDGET = 0.7
#: Cells that are fitted on the driver, 1 MB or so of every 10 thousand; more are fitted as a table.
DRIVER_CELLS = 200_000
SALT = "mix-1"


def topic_of(text: str) -> str:
    """The form of a text: table, reference, symbols, long or short prose. The first that fits."""
    if " | " in text:
        return "table"
    if "http://" in text or "https://" in text or "license" in text.lower():
        return "reference"
    if (len(text) - sum(map(text.count, "#*$%&<>"))) * 20 < len(text) * 19:
        return "symbols"
    return "long prose" if len(text) >= 2000 else "short prose"


@F.arrow_udf(T.StructType([T.StructField("topic", T.StringType()), T.StructField("n_tokens", T.LongType())]))
def described(texts: pa.Array) -> pa.Array:
    """Topic, and tokens counted as runs of characters other than ASCII white space; null is as empty."""
    found = [x or "" for x in texts.to_pylist()]
    return pa.StructArray.from_arrays(
        [pa.array([topic_of(x) for x in found], pa.string()), pa.array([len(words(x)) for x in found], pa.int64())],
        names=["topic", "n_tokens"],
    )


def _targets(cells: pd.DataFrame, given: Mapping[str, Mapping[str, float]]) -> dict[str, pd.Series]:
    out = {}
    for d in DIMENSIONS:
        have = cells.groupby(d, sort=True)["tokens"].sum()
        want = pd.Series(given[d], dtype=float).reindex(have.index).fillna(0.0) if d in given else have.astype(float) ** TEMPERATURE
        want = want.where(have > 0, 0.0)
        out[d] = want / want.sum() if want.sum() else want
    return out


def within_reach(want: pd.Series, most: pd.Series) -> pd.Series:
    """Shares in proportion to want, but none over what its value can give; what is cut goes to the others in proportion.

    Values are taken by want / most, the largest first: one is at its bound if it would be over it with what those
    before it leave. Without enough in all, each is at its bound.
    """
    able = (most > 0) & (want > 0)
    order = pd.DataFrame({"want": want[able], "most": most[able]})
    order = order.assign(key=order["want"] / order["most"]).sort_values("key", ascending=False, kind="stable")
    before = order["most"].cumsum() - order["most"]
    rest = order["want"][::-1].cumsum()[::-1]
    full = order["want"] * (1 - before) >= order["most"] * rest
    left, over = 1 - order["most"][full].sum(), order["want"][~full].sum()
    share = order["most"].where(full, order["want"] * (left / over if over else 0.0))
    return share.reindex(want.index).fillna(0.0)


def fit_cells(cells: pd.DataFrame, targets: Mapping[str, Mapping[str, float]], budget: float | None = None) -> pd.DataFrame:
    """cells (source, lang, topic, tokens) with weight: share of the mixture's tokens, fitted by scaling the
    token table to each marginal in turn, ROUNDS times. A marginal that can't be met (its cells are
    empty) keeps what can be; cells are taken in the order of their names, so sums don't hang on chance.

    With a budget, the mixture's share of all tokens, no cell gives more than it has: each step ends at that bound,
    and the next ones spread what is cut over the other cells. Targets beyond what a value's cells have are lowered
    to that first, and the others raised: see within_reach()."""
    cells = cells.sort_values(list(DIMENSIONS), kind="stable").reset_index(drop=True)
    tokens = cells["tokens"].astype(float).to_numpy()
    if not tokens.sum():
        return cells.assign(weight=0.0)
    weight = tokens / tokens.sum()
    most = weight / budget if budget is not None else np.inf
    want = _targets(cells, targets)
    if budget is not None:
        want = {d: within_reach(w, cells.groupby(d, sort=True)["tokens"].sum() / (tokens.sum() * budget)) for d, w in want.items()}
    codes = {d: (np.unique(cells[d], return_inverse=True)[1], want[d].sort_index().to_numpy()) for d in DIMENSIONS}
    for _ in range(ROUNDS):
        for at, share in codes.values():
            have = np.bincount(at, weights=weight, minlength=len(share))
            weight = np.minimum(most, weight * np.divide(share, have, out=np.zeros_like(share), where=have > 0)[at])
    if budget is None and weight.sum():
        weight = weight / weight.sum()
    return cells.assign(weight=weight)


def _within_reach(want: DataFrame, d: str, wanted: float) -> DataFrame:
    """within_reach() of rows (d, share, have). One task ranks the values of one dimension: a row each, without text."""
    able = want.where("have > 0 and share > 0").withColumn("most", F.col("have") / F.lit(wanted))
    by = Window.orderBy((F.col("share") / F.col("most")).desc(), d)
    before = F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most")
    rest = F.sum("share").over(by.rowsBetween(0, Window.unboundedFollowing))
    able = written_table(able.withColumn("full", F.col("share") * (1 - before) >= F.col("most") * rest), "want")
    sums = able.agg(F.sum(F.when(F.col("full"), F.col("most"))).alias("m"), F.sum(F.when(~F.col("full"), F.col("share"))).alias("s")).first()
    scale = (1 - (sums.m or 0.0)) / sums.s if sums.s else 0.0
    given = able.select(d, F.when(F.col("full"), F.col("most")).otherwise(F.col("share") * scale).alias("given"))
    return want.join(given, d, "left").select(d, F.coalesce("given", F.lit(0.0)).alias("share"), "have")


def _fit_table(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], budget: float | None = None) -> DataFrame:
    """fit_cells() with joins, for more cells than the driver takes; marginals are aggregated each time."""
    out = written_table(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    total = out.agg(F.sum("tokens")).first()[0]
    out = out.withColumn("weight", F.col("weight") / F.lit(float(total or 1)))
    out = out.withColumn("most", F.col("weight") / F.lit(float(budget)) if budget is not None else F.lit(float("inf")))
    wants = {}
    for d in DIMENSIONS:
        have = cells.groupBy(d).agg(F.sum("tokens").alias("have"))
        if d in targets:
            rows = cells.sparkSession.createDataFrame(list(targets[d].items()) or [("", 0.0)], f"{d} string, raw double")
            have = have.join(rows, d, "left").withColumn("raw", F.when(F.col("have") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(0.0))
        else:
            have = have.withColumn("raw", F.pow(F.col("have").cast("double"), TEMPERATURE))
        whole = have.agg(F.sum("raw")).first()[0]
        want = have.select(d, (F.col("raw") / F.lit(float(whole or 1))).alias("share"), "have")
        wants[d] = written_table(want if budget is None else _within_reach(want, d, budget * float(total or 1)), "want").drop("have")
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            scale = out.groupBy(d).agg(F.sum("weight").alias("have")).join(wants[d], d)
            scale = scale.select(d, F.when(F.col("have") > 0, F.col("share") / F.col("have")).otherwise(0.0).alias("scale"))
            out = out.join(scale, d).withColumn("weight", F.least("most", F.col("weight") * F.col("scale"))).drop("scale")
        out = written_table(out, "cells")
    whole = out.agg(F.sum("weight")).first()[0] if budget is None else 1.0
    return out.drop("most").withColumn("weight", F.col("weight") / F.lit(float(whole or 1)))


def _decided(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], budget: float) -> tuple[DataFrame, str]:
    """docs with a struct (topic, n_tokens, probability, kept) under a name that no column of docs has, and the name."""
    if not 0 < budget <= 1:
        raise ValueError("budget is a share of the corpus's tokens, over 0 and up to 1")
    bounded_batches(docs.sparkSession)
    own = free_name(docs, "_mixture")
    cell = [F.coalesce(F.col(d), F.lit("")) for d in DIMENSIONS[:2]]
    rows = docs.withColumn(own, described("text"))
    cells = rows.select(*(c.alias(d) for c, d in zip(cell, DIMENSIONS)), F.col(own).topic.alias("topic"), F.col(own).n_tokens.alias("n_tokens"))
    cells = cells.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    small = cells.limit(DRIVER_CELLS + 1).toPandas()
    if len(small) <= DRIVER_CELLS:
        fitted = fit_cells(small, targets, budget)
        wanted = budget * float(small["tokens"].sum())
        fitted["probability"] = np.minimum(1.0, np.divide(fitted["weight"] * wanted, fitted["tokens"], out=np.zeros(len(fitted)), where=fitted["tokens"].to_numpy() > 0))
        fitted = docs.sparkSession.createDataFrame(
            list(fitted[[*DIMENSIONS, "probability"]].itertuples(index=False, name=None)),
            "source string, lang string, topic string, probability double",
        )
        fitted = F.broadcast(fitted)  # at most DRIVER_CELLS rows
    else:
        table = _fit_table(cells, targets, budget)
        wanted = budget * float(cells.agg(F.sum("tokens")).first()[0] or 0)
        chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * wanted / F.col("tokens")))
        fitted = table.select(*DIMENSIONS, F.coalesce(chance, F.lit(0.0)).alias("probability"))
    names = [free_name(docs, f"_cell_{d}") for d in (*DIMENSIONS, "probability")]
    fitted = fitted.toDF(*names)
    same = [c == F.col(name) for c, name in zip([*cell, F.col(own).topic], names)]
    key = F.concat(F.lit(SALT + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    draw = F.when(F.col("doc_id").isNull(), 0.0).otherwise(draw)
    topic, n_tokens, chance = F.col(own).topic, F.col(own).n_tokens, F.col(names[3])
    kept = (n_tokens > 0) & (draw < chance)
    made = F.struct(topic.alias("topic"), n_tokens.alias("n_tokens"), chance.alias("probability"), kept.alias("kept"))
    return rows.join(fitted, same[0] & same[1] & same[2]).withColumn(own, made).drop(*names), own


def mixture(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """docs with topic, n_tokens, probability and kept (columns of these names give way).

    docs: doc_id, text, source, lang and any other columns. Token weights of the cells source x language x
    topic are raked to `targets` (dimension -> value -> share; a dimension left out takes shares by
    TEMPERATURE) so that the mixture has `budget` of the corpus's tokens, and no value or cell more than its own: see
    fit_cells(). A cell's documents are sampled with probability wanted tokens / its tokens, so expected marginals
    meet the targets wherever the cells have the tokens. The draw is a hash of
    doc_id, so it is the same in every run. Null source or lang is the value ''; null text has no tokens.
    Documents without tokens, or of a cell without tokens, are kept with probability 0. A null doc_id
    draws 0, so it is kept wherever its cell has a chance. Repeated rows draw alike. An empty table gives
    an empty result.
    """
    made = ("topic", "n_tokens", "probability", "kept")
    found, own = _decided(docs, targets or {}, budget)
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    return found.select(*keep, *(F.col(own)[c].alias(c) for c in made))


def keep_mixture(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """The rows of docs that mixture() keeps; all their columns stay as they are, whatever their names."""
    found, own = _decided(docs, targets or {}, budget)
    return found.where(F.col(own).kept).drop(own)


def mixture_sql(budget: float = BUDGET) -> str:
    """mixture() with default targets over the table documents, as SQL: doc_id, source, lang, topic,
    n_tokens, probability (to 6 places) and kept."""
    clean = "trim(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ')"
    parts = [
        f"""docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN contains(t, ' | ') THEN 'table'
    WHEN contains(t, 'http://') OR contains(t, 'https://') OR contains(lower(t), 'license') THEN 'reference'
    WHEN length(translate(t, '#*$%&<>', '')) * 20 < length(t) * 19 THEN 'symbols'
    WHEN length(t) >= 2000 THEN 'long prose' ELSE 'short prose' END AS topic,
  CASE WHEN r = '' THEN 0 ELSE length(r) - length(replace(r, ' ', '')) + 1 END AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t, regexp_replace({clean}, ' +', ' ', 'g') AS r FROM documents))""",
        "g AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)",
        f"c0 AS MATERIALIZED (SELECT *, w / {budget} AS most FROM (SELECT *, tokens / greatest((SELECT sum(tokens) FROM g), 1) AS w FROM g))",
    ]
    for d in DIMENSIONS:
        parts.append(
            f"r_{d} AS MATERIALIZED (SELECT {d}, raw / sum(raw) OVER () AS s, have / ({budget} * sum(have) OVER ()) AS m FROM "
            f"(SELECT {d}, pow(sum(tokens), {TEMPERATURE}) AS raw, sum(tokens) AS have FROM c0 GROUP BY {d} HAVING sum(tokens) > 0)),\n"
            f"f_{d} AS MATERIALIZED (SELECT *, s * (1 - (sum(m) OVER (ORDER BY s / m DESC, {d} ROWS UNBOUNDED PRECEDING) - m)) >= "
            f"m * sum(s) OVER (ORDER BY s / m DESC, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_most FROM r_{d}),\n"
            f"t_{d} AS MATERIALIZED (SELECT k.{d}, CASE WHEN f.at_most THEN f.m WHEN f.s > 0 THEN f.s * (1 - coalesce((SELECT sum(m) FROM f_{d} WHERE at_most), 0)) "
            f"/ (SELECT sum(s) FROM f_{d} WHERE NOT at_most) ELSE 0 END AS share FROM (SELECT DISTINCT {d} FROM c0) k LEFT JOIN f_{d} f ON f.{d} = k.{d})"
        )
    n = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.most, least(c.most, CASE WHEN h.have > 0 THEN c.w * (t.share / h.have) ELSE 0 END) AS w "
                f"FROM c{n} c JOIN t_{d} t ON c.{d} = t.{d} JOIN (SELECT {d}, sum(w) AS have FROM c{n} GROUP BY {d}) h ON c.{d} = h.{d})"
            )
            n += 1
    parts.append(
        f"p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, w * {budget} * (SELECT sum(tokens) FROM c0) / tokens) ELSE 0 END AS probability FROM c{n})"
    )
    draw = f"CASE WHEN doc_id IS NULL THEN 0 ELSE ('0x' || substr(md5('{SALT}:' || doc_id), 1, 8))::BIGINT / 4294967296.0 END"
    return (
        "WITH "
        + ",\n".join(parts)
        + f"\nSELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens::BIGINT AS n_tokens, round(p.probability, 6) AS probability, "
        f"d.n_tokens > 0 AND {draw} < p.probability AS kept FROM docs d JOIN p USING (source, lang, topic)"
    )
