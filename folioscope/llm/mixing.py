"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.runtime import drop, settled, written

#: Exponent by which each marginal's shares are flattened: 1 keeps them, 0 makes them equal.
TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Target weights: shares of all tokens that values of a marginal should have. The values without one split the rest by temperature.
TARGETS = {"lang": {"en": 0.4, "de": 0.15, "fr": 0.15, "es": 0.15}}
#: Rounds of fitting over all marginals, and how many stand in one plan; share of all tokens that the sample aims at; seed of the draw.
ROUNDS, ROUNDS_AT_ONCE, SHARE, SEED = 16, 4, 0.5, 42
#: Cells up to which their table is one partition, and broadcast to the documents.
MAX_BROADCAST_CELLS = 100_000
_NONE = "\x00"


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def length_topic(tokens: Column) -> Column:
    """A stand-in for a topic where documents have none: the band of a document's length in words."""
    return F.when(tokens < 100, "short").when(tokens < 1000, "medium").otherwise("long")


def checked(given: dict[str, dict[str, float]], temperatures: dict[str, float]) -> dict[str, dict[str, float]]:
    """given, if it is fit for use: known marginals, no share below 0, none that sum above 1."""
    for name, shares in given.items():
        if name not in temperatures:
            raise ValueError(f"{name} is no marginal: these are {', '.join(temperatures)}")
        if min(shares.values(), default=0) < 0 or sum(shares.values()) > 1 + 1e-9:
            raise ValueError(f"the shares of {name} must be 0 at least and sum to 1 at most")
    return given


def targets(cells: DataFrame, temperatures: dict[str, float], given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells (one row per combination, with `tokens`) and for each marginal the tokens `target_<name>` that its value should have.

    A value with a given share has that share of all tokens. The others split what is left in proportion to
    their token sums to the power of the marginal's temperature. Where all values of the cells have a
    share, or the others have no tokens, the shares are scaled to sum to 1.
    """
    given = checked(given or {}, temperatures)
    total = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 0))
    for name, power in temperatures.items():
        shares = given.get(name, {})
        own = F.lit(None).cast("double")
        for value, share in shares.items():
            own = F.when(F.col(name) == F.lit(value), F.lit(float(share))).otherwise(own)
        margin = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("m")).withColumn("own", F.when(F.col("m") > 0, own))
        margin = margin.withColumn("free", F.when(F.col("own").isNull() & (F.col("m") > 0), F.pow("m", F.lit(float(power)))).otherwise(F.lit(0.0)))
        sums = margin.agg(F.coalesce(F.sum("own"), F.lit(0.0)).alias("own"), F.coalesce(F.sum("free"), F.lit(0.0)).alias("free")).first()
        if sums["free"] > 0:  # shares of values that don't occur go to the values without one
            part = F.coalesce(F.col("own"), F.col("free") * F.lit((1.0 - (sums["own"] or 0.0)) / sums["free"]))
        else:
            part = F.coalesce(F.col("own") / F.lit(sums["own"] or 1.0), F.lit(0.0))
        margin = margin.select(F.col(name).alias("__v"), (part * total).alias(f"target_{name}"))
        cells = cells.join(margin, F.col(name) == F.col("__v")).drop("__v")
    return cells


def _level(keys: list[str], names: list[str], target: Column) -> Column:
    """The factor by which `free`, cut at `limit`, sums to the target in each group of `keys`; where all of it is too little, the one that cuts everything."""
    at = F.when(F.col("free") > 0, F.col("limit") / F.col("free"))
    order = Window.partitionBy(*keys).orderBy(at.asc_nulls_last(), *names)
    cut = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("free").over(order.rowsBetween(0, Window.unboundedFollowing))
    return F.struct(F.when(rest > 0, (target - cut) / rest).alias("factor"), at.alias("at"))


def _scaled(cells: DataFrame, keys: list[str], names: list[str], target: Column) -> DataFrame:
    whole = Window.partitionBy(*keys)
    cells = cells.withColumn("__l", _level(keys, names, target))
    factor = F.coalesce(F.max(F.when(F.col("__l.factor") <= F.col("__l.at"), F.col("__l.factor"))).over(whole), F.max("__l.at").over(whole), F.lit(0.0))
    return cells.withColumn("free", F.col("free") * factor).drop("__l")


def rake(cells: DataFrame, names: list[str], share: float, rounds: int = ROUNDS) -> DataFrame:
    """cells with `fitted`: tokens scaled to each marginal's targets in turn, `rounds` times over, and never above tokens / share, so that no probability is above 1.

    A cell at its bound stays there, and the other cells of the marginal's value take its rest. A target beyond the tokens
    that its value can give is lowered to them first, and the marginal's other targets rise in proportion: `met_<name>`. Where no
    sample meets all marginals together, the last round's fit stands, and deviations() tells by how much it is off.
    """
    for name in names:  # one row for each value: the targets that can be met
        values = cells.groupBy(name).agg(F.sum(F.col("tokens") / F.lit(share)).alias("limit"), F.max(f"target_{name}").alias("free"))
        total = float(values.agg(F.sum("free")).first()[0] or 0)
        met = _scaled(values.withColumn("__all", F.lit(0)), ["__all"], [name], F.lit(total)).select(F.col(name).alias("__v"), F.least("free", "limit").alias(f"met_{name}"))
        cells = cells.join(met, F.col(name) == F.col("__v")).drop("__v")
    now = settled(cells.withColumn("most", F.col("tokens") / F.lit(share)).withColumn("fitted", F.least(F.col("tokens").cast("double"), F.col("most"))), "raked")
    few = now.count() <= MAX_BROADCAST_CELLS
    for begin in range(0, rounds, ROUNDS_AT_ONCE):  # some rounds are written at a time, so that a plan stays short
        steps, last = _steps([n for _ in range(begin, min(rounds, begin + ROUNDS_AT_ONCE)) for n in names], now.columns)
        # A small table is one partition, and its windows need no shuffle.
        out = now.sparkSession.sql(f"WITH f0 AS (SELECT * FROM {{cells}}), {steps} SELECT * FROM {last}", cells=now.coalesce(1) if few else now)
        now = settled(out, "raked", now)
    return now.drop("most")


def _steps(names: list[str], columns: list[str], materialized: str = "") -> tuple[str, str]:
    """(SQL for Spark and DuckDB, name of the last table): from f0 on, `fitted` is scaled to the met targets of one marginal
    after the other, down as a whole and up by the cells that aren't at their bound `most`."""
    every = ", ".join(x for x in columns if x != "fitted")
    out = []
    for k, n in enumerate(names):
        out.append(f"""f{k + 1} AS {materialized} (
  SELECT {every}, CASE WHEN met_{n} >= whole THEN CASE WHEN fitted >= most OR free <= 0 THEN fitted ELSE least(most, fitted * ((met_{n} - cut) / free)) END
    WHEN whole > 0 THEN fitted * (met_{n} / whole) ELSE 0e0 END AS fitted
  FROM (SELECT *, sum(fitted) OVER w AS whole, sum(CASE WHEN fitted >= most THEN most ELSE 0e0 END) OVER w AS cut,
    sum(CASE WHEN fitted >= most THEN 0e0 ELSE fitted END) OVER w AS free FROM f{k} WINDOW w AS (PARTITION BY {n})))""")
    return ", ".join(out), f"f{len(names)}"


def deviations(cells: DataFrame, names: list[str]) -> DataFrame:
    """(marginal, off): the largest share of its target by which a value of the marginal is off in what rake() returns."""
    each = [cells.groupBy(n).agg(F.sum("fitted").alias("f"), F.max(f"met_{n}").alias("t")).agg(F.lit(n).alias("marginal"), F.max(F.abs(F.col("f") - F.col("t")) / F.greatest(F.col("t"), F.lit(1.0))).alias("off")) for n in names]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on seed and id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def probabilities(docs: DataFrame, temperatures: dict[str, float] | None = None, given: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """Cells: one row per combination of marginals with tokens, targets, fitted and keep_prob.

    docs has a column for each marginal and `tokens`. keep_prob is share * fitted / tokens (see rake), so that the expected
    sample has the marginals aimed at. A cell without tokens keeps its documents with probability `share`. Null values of a
    marginal are a value of their own, written as the character U+0000. given: target weights, TARGETS if left out.
    """
    temperatures = temperatures or TEMPERATURES
    names = list(temperatures)
    keyed = docs.select(*[F.coalesce(F.col(n).cast("string"), F.lit(_NONE)).alias(n) for n in names], "tokens")
    cells = written(keyed.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "cells")
    aimed = settled(targets(cells, temperatures, TARGETS if given is None else given), "targets", cells)
    fitted = rake(aimed, names, share, rounds)
    drop(aimed)
    ratio = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(F.lit(1.0))
    return fitted.withColumn("keep_prob", F.least(F.lit(1.0), F.lit(share) * ratio))


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", topic_col: str | None = None, given: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """docs with __tokens, __topic, __prob and __kept: every row, whether it is drawn, and with what probability.

    Marginals are the columns source and lang, and topic_col or else a band of length; `given` holds target weights
    for them. A document is drawn if a number from its id falls below its cell's probability, so copies of an id
    are drawn together and a run can be repeated; null ids count as the empty text. Nulls are values of their own. An empty
    table gives an empty one. The table of cells is small (one row for each
    combination); its rows are counted, and beyond MAX_BROADCAST_CELLS the join shuffles.
    """
    tokens = n_tokens(F.col(text_col))
    rows = docs.withColumn("__tokens", tokens)
    rows = rows.withColumn("__topic", F.col(topic_col).cast("string") if topic_col else length_topic(F.col("__tokens")))
    marked = rows.select("source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"))
    cells = probabilities(marked, given=given, rounds=rounds, share=share)
    keys = cells.select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"), F.col("keep_prob").alias("__prob"))
    if cells.count() <= MAX_BROADCAST_CELLS:
        keys = F.broadcast(keys)
    null = F.lit(_NONE)
    same = (F.coalesce(F.col("source").cast("string"), null) == F.col("__s")) & (F.coalesce(F.col("lang").cast("string"), null) == F.col("__l")) & (F.coalesce(F.col("__topic"), null) == F.col("__t"))
    return rows.join(keys, same).drop("__s", "__l", "__t").withColumn("__kept", draw(F.col(id_col), seed) < F.col("__prob"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that are drawn, with their columns. Odd rows are treated as mixed() says."""
    return mixed(docs).filter("__kept").select(*docs.columns)


def op9_rows(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("__prob", 6).alias("keep_prob"), F.col("__kept").alias("kept"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and draw of every document under the target weights."""
    return op9_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))


def _sql_scaled(table: str, keys: str, order: str, target: str, extra: str) -> str:
    """A step of the fit in SQL: `free` of each group scaled so that it sums to the target when cut at `limit`."""
    return f"""SELECT {extra}, "limit", free * coalesce(max(CASE WHEN factor <= ratio THEN factor END) OVER (PARTITION BY {keys}), max(ratio) OVER (PARTITION BY {keys}), 0e0) AS free FROM (
    SELECT *, CASE WHEN rest > 0 THEN ({target} - cut) / rest END AS factor FROM (
      SELECT *, coalesce(sum("limit") OVER (PARTITION BY {keys} ORDER BY ratio NULLS LAST, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS cut,
        sum(free) OVER (PARTITION BY {keys} ORDER BY ratio NULLS LAST, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM (SELECT *, CASE WHEN free > 0 THEN "limit" / free END AS ratio FROM {table})))"""


def op9_sql(rounds: int = ROUNDS) -> str:
    """The same in DuckDB: one step of the fit is one table expression."""
    names = list(TEMPERATURES)
    steps = []
    for name in names:
        shares = TARGETS.get(name, {})
        own = "CASE " + " ".join(f"WHEN {name} = '{v}' AND m > 0 THEN {x}e0" for v, x in shares.items()) + " END" if shares else "CAST(NULL AS DOUBLE)"
        steps.append(f"m_{name} AS (SELECT {name}, m, {own} AS own FROM (SELECT {name}, sum(tokens)::DOUBLE AS m FROM cells GROUP BY 1))")
        steps.append(f"p_{name} AS (SELECT {name}, m, own, CASE WHEN own IS NULL AND m > 0 THEN pow(m, {TEMPERATURES[name]}e0) ELSE 0e0 END AS free FROM m_{name})")
        steps.append(f"s_{name} AS (SELECT coalesce(sum(own), 0e0) AS own, coalesce(sum(free), 0e0) AS free FROM p_{name})")
        steps.append(
            f"t_{name} AS (SELECT {name}, m / {SHARE}e0 AS \"limit\", (SELECT sum(tokens)::DOUBLE FROM cells) * CASE WHEN (SELECT free FROM s_{name}) > 0 "
            f"THEN coalesce(own, p.free * ((1e0 - (SELECT own FROM s_{name})) / (SELECT free FROM s_{name}))) ELSE coalesce(own / (SELECT CASE WHEN own = 0 THEN 1e0 ELSE own END FROM s_{name}), 0e0) END AS free FROM p_{name} p)"
        )
        steps.append(f"a_{name} AS (SELECT *, (SELECT sum(free) FROM t_{name}) AS whole FROM t_{name})")
        steps.append(f"met_{name} AS (SELECT {name}, least(free, \"limit\") AS met FROM ({_sql_scaled(f'a_{name}', '1', name, 'whole', name)}))")
    cells = ", ".join(f"met_{n}.met AS met_{n}" for n in names)
    joins = " ".join(f"JOIN met_{n} USING ({n})" for n in names)
    steps.append(f"f0 AS MATERIALIZED (SELECT source, lang, topic, tokens, {cells}, tokens / {SHARE}e0 AS most, least(tokens::DOUBLE, tokens / {SHARE}e0) AS fitted FROM cells {joins})")
    fit, last = _steps(names * rounds, ["source", "lang", "topic", "tokens", *(f"met_{n}" for n in names), "most"], "MATERIALIZED")
    steps.append(fit)
    return rf"""
WITH d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), b AS (
  SELECT *, CASE WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM d
), cells AS (
  SELECT coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang, topic, sum(n_tokens)::BIGINT AS tokens FROM b GROUP BY ALL
), {", ".join(steps)}, p AS (
  SELECT source, lang, topic, least(1e0, {SHARE}e0 * CASE WHEN tokens > 0 THEN fitted / tokens ELSE 1e0 END) AS prob FROM {last}
)
SELECT doc_id, b.source, b.lang, b.topic, n_tokens, round(prob, 6) AS keep_prob,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::BIGINT::VARCHAR, '')), 1, 8))::BIGINT / 4294967296e0 < prob AS kept
FROM b JOIN p ON coalesce(b.source, chr(0)) = p.source AND coalesce(b.lang, chr(0)) = p.lang AND b.topic = p.topic
"""
