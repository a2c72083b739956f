"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic.  Each cell's tokens get a weight
that is raked to the targets of one margin after another until the sources, languages and topics
all have their share; documents are then sampled by the weight of their cell, scaled so that the
expected number of tokens meets the budget.  Documents carry no topic of their own, so it is the
kind of text: empty, repetitive, tabular, numeric, short, long or prose.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import body, store, table

MARGINS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
CAPS, BUDGET = 10, 0.5
#: Raking goes on, SWEEPS at a time and ROUNDS times at most, until every share is met within TOLERANCE.
SWEEPS, TOLERANCE, ROUNDS = 20, 1e-6, 5
SEED = "mix"
#: So many cells at most are raked in one task; more are raked in parallel.
ONE_TASK = 100_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s]+"), lambda w: w != "")


def kind_of_text(text: Column, w: Column) -> Column:
    """The topic of a text, from its words; the first kind that fits."""
    n = F.size(w)
    return (
        F.when(n == 0, "empty")
        .when((n >= 20) & (5 * F.size(F.array_distinct(w)) <= n), "repetitive")
        .when(10 * (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))) >= n, "tabular")
        .when(10 * F.size(F.filter(w, lambda x: x.rlike("[0-9]"))) >= n, "numeric")
        .when(n < 30, "short").when(n >= 1000, "long").otherwise("prose")
    )


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on doc_id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def cell_of(docs: DataFrame) -> DataFrame:
    """docs with _source and _lang ('' for null), _topic and _tokens (number of words)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.withColumns({"_source": name("source"), "_lang": name("lang"), "_w": words(body())})
    return rows.withColumns({"_topic": kind_of_text(body(), F.col("_w")), "_tokens": F.size("_w").cast("long")}).drop("_w")


def cells_of(docs: DataFrame) -> DataFrame:
    """doc_id with its cell: source, lang and topic, and its number of tokens."""
    return cell_of(docs).select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"))


def targets_of(cells: DataFrame, margin: str, power: float, given: dict | None = None) -> DataFrame:
    """Target shares of a margin: as given, else the shares found, each to the power and rescaled."""
    found = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0")
    if given is not None:
        known = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{margin} {dict(cells.dtypes)[margin]}, g double")
        found = found.join(known, margin, "left").select(margin, F.coalesce("g", F.lit(0.0)).alias("t"))
        power = 1.0
    shares = found.select(margin, F.pow(F.col("t").cast("double"), F.lit(power)).alias("p"))
    return shares.crossJoin(F.broadcast(shares.agg(F.sum("p").alias("total")))).select(margin, F.try_divide("p", "total").alias("share"))


def rake(cells: DataFrame, targets: dict[str, dict] | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with all_tokens and their weight.

    Cells of a margin without a target get weight 0.  The cells are few (sources x languages x
    topics): below ONE_TASK they stay in one task, where a sweep is three sums within groups and
    nothing is shuffled.  Given targets that cannot be met together are an error.  Targets that follow
    from the documents can exclude each other too, where cells are few: then the last margin is met,
    the others as nearly as ROUNDS bring them, with a warning.
    """
    small = cells.count() <= ONE_TASK
    state = cells.crossJoin(F.broadcast(cells.agg(F.sum("tokens").alias("all_tokens")))).withColumn("weight", F.lit(1.0))
    for margin, power in MARGINS.items():
        share = targets_of(cells, margin, power, (targets or {}).get(margin)).withColumnRenamed("share", f"share_{margin}")
        state = state.join(share, margin, "left")
    now = lambda m: F.sum(F.col("weight") * F.col("tokens")).over(W.partitionBy(m))
    for _ in range(ROUNDS):
        state = store(state, "raked")
        state = state.coalesce(1) if small else state
        for _ in range(SWEEPS):
            for m in MARGINS:
                state = state.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(F.col(f"share_{m}") * F.col("all_tokens"), now(m)), F.lit(0.0)))
        state = store(state, "raked")
        off = [F.coalesce(F.max(F.abs(now_ / F.col("all_tokens") - F.coalesce(F.col(f"share_{m}"), F.lit(0.0)))), F.lit(0.0)) for m in MARGINS for now_ in [F.col(f"now_{m}")]]
        met = state.withColumns({f"now_{m}": now(m) for m in MARGINS}).where("all_tokens > 0").agg(F.greatest(*off)).first()[0]
        if met < TOLERANCE:
            return state.select("source", "lang", "topic", "tokens", "all_tokens", "weight")
    if targets:
        raise ValueError("the targets of the margins cannot be met together")
    warnings.warn(f"the shares of the margins exclude each other: off by {met:.2g} at most", stacklevel=2)
    return state.select("source", "lang", "topic", "tokens", "all_tokens", "weight")


def calibrate(raked: DataFrame, budget: float = BUDGET, rounds: int = CAPS) -> DataFrame:
    """Adds probability = min(1, c * weight), c such that budget * all tokens are expected.

    c starts as the budget over the weighted tokens; cells that reach probability 1 give what they
    cannot take to the others, again and again.
    """
    state = raked.withColumn("c", F.lit(0.0)).withColumn("probability", F.lit(0.0))
    if raked.count() <= ONE_TASK:
        state = state.coalesce(1)
    for i in range(rounds):
        full = F.col("probability") >= 1
        open_tokens = F.sum(F.when(~full, F.col("weight") * F.col("tokens")))
        taken = F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0))
        scale = state.agg(F.coalesce(F.try_divide(F.greatest(F.lit(budget) * F.max("all_tokens") - taken, F.lit(0.0)), open_tokens), F.lit(0.0)).alias("now"))
        state = state.crossJoin(F.broadcast(scale)).withColumn("c", F.greatest("c", "now")).drop("now")
        state = state.withColumn("probability", F.least(F.lit(1.0), F.col("c") * F.col("weight")))
        if i % 3 == 2:
            state = store(state, f"cap{i}")
    return state


def mix_of(rows: DataFrame, targets: dict[str, dict] | None, budget: float) -> DataFrame:
    """Weight and probability by cell, from rows as cells_of gives them.

    Broadcast where the number of cells is proven small; else Spark joins by a shuffle and splits
    large cells.
    """
    cells = store(rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "counts")
    final = store(calibrate(rake(cells, targets), budget), "mix").select("source", "lang", "topic", "weight", "probability")
    return F.broadcast(final) if final.count() <= 100_000 else final


def mixed(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability and sampled of every row.

    Null sources and languages are a value of their own (''); a null text has no tokens, the topic
    empty and, in a cell without tokens, probability 0.  Rows that repeat a doc_id are drawn together.
    An empty table gives no rows.
    """
    rows = store(cells_of(docs), "cells")
    out = rows.join(mix_of(rows, targets, budget), ["source", "lang", "topic"], "left")
    p = F.round(F.coalesce("probability", F.lit(0.0)), 6)
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("weight"), p.alias("probability"), (uniform(F.col("doc_id")) < p).alias("sampled"))


def sample_mix(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of docs, in all their columns; a row's cell is worked out in place."""
    mix = mix_of(store(cells_of(docs), "cells"), targets, budget)
    mix = mix.select(F.struct("source", "lang", "topic").alias("_cell"), F.round("probability", 6).alias("_p"))
    rows = cell_of(docs).withColumn("_own", F.struct(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")))
    return rows.join(mix, F.col("_own") == F.col("_cell")).where(uniform(F.col("doc_id")) < F.col("_p")).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def _sql() -> str:
    parts = [
        """words AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents)""",
        """d AS MATERIALIZED (SELECT doc_id, source, lang, len(w) AS tokens, CASE WHEN len(w) = 0 THEN 'empty' WHEN len(w) >= 20 AND 5 * len(list_distinct(w)) <= len(w) THEN 'repetitive'
  WHEN 10 * (length(t) - length(replace(t, '|', ''))) >= len(w) THEN 'tabular' WHEN 10 * len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) >= len(w) THEN 'numeric' WHEN len(w) < 30 THEN 'short' WHEN len(w) >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM words)""",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "a AS MATERIALIZED (SELECT sum(tokens) AS total FROM c)",
    ]
    for m, power in MARGINS.items():
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () AS share_{m} FROM (SELECT {m}, pow(sum(tokens), {power}) AS p FROM c GROUP BY {m} HAVING sum(tokens) > 0))")
    parts.append("w0 AS MATERIALIZED (SELECT c.*, total, share_source, share_lang, share_topic, 1.0::DOUBLE AS weight FROM c CROSS JOIN a " + " ".join(f"LEFT JOIN t_{m} USING ({m})" for m in MARGINS) + ")")
    step = lambda inner, m: f"SELECT * EXCLUDE (weight), CASE WHEN sum(weight * tokens) OVER (PARTITION BY {m}) > 0 THEN coalesce(weight * (share_{m} * total / sum(weight * tokens) OVER (PARTITION BY {m})), 0.0) ELSE 0.0 END AS weight FROM ({inner})"
    k, done = 0, []
    for r in range(1, ROUNDS + 1):
        for _ in range(SWEEPS):
            inner = f"SELECT * FROM w{k}"
            for m in MARGINS:
                inner = step(inner, m)
            k += 1
            parts.append(f"w{k} AS MATERIALIZED ({inner})")
        off = ", ".join(f"max(abs(now_{m} / total - coalesce(share_{m}, 0.0)))" for m in MARGINS)
        parts.append(f"o{r} AS MATERIALIZED (SELECT greatest({off}) < {TOLERANCE} AS met FROM (SELECT *, " + ", ".join(f"sum(weight * tokens) OVER (PARTITION BY {m}) AS now_{m}" for m in MARGINS) + f" FROM w{k}))")
        done.append(f"SELECT * FROM w{k} WHERE " + ("true" if r == ROUNDS else f"(SELECT met FROM o{r})") + "".join(f" AND NOT (SELECT met FROM o{j})" for j in range(1, r)))
    parts.append("p0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS c, 0.0::DOUBLE AS probability FROM (" + " UNION ALL ".join(done) + "))")
    for i in range(CAPS):
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight, greatest(c, s) AS c, least(1.0, greatest(c, s) * weight) AS probability FROM p{i} CROSS JOIN (SELECT coalesce(greatest({BUDGET} * any_value(a.total) - coalesce(sum(tokens) FILTER (probability >= 1), 0), 0) / nullif(sum(weight * tokens) FILTER (probability < 1), 0), 0) AS s FROM p{i} CROSS JOIN a))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens::BIGINT AS tokens, round(m.weight, 6) AS weight, round(m.probability, 6) AS probability,
  ('0x' || left(md5('{SEED}' || coalesce(d.doc_id::VARCHAR, '')), 8))::BIGINT / 4294967296.0 < round(m.probability, 6) AS sampled
FROM d JOIN p{CAPS} m USING (source, lang, topic)"""


SQL = _sql()
