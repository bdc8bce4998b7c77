"""Mixing sources to target weights by iterative proportional fitting, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.llm.frames import cut

#: Cells of the contingency table up to this many are raked on the driver; beyond it, as a frame.
DRIVER_CELLS = 100_000
MARGINS = ("source", "lang", "topic")
#: The tables have no topic: these marks of a text's form stand for it, the first that fits; else 'prose'.
TOPICS = (("table", " | "), ("symbols", "$$$"), ("shout", "!! "), ("code", " = "), ("contact", "@"))
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, mark in reversed(TOPICS):
        out = F.when(F.contains(text, F.lit(mark)), name).otherwise(out)
    return out


def _rake_rows(cells: list[tuple], targets: list[dict], rounds: int) -> list[float]:
    """Weights of the cells (value of each margin, ..., tokens) after so many rounds over all margins."""
    w = [float(c[-1]) for c in cells]
    for _ in range(rounds):
        for m, target in enumerate(targets):
            total: dict = {}
            for c, x in zip(cells, w, strict=True):
                total[c[m]] = total.get(c[m], 0.0) + x
            w = [x * target[c[m]] / total[c[m]] if total[c[m]] else 0.0 for c, x in zip(cells, w, strict=True)]
    return w


def _rake_frame(cells: DataFrame, power: float, rounds: int, given: dict[str, dict]) -> DataFrame:
    """The same over a frame (margins, _tokens): adds _w."""
    cells = cells.withColumn("_w", F.col("_tokens").cast("double"))
    for m in MARGINS:
        raw = cells.groupBy(m).agg(F.pow(F.sum("_tokens").cast("double"), F.lit(power)).alias(f"_t_{m}"))
        if m in given:
            wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given[m].items()], "_g string, _v double")
            raw = raw.join(wanted, F.col(m).eqNullSafe(F.col("_g")), "left").select(m, F.coalesce("_v", F.lit(0.0)).alias(f"_t_{m}"))
        norm = raw.agg(F.sum(f"_t_{m}").alias("s")).first().s or 1.0
        raw = raw.withColumnRenamed(m, f"_k_{m}").withColumn(f"_t_{m}", F.col(f"_t_{m}") / norm)
        cells = cells.join(raw, F.col(m).eqNullSafe(F.col(f"_k_{m}"))).drop(f"_k_{m}")
    for _ in range(rounds):
        for m in MARGINS:
            total = cells.groupBy(F.col(m).alias("_k")).agg(F.sum("_w").alias("_s"))
            joined = cells.join(total, F.col(m).eqNullSafe(F.col("_k")))
            cells = joined.withColumn("_w", F.when(F.col("_s") > 0, F.col("_w") * F.col(f"_t_{m}") / F.col("_s")).otherwise(0.0)).drop("_k", "_s")
        cells = cut(cells)
    return cells


def mix(docs: DataFrame, power: float = 0.9, rounds: int = 25, seed: int = 1, topic: Column | None = None, driver_cells: int = DRIVER_CELLS, keep: tuple[str, ...] = (), targets: dict[str, dict] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, kept) of every document, and the columns keep.

    targets gives the weights wanted of a margin's values ({"source": {"web": 3, None: 1}, ...}; null is a value, what is not
    named is wanted not at all); a margin that it does not have aims at its token share to the power given. Both are
    normalised over the values at hand. topic is the column of the topic, or an expression of it. Tokens are
    words of whole texts, one at least for a document. Token weights of the cells (source, lang, topic) are raked to the
    three margins in turn for a fixed number of rounds. weight is the cell's raked share over its own share of tokens;
    probability is weight over the largest weight, so that the expected tokens of what is kept stand in the raked
    proportions and no document is taken twice; kept is md5(doc_id:seed), as a fraction, under probability.

    Nulls are values of their own in every margin; null texts have one token and the topic 'prose'; a null doc_id is
    hashed as empty. Repeated rows get the same decision. An empty table gives no rows. A large cell is only ever a
    sum. Other columns are ignored."""
    given = targets or {}
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.col("source"), F.col("lang"), (topic if topic is not None else topic_of(body)).alias("topic"),
        F.greatest(F.regexp_count(body, F.lit(WORD)), F.lit(1)).cast("long").alias("n_tokens"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("_tokens")))
    spark = docs.sparkSession
    if cells.count() <= driver_cells:
        got = sorted((tuple(r) for r in cells.collect()), key=repr)
        aims = []
        for m in range(len(MARGINS)):
            total: dict = {}
            for c in got:
                total[c[m]] = total.get(c[m], 0) + c[-1]
            raised = {k: float(v) ** power for k, v in total.items()} if MARGINS[m] not in given else {k: float(given[MARGINS[m]].get(k, 0.0)) for k in total}
            norm = sum(raised.values()) or 1.0
            aims.append({k: v / norm for k, v in raised.items()})
        raked = _rake_rows(got, aims, rounds)
        tokens = sum(c[-1] for c in got)
        ratio = [w / (c[-1] / tokens) for c, w in zip(got, raked, strict=True)]
        top = max(ratio, default=1.0) or 1.0
        table = [(*c[:-1], r, r / top) for c, r in zip(got, ratio, strict=True)]
        chance = F.broadcast(spark.createDataFrame(table, "c_source string, c_lang string, c_topic string, weight double, probability double"))
    else:
        raked = _rake_frame(cells, power, rounds, given)
        tokens = raked.agg(F.sum("_tokens").alias("t")).first().t
        raked = raked.withColumn("weight", F.col("_w") / (F.col("_tokens") / tokens))
        top = raked.agg(F.max("weight").alias("t")).first().t
        chance = raked.select(*[F.col(m).alias(f"c_{m}") for m in MARGINS], "weight", (F.col("weight") / top).alias("probability"))
    on = [F.col(m).eqNullSafe(F.col(f"c_{m}")) for m in MARGINS]
    u = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    return rows.join(chance, on[0] & on[1] & on[2]).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"),
        (u < F.col("probability")).alias("kept"), *[F.col(f"_keep_{c}").alias(c if c not in MARGINS and c != "doc_id" else f"{c}_") for c in keep],
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_TOPIC_SQL = "case " + " ".join(f"when contains(coalesce(text, ''), '{mark}') then '{name}'" for name, mark in TOPICS) + " else 'prose' end"


def mix_sql(power: float = 0.9, rounds: int = 25, seed: int = 1, table: str = "documents") -> str:
    """The same by a recursive query: a round is three windows over the cells."""
    k = "k, source, lang, topic, tokens, ts, tl, tt"
    return rf"""
with recursive d as (select doc_id, source, lang, {_TOPIC_SQL} as topic, greatest(len(regexp_extract_all(coalesce(text, ''), '{WORD}')), 1)::bigint as n_tokens from {table}),
c as (select source, lang, topic, sum(n_tokens)::double as tokens from d group by all),
s as (select source, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) over () as ts from c group by source),
l as (select lang, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) over () as tl from c group by lang),
t as (select topic, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) over () as tt from c group by topic),
it as (
 select 0 as k, c.source, c.lang, c.topic, tokens, ts, tl, tt, tokens as w from c join s on c.source is not distinct from s.source join l on c.lang is not distinct from l.lang join t on c.topic = t.topic
 union all
 select k + 1, source, lang, topic, tokens, ts, tl, tt, w * tt / sum(w) over (partition by topic) from (
  select {k}, w * tl / sum(w) over (partition by lang) as w from (
   select {k}, w * ts / sum(w) over (partition by source) as w from it where k < {rounds}))
),
f as (select source, lang, topic, w / (tokens / sum(tokens) over ()) as weight from it where k = {rounds}),
g as (select *, weight / max(weight) over () as probability from f)
select doc_id, d.source, d.lang, d.topic, n_tokens, round(weight, 6) as weight, round(probability, 6) as probability,
 ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{seed}'), 1, 8))::bigint / 4294967296.0 < probability as kept
from d join g on d.source is not distinct from g.source and d.lang is not distinct from g.lang and d.topic = g.topic
"""
