"""One ranking from several differently-scaled scores, by normal scores of empirical percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.ranking import group_ranks
from cairn.session import table

#: score column -> (sign, weight): sign 1 where lower is better, -1 where higher is better.
EVIDENCE = {"fts_rank": (1, 1.0), "dense_rank": (1, 1.0), "exact_score": (-1, 1.0), "graph_score": (-1, 1.0)}

# Coefficients of the rational approximations of the inverse normal distribution (algorithm AS 241).
_CENTRAL = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(coefficients, r: Column) -> Column:
    up, down = (reduce(lambda acc, c: acc * r + F.lit(c), reversed(cs[:-1]), F.lit(cs[-1])) for cs in coefficients)
    return up / down


def inverse_normal(p: Column) -> Column:
    """The quantile of the standard normal distribution at 0 < p < 1; null elsewhere."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.signum(q) * F.when(r <= 5.0, _ratio(_MIDDLE, r - 1.6)).otherwise(_ratio(_TAIL, r - 5.0))
    inner = q * _ratio(_CENTRAL, F.lit(0.180625) - q * q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, inner).otherwise(outer))


def normal_scores(df: DataFrame, scores: dict = EVIDENCE) -> DataFrame:
    """(query_id, record_id, fused, top): the weighted mean of the normal scores, and in `top` for how many of the
    scores no candidate of the query is better.

    Each score becomes badness (lower is better); null and NaN are worst and equal. Its empirical percentile among the
    query's candidates, with averaged ties, is (less + (equal + 1) / 2 - 1/2) / n; the inverse normal of one minus that
    is the normal score. Rows of one (query_id, record_id) - repeated rows - count once, each score at its best. Rows
    with a null key take no part. Other columns are ignored.
    """
    bad = []
    for c, (sign, _) in scores.items():
        v = F.col(c).cast("double")
        worst = v.isNull() | F.isnan(v)
        bad.append(F.min(F.when(worst, float("inf")).otherwise(v * sign + F.lit(0.0))).alias(c))
    one = (
        df.filter(F.col("query_id").isNotNull() & F.col("record_id").isNotNull())
        .groupBy("query_id", "record_id")
        .agg(*bad)
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(c).alias("v")) for i, c in enumerate(scores)]))
    long = one.select("query_id", "record_id", pairs.alias("p")).select("query_id", "record_id", "p.s", "p.v")
    ranks = group_ranks(long, ["query_id", "s"], ["v"])
    pct = (F.col("less") + (F.col("equal") + 1) / 2 - 0.5) / F.col("total")
    weights = list(w for _, w in scores.values())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("s") + 1)
    return (
        long.join(ranks, ["query_id", "s", "v"])
        .groupBy("query_id", "record_id")
        .agg(
            F.round(F.sum(weight * inverse_normal(1 - pct)) / F.lit(sum(weights)), 9).alias("fused"),
            F.sum((F.col("less") == 0).cast("int")).alias("top"),
        )
    )


def fused_ranking(df: DataFrame, scores: dict = EVIDENCE) -> DataFrame:
    """(query_id, record_id, fused, rank): best first, ties by record_id; rank 1, 2, ... is unique in a query."""
    fused = normal_scores(df, scores).withColumn("worse", -F.col("fused"))
    ranks = group_ranks(fused, ["query_id"], ["worse", "record_id"])
    return ranks.select("query_id", "record_id", (-F.col("worse")).alias("fused"), (F.col("less") + 1).alias("rank"))


def dominant_candidates(df: DataFrame, scores: dict = EVIDENCE) -> DataFrame:
    """(query_id, record_id): the first of the fused order where it leads in every score and nobody ties with it.

    A candidate at least as good as every other in all scores has the best percentile of each, so it is first; another
    one as good in all of them would have the same fused score and lead in all as well.
    """
    leads = F.when(F.col("top") == len(scores), 1)
    best = F.max_by(F.struct("record_id", "top"), F.struct("fused", F.col("top")))
    return (
        normal_scores(df, scores)
        .groupBy("query_id")
        .agg(best.alias("b"), F.count(leads).alias("leaders"))
        .filter((F.col("leaders") == 1) & (F.col("b.top") == len(scores)))
        .select("query_id", "b.record_id")
    )


def ndcg(ranking: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, judged, ndcg): how well each query's order of its judged candidates agrees with the grades.

    Gains are 2^grade - 1, discounted by log2 of the place among the judged candidates plus one; repeated labels count
    once (the highest grade). Queries whose grades are all 0 are left out.
    """
    graded = labels.filter(F.col("grade").isNotNull()).groupBy("query_id", "record_id").agg(F.max("grade").alias("grade"))
    rows = graded.join(ranking.select("query_id", "record_id", "rank"), ["query_id", "record_id"])
    place = group_ranks(rows, ["query_id"], ["rank", "grade"]).withColumnRenamed("less", "got")
    ideal = group_ranks(rows.withColumn("low", -F.col("grade")), ["query_id"], ["low", "record_id"])
    gain = lambda g, at: (F.pow(F.lit(2.0), g) - 1) / F.log2(at + 2)
    dcg = place.groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("got"))).alias("dcg"), F.count(F.lit(1)).alias("judged"))
    best = ideal.groupBy("query_id").agg(F.sum(gain(-F.col("low"), F.col("less"))).alias("best"))
    return (
        dcg.join(best, "query_id")
        .filter(F.col("best") > 0)
        .select("query_id", "judged", F.round(F.col("dcg") / F.col("best"), 6).alias("ndcg"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_candidates(table(spark, sf_dir, "candidate_evidence"))


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_ranking(table(spark, sf_dir, "candidate_evidence")).select(
        "query_id", "record_id", (F.round("fused", 6) + F.lit(0.0)).alias("fused"), F.col("rank").cast("long").alias("rank")
    )


def p5_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndcg(fused_ranking(table(spark, sf_dir, "candidate_evidence")), table(spark, sf_dir, "rank_labels"))


def min_max_ranking(df: DataFrame, scores: dict = EVIDENCE) -> DataFrame:
    """(query_id, record_id, rank) by the weighted mean of scores that are stretched to 0..1 in each query, null and NaN 0:
    what the fused ranking is compared with, and what a score with outliers rules."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") * -s) for c, (s, _) in scores.items()}
    one = df.filter(F.col("query_id").isNotNull() & F.col("record_id").isNotNull()).groupBy("query_id", "record_id").agg(*[F.max(v).alias(c) for c, v in clean.items()])
    ends = one.groupBy("query_id").agg(*[f(c).alias(f"{n}_{c}") for c in scores for n, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: F.coalesce(F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))), F.lit(0.0))
    mean = reduce(lambda a, b: a + b, [part(c) * w for c, (_, w) in scores.items()])
    ranks = group_ranks(one.join(ends, "query_id").select("query_id", "record_id", F.round(-mean, 9).alias("worse")), ["query_id"], ["worse", "record_id"])
    return ranks.select("query_id", "record_id", (F.col("less") + 1).alias("rank"))


def compared(df: DataFrame, labels: DataFrame, scores: dict = EVIDENCE) -> DataFrame:
    """(ranking, queries, ndcg): the mean nDCG of the fused ranking, of each score alone and of the min-max mean."""
    rankings = {"fused": fused_ranking(df, scores), "min_max": min_max_ranking(df, scores)} | {c: fused_ranking(df, {c: s}) for c, s in scores.items()}
    rows = [
        ndcg(r, labels).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("ndcg"), 4).alias("ndcg")).select(F.lit(name).alias("ranking"), "queries", "ndcg")
        for name, r in rankings.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def p5_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "candidate_evidence"), table(spark, sf_dir, "rank_labels"))


def _bad_sql() -> str:
    worst = lambda c, s: f"min(CASE WHEN {c} IS NULL OR {c}::VARCHAR = 'nan' THEN 'inf'::DOUBLE ELSE {s} * {c}::DOUBLE END) AS {c}"
    cols = ", ".join(worst(c, s) for c, (s, _) in EVIDENCE.items())
    return f"SELECT query_id, record_id, {cols} FROM candidate_evidence GROUP BY ALL"


def _ratio_sql(coefficients, r: str) -> str:
    up, down = ("(" + reduce(lambda acc, c: f"({acc}) * {r} + {c!r}", reversed(cs[:-1]), repr(cs[-1])) + ")" for cs in coefficients)
    return f"{up} / {down}"


def _ranking_sql() -> str:
    inner = f"q * {_ratio_sql(_CENTRAL, '(0.180625 - q * q)')}"
    outer = f"sign(q) * CASE WHEN r <= 5.0 THEN {_ratio_sql(_MIDDLE, '(r - 1.6)')} ELSE {_ratio_sql(_TAIL, '(r - 5.0)')} END"
    long = " UNION ALL ".join(f"SELECT query_id, record_id, {i} AS s, {w}::DOUBLE AS w, {c} AS v FROM b" for i, (c, (_, w)) in enumerate(EVIDENCE.items()))
    return f"""b AS ({_bad_sql()}), l AS ({long}),
  k AS (SELECT *, rank() OVER (PARTITION BY query_id, s ORDER BY v) - 1 AS less, count(*) OVER (PARTITION BY query_id, s, v) AS equal, count(*) OVER (PARTITION BY query_id, s) AS total FROM l),
  p AS (SELECT *, 1 - (less + (equal + 1) / 2 - 0.5::DOUBLE) / total AS p FROM k), o AS (SELECT *, p - 0.5::DOUBLE AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM p),
  z AS (SELECT query_id, record_id, w, CASE WHEN abs(q) <= 0.425 THEN {inner} ELSE {outer} END AS z FROM o),
  f AS (SELECT query_id, record_id, round(sum(w * z) / sum(w), 9) AS fused FROM z GROUP BY 1, 2),
  ranking AS (SELECT query_id, record_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, record_id) AS rank FROM f)"""


SQL = {
    "p5_ranking": f"WITH {_ranking_sql()} SELECT query_id, record_id, round(fused, 6) + 0.0::DOUBLE AS fused, rank FROM ranking",
    "p5_ndcg": f"""WITH {_ranking_sql()}, g AS (SELECT query_id, record_id, max(grade) AS grade FROM rank_labels WHERE grade IS NOT NULL GROUP BY 1, 2),
  j AS (SELECT g.*, row_number() OVER (PARTITION BY g.query_id ORDER BY rank) AS got, row_number() OVER (PARTITION BY g.query_id ORDER BY grade DESC, record_id) AS best FROM g JOIN ranking USING (query_id, record_id)),
  s AS (SELECT query_id, count(*) AS judged, sum((2.0::DOUBLE ^ grade - 1) / log2(got + 1)) AS dcg, sum((2.0::DOUBLE ^ grade - 1) / log2(best + 1)) AS ideal FROM j GROUP BY 1)
SELECT query_id, judged, round(dcg / ideal, 6) AS ndcg FROM s WHERE ideal > 0""",
    "p5_found": f"""WITH b AS ({_bad_sql()})
SELECT x.query_id, x.record_id FROM b x WHERE NOT EXISTS (
  SELECT 1 FROM b y WHERE y.query_id = x.query_id AND y.record_id <> x.record_id AND (
    NOT (x.fts_rank <= y.fts_rank AND x.dense_rank <= y.dense_rank AND x.exact_score <= y.exact_score AND x.graph_score <= y.graph_score)
    OR (x.fts_rank = y.fts_rank AND x.dense_rank = y.dense_rank AND x.exact_score = y.exact_score AND x.graph_score = y.graph_score)))"""
}
QUERIES = {"p5_found": p5_found, "p5_ranking": p5_ranking, "p5_ndcg": p5_ndcg, "p5_compared": p5_compared}
