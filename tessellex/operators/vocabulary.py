"""Set and bag metrics of token columns. All are aggregates that combine before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """keys, condition, token: a row for each token of each array column in conditions."""
    pairs = F.array(*[F.struct(F.lit(n).alias("condition"), c.alias("tokens")) for n, c in conditions.items()])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.condition", F.explode("p.tokens").alias("token"))


def types(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """keys, token, n: the distinct tokens of an array column and how often they stand; what costs much is done to these."""
    return df.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def vocabulary(tokens: DataFrame, keys: list[str], conditions: list[str]) -> DataFrame:
    """keys and, for each condition, v_<condition>: its distinct tokens. Distinct rows first, so a hot key's counts combine."""
    seen = tokens.select(*keys, "condition", "token").distinct()
    return seen.groupBy(*keys).agg(*[F.count(F.when(F.col("condition") == c, 1)).alias(f"v_{c}") for c in conditions])


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def decomposition(raw: Column, ortho: Column, full: Column) -> dict[str, Column]:
    """total = ortho * morph, and the share of ln total that is morphology; null where undefined."""
    total, orth, morph = (F.when(b > 0, a / b) for a, b in ((raw, full), (raw, ortho), (ortho, full)))
    return {"cr_total": total, "cr_ortho": orth, "cr_morph": morph, "morph_share": F.when((total > 1) & (morph > 0), F.log(morph) / F.log(total))}


def vrg(cr: Column, clamped: bool = True) -> Column:
    gain = 1 - 1 / cr
    return F.when(cr < 1, F.lit(0.0)).otherwise(gain) if clamped else gain


def aes(irs: Column, gain: Column, beta: Column | float = 1.0, clamped: bool = True) -> Column:
    """(1 + b2) I V / (b2 I + V), 0 where the denominator isn't positive."""
    i = F.greatest(F.lit(0.0), F.least(F.lit(1.0), irs)) if clamped else irs
    b2 = beta * beta if isinstance(beta, Column) else F.lit(float(beta) ** 2)
    den = b2 * i + gain
    return F.when(den > 0, (1 + b2) * i * gain / den).otherwise(F.lit(0.0))


def kl_divergence(tokens: DataFrame, keys: list[str], p: str, q: str, epsilon: float = 1e-12, weight: Column | int = 1) -> DataFrame:
    """keys, kl: of the token distributions of condition p from q, over the union vocabulary, epsilon added to counts first. A row counts weight times."""
    n = lambda x: F.coalesce(F.sum(F.when(F.col("condition") == x, weight)), F.lit(0))
    counts = tokens.groupBy(*keys, "token").agg(n(p).alias("cp"), n(q).alias("cq"))
    counts = counts.where("cp + cq > 0").select(*keys, (F.col("cp") + epsilon).alias("cp"), (F.col("cq") + epsilon).alias("cq"))
    # sum p ln(p / q) with p = cp / P, q = cq / Q: one pass of sums
    s = counts.groupBy(*keys).agg(F.sum("cp").alias("tp"), F.sum("cq").alias("tq"), F.sum(F.col("cp") * F.log(F.col("cp") / F.col("cq"))).alias("s"))
    return s.select(*keys, (F.col("s") / F.col("tp") + F.log(F.col("tq") / F.col("tp"))).alias("kl"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def l2(v: Column) -> Column:
    """v with norm 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))
