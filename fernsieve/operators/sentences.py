"""Sentences that say why a member stands where it does, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsieve.operators.explain import BARELY, MAX_REASONS, MIN_DELTA
from fernsieve.operators.scoring import common_criteria, rank_members
from fernsieve.schema import WEIGHTS

#: What the sentences say, first of the better, then of the worse member.
BETTER_WORSE = {
    "faces": ("Eyes are more open than in {partner}.", "Eyes are less open than in {partner}."),
    "exposure": ("Better exposed than {partner}.", "Less well exposed than {partner}."),
    "horizon": ("A more level horizon than {partner}.", "A more tilted horizon than {partner}."),
    "framing": ("The subject sits better in the frame than in {partner}.", "The subject sits less well in the frame than in {partner}."),
}
NEXT_BEST, KEEPER = "the next-best take", "the proposed keeper"


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, rounded by its exact value."""
    return F.replace(F.format_number(x, places), F.lit(","), F.lit(""))


def said(template: str, *values: Column) -> Column:
    """The template with each ``{}`` replaced by a column of text."""
    parts = template.split("{}")
    return F.concat(*[x for k, part in enumerate(parts) for x in (F.lit(part), *values[k : k + 1])])


def sharpness_sentence(mine: Column, best: Column, softest: Column, n: Column) -> Column:
    """A member's sharpness, itself a share of the best, against its cluster."""
    ratio = best / softest
    return (
        F.when(mine < best, said("Softer than the sharpest take — {}× its detail.", fixed(mine / best, 2)))
        .when(softest <= 0, said("Sharpest of the {} takes — the softest has no measurable detail.", n.cast("string")))
        .when(ratio < BARELY, said("Sharpest of the {} takes, though only just — {}× the detail of the softest.", n.cast("string"), fixed(ratio, 2)))
        .otherwise(said("Sharpest of the {} takes — {}× the detail of the softest.", n.cast("string"), fixed(ratio, 2)))
    )


def evidence(scores: DataFrame, weights: dict[str, float] = WEIGHTS, margin: float = 0.05) -> DataFrame:
    """(cluster_id, uuid, place, text) of every member of a cluster of two or more: reasons first, then its standing.

    Reasons are the criteria that all members have and that differ from the partner's by MIN_DELTA or more, the
    largest by weight first, MAX_REASONS of them; with none, one sentence says so. The partner is the winner, the winner's own
    the runner-up. A member's reasons are an array of as many entries as there are criteria: no window is needed.
    """
    used = [n for n in weights if n in scores.columns and weights[n] > 0]
    ranked = rank_members(common_criteria(scores, weights), margin)
    sharp = [F.min("sharpness"), F.max("sharpness")] if "sharpness" in used else [F.lit(None).cast("double")] * 2
    of = ranked.groupBy("cluster_id").agg(F.count("*").cast("int").alias("_n"), sharp[0].alias("_softest"), sharp[1].alias("_sharpest"))
    # the winner is the partner of all others (1), the runner-up that of the winner (2)
    partners = ranked.where("rank <= 2").select("cluster_id", F.col("rank").alias("_with"), F.col("total").alias("_p_total"), *[F.col(n).alias(f"_p_{n}") for n in used])
    joined = ranked.withColumn("_with", F.when(F.col("rank") == 1, 2).otherwise(1)).join(partners, ["cluster_id", "_with"]).join(of, "cluster_id")
    first = F.col("rank") == 1
    partner = F.when(first, NEXT_BEST).otherwise(KEEPER)

    def entry(n: str) -> Column:
        mine, other = F.col(n), F.col(f"_p_{n}")
        delta = mine - other
        if n == "sharpness":
            text = sharpness_sentence(mine, F.col("_sharpest"), F.col("_softest"), F.col("_n"))
        elif n in BETTER_WORSE:
            better, worse = (F.concat(F.lit(x.split("{partner}")[0]), partner, F.lit(x.split("{partner}")[1])) for x in BETTER_WORSE[n])
            text = F.when(delta > 0, better).otherwise(worse)
        else:
            text = F.concat(F.lit("Scores "), F.when(delta > 0, "higher").otherwise("lower"), F.lit(f" on {n} than "), partner, said(" ({} against {}).", fixed(mine, 3), fixed(other, 3)))
        told = ~F.array_contains("dropped", n) & (F.abs(delta) >= MIN_DELTA)
        return F.when(told, F.struct((-F.round(F.abs(delta * float(weights[n])), 9)).alias("order"), F.lit(n).alias("name"), text.alias("text")))

    told = F.slice(F.array_sort(F.array_compact(F.array(*[entry(n) for n in used]))), 1, MAX_REASONS)
    reasons = F.transform(told, lambda x: x["text"])
    any_common = reduce(lambda a, n: a | ~F.array_contains("dropped", n), used, F.lit(False))
    nothing = F.concat(F.lit("Nothing measured here separates this take from "), partner, F.lit("."))
    reasons = F.when((F.size(reasons) == 0) & any_common, F.array(nothing)).otherwise(reasons)
    gap = F.abs(F.col("total") - F.col("_p_total"))
    close = F.col("ambiguous") & (F.col("rank") <= 2)
    standing = (
        F.when(close & first, said("Too close to call — only {} ahead of the next take.", fixed(gap, 3)))
        .when(close, said("Too close to call — only {} behind the proposed keeper.", fixed(gap, 3)))
        .when(first, said("The scorer's pick, {} ahead of the next take.", fixed(gap, 3)))
        .otherwise(said("Behind the proposed keeper by {}.", fixed(gap, 3)))
    )
    lines = F.concat(reasons, F.array(standing))
    return joined.select("cluster_id", "uuid", F.posexplode(lines).alias("place", "text"))


def prose_list(names: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), ", ")
    return F.when(F.size(names) < 2, F.array_join(names, ", ")).otherwise(F.concat(head, F.lit(" and "), F.element_at(names, -1)))


def ranking_sentences(scored: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(cluster_id, basis): what a cluster was ranked on, where some criteria could not be; null where all could.

    ``scored`` has ``dropped`` as ``common_criteria`` gives it. Criteria come by weight, then name, dropped ones by name.
    """
    order = sorted((n for n, w in weights.items() if w > 0), key=lambda n: (-weights[n], n))
    rest = F.filter(F.array(*map(F.lit, order)), lambda n: ~F.array_contains("dropped", n))
    none = F.lit("Nothing measurable ranked these takes — no criterion could be measured for every one of them, so the order between them is arbitrary.")
    some = F.concat(F.lit("Ranked on "), prose_list(rest), F.lit(" — "), prose_list(F.col("dropped")), F.lit(" could not be measured for every take."))
    words = F.when(F.size(rest) == 0, none).when(F.size("dropped") > 0, some)
    return scored.select("cluster_id", "dropped").distinct().select("cluster_id", words.alias("basis"))
