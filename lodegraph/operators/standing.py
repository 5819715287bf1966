"""The standing of claims under a policy: a rule-ordered decision over weights, evidence and class."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .evidence import accepts_verdict
from .ranking import numbered


class Policy(NamedTuple):
    """Scaled parameters; the defaults are the engine's default policy."""

    damping: int = 850_000
    rounds: int = 20
    tau: int = 660_000
    delta_max: int = 290_000
    replication_floor: int = 2
    independence_distance: int = 2
    half_life: int | None = None


#: Fixed value: most rounds that a policy may ask for.
MOST_ROUNDS = 200


def checked(policy: Policy) -> Policy:
    if not 0 <= policy.rounds <= MOST_ROUNDS:
        raise ValueError(f"rounds must be from 0 to {MOST_ROUNDS}")
    return policy


def divergence_factor(affirm: Column, argued: Column, delta_max: int) -> Column:
    """0 without weight on either side, else min(delta_max, delta_max * argued / (affirm + argued)), truncated."""
    return F.least(F.lit(delta_max).cast("bigint"), fixed.mul_div(F.lit(delta_max), argued, affirm + argued))


def replicated(policy: Policy, kind: Column, repro: Column, consistent: Column) -> Column:
    """Whether replication suffices: only empirical claims need it, restricted ones never have it."""
    floor = F.when(repro == "restricted", F.lit(False)).when(repro == "unique-event", consistent >= 1).otherwise(consistent >= policy.replication_floor)
    return (kind != "empirical") | floor


def standings(evidence: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """evidence plus delta and result.

    evidence: (target, class, affirm, deny, abstain, argued, retracted, proof_checked, repro_class,
    independent_consistent, independent_inconsistent); the order of the cases is the rule.
    """
    kind, affirm, deny = F.col("class"), F.col("affirm"), F.col("deny")
    delta = divergence_factor(affirm, F.col("argued"), checked(policy).delta_max)
    total = affirm + deny
    bar = F.col("delta") + policy.tau
    result = (
        F.when(~accepts_verdict(kind), "not-truth-apt")
        .when(F.col("retracted"), "rejected")
        .when((kind == "formal") & F.col("proof_checked"), "accepted")
        .when((kind == "empirical") & (F.col("independent_inconsistent") > 0), "rejected")
        .when(total == 0, "undetermined")
        .when(fixed.ratio(deny, total) >= bar, "rejected")
        .when(fixed.ratio(affirm, total) >= bar, F.when(replicated(policy, kind, F.col("repro_class"), F.col("independent_consistent")), "accepted").otherwise("unreplicated"))
        .otherwise("contested")
    )
    return evidence.withColumn("delta", delta).withColumn("result", result)


def ranked(found: DataFrame) -> DataFrame:
    """Standings with their rank by affirming weight, then id."""
    return numbered(found, F.desc("affirm"), F.asc("target"))
