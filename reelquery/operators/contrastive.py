"""Contrastive scores of a query against its positive and its negatives, before and after a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_sum_exp(values: Column) -> Column:
    """log(sum(exp(x))) of an array without overflow."""
    m = F.array_max(values)
    return m + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def quality(sim_pos: Column, sim_negs: Column, tau: float, scale: float = 1.0) -> Column:
    """(sim_pos - tau * logsumexp(sim_negs / tau)) * scale."""
    return (sim_pos - tau * log_sum_exp(F.transform(sim_negs, lambda x: x / tau))) * scale


def positive_probability(sim_pos: Column, sim_negs: Column, tau: float) -> Column:
    """Share of the positive in the softmax over itself and the negatives."""
    every = F.transform(F.concat(F.array(sim_pos), sim_negs), lambda x: x / tau)
    return F.exp(sim_pos / tau - log_sum_exp(every))


def probability_gain(before: tuple[Column, Column], after: tuple[Column, Column], tau: float) -> Column:
    return positive_probability(*after, tau) - positive_probability(*before, tau)


def cross_entropy(sim_pos: Column, sim_negs: Column, tau: float) -> Column:
    return -F.log(positive_probability(sim_pos, sim_negs, tau))


def margin(sim_pos: Column, sim_negs: Column) -> Column:
    return sim_pos - F.array_max(sim_negs)


def improvement(before: Column, after: Column, scale: float = 1.0) -> Column:
    return (after - before) * scale


def gathered(pairs: DataFrame) -> DataFrame:
    """qid, sim_negs: the similarities of each query's negatives in order of (doc). pairs: qid, doc, sim; negatives of a query are bounded by their mining."""
    return pairs.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("doc", "sim"))).alias("r")).select("qid", F.transform("r", lambda x: x["sim"]).alias("sim_negs"))


def clipped_surrogate(log_new: Column, log_old: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """struct(ratio, objective, clipped) of a probability ratio clipped to [1 - low, 1 + high]."""
    ratio = F.exp(log_new - log_old)
    cut = F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low))
    return F.struct(ratio.alias("ratio"), F.least(ratio * advantage, cut * advantage).alias("objective"), (cut * advantage < ratio * advantage).alias("clipped"))
