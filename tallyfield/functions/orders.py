"""Order column functions: stop-loss, payout, results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Runs behind that end an order, by inning (9: and later).
RUNS_BEHIND = {7: 5, 8: 4, 9: 3}
HIGH_TOTAL = 10.0  # from this total on, one run more


def stop_loss(side: Column, inning: Column, home_score: Column, away_score: Column, total: Column) -> Column:
    """Is a bet on ``side`` far enough behind, late enough, to be closed?  False where anything is unknown."""
    behind = F.when(side == "home", away_score - home_score).when(side == "away", home_score - away_score)
    need = F.when(inning == 7, RUNS_BEHIND[7]).when(inning == 8, RUNS_BEHIND[8]).when(inning >= 9, RUNS_BEHIND[9])
    leash = F.when(total >= HIGH_TOTAL, 1).otherwise(0)
    return F.coalesce((behind > 0) & (behind >= need + leash), F.lit(False))


def payout(contracts: Column, stake: Column, profit: Column, cents: Column) -> Column:
    """Dollars from whole contracts, else stake and profit, else cents."""
    return F.coalesce(contracts.cast("double"), F.round(stake + profit, 6), cents / 100.0)


def final_result(status: Column, home_score: Column, away_score: Column) -> Column:
    """'home' or 'away' of a final game that isn't tied."""
    return F.when(status == "final", F.when(home_score > away_score, "home").when(home_score < away_score, "away"))
