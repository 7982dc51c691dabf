"""Seconds that a rider loses at a junction, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave.functions.rules import first_match

# Seconds, road classes from the busiest down, and waits for a gap by the busiest road's place among them.
STOP_S, SIGNAL_S, YIELD_S = 8.0, 15.0, 4.0
ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential")
GAP_S = (30.0, 30.0, 30.0, 20.0, 12.0)
NO_ROAD, ROLL_FROM = len(ROADS), 5


def road_rank(road: Column) -> Column:
    """0 for the busiest class; any that isn't a road ranks last."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROADS]), road), F.lit(0)).cast("int")
    return F.when(place > 0, place - 1).otherwise(NO_ROAD)


def give_way_s(rank: Column, rolls: Column) -> Column:
    """The stop before a road of this rank; where `rolls`, a quiet one is taken as a yield."""
    gap = F.get(F.array(*[F.lit(s) for s in GAP_S]), rank)
    return F.coalesce(gap, F.when(F.coalesce(rolls, F.lit(False)) & (rank >= ROLL_FROM), YIELD_S).otherwise(STOP_S))


def junction_delay_s(from_path: Column, to_path: Column, came: Column, left: Column, arms: Column, signal: Column, ahead: Column, one_road: Column, crossed: Column, rolls: Column) -> Column:
    """came, left: the rider's road class before and after; arms: classes of the other roads; signal: a real one with
    other arms; ahead: straight on; one_road: onto the same way; crossed: another road as busy as theirs is at the node.

    A signal is a wait whatever meets there. A path gives way to every road. Straight on along one road gives way only
    to two arms as busy or busier; a turn gives way unless it goes onto a quieter road or off one that nothing crosses.
    """
    roads = F.filter(F.transform(F.coalesce(arms, F.array().cast("array<string>")), road_rank), lambda r: r < NO_ROAD)
    own, onto = road_rank(came), F.when(to_path, NO_ROAD).otherwise(road_rank(left))
    met = F.filter(roads, lambda r: r <= own)
    busiest = F.least(onto, F.array_min(roads))
    straight = ahead & (one_road | came.eqNullSafe(left))
    return first_match(
        [
            (signal, SIGNAL_S),
            (F.size(roads) == 0, F.when(from_path & (onto < NO_ROAD), give_way_s(onto, rolls)).otherwise(0.0)),
            (from_path, give_way_s(busiest, rolls)),
            (straight, F.when(F.size(met) >= 2, give_way_s(F.array_min(met), rolls)).otherwise(0.0)),
            ((onto > own) | ((onto == own) & ~crossed), 0.0),
        ],
        give_way_s(busiest, rolls),
    )
