"""All registered queries of the network operators, with their SQL."""

from roadweave.plans import builds, facilities, feeds, junctions, layered, lines, matched, network, places, regions, reports, routed, tagged, timed  # noqa: F401
from roadweave.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
