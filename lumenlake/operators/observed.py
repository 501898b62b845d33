"""What a job reports of its rows, observed while they are written: no second pass, and invariants that hold or stop the job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

ACTIONS = ("NEW", "MODIFIED", "MOVED", "UNCHANGED", "DELETED")


class BrokenInvariant(AssertionError):
    """The numbers of a job do not fit together."""


def write_actions(actions: DataFrame, write: Callable[[DataFrame], None], live_before: int, column: str = "action") -> dict[str, int]:
    """Write a reconcile's actions and give their numbers, which come with the write.

    disk_files is what the listing has, live_before what was stored; live_after, live_before + new - deleted, has to be disk_files after a whole
    reconcile, else BrokenInvariant is raised: rows were lost or counted twice. Other actions than ACTIONS break it too.
    """
    seen = Observation()
    counts = [F.count_if(F.col(column) == a).alias(a.lower()) for a in ACTIONS]
    write(actions.observe(seen, F.count(F.lit(1)).alias("rows"), *counts))
    found = {k: int(v) for k, v in seen.get.items()}
    found["disk_files"] = sum(found[a.lower()] for a in ACTIONS[:-1])
    found["live_before"], found["live_after"] = live_before, live_before + found["new"] - found["deleted"]
    if found["disk_files"] + found["deleted"] != found["rows"] or found["live_after"] != found["disk_files"]:
        raise BrokenInvariant(str(found))
    return found


def write_listing(listing: DataFrame, write: Callable[[DataFrame], None], reason: str, reasons: tuple[str, ...]) -> dict[str, int]:
    """Write the rows of a listing that no reason skips, and give how many were kept and how many each reason skipped."""
    seen = Observation()
    counts = [F.count_if(F.col(reason) == r).alias(r) for r in reasons]
    watched = listing.observe(seen, F.count_if(F.col(reason).isNull()).alias("kept"), *counts)
    write(watched.where(F.col(reason).isNull()).drop(reason))
    return {k: int(v) for k, v in seen.get.items()}
