"""Plain questions: which reports a message asks for, by its words."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import analytics, dedupe

# Words that ask for a report, and the pattern of a search by name.
REPORTS = {
    "storage": ("storage", "breakdown", "how much", "space"),
    "archives": ("archive", "zip", "rar", "compressed"),
    "duplicates": ("duplicate", "cleanup", "wast", "redundant"),
}
SEARCH = re.compile(r"""(?:find|search|look for|where is|show me|list)\s+(?:files?\s+(?:named?|called?|with)?\s+)?["']?([a-z0-9\s._-]{2,30})["']?""")
FOUND = 10


@dataclass(frozen=True)
class Asked:
    """The name to search for, if any, and the reports."""

    keyword: str | None
    reports: tuple[str, ...]


def understood(message: str) -> Asked:
    """What a message asks for; nothing if no word is known."""
    low = message.lower()
    m = SEARCH.search(low)
    keyword = m[1].strip() if m else ""
    return Asked(keyword if len(keyword) >= 2 else None, tuple(r for r, words in REPORTS.items() if any(w in low for w in words)))


def answers(message: str, files: DataFrame, archives: DataFrame | None = None) -> dict[str, DataFrame]:
    """A lazy table for each part of the question: matches by name, and the reports."""
    asked, out = understood(message), {}
    if asked.keyword:
        out["matches"] = analytics.top_files(files.where(F.col("name").ilike(f"%{asked.keyword}%")), FOUND)
    if "storage" in asked.reports:
        out["storage"], out["largest"] = analytics.type_breakdown(files), analytics.top_files(files, FOUND)
    if "archives" in asked.reports and archives is not None:
        out["archives"] = archives.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").cast("long").alias("size")).orderBy(F.desc("size"), "category")
    if "duplicates" in asked.reports:
        out["duplicates"] = dedupe.summary(files)
    return out
