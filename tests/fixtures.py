"""Small fixtures written for these tests (shapes as in FIXTURES.md part A)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

AS_OF = dt.datetime(2024, 6, 1, 12, 0, 0)

SEARCH_DOCS = [
    # id, title, content, format, size, tags, created days ago, modified days ago
    ("knots", "Sailing Guide for Beginners",
     "Tie the rope before you splice it. Slack tide is the moment to leave; splice once more on the way home.",
     "text", 880, ["sailing", "rope"], 21, 9),
    ("harbour", "Harbour Chart Notes", "Depths and lights are drawn in blue.", "html", 1900, ["chart", "harbour"], 40, 4),
    ("tides", "Tide Table", "High and low water by day, with the rope marks of the pier.", "text", 640, ["tides", "chart"], 12, 12),
    ("crew", "Crew List", "names: skipper, mate and cook", "yaml", 310, ["deck hands"], 33, 30),
    ("log", "Logbook", "{ wind: north, periscope: none }", "json", 450, ["chart"], 2, 2),
]


def search_docs(spark):
    rows = []
    for i, (id_, title, content, fmt, size, tags, c, m) in enumerate(SEARCH_DOCS):
        rows.append((i + 1, id_, f"/docs/{id_}.{'txt' if fmt == 'text' else fmt}",
                     title, content, fmt, size, tags, AS_OF - dt.timedelta(days=c), AS_OF - dt.timedelta(days=m),
                     "indexed", "general"))
    df = spark.createDataFrame(rows, "doc_id long, id string, path string, title string, content string, "
                                     "format string, size long, tags array<string>, created_at timestamp_ntz, "
                                     "modified_at timestamp_ntz, status string, category string")
    return df.withColumn("content_hash", F.sha2("content", 256))
