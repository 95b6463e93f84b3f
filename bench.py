"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs over its whole tables into the ``noop`` sink.  ``BENCH_QUERIES`` (comma separated)
picks others, ``BENCH_QUERIES=all`` runs every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "language_content_profile", "text_profile", "keyword_hits", "md_headings", "csv_rows", "json_profile", "json_nodes", "xml_nodes",
    "html_title_text", "html_sanitize", "category_of", "detect_media", "state_changes", "current_state", "debounce", "throttle",
    "delivered_events", "archive_entries", "archive_parts", "cells", "merge_membership", "sheet_to_table", "paragraphs", "docx_html",
    "slide_text_runs", "epub_chapters", "ofd_elements", "pdf_text_ops", "mp3_frame", "wav_header", "mp4_summary", "bmp_header",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from lakefold.plans import QUERIES
    from lakefold.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = build_session("bench", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    seconds, failed = {}, {}
    for name in names:
        started = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
            print(name, seconds[name], file=sys.stderr, flush=True)
        except Exception as err:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = f"{type(err).__name__}: {str(err)[:200]}"
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}
    if failed:
        line["failed"] = failed
    print(json.dumps(line))


if __name__ == "__main__":
    main()
