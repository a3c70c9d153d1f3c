"""The load-test report over a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderstream.operators.loadstats import breaking_point, exceptions_by_message, failures_by_error, request_stats
from orderstream.schemas import CORE_REQUESTS
from orderstream.sinks.reports import export_report, stats_rows


def load_report(request_log: DataFrame, core_names: tuple[str, ...] = CORE_REQUESTS, **steps) -> dict[str, DataFrame]:
    """Report part to DataFrame. `steps` are the settings of the stepped load."""
    return {
        "stats": request_stats(request_log),
        "failures": failures_by_error(request_log),
        "exceptions": exceptions_by_message(request_log),
        "breaking_point": breaking_point(request_log, core_names, **steps),
    }


def export_load_report(report: dict[str, DataFrame], folder: str, version: str, phase: str) -> dict[str, str]:
    """Writes the parts as CSV and returns their paths."""
    titled = {
        "stats": stats_rows(report["stats"]),
        "failures": report["failures"].selectExpr(
            "method AS Method", "name AS Name", "error AS Error", "occurrences AS Occurrences"
        ),
        "exceptions": report["exceptions"].selectExpr(
            "occurrences AS Count", "message AS Message", "CAST(NULL AS STRING) AS Traceback", "nodes AS Nodes"
        ),
    }
    return {kind: export_report(rows, folder, version, phase, kind) for kind, rows in titled.items()}
