"""Reports as JSON, text, Markdown and HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME = 200 * 1024  # bytes of one response


def nested(clusters: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Clusters with their occurrences in order of path and line."""
    rest = [c for c in occurrences.columns if c != "cluster_id"]
    inner = occurrences.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("path", "start_line", *(c for c in rest if c not in ("path", "start_line"))))).alias("occurrences"))
    return clusters.join(inner, "cluster_id", "left")


def json_rows(report: DataFrame) -> DataFrame:
    """value: a JSON text a row, fields in column order; write it with .write.text."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))


def framed(rows: DataFrame, order: str, most: int = FRAME) -> DataFrame:
    """The first rows of a page (a bounded one) whose JSON stays within `most` bytes."""
    sized = rows.withColumn("bytes_", F.octet_length(F.to_json(F.struct(*rows.columns))))
    upto = F.sum("bytes_").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sized.withColumn("upto_", upto).where(F.col("upto_") <= most).drop("bytes_", "upto_")


def text_rows(report: DataFrame) -> DataFrame:
    """value: a line a cluster, and one for each of its occurrences."""
    head = F.concat_ws(" ", F.concat(F.lit("#"), F.col("rank").cast("string")), "cluster_id", "kind", F.concat(F.lit("mass="), F.col("mass").cast("string")))
    body = F.transform("occurrences", lambda o: F.concat(F.lit("  "), o["path"], F.lit(":"), o["start_line"].cast("string")))
    return report.orderBy("rank", "cluster_id").select(F.array_join(F.concat(F.array(head), F.coalesce(body, F.array().cast("array<string>"))), "\n").alias("value"))


def markdown(cluster: dict) -> str:
    """One cluster, as a dictionary of its row."""
    places = "\n".join(f"- `{o['path']}:{o['start_line']}`" for o in cluster.get("occurrences") or ())
    return f"## {cluster['kind']} `{cluster['cluster_id']}`\n\nRank {cluster['rank']}, mass {cluster['mass']}.\n\n{places}\n"


def page(clusters: list[dict], title: str = "Duplicates") -> str:
    """An HTML page of a page of clusters."""
    rows = "".join(f"<tr><td>{c['rank']}<td>{html.escape(c['cluster_id'])}<td>{html.escape(c['kind'])}<td>{c['mass']}<td>{'<br>'.join(html.escape(o['path']) for o in c.get('occurrences') or ())}" for c in clusters)
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr><th>Rank<th>Id<th>Kind<th>Mass<th>Places{rows}</table>"
