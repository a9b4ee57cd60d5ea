"""Writers: manifests, predictions, tile metadata, match details, one JSON document per image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave import schemas


def ordered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns in the given order; missing ones are empty."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_table(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "csv", partition: str | None = None) -> None:
    writer = ordered(df, columns).write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(partition) if partition else writer).save(path)


def write_manifest(df: DataFrame, path: str, fmt: str = "csv") -> None:
    write_table(df, path, schemas.MANIFEST, fmt)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", partition: str | None = None) -> None:
    write_table(df, path, schemas.PREDICTIONS, fmt, partition)


def write_tile_metadata(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder for each parent image; the master table is the same data read without the partition filter."""
    write_table(df, path, [c for c in schemas.TILE_METADATA if c in df.columns], fmt, partition="parent_id")


def write_match_details(df: DataFrame, path: str, fmt: str = "csv") -> None:
    write_table(df, path, schemas.MATCHES, fmt)


def image_summary(meta: DataFrame, dims: DataFrame, size: int, overlap: int, parent: str = "parent_id") -> DataFrame:
    """One row for each image: size, tile settings and kept/dropped counts; ``write.json`` makes one document per line."""
    from lineweave.operators.tiling import tile_summary

    return tile_summary(meta, parent).join(dims, parent).withColumns(
        {"tile_size": F.lit(size), "overlap": F.lit(overlap), "stride": F.lit(size - overlap)})


def detection_documents(dets: DataFrame, by: str, parameters: dict) -> DataFrame:
    """One document for each image: parameters, counts by label, detections. The detections of one image are one JSON value by
    definition of the format; ``write_table`` keeps them as rows where an image may hold very many."""
    rest = [c for c in dets.columns if c != by]
    counts = dets.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("counts"))
    rows = dets.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("detections"))
    settings = F.create_map(*[v for k, p in parameters.items() for v in (F.lit(k), F.lit(str(p)))])
    return rows.join(counts, by).select(by, settings.alias("parameters"), "counts", "detections")


def write_detections_json(dets: DataFrame, path: str, by: str, parameters: dict) -> None:
    detection_documents(dets, by, parameters).write.mode("errorifexists").json(path)


def write_split(parts: DataFrame, path: str) -> None:
    """``(key, part)`` as JSON lines, so that a long list of keys never has to fit one document."""
    parts.select("key", "part").write.mode("errorifexists").json(path)
