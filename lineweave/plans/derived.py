"""Input shapes derived from the star-schema tables (see FIXTURES.md).

The text runs unchanged in Spark SQL and in DuckDB, so both sides of a check read the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lineweave.session import cut

_PIXEL_KEY = """CAST(floor(l_orderkey / 1000) AS INT) AS tile_id,
       CAST((l_partkey * 7) % 192 AS INT) AS y,
       CAST((l_suppkey * 31 + l_linenumber * 57 + l_orderkey * 13) % 192 AS INT) AS x"""

TILE_SIDE = 192
SCENE_SIDE = 768


def _cls(expr: str) -> str:
    return f"CASE {expr} % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'Y' WHEN 2 THEN 'X' ELSE 'N' END"


_NODES = """SELECT CAST(floor(o_orderkey / 4) AS INT) AS node, CAST(o_orderkey % 4 AS INT) AS arm, CAST(floor(o_orderkey / 144) AS INT) AS tile_id,
       CAST(64 + 128 * (floor(o_orderkey / 4) % 6) + (floor(o_orderkey / 4) * 7) % 9 - 4 AS INT) AS cx,
       CAST(64 + 128 * (floor(floor(o_orderkey / 4) / 6) % 6) + (floor(o_orderkey / 4) * 11) % 9 - 4 AS INT) AS cy,
       CAST(floor(floor(o_orderkey / 4) / 5) % 4 AS INT) AS rot,
       CASE CAST(floor(o_orderkey / 144) AS INT) % 4 WHEN 0 THEN 20 ELSE 58 END AS len,
       CAST(CASE WHEN floor(o_orderkey / 144) % 4 = 0 THEN floor(o_orderkey / 4) % 5
                 WHEN floor(o_orderkey / 4) % CASE floor(o_orderkey / 144) % 4 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 18 END = 0 THEN floor(floor(o_orderkey / 4) / 6) % 3
                 ELSE 3 + floor(o_orderkey / 4) % 2 END AS INT) AS kind
FROM orders"""

FX = {
    # Sparse lines on tiles of 768 px: nodes of three or four arms, plain lines (kind 3) and T nodes with a broken stem (kind 4). STEPS(n) are the rows 0 .. n - 1.
    "fx_lines": (
        "orders",
        f"""SELECT DISTINCT tile_id, CAST(cy + floor((k * dy + 500) / 1000.0) AS INT) AS y, CAST(cx + floor((k * dx + 500) / 1000.0) AS INT) AS x FROM (
  SELECT *, STEPS(60) AS k, CASE rot WHEN 0 THEN ux WHEN 1 THEN -uy WHEN 2 THEN -ux ELSE uy END AS dx, CASE rot WHEN 0 THEN uy WHEN 1 THEN ux WHEN 2 THEN -uy ELSE -ux END AS dy
  FROM (SELECT *, CASE WHEN kind = 1 THEN CASE arm WHEN 0 THEN 0 WHEN 1 THEN 866 ELSE -866 END ELSE CASE arm WHEN 0 THEN 1000 WHEN 2 THEN -1000 ELSE 0 END END AS ux,
          CASE WHEN kind = 1 THEN CASE arm WHEN 0 THEN -1000 ELSE 500 END ELSE CASE arm WHEN 1 THEN 1000 WHEN 3 THEN -1000 ELSE 0 END END AS uy
        FROM ({_NODES}) WHERE (arm < 3 OR kind = 2) AND (kind <> 3 OR arm <> 1)))
WHERE k < len AND NOT (kind = 4 AND arm = 1 AND k = 1)""",
    ),
    # The planted nodes, and where a first guess puts them: up to 2 px off, with any label.
    "fx_nodes": (
        "orders",
        f"""SELECT tile_id, node AS id, kind, cx, cy, CASE kind WHEN 1 THEN 'Y' WHEN 2 THEN 'X' WHEN 3 THEN 'N' ELSE 'T' END AS planted,
       CAST(cx + node % 5 - 2 AS INT) AS x, CAST(cy + (node * 3) % 5 - 2 AS INT) AS y, {_cls("(node * 3)")} AS label
FROM ({_NODES}) WHERE arm = 0""",
    ),
    "fx_pixels": ("lineitem", f"SELECT DISTINCT {_PIXEL_KEY} FROM lineitem"),
    "fx_gray": (
        "lineitem",
        f"SELECT {_PIXEL_KEY}, max(CAST((l_partkey * 11 + l_orderkey * 3) % 256 AS INT)) AS v "
        "FROM lineitem GROUP BY 1, 2, 3",
    ),
    "fx_prob": (
        "lineitem",
        f"SELECT {_PIXEL_KEY}, max(CAST((l_partkey * 17 + l_orderkey * 29) % 1000 AS INT)) AS p_milli "
        "FROM lineitem GROUP BY 1, 2, 3",
    ),
    "fx_detections": (
        "orders",
        f"""SELECT o_orderkey AS id, CAST(floor(o_orderkey / 100) AS INT) AS scene_id,
       CAST((o_custkey * 37 + o_orderkey * 11) % 768 AS INT) AS x,
       CAST((o_orderkey * 53 + o_custkey * 5) % 768 AS INT) AS y,
       CAST(o_totalprice / 500000.0 AS DOUBLE) AS score,
       {_cls("o_orderkey")} AS cnn_pred, {_cls("(o_orderkey + o_custkey)")} AS mlp_pred,
       {_cls("(o_custkey)")} AS svm_pred, {_cls("(o_orderkey * 3 + 1)")} AS xgb_pred,
       CAST((o_orderkey * 7) % 180 AS DOUBLE) AS min_gap_deg,
       CAST(120 + (o_custkey * 13) % 120 AS DOUBLE) AS max_gap_deg,
       CAST(2 + (o_orderkey + o_custkey) % 3 AS INT) AS branch_count,
       CASE WHEN o_orderkey % 3 = 0 THEN 'virtual_bridge' ELSE 'base_topology' END AS proposal_source
FROM orders""",
    ),
    "fx_truth": (
        "orders",
        f"""SELECT o_orderkey AS gt_id, CAST(floor(o_orderkey / 100) AS INT) AS scene_id,
       CAST((o_custkey * 37 + o_orderkey * 11) % 768 + o_orderkey % 9 - 4
            + CASE WHEN o_orderkey % 11 = 0 THEN 40 ELSE 0 END AS INT) AS x,
       CAST((o_orderkey * 53 + o_custkey * 5) % 768 + o_orderkey % 7 - 3 AS INT) AS y,
       {_cls("(o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END)")} AS true_label
FROM orders WHERE o_orderkey % 3 <> 0""",
    ),
    "fx_scenes": (
        "orders",
        """SELECT DISTINCT CAST(floor(o_orderkey / 100) AS INT) AS scene_id,
       CAST(40 + (floor(o_orderkey / 100) * 7) % 100 / 10.0 AS DOUBLE) AS center_lat
FROM orders""",
    ),
    "fx_raw": (
        "orders",
        f"""SELECT o_orderkey AS id, CAST(floor(o_orderkey / 100) AS INT) AS scene_id,
       CASE o_orderkey % 5 WHEN 0 THEN ' t ' WHEN 1 THEN 'Y' WHEN 2 THEN 'x' WHEN 3 THEN 'n ' ELSE '' END AS label,
       CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'bad' WHEN 2 THEN 'nan' WHEN 3 THEN 'inf' WHEN 4 THEN ' 12.5 '
            WHEN 5 THEN '-3' ELSE CAST(o_custkey AS STRING) END AS num_text,
       CASE o_orderkey % 11 WHEN 0 THEN 'true' WHEN 1 THEN 'Yes' WHEN 2 THEN '0' WHEN 3 THEN 'f' WHEN 4 THEN ''
            WHEN 5 THEN '2.5' WHEN 6 THEN '-1' WHEN 7 THEN 'oops' WHEN 8 THEN ' T ' WHEN 9 THEN 'no' ELSE '1' END AS flag_text,
       CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
       CASE o_custkey % 4 WHEN 0 THEN 'virtual_bridge' WHEN 1 THEN ' base_topology ' ELSE '' END AS src_text,
       CASE o_orderkey % 4 WHEN 0 THEN 'virtual_gap_endpoint_segment' WHEN 1 THEN 'base_junction' ELSE '' END AS type_text,
       CASE o_orderkey % 6 WHEN 0 THEN 'tile_y00128_x0_gap' WHEN 1 THEN 'ESP_011__y1' WHEN 2 THEN 'hirise_ESP_9__y00'
            WHEN 3 THEN 'tile_7_skel' WHEN 4 THEN 'Scene_MASK' ELSE 'other__b' END AS stem,
       CAST((o_custkey * 37 + o_orderkey * 11) % 800 - 16 AS INT) AS x,
       CAST((o_orderkey * 53 + o_custkey * 5) % 800 - 16 AS INT) AS y,
       CAST((o_custkey * 29 + o_orderkey) % 3600 / 10.0 AS DOUBLE) AS ang_a,
       CAST((o_custkey * 7 + o_orderkey * 3) % 3600 / 10.0 AS DOUBLE) AS ang_b,
       CAST((o_custkey * 13 + o_orderkey * 17) % 3600 / 10.0 AS DOUBLE) AS ang_c,
       CAST(o_orderkey % 5 AS INT) AS n_arms, CAST(1 + o_custkey % 37 AS DOUBLE) AS len_a,
       CAST(1 + o_orderkey % 41 AS DOUBLE) AS len_b
FROM orders""",
    ),
    "fx_rows": (
        "orders",
        f"""SELECT o_orderkey AS id, CAST(floor(o_orderkey / 100) AS INT) AS scene_id,
       CAST((o_custkey * 37 + o_orderkey * 11) % 768 AS INT) AS x,
       CAST((o_orderkey * 53 + o_custkey * 5) % 768 AS INT) AS y,
       {_cls("o_orderkey")} AS cnn_pred, {_cls("(o_orderkey + o_custkey)")} AS mlp_pred,
       {_cls("(o_custkey)")} AS svm_pred, {_cls("(o_orderkey * 3 + 1)")} AS xgb_pred,
       CASE o_custkey % 5 WHEN 0 THEN 'T' WHEN 1 THEN 'Y_balanced' WHEN 2 THEN 'Y_arrowhead' WHEN 3 THEN 'T'
            ELSE 'Unknown' END AS geometry_label,
       CASE WHEN o_orderkey % 3 = 0 THEN 'virtual_bridge' ELSE 'base_topology' END AS proposal_source,
       CASE WHEN o_orderkey % 6 = 0 THEN 'virtual_gap_endpoint_endpoint'
            WHEN o_orderkey % 3 = 0 THEN 'virtual_gap_endpoint_segment' ELSE 'base_junction' END AS proposal_type,
       o_orderkey % 13 = 0 AS border_flag,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 120 AS DOUBLE) END AS min_gap_deg,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(120 + (o_custkey * 13) % 120 AS DOUBLE) END AS max_gap_deg,
       CAST(2 + (o_orderkey + o_custkey) % 3 AS INT) AS branch_count,
       CAST((o_custkey * 11 + o_orderkey * 5) % 97 / 16.0 AS DOUBLE) AS proposal_score,
       CAST(o_orderkey % 5 AS INT) AS agreement,
       {", ".join(f"CAST((o_orderkey * {3 + 2 * h} + o_custkey * {5 + 4 * c}) % 64 / 64.0 AS DOUBLE) AS {m}_prob_{k}"
                  for h, m in enumerate(("cnn", "mlp", "svm", "xgb")) for c, k in enumerate("NTXY"))}
FROM orders""",
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """One derived table. Only the columns a query uses reach the parquet scan.

    ``dealt``: the rows are dealt out first, for work that costs much for each row; a file may be read by one task."""
    base, text = FX[name]
    source = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    if "STEPS(" in text or dealt:
        # A few bytes of file become many rows or long ones here, so only what the text reads is dealt out.
        read = [c for c in source.columns if re.search(rf"\b{c}\b", text)]
        source = source.select(*read).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), read[0])
    text = re.sub(r"STEPS\((\d+)\)", lambda m: f"explode(sequence(0, {int(m[1]) - 1}))", text)
    return spark.sql(text.replace(f"FROM {base}", "FROM {src}"), src=source)


def in_order(px: DataFrame) -> DataFrame:
    """Pixels written in the order of tiles and rows: what is dealt out from there is packed smaller, and read many times."""
    return cut(px.sortWithinPartitions("tile_id", "y", "x"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fx(*names: str, recursive: bool = False) -> str:
    """``WITH fx_a AS (...), fx_b AS (...)`` for the SQL side of a check."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return re.sub(r"STEPS\((\d+)\)", r"unnest(range(\1))", head + ",\n".join(f"{n} AS ({FX[n][1]})" for n in names))
