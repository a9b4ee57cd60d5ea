"""Queries on prediction rows: votes, probabilities, the label ladder, cluster decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.functions import votes as V
from lineweave.operators import arbitration as A
from lineweave.plans.catalog import query
from lineweave.plans.derived import derived, with_fx
from lineweave.plans.points import clusters_sql, nms_sql

BY = ["scene_id"]
CFG = A.Settings(t_min_gap_floor=40.0, rescue_max_gap=200.0, rescue_min_gap_floor=20.0, rescue_min_agreement=2,
                 rescue_segment_two_arm=True, endpoint_mode="rescue_only", positive_only=True,
                 virtual_t_min_agreement=3, drop_border_virtual=True)
VOTE_LIST = "[cnn_pred, mlp_pred, svm_pred, xgb_pred]"
ROWS = with_fx("fx_rows")
AVG = ", ".join(f"(cnn_prob_{c} + mlp_prob_{c} + svm_prob_{c} + xgb_prob_{c}) / 4 AS avg_prob_{c}" for c in "NTXY")

# Votes as rows: the winner has most heads, then the earliest head.
VOTES = f"""cast_votes AS (SELECT id, unnest({VOTE_LIST}) AS v, unnest([1, 2, 3, 4]) AS pos FROM fx_rows),
tally AS (SELECT id, v, count(*) AS n, min(pos) AS first FROM cast_votes GROUP BY 1, 2),
won AS (SELECT id, arg_min(v, -n * 10 + first) AS consensus, CAST(max(n) AS INT) AS agreement,
        CAST(coalesce(sum(n) FILTER (WHERE v = 'X'), 0) AS INT) AS raw_x_votes,
        coalesce(arg_min(v, -n * 10 + first) FILTER (WHERE v <> 'X'), 'Y') AS second FROM tally GROUP BY id)"""


@query("vote", ROWS + f", {VOTES} SELECT id, consensus, agreement, raw_x_votes, second FROM won")
def vote(spark, sf):
    rows = A.with_votes(derived(spark, sf, "fx_rows"))
    return rows.select("id", "consensus", "agreement", "raw_x_votes",
                       V.second_best([F.col(f"{h}_pred") for h in V.HEADS]).alias("second"))


@query("index_majority", ROWS + """, i AS (SELECT id, unnest([id % 4, (id * 3 + 1) % 4, agreement % 4]) AS v FROM fx_rows),
t AS (SELECT id, v, count(*) AS n FROM i GROUP BY 1, 2)
SELECT id, CAST(arg_min(v, -n * 10 + v) AS INT) AS winner FROM t GROUP BY id""")
def index_majority(spark, sf):
    rows = derived(spark, sf, "fx_rows")
    votes = [(F.col("id") % 4).cast("int"), ((F.col("id") * 3 + 1) % 4).cast("int"), F.col("agreement") % 4]
    return rows.select("id", V.index_majority(votes).alias("winner"))


@query("prob_summary", ROWS + ", p AS (SELECT *, " + AVG + """ FROM fx_rows) SELECT id, """ + ", ".join(
    f"avg_prob_{c}, greatest(cnn_prob_{c}, mlp_prob_{c}, svm_prob_{c}, xgb_prob_{c}) AS max_prob_{c}, "
    f"(cnn_pred = '{c}')::INT + (mlp_pred = '{c}')::INT + (svm_pred = '{c}')::INT + (xgb_pred = '{c}')::INT AS vote_count_{c}"
    for c in "NTXY") + " FROM p")
def prob_summary(spark, sf):
    out = V.prob_summary(derived(spark, sf, "fx_rows"))
    return out.select("id", *[f"{k}_{c}" for k in ("avg_prob", "max_prob", "vote_count") for c in V.CLASSES])


@query("choose_label", ROWS + """, o AS (SELECT id, unnest(['N', 'T', 'Y']) AS c, unnest([cnn_prob_N, cnn_prob_T, cnn_prob_Y]) AS p,
 unnest([0, 1, 3]) AS pos FROM fx_rows)
SELECT id, arg_min(c, -p * 1000 + pos) AS label, max(p) AS p FROM o GROUP BY id""")
def choose_label(spark, sf):
    best = V.choose_label(V.head_probs("cnn"), "veto")
    return derived(spark, sf, "fx_rows").select("id", best["label"].alias("label"), best["p"].alias("p"))


GATE_THR = """CASE WHEN (proposal_source = 'virtual_bridge' OR proposal_type LIKE 'virtual_gap%') AND border_flag THEN 0.7
     WHEN proposal_source = 'virtual_bridge' OR proposal_type LIKE 'virtual_gap%' THEN 0.6 ELSE 0.5 END"""


@query("gate", ROWS + f"""
SELECT id, CASE WHEN svm_prob_T + svm_prob_X + svm_prob_Y > 0 THEN least(1.0, svm_prob_T + svm_prob_X + svm_prob_Y)
                ELSE 1.0 - svm_prob_N END AS p, CAST({GATE_THR} AS DOUBLE) AS threshold FROM fx_rows""")
def gate(spark, sf):
    return derived(spark, sf, "fx_rows").select(
        "id", V.gate_probability(V.head_probs("svm")).alias("p"),
        V.gate_threshold(V.is_virtual(), F.col("border_flag")).alias("threshold"))


@query("probs_to_labels", ROWS + """
SELECT id, coalesce(cnn_prob_Y, 0) AS N, coalesce(cnn_prob_T * 2, 0) AS T0, 0.0::DOUBLE AS X, coalesce(cnn_prob_N, 0) AS Y FROM fx_rows""".replace(
    "coalesce(cnn_prob_T * 2, 0) AS T0", "least(1.0, cnn_prob_T * 2) AS T"))
def probs_to_labels(spark, sf):
    """A head trained without X, with its own class order."""
    vec = F.array("cnn_prob_N", "cnn_prob_Y", F.col("cnn_prob_T") * 2)
    return derived(spark, sf, "fx_rows").select("id", V.probs_to_labels(vec, ["Y", "N", "T"]).alias("p")).select("id", "p.*")


@query("decode_class", ROWS + """
SELECT id, CASE WHEN id % 2 = 0 THEN cnn_pred ELSE ['N', 'T', 'X', 'Y'][1 + id % 4] END AS label FROM fx_rows""")
def decode_class(spark, sf):
    value = F.when(F.col("id") % 2 == 0, F.col("cnn_pred")).otherwise((F.col("id") % 4).cast("string"))
    return derived(spark, sf, "fx_rows").select("id", V.decode_class(value, V.CLASSES).alias("label"))


LADDER = f"""{VOTES},
f0 AS (SELECT r.* EXCLUDE (agreement), w.consensus AS raw, w.agreement, w.second,
        (proposal_source = 'virtual_bridge' OR proposal_type LIKE 'virtual_gap%') AS virt, w.agreement < 3 AS weak
       FROM fx_rows r JOIN won w USING (id)),
f1 AS (SELECT *, CASE WHEN raw = 'X' THEN second ELSE raw END AS c1 FROM f0),
f2 AS (SELECT *, CASE WHEN c1 IN ('Y', 'X') AND geometry_label = 'T' THEN 'T'
                      WHEN c1 = 'T' AND geometry_label <> 'T' THEN 'Y' ELSE c1 END AS c2 FROM f1),
f3 AS (SELECT *, CASE WHEN virt AND c2 = 'Y' AND weak AND NOT (xgb_pred = 'Y' AND agreement >= 2 AND geometry_label <> 'T') THEN 'N'
                      WHEN virt AND c2 = 'T' AND weak THEN 'N' WHEN virt AND c2 = 'X' THEN 'N' ELSE c2 END AS c3 FROM f2),
f4 AS (SELECT *, CASE WHEN border_flag AND weak THEN 'N' ELSE c3 END AS c4 FROM f3),
f5 AS (SELECT *, CASE WHEN raw = 'X' AND c4 = 'T' THEN CASE WHEN list_contains({VOTE_LIST}, 'Y') THEN 'Y'
                      WHEN list_contains({VOTE_LIST}, 'N') THEN 'N' ELSE 'Y' END ELSE c4 END AS c5 FROM f4),
f6 AS (SELECT *, CASE WHEN proposal_source = 'base_topology' AND c5 = 'Y' AND xgb_pred <> 'Y' THEN 'N' ELSE c5 END AS c6 FROM f5),
f7 AS (SELECT *, CASE WHEN c6 = 'Y' AND cnn_pred = 'T' AND mlp_pred = 'T' AND svm_pred = 'T' AND xgb_pred = 'T' THEN 'T'
                      ELSE c6 END AS consensus FROM f6)"""


@query("synthesis_filter", ROWS + f", {LADDER} SELECT id, consensus, agreement FROM f7")
def synthesis_filter(spark, sf):
    return A.synthesis_filter(A.with_votes(derived(spark, sf, "fx_rows"))).select("id", "consensus", "agreement")


CURVED = "(agreement >= 2 AND coalesce(max_gap_deg > 200, false) AND coalesce(min_gap_deg >= 20, false))"
TY = f"""t0 AS (SELECT *, cnn_pred AS c0 FROM fx_rows),
t1 AS (SELECT *, CASE WHEN c0 = 'T' AND (min_gap_deg IS NULL OR min_gap_deg < 40) THEN 'Y' ELSE c0 END AS c1 FROM t0),
t2 AS (SELECT *, CASE WHEN c1 = 'Y' AND ({CURVED} OR (proposal_type = 'virtual_gap_endpoint_segment' AND geometry_label = 'Unknown'
                      AND branch_count = 2 AND agreement >= 2)) THEN 'T' ELSE c1 END AS c2 FROM t1),
t3 AS (SELECT *, CASE WHEN c2 = 'T' AND proposal_type = 'virtual_gap_endpoint_endpoint' AND NOT {CURVED} THEN 'Y' ELSE c2 END AS consensus FROM t2)"""


def _labelled(spark, sf):
    """Rows whose label so far is that of the first head."""
    return derived(spark, sf, "fx_rows").withColumn("consensus", F.col("cnn_pred"))


@query("ty_arbitrate", ROWS + f", {TY} SELECT id, consensus FROM t3")
def ty_arbitrate(spark, sf):
    return A.ty_arbitrate(_labelled(spark, sf), CFG).select("id", "consensus")


@query("output_filters", ROWS + """
SELECT id, cnn_pred AS consensus FROM fx_rows WHERE cnn_pred <> 'N'
 AND NOT (proposal_source = 'virtual_bridge' AND cnn_pred = 'T' AND agreement < 3)
 AND NOT (proposal_source = 'virtual_bridge' AND border_flag)""")
def output_filters(spark, sf):
    return A.output_filters(_labelled(spark, sf), CFG).select("id", "consensus")


@query("label_by_head", ROWS + """, o AS (SELECT id, unnest(['N', 'T', 'X', 'Y']) AS c,
 unnest([mlp_prob_N, mlp_prob_T, mlp_prob_X, mlp_prob_Y]) AS p, unnest([0, 1, 2, 3]) AS pos FROM fx_rows),
b AS (SELECT id, arg_min(c, -p * 1000 + pos) AS consensus FROM o GROUP BY id)
SELECT id, consensus, CASE WHEN consensus = 'N' THEN 0 ELSE 1 END AS agreement, mlp_pred AS raw_consensus,
       (mlp_pred = 'X')::INT AS raw_x_votes FROM b JOIN fx_rows USING (id)""")
def label_by_head(spark, sf):
    out = A.label_by_head(derived(spark, sf, "fx_rows"), "mlp", False, A.Settings(x_mode="enabled"))
    return out.select("id", "consensus", "agreement", "raw_consensus", "raw_x_votes")


@query("label_by_cascade", ROWS + f""", g AS (SELECT *, least(1.0, mlp_prob_T + mlp_prob_X + mlp_prob_Y) AS pos0, {GATE_THR} AS thr FROM fx_rows),
h AS (SELECT *, CASE WHEN mlp_prob_T + mlp_prob_X + mlp_prob_Y > 0 THEN pos0 ELSE 1 - mlp_prob_N END AS pos FROM g),
k AS (SELECT *, CASE WHEN pos < thr THEN 'N' WHEN mlp_prob_T >= mlp_prob_Y THEN 'T' ELSE 'Y' END AS kind,
  CASE WHEN branch_count <> 3 OR min_gap_deg IS NULL OR max_gap_deg IS NULL THEN ''
       WHEN max_gap_deg BETWEEN 155 AND 205 AND min_gap_deg BETWEEN 75 AND 95 THEN 'T' WHEN min_gap_deg >= 100 THEN 'Y' ELSE '' END AS gv FROM h)
SELECT id, pos AS gate_prob_positive, CASE WHEN pos < thr THEN 'reject' ELSE 'accept' END AS gate_decision,
       CASE WHEN kind <> 'N' THEN gv ELSE '' END AS geometry_vote,
       CASE WHEN kind <> 'N' AND gv <> '' AND gv <> kind THEN 'override' ELSE '' END AS geometry_vote_applied,
       CASE WHEN kind <> 'N' AND gv <> '' THEN gv ELSE kind END AS consensus FROM k""")
def label_by_cascade(spark, sf):
    out = A.label_by_head(derived(spark, sf, "fx_rows"), "mlp", True, A.Settings())
    return out.select("id", "gate_prob_positive", "gate_decision", "geometry_vote", "geometry_vote_applied", "consensus")


@query("keep_or_drop_n", ROWS + """
SELECT 'drop' AS rule, cnn_pred AS consensus, count(*) AS n FROM fx_rows WHERE cnn_pred <> 'N' GROUP BY 2
UNION ALL SELECT 'as_y', CASE WHEN cnn_pred = 'N' THEN 'Y' ELSE cnn_pred END, count(*) FROM fx_rows GROUP BY 2""")
def keep_or_drop_n(spark, sf):
    rows = _labelled(spark, sf)
    parts = [A.keep_or_drop_n(rows, as_y).groupBy(F.lit(rule).alias("rule"), "consensus").agg(F.count(F.lit(1)).alias("n"))
             for rule, as_y in (("drop", False), ("as_y", True))]
    return parts[0].unionByName(parts[1])


@query("mixed_cluster_arbitrate", with_fx("fx_rows", recursive=True)
       + ", ty AS (SELECT * FROM fx_rows WHERE cnn_pred IN ('T', 'Y')), " + clusters_sql("ty", "<= 900") + f""",
mix AS (SELECT cluster_id FROM ty JOIN cl USING (id) GROUP BY 1 HAVING count(DISTINCT cnn_pred) = 2)
SELECT r.id, CASE WHEN r.cnn_pred = 'T' AND cl.cluster_id IN (SELECT cluster_id FROM mix) AND NOT {CURVED} THEN 'Y'
             ELSE r.cnn_pred END AS consensus FROM fx_rows r LEFT JOIN cl USING (id)""")
def mixed_cluster_arbitrate(spark, sf):
    return A.mixed_cluster_arbitrate(_labelled(spark, sf), 30.0, BY, CFG).select("id", "consensus")


@query("same_label_nms", with_fx("fx_rows", recursive=True)
       + ", sub AS (SELECT *, scene_id || ':' || cnn_pred AS grp FROM fx_rows WHERE cnn_pred <> 'N'), "
       + nms_sql("sub", "-agreement, -proposal_score, id", "<= 1600", by="grp") + """
SELECT id, cnn_pred AS consensus FROM pts WHERE rk NOT IN (SELECT lose FROM dropped)
UNION ALL SELECT id, cnn_pred FROM fx_rows WHERE cnn_pred = 'N'""")
def same_label_nms(spark, sf):
    return A.same_label_nms(_labelled(spark, sf), 40.0, BY).select("id", "consensus")


@query("cluster_arbitrate", with_fx("fx_rows", recursive=True) + ", " + clusters_sql("fx_rows", "<= 900") + f""",
pr AS (SELECT r.*, cl.cluster_id, {AVG} FROM fx_rows r JOIN cl USING (id)),
m AS (SELECT cluster_id, count(*) AS cluster_size, avg(avg_prob_N) AS mn, avg(avg_prob_T) AS mt, avg(avg_prob_Y) AS my FROM pr GROUP BY 1),
v AS (SELECT *, greatest(mn, mt, my) AS score, CASE WHEN mn >= mt AND mn >= my THEN 'N' WHEN mt >= my THEN 'T' ELSE 'Y' END AS lab FROM m),
s AS (SELECT pr.id, v.*, row_number() OVER (PARTITION BY pr.cluster_id ORDER BY
   CASE lab WHEN 'N' THEN avg_prob_N WHEN 'T' THEN avg_prob_T ELSE avg_prob_Y END DESC, pr.id) AS rn FROM pr JOIN v ON v.cluster_id = pr.cluster_id)
SELECT id, cluster_id, cluster_size, lab AS cluster_label, round(score, 6) AS cluster_score,
       CASE WHEN rn = 1 THEN lab ELSE 'N' END AS consensus,
       CASE WHEN rn = 1 THEN greatest(1, CAST(round_even(score * 4, 0) AS INT)) ELSE 0 END AS agreement FROM s""")
def cluster_arbitrate(spark, sf):
    out = A.cluster_arbitrate(V.prob_summary(_labelled(spark, sf)), 30.0, BY)
    return out.select("id", "cluster_id", "cluster_size", "cluster_label", F.round("cluster_score", 6).alias("cluster_score"),
                      "consensus", "agreement")


@query("meta_override", ROWS + """, o AS (SELECT id, unnest(['N', 'T', 'Y']) AS c, unnest([xgb_prob_N, xgb_prob_T, xgb_prob_Y]) AS p,
 unnest([0, 1, 3]) AS pos FROM fx_rows),
b AS (SELECT id, arg_min(c, -p * 1000 + pos) AS meta_pred, max(p) AS conf FROM o GROUP BY id)
SELECT id, meta_pred, conf AS meta_confidence, CASE WHEN conf >= 0.7 THEN meta_pred ELSE cnn_pred END AS consensus,
       CASE WHEN conf >= 0.7 THEN greatest(1, CAST(round_even(conf * 4, 0) AS INT)) ELSE agreement END AS agreement
FROM b JOIN fx_rows USING (id)""")
def meta_override(spark, sf):
    rows = _labelled(spark, sf).withColumns({f"meta_prob_{c}": F.col(f"xgb_prob_{c}") for c in V.CLASSES})
    out = A.meta_override(rows, min_conf=0.7)
    return out.select("id", "meta_pred", "meta_confidence", "consensus", "agreement")
