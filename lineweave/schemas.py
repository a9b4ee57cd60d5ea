"""Column lists of the tables that are written, in order. Fixed values."""

MANIFEST = (
    "patch_filename", "source_image", "node_x", "node_y", "local_x", "local_y", "proposal_source", "proposal_type", "gap_len_px",
    "gap_radius_used", "endpoint_x", "endpoint_y", "target_x", "target_y", "proposal_score", "border_flag")
_HEADS, _CLASSES = ("cnn", "mlp", "svm", "xgb", "rf"), ("N", "T", "X", "Y")
PREDICTIONS = (
    *MANIFEST, "geometry_label", "geometry_branch_count", "geometry_min_gap_deg", "geometry_max_gap_deg", "geometry_anchor_x",
    "geometry_anchor_y", *[f"{h}_pred" for h in _HEADS], *[f"{h}_prob_{c}" for h in _HEADS for c in _CLASSES],
    *[f"avg_prob_{c}" for c in _CLASSES], "meta_pred", "meta_confidence", *[f"meta_prob_{c}" for c in _CLASSES], "gate_source_head",
    "gate_prob_positive", "gate_threshold_used", "gate_decision", "geometry_vote", "geometry_vote_applied", "cluster_id", "cluster_size",
    "cluster_label", "cluster_score", "consensus", "agreement", "raw_consensus", "raw_agreement", "raw_x_votes")
TILE_METADATA = (
    "key", "parent_id", "x0", "y0", "x1", "y1", "width", "height", "valid_ratio", "kept", "center_lat", "center_lon", "center_easting",
    "center_northing")
MATCHES = ("source_image", "true_label", "pred_label", "status", "distance", "gt_x", "gt_y", "pred_x", "pred_y")
PREDICTION_MINIMUM = ("source_image", "node_x", "node_y", "consensus", "agreement")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
