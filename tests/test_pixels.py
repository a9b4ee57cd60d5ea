import numpy as np
import pytest

from lineweave.operators import components as C
from lineweave.operators import paths as T
from lineweave.operators import pixels as P
from tests import shapes as S

TILES = {"cross": S.cross(), "tee": S.tee(), "ring": S.ring(), "gap": S.gap(), "spur": S.spur(), "n10": S.noise(0.1, 1), "n30": S.noise(0.3, 2), "n60": S.noise(0.6, 3),
         "full": {(y, x) for y in range(S.SIDE) for x in range(S.SIDE)}, "dot": {(0, 0)}}


@pytest.fixture(scope="module")
def px(spark):
    return S.frame(spark, TILES).cache()


@pytest.fixture(scope="module")
def dims(spark):
    return S.dims(spark, TILES)


def test_degree(px):
    got = {(r["tile_id"], r["y"], r["x"]): r["deg"] for r in P.degree_map(px).collect()}
    assert got == {(t, *p): len(S.near(s, p)) for t, s in TILES.items() for p in s}


def test_degree_over_bands(spark, monkeypatch, px):
    monkeypatch.setattr(P.banded, "__defaults__", ("tile_id", 4))
    got = {(r["tile_id"], r["y"], r["x"]): r["deg"] for r in P.degree_map(px).collect()}
    assert got == {(t, *p): len(S.near(s, p)) for t, s in TILES.items() for p in s}


@pytest.mark.parametrize("block", [8, 256])
@pytest.mark.parametrize("diagonal", [True, False])
def test_components_over_blocks(px, monkeypatch, block, diagonal):
    monkeypatch.setattr(C, "BLOCK", block)
    found = {}
    for r in C.components(px, diagonal).collect():
        found.setdefault((r["tile_id"], r["comp_id"]), set()).add((r["y"], r["x"]))
    for t, s in TILES.items():
        assert {frozenset(g) for (tile, _), g in found.items() if tile == t} == S.groups(s, diagonal)
    for (_, comp), g in found.items():
        y, x = min(g)
        assert comp == y * P.PITCH + x


@pytest.mark.parametrize("block", [8, 256])
def test_fill_holes_over_blocks(px, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    out = C.fill_holes(px).cache()
    for t, s in TILES.items():
        assert S.pixels_of(out, t) == S.filled(s), t


def test_morph_skeleton(px, dims):
    def step(a, grow):
        pad = np.pad(a, 1, constant_values=not grow)
        parts = [pad[1:-1, 1:-1], pad[:-2, 1:-1], pad[2:, 1:-1], pad[1:-1, :-2], pad[1:-1, 2:]]
        return np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)

    out = C.morph_skeleton(px.where("tile_id <> 'full'"), dims).cache()
    for t, s in TILES.items():
        if t == "full":
            continue
        a = np.zeros((S.SIDE, S.SIDE), dtype=bool)
        for p in s:
            a[p] = True
        want = np.zeros_like(a)
        while a.any():
            e = step(a, False)
            want |= a & ~step(e, True)
            a = e
        assert S.pixels_of(out, t) == set(zip(*map(list, np.nonzero(want)))), t


def test_thin_keeps_groups_and_is_thin(px):
    out = T.thin(px.where("tile_id <> 'full'"), rounds=2).cache()
    for t in ("cross", "tee", "ring", "n30", "n60"):
        got = S.pixels_of(out, t)
        assert got <= TILES[t]
        assert len(S.groups(got)) == len(S.groups(TILES[t]))
        if t in ("cross", "tee", "ring"):      # noise may keep squares whose corners all carry a branch
            assert not any({(y, x), (y + 1, x), (y, x + 1), (y + 1, x + 1)} <= got for y, x in got)


def test_thin_does_not_depend_on_the_pass_length(px):
    thick = P.dilate(px.where("tile_id IN ('n10', 'tee', 'ring')"), P.square(5)).cache()
    assert {tuple(r) for r in T.thin(thick, rounds=1).collect()} == {tuple(r) for r in T.thin(thick, rounds=16).collect()}


def test_prune_spurs(px):
    out = T.prune_spurs(px).cache()
    assert S.pixels_of(out, "spur") == {(20, x) for x in range(S.SIDE)} | {p for p in TILES["spur"] if p == (19, 20)} - {(19, 20)} | (
        S.pixels_of(out, "spur") & {(19, 20)})
    assert not any(p in S.pixels_of(out, "spur") for p in [(15, 20), (16, 20), (17, 20)])
    assert S.pixels_of(out, "ring") == TILES["ring"]
    assert S.pixels_of(out, "tee") == TILES["tee"]


EDGE = [("zero", 5, 5, 5, 5), ("corner", 0, 0, 6, 3), ("edge", 0, 39, 7, 39), ("long", 1, 2, 38, 30), ("steep", 10, 3, 12, 35), ("back", 30, 30, 3, 20), ("up", 20, 30, 20, 5),
        ("near", 12, 12, 14, 13), ("flat", 4, 20, 33, 20)]


def test_corridor_contacts(spark, px):
    pairs = spark.createDataFrame([(t, f"{n}", x0, y0, x1, y1) for t in TILES for n, x0, y0, x1, y1 in EDGE], "tile_id string, id string, x0 int, y0 int, x1 int, y1 int")
    for r in T.corridor_contacts(px, pairs).collect():
        assert r["contacts"] == S.contacts(TILES[r["tile_id"]], r["x0"], r["y0"], r["x1"], r["y1"]), r


def test_local_junction_labels(spark, px):
    pts = spark.createDataFrame([("cross", 1, 20, 20), ("tee", 1, 20, 20), ("ring", 1, 10, 10), ("dot", 1, 30, 30)], "tile_id string, id long, x int, y int")
    got = {r["tile_id"]: r for r in T.local_junction(px, pts).collect()}
    assert got["tee"]["geometry_label"] == "T" and got["tee"]["branch_count"] == 3
    assert got["cross"]["branch_count"] == 4 and got["cross"]["geometry_label"] == "Unknown"
    assert got["dot"]["branch_count"] == 0


def test_bridge_closes_a_gap_into_a_tee(spark):
    tile = {"t": {(20, x) for x in range(40)} | {(y, 20) for y in range(24, 40)}}
    px = S.frame(spark, tile)
    out = [r for r in T.virtual_bridges(px, S.dims(spark, tile)).collect() if r["reason"] == "accepted"]
    assert out and all(abs(r["node_x"] - 20) <= 2 and abs(r["node_y"] - 21) <= 3 for r in out)
    assert T.accepted_bridges(T.virtual_bridges(px, S.dims(spark, tile))).count() >= 1


def test_termini_and_context(spark, px):
    pts = spark.createDataFrame([("tee", 7, 20, 20)], "tile_id string, id long, x int, y int")
    ends = sorted((r["terminus"], r["length"]) for r in T.branch_termini(px, pts).collect())
    assert [e for e, _ in ends].count("endpoint") + [e for e, _ in ends].count("junction") == len(ends)


def test_row_order_does_not_matter(spark, px):
    a = {tuple(r) for r in C.components(px).collect()}
    b = {tuple(r) for r in C.components(px.orderBy("x", "y", ascending=False).repartition(5)).collect()}
    assert a == b


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_neighbour_operators_shuffle_once(spark, px, tmp_path):
    px.write.parquet(str(tmp_path / "px"))
    stored = spark.read.parquet(str(tmp_path / "px"))
    assert exchanges(P.degree_map(stored)) == 1
    assert exchanges(P.degree_map(stored, neighbours=True)) == 1
    assert exchanges(P.erode(stored, P.disk(3))) == 1
    plan = P.degree_map(stored.where("tile_id = 'tee'"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(tile_id), EqualTo(tile_id,tee)]" in plan


def test_contacts_of_diagonals_and_of_lines_given_twice(spark):
    """On a diagonal a pixel that counts lies up to six rows from the middle of its piece; lines may come twice."""
    tile = S.noise(0.5, 11, 40)
    px = S.frame(spark, {"t": tile})
    ends = [(5, 5, 33, 33), (33, 6, 6, 33), (2, 3, 12, 13), (30, 30, 20, 20), (8, 30, 30, 12), (5, 5, 33, 33)]
    pairs = spark.createDataFrame([("t", i, *e) for i, e in enumerate(ends)], "tile_id string, id int, x0 int, y0 int, x1 int, y1 int")
    got = {r["id"]: r["contacts"] for r in T.corridor_contacts(px, pairs).collect()}
    assert got == {i: S.contacts(tile, *e) for i, e in enumerate(ends)}


def test_bridges_send_only_ends_to_the_blocks(spark):
    """Neither the target nor the path of a candidate goes round with it; what is kept of the angles is as Spark merges them."""
    from pyspark.sql import functions as F

    import numpy as np

    rng = np.random.default_rng(4)
    angles, lengths = rng.integers(0, 24, (200, 8)) * 15.0, rng.integers(0, 4, (200, 8)) * 1.0
    rows = spark.createDataFrame([(i, [{"angle": float(a), "length": float(n)} for a, n in zip(x, y) if n >= 1]) for i, (x, y) in enumerate(zip(angles, lengths))],
                                 "id int, b array<struct<angle:double,length:double>>")
    for deg in (15.0, 20.0):
        n, gap = T._merged(angles, lengths, deg)
        cols = T.junction_columns(F.col("b"), deg)
        want = {r["id"]: (r["n"], r["g"]) for r in rows.select("id", cols["branch_count"].alias("n"), cols["min_gap_deg"].alias("g")).collect()}
        assert want == {i: (n[i], None if np.isnan(gap[i]) else gap[i]) for i in range(200)}
    px = S.frame(spark, {"t": S.noise(0.1, 3, 60)})
    plan = T.virtual_bridges(px, S.dims(spark, ["t"], 60))._jdf.queryExecution().executedPlan().toString()
    assert "path_y" not in plan and plan.count("BroadcastExchange") <= 1
