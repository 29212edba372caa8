"""A view of the map: only what is visible is built, and the view is the one on the whole map."""

import os

import pytest
from pyspark.sql import functions as F

from catalog import queries, tables
from mapweave.plans import viewing
from mapweave.plans.importing import tile_meshes
from mapweave.sources import tile_store

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture
def built(monkeypatch):
    """The tiles that meshes were asked for, per call; views are made anew."""
    asked = []

    def watched(m, wanted=None):
        asked.append(wanted)
        return tile_meshes(m, wanted)

    monkeypatch.setattr(queries, "tile_meshes", watched)
    monkeypatch.setattr(queries, "_SEEN", {})
    monkeypatch.setattr(tables, "_STORED", {})
    return asked


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_visible_tiles_are_built(spark, built, monkeypatch):
    monkeypatch.setattr(queries, "PLANES", [(1.0, 0.0, 0.0, 0.0)])  # the east
    got = rows(queries.QUERIES["geo9_visible_faces"](spark, SF))
    boxes = queries._boxes(spark, SF)
    seen = rows(viewing.visible_tiles(boxes, queries.PLANES))
    assert len(built) == 1 and rows(built[0]) == seen and 0 < len(seen) < boxes.count()
    queries.QUERIES["geo9_visible_meshes"](spark, SF)
    assert len(built) == 1

    whole = tile_store.read_tiles(spark, queries._mesh_store(spark, SF), span=queries.FACE_SPAN)
    near = viewing.near_meshes(whole.join(viewing.visible_tiles(boxes, queries.PLANES), ["tx", "ty"], "left_semi"), queries.EYE, queries.RADIUS)
    want = near.select("tx", "ty", "kind", "mesh", F.inline("faces")).groupBy("tx", "ty", "kind", "mesh", "part").count()
    assert got == rows(want) and got


def test_nothing_in_view(spark, built, monkeypatch):
    monkeypatch.setattr(queries, "PLANES", [(0.0, 0.0, 0.0, -1.0)])
    assert queries.QUERIES["geo9_visible_faces"](spark, SF).collect() == []
