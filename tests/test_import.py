"""The stored import: features of all kinds come from one job with one join of tags to shapes."""

import os

import pytest

from catalog import tables
from mapweave.config import ImportConfig
from mapweave.operators import features
from mapweave.plans.importing import import_map

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(df):
    return sorted((repr(r.asDict(recursive=True)) for r in df.collect()))


@pytest.mark.parametrize("config", [ImportConfig(), ImportConfig(min_area_size=5000.0, import_buildings=False), ImportConfig(simplify_geometry=True)])
def test_one_table_of_all_kinds(spark, config):
    n, w = tables.node_table(spark, SF), tables.way_table(spark, SF)
    m = import_map(n, w, config)
    met = features.with_shapes(w, m.shaped, config)
    for kind, want in (("road", m.roads), ("building", m.buildings), ("area", m.areas)):
        got = features.of_kind(met, kind, config)
        assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert rows(got) == rows(want)


def test_import_stores_features_once(spark, monkeypatch):
    made = []
    stored = tables.stored
    monkeypatch.setattr(tables, "_STORED", {})
    monkeypatch.setattr(tables, "_IMPORTED", {})
    monkeypatch.setattr(tables, "stored", lambda s, d, name, *rest: made.append(name) or stored(s, d, name, *rest))
    tables.imported(spark, SF)
    assert made and set(made) == {"nodes", "ways", "features"}
