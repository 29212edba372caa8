import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from mapweave.config import ImportConfig, TileConfig
from mapweave.operators import tiles
from mapweave.plans.importing import import_map
from mapweave.sources import map_xml, tile_store

XML = """<?xml version="1.0"?>
<osm>
  <node id="1" lat="52.5" lon="13.4"/>
  <node id="2" lat="52.5" lon="13.401"><tag k="a" v="1"/><tag k="b" v="2"/><tag k="a" v="3"/></node>
  <node id="3" lat="52.501" lon="13.401"/>
  <node id="-4" lat="52.501" lon="13.4"/>
  <node id="1" lat="52.4999" lon="13.3999"/>
  <way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="-4"/><nd ref="1"/><tag k="building" v="no"/><tag k="highway" v="service"/><tag k="landuse" v="forest"/></way>
  <way id="11"><nd ref="2"/><nd ref="99"/><nd ref="3"/><tag k="highway" v="primary"/></way>
  <way id="12"><nd ref="2"/><nd ref="99"/><tag k="highway" v="primary"/></way>
  <relation id="7"><member type="way" ref="10" role="outer"/><member type="area" ref="5" role=""/><member type="node" ref="2" role=""/><member type="relation" ref="8" role="x"/></relation>
</osm>
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("map")
    (folder / "m.osm").write_text(XML)
    (folder / "m.osm.gz").write_bytes(gzip.compress(XML.encode()))
    (folder / "m.osm.bz2").write_bytes(bz2.compress(XML.encode()))
    return folder


@pytest.mark.parametrize("name", ["m.osm", "m.osm.gz", "m.osm.bz2"])
def test_elements(spark, files, name):
    raw = map_xml.read_map_xml(spark, str(files / name))
    assert (raw.nodes.count(), raw.ways.count(), raw.relations.count()) == (5, 3, 1)
    nodes = {r.node_id: r for r in map_xml.last_per_id(raw.nodes, "node_id").collect()}
    assert sorted(nodes) == [-4, 1, 2, 3] and nodes[1].lat == 52.4999
    assert nodes[2].tags == {"a": "3", "b": "2"} and nodes[3].tags == {}
    refs = map_xml.way_refs(raw.ways).where("way_id = 10").orderBy("seq").collect()
    assert [r.node_id for r in refs] == [1, 2, 3, -4, 1]
    members = map_xml.relation_members(raw.relations).orderBy("seq").collect()
    assert [(m.type, m.ref, m.role) for m in members] == [("way", 10, "outer"), ("node", 2, ""), ("relation", 8, "x")]


def test_plain_files_are_split(spark, tmp_path):
    """Elements of one and of many lines, across the edges of many splits, each once and whole."""
    lines = ["<?xml version='1.0'?>", "<osm>"]
    for i in range(3000):
        lines.append(f'  <node id="{i}" lat="52.5" lon="13.4"/>' if i % 2 else f'  <node\n id="{i}" lat="52.5"\n lon="13.4">\n    <tag k="a>b" v="{i}"/>\n  </node>')
    for i in range(1000):
        lines.append(f'  <way id="{i}">\n    <nd ref="{i}"/>\n    <nd ref="{i + 1}"/><nd ref="{i + 2}"/>\n    <tag k="highway" v="service"/>\n  </way>')
    (tmp_path / "m.osm").write_text("\n".join([*lines, "</osm>"]))
    (tmp_path / "m.osm.bz2").write_bytes(bz2.compress((tmp_path / "m.osm").read_bytes()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = map_xml.read_map_xml(spark, str(tmp_path / "m.osm"))
        assert raw.nodes.rdd.getNumPartitions() > 8
        nodes = {r.node_id: r.tags for r in raw.nodes.collect()}
        assert raw.nodes.count() == 3000 and nodes == {i: {} if i % 2 else {"a>b": str(i)} for i in range(3000)}
        ways = {r.way_id: (r.node_refs, r.tags) for r in raw.ways.collect()}
        assert raw.ways.count() == 1000 and ways == {i: ([i, i + 1, i + 2], {"highway": "service"}) for i in range(1000)}
        assert map_xml.read_map_xml(spark, str(tmp_path / "m.osm.bz2")).nodes.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_row_is_longer_than_a_tag(spark, tmp_path, monkeypatch):
    """Sections of other kinds are never read as one row, and elements are whole wherever splits cut them."""
    join = map_xml._join_tags

    def watched(kind, edges):
        inner = join(kind, edges)

        def run(batches):
            def short(batch):
                assert max(map(len, batch.column(0).to_pylist()), default=0) < 100
                return batch

            return inner(short(b) for b in batches)

        return run

    monkeypatch.setattr(map_xml, "_join_tags", watched)
    lines = ["<osm>", *[f'<node id="{i}" lat="1" lon="2"/>' for i in range(2000)], *[f'<way id="{i}"><nd ref="{i}"/><nd ref="7"/></way>' for i in range(2000)]]
    members = "".join(f'<member type="way" ref="{i}" role=""/>' for i in range(3000))
    (tmp_path / "m.osm").write_text("".join([*lines, f'<relation id="1">{members}</relation>', '<relation id="2"/>', '<node id="9000" lat="1" lon="2"></node>', "</osm>"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, rows in (("128m", "10000"), ("30000", "100"), ("7001", "7"), ("20000", "1")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            raw = map_xml.read_map_xml(spark, str(tmp_path / "m.osm"))
            assert sorted(r.node_id for r in raw.nodes.collect()) == [*range(2000), 9000]
            assert sorted((r.way_id, *r.node_refs) for r in raw.ways.collect()) == [(i, i, 7) for i in range(2000)]
            assert {r.rel_id: [m.ref for m in r.members] for r in raw.relations.collect()} == {1: list(range(3000)), 2: []}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_plain_elements_need_no_parser(spark, tmp_path, monkeypatch):
    """Elements as tools write them are read without the XML parser; what it would read otherwise goes to it, with its results."""
    odd = [
        '<way id="1" id="1"></way>', '<way id="2" version="1" version="2"><nd ref="5"/></way>', '<way id="3" <nd ref="5"/> ></way>',
        '<way id="4"><tag k="a&amp;b" v="&lt;"/><nd ref="6"/></way>', "<way id='5'><nd ref='7'/></way>", '<way id="6"><nd ref="007"/><nd ref="8"/></way>',
        '<way id="7"><tag v="x" k="y"/></way>', '<way id="8"><tag k="a" v="1\n2"/></way>', '<way id="9">some text<nd ref="9"/></way>',
        '<way id="9223372036854775808"><nd ref="1"/></way>', '<way id="10" user="<nd ref="1"/>"></way>', '<way id="11"><tag k="a" v="\x01"/></way>',
        '<way id="12"><tag k="a" v="1"><!-- x --></tag></way>', '<way id="13"><nd/><nd ref="x"/><nd ref="4"/></way>',
    ]
    plain = [
        '<way id="20"/>', '<way id="-21"></way>', '<way version="2" user="a b" id="22" >\n <nd ref="1"/>\n<nd ref="-2" /><tag k=" a " v=""/><tag k="b" v="  9 x"/>\n</way >',
        '<way id="23"><tag k="a" v="\u00e9\u2028\U0001f600\'"/><nd ref="123456789012345678"/></way>', '<way id="24" user=" id"><tag k="id" v="= 7"/></way>',
    ]
    (tmp_path / "m.osm").write_text("<osm>" + "\n".join(odd + plain) + "</osm>", encoding="utf-8")
    (tmp_path / "plain.osm").write_text("<osm>" + "\n".join(plain) + "</osm>", encoding="utf-8")
    rows = lambda name: sorted((r.way_id, r.node_refs, sorted(r.tags.items())) for r in map_xml.read_map_xml(spark, str(tmp_path / name)).ways.collect())
    got, few = rows("m.osm"), rows("plain.osm")
    assert few == [
        (-21, [], []), (20, [], []), (22, [1, -2], [("a", ""), ("b", "9 x")]), (23, [123456789012345678], [("a", "\u00e9\u2028\U0001f600'")]),
        (24, [], [("id", "= 7")]),
    ]
    with monkeypatch.context() as m:
        m.setattr(map_xml, "_is_plain", lambda kind, text: F.lit(False))
        assert rows("m.osm") == got and rows("plain.osm") == few
    monkeypatch.setattr(map_xml.F, "from_xml", lambda text, schema, options: F.lit(None).cast(f"struct<{schema}>".replace(" long", ":long").replace(" double", ":double").replace(" array", ":array")))
    assert rows("plain.osm") == few


def test_import_of_a_file(spark, files):
    raw = map_xml.read_map_xml(spark, str(files / "m.osm"))
    m = import_map(map_xml.last_per_id(raw.nodes, "node_id"), map_xml.last_per_id(raw.ways, "way_id"))
    assert {r.osm_id: len(r.polyline) for r in m.roads.collect()} == {10: 5, 11: 2}
    assert [(r.osm_id, r.type, len(r.footprint)) for r in m.buildings.collect()] == [(10, "Unknown", 5)]
    assert m.areas.count() == 0
    off = import_map(raw.nodes, raw.ways, ImportConfig(import_roads=False, import_buildings=False))
    assert off.roads.count() == off.buildings.count() == 0
    assert import_map(raw.nodes, raw.ways, ImportConfig(simplify_geometry=True, simplify_tolerance=1e4)).roads.count() == 2


def test_tiles_are_clamped(spark):
    box = spark.createDataFrame([(0.0, 0.009, 0.0, 0.009)], "min_lat double, max_lat double, min_lon double, max_lon double")
    grid = tiles.tile_grid(box, TileConfig(tile_size=500.0))
    g = grid.first()
    assert (g.grid_width, g.grid_height) == (3, 3)
    points = [(g.grid_x, g.grid_y), (g.grid_x + 500.0, g.grid_y), (1e6, -1e6), (-1e6, 1e6)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    assert [(r.tx, r.ty) for r in tiles.point_tiles(df, grid).collect()] == [(0, 0), (1, 0), (2, 0), (0, 2)]
    empty = tiles.tile_grid(box.where("min_lat > 5"))
    assert empty.count() == 0


def test_tile_store_reads_only_its_folders(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 20).cast("int").alias("tx"), F.floor(F.col("id") / 20).cast("int").alias("ty"), "id")
    tile_store.write_tiles(df, str(tmp_path / "store"), span=4)
    got = tile_store.read_tiles(spark, str(tmp_path / "store"), span=4, x_range=(3, 5), y_range=(10, 10))
    assert sorted((r.tx, r.ty) for r in got.collect()) == [(3, 10), (4, 10), (5, 10)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(px" in plan and "PushedFilters: [IsNotNull(tx)" in plan
    assert tile_store.read_tiles(spark, str(tmp_path / "store"), span=4).count() == 400
    keys = spark.createDataFrame([(i, 7) for i in range(20)], "tx int, ty int").where("tx = 13")
    few = tile_store.read_keys(spark, str(tmp_path / "store"), keys, span=4)
    assert [(r.tx, r.ty) for r in few.collect()] == [(13, 7)]
