"""DuckDB twins of the registered queries, written as plain relational SQL.

Each twin is a list of named steps that the query needs and a final select.
They work on rows and windows, not on arrays as the Spark side does.
"""

from __future__ import annotations

import re


STEPS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def r(value: str, digits: int = 3) -> str:
    return f"(floor(({value}) * 1e{digits} + 5e-1) / 1e{digits})"


def rs(digits: int, *names: str) -> str:
    return ", ".join(f"{r(n, digits)} as {n}" for n in names)


def twin(name: str, final: str) -> None:
    """Register ``final`` with all steps it names, directly or through other steps, in order."""
    needed, look = set(), [final]
    while look:
        text = look.pop()
        for step in STEPS:
            if step not in needed and re.search(rf"\b{step}\b", text):
                needed.add(step)
                look.append(STEPS[step])
    with_ = ",\n".join(f"{n} as materialized ({STEPS[n]})" for n in STEPS if n in needed)
    ORACLE[name] = (f"with {with_}\n" if with_ else "") + final


# --- map tables ------------------------------------------------------------------

STEPS["geo_node"] = """
select p_partkey as node_id, 525e-1 + (p_partkey // 40) * 5e-4 as lat,
  134e-1 + (p_partkey % 40 - greatest(p_partkey % 5 - 2, 0)) * 7e-4 + greatest(p_partkey % 5 - 2, 0) * 14e-6 as lon
from part"""
STEPS["geo_wayref"] = """
with base as (
  select o_orderkey as k, 3 + o_orderkey % 5 as n, (o_orderkey * 17) % (select max(p_partkey) + 1 from part) as anchor from orders),
e as (select k, n, anchor, unnest(range(0, n)) as i from base),
f as (
  select k, n, case when k % 10 >= 5 then n - 1 - i else i end as seq,
    anchor + ([0,0,1,3,4,3,1])[i + 1] * 40 + ([0,2,3,3,1,-1,-1])[i + 1] as node_id from e)
select k as way_id, seq, node_id from f
union all
select k, n, node_id from f where seq = 0 and k % 5 in (2, 3, 4) and k % 11 <> 0"""
_COLOUR = "[null, 'Red', '#abc', '#A1B2C3', 'zzz']"
STEPS["geo_way"] = f"""
select k as way_id, case when k % 3 = 0 then 'way ' || k end as name,
  case when k % 5 < 2 then (['motorway','motorway_link','trunk','primary','secondary_link','tertiary','residential','living_street',
    'service','footway','pedestrian','steps','cycleway','path','track','bridleway','unclassified','construction'])[(k // 5) % 18 + 1]
    when k % 10 = 9 then 'residential' end as highway,
  case when k % 5 = 2 then (['yes','residential','commercial','industrial','retail','office','apartments','dormitory','house','detached',
    'bungalow','garage','carport','shed','hut','cathedral','mosque','university','clinic','warehouse','no','castle'])[(k // 5) % 22 + 1]
    when k % 10 = 9 then 'no' end as building,
  case when k % 5 = 3 and (k // 5) % 5 = 0 then (['water','wood','scrub','peak'])[(k // 25) % 4 + 1] end as "natural",
  case when k % 5 = 3 and (k // 5) % 5 < 2 then (['riverbank','river'])[(k // 25) % 2 + 1] end as waterway,
  case when k % 5 = 3 and (k // 5) % 5 = 2 then (['park','garden','pitch'])[(k // 25) % 3 + 1] end as leisure,
  case when (k % 5 = 3 and (k // 5) % 5 in (2, 3)) or k % 25 = 2 then
    (['forest','retail','meadow','vineyard','cemetery','reservoir','industrial','residential','quarry'])[(k // 25) % 9 + 1] end as landuse,
  case when k % 5 = 3 and (k // 5) % 5 = 4 then 'parking' end as amenity,
  case when k % 5 < 2 then ([null,'2','3;4','x',null])[(k // 7) % 5 + 1] end as lanes,
  case when k % 5 < 2 then ([null,null,'7.5','12 m',' 9','wide'])[(k // 11) % 6 + 1] end as width,
  case when k % 5 < 2 then (['50','30 mph','walk',null])[(k // 13) % 4 + 1] end as maxspeed,
  case when k % 5 < 2 then (['yes','1','-1','no',null])[(k // 3) % 5 + 1] end as oneway,
  case when k % 5 < 2 then ([null,null,'yes','no'])[(k // 17) % 4 + 1] end as bridge,
  case when k % 5 < 2 then ([null,null,null,'yes','no'])[(k // 19) % 5 + 1] end as tunnel,
  case when k % 5 = 2 then ([null,'12 m','12.5m',' 9','tall','30M'])[(k // 7) % 6 + 1] end as height,
  case when k % 5 = 2 then ([null,'4','2.5','n/a'])[(k // 11) % 4 + 1] end as building_levels,
  case when k % 5 = 2 then ([null,'flat','gabled','hip','pyramidal','lean_to','onion','mansard'])[(k // 13) % 8 + 1] end as roof_shape,
  case when k % 5 = 2 then ({_COLOUR})[(k // 5) % 5 + 1] end as building_colour,
  case when k % 5 = 2 then ({_COLOUR})[(k // 17) % 5 + 1] end as roof_colour
from (select o_orderkey as k from orders)"""

_RAD = "(pi() / 18e1)"


def merc_x(lon: str) -> str:
    return f"(6378137e0 * ({lon}) * {_RAD})"


def merc_y(lat: str) -> str:
    return f"(6378137e0 * ln(tan(pi() / 4e0 + least(greatest({lat}, -85.051128e0), 85.051128e0) * {_RAD} / 2e0)))"


STEPS["bounds"] = "select min(lat) as min_lat, max(lat) as max_lat, min(lon) as min_lon, max(lon) as max_lon from geo_node"
STEPS["measures"] = f"""
select *, (min_lat + max_lat) / 2e0 as center_lat, (min_lon + max_lon) / 2e0 as center_lon,
  (max_lon - min_lon) * (111320e0 * cos((min_lat + max_lat) / 2e0 * {_RAD})) as width_m,
  (max_lat - min_lat) * 111320e0 as height_m from bounds"""
STEPS["origin"] = f"select {merc_x('center_lon')} as origin_x, {merc_y('center_lat')} as origin_y from measures"
STEPS["pt"] = f"select node_id, {merc_x('lon')} - origin_x as x, {merc_y('lat')} - origin_y as y from geo_node, origin"
STEPS["rp"] = """
select way_id, row_number() over (partition by way_id order by seq) - 1 as i, count(*) over (partition by way_id) as n, x, y
from geo_wayref join pt using (node_id)"""
STEPS["closed"] = """
select way_id, count(*) as refs from geo_wayref group by way_id
having count(*) > 2 and arg_min(node_id, seq) = arg_max(node_id, seq)"""

# Ring steps: each point with the next one, the last joined to the first.
_NEXT = """
select *, coalesce(lead(x) over w, first_value(x) over w) as x1, coalesce(lead(y) over w, first_value(y) over w) as y1
from {src} window w as (partition by {key} order by i rows between unbounded preceding and unbounded following)"""
# lead needs no frame, first_value takes the whole partition.
STEPS["rp_next"] = _NEXT.format(src="rp", key="way_id")
STEPS["rp_area"] = "select way_id, case when max(n) < 3 then 0e0 else sum(x * y1 - x1 * y) / 2e0 end as area, max(n) as n from rp_next group by way_id"

_INT = r"regexp_extract({0}, '^\s*([+-]?[0-9]+)', 1)"
_FLOAT = r"regexp_extract({0}, '^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1)"


def stoi(text: str) -> str:
    return f"try_cast({_INT.format(text)} as integer)"


def stof(text: str) -> str:
    return f"try_cast({_FLOAT.format(text)} as double)"


def bare(text: str) -> str:
    return f"(case when {text} like '%m' or {text} like '%M' then left({text}, length({text}) - 1) else {text} end)"


_ROAD_CASE = """case when highway in ('motorway','motorway_link') then 'Motorway' when highway in ('trunk','trunk_link') then 'Trunk'
  when highway in ('primary','primary_link') then 'Primary' when highway in ('secondary','secondary_link') then 'Secondary'
  when highway in ('tertiary','tertiary_link') then 'Tertiary'
  when highway in ('residential','living_street','unclassified') then 'Residential' when highway = 'service' then 'Service'
  when highway in ('footway','pedestrian','steps') then 'Footway' when highway = 'cycleway' then 'Cycleway'
  when highway in ('path','track','bridleway') then 'Path' else 'Unknown' end"""
_BUILDING_CASE = """case building when 'residential' then 'Residential' when 'commercial' then 'Commercial' when 'industrial' then 'Industrial'
  when 'retail' then 'Retail' when 'office' then 'Office' when 'apartments' then 'Apartments' when 'dormitory' then 'Apartments'
  when 'house' then 'House' when 'detached' then 'Detached' when 'garage' then 'Garage' when 'carport' then 'Garage'
  when 'shed' then 'Shed' when 'hut' then 'Shed' when 'church' then 'Church' when 'cathedral' then 'Church' when 'chapel' then 'Church'
  when 'mosque' then 'Church' when 'temple' then 'Church' when 'synagogue' then 'Church' when 'school' then 'School'
  when 'university' then 'School' when 'college' then 'School' when 'hospital' then 'Hospital' when 'clinic' then 'Hospital'
  when 'warehouse' then 'Warehouse' else 'Unknown' end"""
_AREA_CASE = """coalesce(
  case when "natural" in ('water','bay','coastline') then 'Water' when "natural" in ('wood','tree_row') then 'Forest'
    when "natural" in ('grassland','scrub','heath') then 'Grass' end,
  case when waterway in ('riverbank','dock','boatyard') then 'Water' end,
  case when leisure in ('park','garden','playground','nature_reserve') then 'Park' end,
  case when landuse = 'residential' then 'Residential' when landuse in ('commercial','retail') then 'Commercial'
    when landuse = 'industrial' then 'Industrial' when landuse = 'forest' then 'Forest'
    when landuse in ('grass','meadow','village_green','recreation_ground') then 'Grass'
    when landuse in ('farmland','farmyard','orchard','vineyard') then 'Farmland' when landuse = 'cemetery' then 'Cemetery'
    when landuse in ('basin','reservoir') then 'Water' end,
  case when amenity = 'parking' then 'Parking' end, 'Unknown')"""
_ROOF_CASE = """case when roof_shape is null or roof_shape = 'flat' then 'Flat' when roof_shape in ('gabled','half-hipped','saltbox') then 'Gabled'
  when roof_shape in ('hipped','hip') then 'Hipped' when roof_shape = 'pyramidal' then 'Pyramidal'
  when roof_shape in ('skillion','lean_to') then 'Skillion' when roof_shape in ('dome','onion') then 'Dome' else 'Unknown' end"""
_HEIGHT = f"""coalesce({stof(f"split_part({bare('height')}, ' ', 1)")}, {stoi('building_levels')} * 3e0,
  case when building in ('garage','shed','hut','carport') then 3e0 when building in ('house','detached','bungalow') then 8e0
    when building in ('apartments','dormitory') then 15e0 when building in ('commercial','office') then 20e0
    when building in ('industrial','warehouse') then 12e0 when building in ('church','cathedral') then 25e0
    when building = 'hospital' then 18e0 when building in ('school','university') then 12e0 end, 10e0)"""
STEPS["classed"] = f"""
select *, {_ROAD_CASE} as road_type, {_BUILDING_CASE} as building_type, {_AREA_CASE} as area_type, {_ROOF_CASE} as roof_type,
  {_HEIGHT} as h from geo_way"""
STEPS["measured"] = f"""
select *, coalesce({stof(bare('width'))}, {stoi('lanes')} * 35e-1,
    case road_type when 'Motorway' then 14e0 when 'Trunk' then 105e-1 when 'Primary' then 10e0 when 'Secondary' then 8e0
      when 'Tertiary' then 7e0 when 'Residential' then 6e0 when 'Service' then 4e0 when 'Footway' then 2e0
      when 'Cycleway' then 25e-1 when 'Path' then 15e-1 else 6e0 end) as road_width,
  coalesce({stoi('lanes')}, case road_type when 'Motorway' then 4 when 'Trunk' then 3 when 'Primary' then 2 when 'Secondary' then 2
      when 'Tertiary' then 2 when 'Residential' then 2 when 'Unknown' then 2 else 1 end) as road_lanes,
  coalesce({stoi('building_levels')}, cast(trunc(h / 3e0) as integer)) as levels from classed"""
STEPS["road"] = f"""
select way_id as osm_id, road_type as type, road_width as width, road_lanes as lanes, {stof('maxspeed')} as speed_limit,
  coalesce(name, '') as name, coalesce(oneway in ('yes', '1'), false) as is_oneway, coalesce(bridge <> 'no', false) as is_bridge,
  coalesce(tunnel <> 'no', false) as is_tunnel, a.n as points
from measured join rp_area a using (way_id) where highway is not null and road_type <> 'Unknown' and a.n >= 2"""
STEPS["building_row"] = """
select way_id as osm_id, h as height, levels, building_type as type, roof_type, coalesce(name, '') as name,
  roof_colour as roof_color, building_colour as building_color, a.n as points, a.area
from measured join rp_area a using (way_id) join closed using (way_id) where building is not null and a.n >= 4"""
STEPS["area_row"] = """
select way_id as osm_id, area_type as type, coalesce(name, '') as name, a.n as points, a.area
from measured join rp_area a using (way_id) join closed using (way_id)
where building is null and area_type <> 'Unknown' and a.n >= 4"""
STEPS["road_pt"] = "select way_id as osm_id, i, n, x, y from rp where way_id in (select osm_id from road)"
_CCW = "select way_id as osm_id, case when area < 0 then rp.n - 1 - i else i end as i, rp.n, x, y from rp join {0} on osm_id = way_id"
STEPS["building_pt"] = _CCW.format("building_row")
STEPS["area_pt"] = _CCW.format("area_row")
STEPS["feature"] = """
select 'road' as kind, osm_id, type from road union all select 'building', osm_id, type from building_row
union all select 'area', osm_id, type from area_row"""
STEPS["grid"] = """
select greatest(cast(ceil(width_m / 5e2) as integer), 1) as gw, greatest(cast(ceil(height_m / 5e2) as integer), 1) as gh,
  -width_m / 2e0 as gx, -height_m / 2e0 as gy from measures"""
_TILE = """least(greatest(cast(floor((x - gx) / 5e2) as integer), 0), gw - 1) as tx,
  least(greatest(cast(floor((y - gy) / 5e2) as integer), 0), gh - 1) as ty"""
STEPS["bridge"] = f"""
select distinct kind, osm_id, {_TILE} from (
  select 'road' as kind, osm_id, x, y from road_pt union all select 'building', osm_id, x, y from building_pt
  union all select 'area', osm_id, x, y from area_pt), grid"""
STEPS["tile"] = "select distinct tx, ty from bridge"
STEPS["box"] = """
select tx, ty, gx + tx * 5e2 as min_x, 0e0 as min_y, -(gy + ty * 5e2 + 5e2) as min_z,
  gx + tx * 5e2 + 5e2 as max_x, 2e2 as max_y, -(gy + ty * 5e2) as max_z from tile, grid"""
STEPS["fitted"] = "select min(min_x) - 5e2 as fx0, -max(max_z) - 5e2 as fz0, max(max_x) + 5e2 as fx1, -min(min_z) + 5e2 as fz1 from box"
STEPS["world"] = f"select {r('fx0')} as wx0, {r('fz0')} as wz0, {r('fx1')} as wx1, {r('fz1')} as wz1 from fitted"
STEPS["chunk"] = """
select cx, cz, count(*) as points from (
  select cast(floor((x - wx0) / 5e2) as bigint) as cx, cast(floor((y - wz0) / 5e2) as bigint) as cz, * from pt, world)
where cx >= 0 and cz >= 0 and cx < ceil((wx1 - wx0) / 5e2) and cz < ceil((wz1 - wz0) / 5e2) group by cx, cz"""
STEPS["wcell"] = """
select cx, cz, ix, iz, wx0 + cx * 5e2 + ix * (5e2 / 31e0) as x, wz0 + cz * 5e2 + iz * (5e2 / 31e0) as z
from chunk, world, (select unnest(range(0, 32)) as ix), (select unnest(range(0, 32)) as iz)"""

# --- sources -----------------------------------------------------------------------

twin("src1_map_xml", """
select 'node' as kind, count(*) as n, cast(sum(node_id) as bigint) as id_sum from geo_node
union all select 'way', count(*), cast(sum(way_id) as bigint) from geo_way
union all select 'relation', count(*), cast(sum(rel_id) as bigint) from (select distinct way_id // 10 as rel_id from geo_way)""")
twin("src1_xml_nodes", f"select node_id, {rs(7, 'lat', 'lon')} from geo_node")
twin("src2_node_table", f"select node_id, {r('case when lat > 5251e-2 then lat + 1e-3 else lat end', 7)} as lat, {rs(7, 'lon')} from geo_node")
twin("src3_way_refs", "select way_id, seq, node_id from geo_wayref")
ORACLE["src3_xml_way_refs"] = ORACLE["src3_way_refs"]
twin("src4_relation_members", """
select way_id // 10 as rel_id, row_number() over (partition by way_id // 10 order by way_id) - 1 as seq,
  (['way','node','relation'])[way_id % 4 + 1] as type, way_id as ref, case when way_id % 3 = 0 then 'outer' else '' end as role
from geo_way where way_id % 4 <> 3""")
twin("src5_tag_map", "select way_id, highway, coalesce(name, '?') as name, 2 as n from geo_way where highway is not null")
twin("snk1_tile_store", """
select kind, tx, ty, count(*) as n, cast(sum(osm_id) as bigint) as id_sum from bridge
where tx between 1 and 2 and ty between 0 and 3 group by all""")

# --- projections and scalars ------------------------------------------------------------

twin("prj1_mercator", f"select node_id, {r(merc_x('lon'))} as x, {r(merc_y('lat'))} as y, {r(merc_y('lat + 4e1'))} as clamped_y from geo_node")


def lat_of(y: str) -> str:
    return f"((2e0 * atan(exp(({y}) / 6378137e0)) - pi() / 2e0) / {_RAD})"


def lon_of(x: str) -> str:
    return f"(({x}) / 6378137e0 / {_RAD})"


twin("prj2_mercator_to_degrees", f"select node_id, {r(lat_of(merc_y('lat') + ' * 5e-1'), 7)} as lat, {r(lon_of(merc_x('lon') + ' * 5e-1'), 7)} as lon from geo_node")
twin("prj3_local", f"select node_id, {rs(3, 'x', 'y')} from pt")
twin("prj4_local_to_degrees", f"select node_id, {r(lat_of('y + 1e1 + origin_y'), 7)} as lat, {r(lon_of('x - 1e1 + origin_x'), 7)} as lon from pt, origin")
twin("prj5_metres_per_degree", f"select node_id, {r('111320e0')} as per_lat, {r(f'111320e0 * cos(lat * {_RAD})')} as per_lon from geo_node")
twin("prj6_box_measures", f"select {rs(7, 'center_lat', 'center_lon')}, {rs(3, 'width_m', 'height_m')}, min_lat <= max_lat and min_lon <= max_lon as is_valid from measures")
STEPS["texts"] = " union all ".join(
    f"select way_id, '{k}' as key, {c} as text from geo_way where {c} is not null"
    for k, c in (("lanes", "lanes"), ("width", "width"), ("maxspeed", "maxspeed"), ("height", "height"),
                 ("building:levels", "building_levels"), ("name", "name"), ("oneway", "oneway"))
)
twin("scl1_leading_int", f"select way_id, key, cast({stoi('text')} as bigint) as value from texts")
twin("scl2_leading_float", f"select way_id, key, {stof('text')} as value from texts")
twin("scl3_speed_limit", f"select way_id, {stof('maxspeed')} as speed_limit from geo_way")
twin("scl4_oneway", "select way_id, coalesce(oneway in ('yes', '1'), false) as is_oneway from geo_way")
twin("scl5_bridge_tunnel", "select way_id, coalesce(bridge <> 'no', false) as is_bridge, coalesce(tunnel <> 'no', false) as is_tunnel from geo_way")
twin("scl6_names_colours", "select way_id, coalesce(name, '') as name, roof_colour as roof_color, building_colour as building_color from geo_way")


def rgba(r_, g, b, a=1.0) -> str:
    return f"[{r_}e0, {g}e0, {b}e0, {a}e0]"


def tag_colour(col: str, fallback: str) -> str:
    """Only the colour texts that the map tables hold."""
    return f"""case {col} when 'Red' then {rgba(.8, .2, .2)} when '#abc' then [170e0/255e0, 187e0/255e0, 204e0/255e0, 1e0]
      when '#A1B2C3' then [161e0/255e0, 178e0/255e0, 195e0/255e0, 1e0] else {fallback} end"""


def rgba_columns(col: str, digits: int = 4, prefix: str = "color_") -> str:
    return ", ".join(f"{r(f'{col}[{i}]', digits)} as {prefix}{k}" for i, k in enumerate("rgba", 1))


_WALL = f"""case when type in ('Commercial','Office') then {rgba(.6, .7, .8)} when type in ('Industrial','Warehouse') then {rgba(.5, .5, .5)}
  when type in ('Residential','House','Detached') then {rgba(.85, .75, .65)} when type = 'Apartments' then {rgba(.8, .75, .7)}
  when type = 'Church' then {rgba(.9, .88, .85)} when type in ('School','Hospital') then {rgba(.85, .8, .75)}
  when type = 'Retail' then {rgba(.75, .7, .65)} when type in ('Garage','Shed') then {rgba(.6, .55, .5)} else {rgba(.7, .7, .7)} end"""
_ROOF = f"""case when type in ('Commercial','Office') then {rgba(.3, .35, .4)} when type in ('Industrial','Warehouse') then {rgba(.35, .35, .35)}
  when type in ('Residential','House','Detached') then {rgba(.55, .35, .25)} when type = 'Apartments' then {rgba(.4, .4, .45)}
  when type = 'Church' then {rgba(.3, .3, .35)} when type in ('School','Hospital') then {rgba(.5, .3, .25)}
  when type = 'Retail' then {rgba(.4, .4, .4)} when type in ('Garage','Shed') then {rgba(.45, .4, .35)} else {rgba(.4, .4, .45)} end"""
_ROADC = f"""case when type in ('Motorway','Trunk') then {rgba(.2, .2, .25)} when type = 'Primary' then {rgba(.25, .25, .28)}
  when type = 'Secondary' then {rgba(.3, .3, .32)} when type in ('Tertiary','Residential') then {rgba(.35, .35, .38)}
  when type = 'Service' then {rgba(.4, .4, .42)} when type in ('Footway','Path') then {rgba(.6, .55, .45)}
  when type = 'Cycleway' then {rgba(.3, .5, .3)} else {rgba(.4, .4, .4)} end"""
_AREAC = f"""case type when 'Water' then {rgba(.25, .45, .65)} when 'Park' then {rgba(.35, .55, .35)} when 'Forest' then {rgba(.25, .4, .25)}
  when 'Grass' then {rgba(.45, .58, .4)} when 'Parking' then {rgba(.42, .42, .44)} when 'Commercial' then {rgba(.55, .5, .6)}
  when 'Residential' then {rgba(.52, .52, .48)} when 'Industrial' then {rgba(.5, .48, .42)} when 'Farmland' then {rgba(.6, .55, .4)}
  when 'Cemetery' then {rgba(.4, .48, .42)} else {rgba(.48, .48, .48)} end"""
twin("scl7_parse_colour", f"select way_id, {rgba_columns('c')} from (select way_id, {tag_colour('building_colour', '[0e0, 0e0, 0e0, 0e0]')} as c from geo_way)")
twin("scl8_default_colours", f"""
select what, osm_id, lift, {rgba_columns('c')} from (
  select 'wall' as what, osm_id, null::double as lift, {_WALL} as c from building_row
  union all select 'roof', osm_id, null, {_ROOF} from building_row union all select 'road', osm_id, null, {_ROADC} from road
  union all select 'area', osm_id, case type when 'Water' then 1e-2 when 'Parking' then 3e-2 else 2e-2 end, {_AREAC} from area_row)""")
twin("scl9_smooth_lerp", f"""
select node_id, {r('t * t * (3e0 - 2e0 * t)', 6)} as eased, {r('35e-2 * (1e0 - u) + 55e-2 * u', 4)} as color_r,
  {r('45e-2 * (1e0 - u) + 5e-1 * u', 4)} as color_g, {r('35e-2 * (1e0 - u) + 4e-1 * u', 4)} as color_b, {r('1e0 * (1e0 - u) + 1e0 * u', 4)} as color_a
from (select *, least(greatest(t, 0e0), 1e0) as u from (select node_id, (lat - 525e-1) * 4e1 as t from geo_node))""")
twin("scl10_labels", "select distinct kind, type from feature")

# --- classes -----------------------------------------------------------------------------

twin("cls1_road_class", "select way_id, road_type as type from classed")
twin("cls2_building_class", "select way_id, building_type as type from classed")
twin("cls3_area_class", "select way_id, area_type as type from classed")
twin("cls4_roof_class", "select way_id, roof_type as type from classed")
twin("cls5_building_height", "select way_id, h as height from classed")
twin("cls6_building_levels", "select way_id, levels from measured")
twin("cls7_road_width", "select way_id, road_width as width from measured")
twin("cls8_road_lanes", "select way_id, road_lanes as lanes from measured")

# --- filters --------------------------------------------------------------------------------

twin("flt1_roads", "select * from road")
twin("flt2_buildings", f"select * exclude (area, height), {rs(3, 'height')} from building_row")
twin("flt3_areas", "select * exclude (area) from area_row")
twin("flt4_closed_ways", "select way_id, refs from closed")
twin("flt5_import_switches", """
select kind, type, count(*) as n from feature where kind = 'building' or (kind = 'area' and type in ('Park', 'Forest', 'Grass')) group by all""")
_INSIDE = "select * from geo_node where lat between 52501e-3 and 60e0 and lon between 13401e-3 and 1342e-2"
STEPS["in_node"] = _INSIDE
STEPS["in_origin"] = f"""
select {merc_x('(min(lon) + max(lon)) / 2e0')} as ox, {merc_y('(min(lat) + max(lat)) / 2e0')} as oy from in_node"""
STEPS["in_rp"] = f"""
select way_id, row_number() over (partition by way_id order by seq) - 1 as i, count(*) over (partition by way_id) as n,
  {merc_x('lon')} - ox as x, {merc_y('lat')} - oy as y from geo_wayref join in_node using (node_id), in_origin"""
STEPS["in_next"] = _NEXT.format(src="in_rp", key="way_id")
STEPS["in_area"] = "select way_id, sum(x * y1 - x1 * y) / 2e0 as area, max(n) as n from in_next group by way_id"
twin("flt6_bounds_and_area", """
select way_id as osm_id, area_type as type, n as points from classed join in_area using (way_id) join closed using (way_id)
where building is null and area_type <> 'Unknown' and n >= 4 and abs(area) >= 2e4""")
twin("flt7_layers", "select kind, count(*) as n, cast(sum(osm_id) as bigint) as id_sum from feature where kind <> 'building' group by kind")
STEPS["near_tile"] = ("""select tx, ty from box where pow((min_x + max_x) * 5e-1 - 1e2, 2) + pow((min_y + max_y) * 5e-1 - 5e1, 2)
  + pow((min_z + max_z) * 5e-1 + 2e2, 2) <= 81e4""")
twin("flt9_near", "select tx, ty from near_tile")
_REGION = """max_x + 4e2 >= 0 and -min_x - 5e-1 * min_z + 9e2 >= 0 and -min_y + 15e1 >= 0 and 25e-2 * max_x + max_z + 12e2 >= 0"""
twin("flt10_region", f"select tx, ty from box where {_REGION}")
twin("flt12_valid_box", "select tx, ty from box where min_x < max_x or min_z < max_z")

# --- joins --------------------------------------------------------------------------------------

twin("jon1_resolve", f"select way_id, i, {rs(3, 'x', 'y')} from rp")
twin("jon2_named_colours", """
select way_id, case when building_colour = 'Red' then 8e-1 end as r, case when building_colour = 'Red' then 2e-1 end as g,
  case when building_colour = 'Red' then 2e-1 end as b, case when building_colour = 'Red' then 1e0 end as a
from geo_way where building_colour is not null""")
twin("jon3_tile_lookup", f"select kind, osm_id, tx, ty from bridge join (select tx, ty from box where {_REGION}) using (tx, ty)")
twin("jon4_tile_range", """
select tx, ty from tile, grid where tx between least(greatest(floor((-3e2 - gx) / 5e2), 0), gw - 1) and least(greatest(floor((7e2 - gx) / 5e2), 0), gw - 1)
  and ty between least(greatest(floor((-5e3 - gy) / 5e2), 0), gh - 1) and least(greatest(floor((4e2 - gy) / 5e2), 0), gh - 1)""")
STEPS["zoomed"] = """
select kind, zoom, tx >> zoom as tx, ty >> zoom as ty, cast(sum(n) as bigint) as copies, count(*) as tiles
from (select kind, tx, ty, count(*) as n from bridge group by all), (select unnest([0, 1, 2, 3]) as zoom) group by kind, zoom, tx >> zoom, ty >> zoom"""
twin("jon4_zoom_ranges", "select * from zoomed where zoom < 3 and tx <= 5 >> zoom and ty between 1 >> zoom and 9 >> zoom")
_BITS = " + ".join(f"(((tx >> {b}) & 1) << {2 * b}) + (((ty >> {b}) & 1) << {2 * b + 1})" for b in range(20))
twin("srt2_zoom_order", f"""
select zoom, tx, ty, {_BITS} as key, copies from (
  select zoom, tx::bigint as tx, ty::bigint as ty, cast(sum(copies) as bigint) as copies from zoomed group by all)""")
twin("jon5_missing_tiles", """
select tx, ty from tile where tx <> 0
  and (tx, ty) not in (select (tx, ty) from near_tile)""")
STEPS["road_end"] = """
select osm_id * 2 + e as idx, x, y, width from (select osm_id, i, n, x, y, 0 as e from road_pt where i = 0
  union all select osm_id, i, n, x, y, 1 from road_pt where i = n - 1) join road using (osm_id)"""
STEPS["spot"] = "select x, y, min(idx) as idx, count(*) as ends, max(width) as width from road_end group by x, y"
STEPS["spot_cell"] = "select *, floor(x / 14e-1) as cx, floor(y / 14e-1) as cy from spot"
STEPS["leader"] = "select arg_min(x, idx) as lx, arg_min(y, idx) as ly, min(idx) as leader, cx, cy from spot_cell group by cx, cy"
twin("jon6_near_pairs", """
select idx, leader from spot_cell s join leader l on s.cx between l.cx - 2 and l.cx + 2 and s.cy between l.cy - 2 and l.cy + 2
where (x - lx) * (x - lx) + (y - ly) * (y - ly) < 4e0""")

# Mask pieces, cell by cell against all sides, as one would do by hand.
_MC = "78125e-4"
STEPS["mask_def"] = f"select cast(ceil((wx1 - wx0) / {_MC}) as bigint) + 1 as mw, cast(ceil((wz1 - wz0) / {_MC}) as bigint) + 1 as mh, wx0, wz0 from world"


def ring_cells(points: str, prefix: str, where: str = "true") -> None:
    """Steps that weigh every cell of each ring's widened box."""
    STEPS[f"{prefix}_next"] = _NEXT.format(src=f"(select * from {points} where {where})", key="osm_id")
    STEPS[f"{prefix}_box"] = f"""
select osm_id, unnest(range(greatest(cast(floor((min(x) - 5e1 - any_value(wx0)) / {_MC}) as bigint), 0),
    least(cast(ceil((max(x) + 5e1 - any_value(wx0)) / {_MC}) as bigint), any_value(mw) - 1) + 1)) as ix,
  greatest(cast(floor((min(y) - 5e1 - any_value(wz0)) / {_MC}) as bigint), 0) as z0,
  least(cast(ceil((max(y) + 5e1 - any_value(wz0)) / {_MC}) as bigint), any_value(mh) - 1) as z1
from {prefix}_next, mask_def group by osm_id"""
    STEPS[f"{prefix}_cell"] = f"""
select osm_id, ix, iz, wx0 + ix * {_MC} as cx, wz0 + iz * {_MC} as cy
from (select osm_id, ix, unnest(range(z0, z1 + 1)) as iz from {prefix}_box), mask_def"""
    STEPS[f"{prefix}_weight"] = f"""
select osm_id, ix, iz, case when inside then 1e0 when d <= 5e1 then 1e0 - (d / 5e1) * (d / 5e1) * (3e0 - 2e0 * (d / 5e1)) else 0e0 end as weight
from (
  select osm_id, ix, iz,
    sum(case when ((y1 > cy) <> (y > cy)) and cx < (x - x1) * (cy - y1) / nullif(y - y1, 0) + x1 then 1 else 0 end) % 2 = 1 as inside,
    coalesce(min(case when l2 >= 1e-4 then sqrt(pow(cx - (x + (x1 - x) * t), 2) + pow(cy - (y + (y1 - y) * t), 2)) end), 1e30) as d
  from (
    select *, least(greatest(((cx - x) * (x1 - x) + (cy - y) * (y1 - y)) / nullif(l2, 0), 0e0), 1e0) as t
    from (select *, (x1 - x) * (x1 - x) + (y1 - y) * (y1 - y) as l2 from {prefix}_next) e join {prefix}_cell using (osm_id))
  group by osm_id, ix, iz)"""


ring_cells("building_pt", "bring")
ring_cells("area_pt", "aring", "osm_id in (select osm_id from area_row where type <> 'Water')")
_PER = f"count(*) as cells, count(*) filter (weight = 1e0) as \"full\", {r('sum(weight)')} as weight"
twin("jon7_polygon_cells", f"select osm_id, {_PER} from bring_weight where weight > 0 group by osm_id")
STEPS["road_seg"] = """
select osm_id, i, x as ax, y as ay, lead(x) over w as qx, lead(y) over w as qy, width * 5e-1 + 1e1 as radius
from road_pt join road using (osm_id) window w as (partition by osm_id order by i)"""
STEPS["road_sample"] = f"""
select osm_id, radius, ax + (qx - ax) * (k / n) as px, ay + (qy - ay) * (k / n) as py
from (select *, unnest(range(0, n + 1)) as k from (
  select *, greatest(2, cast(floor(sqrt(pow(qx - ax, 2) + pow(qy - ay, 2)) / ({_MC} * 5e-1)) as bigint)) as n from road_seg where qx is not null))"""
STEPS["line_weight"] = f"""
select osm_id, ix, iz, max(case when d <= radius then 1e0 else 1e0 - t * t * (3e0 - 2e0 * t) end) as weight
from (select *, (d - radius) / 5e1 as t from (
  select osm_id, radius, ix, iz, sqrt(pow(wx0 + ix * {_MC} - px, 2) + pow(wz0 + iz * {_MC} - py, 2)) as d
  from (select *, unnest(range(greatest(cast(floor((py - radius - 5e1 - wz0) / {_MC}) as bigint), 0),
      least(cast(ceil((py + radius + 5e1 - wz0) / {_MC}) as bigint), mh - 1) + 1)) as iz
    from (select *, unnest(range(greatest(cast(floor((px - radius - 5e1 - wx0) / {_MC}) as bigint), 0),
      least(cast(ceil((px + radius + 5e1 - wx0) / {_MC}) as bigint), mw - 1) + 1)) as ix from road_sample, mask_def)))
  where d <= radius + 5e1)
group by osm_id, ix, iz"""
twin("jon8_line_cells", f"select osm_id, {_PER} from line_weight where weight > 0 group by osm_id")

# --- faces ---------------------------------------------------------------------------

# Sides of a ring: every point with the next, the closing pair left out when it repeats the first point.
STEPS["b_next"] = _NEXT.format(src="building_pt", key="osm_id")
STEPS["b_first"] = "select osm_id, arg_min(x, i) as fx, arg_min(y, i) as fy, avg(x) as mx, avg(y) as my from building_pt group by osm_id"
STEPS["side"] = """
select b.*, row.type, row.height, row.roof_type, row.roof_color, row.building_color, fx, fy, mx, my
from b_next b join b_first using (osm_id) join building_row row using (osm_id) where not (i = b.n - 1 and x = fx and y = fy)"""
STEPS["axis"] = """
select osm_id, coalesce(dx / nullif(len, 0), 1e0) as ax, coalesce(dy / nullif(len, 0), 0e0) as ay from (
  select *, row_number() over (partition by osm_id order by len desc, i) as k from (
    select osm_id, i, x1 - x as dx, y1 - y as dy, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) as len from b_next)) where k = 1"""
STEPS["extent"] = """
select osm_id, any_value(ax) as ax, any_value(ay) as ay, any_value(mx) as cx, any_value(my) as cy,
  max(u) - min(u) as length, max(v) - min(v) as width from (
  select osm_id, ax, ay, mx, my, (x - mx) * ax + (y - my) * ay as u, (y - my) * ax - (x - mx) * ay as v
  from building_pt join axis using (osm_id) join b_first using (osm_id)) group by osm_id"""
STEPS["clear_of"] = """
select osm_id, min(case when l2 > 1e-6 then sqrt(pow(mx - (x + (x1 - x) * t), 2) + pow(my - (y + (y1 - y) * t), 2)) end) as clearance from (
  select *, least(greatest(((mx - x) * (x1 - x) + (my - y) * (y1 - y)) / nullif(l2, 0), 0e0), 1e0) as t from (
    select *, (x1 - x) * (x1 - x) + (y1 - y) * (y1 - y) as l2 from side)) group by osm_id"""
_XYZ = [f"{a}{i}" for i in range(4) for a in "xyz"]
STEPS["wall"] = f"""
select osm_id, 'wall' as part, i as face, x as x0, 0e0 as y0, -y as z0, x1 as x1, 0e0 as y1, -y1 as z1,
  x1 as x2, height as y2, -y1 as z2, x as x3, height as y3, -y as z3,
  -(y1 - y) / nullif(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)), 0) as nx,
  case when x1 <> x or y1 <> y then 0e0 end as ny,
  -(x1 - x) / nullif(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)), 0) as nz,
  {tag_colour('building_color', f'({_WALL})')} as c from side"""
_ROOFC = tag_colour("roof_color", f"({_ROOF})")


def upward(third: str) -> str:
    """nx, ny, nz from corners 0, 1 and the point ``third``."""
    return f"""kx * s as nx, ky * s as ny, kz * s as nz from (select *, (case when ky < 0 then -1e0 else 1e0 end) / nullif(sqrt(kx*kx + ky*ky + kz*kz), 0) as s from (
  select *, (y1 - y0) * (z{third} - z0) - (y{third} - y0) * (z1 - z0) as kx, (z1 - z0) * (x{third} - x0) - (z{third} - z0) * (x1 - x0) as ky,
    (x1 - x0) * (y{third} - y0) - (x{third} - x0) * (y1 - y0) as kz"""


STEPS["gable"] = f"""
select osm_id, 'roof' as part, face, {', '.join(_XYZ)}, c, {upward('t')} from (
  select *, case when q > 0 then x3 else x2 end as xt, case when q > 0 then y3 else y2 end as yt, case when q > 0 then z3 else z2 end as zt from (
    select osm_id, i as face, {_ROOFC} as c, x as x0, height as y0, -y as z0, x1 as x1, height as y1, -y1 as z1,
      cx + ax * (length * 5e-1) as x2, height + width * 5e-1 * 3e-1 as y2, -(cy + ay * (length * 5e-1)) as z2,
      cx - ax * (length * 5e-1) as x3, height + width * 5e-1 * 3e-1 as y3, -(cy - ay * (length * 5e-1)) as z3,
      ((y + s.y1) * 5e-1 - cy) * ax - ((x + s.x1) * 5e-1 - cx) * ay as q
    from side s join extent using (osm_id) where roof_type = 'Gabled'))))"""
STEPS["pointed"] = f"""
select osm_id, 'roof' as part, face, {', '.join(_XYZ)}, c, {upward('2')} from (
  select osm_id, i as face, {_ROOFC} as c, x as x0, height as y0, -y as z0, x1 as x1, height as y1, -y1 as z1,
    mx as x2, height + clearance * 3e-1 as y2, -my as z2, null::double as x3, null::double as y3, null::double as z3
  from side join clear_of using (osm_id) where roof_type in ('Hipped', 'Pyramidal'))))"""
STEPS["line_step"] = """
select osm_id, i, n, x, y, lag(x) over w as xp, lag(y) over w as yp, lead(x) over w as xn, lead(y) over w as yn
from road_pt window w as (partition by osm_id order by i)"""
STEPS["line_unit"] = """
select *, coalesce((x - xp) / nullif(lp, 0), 0e0) as ux, coalesce((y - yp) / nullif(lp, 0), 0e0) as uy,
  coalesce((xn - x) / nullif(ln, 0), 0e0) as vx, coalesce((yn - y) / nullif(ln, 0), 0e0) as vy from (
  select *, sqrt((x - xp) * (x - xp) + (y - yp) * (y - yp)) as lp, sqrt((xn - x) * (xn - x) + (yn - y) * (yn - y)) as ln from line_step)"""
STEPS["tangent"] = """
select osm_id, i, x, y, case when l < 1e-4 then 1e0 else sx / l end as tx, case when l < 1e-4 then 0e0 else sy / l end as ty from (
  select *, sqrt(sx * sx + sy * sy) as l from (
    select *, case when xp is null then xn - x when xn is null then x - xp else ux + vx end as sx,
      case when xp is null then yn - y when xn is null then y - yp else uy + vy end as sy from line_unit))"""
STEPS["edge_pair"] = """
select osm_id, i, x + ty * h as lx, y - tx * h as ly, x - ty * h as rx, y + tx * h as ry, type
from (select tangent.*, width * 5e-1 as h, type from tangent join road using (osm_id))"""
STEPS["ribbon"] = f"""
select osm_id, 'ribbon' as part, a.i as face, a.lx as x0, 1e-1 as y0, -a.ly as z0, a.rx as x1, 1e-1 as y1, -a.ry as z1,
  b.rx as x2, 1e-1 as y2, -b.ry as z2, b.lx as x3, 1e-1 as y3, -b.ly as z3, 0e0 as nx, 1e0 as ny, 0e0 as nz, {_ROADC.replace('type', 'a.type')} as c
from edge_pair a join edge_pair b using (osm_id) where b.i = a.i + 1"""
_FACE = f"{rs(2, *_XYZ)}, {rs(3, 'nx', 'ny', 'nz')}, {rgba_columns('c')}"
twin("geo1_walls", f"select osm_id, part, face, {_FACE} from wall")
twin("geo2_gabled_roofs", f"select osm_id, part, face, {_FACE} from gable")
twin("geo3_pointed_roofs", f"select osm_id, part, face, {_FACE} from pointed")
twin("geo4_ribbons", f"select osm_id, part, face, {_FACE} from ribbon")
STEPS["b_face"] = "select * from wall union all by name select * from gable union all by name select * from pointed"


def box_of(src: str) -> str:
    low = lambda a: f"min(least({', '.join(f'{a}{i}' for i in range(4))}))"
    high = lambda a: f"max(greatest({', '.join(f'{a}{i}' for i in range(4))}))"
    return f"select osm_id, {', '.join(f'{low(a)} as min_{a}, {high(a)} as max_{a}' for a in 'xyz')} from {src} group by osm_id"


STEPS["b_box"] = box_of("b_face")
STEPS["r_box"] = box_of("ribbon")
_HALF = {a: f"((max_{a} - min_{a}) * 5e-1)" for a in "xyz"}
twin("agg16_feature_boxes", "select osm_id, " + rs(2, *[f"{m}_{a}" for a in "xyz" for m in ("min", "max")]) + ", "
     + ", ".join(f"{r(f'(min_{a} + max_{a}) * 5e-1', 2)} as center_{a}, {r(_HALF[a], 2)} as half_{a}" for a in "xyz")
     + f", {r('sqrt(' + ' + '.join(f'{_HALF[a]} * {_HALF[a]}' for a in 'xyz') + ')', 2)} as radius from b_box")
twin("flt8_near_flat", """select osm_id from r_box where ((min_x + max_x) * 5e-1 - 1e2) * ((min_x + max_x) * 5e-1 - 1e2)
  + ((min_z + max_z) * 5e-1 + 2e2) * ((min_z + max_z) * 5e-1 + 2e2) <= 81e4""")
_TRI = {0: (0, 1, 2), 1: (0, 2, 3)}
twin("jon10_batched_triangles", " union all ".join(
    f"select osm_id, part, face, {half} as half, "
    + ", ".join(f"{r(f'{a}{at}', 2)} as {a}{i}" for i, at in enumerate(picks) for a in "xyz")
    + " from b_face" + (" where x3 is not null" if half else "") for half, picks in _TRI.items()))
twin("jon11_bad_indices", """
select osm_id, max(face) as face, max(face) * 4 + 4 as vertex from ribbon group by osm_id""")
# Junctions: rounds of the greedy rule written out; a twin with places left after them fails.
ROUNDS = 6


def mixed(number: str) -> str:
    """The order in which places are met."""
    up = f"({number} + {1 << 61})"
    high, low = f"({up} >> 31)", f"({up} % {1 << 31})"
    for constant in (1500450271, 1190494759, 987654319, 2038074743):
        at = f"(({low} + {constant}) % {(1 << 31) - 1})"
        high, low = low, f"(({high} + ({at} * {at}) % {(1 << 31) - 1}) % {1 << 31})"
    return f"({high} * {1 << 31} + {low})"


def greedy(prefix: str, spots: str, keys: list[str]) -> None:
    k = "".join(f"{c}, " for c in keys)
    on = "".join(f"a.{c} = b.{c} and " for c in keys)
    STEPS[f"{prefix}_turn"] = f"select *, {mixed('idx')} as turn from {spots}"
    STEPS[f"{prefix}_near"] = f"""
select {''.join(f'a.{c}, ' for c in keys)}a.idx as idx, b.idx as other, a.turn as turn, b.turn as other_turn from (select *, floor(x / 2e0) as cx, floor(y / 2e0) as cy from {prefix}_turn) a
join (select *, unnest([-1, 0, 1]) as ox from (select *, unnest([-1, 0, 1]) as oy from {prefix}_turn)) b
  on {on}a.cx = floor(b.x / 2e0) + ox and a.cy = floor(b.y / 2e0) + oy
where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 4e0"""
    STEPS[f"{prefix}_free0"] = f"select {k}idx from {spots}"
    for n in range(ROUNDS):
        free = f"{prefix}_free{n}"
        STEPS[f"{prefix}_seed{n}"] = f"""
select {k}idx from {free} where ({k}idx) not in (
  select ({k}idx) from {prefix}_near join (select {k}idx as other from {free}) using ({k}other) where other_turn < turn)"""
        STEPS[f"{prefix}_free{n + 1}"] = f"""
select {k}idx from {free} where ({k}idx) not in (
  select ({k}idx) from {prefix}_near join (select {k}idx as other from {prefix}_seed{n}) using ({k}other))"""
    seeds = " union all ".join(f"select * from {prefix}_seed{n}" for n in range(ROUNDS))
    STEPS[f"{prefix}_group"] = f"""
select {k}idx, arg_min(other, other_turn) as seed from {prefix}_near join (select {k}idx as other from ({seeds})) using ({k}other)
where other_turn <= turn and (select case when count(*) > 0 then error('places left after all rounds: ' || count(*)) else '' end from {prefix}_free{ROUNDS}) = ''
group by all"""


greedy("j", "spot", [])
twin("ord6_junction_groups", "select idx, seed from j_group")
STEPS["tile_spot"] = """
select tx, ty, x, y, min(idx) as idx, count(*) as ends, max(width) as width
from road_end join (select tx, ty, osm_id from bridge where kind = 'road') on idx // 2 = osm_id group by tx, ty, x, y"""
greedy("t", "tile_spot", ["tx", "ty"])
STEPS["junction"] = """
select tx, ty, seed, cast(sum(ends) as bigint) as ends, sum(x * ends) / sum(ends) as x, sum(y * ends) / sum(ends) as y, max(width) * 6e-1 as radius
from tile_spot join t_group using (tx, ty, idx) group by tx, ty, seed having sum(ends) >= 2"""
twin("geo5_junctions", f"select tx, ty, seed, ends, {rs(3, 'x', 'y', 'radius')} from junction")
STEPS["disc"] = """
select tx, ty, seed // 2 as osm_id, seed, 'junction' as part, s as face, x as x0, 6e-2 as y0, -y as z0,
  x + radius * cos(s * (2e0 * pi() / 12e0)) as x1, 6e-2 as y1, -y + radius * sin(s * (2e0 * pi() / 12e0)) as z1,
  x + radius * cos(((s + 1) % 12) * (2e0 * pi() / 12e0)) as x2, 6e-2 as y2, -y + radius * sin(((s + 1) % 12) * (2e0 * pi() / 12e0)) as z2,
  null::double as x3, null::double as y3, null::double as z3, 0e0 as nx, 1e0 as ny, 0e0 as nz, [3e-1, 3e-1, 32e-2, 1e0] as c
from (select *, unnest(range(0, 12)) as s from junction)"""
twin("geo5_junction_faces", f"select tx, ty, osm_id, seed, part, face, {_FACE} from disc")
_XYZS = ", ".join(f"{a}{i}" for a in "xyz" for i in range(4))
STEPS["tile_face"] = f"""
select tx, ty, 'road' as kind, 'road ' || osm_id as mesh, part, osm_id, {_XYZS} from ribbon join bridge using (osm_id) where kind = 'road'
union all select tx, ty, 'road', 'junction ' || seed, part, osm_id, {_XYZS} from disc
union all select tx, ty, 'building', 'building ' || osm_id, part, osm_id, {_XYZS} from b_face join bridge using (osm_id) where kind = 'building'"""
twin("geo6_tile_faces", "select tx, ty, kind, mesh, part, count(*) as faces from tile_face group by all")
twin("agg18_face_counts", """
select tx, ty, kind, count(distinct mesh) as meshes, cast(sum(case when x3 is null then 1 else 2 end) as bigint) as triangles
from tile_face group by tx, ty, kind""")
twin("geo9_visible_faces", f"""
with seen as (select * from tile_face join (select tx, ty from box where {_REGION}) using (tx, ty)),
near as (select tx, ty, mesh from seen group by all
  having pow((min(least(x0, x1, x2, x3)) + max(greatest(x0, x1, x2, x3))) * 5e-1 - 1e2, 2)
    + pow((min(least(z0, z1, z2, z3)) + max(greatest(z0, z1, z2, z3))) * 5e-1 + 2e2, 2) <= 81e4)
select tx, ty, kind, mesh, part, count(*) as faces from seen join near using (tx, ty, mesh) group by tx, ty, kind, mesh, part""".replace("with seen as", "select * from (with seen as", 1) + ")")

STEPS["area_ring"] = f"""
select tx, ty, osm_id, i, x, case type when 'Water' then 1e-2 when 'Parking' then 3e-2 else 2e-2 end as y, -y as z, {_AREAC} as c
from area_pt join (select osm_id, type from area_row) using (osm_id) join (select tx, ty, osm_id from bridge where kind = 'area') using (osm_id)"""
twin("geo6_tile_areas", f"select tx, ty, osm_id, i, {rs(3, 'x', 'y', 'z')}, {rgba_columns('c')} from area_ring")
_LOW = ", ".join(f"min(least({', '.join(f'{a}{i}' for i in range(4))})) as min_{a}, max(greatest({', '.join(f'{a}{i}' for i in range(4))})) as max_{a}" for a in "xyz")
STEPS["mesh_box"] = f"""
select tx, ty, kind, mesh, {_LOW}, cast(sum(case when x3 is null then 1 else 2 end) as bigint) as triangles from tile_face group by tx, ty, kind, mesh
union all select tx, ty, 'area', 'area ' || osm_id, min(x), max(x), min(y), max(y), min(z), max(z), 0 from area_ring group by tx, ty, osm_id"""
twin("geo9_visible_meshes", f"""
select tx, ty, kind, mesh, {rs(2, *[f'{s}_{a}' for a in 'xyz' for s in ('min', 'max')])}, triangles
from mesh_box join (select tx, ty from box where {_REGION}) using (tx, ty)
where pow((min_x + max_x) * 5e-1 - 1e2, 2) + pow((min_z + max_z) * 5e-1 + 2e2, 2) <= 81e4""")
twin("jon5_tile_ledger", """
select tx, ty, f.features, coalesce(m.meshes, 0) as meshes, coalesce(m.triangles, 0) as triangles,
  case when (tx, ty) in (select (tx, ty) from near_tile) then 1 else 2 end as run
from (select tx, ty, count(*) as features from bridge group by tx, ty) f
left join (select tx, ty, count(*) as meshes, cast(sum(triangles) as bigint) as triangles from mesh_box group by tx, ty) m using (tx, ty)""")

# --- aggregations ----------------------------------------------------------------------

twin("agg1_bounds", f"select {rs(7, 'min_lat', 'max_lat', 'min_lon', 'max_lon')} from bounds")
twin("agg2_statistics", """
select (select count(*) from geo_node) as total_nodes, (select count(*) from geo_way) as total_ways,
  (select count(distinct way_id // 10) from geo_way) as total_relations, (select count(*) from road) as processed_roads,
  (select count(*) from building_row) as processed_buildings, (select count(*) from area_row) as processed_areas""")
twin("agg3_roads_by_class", "select type, count(*) as n from road group by type")
twin("agg4_buildings_by_class", "select type, count(*) as n from building_row group by type")
twin("agg5_areas_by_class", "select type, count(*) as n from area_row group by type")
twin("agg6_tile_totals", "select kind, count(*) as copies from bridge group by kind")
twin("agg7_visible_tiles", f"""
select count(*) filter ((min_x < max_x or min_z < max_z) and {_REGION}) as visible_tiles, count(*) as tiles from box""")
twin("agg8_signed_area", f"select way_id, {r('area', 0)} as area from rp_area")
STEPS["center"] = """
select way_id, case when max(n) < 3 or abs(sum(k)) / 2e0 < 1e-10 then avg(x) else sum((x + x1) * k) / (6e0 * (sum(k) / 2e0)) end as x,
  case when max(n) < 3 or abs(sum(k)) / 2e0 < 1e-10 then avg(y) else sum((y + y1) * k) / (6e0 * (sum(k) / 2e0)) end as y
from (select *, x * y1 - x1 * y as k from rp_next) group by way_id"""
twin("agg9_centroid", f"select way_id, {rs(1, 'x', 'y')} from center")
twin("agg10_line_length", f"""
select way_id, {r('sum(case when i < n - 1 then sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) else 0 end)')} as length
from rp_next group by way_id""")
twin("agg11_vertex_mean", f"select way_id, {r('avg(x)')} as x, {r('avg(y)')} as y from rp group by way_id")
twin("agg12_principal_axis", f"select osm_id, {rs(3, 'ax', 'ay', 'length', 'width')} from extent")
twin("agg13_clearance", f"select osm_id, {rs(3, 'clearance')} from clear_of")
STEPS["three"] = """
select way_id, arg_min(x, i) as ax, arg_min(y, i) as ay, max(x) filter (i = 1) as px, max(y) filter (i = 1) as py,
  arg_max(x, i) as ex, arg_max(y, i) as ey from rp where n >= 2 group by way_id"""
twin("agg14_point_to_segment", f"""
select way_id, {r('sqrt(pow(px - (ax + t * (ex - ax)), 2) + pow(py - (ay + t * (ey - ay)), 2))')} as distance from (
  select *, case when l2 < 1e-10 then 0e0 else least(greatest(((px - ax) * (ex - ax) + (py - ay) * (ey - ay)) / l2, 0e0), 1e0) end as t
  from (select *, (ex - ax) * (ex - ax) + (ey - ay) * (ey - ay) as l2 from three))""")
twin("agg17_mask_blend", f"select ix, iz, {r('max(weight)', 4)} as weight from aring_weight where weight > 0 group by ix, iz")
STEPS["gen_chunk"] = "select distinct cast(floor((x - wx0) / 5e2) as bigint) as cx, cast(floor((y - wz0) / 5e2) as bigint) as cz from road_pt, world"
STEPS["mesh_chunk"] = "select distinct cast(floor((x - wx0) / 5e2) as bigint) as cx, cast(floor((y - wz0) / 5e2) as bigint) as cz from building_pt, world"
twin("agg19_chunk_counts", """
select count(*) as chunks, count(*) filter ((cx, cz) in (select (cx, cz) from gen_chunk)) as generated,
  count(*) filter ((cx, cz) in (select (cx, cz) from mesh_chunk)) as with_mesh from chunk""")
twin("agg20_fit_world", f"select {r('wx0')} as world_min_x, {r('wz0')} as world_min_z, {r('wx1')} as world_max_x, {r('wz1')} as world_max_z from world")

# --- ordered, sorted, sets ------------------------------------------------------------------

twin("ord1_ring_sides", f"select osm_id, i, {r('x')} as px, {r('y')} as py, {r('x1')} as qx, {r('y1')} as qy from side")
twin("ord2_tangents", f"select osm_id, i, {rs(3, 'tx', 'ty')} from tangent where xp is not null or xn is not null".replace("from tangent where", "from (select tangent.*, xp, xn from tangent join line_step using (osm_id, i)) where"))
twin("ord3_winding", f"""
select way_id, area < 0 as clockwise, {r('max(x) filter (i = case when area < 0 then rp.n - 2 else 1 end)')} as ccw_x,
  {r('max(y) filter (i = case when area < 0 then rp.n - 2 else 1 end)')} as ccw_y,
  {r('max(x) filter (i = case when area < 0 then 1 else rp.n - 2 end)')} as cw_x,
  {r('max(y) filter (i = case when area < 0 then 1 else rp.n - 2 end)')} as cw_y
from rp join rp_area using (way_id) where rp.n >= 4 group by way_id, area""")
SPLITS = 6  # levels written out; a twin with spans left to cut after them fails
STEPS["span0"] = "select osm_id, 0 as lo, max(i) as hi from road_pt group by osm_id"
for _n in range(SPLITS + 1):
    STEPS[f"cut{_n}"] = f"""
select osm_id, lo, hi, arg_max(i, (d, -i)) as mid from (
  select s.osm_id, lo, hi, p.i, case when l2 < 1e-10 then sqrt(pow(p.x - a.x, 2) + pow(p.y - a.y, 2)) else
      sqrt(pow(p.x - (a.x + t * (b.x - a.x)), 2) + pow(p.y - (a.y + t * (b.y - a.y)), 2)) end as d
  from span{_n} s join road_pt a on a.osm_id = s.osm_id and a.i = lo join road_pt b on b.osm_id = s.osm_id and b.i = hi
  join road_pt p on p.osm_id = s.osm_id and p.i > lo and p.i < hi,
  lateral (select (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) as l2),
  lateral (select least(greatest(((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / nullif(l2, 0), 0e0), 1e0) as t))
where d > 6e1 group by osm_id, lo, hi"""
    STEPS[f"span{_n + 1}"] = f"select osm_id, lo, mid as hi from cut{_n} union all select osm_id, mid, hi from cut{_n}"
STEPS["kept"] = "select osm_id, lo as i from span0 union select osm_id, hi from span0" + "".join(
    f" union select osm_id, mid from cut{n}" for n in range(SPLITS)) + f"""
  union select error('spans left after all levels: ' || osm_id)::bigint, mid from cut{SPLITS}"""
twin("ord4_simplify", f"select osm_id, row_number() over (partition by osm_id order by i) - 1 as i, {rs(3, 'x', 'y')} from kept join road_pt using (osm_id, i)")
ORACLE["srt2_key_order"] = ""
twin("srt1_samples", """
select * from (select osm_id, type, points, 'road' as kind from road order by osm_id limit 5)
union all select * from (select osm_id, type, points, 'building' from building_row order by osm_id limit 5)
union all select * from (select osm_id, type, points, 'area' from area_row order by osm_id limit 5)""")
twin("srt2_key_order", "select 0 as zoom, tx, ty from tile")
twin("srt3_first_tile", f"""
select tx, ty, {r('(min_x + max_x) * 5e-1')} as x, {r('(min_y + max_y) * 5e-1')} as y, {r('(min_z + max_z) * 5e-1')} as z
from box where min_x < max_x or min_z < max_z order by tx, ty limit 1""")
twin("set1_feature_tiles", "select kind, osm_id, tx, ty from bridge")
twin("set2_features_of_all_tiles", "select kind, type, count(*) as copies from bridge join feature using (kind, osm_id) group by all")
twin("set3_areas_without_buildings", "select osm_id from area_row")

# --- tiling ---------------------------------------------------------------------------------

twin("til1_grid", f"select gw as grid_width, gh as grid_height, {r('gx')} as grid_x, {r('gy')} as grid_y, {r('5e2')} as tile_size from grid")
twin("til2_point_tiles", f"select node_id, {_TILE} from pt, grid")
twin("til3_tiles_by_class", "select tx, ty, type, count(*) as roads from bridge join road using (osm_id) where kind = 'road' group by tx, ty, type")
twin("til4_tile_boxes", f"select tx, ty, {rs(3, 'min_x', 'min_y', 'min_z', 'max_x', 'max_y', 'max_z')} from box")
twin("til5_point_chunks", "select node_id, cast(floor((x * 2e0 - wx0) / 5e2) as bigint) as cx, cast(floor((y * 2e0 - wz0) / 5e2) as bigint) as cz from pt, world")
twin("til6_chunk_bounds", f"select cx, cz, {r('wx0 + cx * 5e2')} as min_x, {r('wz0 + cz * 5e2')} as min_z, {r('wx0 + cx * 5e2 + 5e2')} as max_x, {r('wz0 + cz * 5e2 + 5e2')} as max_z from chunk, world")
twin("til7_chunks_of_boxes", """
select osm_id, cx, unnest(range(z0, z1 + 1)) as cz from (
  select osm_id, unnest(range(cast(floor((min(x) - any_value(wx0)) / 5e2) as bigint), cast(ceil((max(x) - any_value(wx0)) / 5e2) as bigint) + 1)) as cx,
    cast(floor((min(y) - any_value(wz0)) / 5e2) as bigint) as z0, cast(ceil((max(y) - any_value(wz0)) / 5e2) as bigint) as z1
  from area_pt, world group by osm_id)""")
twin("til8_world_chunks", "select cx, cz, points from chunk")
STEPS["eye"] = "select avg(x) as ex, avg(y) as ez from building_pt group by osm_id"
twin("til9_chunks_around", """
select distinct cx, cz from (select *, unnest(range(z0, z1 + 1)) as cz from (
  select *, unnest(range(cast(floor((ex - 8e2 - wx0) / 5e2) as bigint), cast(ceil((ex + 8e2 - wx0) / 5e2) as bigint) + 1)) as cx,
    cast(floor((ez - 8e2 - wz0) / 5e2) as bigint) as z0, cast(ceil((ez + 8e2 - wz0) / 5e2) as bigint) as z1 from eye, world))
where wx0 + cx * 5e2 + 5e2 >= wx0 and wx0 + cx * 5e2 <= wx1 and wz0 + cz * 5e2 + 5e2 >= wz0 and wz0 + cz * 5e2 <= wz1
  and (cx, cz) not in (select (cx, cz) from gen_chunk join chunk using (cx, cz))""")

# --- rasters ----------------------------------------------------------------------------------

_CELL = "cx, cz, ix, iz"


def permutation(seed: int) -> list[int]:
    """0..255 shuffled from the last place down by a 32-bit xorshift generator; seed 0 acts as 1."""
    line, x = [*range(256)], seed % 2**32 or 1
    for n in range(256, 1, -1):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        line[n - 1], line[x % n] = line[x % n], line[n - 1]
    return line


def noise_steps(prefix: str, src: str, keys: str, x: str, y: str, seed: int, octaves: list[tuple[float, float]]) -> None:
    """Steps <prefix>_oct (keys, k, amp, n): one row per point and octave; octaves are (frequency, amplitude)."""
    perm = permutation(seed)
    STEPS[f"{prefix}_perm"] = f"select {perm} as p"
    listed = ", ".join(f"({i}, {f!r}::double, {a!r}::double)" for i, (f, a) in enumerate(octaves))
    f2, g2 = "((sqrt(3e0) - 1e0) * 5e-1)", "((3e0 - sqrt(3e0)) / 6e0)"
    STEPS[f"{prefix}_in"] = f"select {keys}, k, amp, ({x}) * f as px, ({y}) * f as py from {src}, (values {listed}) o(k, f, amp)"
    STEPS[f"{prefix}_a"] = f"select *, floor(px + (px + py) * {f2}) as i, floor(py + (px + py) * {f2}) as j from {prefix}_in"
    STEPS[f"{prefix}_b"] = f"""
select *, case when x0 > y0 then 1 else 0 end as i1, case when x0 > y0 then 0 else 1 end as j1, cast(i as bigint) & 255 as ii, cast(j as bigint) & 255 as jj
from (select *, px - (i - (i + j) * {g2}) as x0, py - (j - (i + j) * {g2}) as y0 from {prefix}_a)"""
    STEPS[f"{prefix}_c"] = f"""
select *, p[((ii + p[jj + 1]) & 255) + 1] % 12 as g0, p[((ii + i1 + p[((jj + j1) & 255) + 1]) & 255) + 1] % 12 as g1,
  p[((ii + 1 + p[((jj + 1) & 255) + 1]) & 255) + 1] % 12 as g2, x0 - i1 + {g2} as x1, y0 - j1 + {g2} as y1,
  x0 - 1e0 + 2e0 * {g2} as x2, y0 - 1e0 + 2e0 * {g2} as y2 from {prefix}_b, {prefix}_perm"""
    part = lambda k: (
        f"pow(greatest(5e-1 - x{k} * x{k} - y{k} * y{k}, 0e0), 4) * "
        f"((case when g{k} & 1 = 0 then x{k} else -x{k} end) + (case when g{k} & 2 = 0 then y{k} else -y{k} end))"
    )
    STEPS[f"{prefix}_oct"] = f"select {keys}, k, amp, 7e1 * ({part(0)} + {part(1)} + {part(2)}) as n from {prefix}_c"


def fractal(prefix: str, src: str, keys: str, x: str, y: str, seed: int = 12345, octaves: int = 6, lac: float = 2.0, per: float = 0.5) -> None:
    """Step <prefix> (keys, n)."""
    noise_steps(prefix, src, keys, x, y, seed, [(lac**k, per**k) for k in range(octaves)])
    STEPS[prefix] = f"select {keys}, sum(amp * n) / sum(amp) as n from {prefix}_oct group by {keys}"


def ridged(prefix: str, src: str, keys: str, x: str, y: str, seed: int = 12345, octaves: int = 6) -> None:
    noise_steps(prefix, src, keys, x, y, seed, [(2.0**k, 0.5 * 0.5**k) for k in range(octaves)])
    STEPS[prefix] = f"""
select {keys}, sum(e * amp * before) as n from (
  select *, coalesce(lag(e) over (partition by {keys} order by k), 1e0) as before from (
    select *, (1e0 - abs(n)) * (1e0 - abs(n)) as e from {prefix}_oct)) group by {keys}"""


fractal("nf", "wcell", _CELL, "x * 2e-3", "z * 2e-3")
ridged("nr", "wcell", _CELL, "x * 2e-3", "z * 2e-3")
fractal("nflat", "wcell", _CELL, "x * 2e-3", "z * 2e-3", octaves=2, per=0.3)
fractal("nfine", "wcell", _CELL, "x * 2e-3 * 2e0", "z * 2e-3 * 2e0", octaves=3)
fractal("nbroad", "wcell", _CELL, "x * 2e-3 * 5e-1", "z * 2e-3 * 5e-1", octaves=4)
for _s in (0, 1, 7):
    fractal(f"seed{_s}x", "pt", "node_id", "x * 1e-2", "y * 1e-2", seed=_s, octaves=1)
twin("rst1_grid", f"select {_CELL}, {rs(3, 'x', 'z')} from wcell")
twin("rst2_seeds", f"""
select node_id, {r('a.n', 4)} as s0, {r('b.n', 4)} as s1, {r('c.n', 4)} as s7 from seed0x a join seed1x b using (node_id) join seed7x c using (node_id)""")
twin("rst3_fractal_noise", f"select {_CELL}, {rs(4, 'n')} from nf")
twin("rst4_ridged_noise", f"select {_CELL}, {rs(4, 'n')} from nr")
STEPS["rolling"] = f"select {_CELL}, 5e1 * (u * u * (3e0 - 2e0 * u) * 2e0 - 1e0) as h from (select *, n * 5e-1 + 5e-1 as u from nf)"
STEPS["hilly"] = f"select {_CELL}, nf.n * 8e-1 + nfine.n * 2e-1 as level from nf join nfine using ({_CELL})"
STEPS["mountain"] = f"select {_CELL}, 5e1 * (nr.n * pow((nbroad.n + 1e0) * 5e-1, 15e-1) * 2e0 - 1e0) as h from nr join nbroad using ({_CELL})"
twin("rst5_flat", f"select {_CELL}, {r('5e1 * (n * 1e-1)')} as h from nflat")
twin("rst5_rolling", f"select {_CELL}, {rs(3, 'h')} from rolling")
twin("rst5_hilly", f"select {_CELL}, {r('5e1 * level')} as h from hilly")
twin("rst5_mountainous", f"select {_CELL}, {rs(3, 'h')} from mountain")
STEPS["survey"] = f"""
select {_CELL}, avg(p_size) as v from (
  select cx, cz, cast(floor((x - (wx0 + cx * 5e2)) / (5e2 / 31e0) + 5e-1) as bigint) as ix,
    cast(floor((y - (wz0 + cz * 5e2)) / (5e2 / 31e0) + 5e-1) as bigint) as iz, p_size from (
    select cast(floor((x - wx0) / 5e2) as bigint) as cx, cast(floor((y - wz0) / 5e2) as bigint) as cz, pt.x, pt.y, wx0, wz0, p_size
    from pt join part on p_partkey = node_id, world)) group by {_CELL}"""
STEPS["cell"] = f"select {_CELL}, x, z, h + coalesce(v, 0e0) as h from wcell join rolling using ({_CELL}) left join survey using ({_CELL})"
STEPS["rough"] = f"select {_CELL}, x, z, 2e2 * level + coalesce(v, 0e0) as h from wcell join hilly using ({_CELL}) left join survey using ({_CELL})"
twin("rst6_flatten_center", f"""
select {_CELL}, {r('case when d < 2e2 then 5e0 when d < 3e2 then 5e0 * (1e0 - t * t * (3e0 - 2e0 * t)) + h * (t * t * (3e0 - 2e0 * t)) else h end')} as h
from (select *, (d - 2e2) / 1e2 as t from (select *, sqrt((x - 5e2) * (x - 5e2) + (z - 5e2) * (z - 5e2)) as d from cell))""")


def around(src: str) -> str:
    return f"""
select a.*, l.h as hl, q.h as hr, d.h as hd, u.h as hu from {src} a
left join {src} l on l.cx = a.cx and l.cz = a.cz and l.iz = a.iz and l.ix = a.ix - 1
left join {src} q on q.cx = a.cx and q.cz = a.cz and q.iz = a.iz and q.ix = a.ix + 1
left join {src} d on d.cx = a.cx and d.cz = a.cz and d.ix = a.ix and d.iz = a.iz - 1
left join {src} u on u.cx = a.cx and u.cz = a.cz and u.ix = a.ix and u.iz = a.iz + 1"""


STEPS["near_cell"] = around("cell")
STEPS["near_rough"] = around("rough")
STEPS["steep"] = f"""
select {_CELL}, to_ix, to_iz, gap from (
  select {_CELL}, h - least(hl, hr, hd, hu) as gap,
    case when hl = least(hl, hr, hd, hu) then ix - 1 when hr = least(hl, hr, hd, hu) then ix + 1 else ix end as to_ix,
    case when hl = least(hl, hr, hd, hu) or hr = least(hl, hr, hd, hu) then iz when hd = least(hl, hr, hd, hu) then iz - 1 else iz + 1 end as to_iz
  from near_rough where hl is not null and hr is not null and hd is not null and hu is not null) where gap > 5e-1"""
twin("ord5_steepest", f"select {_CELL}, to_ix, to_iz, {r('gap')} as drop from steep")
twin("rst7_thermal_pass", f"""
select {_CELL}, {r('h + coalesce(sum(g), 0e0)')} as h from rough left join (
  select {_CELL}, -(gap - 5e-1) * 1e-1 * 5e-1 as g from steep
  union all select cx, cz, to_ix, to_iz, (gap - 5e-1) * 1e-1 * 5e-1 from steep) using ({_CELL}) group by {_CELL}, h""")
twin("agg15_height_range", f"select cx, cz, {r('min(h)')} as min_h, {r('max(h)')} as max_h from cell group by cx, cz")
twin("flt11_under_water", "select cx, cz, count(*) as wet from cell where h < 0 group by cx, cz")


def bilinear(points: str, key: str) -> str:
    at = lambda dx, dz: f"(select h from cell c where c.cx = q.cx and c.cz = q.cz and c.ix = least(greatest(q.jx + {dx}, 0), 31) and c.iz = least(greatest(q.jz + {dz}, 0), 31))"
    return f"""
select {key}, {r('coalesce((h00 * (1e0 - fx) + h10 * fx) * (1e0 - fz) + (h01 * (1e0 - fx) + h11 * fx) * fz, 0e0)')} as h from (
  select {key}, gx - jx as fx, gz - jz as fz, {at(0, 0)} as h00, {at(1, 0)} as h10, {at(0, 1)} as h01, {at(1, 1)} as h11 from (
    select *, cast(floor(gx) as bigint) as jx, cast(floor(gz) as bigint) as jz from (
      select *, (x - (wx0 + cx * 5e2)) / (5e2 / 31e0) as gx, (z - (wz0 + cz * 5e2)) / (5e2 / 31e0) as gz from (
        select p.*, wx0, wz0, cast(floor((x - wx0) / 5e2) as bigint) as cx, cast(floor((z - wz0) / 5e2) as bigint) as cz from ({points}) p, world))) q)"""


twin("jon9_heights_at_points", bilinear("select node_id, x, y * 11e-1 as z from pt", "node_id"))
twin("rst8_bilinear", bilinear("select osm_id, avg(x) as x, avg(y) as z from building_pt group by osm_id", "osm_id"))
STEPS["gradient"] = f"""
select *, gx / l as nx, 1e0 / l as ny, gz / l as nz, degrees(acos(least(greatest(1e0 / l, -1e0), 1e0))) as slope from (
  select *, sqrt(gx * gx + 1e0 + gz * gz) as l from (
    select *, (coalesce(hl, h) - coalesce(hr, h)) / (2e0 * (5e2 / 31e0)) as gx, (coalesce(hd, h) - coalesce(hu, h)) / (2e0 * (5e2 / 31e0)) as gz from {{0}}))"""
STEPS["grad_cell"] = STEPS["gradient"].format("near_cell")
STEPS["grad_rough"] = STEPS.pop("gradient").format("near_rough")
twin("rst9_normals", f"select {_CELL}, {rs(4, 'nx', 'ny', 'nz')} from grad_cell")
twin("rst10_slope", f"select {_CELL}, {rs(2, 'slope')} from grad_cell")
_REL = "(h - lo) / (case when hi - lo < 1e-3 then 1e0 else hi - lo end)"
for _src in ("cell", "rough"):
    STEPS[f"rel_{_src}"] = f"select *, {_REL} as rel from grad_{_src} join (select cx, cz, min(h) as lo, max(h) as hi from {_src} group by cx, cz) using (cx, cz)"
twin("rst11_relative_height", f"select {_CELL}, {rs(4, 'rel')} from rel_cell")
_LOW, _MID, _HIGH, _PEAK, _STEEP = ([.35, .45, .35, 1.0], [.55, .5, .4, 1.0], [.7, .7, .72, 1.0], [.95, .95, .98, 1.0], [.5, .45, .4, 1.0])


def mix(a: str, b: str, t: str) -> str:
    return f"(({a}) * (1e0 - ({t})) + ({b}) * ({t}))"


def by_height(k: int) -> str:
    e = lambda c: f"{c[k]}e0"
    return f"""(case when rel < 2e-1 then {e(_LOW)} when rel < 5e-1 then {mix(e(_LOW), e(_MID), '(rel - 2e-1) / 3e-1')}
  when rel < 75e-2 then {mix(e(_MID), e(_HIGH), '(rel - 5e-1) / 25e-2')} when rel < 9e-1 then {mix(e(_HIGH), e(_PEAK), '(rel - 75e-2) / 15e-2')} else {e(_PEAK)} end)"""


_BLEND = "(case when slope < 25e0 then 0e0 when slope > 45e0 then 1e0 else (slope - 25e0) / 2e1 end)"
_MODES = {
    "solid": lambda k: f"{[.4, .5, .3, 1.0][k]}e0",
    "heightgradient": by_height,
    "slopegradient": lambda k: mix(f"{_LOW[k]}e0", f"{_STEEP[k]}e0", _BLEND),
    "biome": lambda k: mix(by_height(k), f"{_STEEP[k]}e0", _BLEND),
}


def shade(k: int, mode: str) -> str:
    return f"case when h < 0 then {[.35, .4, .35, 1.0][k]}e0 else {_MODES[mode](k)} end"


for _mode in _MODES:
    twin(f"rst12_{_mode}", f"select {_CELL}, " + ", ".join(f"{r(shade(k, _mode))} as {c}" for k, c in enumerate("rgba")) + " from rel_rough")
twin("rst13_mask_definition", f"select mw as mask_width, mh as mask_height, {r(_MC)} as cell, {r('wx0')} as mask_x, {r('wz0')} as mask_z from mask_def")
STEPS["flat_mask"] = """
select ix, iz, max(weight) as weight from (
  select ix, iz, weight from bring_weight union all select ix, iz, weight from aring_weight union all select ix, iz, weight from line_weight)
where weight > 0 group by ix, iz"""
twin("rst14_flatten_mask", f"select ix, iz, {rs(4, 'weight')} from flat_mask")
STEPS["mask_at"] = f"""
select cx, cz, q.ix, q.iz, h, (coalesce(a.weight, 0) * (1e0 - fx) + coalesce(b.weight, 0) * fx) * (1e0 - fz)
  + (coalesce(c.weight, 0) * (1e0 - fx) + coalesce(d.weight, 0) * fx) * fz as weight
from (select *, gx - jx as fx, gz - jz as fz, least(jx, mw - 1) as m0, least(jx + 1, mw - 1) as m1, least(jz, mh - 1) as k0, least(jz + 1, mh - 1) as k1 from (
    select *, cast(floor(gx) as bigint) as jx, cast(floor(gz) as bigint) as jz from (
      select cell.*, mw, mh, (x - wx0) / {_MC} as gx, (z - wz0) / {_MC} as gz from cell, mask_def))) q
left join flat_mask a on a.ix = m0 and a.iz = k0 left join flat_mask b on b.ix = m1 and b.iz = k0
left join flat_mask c on c.ix = m0 and c.iz = k1 left join flat_mask d on d.ix = m1 and d.iz = k1"""
twin("rst15_mask_sample", f"select {_CELL}, {rs(4, 'weight')} from mask_at")
twin("rst16_levelled", f"select {_CELL}, {r('case when weight > 0 then h * (1e0 - weight) + 2e0 * weight else h end')} as h from mask_at")
twin("rst17_vertices", f"""
select {_CELL}, {r('x')} as vx, {r('h')} as vy, {r('-z')} as vz, {r('nx', 4)} as nx, {r('ny', 4)} as ny, {r('-nz', 4)} as nz, {r('slope', 2)} as slope,
  {', '.join(f"{r(shade(k, 'biome'), 4)} as color_{c}" for k, c in enumerate('rgba'))} from rel_cell""")
twin("udf1_custom_colour", f"""
select {_CELL}, {r('floor(h / 5e0) - 2e0 * floor(floor(h / 5e0) / 2e0)')} as r, {r('slope / 9e1')} as g, {r('5e-1')} as b, {r('1e0')} as a from grad_cell""")
twin("geo7_water", f"""
select cx, cz, {', '.join(f"{r(x)} as x{i}, {r('0e0')} as y{i}, {r('-(' + z + ')')} as z{i}" for i, (x, z) in enumerate([('wx0 + cx * 5e2', 'wz0 + cz * 5e2'), ('wx0 + cx * 5e2 + 5e2', 'wz0 + cz * 5e2'), ('wx0 + cx * 5e2 + 5e2', 'wz0 + cz * 5e2 + 5e2'), ('wx0 + cx * 5e2', 'wz0 + cz * 5e2 + 5e2')]))},
  {r('2e-1', 4)} as color_r, {r('4e-1', 4)} as color_g, {r('6e-1', 4)} as color_b, {r('9e-1', 4)} as color_a from chunk, world""")
STEPS["even_cell"] = "select cx, cz, ix // 2 as ix, iz // 2 as iz, x, z, h from cell where ix % 2 = 0 and iz % 2 = 0"
STEPS["square"] = """
select a.*, q.h as h10, u.h as h01, d.h as h11 from even_cell a
join even_cell q on q.cx = a.cx and q.cz = a.cz and q.iz = a.iz and q.ix = a.ix + 1
join even_cell u on u.cx = a.cx and u.cz = a.cz and u.ix = a.ix and u.iz = a.iz + 1
join even_cell d on d.cx = a.cx and d.cz = a.cz and d.ix = a.ix + 1 and d.iz = a.iz + 1"""
_STEP = "(2e0 * (5e2 / 31e0))"
_AT = {"00": ("x", "h", "z"), "10": (f"x + {_STEP}", "h10", "z"), "01": ("x", "h01", f"z + {_STEP}"), "11": (f"x + {_STEP}", "h11", f"z + {_STEP}")}
twin("geo8_surface_triangles", " union all ".join(
    f"select {_CELL}, {half} as half, " + ", ".join(
        f"{r(_AT[c][0])} as x{i}, {r(_AT[c][1])} as y{i}, {r('-(' + _AT[c][2] + ')')} as z{i}" for i, c in enumerate(corners))
    + " from square" for half, corners in ((0, ("00", "10", "01")), (1, ("10", "11", "01")))))
