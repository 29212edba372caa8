"""Vocabularies, defaults and colours that results must agree with.

Everything in this file is data.  Colours are (red, green, blue, alpha) in 0..1.
"""

# Geodesy.
EARTH_RADIUS = 6378137.0
METRES_PER_DEGREE = 111320.0
MAX_MERCATOR_LAT = 85.051128

# Road class -> values of the tag `highway`.
ROAD_VALUES = {
    "Motorway": ["motorway", "motorway_link"],
    "Trunk": ["trunk", "trunk_link"],
    "Primary": ["primary", "primary_link"],
    "Secondary": ["secondary", "secondary_link"],
    "Tertiary": ["tertiary", "tertiary_link"],
    "Residential": ["residential", "living_street", "unclassified"],
    "Service": ["service"],
    "Footway": ["footway", "pedestrian", "steps"],
    "Cycleway": ["cycleway"],
    "Path": ["path", "track", "bridleway"],
}

# Road class -> width in metres, lanes.
ROAD_WIDTH = {
    "Motorway": 14.0,
    "Trunk": 10.5,
    "Primary": 10.0,
    "Secondary": 8.0,
    "Tertiary": 7.0,
    "Residential": 6.0,
    "Service": 4.0,
    "Footway": 2.0,
    "Cycleway": 2.5,
    "Path": 1.5,
}
DEFAULT_ROAD_WIDTH = 6.0
LANE_WIDTH = 3.5
ROAD_LANES = {
    "Motorway": 4,
    "Trunk": 3,
    "Primary": 2,
    "Secondary": 2,
    "Tertiary": 2,
    "Residential": 2,
    "Service": 1,
    "Footway": 1,
    "Cycleway": 1,
    "Path": 1,
}
DEFAULT_ROAD_LANES = 2

# Building class -> values of the tag `building`.
BUILDING_VALUES = {
    "Residential": ["residential"],
    "Commercial": ["commercial"],
    "Industrial": ["industrial"],
    "Retail": ["retail"],
    "Office": ["office"],
    "Apartments": ["apartments", "dormitory"],
    "House": ["house"],
    "Detached": ["detached"],
    "Garage": ["garage", "carport"],
    "Shed": ["shed", "hut"],
    "Church": ["church", "cathedral", "chapel", "mosque", "temple", "synagogue"],
    "School": ["school", "university", "college"],
    "Hospital": ["hospital", "clinic"],
    "Warehouse": ["warehouse"],
}

# Height in metres -> values of the tag `building`.
BUILDING_HEIGHTS = {
    3.0: ["garage", "shed", "hut", "carport"],
    8.0: ["house", "detached", "bungalow"],
    15.0: ["apartments", "dormitory"],
    20.0: ["commercial", "office"],
    12.0: ["industrial", "warehouse", "school", "university"],
    25.0: ["church", "cathedral"],
    18.0: ["hospital"],
}

# Area class by tag; the tags are tried in this order.
AREA_VALUES = {
    "natural": {
        "Water": ["water", "bay", "coastline"],
        "Forest": ["wood", "tree_row"],
        "Grass": ["grassland", "scrub", "heath"],
    },
    "waterway": {
        "Water": ["riverbank", "dock", "boatyard"],
    },
    "leisure": {
        "Park": ["park", "garden", "playground", "nature_reserve"],
    },
    "landuse": {
        "Residential": ["residential"],
        "Commercial": ["commercial", "retail"],
        "Industrial": ["industrial"],
        "Forest": ["forest"],
        "Grass": ["grass", "meadow", "village_green", "recreation_ground"],
        "Farmland": ["farmland", "farmyard", "orchard", "vineyard"],
        "Cemetery": ["cemetery"],
        "Water": ["basin", "reservoir"],
    },
    "amenity": {
        "Parking": ["parking"],
    },
}
NATURAL_AREAS = ["Park", "Forest", "Grass"]

# Roof class -> values of the roof shape tag.
ROOF_VALUES = {
    "Flat": ["flat"],
    "Gabled": ["gabled", "half-hipped", "saltbox"],
    "Hipped": ["hipped", "hip"],
    "Pyramidal": ["pyramidal"],
    "Skillion": ["skillion", "lean_to"],
    "Dome": ["dome", "onion"],
}

# Colour name -> colour.
NAMED_COLOURS = {
    "red": (0.8, 0.2, 0.2, 1.0),
    "green": (0.2, 0.6, 0.2, 1.0),
    "blue": (0.2, 0.4, 0.8, 1.0),
    "yellow": (0.9, 0.85, 0.2, 1.0),
    "orange": (0.9, 0.5, 0.1, 1.0),
    "brown": (0.55, 0.35, 0.2, 1.0),
    "white": (0.95, 0.95, 0.95, 1.0),
    "black": (0.1, 0.1, 0.1, 1.0),
    "grey": (0.5, 0.5, 0.5, 1.0),
    "gray": (0.5, 0.5, 0.5, 1.0),
    "beige": (0.9, 0.85, 0.7, 1.0),
    "cream": (1.0, 0.95, 0.8, 1.0),
    "tan": (0.82, 0.7, 0.55, 1.0),
    "pink": (1.0, 0.7, 0.75, 1.0),
    "maroon": (0.5, 0.15, 0.15, 1.0),
    "terracotta": (0.8, 0.45, 0.3, 1.0),
    "sandstone": (0.85, 0.75, 0.6, 1.0),
    "brick": (0.7, 0.35, 0.25, 1.0),
    "slate": (0.4, 0.45, 0.5, 1.0),
    "copper": (0.5, 0.7, 0.6, 1.0),
    "silver": (0.75, 0.75, 0.8, 1.0),
    "gold": (0.85, 0.7, 0.3, 1.0),
}

# Building class -> wall colour, roof colour.
WALL_COLOURS = {
    "Commercial": (0.6, 0.7, 0.8, 1.0),
    "Office": (0.6, 0.7, 0.8, 1.0),
    "Industrial": (0.5, 0.5, 0.5, 1.0),
    "Warehouse": (0.5, 0.5, 0.5, 1.0),
    "Residential": (0.85, 0.75, 0.65, 1.0),
    "House": (0.85, 0.75, 0.65, 1.0),
    "Detached": (0.85, 0.75, 0.65, 1.0),
    "Apartments": (0.8, 0.75, 0.7, 1.0),
    "Church": (0.9, 0.88, 0.85, 1.0),
    "School": (0.85, 0.8, 0.75, 1.0),
    "Hospital": (0.85, 0.8, 0.75, 1.0),
    "Retail": (0.75, 0.7, 0.65, 1.0),
    "Garage": (0.6, 0.55, 0.5, 1.0),
    "Shed": (0.6, 0.55, 0.5, 1.0),
}
DEFAULT_WALL_COLOUR = (0.7, 0.7, 0.7, 1.0)
ROOF_COLOURS = {
    "Commercial": (0.3, 0.35, 0.4, 1.0),
    "Office": (0.3, 0.35, 0.4, 1.0),
    "Industrial": (0.35, 0.35, 0.35, 1.0),
    "Warehouse": (0.35, 0.35, 0.35, 1.0),
    "Residential": (0.55, 0.35, 0.25, 1.0),
    "House": (0.55, 0.35, 0.25, 1.0),
    "Detached": (0.55, 0.35, 0.25, 1.0),
    "Apartments": (0.4, 0.4, 0.45, 1.0),
    "Church": (0.3, 0.3, 0.35, 1.0),
    "School": (0.5, 0.3, 0.25, 1.0),
    "Hospital": (0.5, 0.3, 0.25, 1.0),
    "Retail": (0.4, 0.4, 0.4, 1.0),
    "Garage": (0.45, 0.4, 0.35, 1.0),
    "Shed": (0.45, 0.4, 0.35, 1.0),
}
DEFAULT_ROOF_COLOUR = (0.4, 0.4, 0.45, 1.0)

# Road class -> colour.
ROAD_COLOURS = {
    "Motorway": (0.2, 0.2, 0.25, 1.0),
    "Trunk": (0.2, 0.2, 0.25, 1.0),
    "Primary": (0.25, 0.25, 0.28, 1.0),
    "Secondary": (0.3, 0.3, 0.32, 1.0),
    "Tertiary": (0.35, 0.35, 0.38, 1.0),
    "Residential": (0.35, 0.35, 0.38, 1.0),
    "Service": (0.4, 0.4, 0.42, 1.0),
    "Footway": (0.6, 0.55, 0.45, 1.0),
    "Path": (0.6, 0.55, 0.45, 1.0),
    "Cycleway": (0.3, 0.5, 0.3, 1.0),
}
DEFAULT_ROAD_COLOUR = (0.4, 0.4, 0.4, 1.0)
JUNCTION_COLOUR = (0.3, 0.3, 0.32, 1.0)

# Area class -> colour; lift above the ground in metres.
AREA_COLOURS = {
    "Water": (0.25, 0.45, 0.65, 1.0),
    "Park": (0.35, 0.55, 0.35, 1.0),
    "Forest": (0.25, 0.4, 0.25, 1.0),
    "Grass": (0.45, 0.58, 0.4, 1.0),
    "Parking": (0.42, 0.42, 0.44, 1.0),
    "Commercial": (0.55, 0.5, 0.6, 1.0),
    "Residential": (0.52, 0.52, 0.48, 1.0),
    "Industrial": (0.5, 0.48, 0.42, 1.0),
    "Farmland": (0.6, 0.55, 0.4, 1.0),
    "Cemetery": (0.4, 0.48, 0.42, 1.0),
}
DEFAULT_AREA_COLOUR = (0.48, 0.48, 0.48, 1.0)
AREA_LIFT = {"Water": 0.01, "Parking": 0.03}
DEFAULT_AREA_LIFT = 0.02

# Faces.
ROAD_LIFT = 0.1
JUNCTION_LIFT = 0.06
JUNCTION_DISTANCE = 2.0
JUNCTION_RADIUS_PER_WIDTH = 0.6
JUNCTION_SEGMENTS = 12
ROOF_PITCH = 0.3
