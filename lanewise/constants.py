"""Fixed values of the road data model. They must equal the model's own, for results to agree."""

#: Degrees per metre, and metres per degree.
DIS_FACTOR = 1 / 110 / 1000
METRES_PER_DEGREE = 110 * 1000
#: Sphere radii: mean radius in metres, and the rounded one in kilometres.
EARTH_RADIUS_M = 6371008.8
EARTH_RADIUS_KM = 6371.0
#: WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_E = 0.0818191908426215

#: Road class of an OSM highway tag.
HIGHWAY_CLASS = {
    "motorway": "motorway", "motorway_link": "motorway", "trunk": "trunk", "trunk_link": "trunk", "primary": "primary", "primary_link": "primary",
    "secondary": "secondary", "secondary_link": "secondary", "tertiary": "tertiary", "tertiary_link": "tertiary", "residential": "residential",
    "residential_link": "residential", "service": "service", "services": "service", "cycleway": "cycleway", "footway": "footway",
    "pedestrian": "footway", "steps": "footway", "track": "track", "unclassified": "unclassified",
}
#: Class numbers of the network builder.
LINK_TYPE_NO = {
    "motorway": 1, "trunk": 2, "primary": 3, "secondary": 4, "tertiary": 5, "residential": 6, "service": 7, "cycleway": 8, "footway": 9,
    "track": 10, "unclassified": 11, "connector": 20, "railway": 30, "aeroway": 31,
}
#: Road levels of the fusion, with fractional levels for links.
ROAD_LEVEL = {
    "motorway": 1, "motorway_link": 1.1, "trunk": 2, "trunk_link": 2.2, "primary": 3, "primary_link": 3.3, "secondary": 4, "secondary_link": 4.4,
    "tertiary": 5, "tertiary_link": 5.5, "residential": 6, "service": 7, "cycleway": 8, "footway": 9, "track": 10, "unclassified": 11,
    "living_street": 15, "connector": 20, "railway": 30, "aeroway": 31,
}
DEFAULT_LANES = {
    "motorway": 4, "trunk": 3, "primary": 3, "secondary": 2, "tertiary": 2, "residential": 1, "service": 1, "cycleway": 1, "footway": 1, "track": 1,
    "unclassified": 1, "connector": 2,
}
DEFAULT_SPEED = {
    "motorway": 59, "trunk": 39, "primary": 39, "secondary": 39, "tertiary": 29, "residential": 29, "service": 29, "cycleway": 9, "footway": 4,
    "track": 29, "unclassified": 29, "connector": 59,
}
DEFAULT_ONEWAY = {
    "motorway": True, "trunk": True, "primary": True, "secondary": False, "tertiary": False, "residential": False, "service": False,
    "cycleway": True, "footway": True, "track": True, "unclassified": False, "connector": False, "railway": True, "aeroway": True,
}
#: Highway tags without a class that are passed over in silence.
NEGLIGIBLE_CLASSES = (
    "path", "construction", "proposed", "raceway", "bridleway", "rest_area", "su", "living_street", "road", "abandoned", "planned",
    "trailhead", "stairs",
)
#: Tags that exclude a way from an agent type's network.
AGENT_EXCLUDES = {
    "auto": {
        "area": ["yes"],
        "highway": ["cycleway", "footway", "path", "pedestrian", "steps", "track", "corridor", "elevator", "escalator", "proposed",
                    "construction", "bridleway", "abandoned", "platform", "raceway", "service"],
        "motor_vehicle": ["no"], "motorcar": ["no"], "access": ["private"],
        "service": ["parking", "parking_aisle", "driveway", "private", "emergency_access"],
    },
    "bike": {
        "area": ["yes"],
        "highway": ["footway", "steps", "corridor", "elevator", "escalator", "motor", "proposed", "construction", "abandoned", "platform", "raceway"],
        "bicycle": ["no"], "service": ["private"], "access": ["private"],
    },
    "walk": {
        "area": ["yes"],
        "highway": ["cycleway", "motor", "proposed", "construction", "abandoned", "platform", "raceway"],
        "foot": ["no"], "service": ["private"], "access": ["private"],
    },
}
#: Links at most this long, signal to signal, belong to one intersection; metres.
INTERSECTION_BUFFER = 20.0

#: Headers of the network's CSV files.
GMNS_NODE = ["name", "node_id", "osm_node_id", "osm_highway", "zone_id", "ctrl_type", "node_type", "activity_type", "is_boundary", "x_coord", "y_coord", "main_node_id", "poi_id"]
GMNS_LINK = ["name", "link_id", "osm_way_id", "from_node_id", "to_node_id", "dir_flag", "length", "lanes", "free_speed", "capacity", "link_type_name", "link_type", "geometry", "allowed_uses", "from_biway"]
GMNS_SEGMENT = ["segment_id", "link_id", "ref_node_id", "start_lr", "end_lr", "capacity", "free_speed", "bike_facility", "ped_facility", "parking", "allowed_uses", "l_lanes_added", "r_lanes_added"]
GMNS_POI = ["name", "poi_id", "osm_way_id", "osm_relation_id", "building", "amenity", "geometry", "centroid"]

#: Rows of a lane label: y coordinates from 240 to 710, every 10; -2 where the lane has no point.
LABEL_ROWS = (240, 710, 10)
LABEL_MISSING = -2
LABEL_SCALE = 1280 / 1024
