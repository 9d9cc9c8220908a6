"""Fixed places and distance."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Built-in cell towers (id, latitude, longitude, area, city).
TOWERS = (
    ("SRT-T01", 21.1702, 72.8311, "Athwa Gate", "Surat"),
    ("SRT-T02", 21.1860, 72.7933, "Adajan", "Surat"),
    ("SRT-T03", 21.2148, 72.8470, "Katargam", "Surat"),
    ("SRT-T04", 21.1565, 72.7710, "Vesu", "Surat"),
    ("SRT-T05", 21.2050, 72.8630, "Varachha", "Surat"),
    ("SRT-T06", 21.1980, 72.8150, "Ring Road", "Surat"),
    ("SRT-T07", 21.1690, 72.7880, "Piplod", "Surat"),
    ("SRT-T08", 21.1780, 72.8550, "Udhna", "Surat"),
    ("SRT-T09", 21.1450, 72.7650, "Dumas Road", "Surat"),
    ("SRT-T10", 21.2280, 72.8380, "Sachin GIDC", "Surat"),
    ("AMD-T01", 23.0225, 72.5714, "SG Highway", "Ahmedabad"),
    ("AMD-T02", 23.0396, 72.5660, "Vastrapur", "Ahmedabad"),
    ("AMD-T03", 23.0126, 72.5827, "Navrangpura", "Ahmedabad"),
    ("MUM-T01", 19.0760, 72.8777, "Andheri", "Mumbai"),
    ("MUM-T02", 19.0176, 72.8562, "Dadar", "Mumbai"),
    ("MUM-T03", 19.0896, 72.8656, "Goregaon", "Mumbai"),
    ("MUM-T04", 18.9696, 72.8199, "Colaba", "Mumbai"),
    ("DEL-T01", 28.6139, 77.2090, "Connaught Place", "Delhi"),
    ("DEL-T02", 28.5672, 77.2100, "Saket", "Delhi"),
    ("DEL-T03", 28.6328, 77.2197, "Karol Bagh", "Delhi"),
    ("BLR-T01", 12.9716, 77.5946, "MG Road", "Bangalore"),
    ("BLR-T02", 12.9352, 77.6245, "Koramangala", "Bangalore"),
    ("BLR-T03", 13.0206, 77.5650, "Rajajinagar", "Bangalore"),
    ("PNE-T01", 18.5204, 73.8567, "Shivajinagar", "Pune"),
    ("PNE-T02", 18.5074, 73.8077, "Hinjawadi", "Pune"),
    ("HYD-T01", 17.3850, 78.4867, "HITEC City", "Hyderabad"),
    ("HYD-T02", 17.4065, 78.4772, "Banjara Hills", "Hyderabad"),
    ("CHE-T01", 13.0827, 80.2707, "T. Nagar", "Chennai"),
    ("CHE-T02", 13.0569, 80.2425, "Guindy", "Chennai"),
)

# Cities (name, latitude, longitude) in the order a text is matched.
CITIES = (
    ("Surat", 21.1702, 72.8311),
    ("Mumbai", 19.0760, 72.8777),
    ("Delhi", 28.6139, 77.2090),
    ("Bangalore", 12.9716, 77.5946),
    ("Ahmedabad", 23.0225, 72.5714),
    ("Pune", 18.5204, 73.8567),
    ("Hyderabad", 17.3850, 78.4867),
    ("Chennai", 13.0827, 80.2707),
)

# Public address prefix and its city.
ADDRESS_PREFIXES = (
    ("103.21", "Mumbai"),
    ("103.22", "Delhi"),
    ("103.23", "Bangalore"),
    ("103.24", "Ahmedabad"),
    ("103.25", "Surat"),
    ("103.26", "Pune"),
    ("103.27", "Hyderabad"),
    ("103.28", "Chennai"),
)

# Tower-id prefix and its city, in matching order for map places.
TOWER_PREFIXES = (
    ("MUM", "Mumbai"),
    ("DEL", "Delhi"),
    ("BLR", "Bangalore"),
    ("AMD", "Ahmedabad"),
    ("SRT", "Surat"),
    ("PNE", "Pune"),
    ("HYD", "Hyderabad"),
    ("CHE", "Chennai"),
)

EARTH_RADIUS_KM = 6371.0


def _first_towers() -> list[tuple]:
    """First built-in tower of each three-letter prefix, in table order."""
    seen: dict[str, tuple] = {}
    for row in TOWERS:
        seen.setdefault(row[0].split("-")[0], row)
    return list(seen.values())


def _place(lat: float, lon: float, label: str) -> Column:
    return F.struct(
        F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), F.lit(label).alias("label")
    )


def _literal_map(pairs) -> Column:
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), v if isinstance(v, Column) else F.lit(v)]
    return F.create_map(*flat)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), 2
    )
    return F.lit(EARTH_RADIUS_KM * 2.0) * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def address_city(ip: Column, whole_octets: bool = True) -> Column:
    """City of a public address.

    ``whole_octets`` matches "103.21." only; switched off, "103.211.x" counts as
    "103.21" too. Every prefix is six characters long.
    """
    head = F.substring_index(ip, ".", 2) if whole_octets else F.substring(ip, 1, 6)
    return _literal_map(ADDRESS_PREFIXES)[head]


def event_place(location: Column, public_ip: Column, whole_octets: bool = True) -> Column:
    """Place of an event from the fixed tables, struct<lat, lon, label> or null.

    Order: tower id, tower-id prefix (its first three letters), address prefix, city
    named in the text. The tables are literals in the plan, so no join and no
    broadcast takes part.
    """
    up = F.upper(location)
    towers = [(t[0], _place(t[1], t[2], f"{t[3]}, {t[4]}")) for t in TOWERS]
    prefixes = [(t[0].split("-")[0], _place(t[1], t[2], f"{t[3]}, {t[4]}")) for t in _first_towers()]
    coords = {name: (lat, lon) for name, lat, lon in CITIES}
    addresses = [(city, _place(*coords[city], f"IP-Geo ({city})")) for _, city in ADDRESS_PREFIXES]
    named = F.lit(None)
    for name, lat, lon in reversed(CITIES):
        named = F.when(up.contains(name.upper()), _place(lat, lon, name)).otherwise(named)
    return F.coalesce(
        _literal_map(towers)[up],
        _literal_map(prefixes)[F.substring(up, 1, 3)],
        _literal_map(addresses)[address_city(public_ip, whole_octets)],
        named,
    )


def node_city(location: Column) -> Column:
    """City label of a location for the network view."""
    by_id = _literal_map((t[0], t[4]) for t in TOWERS)
    by_name = _literal_map((name.lower(), name) for name, _, _ in CITIES)
    return F.coalesce(
        by_id[F.upper(location)],
        by_name[F.lower(location)],
        F.when(F.length(location) <= 32, location),
    )


def map_city(location: Column) -> Column:
    """City of a location for the map views: named in the text, else id prefix."""
    # Order in which city names are looked for on the map.
    order = ("Mumbai", "Delhi", "Bangalore", "Ahmedabad", "Surat", "Pune", "Hyderabad", "Chennai")
    out = _literal_map(TOWER_PREFIXES)[F.substring(F.upper(location), 1, 3)]
    for city in reversed(order):
        out = F.when(F.lower(location).contains(city.lower()), city).otherwise(out)
    return out


def map_tower(location: Column) -> Column:
    """Tower id that stands for a location on the map, null when it has none."""
    by_id = _literal_map((t[0], t[0]) for t in TOWERS)[location]
    by_prefix = _literal_map((t[0].split("-")[0], t[0]) for t in _first_towers())[
        F.substring(F.upper(location), 1, 3)
    ]
    by_city = _literal_map((t[4], t[0]) for t in _first_towers())[map_city(location)]
    return F.coalesce(by_id, by_prefix, by_city)
