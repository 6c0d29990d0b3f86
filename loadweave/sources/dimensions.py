"""Fixed lookup values of the Spanish load model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.calendar import HolidayRule

# fixed values: community -> (station id, station name)
STATIONS = {
    "AN": ("5783", "Sevilla/Aeropuerto"),
    "AR": ("9434", "Zaragoza/Aeropuerto"),
    "AS": ("1249X", "Oviedo"),
    "CB": ("1109", "Santander/Aeropuerto"),
    "CE": ("5000C", "Ceuta"),
    "CL": ("2422", "Valladolid/Aeropuerto"),
    "CM": ("4121", "Ciudad Real"),
    "CN": ("C649I", "Gran Canaria/Aeropuerto"),
    "CT": ("0076", "Barcelona/Aeropuerto"),
    "EX": ("4452", "Badajoz/Aeropuerto"),
    "GA": ("1428", "Santiago/Aeropuerto"),
    "MC": ("7178I", "Murcia"),
    "MD": ("3129", "Madrid/Retiro"),
    "ML": ("6000A", "Melilla"),
    "NC": ("9262", "Pamplona/Aeropuerto"),
    "PV": ("1082", "Bilbao/Aeropuerto"),
    "RI": ("9170", "Logroño/Aeropuerto"),
    "VC": ("8416", "Valencia/Aeropuerto"),
}

# fixed values: community -> (latitude, longitude, city)
COORDINATES = {
    "AN": (37.39, -5.99, "Sevilla"),
    "AR": (41.66, -0.88, "Zaragoza"),
    "AS": (43.36, -5.85, "Oviedo"),
    "CB": (43.46, -3.82, "Santander"),
    "CE": (35.89, -5.32, "Ceuta"),
    "CL": (41.65, -4.72, "Valladolid"),
    "CM": (38.99, -3.93, "Ciudad Real"),
    "CN": (28.00, -15.41, "Las Palmas"),
    "CT": (41.39, 2.16, "Barcelona"),
    "EX": (38.88, -6.97, "Badajoz"),
    "GA": (42.88, -8.54, "Santiago"),
    "MC": (37.98, -1.13, "Murcia"),
    "MD": (40.41, -3.70, "Madrid"),
    "ML": (35.29, -2.94, "Melilla"),
    "NC": (42.81, -1.64, "Pamplona"),
    "PV": (43.26, -2.93, "Bilbao"),
    "RI": (42.47, -2.44, "Logroño"),
    "VC": (39.47, -0.38, "Valencia"),
}

# fixed values: NUTS2 code -> region name
NUTS2_NAMES = {
    "ES11": "Galicia",
    "ES12": "Principado de Asturias",
    "ES13": "Cantabria",
    "ES21": "País Vasco",
    "ES22": "Comunidad Foral de Navarra",
    "ES23": "La Rioja",
    "ES24": "Aragón",
    "ES30": "Comunidad de Madrid",
    "ES41": "Castilla y León",
    "ES42": "Castilla-la Mancha",
    "ES43": "Extremadura",
    "ES51": "Cataluña",
    "ES52": "Comunitat Valenciana",
    "ES53": "Illes Balears",
    "ES61": "Andalucía",
    "ES62": "Región de Murcia",
    "ES63": "Ciudad Autónoma de Ceuta",
    "ES64": "Ciudad Autónoma de Melilla",
    "ES70": "Canarias",
}

# fixed values: NUTS2 code -> land area in km2
NUTS2_AREA = {
    "ES11": 29574,
    "ES12": 10604,
    "ES13": 5321,
    "ES21": 7234,
    "ES22": 10391,
    "ES23": 5045,
    "ES24": 47720,
    "ES30": 8028,
    "ES41": 94226,
    "ES42": 79461,
    "ES43": 41635,
    "ES51": 32114,
    "ES52": 23255,
    "ES53": 4992,
    "ES61": 87268,
    "ES62": 11313,
    "ES63": 19,
    "ES64": 13,
    "ES70": 7447,
}

# fixed values: community -> NUTS2 code
COMMUNITY_NUTS2 = {
    "AN": "ES61",
    "AR": "ES24",
    "AS": "ES12",
    "CB": "ES13",
    "CE": "ES63",
    "CL": "ES41",
    "CM": "ES42",
    "CN": "ES70",
    "CT": "ES51",
    "GA": "ES11",
    "MC": "ES62",
    "MD": "ES30",
    "ML": "ES64",
    "NC": "ES22",
    "PV": "ES21",
    "RI": "ES23",
    "VC": "ES52",
}

# the mapping with Extremadura, whose weather would otherwise belong to no region
COMMUNITY_NUTS2_FULL = COMMUNITY_NUTS2 | {"EX": "ES43"}

# fixed values: calendar regions
CALENDAR_REGIONS = (
    "AN", "AR", "AS", "CB", "CE", "CL", "CM", "CN", "CT", "EX", "GA", "IB", "MC", "MD", "ML", "NC", "PV", "RI", "VC",
)

# standing national holidays
NATIONAL_RULES = (
    HolidayRule("Año nuevo", 1, 1),
    HolidayRule("Epifanía del Señor", 1, 6),
    HolidayRule("Viernes Santo", easter_offset=-2),
    HolidayRule("Fiesta del Trabajo", 5, 1),
    HolidayRule("Asunción de la Virgen", 8, 15),
    HolidayRule("Fiesta Nacional de España", 10, 12),
    HolidayRule("Todos los Santos", 11, 1),
    HolidayRule("Día de la Constitución Española", 12, 6),
    HolidayRule("La Inmaculada Concepción", 12, 8),
    HolidayRule("Natividad del Señor", 12, 25),
)

# standing regional holidays; each government moves some days every year, so
# pass the official list of the year where it matters
REGIONAL_RULES = (
    HolidayRule("Día de Andalucía", 2, 28, region="AN"),
    HolidayRule("Día de Aragón", 4, 23, region="AR"),
    HolidayRule("Día de Asturias", 9, 8, region="AS"),
    HolidayRule("Día de las Instituciones de Cantabria", 7, 28, region="CB"),
    HolidayRule("La Bien Aparecida", 9, 15, region="CB"),
    HolidayRule("Día de Ceuta", 9, 2, region="CE"),
    HolidayRule("Fiesta de Castilla y León", 4, 23, region="CL"),
    HolidayRule("Día de Castilla-La Mancha", 5, 31, region="CM"),
    HolidayRule("Día de Canarias", 5, 30, region="CN"),
    HolidayRule("San Juan", 6, 24, region="CT"),
    HolidayRule("Fiesta Nacional de Cataluña", 9, 11, region="CT"),
    HolidayRule("San Esteban", 12, 26, region="CT"),
    HolidayRule("Día de Extremadura", 9, 8, region="EX"),
    HolidayRule("Día de las Letras Gallegas", 5, 17, region="GA"),
    HolidayRule("Día Nacional de Galicia", 7, 25, region="GA"),
    HolidayRule("Día de las Illes Balears", 3, 1, region="IB"),
    HolidayRule("Día de la Región de Murcia", 6, 9, region="MC"),
    HolidayRule("Fiesta de la Comunidad de Madrid", 5, 2, region="MD"),
    HolidayRule("Día de Melilla", 9, 17, region="ML"),
    HolidayRule("San Francisco Javier", 12, 3, region="NC"),
    HolidayRule("Día de La Rioja", 6, 9, region="RI"),
    HolidayRule("San José", 3, 19, region="VC"),
    HolidayRule("Día de la Comunitat Valenciana", 10, 9, region="VC"),
    *(HolidayRule("Jueves Santo", easter_offset=-3, region=r) for r in CALENDAR_REGIONS if r not in ("CT", "VC")),
    *(HolidayRule("Lunes de Pascua", easter_offset=1, region=r) for r in ("CT", "IB", "NC", "PV", "RI", "VC")),
)

SPAIN_RULES = NATIONAL_RULES + REGIONAL_RULES


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The lookup values as small frames, for joins and SQL."""
    stations = [(c, *v) for c, v in STATIONS.items()]
    coordinates = [(c, *v) for c, v in COORDINATES.items()]
    regions = [(c, name, NUTS2_AREA[c]) for c, name in NUTS2_NAMES.items()]
    return {
        "stations": spark.createDataFrame(stations, "community_code string, indicativo string, station string"),
        "coordinates": spark.createDataFrame(coordinates, "community_code string, latitude double, longitude double, city string"),
        "regions": spark.createDataFrame(regions, "nuts2_code string, region_name string, area_km2 int"),
        "codes": spark.createDataFrame(list(COMMUNITY_NUTS2_FULL.items()), "community_code string, nuts2_code string"),
    }
