"""Small fixed lookup tables (drivers, teams, session labels, circuits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: published lookup tables ---------------------------------------------------
DRIVER_NAMES = {
    "1": "Max Verstappen", "2": "Logan Sargeant", "3": "Daniel Ricciardo", "4": "Lando Norris",
    "10": "Pierre Gasly", "11": "Sergio Perez", "14": "Fernando Alonso", "16": "Charles Leclerc",
    "18": "Lance Stroll", "20": "Kevin Magnussen", "21": "Nyck de Vries", "22": "Yuki Tsunoda",
    "23": "Alexander Albon", "24": "Zhou Guanyu", "27": "Nico Hulkenberg", "31": "Esteban Ocon",
    "38": "Oliver Bearman", "40": "Liam Lawson", "43": "Franco Colapinto", "44": "Lewis Hamilton",
    "55": "Carlos Sainz", "63": "George Russell", "77": "Valtteri Bottas", "81": "Oscar Piastri",
}
TEAM_NAMES = {
    "1": "Red Bull Racing", "2": "Williams", "3": "RB", "4": "McLaren", "10": "Alpine",
    "11": "Red Bull Racing", "14": "Aston Martin", "16": "Ferrari", "18": "Aston Martin",
    "20": "Haas", "21": "AlphaTauri", "22": "RB", "23": "Williams", "24": "Kick Sauber",
    "27": "Haas", "31": "Alpine", "38": "Ferrari", "40": "RB", "43": "Williams",
    "44": "Mercedes", "55": "Ferrari", "63": "Mercedes", "77": "Kick Sauber", "81": "McLaren",
}
SESSION_LABELS = {"Q": "Qualifying", "R": "Race", "Sprint": "Sprint", "SQ": "Sprint Shootout"}
CIRCUITS = [
    ("Bahrain Grand Prix", 26.0325, 50.5106), ("Saudi Arabian Grand Prix", 21.6319, 39.1044),
    ("Australian Grand Prix", -37.8497, 144.9680), ("Japanese Grand Prix", 34.8431, 136.5407),
    ("Chinese Grand Prix", 31.3389, 121.2197), ("Miami Grand Prix", 25.9581, -80.2389),
    ("Emilia Romagna Grand Prix", 44.3439, 11.7167), ("Monaco Grand Prix", 43.7347, 7.4206),
    ("Canadian Grand Prix", 45.5000, -73.5228), ("Spanish Grand Prix", 41.5700, 2.2611),
    ("Austrian Grand Prix", 47.2197, 14.7647), ("British Grand Prix", 52.0786, -1.0169),
    ("Hungarian Grand Prix", 47.5789, 19.2486), ("Belgian Grand Prix", 50.4372, 5.9714),
    ("Dutch Grand Prix", 52.3888, 4.5409), ("Italian Grand Prix", 45.6156, 9.2811),
    ("Azerbaijan Grand Prix", 40.3725, 49.8533), ("Singapore Grand Prix", 1.2914, 103.8636),
    ("United States Grand Prix", 30.1328, -97.6411), ("Mexico City Grand Prix", 19.4042, -99.0907),
    ("São Paulo Grand Prix", -23.7036, -46.6997), ("Las Vegas Grand Prix", 36.1147, -115.1728),
    ("Qatar Grand Prix", 25.4900, 51.4542), ("Abu Dhabi Grand Prix", 24.4672, 54.6031),
]
# ----------------------------------------------------------------------------------------------


def drivers(spark: SparkSession) -> DataFrame:
    rows = [(number, name, TEAM_NAMES.get(number)) for number, name in DRIVER_NAMES.items()]
    return spark.createDataFrame(rows, "Driver string, driver_name string, team_name string")


def session_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SESSION_LABELS.items()), "Session string, session_label string")


def circuits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CIRCUITS, "name string, lat double, lon double")
