"""Rule catalogue and country centroids as small joinable tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: category of rules that are not catalogued.
UNKNOWN_CATEGORY = "기타"

# Rule id, threat name, category, mitre, condition; the order is the display order.
RULES = (
    ("SUSPICIOUS_PROCESS_CHAIN", "의심스러운 프로세스 실행 체인", "권한상승", "T1059",
     "office app starts a shell as its child"),
    ("DOWNLOAD_AND_EXECUTE", "다운로드 후 실행", "악성코드", "T1105+T1204",
     "download, then execution from a temp or download path"),
    ("SCRIPT_FROM_TEMP_PATH", "임시·다운로드 경로 스크립트 실행", "실행", "T1059",
     "script argument lies in a temp or download path"),
    ("FILE_IN_AUTORUN_PATH", "자동실행 경로 파일 생성", "지속성", "T1547",
     "file created, written or moved into an autorun path"),
    ("WEAK_TLS_HANDSHAKE", "낡은 TLS 로 맺은 연결", "명령제어", "T1573",
     "handshake below TLS 1.2"),
)

# ISO2 code, name, latitude, longitude.
CENTROIDS = (
    ("US", "United States", 37.09, -95.71), ("CA", "Canada", 56.13, -106.35),
    ("MX", "Mexico", 23.63, -102.55), ("BR", "Brazil", -14.24, -51.93),
    ("AR", "Argentina", -38.42, -63.62), ("CL", "Chile", -35.68, -71.54),
    ("CO", "Colombia", 4.57, -74.30), ("GB", "United Kingdom", 55.38, -3.44),
    ("IE", "Ireland", 53.41, -8.24), ("FR", "France", 46.23, 2.21),
    ("DE", "Germany", 51.17, 10.45), ("NL", "Netherlands", 52.13, 5.29),
    ("BE", "Belgium", 50.50, 4.47), ("ES", "Spain", 40.46, -3.75),
    ("PT", "Portugal", 39.40, -8.22), ("IT", "Italy", 41.87, 12.57),
    ("CH", "Switzerland", 46.82, 8.23), ("AT", "Austria", 47.52, 14.55),
    ("SE", "Sweden", 60.13, 18.64), ("NO", "Norway", 60.47, 8.47),
    ("FI", "Finland", 61.92, 25.75), ("DK", "Denmark", 56.26, 9.50),
    ("PL", "Poland", 51.92, 19.15), ("CZ", "Czechia", 49.82, 15.47),
    ("RO", "Romania", 45.94, 24.97), ("UA", "Ukraine", 48.38, 31.17),
    ("RU", "Russia", 61.52, 105.32), ("TR", "Turkey", 38.96, 35.24),
    ("IL", "Israel", 31.05, 34.85), ("SA", "Saudi Arabia", 23.89, 45.08),
    ("AE", "United Arab Emirates", 23.42, 53.85), ("ZA", "South Africa", -30.56, 22.94),
    ("NG", "Nigeria", 9.08, 8.68), ("EG", "Egypt", 26.82, 30.80),
    ("KE", "Kenya", -0.02, 37.91), ("IN", "India", 20.59, 78.96),
    ("PK", "Pakistan", 30.38, 69.35), ("CN", "China", 35.86, 104.20),
    ("HK", "Hong Kong", 22.32, 114.17), ("TW", "Taiwan", 23.70, 120.96),
    ("JP", "Japan", 36.20, 138.25), ("KR", "South Korea", 35.91, 127.77),
    ("SG", "Singapore", 1.35, 103.82), ("MY", "Malaysia", 4.21, 101.98),
    ("TH", "Thailand", 15.87, 100.99), ("VN", "Vietnam", 14.06, 108.28),
    ("ID", "Indonesia", -0.79, 113.92), ("PH", "Philippines", 12.88, 121.77),
    ("AU", "Australia", -25.27, 133.78), ("NZ", "New Zealand", -40.90, 174.89),
)


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(RULES)]
    return spark.createDataFrame(
        rows, "ord int, rule_id string, threat_name string, category string, "
              "catalog_mitre string, description string")


def centroids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CENTROIDS, "code string, country string, lat double, lng double")


def with_catalog(df: DataFrame) -> DataFrame:
    """Adds `threat_name` and `category`; unknown rules fall back to their id."""
    # Five fixed rows: broadcasting them never grows with the data.
    table = F.broadcast(rules(df.sparkSession).select(
        "rule_id", F.col("threat_name").alias("_name"), F.col("category").alias("_category")))
    return (df.join(table, "rule_id", "left")
            .withColumn("threat_name", F.coalesce("_name", "rule_id"))
            .withColumn("category", F.coalesce("_category", F.lit(UNKNOWN_CATEGORY)))
            .drop("_name", "_category"))


def with_rule_texts(df: DataFrame) -> DataFrame:
    """Adds `threat_name`, `category`, `catalog_mitre` and `description`; an unknown rule has its
    id as name and description, and no technique."""
    table = F.broadcast(rules(df.sparkSession).select("rule_id", "catalog_mitre", "description"))
    return with_catalog(df).join(table, "rule_id", "left").withColumn("description", F.coalesce("description", "rule_id"))


def rule_ids_named(term: str) -> list[str]:
    return [r[0] for r in RULES if term.lower() in r[1].lower()]
