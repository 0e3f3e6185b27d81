"""The airlines, airports, city names and routes that results must agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: code: (name, class, country)
AIRLINES = {
    "KE": ("대한항공", "fsc", "KR"),
    "OZ": ("아시아나항공", "fsc", "KR"),
    "LJ": ("진에어", "lcc", "KR"),
    "7C": ("제주항공", "lcc", "KR"),
    "TW": ("티웨이항공", "lcc", "KR"),
    "BX": ("에어부산", "lcc", "KR"),
    "ZE": ("이스타항공", "lcc", "KR"),
    "RS": ("에어서울", "lcc", "KR"),
    "YP": ("에어프레미아", "lcc", "KR"),
    "NH": ("ANA", "fsc", "JP"),
    "JL": ("JAL", "fsc", "JP"),
    "MM": ("피치항공", "lcc", "JP"),
    "GK": ("젯스타재팬", "lcc", "JP"),
    "SQ": ("싱가포르항공", "fsc", "SG"),
    "CX": ("캐세이퍼시픽", "fsc", "HK"),
    "VN": ("베트남항공", "fsc", "VN"),
    "VJ": ("비엣젯항공", "lcc", "VN"),
    "AK": ("에어아시아", "lcc", "MY"),
    "5J": ("세부퍼시픽", "lcc", "PH"),
    "CI": ("중화항공", "fsc", "TW"),
    "BR": ("에바항공", "fsc", "TW"),
    "CZ": ("중국남방항공", "fsc", "CN"),
    "CA": ("에어차이나", "fsc", "CN"),
    "UA": ("유나이티드항공", "fsc", "US"),
    "DL": ("델타항공", "fsc", "US"),
    "AA": ("아메리칸항공", "fsc", "US"),
    "HA": ("하와이안항공", "fsc", "US"),
    "TG": ("타이항공", "fsc", "TH"),
    "MH": ("말레이시아항공", "fsc", "MY"),
    "PR": ("필리핀항공", "fsc", "PH"),
}
#: Short names that posts use for airlines.
AIRLINE_SHORT_NAMES = {"티웨이": "TW", "아시아나": "OZ", "비엣젯": "VJ", "젯스타": "GK", "피치": "MM", "세부퍼시픽": "5J"}
#: code: (city, country, representative)
AIRPORTS = {
    "ICN": ("서울", "KR", "ICN"),
    "GMP": ("서울", "KR", "ICN"),
    "NRT": ("도쿄", "JP", "NRT"),
    "HND": ("도쿄", "JP", "NRT"),
    "KIX": ("오사카", "JP", "KIX"),
    "ITM": ("오사카", "JP", "KIX"),
    "FUK": ("후쿠오카", "JP", "FUK"),
    "CTS": ("삿포로", "JP", "CTS"),
    "OKA": ("오키나와", "JP", "OKA"),
    "NGO": ("나고야", "JP", "NGO"),
    "TPE": ("타이베이", "TW", "TPE"),
    "TSA": ("타이베이", "TW", "TPE"),
    "HKG": ("홍콩", "HK", "HKG"),
    "PVG": ("상하이", "CN", "PVG"),
    "SHA": ("상하이", "CN", "PVG"),
    "BKK": ("방콕", "TH", "BKK"),
    "DMK": ("방콕", "TH", "BKK"),
    "DAD": ("다낭", "VN", "DAD"),
    "SGN": ("호치민", "VN", "SGN"),
    "SIN": ("싱가포르", "SG", "SIN"),
    "KUL": ("쿠알라룸푸르", "MY", "KUL"),
    "MNL": ("마닐라", "PH", "MNL"),
    "CEB": ("세부", "PH", "CEB"),
    "GUM": ("괌", "GU", "GUM"),
    "LAX": ("LA", "US", "LAX"),
    "JFK": ("뉴욕", "US", "JFK"),
    "EWR": ("뉴욕", "US", "JFK"),
    "LGA": ("뉴욕", "US", "JFK"),
    "HNL": ("하와이", "US", "HNL"),
    "KOA": ("하와이", "US", "HNL"),
    "OGG": ("하와이", "US", "HNL"),
}
#: Names of destinations and of origins in posts.
DESTINATION_NAMES = {
    "도쿄": "NRT",
    "동경": "NRT",
    "TOKYO": "NRT",
    "오사카": "KIX",
    "OSAKA": "KIX",
    "후쿠오카": "FUK",
    "하카타": "FUK",
    "FUKUOKA": "FUK",
    "삿포로": "CTS",
    "SAPPORO": "CTS",
    "치토세": "CTS",
    "오키나와": "OKA",
    "OKINAWA": "OKA",
    "나하": "OKA",
    "나고야": "NGO",
    "NAGOYA": "NGO",
    "타이베이": "TPE",
    "타이페이": "TPE",
    "TAIPEI": "TPE",
    "대만": "TPE",
    "홍콩": "HKG",
    "HONGKONG": "HKG",
    "상하이": "PVG",
    "SHANGHAI": "PVG",
    "방콕": "BKK",
    "BANGKOK": "BKK",
    "다낭": "DAD",
    "DANANG": "DAD",
    "호치민": "SGN",
    "사이공": "SGN",
    "HOCHIMINH": "SGN",
    "싱가포르": "SIN",
    "SINGAPORE": "SIN",
    "쿠알라룸푸르": "KUL",
    "KL": "KUL",
    "KUALALUMPUR": "KUL",
    "마닐라": "MNL",
    "MANILA": "MNL",
    "세부": "CEB",
    "CEBU": "CEB",
    "괌": "GUM",
    "GUAM": "GUM",
    "LA": "LAX",
    "엘에이": "LAX",
    "로스앤젤레스": "LAX",
    "LOSANGELES": "LAX",
    "뉴욕": "JFK",
    "NEWYORK": "JFK",
    "NY": "JFK",
    "하와이": "HNL",
    "호놀룰루": "HNL",
    "HAWAII": "HNL",
    "HONOLULU": "HNL",
}
ORIGIN_NAMES = {
    "인천": "ICN",
    "INCHEON": "ICN",
    "서울": "ICN",
    "SEOUL": "ICN",
    "김포": "GMP",
    "GIMPO": "GMP",
}
#: What cities are called for readers.
CITY_NAMES = {
    "ICN": "인천",
    "GMP": "김포",
    "NRT": "도쿄",
    "HND": "도쿄",
    "KIX": "오사카",
    "FUK": "후쿠오카",
    "CTS": "삿포로",
    "OKA": "오키나와",
    "NGO": "나고야",
    "BKK": "방콕",
    "DMK": "방콕",
    "SGN": "호찌민",
    "HAN": "하노이",
    "DAD": "다낭",
    "SIN": "싱가포르",
    "KUL": "쿠알라룸푸르",
    "MNL": "마닐라",
    "CEB": "세부",
    "TPE": "타이베이",
    "HKG": "홍콩",
    "PVG": "상하이",
    "LAX": "LA",
    "JFK": "뉴욕",
    "HNL": "호놀룰루",
    "SFO": "샌프란시스코",
    "GUM": "괌",
}
#: Destinations of each region; all of them in display order.
REGIONS = {
    "JP": ["NRT", "KIX", "FUK", "CTS", "OKA", "NGO"], "CN": ["PVG"], "TW": ["TPE"], "HK": ["HKG"],
    "SEA": ["BKK", "DAD", "SGN", "SIN", "KUL", "MNL", "CEB"], "US": ["LAX", "JFK", "HNL"], "GU": ["GUM"]}
ROUTE_ORDER = ["NRT", "KIX", "FUK", "CTS", "OKA", "NGO", "TPE", "HKG", "PVG", "BKK", "DAD", "SGN", "SIN", "KUL", "MNL", "CEB", "GUM", "LAX", "JFK", "HNL"]
CLASSES = ["fsc", "lcc", "mixed"]
SOURCES = ["ppomppu", "ruliweb", "clien", "playwings"]


def airlines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in AIRLINES.items()], "code string, name string, carrier_class string, country string")


def airports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in AIRPORTS.items()], "iata string, city string, country string, representative string")

#: Seasons of flights from Incheon to Japan, month by month, with the months of the lowest fares.
SEASONS = [
    (1, "mid", "성수기"), (2, "good", "저점"), (3, "good", "저렴"), (4, "mid", "보통"), (5, "good", "저렴"), (6, "mid", "보통"),
    (7, "bad", "성수기"), (8, "bad", "최고가"), (9, "mid", "보통"), (10, "good", "저렴"), (11, "good", "저점"), (12, "bad", "성수기")]
BEST_MONTHS = (2, 11)


def seasons(spark):
    """(month, tone, label, best)."""
    return spark.createDataFrame([(m, tone, label, m in BEST_MONTHS) for m, tone, label in SEASONS], "month int, tone string, label string, best boolean")
