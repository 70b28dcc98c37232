"""Word lists and lookup tables the results depend on."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Words that stand for a missing value.
NULL_WORDS = ("none", "null", "nan", "-", "--")

# Spellings repaired on exact match.
TEXT_FIXES = {
    "Tofas": "Tofaş", "Tofaş": "Tofaş", "TofaÅŸ": "Tofaş", "TofaÅ£": "Tofaş", "Tofaţ": "Tofaş",
    "Sahin": "Şahin", "Şahin": "Şahin", "Ţahin": "Şahin",
    "Doğan": "Doğan", "Dogan": "Doğan", "Dođan": "Doğan",
    "Serçe": "Serçe", "Serce": "Serçe", "Ser?e": "Serçe",
    "Mercedes - Benz": "Mercedes-Benz", "Mercedes Benz": "Mercedes-Benz", "Mercedes-Benz": "Mercedes-Benz",
}

# Series of the Tofaş brand by folded key; the order decides which word wins in free text.
TOFAS_SERIES = {
    "sahin": "Şahin", "ahin": "Şahin", "dogan": "Doğan", "kartal": "Kartal", "murat": "Murat", "serce": "Serçe",
}

# Option labels. Keys are looked up after folding, so keys that hold a space, a mark or a
# non-ASCII letter never match; they are kept because the field then keeps its own text.
TRANSMISSION = {
    "manuel": "Manuel", "duz": "Manuel", "düz": "Manuel", "otomatik": "Otomatik",
    "yarı otomatik": "Yarı Otomatik", "yari otomatik": "Yarı Otomatik",
}
FUEL = {
    "benzin": "Benzin", "dizel": "Dizel", "diesel": "Dizel", "lpg": "LPG",
    "benzin lpg": "Benzin & LPG", "benzin & lpg": "Benzin & LPG",
    "hibrit": "Hibrit", "hybrid": "Hibrit", "elektrik": "Elektrik", "elektrikli": "Elektrik",
}
BODY = {
    "sedan": "Sedan", "hatchback": "Hatchback", "station wagon": "Station Wagon", "suv": "SUV", "coupe": "Coupe",
    "cabrio": "Cabrio", "convertible": "Cabrio", "pick-up": "Pick-up", "pickup": "Pick-up",
}
SELLER = {"sahibinden": "Sahibinden", "galeriden": "Galeriden", "yetkili bayiden": "Yetkili Bayiden"}

ACRONYMS = ("ABS", "AMG", "CDI", "CNG", "DCI", "DSG", "GTI", "LPG", "TSI", "TDI", "VTEC")
PRODUCT_SPELLINGS = (
    (r"blue\s*motion", "BlueMotion"), (r"blue\s*hdi", "BlueHDi"), (r"blue\s*tec", "BlueTEC"),
    (r"multijet", "Multijet"), (r"ecoboost", "EcoBoost"),
)

LIRA_KEYS = ("tl", "try", "turklirasi", "t")
TRUE_KEYS = ("1", "true", "yes", "evet")

# Claim words searched in folded titles, and the labels they give.
CLAIM_WORDS = ("boyasiz", "degisensiz", "tramersiz")
UNPAINTED = "Boyasız"
UNCHANGED = "Değişensiz"
CLAIMED_FROM_TITLE = "clean_claimed_from_title"
CLAIMED_BY_SEGMENT = "clean_claimed"

UNKNOWN_CATEGORY = "Bilinmiyor"
UNTITLED = "İlan"

# Brands sold on the market but possibly absent from a catalog, and fixed brand keys.
EXTRA_BRANDS = ("TOGG", "Tesla", "Ferrari", "Lamborghini", "Bentley", "Rolls-Royce", "Maserati", "Porsche")
FIXED_BRAND_KEYS = {
    "tofas": "Tofaş", "tofa": "Tofaş", "tofat": "Tofaş",
    "mercedesbenz": "Mercedes-Benz", "mercedes-benz": "Mercedes-Benz",
}

# The 81 provinces.
PROVINCES = (
    "Adana", "Adıyaman", "Afyonkarahisar", "Ağrı", "Aksaray", "Amasya", "Ankara", "Antalya", "Ardahan", "Artvin",
    "Aydın", "Balıkesir", "Bartın", "Batman", "Bayburt", "Bilecik", "Bingöl", "Bitlis", "Bolu", "Burdur", "Bursa",
    "Çanakkale", "Çankırı", "Çorum", "Denizli", "Diyarbakır", "Düzce", "Edirne", "Elazığ", "Erzincan", "Erzurum",
    "Eskişehir", "Gaziantep", "Giresun", "Gümüşhane", "Hakkari", "Hatay", "Iğdır", "Isparta", "İstanbul", "İzmir",
    "Kahramanmaraş", "Karabük", "Karaman", "Kars", "Kastamonu", "Kayseri", "Kırıkkale", "Kırklareli", "Kırşehir",
    "Kilis", "Kocaeli", "Konya", "Kütahya", "Malatya", "Manisa", "Mardin", "Mersin", "Muğla", "Muş", "Nevşehir",
    "Niğde", "Ordu", "Osmaniye", "Rize", "Sakarya", "Samsun", "Siirt", "Sinop", "Sivas", "Şanlıurfa", "Şırnak",
    "Tekirdağ", "Tokat", "Trabzon", "Tunceli", "Uşak", "Van", "Yalova", "Yozgat", "Zonguldak",
)
PROVINCE_ALIASES = {"afyon": "Afyonkarahisar", "icel": "Mersin", "maras": "Kahramanmaraş"}

# Month names by case-folded spelling.
MONTHS = {
    "ocak": 1, "şubat": 2, "subat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "mayis": 5, "haziran": 6, "temmuz": 7,
    "ağustos": 8, "agustos": 8, "eylül": 9, "eylul": 9, "ekim": 10, "kasım": 11, "kasim": 11, "aralık": 12, "aralik": 12,
}

# Page markers, checked in this order: challenge, login, removed, active.
CHALLENGE_MARKERS = (
    "bağlantınız kontrol ediliyor", "basılı tut", "olağan dışı erişim", "cdn-cgi/challenge-platform",
)
LOGIN_MARKERS = ("<title>sahibinden.com giriş</title>", "individual-login-body", "giriş yapmanız gerekmektedir")
REMOVED_MARKERS = (
    "ilan yayından kaldırılmış", "ilan yayından kaldırıldı", "bu ilan yayında değildir",
    "bu ilan artık yayında değil", "aradığınız ilan yayından kaldırılmış", "aradığınız sayfa bulunamadı",
    "ilan bulunamadı",
)
ACTIVE_MARKERS = ("classifiedDetail", "classifiedId", "classifiedInfo", "İlan No", "İlan Tarihi")

# Mileage bands: lower, upper (None = open), label.
MILEAGE_BANDS = (
    (0, 25_000, "0-25 bin km"), (25_001, 50_000, "25-50 bin km"), (50_001, 75_000, "50-75 bin km"),
    (75_001, 100_000, "75-100 bin km"), (100_001, 150_000, "100-150 bin km"), (150_001, 200_000, "150-200 bin km"),
    (200_001, 300_000, "200-300 bin km"), (300_001, 500_000, "300-500 bin km"), (500_001, None, "500 bin km+"),
)

# Upper edges of the default price bands; each band starts one lira above the previous edge, the last is open.
PRICE_BAND_EDGES = (
    *range(100_000, 2_000_001, 100_000), *range(2_250_000, 5_000_001, 250_000), 6_000_000, 7_500_000, 10_000_000, 15_000_000,
)


def python_key(text: str) -> str:
    """Driver-side twin of ``normalize_key`` for building small lookup tables."""
    ascii_text = unicodedata.normalize("NFKD", text.strip().casefold()).encode("ascii", "ignore").decode("ascii")
    return "".join(c for c in ascii_text if c in "abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=1)
def province_by_key() -> dict[str, str]:
    return {python_key(name): name for name in PROVINCES}


@lru_cache(maxsize=1)
def province_by_casefold() -> dict[str, str]:
    return {name.casefold(): name for name in PROVINCES}
