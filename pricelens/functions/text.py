"""Text rules for listing fields, all as built-in column expressions.

The ``*_of`` functions expect text that ``clean_text`` has already produced as a column of its
own; a job cleans every field once in one projection and builds on the result, so the cleaning
expression is not repeated inside each rule.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricelens.functions import vocabulary as vocab
from pricelens.functions.folding import ascii_fold, casefold, compatibility_compose, literal_map

SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# White space of ASCII other than a lone space between two words.
ASCII_SPACING = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f]|  "


def _single_spaced(text: Column) -> Column:
    """ASCII text, the usual case, in which at most the ends need trimming; decided without rewriting the text."""
    return (F.octet_length(text) == F.length(text)) & ~text.rlike(ASCII_SPACING)


def _squeeze_all(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def squeeze(text: Column) -> Column:
    """Collapse every Unicode whitespace run to one space and trim."""
    return F.when(_single_spaced(text), F.btrim(text)).otherwise(_squeeze_all(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def lookup(key: Column, mapping: dict[str, str]) -> Column:
    """Small fixed dictionary as a literal map; null when the key is absent."""
    return F.try_element_at(literal_map(mapping), key)


def normalize_key(text: Column) -> Column:
    return F.regexp_replace(ascii_fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(ascii_fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def clean_text(text: Column) -> Column:
    """Trimmed display text; placeholder words become null; known misspellings are repaired."""
    # no-break space and dashes become plain; soft hyphen, zero-width space and byte-order mark vanish
    text = text.cast("string")
    plain = _squeeze_all(F.translate(text, "\u00a0\u2013\u2014\u00ad\u200b\ufeff", " --"))
    plain = F.when(_single_spaced(text), F.btrim(text)).otherwise(plain)
    # lower case never has fewer characters
    word = F.length(plain) <= max(map(len, vocab.NULL_WORDS))
    kept = F.when((plain == "") | (word & F.lower(plain).isin(*vocab.NULL_WORDS)), F.lit(None)).otherwise(plain)
    return F.coalesce(lookup(kept, vocab.TEXT_FIXES), kept)


def normalize_int(text: Column) -> Column:
    """Digits of a text field as a whole number (a sign or a decimal point is dropped)."""
    return F.nullif(F.regexp_replace(text.cast("string"), "[^0-9]", ""), F.lit("")).try_cast("bigint")


def normalize_number(column: Column, dtype: str) -> Column:
    """Digits of text; numeric input keeps its sign and is truncated."""
    if dtype == "string":
        return normalize_int(column)
    if dtype in ("double", "float"):
        return F.when(F.isnan(column), None).otherwise(column).try_cast("bigint")
    return column.cast("bigint")


def currency_of(cleaned: Column) -> Column:
    key = normalize_key(cleaned)
    return F.when(cleaned.isNull() | key.isin(*vocab.LIRA_KEYS), "TRY").otherwise(F.upper(cleaned))


def normalize_currency(text: Column) -> Column:
    return currency_of(clean_text(text))


def choice_of(cleaned: Column, mapping: dict[str, str]) -> Column:
    return F.coalesce(F.when(cleaned.isNotNull(), lookup(normalize_key(cleaned), mapping)), cleaned)


def normalize_choice(text: Column, mapping: dict[str, str]) -> Column:
    return choice_of(clean_text(text), mapping)


def normalize_flag(value: Column, dtype: str = "string") -> Column:
    if dtype in ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean"):
        return F.when(value.cast("int") == 1, 1).otherwise(0)
    return F.when(normalize_key(value).isin(*vocab.TRUE_KEYS), 1).otherwise(0)


def color_of(cleaned: Column) -> Column:
    cased = F.concat(F.upper(F.substring(cleaned, 1, 1)), F.lower(F.substr(cleaned, F.lit(2))))
    return F.coalesce(lookup(cleaned, vocab.TEXT_FIXES), cased)


def normalize_color(text: Column) -> Column:
    return color_of(clean_text(text))


def package_of(cleaned: Column) -> Column:
    """Uniform ' / ' spacing and house spelling for trim acronyms and product names."""
    spaced = _squeeze_all(F.regexp_replace(cleaned, f"{SPACE_CLASS}*/{SPACE_CLASS}*", " / "))
    out = F.when(cleaned.contains("/"), spaced).otherwise(cleaned)
    patterns = [(name, name) for name in vocab.ACRONYMS] + list(vocab.PRODUCT_SPELLINGS)
    respelled = out
    for pattern, spelling in patterns:
        respelled = F.regexp_replace(respelled, rf"(?iuU)\b{pattern}\b", spelling)
    # one test decides whether the chain has anything to do
    any_name = r"(?iuU)\b(?:" + "|".join(pattern for pattern, _ in patterns) + r")\b"
    return F.when(cleaned.rlike(any_name), respelled).otherwise(out)


def normalize_package(text: Column) -> Column:
    return package_of(clean_text(text))


def claim_from_title(title: Column) -> dict[str, Column]:
    """Paint / changed / damage claims a seller makes in the title."""
    return claim_from_key(normalize_key(title))


def claim_from_key(key: Column) -> dict[str, Column]:
    unpainted, unchanged, undamaged = (key.contains(w) for w in vocab.CLAIM_WORDS)
    claimed = unpainted | (unchanged & undamaged)
    return {
        "paint_status": F.when(unpainted, vocab.UNPAINTED),
        "changed_part_status": F.when(unchanged, vocab.UNCHANGED),
        "damage_status": F.when(claimed, vocab.CLAIMED_FROM_TITLE),
    }


def series_of(packaged: Column, brand: Column) -> Column:
    single = (normalize_key(brand) == "mercedesbenz") & packaged.rlike(r"^\p{L}$")
    return F.when(single, F.concat(F.upper(packaged), F.lit(" Serisi"))).otherwise(packaged)


def normalize_series(text: Column, brand: Column) -> Column:
    return series_of(normalize_package(text), brand)


def catalog_series(text: Column, brand: Column) -> Column:
    trimmed = strip(F.coalesce(text, F.lit("")))
    single = (normalize_key(brand) == "mercedesbenz") & trimmed.rlike(r"^\p{L}$")
    return F.when(single, F.concat(F.upper(trimmed), F.lit(" Serisi"))).otherwise(trimmed)


def tofas_haystack(*signals: Column) -> Column:
    return normalize_key(F.concat_ws(" ", *[F.coalesce(s, F.lit("")) for s in signals]))


def tofas_series(series: Column, haystack: Column) -> Column:
    """Series of one brand from cleaned text: its own key, or the first known word in the other fields."""
    inferred = F.coalesce(*[F.when(haystack.contains(key), name) for key, name in vocab.TOFAS_SERIES.items()])
    return F.coalesce(lookup(normalize_key(series), vocab.TOFAS_SERIES), inferred, series)


def cosmetic_key(text: Column) -> Column:
    """Spelling-insensitive identity: case, spaces and hyphens ignored, other marks kept."""
    bare = F.regexp_replace(F.coalesce(clean_text(text), F.lit("")), f"(?:{SPACE_CLASS}|-)+", "")
    return casefold(bare)


def _province(key: Column) -> Column:
    from_list = lookup(key, vocab.province_by_key())
    return F.coalesce(from_list, lookup(key, vocab.PROVINCE_ALIASES))


# cleaned text holds no white space but single spaces
_SEPARATOR, _WORD = "[ ,/]", "[^ ,/]"


def first_word(cleaned: Column) -> Column:
    return F.nullif(F.regexp_extract(cleaned, f"({_WORD}+)", 1), F.lit(""))


def split_province(cleaned: Column, word_key: Column) -> tuple[Column, Column]:
    """(province, rest) when the first word, given by its folded key, is a province, else (null, whole text)."""
    province = _province(word_key)
    tail = F.regexp_replace(cleaned, f"^{_SEPARATOR}*{_WORD}+{_SEPARATOR}*", "")
    rest = F.nullif(F.btrim(F.regexp_replace(tail, f"{_SEPARATOR}+", " ")), F.lit(""))
    return province, F.when(word_key.isNull(), F.lit(None)).when(province.isNull(), cleaned).otherwise(rest)


def word_key(word: Column) -> Column:
    return F.when(word.isNotNull(), normalize_key(word))


def place_parts(city: Column, district: Column, city_key: Column, district_key: Column) -> dict[str, Column]:
    """Province and rest of both cleaned fields; the input of ``place_of``."""
    province, city_rest = split_province(city, city_key)
    district_city, district_rest = split_province(district, district_key)
    return {"province": province, "city_rest": city_rest, "district_city": district_city, "district_rest": district_rest}


def place_of(parts: dict[str, Column], city: Column, district: Column) -> tuple[Column, Column]:
    """City and district before the equal-name rule; a district written after the city moves over."""
    province, rest = parts["province"], parts["city_rest"]
    # without a province the rest is the whole city text, which then takes the district's place
    moved = parts["district_rest"].isNotNull() & (province.isNull() | parts["district_city"].eqNullSafe(province))
    return F.coalesce(province, city), F.when(rest.isNotNull(), rest).when(moved, parts["district_rest"]).otherwise(district)


def drop_repeated_city(city: Column, district: Column) -> Column:
    return F.when(city.isNotNull() & (normalize_key(city) == normalize_key(district)), F.lit(None)).otherwise(district)


def normalize_location(city: Column, district: Column) -> tuple[Column, Column]:
    city, district = clean_text(city), clean_text(district)
    parts = place_parts(city, district, word_key(first_word(city)), word_key(first_word(district)))
    final_city, final_district = place_of(parts, city, district)
    return final_city, drop_repeated_city(final_city, final_district)


def split_page_location(text: Column) -> tuple[Column, Column]:
    """City and district as printed on a result page: 'A / B', 'A  B', or 'Province rest'."""
    trimmed = strip(text)
    parts = F.filter(F.split(trimmed, f"{SPACE_CLASS}*/{SPACE_CLASS}*|{SPACE_CLASS}{{2,}}"), lambda p: p != "")
    compact = F.coalesce(F.try_element_at(parts, F.lit(1)), trimmed)
    folded = casefold(compact)
    by_fold = vocab.province_by_casefold()
    exact = lookup(folded, by_fold)
    head = lookup(F.substring_index(folded, " ", 1), by_fold)
    # province names hold no space, so the part before the first space is the only possible prefix
    rest = F.nullif(strip(F.regexp_replace(compact, "^[^ ]* ", "")), F.lit(""))
    two = F.size(parts) >= 2
    blank = text.isNull() | (text == "")
    city = (
        F.when(blank, F.lit(None))
        .when(two, F.try_element_at(parts, F.lit(1)))
        .otherwise(F.coalesce(exact, F.when(folded.contains(" "), head), compact))
    )
    district = (
        F.when(blank, F.lit(None))
        .when(two, F.try_element_at(parts, F.lit(2)))
        .when(exact.isNull() & folded.contains(" ") & head.isNotNull(), rest)
    )
    return city, district


def year_from_title(title: Column) -> Column:
    full = F.nullif(F.regexp_extract(title, r"(?U)\b(19[5-9][0-9]|20[0-2][0-9])\b", 1), F.lit("")).cast("int")
    short = F.nullif(F.regexp_extract(title, r"(?iuU)\b([0-2][0-9])\s*(?:model|mdl)\b", 1), F.lit("")).cast("int")
    return F.coalesce(full, F.when(short <= 29, 2000 + short).when(short.isNotNull(), 1900 + short))


def mileage_from_title(title: Column) -> Column:
    prepared = F.replace(
        F.replace(F.translate(F.lower(title), ".,", ""), F.lit("ooo"), F.lit("000")), F.lit("bin"), F.lit("000")
    )
    km = F.nullif(F.regexp_extract(prepared, r"(?U)\b([0-9]{2,6})\s*(?:km|kilometre|kmde|binde)\b", 1), F.lit(""))
    thousands = F.nullif(F.regexp_extract(prepared, r"(?U)\b([0-9]{2,3})\s*000de\b", 1), F.lit(""))
    return F.coalesce(km.cast("int"), thousands.cast("int") * 1000)


def query_defaults(query: Column) -> tuple[Column, Column]:
    """First word of a search query is the brand, the rest the series."""
    words = F.filter(F.split(squeeze(query), " "), lambda w: w != "")
    brand = F.try_element_at(words, F.lit(1))
    series = F.nullif(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " "), F.lit(""))
    return brand, series


def training_text(text: Column) -> Column:
    """Category text for the condition model; nothing becomes an explicit unknown label."""
    composed = F.translate(compatibility_compose(text), "ţŢ", "şŞ")
    return F.coalesce(F.nullif(squeeze(composed), F.lit("")), F.lit(vocab.UNKNOWN_CATEGORY))


def total_count_on_page(html: Column) -> Column:
    """Listing total a result page prints in its heading."""
    found = F.regexp_extract(html, rf"(?iu)([0-9](?:[0-9.]|{SPACE_CLASS})*){SPACE_CLASS}+ilan{SPACE_CLASS}+bulundu", 1)
    return F.nullif(F.regexp_replace(found, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))
