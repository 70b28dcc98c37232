"""Column text rules against plain Python twins."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pricelens.functions import dates, text as tx, vocabulary as vocab
from pricelens.functions.folding import casefold, casefold_table

WORDS = [
    "Boyasız", "BOYASIZ", "Değişensiz", "Iğdır", "İstanbul", "Türk Lirası", "straße", "½ price", "１２３", "ﬁat", "NİSAN", "a—b…c",
    "𝐀bc", "Σας", "Şanlıurfa", "x y", "ĳ", "Ａ＇b", "", "ß", "plain ABC-12", "㎏ ℻", "日本 car",
]


def python_slug(text: str) -> str:
    ascii_text = unicodedata.normalize("NFKD", text.strip().casefold()).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", "-", ascii_text).strip("-")


def column(spark, values, *expressions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, w string")
    named = [e(F.col("w")).alias(f"c{n}") for n, e in enumerate(expressions)]
    return [tuple(r)[1:] for r in df.select("i", *named).orderBy("i").collect()]


def test_keys_match_python(spark):
    got = column(spark, WORDS, tx.normalize_key, tx.slugify, casefold)
    assert got == [(vocab.python_key(w), python_slug(w), w.casefold()) for w in WORDS]


def test_dotless_i_hides_a_lower_case_claim(spark):
    claims = column(spark, ["Boyasız", "BOYASIZ", "DEGISENSIZ TRAMERSIZ", "Degisensiz"],
                    lambda c: tx.claim_from_title(c)["paint_status"], lambda c: tx.claim_from_title(c)["changed_part_status"], lambda c: tx.claim_from_title(c)["damage_status"])
    assert claims == [(None, None, None), ("Boyasız", None, "clean_claimed_from_title"), (None, "Değişensiz", "clean_claimed_from_title"), (None, "Değişensiz", None)]


@pytest.mark.parametrize("raw, cleaned", [
    ("  a  b ", "a b"), ("None", None), ("--", None), (None, None), ("Tofas", "Tofaş"), ("a–b​", "a-b"), ("Mercedes - Benz", "Mercedes-Benz"),
])
def test_clean_text(spark, raw, cleaned):
    assert column(spark, [raw], tx.clean_text) == [(cleaned,)]


def test_numbers_lose_sign_and_point(spark):
    assert column(spark, ["-5", "12.5", "1.250 TL", "none", None], tx.normalize_int) == [(5,), (125,), (1250,), (None,), (None,)]


def test_choices_and_currency(spark):
    assert column(spark, ["OTOMATIK", "Yarı Otomatik", "düz", None], lambda c: tx.normalize_choice(c, vocab.TRANSMISSION)) == [("Otomatik",), ("Yarı Otomatik",), ("Manuel",), (None,)]
    assert column(spark, ["tl", "usd", "Türk Lirası", None], tx.normalize_currency) == [("TRY",), ("USD",), ("TÜRK LIRASI",), ("TRY",)]


def test_package_spelling(spark):
    assert column(spark, ["1.6 tdi/bluemotion", "blue hdi 1.5", " gTi  amg ", "AMG+"], tx.normalize_package) == [("1.6 TDI / BlueMotion",), ("BlueHDi 1.5",), ("GTI AMG",), ("AMG+",)]


def test_locations(spark):
    cases = {
        ("Ankara Çankaya", None): ("Ankara", "Çankaya"), ("Afyon", "Merkez"): ("Afyonkarahisar", "Merkez"), ("Içel", None): ("Mersin", None),
        ("İstanbul", "İstanbul"): ("İstanbul", None), ("Ankara", "Ankara Keçiören"): ("Ankara", "Keçiören"), (None, "Ankara Keçiören"): (None, "Keçiören"),
        ("Foo Bar", "X"): ("Foo Bar", None), (None, None): (None, None),
    }
    df = spark.createDataFrame(list(cases), "a string, b string")
    city, district = tx.normalize_location(F.col("a"), F.col("b"))
    assert {(r.a, r.b): (r.c, r.d) for r in df.select("a", "b", city.alias("c"), district.alias("d")).collect()} == cases


def test_every_expanding_letter(spark):
    letters = [c for c, _ in casefold_table().expansions]
    assert not set(letters) & set("".join(folded for _, folded in casefold_table().expansions))
    words = [*letters, "A".join(letters), "".join(reversed(letters)) + "İ日本", "ß" * 5000]
    assert column(spark, words, casefold) == [(w.casefold(),) for w in words]


def test_title_hints(spark):
    titles = ["2015 model 120.000 km", "15 model", "98 mdl", "temiz 95 binde", "100.ooo km", "1949"]
    assert column(spark, titles, tx.year_from_title, tx.mileage_from_title) == [(2015, 120000), (2015, None), (None, None), (None, 95000), (None, 100000), (None, None)]


def test_dates_of_both_flavours(spark):
    values = ["Bugün", "dün", "1 Temmuz 2026", "31 Şubat 2026", "5 NİSAN 2026", "02/03/2026", "2026-07-01", "Bugün 10:00", "x"]
    got = column(spark, values, lambda c: dates.listing_date(c, "2026-07-10").cast("string"), lambda c: dates.ingest_date(c, "2026-07-10").cast("string"))
    assert got == [
        ("2026-07-10", "2026-07-10"), ("2026-07-09", "2026-07-09"), ("2026-07-01", "2026-07-01"), (None, None), (None, None), ("2026-03-02", None),
        ("2026-07-01", None), (None, "2026-07-10"), (None, None),
    ]


def test_cosmetic_key_keeps_plus(spark):
    assert column(spark, ["200 AMG", "200-amg", "200 AMG+"], tx.cosmetic_key) == [("200amg",), ("200amg",), ("200amg+",)]


def test_training_text(spark):
    assert column(spark, [None, "  Tofaţ  ", "a  b"], tx.training_text) == [("Bilinmiyor",), ("Tofaş",), ("a b",)]


def test_page_place(spark):
    got = column(spark, ["Ankara / Çankaya", "Ankara  Kızılay", "Ankara Çankaya Merkez", "izmir", None], lambda c: tx.split_page_location(c)[0], lambda c: tx.split_page_location(c)[1])
    assert got == [("Ankara", "Çankaya"), ("Ankara", "Kızılay"), ("Ankara", "Çankaya Merkez"), ("izmir", None), (None, None)]


def test_plain_text_is_not_rewritten_differently(spark):
    """The short way for ASCII text with lone spaces gives what the whole rule gives."""
    texts = ["a b", " a  b ", "a\tb", "\x1fa", "a b", " null ", "NaN", "--", "a – b", "Kull", "", "  ", None, "x" * 50 + "  ", "İ", "a​b", "Tofas", "a\r\nb c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = tx._squeeze_all(F.translate(F.col("t"), " –—­​﻿", " --"))
    kept = F.when((whole == "") | F.lower(whole).isin(*tx.vocab.NULL_WORDS), F.lit(None)).otherwise(whole)
    rows = df.select("t", tx.squeeze(F.col("t")).alias("a"), tx._squeeze_all(F.col("t")).alias("b"), tx.clean_text(F.col("t")).alias("c"), F.coalesce(tx.lookup(kept, tx.vocab.TEXT_FIXES), kept).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows) and len(rows) == len(texts)
