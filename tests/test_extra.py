import datetime as dt

from pyspark.sql import functions as F

from sparkloom.functions import bits, extra, numeric, registry, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_colours(spark):
    red = bits.color_from_hex(F.lit("#ff0000"))
    assert one(spark, bits.color_to_hex(extra.color_palette(red, "complementary")[1])) == "#00ffff"
    assert tuple(one(spark, extra.color_to_hsl(red))) == (0.0, 1.0, 0.5)
    assert one(spark, bits.color_to_hex(extra.color_darken(red, F.lit(0.25)))) == "#800000"


def test_schemas():
    schema = '{"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": false}'
    assert extra.json_schema_errors.plain('{"a": 3, "b": ["x"]}', schema) == []
    assert len(extra.json_schema_errors.plain('{"a": 1, "b": [1], "c": 0}', schema)) == 3


def test_patch_undoes_diff():
    a, b = "one\ntwo\nthree\nfour\nfive\nsix\nseven", "one\n2\nthree\nfour\nfive\nsix\nseven\neight"
    assert extra.text_patch.plain(a, text.text_diff.plain(a, b)) == b


def test_finance():
    assert round(extra.bond_yield.plain(1000.0, 0.05, 1081.1089, 10), 5) == 0.04
    assert round(extra.xirr.plain([0, 365], [-100.0, 110.0]), 6) == 0.1
    assert round(sum(extra.depreciation_db.plain(1000.0, 100.0, 5, k) for k in range(1, 6)), 6) == 900


def test_cron_lists():
    at = dt.datetime(2024, 1, 1)
    assert extra.cron_list.plain("0 0 1 * *", at, 2) == [dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)]
    assert len(extra.cron_between.plain("0 * * * *", at, dt.datetime(2024, 1, 2))) == 23
    assert extra.cron_parse.plain("a b c d e") is False


def test_quantities_and_money(spark):
    a, b = extra.quantity_create(F.lit(1), "km"), extra.quantity_create(F.lit(500), "m")
    assert one(spark, extra.quantity_add(a, b))[0] == 1.5
    assert one(spark, extra.money_format(numeric.money_create(F.lit(1234.5), F.lit("EUR")))) == "€1,234.50"
    assert one(spark, extra.currency_by_numeric(F.lit(978))) == "EUR"


def test_others(spark):
    assert one(spark, extra.isbn_to_13(F.lit("0-306-40615-2"))) == "9780306406157"
    assert one(spark, extra.qgram_distance(F.lit("abc"), F.lit("abd"), 2)) == 2
    assert one(spark, extra.time_bucket_calendar(3, F.lit("2024-05-20").cast("date"))) == dt.date(2024, 4, 1)
    assert one(spark, extra.format_duration(F.lit(93784.0))) == "1d 2h 3m 4s"
    assert tuple(one(spark, extra.regex_find(F.lit("abc123"), "[0-9]+"))) == (3, 6)
    rows = F.array(F.struct(F.lit(1).alias("ancestor"), F.lit(1).alias("descendant"), F.lit(0).alias("depth")))
    assert one(spark, extra.closure_table_ancestors(extra.closure_table_insert(rows, F.lit(2), F.lit(1)), F.lit(2))) == [1]


def test_registry_names_are_functions():
    found = registry.functions()
    assert len(found) > 380 and all(map(callable, found.values()))


def test_metaphone():
    got = {w: extra.metaphone.plain(w) for w in ("Knight", "Philip", "Thumb", "Nation", "Judge", "Xavier")}
    assert got == {"Knight": "NT", "Philip": "FLP", "Thumb": "0M", "Nation": "NXN", "Judge": "JJ", "Xavier": "SFR"}
