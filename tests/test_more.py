import datetime as dt
import random

from sparkloom.functions import more


def test_hll_within_its_error():
    s = more.hll_create.plain(12)
    for k in range(5000):
        s = more.hll_add.plain(s, f"v{k % 2000}")
    assert abs(more.hll_count.plain(s) - 2000) < 2000 * 4 * more.hll_error.plain(s)
    assert more.hll_merge.plain(s, s) == s


def test_bloom_has_no_false_negative():
    s = more.bloom_create.plain(500, 0.01)
    for k in range(500):
        s = more.bloom_add.plain(s, str(k))
    assert all(more.bloom_contains.plain(s, str(k)) for k in range(500))
    assert sum(more.bloom_contains.plain(s, f"x{k}") for k in range(2000)) < 60
    assert more.bloom_false_positive_rate.plain(s) < 0.03


def test_count_min_never_under_counts():
    s, r = more.cms_create.plain(64, 4), random.Random(1)
    true = {}
    for _ in range(500):
        k = str(r.randint(0, 40))
        true[k] = true.get(k, 0) + 1
        s = more.cms_add.plain(s, k, 1)
    assert all(more.cms_estimate.plain(s, k) >= n for k, n in true.items())
    assert more.cms_estimate.plain(more.cms_merge.plain(s, s), "1") == 2 * more.cms_estimate.plain(s, "1")


def test_tdigest_quantiles():
    s = more.tdigest_create.plain(100)
    for k in range(2000):
        s = more.tdigest_add.plain(s, (k * 7919) % 2000)
    assert abs(more.tdigest_quantile.plain(s, 0.5) - 1000) < 40 and abs(more.tdigest_quantile.plain(s, 0.99) - 1980) < 20
    assert abs(more.tdigest_cdf.plain(s, 500.0) - 0.25) < 0.02


def test_geometry_text():
    poly = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"
    assert more.st_geom_from_geojson.plain(more.st_as_geojson.plain(poly)) == poly
    assert more.st_centroid.plain(poly) == "POINT(2 2)"
    assert more.st_centroid.plain("LINESTRING(0 0, 2 0)") == "POINT(1 0)"
    assert more.st_buffer.plain("POINT(1 1)", 2.0).startswith("POLYGON((3 1,")


def test_names_and_phonetics():
    assert more.nysiis.plain("KNIGHT") == more.nysiis.plain("NIGHT")
    assert more.company_similarity.plain("Acme Inc.", "The ACME Company") == 1
    assert more.name_similarity.plain("Ann Lee", "Lee, Ann") == 1
    assert more.address_similarity.plain("12 N Main St", "12 North Main Street") == 1


def test_documents():
    assert more.markdown_to_html.plain("# T\n\n- a\n- *b*\n\ntext `x` [l](u)") == '<h1>T</h1>\n<ul><li>a</li><li><em>b</em></li></ul>\n<p>text <code>x</code> <a href="u">l</a></p>'
    assert more.html_to_text.plain("<p>a &amp; b</p><script>no</script><div>c</div>") == "a & b\nc"
    assert more.detect_mime_type.plain(b"%PDF-1.7") == "application/pdf"


def test_natural_dates():
    ref = dt.date(2024, 3, 31)
    parse = lambda t: more.parse_natural_date.plain(t, ref)
    assert parse("tomorrow") == dt.date(2024, 4, 1) and parse("1 month ago") == dt.date(2024, 2, 29) and parse("next sunday") == dt.date(2024, 4, 7)
    assert parse("in 2 weeks") == dt.date(2024, 4, 14) and parse("rubbish") is None
    assert more.parse_natural_duration.plain("1 hour 30 minutes") == 5400 and more.parse_natural_duration.plain("2d 4h") == 187200 and more.parse_natural_duration.plain("soon") is None
