"""Closed forms against a plain loop over steps, and traps of the data."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import domains, values
from tidemark.operators import age, algebra, analytics, constraints, counters, extract, graph, schema, trust
from tidemark.sources import store, tables

DAY = 86400 * 1000000


def test_floored_sum(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.randint(-3, 3)) for k in range(200) for t in range(12) if rng.random() < 0.7]
    want = {}
    for k in range(200):
        s, seen = 0, False
        for t in range(12):
            d = sum(x for a, b, x in rows if (a, b) == (k, t))
            seen = seen or any((a, b) == (k, t) for a, b, _ in rows)
            s = max(0, s + d)
            if seen:
                want[k, t] = s
    out = counters.running(spark.createDataFrame(rows, "k int, step long, d long"), spark.range(12).withColumnRenamed("id", "step"), ["k"], floored=True)
    assert {(r["k"], r["step"]): r["value"] for r in out.collect()} == want


def test_boundary_event_belongs_to_next_step(spark):
    df = spark.sql("SELECT timestamp_micros(x) AS ts FROM VALUES (0L), (9L), (10L), (-1L) t(x)")
    assert [r["step"] for r in counters.assign_step(df, "ts", 0, 10).collect()] == [0, 0, 1, -1]


def test_session_gap_and_close(spark):
    two = 2 * DAY
    edits = spark.createDataFrame([("s", 0, 1), ("s", two, 2), ("s", 2 * two + 1, 3)], "statement string, us long, revision_id long").withColumn("reference", F.lit("r"))
    out = trust.sessionize(edits, two)
    assert [r["session"] for r in out.orderBy("us").collect()] == [0, 0, 1]
    closes = trust.session_close(out, two, 0, DAY)
    # last edit at 2 d: closes in the step whose end is later than 4 d, the one that begins there
    assert {r["session"]: r["step"] for r in closes.collect()} == {0: 4, 1: 6}


def test_age_expiry(spark):
    events = spark.createDataFrame([("v", 1, 0, 1, 0), ("w", 1, 0, 1, 0), ("w", 1, 5 * DAY, 2, None)], "value_id string, property_id int, us long, revision_id long, value_at long")
    spine = spark.range(100).withColumnRenamed("id", "step")
    out = {(r["value_id"], r["step"]) for r in age.active(events, spine, 0, DAY).collect()}
    # alive while written later than T - 90 d: at T = 90 d it is gone; a later event clears it once it is before T
    assert out == {("v", t) for t in range(89)} | {("w", t) for t in range(5)}


def test_discard_marks():
    assert trust.discard_steps(40, 30, 360) == [12, 24, 36]


def test_domain_fold(spark):
    rng = random.Random(2)
    rows = [(t, f"d{k}", rng.choice([-1, 1, 1])) for k in range(60) for t in range(10) if rng.random() < 0.6]
    marks, want = [3, 6], {}
    for k in range(60):
        s = c = 0
        for t in range(10):
            here = [d for a, b, d in rows if (a, b) == (t, f"d{k}")]
            s, c = s + sum(here), c + sum(d > 0 for d in here)
            if t in marks and s <= 1:
                s = c = 0
            if s or c:
                want[t, f"d{k}"] = s, c
    signed = spark.createDataFrame(rows, "step long, domain string, d long").withColumn("c", (F.col("d") > 0).cast("long"))
    out = trust.domain_counts(signed, spark.range(10).withColumnRenamed("id", "step"), marks)
    assert {(r["step"], r["domain"]): (r["count"], r["creates"]) for r in out.collect()} == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("+2013-05-01T00:00:00Z", 1367366400), ('"+2013-05-01T00:00:00Z"', 1367366400), ("+2026-00-00T00:00:00Z", None), ("+2026-07-00T00:00:00Z", None), ("2013", 1356998400), ("-0044-03-15T00:00:00Z", None), ("9999-01-01T00:00:00Z", None), ("2013-02-30T00:00:00Z", None), ("{}", None), (None, None)],
)
def test_time_values(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(F.unix_timestamp(values.parse_time_value(F.col("t"))).alias("s")).first()
    assert row["s"] == want


@pytest.mark.parametrize(("text", "want"), [("+0.98", 0.98), ("1d", None), ("1_000", 1000.0), ("inf", float("inf")), ("nan", None), ("{}", None), ('"-3"', -3.0), ("1e3", 1000.0)])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(values.coerce_numeric(F.col("t")).alias("n")).first()["n"] == want


def test_domains(spark):
    given = {
        "www.foo.com/bar": "foo.com", "https://u:p@EN.Wikipedia.org:80/x": "wikipedia.org", "http://1.2.3.4/": domains.INVALID, "http://localhost/": domains.INVALID, "http://me.blogspot.com/a": "blogspot.com",
        "http://a.b.co.uk/": "b.co.uk", "Q328": "Q328", "ISBN 978": "ISBN", "DOI:10.1": "DOI", "PMID 1": "PMID",
    }
    out = domains.with_domain(spark.createDataFrame([(k,) for k in given], "reference string"))
    assert {r["reference"]: r["domain"] for r in out.collect()} == given


def test_julian_day(spark):
    df = spark.createDataFrame([(2000, 1, 1), (-4714, 11, 24), (1970, 1, 1)], "y int, m int, d int")
    assert [r[0] for r in df.select(values.julian_day(F.col("y"), F.col("m"), F.col("d"))).collect()] == [2451545, 0, 2440588]


def test_wilson_without_observations(spark):
    low, high = values.wilson(F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(low, high).first()[:] == (0.0, 1.0)


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)], "entity_id long, class_id long")
    got = {(r["node"], r["ancestor"]) for r in constraints.closure(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b} | {(4, 1), (4, 2), (4, 3)}


def test_division_by_zero_writes_nothing(spark):
    a, b = (spark.createDataFrame([(0, 1.0), (1, 2.0)], "step long, value double"), spark.createDataFrame([(0, 0.0), (1, 4.0)], "step long, value double"))
    assert [tuple(r) for r in algebra.divide(a, b).collect()] == [(1, 0.5)]


def test_cycle_of_metrics_is_an_error():
    g = algebra.MetricGraph().add("a", lambda b: b, "b").add("b", lambda a: a, "a")
    with pytest.raises(ValueError, match="depend"):
        g.levels()


def test_flatten_skips_shape_or_and_extra():
    assert schema.flatten_schema(1, '{"type":"Schema","start":{"type":"ShapeOr","shapeExprs":[]},"shapes":[]}') == []


ENTITY, STRING, DATE = "http://www.wikidata.org/entity/", "http://www.w3.org/2001/XMLSchema#string", "http://www.w3.org/2001/XMLSchema#dateTime"


def node(**parts):
    return {"type": "NodeConstraint"} | parts


@pytest.mark.parametrize(
    ("rule", "value", "want"),
    [
        ({"type": "ShapeOr", "shapeExprs": [node(values=[ENTITY + "Q5"]), {"type": "Odd"}]}, "Q5", True),
        ({"type": "ShapeOr", "shapeExprs": [node(values=[ENTITY + "Q5"]), {"type": "Odd"}]}, "Q6", False),
        ("http://other/shape", "x", True),
        (None, 7, True),
        (node(), 7, False),  # whole numbers and lists are no values
        (node(), 7.5, True),
        (node(values=[ENTITY + "Q5"], datatype=STRING), "Q5", True),  # both must hold
        (node(values=[ENTITY + "Q5"], datatype=DATE), "Q5", False),
        (node(values=[{"type": "IriStem", "stem": ENTITY}]), "Q1", True),
        (node(values=[{"type": "IriStem", "stem": ENTITY}, ENTITY + "x"]), "x", False),  # the stem decides
        (node(values=[{"type": "IriStem", "stem": "http://elsewhere/"}, ENTITY + "x"]), "x", True),  # an unknown one doesn't
        (node(values=[{"type": "IriStem", "stem": "http://commons.wikimedia.org/wiki/Special:FilePath"}]), "a.jpg", True),
        (node(values=[{"type": "Language", "languageTag": "en"}]), "text", True),
        (node(values=[{"type": "Language", "languageTag": "de"}, {"type": "Language", "languageTag": "en"}]), "text", False),
        (node(datatype=DATE), "+2024-01-05T00:00:00Z", True),
        (node(datatype=DATE), "2024-01-05", True),
        (node(datatype=DATE), "+2024-00-00T00:00:00Z", False),
        (node(datatype="http://www.w3.org/2001/XMLSchema#decimal"), "+12.5", True),
        (node(datatype="http://www.w3.org/2001/XMLSchema#decimal"), "Q12", False),
        (node(datatype="http://www.opengis.net/ont/geosparql#wktLiteral"), {"longitude": 1.5, "latitude": 2}, True),
        (node(datatype="http://www.opengis.net/ont/geosparql#wktLiteral"), {"longitude": "1", "latitude": 2}, False),
        ({"type": "TripleConstraint", "predicate": "http://www.wikidata.org/prop/direct/P31", "valueExpr": node(values=[])}, "x", False),
        ({"type": "TripleConstraint", "predicate": "http://www.wikidata.org/prop/direct/P32", "valueExpr": node(values=[])}, "x", True),  # of another property
        ({"type": "Shape", "expression": {"type": "EachOf", "expressions": [node(datatype=STRING), node(datatype=DATE)]}}, "x", False),
        ({"type": "ShapeAnd", "shapeExprs": [node(datatype=STRING), "http://other/shape"]}, "x", True),
        ({"type": "Shape"}, "x", True),
    ],
)
def test_compliance_nodes(rule, value, want):
    assert schema.complies(rule, value, 31) == want


def test_wilson_with_an_uneven_exposure(spark):
    """Three domains by hand: one with most of the mass and few creations has its bar raised, one without mass counts as 0."""
    flow = spark.createDataFrame([(0, "old", 40, 10), (0, "new", 5, 45), (0, "gone", 30, 0)], "step long, domain string, out_weight long, in_weight long")
    mass = spark.createDataFrame([(0, "old", 900.0), (0, "new", 100.0)], "step long, domain string, mass double")
    creates = spark.createDataFrame([(0, "old", 100), (0, "new", 300)], "step long, domain string, creates long")
    got = {r["domain"]: r for r in trust.flow_wilson(flow, mass, creates).collect()}
    assert got["old"]["p0"] == pytest.approx((0.9 + 1 / 3) / (0.9 + 1 / 3 + 0.25 + 1 / 3)) and got["gone"]["p0"] == pytest.approx(0.5)
    tilted = 0.7 / 0.3 * got["old"]["p0"] / (1 - got["old"]["p0"])
    assert got["old"]["bar"] == pytest.approx(tilted / (1 + tilted)) and got["new"]["bar"] == got["gone"]["bar"] == 0.7
    assert got["old"]["deff"] == pytest.approx(1 + math.log1p(0.9)) and got["gone"]["deff"] == 1
    assert {d: r["class"] for d, r in got.items()} == {"old": "contested", "new": "dominating", "gone": "dominated"}


def test_class_values(spark):
    mass = spark.createDataFrame([(0, d, float(9 - k)) for k, d in enumerate("abcd")], "step long, domain string, mass double")
    classes = spark.createDataFrame([(0, "a", 9.0, "dominated"), (0, "b", 8.0, "contested"), (0, "c", 7.0, "dominating")], "step long, domain string, mass double, class string")
    assert [r["class_value"] for r in trust.top_classes(classes, mass).orderBy("rank").collect()] == [-1, 0, 1, 2]


def test_missing_series_is_an_error(spark):
    rows = spark.createDataFrame([(1, "m", 0, 1.0)], "run_id int, metric string, step long, value double")
    with pytest.raises(KeyError):
        analytics.fetch_series(rows, 1, ["m", "other"])


def test_nearest_breaks_ties_to_the_earlier(spark):
    rows = spark.createDataFrame([(1, 1.0), (3, 3.0)], "step int, value double")
    out = analytics.nearest(rows, spark.createDataFrame([(2,), (9,)], "target int"), 1)
    assert [(r["target"], r["step"]) for r in out.collect()] == [(2, 1)]


def test_paths_back(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("a", "c", 1), ("c", "d", 1)], "src string, dst string, weight long")
    assert {r["domain"]: r["class"] for r in graph.degree_with_path(e).collect()} == {"a": "dominated", "b": "contested", "c": "dominated", "d": "dominating"}


def test_unchanged_revision_is_not_stored(spark):
    text = '{"claims":{},"labels":{"en":{"value":"%s"}}}'
    rows = [(1, 1, False, text % "a"), (1, 2, False, text % "a"), (1, 3, True, text % "b"), (1, 4, False, "{broken"), (1, 5, False, text % "c")]
    df = spark.createDataFrame(rows, "entity_id long, revision_id long, deleted boolean, text string").withColumn("ts", F.timestamp_seconds("revision_id"))
    out = extract.changes(df).where("kind = 'revision'").orderBy("revision_id").collect()
    assert [(r["revision_id"], r["prev_revision_id"]) for r in out] == [(1, None), (5, 1)]


def test_import_refuses_changed_rows(spark, tmp_path):
    st = store.ResultStore(spark, f"file://{tmp_path}/a")
    rows = spark.sql("SELECT timestamp'2024-01-01' AS step_end, 1.0D AS value")
    st.write(store.series(rows, 1, "m"))
    store.export_run(st, 1, f"file://{tmp_path}/x")
    other = store.ResultStore(spark, f"file://{tmp_path}/b")
    assert store.import_run(other, f"file://{tmp_path}/x", dry_run=True) == "checked"
    assert store.import_run(other, f"file://{tmp_path}/x") == "imported"
    assert store.import_run(other, f"file://{tmp_path}/x") == "skipped"
    store.series(rows.withColumn("value", F.lit(2.0)), 1, "m").write.mode("overwrite").parquet(f"file://{tmp_path}/x/series")
    with pytest.raises(ValueError, match="manifest"):
        store.import_run(other, f"file://{tmp_path}/x", replace=True)


def test_upsert_keeps_the_new(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in tables.upsert(a, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c")}


def slow_spikes(y, width, threshold, limit, reserved):
    fine, found, kept = [v is not None and math.isfinite(v) for v in y], [], []
    known = [v for v, f in zip(y, fine, strict=True) if f]
    for i in range(1, len(y) - 1):
        sides = [[y[j] for j in r if fine[j]] for r in (range(max(0, i - width), i), range(i + 1, min(len(y), i + width + 1)))]
        if fine[i] and all(sides):
            up, down = y[i] - max(map(min, sides)), min(map(max, sides)) - y[i]
            most = max(up, down)
            if most > 0 and most >= threshold * (max(known) - min(known)):
                found.append((most, abs(y[i]), i, 1 if up >= down else -1))
    for most, _, i, way in sorted(found, reverse=True):
        if (reserved is None or abs(i - reserved) > width) and all(abs(i - j) > width for j, _, _ in kept):
            kept.append((i, most, way))
            if len(kept) >= limit:
                break
    return set(kept)


@pytest.mark.parametrize("limit, reserved", [(10**6, None), (2, None), (3, 5)])
def test_spikes(spark, limit, reserved):
    rng = random.Random(3)
    series = {f"m{k}": [rng.choice([0.0, 1.0, -3.0, 4.0, 4.5, float(k), None, float("nan"), float("inf")][: 9 if k % 2 else 6]) for _ in range(k)] for k in range(40)}
    series |= {"drop": [5.0, 5.0, 5.0, 0.0, 5.0, 5.0, 5.0], "ends": [9.0, 1.0, 1.0, 1.0, 9.0]}
    rows = [(m, 10 * step, v) for m, y in series.items() for step, v in enumerate(y)]
    got = analytics.spikes(spark.createDataFrame(rows, "metric string, step long, value double"), 2, 0.2, limit=limit, reserved=reserved).collect()
    want = {(m, 10 * i, most, way) for m, y in series.items() for i, most, way in slow_spikes(y, 2, 0.2, limit, reserved)}
    assert {(r["metric"], r["step"], r["prominence"], r["direction"]) for r in got} == want
    assert reserved == 5 or ("drop", 30, 5.0, -1) in want


def test_replacements_against_a_loop(spark):
    """Each statement by itself: an edit takes the first open one of the other sign that is at most a day old."""
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(12)}", rng.randrange(4 * DAY), k, rng.choice([-1, 1]), f"d{rng.randrange(4)}") for k in range(300)]
    want: dict = {}
    for name in {r[0] for r in rows}:
        edits = sorted((r[1], r[2], r[3], r[4]) for r in rows if r[0] == name)
        used: set = set()
        for us, i, sign, domain in edits:
            mate = next(((u, j, g, o) for u, j, g, o in edits if (u, j) < (us, i) and j not in used and g == -sign and us - u <= DAY), None)
            if mate is None:
                continue
            used |= {i, mate[1]}
            pair = (domain, mate[3]) if sign < 0 else (mate[3], domain)
            if pair[0] != pair[1]:
                want[pair] = want.get(pair, 0) + 1
    got = graph.replacements(spark.createDataFrame(rows, "statement string, us long, revision_id long, sign int, domain string"), DAY).collect()
    assert {(r["src"], r["dst"]): r["weight"] for r in got} == want and len(want) > 5


def test_light_vertices_become_one(spark):
    edges = spark.createDataFrame([("a", "x", 2), ("a", "y", 3), ("x", "y", 5), ("x", "a", 7), ("a", "b", 1)], "src string, dst string, weight long")
    mass = spark.createDataFrame([("a", 9.0), ("b", 9.0), ("x", 1.0)], "domain string, mass double")
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.contracted(edges, mass, 3, 4, "*").collect()}
    assert got == {("a", "*"): 5, ("*", "*"): 5, ("*", "a"): 7, ("a", "b"): 1}
    assert graph.contracted(edges, mass, 3, 5).count() == 5


def test_csv_series(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp,a,b\n2024-01-02 00:00:00,1,\n2024-01-01T00:00:00+00:00,,\n")
    got = {(r["series"], str(r["timestamp"])[:10]): r["value"] for r in tables.csv_series(spark, f"file://{tmp_path}/s.csv", ["a"]).collect()}
    assert got == {("a", "2024-01-02"): 1.0, ("a", "2024-01-01"): None}
    for columns, what in ((["c"], "lacks"), (["b"], "no data")):
        with pytest.raises(ValueError, match=what):
            tables.csv_series(spark, f"file://{tmp_path}/s.csv", columns)


def test_attached_database(spark, tmp_path):
    """A table of an external database, in ranges of its key; the embedded database that Spark ships stands for it."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(50).select(F.col("id").alias("ID"), (F.col("id") * 2).alias("V"))
    rows.write.jdbc(url, "T", properties={"driver": driver})
    got = tables.attach_jdbc(spark, url, "T", "ID", [0, 10, 40], driver=driver)
    assert got.rdd.getNumPartitions() == 2 and sorted(map(tuple, got.collect())) == [(k, 2 * k) for k in range(40)]


@pytest.mark.parametrize("text", ["{}", '{"a": 1}', "Q5", '"Q5"', "22", "", None])
def test_stored_values(text):
    assert schema.read_value(text) == {"{}": {}, '{"a": 1}': {"a": 1}, '"Q5"': "Q5"}.get(text, text)
