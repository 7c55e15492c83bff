import json

import pytest
from conftest import rows

from curalake.operators import annotations as A
from curalake.operators import identity
from curalake.operators.violations import GateError
from curalake.plans import jobs
from curalake.sources import tables


def polygon(title, x, y, x2, y2, kind="polygon", points=4):
    corners = [[x, y], [x2, y], [x2, y2], [x, y2]][:points]
    return {"classTitle": title, "geometryType": kind, "points": {"exterior": corners}}


def parsed(spark, *documents):
    data = [(f"s/ann/{i}.jpg.json", kind, d if isinstance(d, str) else json.dumps(d)) for i, (kind, d) in enumerate(documents)]
    return tables.parse_annotations(spark.createDataFrame(data, "annotation_path string, source_kind string, document string"))


SIZE = {"width": 800, "height": 600}


@pytest.mark.parametrize("title,target", [("Scratch", "scratch"), ("Dent", "dent"), ("Corrosion", "rust")])
def test_single_damage(spark, title, target):
    found = A.crop_candidates(parsed(spark, ("damage", {"size": SIZE, "objects": [polygon(title, 200, 150, 400, 350)]}))).first()
    assert (found["class_name"], found["image_path"], tuple(found["crop_box"])) == (target, "s/img/0.jpg", (160, 110, 440, 390))


def test_overlap_panels_and_malformed(spark):
    clash = {"size": SIZE, "objects": [polygon("Scratch", 100, 100, 400, 400), polygon("Dent", 120, 120, 380, 380)]}
    same = {"size": SIZE, "objects": [polygon("Scratch", 100, 100, 400, 400), polygon(" scratch", 120, 120, 380, 380)]}
    panels = {"size": SIZE, "objects": [polygon("hood", 0, 0, 100, 100), polygon("Front-Door", 0, 0, 300, 300), polygon("glass", 0, 0, 700, 500)]}
    tie = {"size": SIZE, "objects": [polygon("Dent", 0, 0, 100, 100), polygon("Scratch", 300, 300, 400, 400)]}
    bad = [
        {"size": SIZE, "objects": [polygon("Dent", 0, 0, 200, 200, points=2)]}, {"objects": [polygon("Dent", 0, 0, 200, 200)]},
        {"size": {"width": 95, "height": 600}, "objects": [polygon("Dent", 0, 0, 200, 200)]},
        {"size": SIZE, "objects": [polygon("Dent", 0, 0, 200, 200, kind="rectangle")]}, {"size": SIZE}, '{"size":',
    ]
    rows_in = parsed(spark, ("damage", clash), ("damage", same), ("normal", panels), ("damage", tie), *[("damage", b) for b in bad])
    assert rows(A.crop_candidates(rows_in), "annotation_path", "class_name", "source_label") == [
        ("s/ann/1.jpg.json", "scratch", "Scratch"), ("s/ann/2.jpg.json", "normal", "Front-Door"), ("s/ann/3.jpg.json", "dent", "Dent"),
    ]
    status = dict(rows(A.with_objects(rows_in), "annotation_path", "status"))
    assert [status[f"s/ann/{i}.jpg.json"] for i in range(4, 10)] == [
        "no_usable_object", "missing_size", "image_too_small", "no_usable_object", "no_usable_object", "missing_size",
    ]


def test_bad_points_objects_and_sizes_are_skipped_alone(spark):
    dent = polygon("Dent", 100, 100, 300, 300)
    bad_point = polygon("Dent", 100, 100, 300, 300)
    bad_point["points"]["exterior"] = [["a", 1], ["7", "8"], [5], None, {"x": 1}, *bad_point["points"]["exterior"][:3]]
    few_points = polygon("Dent", 100, 100, 300, 300, points=2)
    few_points["points"]["exterior"].append(["a", 1])
    found = parsed(
        spark, ("damage", {"size": SIZE, "objects": [bad_point]}), ("damage", {"size": SIZE, "objects": ["note", 3, None, dent]}),
        ("damage", {"size": {"width": "800", "height": 600.0}, "objects": [dent]}), ("damage", {"size": {"width": "wide", "height": 600}, "objects": [dent]}),
        ("damage", {"size": SIZE, "objects": [few_points]}), ("damage", {"size": [800, 600], "objects": [dent]}),
        ("damage", {"size": SIZE, "objects": {"a": dent}}), ("damage", "[1]"), ("damage", ""),
    )
    status = dict(rows(A.with_objects(found), "annotation_path", "status"))
    assert [status[f"s/ann/{i}.jpg.json"] for i in range(9)] == [
        "admitted", "admitted", "admitted", "missing_size", "no_usable_object", "missing_size", "no_usable_object", "missing_size", "missing_size",
    ]
    boxes = [tuple(r["crop_box"]) for r in A.crop_candidates(found).orderBy("annotation_path").collect()]
    assert boxes == [(60, 60, 340, 340)] * 3


def test_scan_files_and_curate(spark, tmp_path):
    folder = tmp_path / "ann"
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.jpg.json").write_text(json.dumps({"size": SIZE, "objects": [polygon("Dent", 10 * i, 0, 10 * i + 60 + 20 * i, 50)]}))
    (folder / "notes.txt").write_text("x")
    found = tables.scan_annotations(spark, str(tmp_path), "damage")
    assert found.count() == 6
    candidates = A.crop_candidates(found)
    used = candidates.select("source_group").limit(1)
    sample = jobs.curate_candidates(found, [used], {"dent": 3})
    assert sample.count() == 3 and identity.exclude_groups(sample, [used]).count() == 3
    # short sides below 128 come last
    assert sample.filter("short_side < 128").count() == 0 or candidates.filter("short_side >= 128").count() < 4


def test_licensed_candidates(spark):
    listing = spark.createDataFrame(
        [(i, f"t{i}", "CC" if i % 3 else " ", "https://l") for i in (5, 1, 2, 3, 4, 7, 7)], "page_id bigint, title string, licence string, licence_url string"
    )
    used = spark.createDataFrame([("commons-1",)], "source_group string")
    assert rows(A.licensed_candidates(listing, used, 3), "page_id", "licence") == [(2, "CC (https://l)"), (4, "CC (https://l)"), (5, "CC (https://l)")]


def test_acquired_candidates_are_large_and_as_many_as_requested(spark):
    listing = spark.createDataFrame([(i, f"t{i}", "CC", "https://l") for i in range(1, 6)], "page_id bigint, title string, licence string, licence_url string")
    scan = spark.createDataFrame([("commons-1", 255), ("commons-2", 256), ("commons-3", None), ("commons-4", 900)], "source_group string, short_side int")
    assert rows(jobs.acquire_candidates(listing, None, scan, 5), "page_id", "short_side") == [(2, 256), (4, 900)]
    with pytest.raises(GateError, match="5 of 6"):
        jobs.acquire_candidates(listing, None, scan, 6)


def test_odd_polygons_keep_their_numbers(spark):
    def document(exterior, title='"Dent"'):
        return f'{{"size":{{"width":800,"height":600}},"objects":[{{"classTitle":{title},"geometryType":"polygon","points":{{"exterior":{exterior}}}}}]}}'

    found = parsed(
        spark, ("damage", document("[[1, 2], [3.5, -4], [5e1, 6]]")), ("damage", document('[["1",2],[3,4],5,[],["a\\\\\\"b",{"k":1}]]')),
        ("damage", document('[[1,"2"],[3,null],["x]","y"],[true,7]]')), ("damage", document("[[1,2]]", "1.0")), ("damage", document("[[1,2]]").replace("exterior", "\\u0065xterior")),
        ("damage", document('"[[1,2]]"')),
    )
    points = {r["annotation_path"]: r["e"] for r in found.selectExpr("annotation_path", "objects[0].points.exterior AS e").collect()}
    assert [points[f"s/ann/{i}.jpg.json"] for i in range(6)] == [
        [[1.0, 2.0], [3.5, -4.0], [50.0, 6.0]], [[None, 2.0], [3.0, 4.0], None, [], [None, None]],
        [[1.0, None], [3.0, None], [None, None], [1.0, 7.0]], [[1.0, 2.0]], [[1.0, 2.0]], None,
    ]


def test_the_text_of_an_annotation_is_made_once(spark):
    from curalake.plans import views

    plan = views.annotation_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_json(") + plan.count("StructsToJsonEvaluator") <= 2
