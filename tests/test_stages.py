"""Stages: reuse by content, versions, reports without building, the entries of a run, resumable folds."""

import random

import pytest
from pyspark.sql import functions as F

from cohortloom.plans.folds import FoldStage
from cohortloom.plans.stages import CohortRun, Stage, StageGraph
from cohortloom.plans.store import StageStore, same_rows


def test_a_reader_meets_whole_tables(spark, tmp_path):
    """A table that is read stays while others are written over it; unchanged rows swap nothing."""
    store = StageStore(spark, str(tmp_path))
    rows = lambda n: spark.range(n).withColumn("v", F.lit(n))
    assert store.put("t", rows(5), "a")
    first = store.status("t")
    reader = store.read("t")
    assert store.put("t", rows(7), "a") and store.status("t")["path"] != first["path"]
    assert reader.count() == 5 and {r.v for r in reader.collect()} == {5}  # the old version, whole
    assert store.read("t").count() == 7
    now = store.status("t")
    assert not store.put("t", rows(7).orderBy(F.desc("id")), "a") and store.status("t") == now
    assert not store.put("t", rows(7), "b") and store.status("t") == now | {"inputs": "b"}  # known to be good for other inputs too
    assert store.put("t", rows(8), "b") and store.status("t")["version"] == 3
    with pytest.raises(Exception):  # noqa: B017  two versions back
        spark.read.parquet(first["path"]).count()
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 2


def test_a_failed_build_leaves_the_table(spark, tmp_path):
    store = StageStore(spark, str(tmp_path))
    store.put("t", spark.range(3), "a")
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        store.put("t", broken, "b")
    assert store.read("t").count() == 3 and store.status("t")["inputs"] == "a"


def test_graph(spark, tmp_path):
    store, ran = StageStore(spark, str(tmp_path)), []

    def stage(name, inputs, build, **more):
        return Stage(name, inputs, lambda *t: (ran.append(name), build(*t))[1], **more)

    def graph(n, factor=2, required=frozenset({"y"})):
        stages = [
            stage("halved", ("numbers",), lambda t: t.select((F.col("id") / 2).cast("long").alias("h")).distinct()),
            stage("scaled", ("halved",), lambda t: t.select((F.col("h") * factor).alias("y")), parameters={"factor": factor}, required=required),
            stage("alone", ("other",), lambda t: t),
        ]
        return StageGraph(store, {"numbers": spark.range(n), "other": spark.range(2)}, stages)

    g = graph(9)
    assert g.report()["scaled"] == {"reusable": False, "reason": "halved is not reusable"} and not ran
    assert g.run("scaled")["scaled"].count() == 5 and ran == g.built == ["halved", "scaled"]
    g = graph(9)
    assert g.report("scaled") == {"halved": {"reusable": True, "reason": ""}, "scaled": {"reusable": True, "reason": ""}}
    g.run("scaled")
    assert ran == ["halved", "scaled"] and g.reused == ["halved", "scaled"]
    graph(10).run("scaled")  # other numbers, the same halves
    assert ran == ["halved", "scaled", "halved"]
    graph(10, 3).run("scaled")
    assert ran[3:] == ["scaled"]
    graph(10, 3).run("scaled", force=["scaled"])
    assert ran[4:] == ["scaled"]
    assert "columns are missing: z" in graph(10, 3, frozenset({"y", "z"})).report("scaled")["scaled"]["reason"]
    with pytest.raises(ValueError, match="lacks z"):
        graph(10, 3, frozenset({"y", "z"})).run("scaled")
    status = graph(10).status()
    assert status["scaled"]["there"] and not status["alone"]["there"]
    with pytest.raises(ValueError, match="no stage"):
        graph(10).run("nothing")
    with pytest.raises(ValueError, match="reads nothing"):
        StageGraph(store, {}, [Stage("s", ("nothing",), lambda t: t)])


@pytest.fixture
def run_of(spark, sf, tmp_path):
    """A run over the driver's embeddings in the role of images."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = lambda k: F.get("embedding", F.lit(k)).cast("double")
    label = F.col("label") % 2
    items = e.select(
        F.col("vec_id").cast("long").alias("item"), F.concat_ws("-", label, F.col("vec_id") % 7).alias("subject"), F.concat_ws("/", label, F.col("vec_id") % 14).alias("series"), F.concat_ws("/", label, F.col("vec_id") % 28).alias("sequence"), label.alias("label"), F.col("vec_id").alias("ts"),
        (F.abs(n(4)) * 100 + 5).alias("sharpness"), (F.abs(n(5)) / 10).alias("noise"), (F.abs(n(6)) * 200 + 20).alias("spread"), F.xxhash64("vec_id").alias("hash"), (F.abs(n(0)) / 4 + 0.01).alias("area"), n(1).alias("centroid_x"), n(2).alias("centroid_y"), F.abs(n(3)).alias("boundary"), ((F.col("vec_id") % 10) / 9).alias("position"), (F.col("vec_id") % 2).alias("family"),
    )
    marks = items.where("item % 3 = 0").select("item", F.lit("HEART_PRESENT").alias("target_type"), F.lit(0.2).alias("mask_area"), F.lit(True).alias("found"))
    predictions = items.select("item", F.lit(1).alias("valid"), F.lit(1).alias("present"))
    regions = F.explode(F.array(*map(F.lit, ("full", "attention", "attention_complement", "manual", "manual_complement")))).alias("region")
    vectors = e.select(F.col("vec_id").cast("long").alias("item"), "embedding", regions).select("item", "region", F.transform("embedding", lambda x: x.cast("double") * F.length("region")).alias("vector"))

    def make(marks=marks, predictions=predictions):
        return CohortRun(StageStore(spark, str(tmp_path)), items, marks, predictions, vectors, draws=40, folds=3)

    return make, marks, predictions


def test_entries_of_a_run(run_of):
    make, marks, predictions = run_of
    first = make()
    assert not any(x["reusable"] for x in first.persistence_status().values())
    got = first.prepare()
    assert got["status"] == "prepare_complete" and got["built"] == ["manifest", "quality", "target_audit"] and got["images"] == 500 and got["accepted_targets"] > 20
    with pytest.raises(ValueError, match="no prediction"):
        make(predictions=predictions.where("item > 5")).finalize()
    done = make().finalize("evaluate")
    assert done["status"] == "complete" and done["built"] == ["matching", "feature_bank", "oof_scores", "results", "comparisons"]
    assert done["tables"]["results"].count() == 11 and done["tables"]["comparisons"].count() == 12
    again = make()
    assert all(x == {"reusable": True, "reason": ""} for x in again.persistence_status().values())
    assert again.prepare()["built"] == [] and again.finalize("evaluate")["built"] == []
    assert make().status()["last_stage"]["stage"] == "evaluate" and make().finalize("status")["status"]["results"]["rows"] == 11
    other = make(marks=marks.where("item % 2 = 0"))  # the quality audit and the matching don't read them
    told = other.persistence_status()
    assert told["matching"]["reusable"] and told["target_audit"]["reason"] == "inputs or parameters have changed" and told["results"]["reason"] == "oof_scores is not reusable"
    assert make().finalize("matching", force=["matching"])["built"] == ["matching"]
    with pytest.raises(ValueError, match="action"):
        make().finalize("train")


def test_folds_are_resumed(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, k % 3, rng.random(), k % 2 if k % 4 else None) for k in range(60)]
    df = lambda r: spark.createDataFrame(r, "item long, fold int, x double, y int")
    fit = lambda t: t.groupBy("y").agg(F.round(F.avg("x"), 9).alias("centre"))

    def predict(model, part):
        near = part.drop("y").crossJoin(F.broadcast(model)).groupBy("item").agg(F.min_by("y", F.abs(F.col("x") - F.col("centre"))).alias("guess"))
        return part.select("item").join(near, "item")

    def run(rows, **force):
        stage = FoldStage(StageStore(spark, str(tmp_path)), fit, predict, "item", folds=3)
        out = stage.run(df(rows), df(rows).where("y IS NOT NULL"), **force)
        assert out.count() == len(rows)
        return stage, {r.item: r.guess for r in out.collect()}

    stage, guess = run(rows)
    assert (stage.fitted, stage.computed, stage.reused) == ([0, 1, 2], [0, 1, 2], []) and stage.status()["parts_complete"]
    for k in range(3):
        train = [r for r in rows if r[1] != k and r[3] is not None]
        centre = {y: round(sum(r[2] for r in train if r[3] == y) / sum(r[3] == y for r in train), 9) for y in (0, 1)}
        assert all(guess[r[0]] == min(centre, key=lambda y: abs(r[2] - centre[y])) for r in rows if r[1] == k)
    stage, again = run(rows)
    assert (stage.fitted, stage.computed) == ([], []) and again == guess
    moved = [r if r[0] != 4 else (4, r[1], 0.999, None) for r in rows]  # fold 1, no target
    stage, _ = run(moved)
    assert (stage.fitted, stage.computed, stage.reused) == ([], [1], [0, 2])
    told = [r if r[0] != 5 else (5, r[1], 0.999, 1) for r in moved]  # fold 2 has another target: the other folds' models change
    stage, _ = run(told)
    assert (stage.fitted, stage.computed) == ([0, 1], [0, 1, 2])
    stage, _ = run(told, force_training=[2])
    assert (stage.fitted, stage.computed) == ([2], [])  # the same model by content
    stage, _ = run(told, force_prediction=[0])
    assert (stage.fitted, stage.computed) == ([], [0])
    with pytest.raises(ValueError, match="predictions"):
        FoldStage(StageStore(spark, str(tmp_path / "x")), fit, lambda m, p: predict(m, p).where("item <> 7"), "item", folds=3).run(df(rows), df(rows).where("y IS NOT NULL"))
    assert same_rows(df(rows), df(rows))
