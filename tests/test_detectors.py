import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import anomalies as A
from packetloom.operators import autoencoder as AE
from packetloom.operators import detect as D
from packetloom.operators import forest as FO


@pytest.fixture(scope="module")
def matrices(spark):
    def table(x, prefix):
        rows = [("c", f"{prefix}{i}", *map(float, r)) for i, r in enumerate(x)]
        return spark.createDataFrame(rows, "capture_id string, flow_id string, " + ", ".join(f"{f} double" for f in A.FEATURES))

    normal = np.random.default_rng(42).normal(0.5, 0.1, (1000, 13))
    odd = np.random.default_rng(99).normal(5.0, 1.0, (20, 13))
    return table(normal, "n").repartition(4).cache(), table(odd, "o").cache()


@pytest.fixture(scope="module")
def forest(matrices):
    return FO.fit_forest(matrices[0], ["flow_id"], trees=60)


@pytest.fixture(scope="module")
def network(matrices):
    return AE.fit_autoencoder(matrices[0], epochs=12, partitions=2, ids=["flow_id"])


def test_forest(spark, matrices, forest, tmp_path):
    normal, odd = matrices
    assert forest.nodes["tree"].nunique() == 60 and (forest.nodes.groupby("tree")["size"].max() == 256).all()
    assert len(forest.nodes) <= 60 * 511
    scored = FO.score_forest(odd, forest).collect()
    assert all(r["is_anomaly"] and 0 <= r["score"] <= 1 for r in scored)
    share = FO.score_forest(normal, forest).agg(F.avg(F.col("is_anomaly").cast("int"))).first()[0]
    assert share == pytest.approx(0.05, abs=0.005)
    FO.save_forest(spark, forest, str(tmp_path / "f"))
    again = FO.score_forest(odd, FO.load_forest(spark, str(tmp_path / "f"))).orderBy("flow_id").collect()
    assert [r["score"] for r in again] == [r["score"] for r in sorted(scored, key=lambda r: r["flow_id"])]
    with pytest.raises(RuntimeError):
        FO.score_forest(odd, None)


def test_forest_is_repeatable(matrices, forest):
    again = FO.fit_forest(matrices[0].repartition(7), ["flow_id"], trees=60)
    assert again.offset == pytest.approx(forest.offset) and again.nodes["split"].sum() == pytest.approx(forest.nodes["split"].sum())


def test_autoencoder(spark, matrices, network, tmp_path):
    normal, odd = matrices
    assert len(network.weights) == 5933
    mean = lambda df: AE.score_autoencoder(df, network, ["capture_id"]).agg(F.avg("reconstruction_error")).first()[0]
    assert mean(odd) > 10 * mean(normal)
    rows = AE.score_autoencoder(normal.unionByName(odd), network, ["capture_id"]).collect()
    assert max(r["score"] for r in rows) == 1.0 and all(r["is_anomaly"] for r in rows if r["flow_id"].startswith("o"))
    AE.save_autoencoder(spark, network, str(tmp_path / "a"))
    loaded = AE.load_autoencoder(spark, str(tmp_path / "a"))
    assert np.array_equal(loaded.weights, network.weights) and loaded.threshold == network.threshold
    with pytest.raises(RuntimeError):
        AE.score_autoencoder(odd, None)


def test_gradient_matches_differences():
    sizes = AE.layer_sizes(13, 2)
    w = AE.initial_weights(sizes, 1)
    x = np.random.default_rng(0).normal(size=(5, 13))
    loss = lambda v: AE.errors_of(x, v, sizes).mean()
    g = AE._gradient(x, w, sizes)
    for i in range(0, len(w), 17):
        step = np.zeros_like(w)
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-6)


def test_jobs(spark, make_flows, tmp_path):
    flows = make_flows([{"packet_count": 10 + i % 5, "byte_count": 1000 + 13 * i} for i in range(60)]
                       + [{"packet_count": 90_000, "byte_count": 60_000_000, "bytes_per_second": 9e9}]).drop(
        "is_anomaly", "anomaly_type", "severity", "ensemble_score")
    untrained = D.analyse(flows, None).collect()
    assert all(r["ensemble_score"] == 0.0 and not r["is_anomaly"] and r["severity"] == "info" for r in untrained)
    models = D.train(flows, trees=20, epochs=3, partitions=2)
    D.save_models(spark, models, str(tmp_path / "m"))
    scored = D.analyse(flows, D.load_models(spark, str(tmp_path / "m")))
    rows = {r["flow_id"]: r for r in scored.collect()}
    assert len(rows) == 61 and rows["f060"]["is_anomaly"] and rows["f060"]["anomaly_type"] == "data_exfiltration"
    r = rows["f003"]
    assert r["ensemble_score"] == pytest.approx((r["if_score"] + r["ae_score"]) / 2)


def test_paths_match_a_plain_walk(forest):
    """Also for values that are no numbers and values that equal a split."""
    x = np.random.default_rng(3).normal(0.5, 0.3, (300, 13))
    x[::7, 4], x[5, :] = np.nan, np.inf
    x[3, int(forest.nodes["feature"].iloc[0])] = forest.nodes["split"].iloc[0]

    def walk(row):
        total = 0.0
        for _, t in forest.nodes.groupby("tree"):
            t, at, depth = t.set_index("node"), 0, 0
            while t.at[at, "feature"] >= 0:
                at = t.at[at, "left"] if row[t.at[at, "feature"]] <= t.at[at, "split"] else t.at[at, "right"]
                depth += 1
            total += depth + float(FO.average_path(t.at[at, "size"]))
        return total

    paths = FO._paths(x, forest.arrays())
    some = [0, 3, 5, 7, 14, 100]
    assert paths[some].tolist() == [walk(x[i]) for i in some]


def test_learners_are_added_by_tasks_first(matrices, monkeypatch):
    one = AE.fit_autoencoder(matrices[0], epochs=2, partitions=5, ids=["flow_id"])
    monkeypatch.setattr(AE, "MEET", 2)
    two = AE.fit_autoencoder(matrices[0], epochs=2, partitions=5, ids=["flow_id"])
    assert np.allclose(one.weights, two.weights, rtol=0, atol=1e-12) and one.threshold == pytest.approx(two.threshold)


def test_rows_are_not_dealt_by_capture(matrices, network):
    """All rows of a few captures would meet in as few tasks."""
    plan = AE.score_autoencoder(matrices[0], network, ["capture_id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(capture_id" not in plan
