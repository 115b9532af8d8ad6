import numpy as np
import pytest

from lakeworks.operators import clusters, routing
from tests.test_spatial import plain_walk


@pytest.fixture(scope="module")
def zoned(spark):
    rng = np.random.default_rng(7)
    centers = [(40.70, -74.02), (40.80, -73.95), (40.75, -73.99)]
    rows = [
        (z * 100 + i, f"s{z}-{i}", float(lat + dy), float(lon + dx), 5)
        for z, (lat, lon) in enumerate(centers)
        for i, (dy, dx) in enumerate(rng.normal(0, 0.003, (40, 2)))
    ]
    stops = spark.createDataFrame(rows, "stop_id long, name string, lat double, lon double, capacity long")
    model = clusters.fit(stops, k=3)
    return stops, model, clusters.assign(model, stops)


def test_every_stop_gets_the_nearest_center(zoned):
    stops, model, assigned = zoned
    rows = assigned.orderBy("stop_id").collect()
    points = np.array([(r["lat"], r["lon"]) for r in rows])
    scaled = (points - points.mean(axis=0)) / points.std(axis=0, ddof=1)
    centers = np.array(model.stages[-1].clusterCenters())
    centers = np.array(sorted(centers.tolist()))  # zones are numbered in the order of their centers
    nearest = ((scaled[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1) + 1
    assert [r["zone_id"] for r in rows] == nearest.tolist()
    # The three heaps are far apart, so each is one zone.
    assert len({(r["stop_id"] // 100, r["zone_id"]) for r in rows}) == 3


def test_balance_and_quality(zoned):
    stops, model, assigned = zoned
    assert sorted(r["stop_count"] for r in clusters.balance(assigned).collect()) == [40, 40, 40]
    row = clusters.evaluate(model, stops).first()
    assert row["silhouette"] > 0.9 and row["clusters"] == 3 and 0 < row["mean_squared_distance"] < 0.1
    assert row["mean_squared_distance"] == pytest.approx(model.stages[-1].summary.trainingCost / stops.count())


def test_a_model_from_disk_and_restarts(zoned, folder):
    stops, model, assigned = zoned
    model.write().save(folder)
    loaded = clusters.PipelineModel.load(folder)
    assert clusters.evaluate(loaded, stops).first() == clusters.evaluate(model, stops).first()
    best = clusters.fit(stops, k=3, restarts=3)
    again = {(r["stop_id"], r["zone_id"]) for r in clusters.assign(best, stops).collect()}
    assert again == {(r["stop_id"], r["zone_id"]) for r in assigned.collect()}


def test_layers_and_greedy_routes_over_clusters(zoned):
    _, _, assigned = zoned
    layers = routing.combined_layers(routing.Routes(assigned))
    assert {r["layer_type"]: r["count"] for r in layers.groupBy("layer_type").count().collect()} == {
        "Stop": 120, "Route Path": 3, "Zone Center": 3,
    }
    got = routing.greedy_routes(assigned, at_once=30).collect()
    for zone in {r["zone_id"] for r in got}:
        stops = [(r["stop_id"], (r["lat"], r["lon"])) for r in assigned.filter(f"zone_id = {zone}").collect()]
        route = [r["stop_id"] for r in sorted((r for r in got if r["zone_id"] == zone), key=lambda r: r["stop_number"])]
        assert route == plain_walk(stops)
