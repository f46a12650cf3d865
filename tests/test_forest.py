"""The forest grows the same trees wherever its nodes are finished, and finds the splits that trying all of them finds."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from reviewspark.learning import forest
from reviewspark.learning.models import ScreenClassifier
from reviewspark.session import checkpoint


@pytest.fixture(scope="module")
def points(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(400):
        values = {int(j): float(rnd.integers(-2, 6)) for j in rnd.choice(30, 8, replace=False)}
        label = int(values.get(4, 0.0) > 1 or rnd.random() < 0.1)
        rows.append((f"p{i}", label, Vectors.sparse(30, values) if i % 2 else Vectors.dense(Vectors.sparse(30, values).toArray())))
    return checkpoint(spark.createDataFrame(rows, ["entry_id", "label", "features"]).repartition(3, "entry_id").sortWithinPartitions("entry_id"))


def _fit(points, **options):
    classifier = RandomForestClassifier(numTrees=8, maxDepth=9, seed=5, featuresCol="features", labelCol="label", **options)
    sizes = {r["label"]: r["count"] for r in points.groupBy("label").count().collect()}
    return lambda local: forest.fit_forest(classifier, points, sizes, (1.0, 2.0), local_rows=local)


def test_wide_nodes_split_as_in_one_task(points):
    """Sizes of the nodes that a task finishes alone change where the work is done, not the trees."""
    fit = _fit(points, minInstancesPerNode=2)
    score = lambda model: sorted((r["entry_id"], r["probability"]) for r in model.transform(points).collect())
    alone, shared = fit(10_000), fit(60)
    assert score(alone) == score(shared)
    assert sum(t.numNodes for t in alone.trees) == sum(t.numNodes for t in shared.trees) > 8 * 5
    assert np.allclose(alone.featureImportances.toArray(), shared.featureImportances.toArray())
    assert alone.featureImportances.toArray().argmax() == 4 and max(t.depth for t in alone.trees) <= 9


def test_best_split_is_that_of_trying_all(points):
    rows = points.select("label", "features").collect()
    x, y = np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows])
    edges = forest.bin_edges(points, "features", 30)
    shape = forest.Shape(1, 1, 3, 5, (1.0, 2.0), edges)
    dense = (edges[None, :, :] < x[:, :, None]).sum(axis=2).astype(np.uint8)
    tried, times = shape.candidates(np.array([77], np.uint64)), np.ones(len(y), np.int64)
    assert len(set(tried[0])) == shape.tried == 6
    keys, counts = forest.histograms(dense, y, np.arange(len(y)), np.zeros(len(y), np.int64), times, tried, shape.zero)
    totals = np.array([[(y == 0).sum(), (y == 1).sum()]], float)
    _, feature, bins, gain, left = forest.best_splits(shape, keys, counts, totals, tried)

    def gini(part):
        w = np.array([(part == 0).sum(), 2.0 * (part == 1).sum()])
        return (1 - ((w / w.sum()) ** 2).sum()) * w.sum()

    best = 0.0
    for f in tried[0]:
        for threshold in edges[f][np.isfinite(edges[f])]:
            a, b = y[x[:, f] <= threshold], y[x[:, f] > threshold]
            if min(len(a), len(b)) >= 3:
                best = max(best, (gini(y) - gini(a) - gini(b)) / (totals @ [1.0, 2.0])[0])
    assert gain[0] == pytest.approx(best)
    assert left[0].sum() == (x[:, feature[0]] <= edges[feature[0], bins[0]]).sum()


def test_forest_keeps_its_settings_and_saves(spark, points, tmp_path):
    """The classifier's forest is grown here, not by dense histograms per node and partition, and is Spark ML's model."""
    model = ScreenClassifier(numTrees=5, maxDepth=4, prefix="rf_").fit(points)
    assert model.getNumTrees == 5 and model.getMaxDepth() == 4 and model.getRawPredictionCol() == "rf_rawPrediction"
    assert model.getMaxMemoryInMB() < 1024
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    shown = lambda m: sorted((r["entry_id"], r["rf_probability"]) for r in m.transform(points).collect())
    assert shown(again) == shown(model)
    right = model.transform(points).agg(F.avg((F.col("label") == F.col("rf_prediction")).cast("double"))).first()[0]
    assert right > 0.8


def test_large_nodes_are_split_by_their_columns_alike(points, monkeypatch):
    """Inside a task, nodes above `DENSE_ROWS` rows read the columns they try; the trees are those of dense blocks."""
    chunk = forest.Chunk.joined([c for _, c in forest._chunks(forest.binned(points, "features", forest.bin_edges(points, "features", 30)).toArrow().to_batches())])
    shape = forest.Shape(4, 9, 2, 5, (1.0, 2.0), forest.bin_edges(points, "features", 30))
    top, times = forest.Top.of(shape), forest._draws(shape, 0, len(chunk.labels))
    at = [np.flatnonzero(times[:, t]) for t in range(4)]
    rows, roots = np.concatenate(at), np.repeat(np.arange(4), [len(a) for a in at])
    given = shape, chunk.take(rows), times[rows, roots], roots, top.salt, top.depth
    dense = forest.grown(*given)
    monkeypatch.setattr(forest, "DENSE_ROWS", 20)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 50)

    def walked(tree, at=0):
        inner = tree["feature"][at] >= 0
        below = [walked(tree, tree["left"][at] + i) for i in (0, 1)] if inner else []
        return tuple(tree[c][at] for c in ("depth", "feature", "bin", "zeros", "ones")), below

    columns = forest.grown(*given)
    assert [walked(t) for t in columns] == [walked(t) for t in dense] and all(len(t["left"]) > 9 for t in dense)
    for t in range(4):  # rows that the tree does not draw stay out
        own = forest.grown(shape, chunk, times[:, t], np.zeros(len(times), np.int64), top.salt[[t]], top.depth[[t]])
        assert walked(own[0]) == walked(dense[t])


def test_model_is_a_table_with_one_packed_row_per_tree(spark, points):
    """No node becomes an object of the driver; scores are the mean share of class 1 in the leaves."""
    model = _fit(points, minInstancesPerNode=2)(10_000)
    table = model._table("trees").orderBy("tree").collect()
    assert not hasattr(model, "_java_obj") and [r["tree"] for r in table] == list(range(8))
    assert [t.numNodes for t in model.trees] == [r["size"] for r in table]
    edges = forest.bin_edges(points, "features", 30)
    kinds = [("feature", np.int32), ("bin", np.uint8), ("left", np.int32), ("zeros", np.int64), ("ones", np.int64)]
    trees = [[forest._read(bytes(r[name]), kind) for name, kind in kinds] for r in table]
    for row in model.transform(points).collect():
        shares = []
        for feature, cut, left, zeros, ones in trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] + (row["features"][int(feature[at])] > edges[feature[at], cut[at]])
            shares.append(2.0 * ones[at] / (zeros[at] + 2.0 * ones[at]))
        assert row["probability"][1] == pytest.approx(np.mean(shares)) and row["rawPrediction"][1] == pytest.approx(sum(shares))
        assert row["prediction"] == (row["probability"][1] > 0.5)


def test_bin_edges_are_quantiles_of_each_feature(spark):
    rnd = np.random.default_rng(1)
    values = [rnd.normal(size=3000).round(3), np.where(rnd.random(3000) < 0.1, rnd.random(3000), 0.0), np.zeros(3000)]
    rows = spark.createDataFrame([(0, Vectors.dense(*x)) for x in zip(*values)], ["label", "features"]).repartition(2)
    edges = forest.bin_edges(rows, "features", 3)
    assert np.isinf(edges[2]).all()
    for own, x in zip(edges, values[:2]):
        x, own = np.sort(x[x != 0]), own[np.isfinite(own)]
        assert (np.diff(own) > 0).all() and len(own) >= 28 and x[x > 0].min() / 2 in own and own.max() < x.max()
        ranks = np.searchsorted(x, own, side="right") / len(x)
        assert all(np.abs(ranks - k / 29).min() < 2 / forest.ACCURACY + 0.002 for k in range(1, 29))
