"""Queries read their tables whole."""

import os

import numpy as np
import pytest

from papertide import plans
from papertide.operators import vectors
from papertide.plans import analytics, views

from .test_queries import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_graphs_take_all_orders(spark):
    rows = views.authors(spark, DATA)
    everyone = {r.auid for r in rows.select("auid").distinct().collect()}
    assert {r.auid for r in plans.QUERIES["betweenness"](spark, DATA).collect()} == everyone
    assert {r.auid for r in plans.QUERIES["degree_centrality_all"](spark, DATA).collect()} == everyone
    years = {r.year for r in rows.select("year").distinct().collect()}
    by_year = plans.QUERIES["edges_by_year_all"](spark, DATA)
    assert len(years) > 1 and {r.year for r in by_year.select("year").distinct().collect()} == years
    total = plans.QUERIES["coauthor_edges_all"](spark, DATA).groupBy().sum("weight").first()[0]
    assert total == by_year.groupBy().sum("weight").first()[0] == plans.QUERIES["coauthor_edges"](spark, DATA).groupBy().sum("weight").first()[0]


def test_topics_cluster_all_vectors_and_keep_noise(spark):
    """A cluster of 12 among 3,600 vectors is found, and what density clustering calls noise has no topic."""
    rng = np.random.default_rng(6)
    centres = np.eye(8)
    x = np.concatenate([centres[0] + rng.normal(size=(1800, 8)) * 0.02, centres[1] + rng.normal(size=(1788, 8)) * 0.02, centres[2] + rng.normal(size=(12, 8)) * 0.005, rng.normal(size=(200, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "eid long, vector array<float>")
    got = {r.eid: (r.topic, r.similarity) for r in analytics._topics(df).collect()}
    assert len(got) == len(x)
    small = {got[i][0] for i in range(3588, 3600)}
    assert len(small) == 1 and small.isdisjoint({got[i][0] for i in range(3588)}) and min(small) >= 0
    found = {r.eid: r.topic for r in vectors.density_clusters(vectors.project(df, "eid", "vector", 5), "eid").collect()}
    assert {i: t for i, (t, _) in got.items()} == found
    assert -1 in found.values() and all((t == -1) == (s is None) for t, s in got.values())
