"""A handful of published values as literals, so that these checks always run."""

import pytest

from probitas.operators import rollups as RU

# Fixed test values: one system's published country distances (fact), alphabetical, and the published mean, which
# leaves out the last country.
DISTANCES = [-3, 18, 29, -14, 52, 75, -41, 34, 42, 20, 17, 39, -34, 27, -28, -18, 56, -30, 2, 49, -42, 28, 48, 18, 23, 8, 35, -11, -14, 24,
             29, 38, -24, 29, -34, 43, 10, 49, 76, 49, 33, 39, 12, -12, -27, 4, 18, 28, 35]
MEAN_DISTANCE = 16.020833333333332
# Truth and the systems' percentages of three countries, as published.
PERCENTAGES = {"Albania": (41, [38, 30, 42, 47, 56, 55, 26, 25, 57, 52]), "Armenia": (9, [38, 32, 10, 28, 76, 40, 16, 10, 40, 42]),
               "Austria": (55, [41, 62, 51, 50, 50, 50, 74, 42, 71, 66])}
PUBLISHED_DISTANCES = {"Albania": (-3, -11), "Armenia": (29, 23), "Austria": (-14, 7)}  # first and second system
# Published fact validity of two systems over forty languages, and their published averages.
VALIDITY = {
    "LlaMA 3B": ([1.0, 0.89, 0.0, 0.82, 1.0, 1.0, 0.89, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 0.99, 1.0, 1.0, 0.34, 0.0, 0.89, 0.03, 0.0, 0.0, 0.98,
                  0.0, 1.0, 0.0, 0.75, 0.0, 0.0, 1.0, 1.0, 1.0, 0.84, 0.61, 0.78, 0.99, 1.0, 1.0, 1.0, 0.98], 0.69),
    "LlaMA 8B": ([1.0, 1.0, 0.0, 0.68, 1.0, 1.0, 0.93, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 0.99, 0.94, 1.0, 1.0, 0.0, 1.0, 0.03, 0.0, 0.0, 0.99,
                  0.0, 1.0, 0.0, 0.91, 0.67, 0.0, 1.0, 1.0, 1.0, 1.0, 0.78, 0.91, 0.99, 0.99, 1.0, 1.0, 1.0], 0.75),
}


def test_distances(spark):
    rows = [("Fact", c, f"m{k}", t, v) for c, (t, vs) in PERCENTAGES.items() for k, v in enumerate(vs)]
    dist = RU.distances(spark.createDataFrame(rows, "test string, country string, model string, truth long, value long"))
    got = {(r.country, r.model): r.distance for r in dist.collect()}
    for c, (a, b) in PUBLISHED_DISTANCES.items():
        assert (got[c, "m0"], got[c, "m1"]) == (a, b)


def test_mean_distance_leaves_out_the_last_country(spark):
    rows = [("Fact", f"c{k:02d}", "m", 0, v) for k, v in enumerate(DISTANCES)]
    dist = RU.distances(spark.createDataFrame(rows, "test string, country string, model string, truth long, value long"))
    assert RU.mean_distance(dist, drop_last_country=True).first().avg_distance == round(MEAN_DISTANCE, 4)


@pytest.mark.parametrize("model", sorted(VALIDITY))
def test_matrix_average(spark, model):
    values, average = VALIDITY[model]
    labels = [f"l{k}" for k in range(len(values))]
    rows = [("language_scenario", "fact_val", model, lab, v) for lab, v in zip(labels, values)]
    means = spark.createDataFrame(rows, "scenario string, metric string, model string, label string, value double")
    row = RU.metric_matrix(means, "language_scenario", labels).first()
    assert row.average == average and [row[x] for x in labels] == values
