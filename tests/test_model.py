import math
from collections import Counter

import fixtures as X
import pytest

from strideway.functions.stats import chi2_sf, is_graphic
from strideway.operators import entropy, spectral
from strideway.operators.higher_order import HigherOrderNetwork as Hon
from strideway.operators.model import MarkovSequence, MultiOrderModel
from strideway.operators.paths import PathSet, PathsTooShort


@pytest.fixture(scope="module")
def small(spark):
    return X.random_paths(spark, 20, 10, 10)


def total(h):
    r = h.edges().groupBy().sum("w_sub", "w_long").first()
    return [r[0], r[1]]


def test_networks_of_order_k(small):
    assert total(Hon(small, 1)) == [121, 9] and total(Hon(small, 2)) == [91, 6]
    assert [Hon(small, k).model_size() for k in range(1, 7)] == [44, 46, 36, 27, 19, 12]
    assert Hon(small, 2, possible=False).nodes().count() == 42 and Hon(small, 2).nodes().count() == 44
    assert Hon(small, 2).adjacency(weighted=True).groupBy().sum("v").first()[0] == 97
    with pytest.raises(PathsTooShort):
        Hon(small, 30)


@pytest.mark.parametrize("args,k,possible,want", [((7, 20, 9), 1, True, 121), ((7, 20, 9), 2, True, 116), ((10, 10, 9), 2, True, 136), ((10, 10, 9), 2, False, 140)])
def test_distances(spark, args, k, possible, want):
    p = X.random_paths(spark, *args)
    if k == 1:
        got = Hon(p, 1).distances().groupBy().sum("dist").first()[0]
    else:
        got = Hon(p, k, possible=possible).distances().groupBy().sum("dist").first()[0]
    assert got == want


def test_network_hypothesis(spark):
    m = MultiOrderModel(X.random_paths(spark, 20, 40, 6), 1)
    for method, ic in {"AIC": (853.7904463, 829.9533868), "BIC": (862.2348436, 885.6864088), "AICc": (856.3359008, 1305.9533868)}.items():
        assert m.test_network_hypothesis(method=method)[1:] == pytest.approx(ic, abs=1e-5)


def test_order_selection(spark):
    one = PathSet.of(spark, [("a,c", 1), ("b,c", 1), ("c,d", 1), ("c,e", 1), *((x, 4) for x in ("a,c,d", "b,c,e", "b,c,d", "a,c,e"))])
    two = PathSet.of(spark, [("a,c", 1), ("b,c", 1), ("c,d", 1), ("c,e", 1), ("a,c,d", 4), ("b,c,e", 4)])
    assert MultiOrderModel(one, 2).estimate_order() == 1
    assert MultiOrderModel(two, 2).estimate_order() == 2
    assert MultiOrderModel(two, 1).state_file_lines(1)[0] == "*Vertices 5"


def test_likelihood_is_additive(spark):
    a, b = X.random_paths(spark, 10, 20, 10), X.random_paths(spark, 20, 30, 10)
    m = MultiOrderModel(a + b, 2)
    assert m.likelihood(a) + m.likelihood(b) == pytest.approx(m.likelihood(a + b))


def test_order_selection_makes_its_paths_once(spark):
    """They were made again for each likelihood and each count of walks."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = X.random_paths(spark, 60, 20, 5).longest
    m = MultiOrderModel(PathSet(rows.mapInPandas(counted, rows.schema)), 2)
    m.likelihood_ratio_test(null=1, order=2)
    m.test_network_hypothesis()
    m.likelihood_terms().collect()
    assert made.value == rows.count()


def test_likelihoods_and_freedom_are_those_of_listed_steps(spark):
    p = X.random_paths(spark, 40, 3, 5)
    m = MultiOrderModel(p, 2)
    paths = {tuple(r["path"]): r["freq"] for r in p.longest.collect()}
    grams, contexts = Counter(), Counter()
    for path, f in paths.items():
        for k in range(3):
            for i in range(len(path) - k):
                grams[path[i : i + k + 1]] += f
                contexts[path[i : i + k], k] += f

    def ll(path, layer):
        steps = [path[max(0, j - layer) : j + 1] for j in range(len(path))]
        return sum(math.log(grams[g] / contexts[g[:-1], len(g) - 1]) for g in steps)

    for top in range(3):
        assert m.likelihood(max_order=top) == pytest.approx(sum(f * ll(x, min(top, len(x) - 1)) for x, f in paths.items()))
        assert m.layer_likelihood(layer=top)[1] == sum(f for x, f in paths.items() if len(x) > top)
        terms = {r["length"]: r["ll"] for r in m.likelihood_terms().filter(f"layer = {top}").collect()}
        for n in {len(x) for x in paths}:
            assert terms[n - 1] == pytest.approx(sum(f * ll(x, top) for x, f in paths.items() if len(x) == n))
    edges = [g for g in grams if len(g) == 2]
    walks = [[(v,) for v in {v for g in edges for v in g}]]
    for _ in range(3):
        walks.append([w + (b,) for w in walks[-1] for a, b in edges if w[-1] == a])
    for k in range(1, 4):
        assert Hon(p, k).degrees_of_freedom() == len(walks[k]) - len({w[:-1] for w in walks[k]})


def test_centralities_of_order_k(spark):
    p = X.random_paths(spark, 50, 0, 8)
    for k in (1, 2):
        c = X.pairs(Hon(p, k).closeness())
        assert sum(c.values()) == pytest.approx(55)
    b1, b2 = X.pairs(Hon(p, 1).betweenness()), X.pairs(Hon(p, 2).betweenness())
    assert sum(b1.values()) == pytest.approx(2) and max(b1.values()) == pytest.approx(1 / 3)
    assert sum(b2.values()) == pytest.approx(3) and max(b2.values()) == pytest.approx(1.5)


def variance(values):
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values) / len(values)


def test_pagerank_of_order_k(spark):
    p = X.random_paths(spark, 50, 0, 8)
    for k, how, want in ((1, "scaled", 6.111e-05), (2, "scaled", 3.9924e-04), (2, "last", 4.5827e-04), (2, "first", 3.4580e-04)):
        got = X.pairs(spectral.pagerank_of(Hon(p, k), how)).values()
        assert sum(got) == pytest.approx(1) and variance(list(got)) == pytest.approx(want, rel=1e-3)


def test_spectral(spark):
    assert spectral.slow_down_factor(X.random_paths(spark, 90, 90)) == pytest.approx(4.05, rel=0.01)


def test_preference(spark):
    from strideway.operators.extract import causal_paths
    from strideway.operators.temporal import TemporalEdges

    p = causal_paths(TemporalEdges.of(spark, X.TEMPORAL), 1)
    assert p.observation_count().first()["n"] == 10
    assert entropy.betweenness_preference(p, "e") == pytest.approx(1.2954618442)
    assert entropy.betweenness_preference(p, "e", method="Miller") == pytest.approx(0.9954618442)
    assert entropy.betweenness_preference(p, "e", normalized=True) == pytest.approx(1)
    assert entropy.betweenness_preference(p, "nowhere") is None


def test_markov_sequence(spark):
    import numpy as np

    np.random.seed(1)
    s = "".join(np.random.choice(list("abc"), 400))
    seq = MarkovSequence(spark.createDataFrame(list(enumerate(s)), "pos long, s string"))
    assert seq.estimate_order(3, "BIC") == 1
    assert seq.log_likelihood(2) > seq.log_likelihood(1)


def test_numbers():
    assert chi2_sf(0, 3) == 1 and chi2_sf(11.09, 2) == pytest.approx(0.0039, abs=1e-4) and chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert chi2_sf(1.0, 4) == pytest.approx(0.9098, abs=1e-4)
    assert is_graphic([3, 3, 2, 2, 1, 1]) and not is_graphic([4, 4, 4, 2, 2]) and not is_graphic([1, 1, 1]) and is_graphic([2], self_loops=True) and is_graphic([2, 2], multi_edges=True)
