"""Inputs and seeded generators that the expected values of the tests belong to."""

import numpy as np

from strideway.operators.paths import PathSet

TEMPORAL = [(a, b, t) for t, (a, b) in enumerate("ce ef ae eg ce ef ae eg ce ef fe eb eb ce ef be eg ce ef ce ef".split(), 1)]
CAUSAL = [("a", "b", 1), ("b", "a", 3), ("b", "c", 3), ("d", "c", 4), ("c", "d", 5), ("c", "b", 6)]
DAG = [tuple(x) for x in "ab ac cb be bf fg cg hi hj".split()]
NGRAMS = [("a,b,c,d,a,b", 2), ("d,e,d,a,b", 4)]
NETWORK = [tuple(x) for x in "AB AC BC BD BF CG CE DF EG FH GH".split()]
OD = [("A", "H", 5.0), ("B", "E", 3.0), ("D", "E", 7.0), ("A", "F", 3.0)]


def random_paths(spark, size, seed, nodes=None):
    """Paths by the legacy generator: a frequency, a number of nodes, then the nodes of each."""
    names = [chr(ord("a") + k) for k in range(26)] if nodes is None else [str(k) for k in range(nodes)]
    np.random.seed(seed)
    rows = []
    for _ in range(size):
        freq = np.random.randint(1, 4)
        length = np.random.randint(1, 10)
        rows.append(([names[k] for k in np.random.choice(len(names), length)], int(freq)))
    return PathSet.of(spark, rows)


def pairs(df, key="node", value="value"):
    return {r[key]: r[value] for r in df.collect()}


def freqs(paths):
    return {"".join(r["path"]): r["freq"] for r in paths.longest.collect()}
