"""Multi-order Markov models of path sets, likelihoods, order selection, and Markov chains of one sequence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideway.functions.stats import chi2_sf
from strideway.operators.higher_order import HigherOrderNetwork
from strideway.operators.iterate import cut
from strideway.operators.paths import PathSet


class MultiOrderModel:
    """trans: (k, gram, cnt, p) of all orders up to max_order in one table, from one pass over the grams. The paths are made once and kept."""

    def __init__(self, paths: PathSet, max_order: int = 1) -> None:
        self.paths, self.max_order = paths.kept(), max_order
        s = self.paths.stats(0, max_order).select("k", F.col("path").alias("gram"), (F.col("sub") + F.col("longest")).alias("cnt")).filter("cnt > 0")
        context = F.slice("gram", 1, F.col("k"))
        self.trans = cut(s.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("k", context))))
        self._dof: dict[tuple[int, str], int] = {}
        self._own: dict[tuple[int, bool, int], tuple[float, float]] = {}

    def add_layers(self, max_order: int) -> MultiOrderModel:
        return self if max_order <= self.max_order else MultiOrderModel(self.paths, max_order)

    def layer(self, k: int) -> HigherOrderNetwork:
        return HigherOrderNetwork(self.paths, k)

    @staticmethod
    def _rows(paths: PathSet, min_len: int, max_len: int | None) -> DataFrame:
        size = F.size("path")
        return paths.longest.filter((size - 1 >= min_len) if max_len is None else (size - 1).between(min_len, max_len)).filter("freq > 0")

    @staticmethod
    def _grams(layer: int) -> Column:
        """The gram of each step of a path; up to the layer's order each node has the context there is."""
        at = F.sequence(F.lit(1), F.size("path"))
        return F.transform(at, lambda j: F.slice("path", j - F.least(j - 1, F.lit(layer)), F.least(j, F.lit(layer + 1))))

    def _known(self, steps: DataFrame) -> DataFrame:
        """steps with p of their gram. The lookup table is as large as the model, so the join is left to AQE; a step that the model lacks fails."""
        missing = F.raise_error(F.concat(F.lit("no transition for "), F.array_join("gram", ","))).cast("double")
        return steps.join(self.trans.select("gram", "p"), "gram", "left").withColumn("p", F.coalesce("p", missing))

    def path_likelihoods(self, paths: PathSet, layer: int, min_len: int = 0, max_len: int | None = None) -> DataFrame:
        """(path, freq, ll): log likelihood of one traversal."""
        steps = self._rows(paths, min_len, max_len).select("path", "freq", F.explode(self._grams(layer)).alias("gram"))
        return self._known(steps).groupBy("path", "freq").agg(F.sum(F.log("p")).alias("ll"))

    def _sums(self, paths: PathSet, layer: int, min_len: int = 0, max_len: int | None = None, by: tuple[Column, ...] = ()) -> DataFrame:
        """(.., ll, n): log likelihood of all traversals and their number. Equal grams are counted before they are looked up, so no step is shuffled and none carries its path."""
        names = [f"__by{i}" for i in range(len(by))]
        rows = self._rows(paths, min_len, max_len)
        steps = rows.select(*[c.alias(x) for c, x in zip(by, names)], "freq", F.posexplode(self._grams(layer)).alias("at", "gram"))
        counts = steps.groupBy(*names, "gram").agg(F.sum("freq").alias("taken"), F.sum(F.when(F.col("at") == 0, F.col("freq")).otherwise(0.0)).alias("starts"))
        return self._known(counts).groupBy(*names).agg(F.coalesce(F.sum(F.col("taken") * F.log("p")), F.lit(0.0)).alias("ll"), F.coalesce(F.sum("starts"), F.lit(0.0)).alias("n"))

    def layer_likelihood(self, paths: PathSet | None = None, layer: int = 1, longer: bool = True, min_len: int | None = None) -> tuple[float, float]:
        """(log likelihood, path observations) of paths of the layer's length or more, or of min_len or more."""
        low = layer if min_len is None else min_len
        if paths is None and (layer, longer, low) in self._own:
            return self._own[layer, longer, low]
        got = self._sums(paths or self.paths, layer, low, None if longer else layer).first()
        if paths is None:
            self._own[layer, longer, low] = got["ll"], got["n"]
        return got["ll"], got["n"]

    def likelihood_terms(self, paths: PathSet | None = None) -> DataFrame:
        """(length, layer, ll): log likelihoods of paths by length, at their own layer and at the top one."""
        out, p = None, paths.kept() if paths else self.paths
        for layer in range(self.max_order + 1):
            r = self._sums(p, layer, by=(F.size("path") - 1,)).select(F.col("__by0").alias("length"), "ll", F.lit(layer).alias("layer"))
            out = r if out is None else out.unionByName(r)
        return out

    def likelihood(self, paths: PathSet | None = None, max_order: int | None = None) -> float:
        """Log likelihood: paths of k < K edges at layer k, all others at layer K. A path of k < K edges has the same grams at layers k and K, so one pass at layer K does."""
        return self.layer_likelihood(paths, self.max_order if max_order is None else max_order, min_len=0)[0]

    def _layer_dof(self, k: int, assumption: str) -> int:
        if (k, assumption) not in self._dof:
            self._dof[k, assumption] = HigherOrderNetwork(self.paths, k).degrees_of_freedom(assumption)
        return self._dof[k, assumption]

    def degrees_of_freedom(self, max_order: int | None = None, assumption: str = "paths") -> int:
        return sum(self._layer_dof(k, assumption) for k in range((self.max_order if max_order is None else max_order) + 1))

    def likelihood_ratio_test(self, paths: PathSet | None = None, null: int = 0, order: int = 1, assumption: str = "paths", threshold: float = 0.01) -> tuple[bool, float]:
        p = paths.kept() if paths else None
        x = -2 * (self.likelihood(p, null) - self.likelihood(p, order))
        # layers up to the null model's are in both
        p = chi2_sf(x, sum(self._layer_dof(k, assumption) for k in range(null + 1, order + 1)))
        return p < threshold, p

    def estimate_order(self, paths: PathSet | None = None, stop: int | None = None, threshold: float = 0.01) -> int:
        """The largest order k >= 2 that is accepted against k - 1, else 1."""
        model, best, paths = self.add_layers(stop or self.max_order), 1, paths.kept() if paths else None
        for k in range(2, (stop or self.max_order) + 1):
            if model.likelihood_ratio_test(paths, k - 1, k, threshold=threshold)[0]:
                best = k
        return best

    def test_network_hypothesis(self, paths: PathSet | None = None, method: str = "AIC") -> tuple[bool, float, float]:
        """(whether the network topology is worth its parameters, criterion of order 0, of order 1)."""
        l0, n = self.layer_likelihood(paths, 0, min_len=1)
        l1, _ = self.layer_likelihood(paths, 1, min_len=1)
        d0, d1 = self.degrees_of_freedom(0), self.degrees_of_freedom(1)
        if method == "AIC":
            ic = [2 * d - 2 * x for d, x in ((d0, l0), (d1, l1))]
        elif method == "BIC":
            ic = [math.log(n) * d - 2 * x for d, x in ((d0, l0), (d1, l1))]
        elif method == "AICc":
            if n <= d1 - 2:
                raise ValueError("too few samples for the model's complexity")
            ic = [2 * d - 2 * x + 2 * (d + 1) * (d + 2) / (n - d - 2) for d, x in ((d0, l0), (d1, l1))]
        else:
            raise ValueError("method is AIC, BIC or AICc")
        return ic[0] > ic[1], ic[0], ic[1]

    def summary(self) -> DataFrame:
        return self.trans.groupBy("k").agg(F.count("*").alias("grams"), F.sum("cnt").alias("weight"))

    def state_file_lines(self, layer: int) -> list[str]:
        """Lines of a state-network file (vertices, states, links) of one layer; collects that layer."""
        if not layer:
            raise ValueError("layer must be 1 or more")
        edges = sorted((tuple(r["src"]), tuple(r["dst"]), r["w"]) for r in self.layer(layer).weights().collect())
        states = sorted({x for e in edges for x in e[:2]})
        names = sorted({s[-1] for s in states})
        v, s = {n: i + 1 for i, n in enumerate(names)}, {x: i + 1 for i, x in enumerate(states)}
        out = [f"*Vertices {len(names)}", *(f'{v[n]} "{n}"' for n in names), f"*States {len(states)}"]
        out += [f'{s[x]} {v[x[-1]]} "{"-".join(x)}"' for x in states]
        return [*out, f"*Links {len(edges)}", *(f"{s[a]} {s[b]} {w:g}" for a, b, w in edges)]


class MarkovSequence:
    """A Markov chain of one sequence: (pos, s), or of many with a key column, whose contexts never cross keys."""

    def __init__(self, seq: DataFrame, key: str | None = None) -> None:
        self.seq, self.key = seq, key

    def grams(self, k: int) -> DataFrame:
        """(ctx array, s): each symbol with the k before it. One window a key; a single long sequence needs `key` to be split."""
        w = Window.partitionBy(self.key).orderBy("pos") if self.key else Window.orderBy("pos")
        before = [F.lag("s", k - i).over(w).alias(f"b{i}") for i in range(k)]
        rows = self.seq.select(*before, "s")
        if k:
            rows = rows.filter(F.col("b0").isNotNull())
        return rows.select(F.array(*[F.col(f"b{i}") for i in range(k)]).cast("array<string>").alias("ctx"), "s")

    def transitions(self, k: int = 1) -> DataFrame:
        """(ctx, s, cnt, p)."""
        c = self.grams(k).groupBy("ctx", "s").agg(F.count("*").alias("cnt"))
        return c.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("ctx")))

    def log_likelihood(self, k: int = 1) -> float:
        return self.transitions(k).agg(F.coalesce(F.sum(F.col("cnt") * F.log("p")), F.lit(0.0))).first()[0]

    def _sizes(self) -> tuple[int, int]:
        r = self.seq.agg(F.count_distinct("s"), F.count("*")).first()
        return r[0], r[1]

    def bic(self, k: int = 1, m: int = 1) -> float:
        s, n = self._sizes()
        return math.log(n - k) * (s**k - s**m) * (s - 1) - 2 * (self.log_likelihood(k) - self.log_likelihood(m))

    def aic(self, k: int = 1, m: int = 1) -> float:
        s, _ = self._sizes()
        return 2 * (s**k - s**m) * (s - 1) - 2 * (self.log_likelihood(k) - self.log_likelihood(m))

    def estimate_order(self, max_order: int, method: str = "BIC") -> int:
        if method == "Likelihood":
            return max(range(1, max_order + 1), key=self.log_likelihood)
        score = {"BIC": self.bic, "AIC": self.aic}[method]
        return min(range(1, max_order), key=lambda k: score(k, max_order))
