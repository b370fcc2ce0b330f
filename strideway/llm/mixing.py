"""Mixing to target weights by soft memberships.

Native: every step on rows is a DataFrame or SQL expression. A multinomial logistic classifier, fitted on the labelled table, gives each document a posterior over DOMAINS
(junk, good, toxic); its expected tokens in a domain are tokens x posterior. Document rates r >= 0 (and <= max_rate) then minimise the squared
relative misses of the domains, sum over d of (sum over i of tokens_i p_id r_i - target_d)^2 / tokens_d, by projected gradient from r = 1, with the row
step scaled by 1 / tokens_i, so documents of one posterior share one rate. A rate is a fold of the gradients so far over the document's posterior, so
an iteration is one aggregation of a narrow written table and hands the driver one number a domain.

The good domain is wanted whole. The weights of the others are upper shares: each is wanted up to its weight relative to good's, and whole if it has less, so a
scarce domain never shrinks the rest, and rates up to max_rate = 1 can meet the targets. A domain without labelled rows has no term, as its posterior is only the
prior; without labelled good rows there is nothing to measure the others by, and all rates stay at the start.
A document is taken floor(rate) times, and once more if the hash of its id and text falls below the remainder: the draw is reproducible.

The classifier reads present features: words, doubled symbols, levels of repeated and of echoed words, and stems that several different words begin with; the FEATURES
ones of largest information gain are used. Its weights come from accelerated gradient steps on the driver over the features of a bounded sample: about TRAIN_DOCS labelled rows a domain, chosen by hashes and weighted back to all labelled rows,
whatever the corpus is. All counts and totals of tokens cover
all documents. A hot source or domain is only a larger term of map-side sums. Labels join by id with AQE's skew splitting.

Cases. Null or blank text: 0 tokens, the prior as posterior, rate by it. Null id: never labelled; drawn by its text. Labels repeated for an id: counted
once each, duplicates folded. No label at all: uniform posteriors, rates 1. A domain without labelled rows: its small prior only, no target. Null label: the row is not learned from. A domain without tokens: it has no term. Repeated rows: equal rates and equal
draws. Long texts: whole, in one row's expression. Empty table: no rows. Other columns are carried, whatever their names and types; only ``mixed`` raises ValueError for columns named like its results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import join_small, written

DOMAINS = ("junk", "good", "toxic")
GOOD = 1
TARGETS = (0.02, 0.975, 0.005)
#: Features of the classifier, and levels of the shares of repeated and of echoed words; symbols whose doubling is a feature.
FEATURES, LEVELS = 300, 16
#: Characters of a stem, and numbers of different longer words that share one.
STEM, FAMILIES = 5, (2, 3, 5, 8)
SYMBOLS = "!%*$&#@~=^<>|?"
#: Labelled rows a domain that the classifier is fitted on, in expectation.
TRAIN_DOCS = 3000
#: Gradient steps of the classifier and its ridge.
FIT_STEPS, RIDGE = 300, 1e-4
#: Least squares ends at misses of TOLERANCE of the total, or after ITERATIONS.
ITERATIONS, MOMENTUM, TOLERANCE = 24, 0.6, 1e-3


@dataclass
class Model:
    """Log share of the labels and bias by domain; weights by feature and domain; the domains with labelled rows."""

    prior: list[float]
    bias: list[float]
    weights: dict[str, list[float]]
    live: list[int]


_RESULTS = ("n_tokens", "rate", "copies", *(f"p_{d}" for d in DOMAINS))


def _words(text: Column) -> Column:
    """Lower-cased words without full stops and commas. Plain replacements and one-character separators: no regular expressions."""
    plain = F.lower(text)
    for old, new in ((".", ""), (",", ""), ("\n", " "), ("\t", " "), ("\r", " "), ("\f", " ")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.array_remove(F.split(plain, " "), "")


def _shape(text: Column, words: Column, own: Column) -> list[Column]:
    """Features of form: each doubled symbol that occurs (else null), the share of repeated words and that of words equal to the one before, in LEVELS levels.

    No word contains a blank, as these do.
    """
    level = lambda part: F.least(F.floor(F.lit(LEVELS) * part / F.greatest(F.size(words), F.lit(1))), F.lit(LEVELS - 1)).cast("string")
    echoes = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
    levels = [F.concat(F.lit("repeats "), level(F.size(words) - F.size(own))), F.concat(F.lit("echoes "), level(echoes))]
    return [*[F.when(F.contains(text, F.lit(2 * x)), F.lit(f"has {2 * x}")) for x in SYMBOLS], *levels]


def _families(own: Column, stems: list[str] | None) -> Column:
    """For each stem of several different words (of the chosen stems, if given) a feature for each number in FAMILIES that they reach."""
    long = F.filter(own, lambda w: F.length(w) > STEM if stems is None else (F.length(w) > STEM) & F.substring(w, 1, STEM).isin(stems))
    ordered = F.sort_array(F.transform(long, lambda w: F.substring(w, 1, STEM)))

    def reached(o: Column, n: int) -> Column:
        return F.filter(F.transform(o, lambda x, i: F.when(x == F.get(o, i + (n - 1)), F.concat(F.lit(f"stem {n} "), x))), lambda x: x.isNotNull())

    def families(o: Column) -> Column:
        return F.array_distinct(F.concat(*[reached(o, n) for n in FAMILIES]))

    # as the one element of an array the sorted stems are a variable: as an expression they would be sorted anew for each of their elements
    return F.get(F.transform(F.array(ordered), families), F.lit(0))


def _worded(df: DataFrame, *cols: Column) -> DataFrame:
    """cols with the words of column text (w) and the distinct ones (own): columns, as each is used more than once."""
    return df.select(*cols, "text", _words(F.col("text")).alias("w")).withColumn("own", F.array_distinct("w"))


def _features(chosen: list[str] | None) -> Column:
    """Distinct features of a _worded text: its words (of the chosen ones, if given), its stems and its form."""
    text, words, own = F.col("text"), F.col("w"), F.col("own")
    form = F.array_compact(F.array(*_shape(text, words, own)))
    if chosen is None:
        return F.concat(own, _families(own, None), form)
    names = F.array(*[F.lit(c) for c in chosen]) if chosen else F.array().cast("array<string>")
    parts = [own, form]
    if stems := sorted({c.split(" ", 2)[2] for c in chosen if c.startswith("stem ")}):
        parts.append(_families(own, stems))
    return F.array_intersect(F.concat(*parts), names)


def _domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 1).when((quality == 0) & (toxic == 0), 0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = FIT_STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights (columns of x by columns of y) of the multinomial logistic regression, by accelerated gradient steps."""
    weight = (weight / weight.sum())[:, None]
    bound = 0.5 * float(np.linalg.eigvalsh(x.T @ (x * weight))[-1]) + ridge
    now = ahead = np.zeros((x.shape[1], y.shape[1]))
    for k in range(steps):
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - (x.T @ ((p - y) * weight) + ridge * ahead) / bound
        ahead = new + k / (k + 3) * (new - now)
        now = new
    return now


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_docs: int = TRAIN_DOCS) -> Model:
    """The classifier from the labelled rows."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), _domain(F.col("quality"), F.col("toxic")).alias("d")).filter("d IS NOT NULL AND id IS NOT NULL").distinct()
    sizes = {r["d"]: r["n"] for r in marks.groupBy("d").agg(F.count("*").alias("n")).collect()}
    total, k = sum(sizes.values()), len(DOMAINS)
    if not total:
        return Model([0.0] * k, [0.0] * k, {}, [])
    prior = [math.log((sizes.get(d, 0) + 1) / (total + k)) for d in range(k)]
    few = lambda h, n: F.pmod(h, F.lit(1_000_003)) < 1_000_003 * F.create_map(*[x for d, m in sorted(n.items()) for x in (F.lit(d), F.lit(min(1.0, train_docs / m)))])[F.col("d")]
    some = marks.filter(few(F.xxhash64("id"), sizes))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = join_small(texts, some, ["id"], "inner", 24, "labels")
    # equal documents of a domain are one row with a count
    known = written(_worded(known, F.col("d")).select("d", _features(None).alias("f")).groupBy("d", "f").agg(F.count("*").alias("n")), "features")
    docs = {r["d"]: r for r in known.groupBy("d").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect()}
    live = sorted(docs)
    if not live:
        return Model(prior, [0.0] * k, {}, [])
    # an id that many documents share brings them all; here the sample is bounded again
    known = known.filter(few(F.xxhash64("f"), {d: r["m"] for d, r in docs.items()}))
    counts = known.select("d", "n", F.explode("f").alias("f")).groupBy("f").agg(*[F.sum(F.when(F.col("d") == d, F.col("n")).otherwise(0)).alias(f"n{d}") for d in live])
    sampled = {r["d"]: r["n"] for r in known.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    rate = {d: (F.col(f"n{d}") + 0.5) / (sampled.get(d, 0) + 1.0) for d in live}
    mean = sum([rate[d] for d in live[1:]], rate[live[0]]) / len(live)
    gain = F.lit(0.0)
    for d in live:
        gain = gain + rate[d] * F.log(rate[d] / mean) + (1 - rate[d]) * F.log((1 - rate[d]) / (1 - mean))
    # the features that say most about the domain, one short row each
    chosen = sorted(r["f"] for r in counts.withColumn("gain", gain).orderBy(F.desc("gain"), "f").limit(FEATURES).select("f").collect())
    at = F.transform(F.array_intersect("f", F.array(*[F.lit(c) for c in chosen])), lambda f: F.array_position(F.array(*[F.lit(c) for c in chosen]), f).cast("int"))
    rows = sorted((r["d"], r["at"], r["n"]) for r in known.select("d", F.array_sort(at).alias("at"), "n").collect())
    x, y, weight = np.zeros((len(rows), len(chosen) + 1)), np.zeros((len(rows), len(live))), np.zeros(len(rows))
    x[:, 0] = 1
    for i, (d, present, n) in enumerate(rows):
        x[i, present], y[i, live.index(d)], weight[i] = 1, 1, n * sizes[d] / sampled[d]
    w = logistic(x, y, weight)
    spread = lambda row: [float(row[live.index(d)]) if d in live else 0.0 for d in range(k)]
    return Model(prior, spread(w[0]), {c: spread(w[i]) for i, c in enumerate(chosen, 1)}, live)


def posteriors(df: DataFrame, model: Model, text: Column) -> DataFrame:
    """(row: a struct of df's columns, n_tokens, p_<domain>)."""
    k, text = len(DOMAINS), F.coalesce(text, F.lit(""))
    chosen = sorted(model.weights)
    names = F.array(*[F.lit(c) for c in chosen]) if chosen else F.array().cast("array<string>")
    out = _worded(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text.alias("text")), F.col("row"))
    out = out.select("row", F.size("w").cast("long").alias("n_tokens"), F.transform(_features(chosen), lambda f: F.array_position(names, f).cast("int")).alias("at"))
    tables = ["array(" + ",".join(f"{model.weights[f][d]:.6f}D" for f in chosen) + ")" if chosen else "array(0D)" for d in range(k)]
    start = ", ".join(f"{float(model.bias[d])!r}D AS s{d}" for d in range(k))
    step = ", ".join(f"s.s{d} + get({tables[d]}, i - 1) AS s{d}" for d in range(k))
    out = out.withColumn("s", F.expr(f"aggregate(at, struct({start}), (s, i) -> struct({step}))"))
    out = out.select("row", "n_tokens", *[F.when(F.col("n_tokens") > 0, F.col("s")[f"s{d}"]).otherwise(F.lit(float(model.prior[d]))).alias(f"s{d}") for d in range(k)])
    # a domain without labelled rows has its small prior for any text; without any labels all are alike
    live = model.live or list(range(k))
    top = F.greatest(*[F.col(f"s{d}") for d in live]) if len(live) > 1 else F.col(f"s{live[0]}")
    parts = {d: F.exp(F.col(f"s{d}") - top) for d in live}
    seen = sum(list(parts.values())[1:], parts[live[0]])
    parts |= {d: F.lit(math.exp(model.prior[d])) * seen for d in range(k) if d not in live}
    whole = sum([parts[d] for d in range(1, k)], parts[0])
    # some digits: documents of one rounded posterior are one row of the least squares
    out = out.withColumns({f"p_{name}": F.round(parts[d] / whole, 4) for d, name in enumerate(DOMAINS) if d != GOOD})
    out = out.withColumn(f"p_{DOMAINS[GOOD]}", F.round(1 - sum([F.col(f"p_{name}") for d, name in enumerate(DOMAINS) if d != GOOD], F.lit(0.0)), 4))
    return out.select("row", "n_tokens", *[f"p_{name}" for name in DOMAINS])


def _state(steps: list[list[float]], max_rate: float | None) -> Column:
    """Struct of r, the rate after accelerated projected steps, and y, the point where the next gradient is taken."""
    p = [F.col(f"p_{name}") for name in DOMAINS]
    project = lambda x: F.greatest(x if max_rate is None else F.least(x, F.lit(max_rate)), F.lit(0.0))
    first = F.lit(1.0 if max_rate is None else min(1.0, max_rate))
    start = F.struct(first.alias("r"), first.alias("y"))
    if not steps:
        return start
    rows = F.expr("array(" + ",".join("array(" + ",".join(f"{x:.17g}D" for x in s) + ")" for s in steps) + ")")

    def step(state: Column, s: Column) -> Column:
        moved = project(state["y"] + sum([p[d] * F.get(s, F.lit(d)) for d in range(1, len(p))], p[0] * F.get(s, F.lit(0))))
        return F.struct(moved.alias("r"), (moved + F.lit(MOMENTUM) * (moved - state["r"])).alias("y"))

    return F.aggregate(rows, start, step)


def fit_rates(table: DataFrame, targets: tuple[float, ...] = TARGETS, max_rate: float | None = 1.0, known: list[int] | None = None) -> tuple[list[list[float]], dict[str, list[float]]]:
    """(steps for _state, report of tokens, targets and what is reached); table has n_tokens and posteriors. known: the domains with labelled rows, all by default."""
    k = len(DOMAINS)
    names = [f"p_{name}" for name in DOMAINS]
    # a document's rate depends on its posterior only, so equal posteriors are added up first
    groups = written(table.groupBy(*names).agg(F.sum("n_tokens").cast("double").alias("n_tokens")), "posterior-groups")
    mass = [F.col("n_tokens") * F.col(name) for name in names]
    gram = groups.select([F.sum(mass[a] * F.col(names[b])).alias(f"{a}_{b}") for a in range(k) for b in range(k)] + [F.sum(m).alias(f"t{d}") for d, m in enumerate(mass)]).first()
    have = [float(gram[f"t{d}"] or 0) for d in range(k)]
    live = [d for d in range(k) if have[d] > 0 and (known is None or d in known)]
    if GOOD not in live:
        return [], {"tokens": have, "target": have, "reached": have if max_rate is None else [h * min(1.0, max_rate) for h in have]}
    want = [min(have[d], targets[d] / targets[GOOD] * have[GOOD]) if d in live else 0.0 for d in range(k)]
    total = sum(want)
    # the largest row sum bounds the largest eigenvalue of the scaled Gram matrix, so this step never overshoots
    bound = max(sum((gram[f"{a}_{b}"] or 0.0) / math.sqrt(have[a] * have[b]) for b in live) for a in live)

    def sums(steps: list[list[float]]) -> tuple[list[float], list[float]]:
        rows = groups.withColumn("s", _state(steps, max_rate))
        row = rows.select([F.sum(m * F.col("s")[x]).alias(f"{d}{x}") for x in ("r", "y") for d, m in enumerate(mass)]).first()
        values = [float(x or 0) for x in row]
        return values[:k], values[k:]

    steps: list[list[float]] = []
    reached, ahead = sums(steps)
    for _ in range(ITERATIONS):
        if max(abs(reached[d] - want[d]) for d in live) <= TOLERANCE * max(total, 1.0):
            break
        steps.append([(want[d] - ahead[d]) / have[d] / bound if d in live else 0.0 for d in range(k)])
        reached, ahead = sums(steps)
    return steps, {"tokens": have, "target": want, "reached": reached}


def _drawn(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, targets: tuple[float, ...], max_rate: float | None, seed: int, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, list[float]]]:
    """((row: a struct of df's columns or those of keep, n_tokens, posteriors, rate, copies), fit_rates' report)."""
    if targets[GOOD] <= 0:
        raise ValueError("the good domain needs a target: the others are shares of it")
    model = fit(df, labels, id_col, text_col)
    scored = posteriors(df, model, F.col(f"`{text_col}`"))
    # the draw is a hash of id and text
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("row")[id_col], F.col("row")[text_col]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    row = F.col("row") if keep is None else F.struct(*[F.col("row")[c].alias(c) for c in keep])
    scored = written(scored.select(row.alias("row"), "n_tokens", *[f"p_{d}" for d in DOMAINS], draw.alias("draw")), "posteriors")
    steps, told = fit_rates(scored, targets, max_rate, model.live)
    out = scored.withColumn("rate", _state(steps, max_rate)["r"])
    copies = (F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return out.withColumn("copies", copies).drop("draw"), told


def mixed(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: tuple[float, ...] = TARGETS, max_rate: float | None = 1.0, seed: int = 17) -> DataFrame:
    """df's columns with n_tokens, posteriors, rate and copies."""
    if clash := set(_RESULTS) & set(df.columns):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    out, _ = _drawn(df, labels, id_col, text_col, targets, max_rate, seed)
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns], *_RESULTS)


def sample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: tuple[float, ...] = TARGETS, max_rate: float | None = 1.0, seed: int = 17) -> DataFrame:
    """The mixture: the rows of df, all columns, each as often as its copies say."""
    out, _ = _drawn(df, labels, id_col, text_col, targets, max_rate, seed)
    out = out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns])


def report(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, posteriors, rate, copies) of every document; target_ and reached_ of each domain are its expected tokens, the same in all rows."""
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, told = _drawn(narrow, labels, "doc_id", "text", TARGETS, 1.0, 17, ["doc_id"])
    sums = [F.lit(float(told[what][d])).alias(f"{what}_{name}") for what in ("target", "reached") for d, name in enumerate(DOMAINS)]
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "n_tokens", *[f"p_{d}" for d in DOMAINS], F.round("rate", 6).alias("rate"), "copies", *sums)
