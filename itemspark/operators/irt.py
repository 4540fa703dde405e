"""Item-response models as alternating Spark aggregations.

A model is two tables: ``items`` (model, item, a1..ak, d) and ``takers`` (model,
taker, t1..tk); the probability of a right answer is sigmoid(a . t - d).  One
step joins the cells with both tables and adds up gradients per item or per
taker, so a hot item or taker is combined map-side like any other sum.

Fits alternate bounded Newton steps per item and per taker (``tiles``) until likelihood
and projected gradients have settled; a fit that doesn't settle is an error, not a
result.  ``model`` lets many models (a sweep of dimensions) share every pass.  The single
steps ``item_step`` and ``taker_step`` use a separable quadratic model instead: every
parameter moves by gradient over its share of the curvature and is then clamped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.functions.scalars import dot, hash_normal, hash_uniform, log_likelihood, sigmoid
from itemspark.operators import parts, stats, tiles
from itemspark.operators.factors import varimax_turns
from itemspark.operators.moments import collect_matrix, dense_gram
from itemspark.operators.vectors import dims
from itemspark.session import cut_lineage, drop_staged

#: A fit has settled when a round changes the log-likelihood by less than this share,
TOLERANCE = 5e-4
#: and no projected gradient is larger than this for each cell of its item or taker.
GRADIENT = 0.02
#: Factor on the steps of the alternating fits; below 2.
RELAXATION = 1.5
#: A fit that hasn't settled after so many rounds raises.
MOST_ROUNDS = 500


# --- one dimension ---------------------------------------------------------

def normal_nodes(n: int = 21) -> tuple[list[float], list[float]]:
    """Gauss-Hermite nodes and weights for the standard normal distribution."""
    x, w = np.polynomial.hermite.hermgauss(n)
    return [float(v) for v in x * np.sqrt(2.0)], [float(v) for v in w / np.sqrt(np.pi)]


def expected_probability(z: Column, nodes: int = 21) -> Column:
    """Mean of sigmoid(theta + z) over theta ~ N(0, 1)."""
    x, w = normal_nodes(nodes)
    total = F.lit(0.0)
    for node, weight in zip(x, w):
        total = total + F.lit(weight) * sigmoid(z + F.lit(node))
    return total


def easiness_by_mean(items: DataFrame, limit: float = 12.0, halvings: int = 45) -> DataFrame:
    """Add ``z`` with E[sigmoid(theta + z)] = correct / asked, by bisection.

    The nuisance abilities do not depend on the data, so the first stage depends
    on an item only through its train mean: each distinct (correct, asked) pair
    is solved once.  Means of 0 and 1 end at the limits.
    """
    x, w = normal_nodes()
    nodes = F.arrays_zip(F.array(*map(F.lit, x)).alias("x"), F.array(*map(F.lit, w)).alias("w"))
    target = F.col("correct") / F.col("asked")

    def step(state, _):
        middle = (state["lo"] + state["hi"]) / 2
        mean = F.aggregate(nodes, F.lit(0.0), lambda s, n: s + n["w"] * sigmoid(middle + n["x"]))
        low = mean < target
        return F.struct(F.when(low, middle).otherwise(state["lo"]).alias("lo"),
                        F.when(low, state["hi"]).otherwise(middle).alias("hi"))
    begin = F.struct(F.lit(-limit).alias("lo"), F.lit(limit).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), begin, step)
    pairs = items.select("correct", "asked").distinct().withColumn("_s", found)
    solved = pairs.select("correct", "asked", ((F.col("_s.lo") + F.col("_s.hi")) / 2).alias("z"))
    return items.join(solved, ["correct", "asked"])


def fit_one_parameter(train: DataFrame, tolerance: float = 1e-8, ridge: float = 1e-3
                      ) -> tuple[DataFrame, DataFrame]:
    """Two-stage model sigmoid(theta + z): ``items`` (item, z), ``takers`` (taker, theta).

    Stage two is Newton's method with ``z`` fixed, until no ability moves by more than
    ``tolerance``.  ``ridge`` keeps takers with only right or only wrong answers finite.
    """
    sums = train.groupBy("item").agg(F.sum("y").alias("correct"), F.count("y").alias("asked"))
    items = cut_lineage(easiness_by_mean(sums))
    # equal z values of a taker are merged before the rounds
    merged = cut_lineage(train.join(items.select("item", "z"), "item").groupBy("taker", "z")
                         .agg(F.count("y").alias("n"), F.sum("y").alias("s")))
    takers = merged.select("taker").distinct().withColumn("theta", F.lit(0.0))
    for _ in range(MOST_ROUNDS):
        p = sigmoid(F.col("theta") + F.col("z"))
        moved = merged.join(takers, "taker").groupBy("taker").agg(
            F.max("theta").alias("old"), F.sum(F.col("s") - F.col("n") * p).alias("g"),
            F.sum(F.col("n") * p * (1 - p)).alias("h"))
        step = (F.col("g") - ridge * F.col("old")) / (F.col("h") + ridge)
        step = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step))       # Newton: not relaxed
        takers = cut_lineage(moved.select("taker", (F.col("old") + step).alias("theta"), step.alias("_step")))
        if (takers.agg(F.max(F.abs("_step"))).first()[0] or 0.0) < tolerance:
            return items, takers.drop("_step")
    raise RuntimeError(f"abilities still move after {MOST_ROUNDS} rounds")


def one_parameter_scores(cells: DataFrame, items: DataFrame, takers: DataFrame) -> DataFrame:
    return (cells.join(items.select("item", "z"), "item").join(takers, "taker")
            .withColumn("score", sigmoid(F.col("theta") + F.col("z"))))


# --- several dimensions ----------------------------------------------------

@dataclass(frozen=True)
class Model:
    items: DataFrame      # model, item, q1..qk, a1..ak, d
    takers: DataFrame     # model, taker, t1..tk
    k: int


def _logit(k: int) -> Column:
    return dot([F.col(c) for c in dims("a", k)], [F.col(c) for c in dims("t", k)]) - F.col("d")


def _joined(cells: DataFrame, model: Model) -> DataFrame:
    return (cells.join(model.items, "item").join(model.takers, ["model", "taker"]))


def model_scores(cells: DataFrame, model: Model) -> DataFrame:
    """Probability per model and cell, for the given cells only."""
    return _joined(cells, model).select("model", *cells.columns, sigmoid(_logit(model.k)).alias("score"))


def free_masks(items: DataFrame, k: int, models: list[int] | None = None) -> DataFrame:
    """q = 1 on the first ``model`` dimensions: unrestricted models of several sizes."""
    sizes = F.array(*[F.lit(m) for m in (models or [k])])
    table = items.select("item", F.explode(sizes).alias("model"))
    return table.select("model", "item", *[
        F.when(F.col("model") > d, 1.0).otherwise(0.0).alias(c) for d, c in enumerate(dims("q", k))])


def qmatrix_masks(qmatrix: DataFrame, factors: list[str]) -> DataFrame:
    """q from (item, factor) rows; the model number is the number of factors."""
    names = dims("q", len(factors))
    return qmatrix.groupBy("item").agg(*[
        F.max((F.col("factor") == f).cast("double")).alias(c) for f, c in zip(factors, names)]
    ).select(F.lit(len(factors)).alias("model"), "item", *names)


def nuisance_items(train: DataFrame, masks: DataFrame, k: int, a_min: float = 1e-6) -> DataFrame:
    """Optimum of the first stage under data-independent abilities: the smallest
    allowed discriminations and d = -logit(train mean)."""
    means = train.groupBy("item").agg(
        ((F.sum("y") + 0.5) / (F.count("y") + 1.0)).alias("_m"))
    a = [(F.col(q) * a_min).alias(c) for q, c in zip(dims("q", k), dims("a", k))]
    return (masks.join(means, "item", "left").na.fill(0.5, ["_m"])
            .select("model", "item", *dims("q", k), *a, F.log((1 - F.col("_m")) / F.col("_m")).alias("d")))


def start(train: DataFrame, takers: DataFrame, masks: DataFrame, k: int, theta_min: float | None,
          seed: int = 0) -> Model:
    """Reproducible start: a near 1 on allowed dimensions, small abilities, d from means."""
    first = nuisance_items(train, masks, k)
    a = [(F.col(q) * (0.5 + hash_uniform(["model", "item"], f"{seed}-a{d}"))).alias(c)
         for d, (q, c) in enumerate(zip(dims("q", k), dims("a", k)))]
    items = first.select("model", "item", *dims("q", k), *a, "d")
    models = [r[0] for r in masks.select("model").distinct().collect()]     # a few numbers
    table = takers.select("taker", F.explode(F.array(*map(F.lit, sorted(models)))).alias("model"))
    t = [0.5 * hash_normal(["model", "taker"], f"{seed}-t{d}") for d in range(k)]
    if theta_min is not None:
        t = [F.greatest(F.lit(theta_min), F.abs(x)) for x in t]
    people = table.select("model", "taker", *[x.alias(c) for x, c in zip(t, dims("t", k))])
    return Model(cut_lineage(items), cut_lineage(people), k)


def _sums(weights: list[Column], k: int, prefix: str) -> list[Column]:
    """Gradient, curvature and log-likelihood sums of one side, given the other side's
    values; a cell's curvature is dealt to the parameters by the size of their weights."""
    p = sigmoid(_logit(k))
    gap, bend = F.col("y") - p, p * (1 - p) * sum((F.abs(w) for w in weights), F.lit(1.0))
    out = [F.sum(gap).alias(f"{prefix}gd"), F.sum(bend).alias(f"{prefix}hd"),
           F.sum(log_likelihood(F.col("y"), p)).alias(f"{prefix}ll")]
    for i, w in enumerate(weights, 1):
        out += [F.sum(gap * w).alias(f"{prefix}g{i}"), F.sum(F.abs(w) * bend).alias(f"{prefix}h{i}")]
    return out


def _kept(step: Column, most: float = 2.0) -> Column:
    """A step, relaxed beyond 1 as the dealt-out curvature is too large, but not larger
    than ``most``, as it holds near the present value only."""
    return F.greatest(F.lit(-most), F.least(F.lit(most), RELAXATION * step))


def item_step(train: DataFrame, model: Model, a_min: float = 1e-6, ridge: float = 0.1) -> Model:
    """Move a and d of every item with the abilities fixed; masked a stay 0."""
    k = model.k
    weights = [F.col(t) * F.col(q) for t, q in zip(dims("t", k), dims("q", k))]
    sums = _joined(train, model).groupBy("model", "item").agg(*_sums(weights, k, "_"))
    table = model.items.join(sums, ["model", "item"], "left").na.fill(0.0)
    new = []
    for i, (a, q) in enumerate(zip(dims("a", k), dims("q", k)), 1):
        move = _kept((F.col(f"_g{i}") + ridge * (1 - F.col(a))) / (F.col(f"_h{i}") + ridge))
        new.append((F.greatest(F.lit(a_min), F.col(a) + move) * F.col(q)).alias(a))
    d = F.col("d") - _kept((F.col("_gd") + ridge * F.col("d")) / (F.col("_hd") + ridge))
    items = table.select("model", "item", *dims("q", k), *new, d.alias("d"))
    return Model(cut_lineage(items), model.takers, k)


def taker_step(train: DataFrame, model: Model, theta_min: float | None = 0.0,
               ridge: float = 1.0) -> Model:
    """Move the abilities with the items fixed; N(0, 1/ridge) prior.

    ``_ll`` in the new table is the log-likelihood of a taker's cells before the step.
    """
    k = model.k
    weights = [F.col(a) for a in dims("a", k)]
    sums = _joined(train, model).groupBy("model", "taker").agg(*_sums(weights, k, "_"))
    table = model.takers.drop("_ll").join(sums, ["model", "taker"], "left").na.fill(0.0)
    new = []
    for i, t in enumerate(dims("t", k), 1):
        x = F.col(t) + _kept((F.col(f"_g{i}") - ridge * F.col(t)) / (F.col(f"_h{i}") + ridge))
        new.append((x if theta_min is None else F.greatest(F.lit(theta_min), x)).alias(t))
    return Model(model.items, cut_lineage(table.select("model", "taker", *new, "_ll")), k)


def solve(train: DataFrame, begun: Model, tolerance: float = TOLERANCE, gradient: float = GRADIENT,
          theta_min: float | None = 0.0, a_min: float = 1e-6, move_items: bool = True,
          item_ridge: float = 0.1, taker_ridge: float = 1.0) -> Model:
    """The penalised optimum near ``begun``, by alternating bounded Newton steps.

    Cells are stored once as tiles and don't move.  A model has settled when a round
    changes its log-likelihood by at most ``tolerance`` of itself and no item's or taker's
    projected gradient exceeds ``gradient`` times its cells (and one for the prior).
    """
    k = begun.k
    models = sorted(r[0] for r in begun.items.select("model").distinct().collect())      # a few numbers
    columns = [*dims("q", k), *dims("a", k), "d"]
    used = begun.items.groupBy("model").agg(*[F.max(c).alias(c) for c in dims("q", k)]).collect()
    used_by = {models.index(r["model"]): [d for d, c in enumerate(dims("q", k)) if r[c] > 0] for r in used}
    own_i, own_t = begun.items.select("item").distinct(), begun.takers.select("taker").distinct()
    sums = 1 + sum((len(u) + 2) * (len(u) + 3) // 2 for u in used_by.values())
    size = tiles.block_size(train.where("y IS NOT NULL").count(), own_i.count(), own_t.count(), sums)
    places_i, places_t = tiles.blocks_of(own_i, "item", size), tiles.blocks_of(own_t, "taker", size)
    spark = train.sparkSession
    table = tiles.kept_tiles(tiles.stored_tiles(train, places_i, places_t))
    items = tiles.kept_state(tiles.packed_blocks(begun.items, places_i, "item", columns, models))
    takers = tiles.kept_state(tiles.packed_blocks(begun.takers, places_t, "taker", dims("t", k), models))
    shape, active = tiles.Shape(len(models), k), tuple(range(len(models)))
    before: dict[int, float] = {}
    paths: list[str] = []

    def unpacked(state, places, key, names):
        rows = spark.createDataFrame(state.map(lambda row: (row[0][0], row[1][0])), "block int, payload binary")
        return tiles.unpacked_blocks(rows, places, key, names, models)

    def told(side):
        return tiles.sent(table, items if side == "item" else takers, shape, side)

    old: list = []                              # states of the round before
    sent_items, sent_takers = told("item"), told("taker")
    try:
        for done in range(MOST_ROUNDS):
            was = [items, takers] if move_items else [takers]
            if move_items:
                items = tiles.step(table, items, sent_items, sent_takers, shape, active, "item", item_ridge, a_min, used_by, RELAXATION)
                sent_items = told("item")
            takers = tiles.step(table, takers, sent_items, sent_takers, shape, active, "taker", taker_ridge, theta_min, used_by,
                                RELAXATION if move_items else 1.0)
            sent_takers = told("taker")
            now, gap = tiles.progress(items if move_items else None, takers)
            if not done:
                parts.without_shuffles(table.rows)
            for state in was:                   # nothing reads what they were made of again
                parts.without_shuffles(state)
            for state in old:
                state.unpersist()
            old = was
            active = tuple(m for m in active if gap.get(m, 0.0) > gradient
                           or abs(now.get(m, 0.0) - before.get(m, float("inf"))) > tolerance * abs(now.get(m, 0.0)))
            before = now
            if not active:
                found = unpacked(items, places_i, "item", columns)
                return Model(found, unpacked(takers, places_t, "taker", dims("t", k)), k)
            if (done + 1) % parts.STORED == 0:
                last = paths
                for state in (items, takers) if move_items else (takers,):
                    parts.without_shuffles(state)
                if move_items:
                    items, path = parts.stored(items, spark, "items")
                    paths = [path]
                    sent_items = told("item")
                takers, path = parts.stored(takers, spark, "takers")
                paths = [path, *(paths if move_items else [])]
                sent_takers = told("taker")
                for state in old:
                    state.unpersist()
                old = []
                for path in last:
                    drop_staged(spark, path)
    finally:
        for kept in (table.rows, items, takers, *old):
            kept.unpersist()
        for path in paths:
            drop_staged(spark, path)
    raise RuntimeError(f"{len(active)} models have not settled after {MOST_ROUNDS} rounds")


def fit_joint(train: DataFrame, takers: DataFrame, masks: DataFrame, k: int, tolerance: float = TOLERANCE,
              theta_min: float | None = 0.0, a_min: float = 1e-6, seed: int = 0) -> Model:
    """Items and abilities together.  ``theta_min=None`` leaves abilities free."""
    return solve(train, start(train, takers, masks, k, theta_min, seed), tolerance, theta_min=theta_min, a_min=a_min)


def fit_nuisance(train: DataFrame, takers: DataFrame, masks: DataFrame, k: int, tolerance: float = TOLERANCE,
                 theta_min: float | None = 0.0, a_min: float = 1e-6) -> Model:
    """Two-stage variant: closed-form items, then abilities only."""
    begun = start(train, takers, masks, k, theta_min)
    begun = Model(cut_lineage(nuisance_items(train, masks, k, a_min)), begun.takers, k)
    return solve(train, begun, tolerance, theta_min=theta_min, move_items=False)


def projected_gradients(train: DataFrame, model: Model, theta_min: float | None = 0.0, a_min: float = 1e-6,
                        item_ridge: float = 0.1, taker_ridge: float = 1.0, move_items: bool = True) -> DataFrame:
    """How far a fit is from its optimum: model, side, key and gap, the largest gradient
    of an item's or taker's parameters for each of its cells (and one for the prior).  A
    parameter at its bound counts only if its gradient points away from the bound."""
    k = model.k
    joined = _joined(train, model)

    def side(table, key, weights, own, low, ridge, centre, name):
        sums = joined.groupBy("model", key).agg(F.count("*").alias("_n"), *_sums(weights, k, "_"))
        rows = table.join(sums, ["model", key], "left").na.fill(0.0).na.fill(0)
        gaps = []
        for i, c in enumerate(own, 1):
            g = F.col(f"_g{i}") + ridge * (centre - F.col(c))
            free = F.lit(True) if low is None else (F.col(c) > low) | (g > 0)
            gaps.append(F.when(free, F.abs(g)).otherwise(0.0) * (F.col(f"q{i}") if name == "items" else 1.0))
        if name == "items":
            gaps.append(F.abs(F.col("_gd") + ridge * F.col("d")))
        return rows.select("model", F.lit(name).alias("side"), F.col(key).cast("string").alias("key"),
                           (F.greatest(*gaps, F.lit(0.0)) / (F.col("_n") + 1)).alias("gap"))

    found = side(model.takers, "taker", [F.col(a) for a in dims("a", k)], dims("t", k), theta_min, taker_ridge, 0.0, "takers")
    if not move_items:
        return found
    weights = [F.col(t) * F.col(q) for t, q in zip(dims("t", k), dims("q", k))]
    return found.unionByName(side(model.items, "item", weights, dims("a", k), a_min, item_ridge, 1.0, "items"))


def rotate_items(model: Model) -> DataFrame:
    """Varimax of every model's discriminations (model number = its dimensions), then
    clamped at 0; the sums for all models come from one pass."""
    k = model.k
    turned = None
    for number, turn in sorted(varimax_turns(model.items, "model", "a", k).items()):
        full = np.zeros((k, k))
        full[:number, :number] = turn
        columns = [F.col(c) for c in dims("a", k)]
        a = [F.greatest(F.lit(0.0), dot(columns, [F.lit(float(w)) for w in full[:, d]])).alias(c)
             for d, c in enumerate(dims("a", k))]
        part = model.items.filter(F.col("model") == number).select(
            "model", "item", *dims("q", k), *a, "d")
        turned = part if turned is None else turned.unionByName(part)
    return turned


def fit_exploratory(train: DataFrame, items: DataFrame, takers: DataFrame, sizes: list[int],
                    tolerance: float = TOLERANCE, seed: int = 0) -> Model:
    """Unrestricted models of the given sizes in shared passes: joint fit with a >= 0,
    varimax per size, then the abilities again for the rotated items."""
    k = max(sizes)
    model = fit_joint(train, takers, free_masks(items, k, sizes), k, tolerance, 0.0, 0.0, seed)
    model = Model(cut_lineage(rotate_items(model)), model.takers, k)
    return solve(train, model, tolerance, move_items=False)


def evaluate(cells: DataFrame, model: Model, items: DataFrame, takers: DataFrame) -> DataFrame:
    """One row per model: AUC and score correlation on train and test, fit indices."""
    scored = cut_lineage(model_scores(cells, model).withColumn("score", F.round("score", 9)))
    def by_split(table, value, name):
        pick = [F.max(F.when(F.col("split") == s, F.col(value))).alias(f"{s}_{name}")
                for s in ("train", "test")]
        return table.groupBy("model").agg(*pick)
    areas = by_split(stats.auc(scored, groups=["model", "split"]), "auc", "auc")
    ctt = by_split(stats.ctt_correlation(scored, ["model", "split"]), "cttcorr", "cttcorr")
    n_items = items.agg(F.count(F.lit(1))).scalar()
    n_takers = takers.agg(F.count(F.lit(1))).scalar()
    fit = stats.fit_indices(scored.filter("split = 'train'"), n_items, n_takers, F.col("model"), ["model"])
    return (areas.join(ctt, "model").join(fit, "model")
            .select(F.col("model").alias("n_dimensions"), "train_auc", "test_auc", "train_cttcorr",
                    "test_cttcorr", "log_likelihood", "AIC", "BIC"))


def theta_table(model: Model, names: list[str]) -> DataFrame:
    """Abilities named by component: taker, component, theta."""
    entries = F.array(*[F.struct(F.lit(n).alias("component"), F.col(c).alias("theta"))
                        for n, c in zip(names, dims("t", model.k))])
    return model.takers.select("taker", F.explode(entries).alias("e")).select("taker", "e.*")


def item_table(model: Model) -> DataFrame:
    return model.items.select("item", F.array(*dims("a", model.k)).alias("a"), "d")


# --- fixed unit discriminations with a covariance penalty ------------------

def fit_penalised(cells: DataFrame, takers: DataFrame, masks: DataFrame, k: int, tolerance: float = 1e-3,
                  weight: float = 0.001, seed: int = 0) -> tuple[Model, DataFrame]:
    """Unit discriminations on the Q-matrix; loss = mean cross entropy plus ``weight``
    times the squared distance of the abilities' covariance to the identity.

    ``cells`` carry a ``split``; the whole train part is one batch.  Epochs end when
    one changes the train loss by less than ``tolerance`` of itself.  Returns the model
    and per epoch the train loss, test loss and test AUC.
    """
    train = cells.filter("split = 'train'")
    begun = start(train, takers, masks, k, None, seed)
    ones = [F.col(q).alias(a) for q, a in zip(dims("q", k), dims("a", k))]
    model = Model(cut_lineage(begun.items.select(
        "model", "item", *dims("q", k), *ones, hash_normal(["item"], f"{seed}-b").alias("d"))),
        cut_lineage(begun.takers.select("model", "taker", *[(F.col(c) * 2).alias(c) for c in dims("t", k)])), k)
    n_cells = train.count()
    history, before = None, float("inf")
    gradient, bound, penalty, mean = _penalty(model)
    for epoch in range(1, MOST_ROUNDS + 1):
        n = n_cells * weight
        weights = [F.col(a) for a in dims("a", k)]
        sums = _joined(train, model).groupBy("model", "taker").agg(*_sums(weights, k, "_"))
        table = model.takers.join(sums, ["model", "taker"], "left").na.fill(0.0)
        centred = [F.col(c) - F.lit(float(m)) for c, m in zip(dims("t", k), mean)]
        new = [(F.col(t) + _kept((F.col(f"_g{i + 1}") - n * dot(centred, [F.lit(float(v)) for v in gradient[:, i]]))
                / (F.col(f"_h{i + 1}") + n * bound + 1e-9))).alias(t) for i, t in enumerate(dims("t", k))]
        model = Model(model.items, cut_lineage(table.select("model", "taker", *new)), k)
        gaps = _joined(train, model).groupBy("model", "item").agg(
            F.sum(F.col("y") - sigmoid(_logit(k))).alias("_g"),
            F.sum(sigmoid(_logit(k)) * (1 - sigmoid(_logit(k)))).alias("_h"))
        moved = model.items.join(gaps, ["model", "item"], "left").na.fill(0.0)
        d = F.col("d") - _kept(F.col("_g") / (F.col("_h") + 1e-9))
        model = Model(cut_lineage(moved.select(*[c for c in model.items.columns if c != "d"], d.alias("d"))),
                      model.takers, k)
        scored = model_scores(cells, model)
        loss = scored.groupBy("split").agg(
            F.avg(-log_likelihood(F.col("y"), F.col("score"))).alias("loss"))
        areas = stats.auc(scored.withColumn("score", F.round("score", 9)), groups=["split"])
        pick = [F.max(F.when(F.col("split") == s, F.col(v))).alias(n_) for s, v, n_ in
                (("train", "loss", "train_loss"), ("test", "loss", "test_loss"), ("test", "auc", "test_auc"))]
        gradient, bound, penalty, mean = _penalty(model)
        row = cut_lineage(loss.join(areas, "split").agg(*pick).withColumn("epoch", F.lit(epoch))
                          .withColumn("penalty", F.lit(float(weight * penalty)))
                          .withColumn("train_loss", F.col("train_loss") + F.col("penalty")))
        history = row if history is None else history.unionByName(row)
        now = row.first()["train_loss"]
        if now is None or abs(now - before) <= tolerance * abs(now):
            return model, history
        before = now
    raise RuntimeError(f"the loss has not settled after {MOST_ROUNDS} epochs")


def _penalty(model: Model) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Gradient matrix, curvature bound and value of |cov(t) - I|^2, and the means."""
    k = model.k
    rows = model.takers.select(F.array(*dims("t", k), F.lit(1.0)).alias("v"))
    g = collect_matrix(dense_gram(rows, k + 1), k + 1)
    n, total = g[-1, -1], g[:-1, -1]
    mean = total / n
    cov = (g[:-1, :-1] - np.outer(total, mean)) / max(n - 1, 1)
    gap = cov - np.eye(k)
    scale = 4.0 / max(n - 1, 1)
    bound = scale * (np.abs(np.linalg.eigvalsh(gap)).max() + 2 * np.linalg.eigvalsh(cov).max())
    return scale * gap, bound, float((gap ** 2).sum()), mean


# --- all cells, and items from text ----------------------------------------

def full_grid(model: Model, block: int = 1024, salts: int = 32) -> DataFrame:
    """Probability of every taker and item, asked or not: (taker, item, p) rows.

    Both tables are cut into blocks; an item block meets every taker block through
    an equi-join on the block number, salted because there are few numbers, and a
    pair of blocks is one small matrix product.
    """
    from itemspark.operators.ranks import positions
    import pandas as pd
    k = model.k

    def blocks(table, key, values, name):
        numbered = positions(table, [F.col(key)], name="_p")
        number = ((F.col("_p") - 1) / block).cast("int").alias(name)
        return numbered.groupBy(number).agg(F.collect_list(
            F.struct(F.col(key).alias("key"), F.array(*values).alias("v"))).alias(f"{name}_rows"))
    people = cut_lineage(blocks(model.takers, "taker", dims("t", k), "tb"))
    tests = blocks(model.items, "item", dims("a", k) + ["d"], "ib")
    last = people.agg(F.max("tb")).scalar()
    salted = people.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    work = (tests.withColumn("tb", F.explode(F.sequence(F.lit(0), last)))
            .withColumn("salt", F.pmod(F.col("ib"), F.lit(salts)))
            .join(salted, ["tb", "salt"]).select("ib_rows", "tb_rows"))

    def multiply(frames):
        for frame in frames:
            for items, takers in zip(frame["ib_rows"], frame["tb_rows"]):
                a = np.array([r["v"] for r in items])
                t = np.array([r["v"] for r in takers])
                p = 1.0 / (1.0 + np.exp(-(a[:, :k] @ t.T - a[:, k:])))
                item = np.array([r["key"] for r in items], dtype=np.int64)
                taker = np.array([r["key"] for r in takers], dtype=np.int64)
                yield pd.DataFrame({"taker": np.tile(taker, len(item)), "item": np.repeat(item, len(taker)),
                                    "p": p.ravel()})
    return work.mapInPandas(multiply, "taker bigint, item bigint, p double")


def fit_text_regression(vectors: DataFrame, targets: DataFrame, width: int, k: int,
                        ridge: float = 1.0) -> np.ndarray:
    """Ridge regression of item vectors ``f1..fk`` on text vectors (item, embedding):
    coefficients of (1, embedding), from one pass of cross products."""
    rows = vectors.join(targets, "item").select(
        F.concat(F.array(F.lit(1.0)), "embedding", F.array(*dims("f", k))).alias("v"))
    g = collect_matrix(dense_gram(rows, 1 + width + k), 1 + width + k)
    penalty = ridge * np.eye(1 + width)
    penalty[0, 0] = 1e-9
    return np.linalg.solve(g[:1 + width, :1 + width] + penalty, g[:1 + width, 1 + width:])


def predict_text_regression(vectors: DataFrame, coefficients: np.ndarray) -> DataFrame:
    """Item vectors for (item, embedding) rows."""
    def value(d):
        weights = F.array(*[F.lit(float(w)) for w in coefficients[1:, d]])
        products = F.zip_with("embedding", weights, lambda x, w: x * w)
        return F.aggregate(products, F.lit(float(coefficients[0, d])), lambda s, x: s + x)
    return vectors.select("item", *[value(d).alias(f"f{d + 1}") for d in range(coefficients.shape[1])])

