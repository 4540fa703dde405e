"""From responses to a balanced test: scenario profile, components, selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.operators import choose, factors, reshape, score, skills, stats
from itemspark.session import cut_lineage
from itemspark.sources.views import Study


@dataclass(frozen=True)
class MasterTest:
    scores: DataFrame           # taker, scenario, p
    correlations: DataFrame     # v1, v2, n, r
    loadings: DataFrame         # label, factor, loading
    strong: DataFrame           # factor, labels
    selection: DataFrame        # position, item, component, pole, ...
    matrix: DataFrame           # taker, position, item, component, y


def build(study: Study, parameters: DataFrame, blueprint: DataFrame, components: int = 7,
          min_per_scenario: int = 10, threshold: float = 0.4) -> MasterTest:
    """``parameters``: item, a.  ``blueprint``: component, pole, scenario, k."""
    spark = study.responses.sparkSession
    scores = cut_lineage(score.scenario_scores(study.responses, study.items, study.takers))
    correlations = stats.correlations(scores, "taker", "scenario", "p")
    labels, matrix, _ = factors.correlation_matrix(scores, "taker", "scenario", "p")
    loadings, _ = factors.column_components(spark, labels, matrix, min(components, len(labels)))
    profile = score.item_profile(study.responses, study.items, score.taker_count(study.takers))
    pool = profile.select("item", "scenario", "missing_count").join(
        parameters.select("item", "a"), "item")
    chosen = choose.balanced_items(pool, blueprint, min_per_scenario)
    selection = cut_lineage(reshape.selection_positions(chosen))
    return MasterTest(scores, correlations, loadings,
                      skills.strong_scenarios(loadings, "label", threshold), selection,
                      reshape.gather(study.responses, selection).filter(F.col("y").isNotNull()))
