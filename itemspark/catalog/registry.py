"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Named pieces of check SQL, in dependency order.
PIECES = {
    "responses": """
        SELECT l_suppkey AS taker, l_partkey AS item,
               MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y
        FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "items": """
        SELECT p_partkey AS item, p_name AS input_text, p_type AS scenario, p_brand AS benchmark
        FROM part""",
    "takers": "SELECT s_suppkey AS taker, s_name AS name FROM supplier",
    "named_items": """
        SELECT item, input_text, benchmark,
               CASE scenario WHEN 'ECONOMY' THEN 'mmlu' WHEN 'SMALL' THEN 'legalbench'
                             WHEN 'LARGE' THEN 'air_bench_2024' WHEN 'MEDIUM' THEN 'med_qa'
                             WHEN 'PROMO' THEN 'thai_exam' ELSE 'not_listed' END AS scenario
        FROM items""",
    "params": "SELECT p_partkey AS item, p_retailprice / 1000 AS a, p_size / 25e0 AS d FROM part",
    "loadings": """
        SELECT vec_id AS item, UNNEST(generate_series(0, LEN(embedding) - 1)) AS factor,
               CAST(UNNEST(embedding) AS DOUBLE) AS loading
        FROM embeddings""",
    "n": "SELECT COUNT(*) AS n_takers FROM takers",
    "profile": """
        SELECT i.*, COALESCE(c.asked, 0) AS asked, COALESCE(c.correct, 0) AS correct,
               n_takers - COALESCE(c.asked, 0) AS missing_count,
               COALESCE(c.asked, 0) / CAST(n_takers AS DOUBLE) AS response_rate
        FROM items i CROSS JOIN n
        LEFT JOIN (SELECT item, COUNT(*) AS asked, CAST(SUM(y) AS BIGINT) AS correct
                   FROM responses GROUP BY item) c ON c.item = i.item""",
    "scores": """
        SELECT t.taker, s.scenario, COALESCE(c.correct, 0) / CAST(s.n_items AS DOUBLE) AS p
        FROM takers t
        CROSS JOIN (SELECT scenario, COUNT(*) AS n_items FROM items GROUP BY scenario) s
        LEFT JOIN (SELECT r.taker, i.scenario, SUM(r.y) AS correct
                   FROM responses r JOIN items i ON i.item = r.item
                   GROUP BY r.taker, i.scenario) c
               ON c.taker = t.taker AND c.scenario = s.scenario""",
    "observed": """
        SELECT r.taker, i.scenario, i.benchmark, AVG(r.y) AS p
        FROM responses r JOIN items i ON i.item = r.item
        GROUP BY r.taker, i.scenario, i.benchmark""",
    "split": """
        SELECT *, CASE WHEN SUBSTR(MD5(CONCAT(taker, '|', item, '|42')), 1, 8) < 'cccccccc'
                       THEN 'train' ELSE 'test' END AS split
        FROM responses""",
    "score_corr": """
        SELECT x.scenario AS v1, z.scenario AS v2, CORR(x.p, z.p) AS r
        FROM scores x JOIN scores z ON z.taker = x.taker GROUP BY x.scenario, z.scenario""",
    "bar": """
        SELECT GREATEST(0.1, LEAST(0.2, MAX(ABS(loading)) * 0.5)) AS threshold FROM loadings""",
    "sized": """
        SELECT l.*, ABS(loading) AS size,
               ROW_NUMBER() OVER (PARTITION BY factor ORDER BY ABS(loading) DESC, item) AS place,
               COUNT(*) FILTER (WHERE ABS(loading) > threshold) OVER (PARTITION BY factor) AS n_strong,
               threshold
        FROM loadings l CROSS JOIN bar""",
    "described": """
        SELECT s.item, s.factor, s.loading, s.size, i.scenario FROM sized s
        JOIN named_items i ON i.item = s.item
        WHERE size > threshold OR (n_strong = 0 AND place <= 3)""",
    "factor_scenarios": """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY factor
                                     ORDER BY n DESC, mean_loading DESC, scenario) AS place,
               n * 100.0 / SUM(n) OVER (PARTITION BY factor) AS percent
        FROM (SELECT factor, scenario, COUNT(*) AS n, AVG(size) AS mean_loading
              FROM described GROUP BY factor, scenario)""",
    "skills": """
        SELECT factor, top_scenario,
               CASE WHEN top_scenario LIKE '%mmlu%' THEN 'General Knowledge'
                    WHEN top_scenario LIKE '%legal%' THEN 'Legal Reasoning'
                    WHEN top_scenario LIKE '%med%' THEN 'Medical Knowledge'
                    WHEN second IS NULL THEN 'Mixed Skills'
                    ELSE CONCAT(t1.title, '-', t2.title, ' Skills') END AS skill
        FROM (SELECT factor, MAX(CASE WHEN place = 1 THEN scenario END) AS top_scenario,
                     MAX(CASE WHEN place = 2 THEN scenario END) AS second
              FROM factor_scenarios GROUP BY factor) f
        LEFT JOIN titles t1 ON t1.scenario = top_scenario
        LEFT JOIN titles t2 ON t2.scenario = second""",
    "assigned": """
        SELECT item, ARG_MAX(factor, (size, -factor)) AS factor, MAX(size) AS max_loading
        FROM sized WHERE size > threshold OR (n_strong = 0 AND place <= 10) GROUP BY item""",
    "members": """
        SELECT item, factor, loading, CASE WHEN ABS(loading) >= 0.01 THEN 1 ELSE 0 END AS member
        FROM loadings""",
    "meta": """
        SELECT item, COALESCE(STRING_AGG('Factor_' || factor, ',' ORDER BY factor)
                              FILTER (WHERE member = 1), '') AS assigned_factors,
               CAST(SUM(member) AS BIGINT) AS num_factors, MAX(ABS(loading)) AS max_loading,
               'Factor_' || ARG_MAX(factor, (ABS(loading), -factor)) AS primary_factor
        FROM members GROUP BY item""",
    "cell_scores": """
        SELECT c.*, i.scenario,
               1 / (1 + EXP(-(s.p * q.a - q.d))) AS score
        FROM split c JOIN items i ON i.item = c.item JOIN params q ON q.item = c.item
        JOIN scores s ON s.taker = c.taker AND s.scenario = i.scenario""",
}
PIECES_TITLES = """
        SELECT * FROM (VALUES ('mmlu', 'Mmlu'), ('legalbench', 'Legalbench'),
            ('air_bench_2024', 'Air Bench 2024'), ('med_qa', 'Med Qa'),
            ('thai_exam', 'Thai Exam'), ('not_listed', 'Not Listed')) v(scenario, title)"""
PIECES = {"titles": PIECES_TITLES} | PIECES


def full_sql(body: str, extra: str = "") -> str:
    """Put the shared pieces (and the query's own) in front of its SELECT."""
    parts = [f"{name} AS ({textwrap.dedent(text).strip()})" for name, text in PIECES.items()]
    if extra:
        parts.append(textwrap.dedent(extra).strip())
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + textwrap.dedent(body).strip()


def query(name: str, sql: str | None = None, extra: str = ""):
    """Register a query; ``sql`` is the equivalent DuckDB text, when there is one."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = full_sql(sql, extra)
        return function
    return register
