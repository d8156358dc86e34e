"""A book of queries: functions of (spark, sf_dir) by name, each with the DuckDB SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

#: The catalog's tables over the driver's, for use after WITH in oracle SQL.
CATALOG = """
cities AS (SELECT n_nationkey::BIGINT AS city_id, n_name AS city_name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey),
venues AS (SELECT c_custkey::BIGINT AS venue_id, c_name AS venue_name, c_nationkey::BIGINT AS city_id, c_mktsegment AS venue_type, CASE WHEN c_acctbal >= 0 THEN 'https://venue.example/' || c_custkey END AS website_url FROM customer),
ev AS (SELECT o_orderkey::BIGINT AS event_id, o_custkey::BIGINT AS venue_id, o_orderdate::DATE AS start_date, o_totalprice AS price, o_orderpriority AS scrape_source, CASE WHEN o_orderstatus = 'P' THEN 'Sports' END AS sport FROM orders),
types AS (SELECT p_partkey::BIGINT AS type_id, p_name AS type_name, p_type AS category FROM part),
bridge AS (SELECT DISTINCT l_orderkey::BIGINT AS event_id, l_partkey::BIGINT AS type_id FROM lineitem),
artists AS (SELECT event_id, s_name AS artist_name FROM (SELECT l_orderkey::BIGINT AS event_id, min(l_suppkey) AS s FROM lineitem GROUP BY 1) JOIN supplier ON s = s_suppkey),
taxonomy AS (SELECT city_name AS sub_genre, country AS parent_genre FROM cities),
genres AS (SELECT lower(s_name) AS normalized_name, CASE WHEN s_suppkey % 7 = 0 THEN 'UNKNOWN' ELSE n.n_name END AS primary_genre, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 7 <> 0 THEN o.n_name END AS secondary_1, NULL::VARCHAR AS secondary_2
  FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey LEFT JOIN nation o ON o.n_nationkey = (s_nationkey + 7) % 25 WHERE s_suppkey % 3 <> 0),
matches AS (SELECT event_id, CASE WHEN sport IS NOT NULL THEN 'League ' || (event_id % 3) || ' - ' || city_name || ' Reds vs ' || country || ' Blues' ELSE type_name END AS event_name, CASE WHEN sport IS NOT NULL THEN city_name || ' Reds' END AS home_team, CASE WHEN sport IS NOT NULL THEN country || ' Blues' END AS away_team
  FROM ev JOIN venues USING (venue_id) JOIN cities USING (city_id) LEFT JOIN (SELECT event_id, min(type_id) AS type_id FROM bridge GROUP BY 1) USING (event_id) LEFT JOIN types USING (type_id)),
logs AS (SELECT event_id::BIGINT AS log_id, event_type AS job_name, user_id::BIGINT AS detail, ts AS started_at, trunc(value)::BIGINT AS events_found FROM events)
"""


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None, catalog: bool = True):
        """Registers a function under its own name."""

        def put(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = (f"WITH {CATALOG.strip()}\n{sql}" if not sql.lstrip().startswith(",") else f"WITH {CATALOG.strip()}{sql}") if catalog else sql
            return f

        return put
