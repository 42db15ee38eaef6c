"""Scores of texts by the SQL that the scoring queries are compared with."""

import duckdb

from foliomill.plans.oracles import scoring


def sql_scores(cases):
    """(accuracy, completeness, weighted score) of each (text, ext, size)."""
    connection = duckdb.connect()
    connection.execute("CREATE TABLE src(k BIGINT, t VARCHAR, ext VARCHAR, length BIGINT)")
    connection.executemany("INSERT INTO src VALUES (?, ?, ?, ?)", [(k, *case) for k, case in enumerate(cases)])
    found = connection.execute(f"WITH {scoring('src')} SELECT accuracy, completeness, weighted_score FROM scores ORDER BY k")
    return found.fetchall()
