"""Rounding where a source is said to have very many rows."""

from motifloom.llm import mixing


def test_rounding_of_a_huge_source(spark):
    units = spark.range(200).selectExpr("'a' as source", "cast(id as string) as id", "double(1 + id % 7) as w", "0.25D as p", "1000000000L as n")
    rows = mixing.rounded(units, 1_000_000_000, chunk=512).collect()
    assert sorted(int(r["id"]) for r in rows) == list(range(200))
    taken = sum(r["extra"] * (1 + int(r["id"]) % 7) for r in rows)
    assert abs(taken - 0.25 * sum(1 + i % 7 for i in range(200))) <= 3.5 + 1e-6
