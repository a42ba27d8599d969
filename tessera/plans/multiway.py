"""Conjunctive queries over named relations, and one entry point for all query languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def multiway_join(relations: dict[str, DataFrame], atoms: list[tuple[str, list[str]]], output: list[str]) -> DataFrame:
    """The distinct ``output`` variables for which every atom (relation, variables by position) holds.

    The order starts with the two atoms that share most variables and goes on
    with the atom that most variables of are bound, so an atom that closes a
    cycle filters at once; each join keeps only variables still needed. Null
    equals nothing. Atoms without a common variable raise, as they would be
    joined by a product.
    """

    def rows(atom: tuple[str, list[str]]) -> DataFrame:
        name, variables = atom
        df = relations[name].toDF(*[f"_{i}" for i in range(len(variables))])
        places: dict[str, list[int]] = {}
        for i, v in enumerate(variables):
            places.setdefault(v, []).append(i)
        for at in places.values():
            for i in at[1:]:
                df = df.where(F.col(f"_{at[0]}") == F.col(f"_{i}"))
        return df.select(*[F.col(f"_{at[0]}").alias(v) for v, at in places.items()]).distinct()

    if unknown := set(output) - {v for _, vs in atoms for v in vs}:
        raise ValueError(f"unbound variables: {sorted(unknown)}")
    left = list(atoms)
    first = max(range(len(left)), key=lambda i: (max((len(set(left[i][1]) & set(a[1])) for k, a in enumerate(left) if k != i), default=0), -i))
    start = left.pop(first)
    out, bound = rows(start), set(start[1])
    while left:
        best = max(range(len(left)), key=lambda i: (len(bound & set(left[i][1])), -len(set(left[i][1]) - bound), -i))
        atom = left.pop(best)
        common = sorted(bound & set(atom[1]))
        if not common:
            raise ValueError(f"{atom[0]} shares no variable with the other atoms")
        out = out.join(rows(atom), common, "left_semi" if set(atom[1]) <= bound else "inner")
        bound |= set(atom[1])
        needed = set(output).union(*[a[1] for a in left])
        if bound - needed:
            bound &= needed
            out = out.select(*sorted(bound)).distinct()
    return out.select(*output).distinct()


def run(spark: SparkSession, language: str, text: str, **data) -> DataFrame:
    """A query in any of the front ends' languages.

    ``data`` is what the language reads: ``tables`` (datalog, influxql, signal),
    ``nodes`` and ``edges`` (cypher, gremlin), ``triples`` (sparql), ``samples``
    and ``at_us`` (promql), ``graphql`` (a ``GraphQL``); SQL and CQL read
    temporary views, ``args`` are SQL's parameters.
    """
    from tessera.plans import cypher, datalog, gremlin, metrics, signal_language, sparql, sql

    languages = {
        "sql": lambda: sql.run_sql(spark, text, data.get("args")),
        "cql": lambda: metrics.run_cql(spark, text, data.get("keys")),
        "cypher": lambda: cypher.run_cypher(spark, text, data["nodes"], data["edges"]),
        "gremlin": lambda: gremlin.run_gremlin(text, data["nodes"], data["edges"]),
        "sparql": lambda: sparql.run_sparql(spark, text, data["triples"]),
        "datalog": lambda: datalog.run_datalog(spark, text, data["tables"]),
        "influxql": lambda: metrics.run_influx(text, data["tables"]),
        "promql": lambda: metrics.run_promql(text, data["samples"], data["at_us"]),
        "graphql": lambda: data["graphql"].run(text),
        "signal": lambda: signal_language.run_signal(spark, text, data["tables"]),
    }
    if language.lower() not in languages:
        raise ValueError(f"unknown language {language}; known: {', '.join(sorted(languages))}")
    return languages[language.lower()]()
