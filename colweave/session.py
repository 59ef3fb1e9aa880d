"""Sessions: prepared programs over a Spark session."""

from __future__ import annotations

import json
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .plans.program import Program, Result, prepare
from .plans.serial import to_json
from .plans.sql import parse


def create(master: str | None = None, **conf: str) -> SparkSession:
    """A Spark session with the settings the engine rests on; cluster settings come from the environment."""
    builder = SparkSession.builder.appName("colweave").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


class Prepared:
    """A program bound to an input; run() repeats it, on another input if one is given with the same types."""

    def __init__(self, program: Program, df: DataFrame, **inputs) -> None:
        self.program, self.df, self.inputs = program, df, inputs
        self.planned, self.runs = program.plan(df, **inputs), 0

    def run(self, df: DataFrame | None = None, **inputs) -> Result:
        if df is not None and [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in self.df.schema]:
            raise TypeError("the input's columns differ from those prepared")
        self.runs += 1
        if df is None and not inputs:
            return replace(self.planned).check()
        return self.program.run(df if df is not None else self.df, **(self.inputs | inputs))


class Session:
    """Runs and prepares programs, given as trees or as text; programs given as text are parsed once."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.parsed: dict[str, Program] = {}
        self.prepared: list[Prepared] = []
        self.counts = {"parsed": 0, "reused": 0, "runs": 0}
        prepare(spark)

    def program(self, source: Program | str) -> Program:
        if not isinstance(source, str):
            return source
        if source in self.parsed:
            self.counts["reused"] += 1
        else:
            self.parsed[source] = parse(source)
            self.counts["parsed"] += 1
        return self.parsed[source]

    def run(self, source: Program | str, df: DataFrame, **inputs) -> Result:
        self.counts["runs"] += 1
        return self.program(source).run(df, **inputs)

    def prepare(self, source: Program | str, df: DataFrame, **inputs) -> Prepared:
        self.prepared.append(Prepared(self.program(source), df, **inputs))
        return self.prepared[-1]

    def release(self, prepared: Prepared) -> None:
        """Forget one prepared program."""
        self.prepared = [p for p in self.prepared if p is not prepared]

    def clear(self) -> None:
        """Forget all prepared programs and parsed texts."""
        self.prepared, self.parsed = [], {}

    def statistics(self) -> dict[str, int]:
        """Texts parsed and reused, programs run and prepared, and runs of those that are prepared."""
        return self.counts | {"prepared": len(self.prepared), "prepared_runs": sum(p.runs for p in self.prepared)}

    def inspect(self, source: Program | str, df: DataFrame, **inputs) -> str:
        return self.program(source).inspect(df, **inputs)

    def bug_report(self, source: Program | str, df: DataFrame, **inputs) -> dict[str, str]:
        """What someone else needs to see the same: versions, the input's schema, the program as JSON and Spark's plans, no data."""
        program = self.program(source)
        return {
            "spark": self.spark.version,
            "python": sys.version.split()[0],
            "schema": df.schema.json(),
            "program": to_json(program),
            "plan": program.inspect(df, **inputs),
            "statistics": json.dumps(self.statistics()),
        }
