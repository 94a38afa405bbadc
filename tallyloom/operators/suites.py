"""Named audit suites: which rules a kind of problem is checked by, over long tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tables import large

from . import checks, kinds_facilities, kinds_networks, kinds_production, kinds_rosters, kinds_routing, kinds_shops, kinds_stocks, rules  # noqa: F401  register their rules and checks
from .audit import RULES, rollup
from .kinds import kind_of


@dataclass(frozen=True)
class Suite:
    """rules, by name."""

    rules: tuple[str, ...]


#: Rules of each kind, over long tables that the caller makes; kinds.py has the checks that start from JSON.
SUITES: dict[str, Suite] = {
    "vrptw_md": Suite(("coverage", "capacity", "fleet", "clock", "declared")),
    "pdptw": Suite(("coverage", "pairing", "capacity", "clock", "declared")),
    "cvrp": Suite(("coverage", "capacity", "declared")),
    "vrp_coverage": Suite(("coverage",)),
    "tsp": Suite(("index", "coverage", "declared")),
    "single_machine": Suite(("coverage", "declared")),
    "critical_path": Suite(("precedence", "declared")),
    "train_composition": Suite(("coverage", "declared")),
    "parallel_machines": Suite(("coverage", "capacity", "declared")),
    "flow_shop": Suite(("coverage", "declared")),
    "cluster_nodes": Suite(("coverage", "capacity")),
    "fjsp_setup": Suite(("operations", "overlap", "setup", "blocked", "declared")),
    "fjsp": Suite(("operations", "overlap", "declared")),
    "job_shop": Suite(("operations", "overlap", "declared")),
    "nurse_roster": Suite(("staffing", "sequence", "runs", "blocks", "totals", "declared")),
    "nurse_small": Suite(("staffing", "sequence", "declared")),
    "role_roster": Suite(("staffing", "fit", "runs", "totals")),
    "meeting_rooms": Suite(("coverage", "fit", "overlap")),
    "gates": Suite(("coverage", "fit", "overlap", "declared")),
    "operating_rooms": Suite(("coverage", "fit", "overlap", "declared")),
    "multi_project": Suite(("precedence", "cumulative", "declared")),
    "rcpsp": Suite(("precedence", "cumulative", "declared")),
    "line_up": Suite(("index", "capacity", "fit")),
    "class_timetable": Suite(("coverage", "overlap", "fit")),
    "event_staff": Suite(("staffing", "fit", "declared")),
    "knapsack": Suite(("index", "capacity", "declared")),
    "knapsack_multi": Suite(("index", "linear", "declared")),
    "bin_packing": Suite(("coverage", "capacity", "declared")),
    "capital_budget": Suite(("budget", "prerequisites", "declared")),
    "strip_packing": Suite(("packing", "declared")),
    "network_flow": Suite(("arcs", "conservation", "declared")),
    "shortest_path": Suite(("path", "path_ends", "declared")),
    "min_cut": Suite(("index", "declared")),
    "spanning_tree": Suite(("bounds",)),
    "set_cover": Suite(("index", "set_cover", "declared")),
    "set_partition": Suite(("index", "partition", "declared")),
    "facility_cover": Suite(("radius", "declared")),
    "facility_location": Suite(("coverage", "capacity", "declared")),
    "assignment": Suite(("coverage", "capacity", "declared")),
    "assignment_lp": Suite(("bounds", "coverage")),
    "stable_matching": Suite(("coverage", "stable")),
    "quadratic_assignment": Suite(("coverage", "declared")),
    "independent_set": Suite(("index", "independent")),
    "clique": Suite(("index", "clique")),
    "vertex_cover": Suite(("index", "cover_edges")),
    "graph_colouring": Suite(("coverage", "colouring")),
    "unit_commitment": Suite(("levels", "capacity", "declared")),
    "workforce": Suite(("hiring", "stock", "declared")),
    "aggregate_plan": Suite(("stock", "supply", "declared")),
    "production_mix": Suite(("linear", "declared")),
    "lot_sizing": Suite(("stock", "capacity", "declared")),
    "newsvendor": Suite(("bounds", "declared")),
    "cash_management": Suite(("stock", "declared")),
    "facility_multi": Suite(("coverage", "stock", "capacity", "declared")),
    "facility_robust": Suite(("coverage", "scenario_outflow", "declared")),
    "facility_2ech": Suite(("coverage", "scenario_outflow", "declared")),
    "mcnd_surv": Suite(("arcs", "conservation", "path", "disjoint", "declared")),
    "mcnd": Suite(("arcs", "conservation", "declared")),
    "portfolio_cvar": Suite(("portfolio", "no_sale", "declared")),
    "portfolio": Suite(("portfolio", "no_sale", "declared")),
    "clsp": Suite(("capacity", "stock", "declared")),
    "prp_tw": Suite(("capacity", "stock", "match", "clock", "declared")),
    "prp": Suite(("capacity", "stock", "match", "declared")),
    "crew_pairing": Suite(("coverage", "duties", "declared")),
    "crew_pairing_seniority": Suite(("crews", "duties", "declared")),
    "cutting_1d": Suite(("patterns", "production", "declared")),
    "cutting_2d": Suite(("patterns", "production", "packing", "declared")),
}


def suite_of(payload: Column) -> Column:
    """The kind of an instance's JSON payload; null if none fits."""
    return kind_of(payload)


class MissingTable(Exception):
    """A rule asks for a table that is not there."""


class Tables(dict):
    def __missing__(self, name: str):
        raise MissingTable(name)


def run_suite(name: str, tables: dict[str, DataFrame], instances: DataFrame, totals: int | None = None) -> DataFrame:
    """(instance_id, feasible, violation_count, partial_score, messages, verified, suite) of instances (instance_id) under a suite.

    Rules whose tables are absent leave the instances unverified, as an unknown suite does; they are not violations. A table readable (instance_id,
    readable) tells which instances could be read: the others are unverified and feasible, and those that it lacks too. totals: constraints of an
    instance, by default one for each rule, or a column total of instances.
    """
    suite = SUITES.get(name)
    rules = suite.rules if suite else ()
    given = []
    for r in rules:
        try:
            given.append(RULES[r](Tables(tables)))
        except MissingTable:  # whatever else a rule raises is a fault of its own
            pass
    own = reduce(DataFrame.unionByName, given, no_violations(instances))
    x = instances if "total" in instances.columns else instances.withColumn("total", F.lit(totals or max(1, len(rules))))
    x = x.select(F.col("instance_id").cast("string").alias("instance_id"), "total")
    if "readable" in tables:
        x = x.join(tables["readable"].select(F.col("instance_id").cast("string").alias("instance_id"), "readable"), "instance_id", "left")
    verified = F.col("verified") & F.lit(bool(suite) and len(given) == len(rules))
    return rollup(own, x).withColumn("verified", verified).withColumn("suite", F.lit(name)).drop("total_constraints")


def no_violations(instances: DataFrame) -> DataFrame:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return instances.select(F.col("instance_id").cast("string").alias("instance_id"), text.alias("rule"), text.alias("entity"), number.alias("observed"), number.alias("limit")).where(F.lit(False))


SCORERS: dict[str, object] = {}


def scorer(core_type: str):
    """Registers a function from rows of a core type (instance_id, solution, ...) to (instance_id, cost)."""

    def add(f):
        SCORERS[core_type] = f
        return f

    return add


def score_costs(rows: DataFrame, fallback) -> DataFrame:
    """(instance_id, cost): each row by its core type's scorer, or by fallback where there is none or it gives null. rows: (instance_id, core_type, ...)."""
    parts = [f(rows.where(F.col("core_type") == name)).select("instance_id", F.col("cost").alias("own")) for name, f in SCORERS.items()]
    own = reduce(DataFrame.unionByName, parts) if parts else rows.select("instance_id", F.lit(None).cast("double").alias("own")).where(F.lit(False))
    x = rows.select("instance_id").join(large(own), "instance_id", "left").join(large(fallback(rows)), "instance_id", "left")
    return x.select("instance_id", F.coalesce("own", "cost").alias("cost"))
