"""End-to-end jobs over files, the shape a user of the reference runs:

* :func:`build_analysis` — raw per-hazard files → analysis table (E1 yearly,
  E4 binned), written as parquet or CSV;
* :func:`train_and_predict` — analysis table → feature table, composite
  index, forecast rows and feature importance, with the read-or-build cache
  (E2);
* :func:`page_views` — the interactive page's queries (E3) as DataFrames.

Paths are parameters: ``RawPaths`` names the files of each hazard.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (DAMAGE_COLUMNS, EXCLUDED_ENTITIES, HAZARDS, PER_CAPITA_AFFECTED,
                      PER_CAPITA_DEATH, TOTAL_AFFECTED_COLUMN, TOTAL_DEATHS_COLUMN)
from ..operators.joins import join_on_keys
from ..operators.reshape import union_rows
from ..session import stage
from ..sources import io as IO
from . import analysis as A
from . import builders as B
from . import features as FE
from . import model as M
from . import views as V


@dataclass
class RawPaths:
    """File paths per hazard (keys: ``flood, drought, storms, extreme_temp``)."""
    per_capita_affected: dict[str, str]
    per_capita_death: dict[str, str]
    total_affected: dict[str, str]
    total_deaths: dict[str, str]
    damage: str
    affected_headers: dict[str, str] = field(default_factory=lambda: dict(PER_CAPITA_AFFECTED))
    death_headers: dict[str, str] = field(default_factory=lambda: dict(PER_CAPITA_DEATH))
    total_affected_columns: dict[str, str] = field(
        default_factory=lambda: dict(TOTAL_AFFECTED_COLUMN))
    total_deaths_columns: dict[str, str] = field(
        default_factory=lambda: dict(TOTAL_DEATHS_COLUMN))

    @classmethod
    def from_json(cls, path: str) -> RawPaths:
        with open(path) as fh:
            return cls(**json.load(fh))


def read_measures(spark: SparkSession, raw: RawPaths, how: str = "full",
                  totals: bool = False) -> DataFrame:
    """Read every hazard's affected and death files, tag them with the hazard
    and join the two families once on (country, year, hazard) (J1 full / J2
    inner): rows ``(country, year, hazard, affected, death)``. The loop runs
    over the four hazards, each a lazy read."""
    affected, death = [], []
    for h in HAZARDS:
        if totals:
            aff = IO.read_total(spark, raw.total_affected[h],
                                raw.total_affected_columns[h], "affected")
            dth = IO.read_total(spark, raw.total_deaths[h],
                                raw.total_deaths_columns[h], "death")
        else:
            aff = IO.read_measure(spark, raw.per_capita_affected[h], "Country name",
                                  "Year", raw.affected_headers[h], "affected")
            dth = IO.read_measure(spark, raw.per_capita_death[h], "Country name",
                                  "Year", raw.death_headers[h], "death")
        affected.append(aff.withColumn("hazard", F.lit(h)))
        death.append(dth.withColumn("hazard", F.lit(h)))
    return join_on_keys(union_rows(affected), union_rows(death),
                        ["country", "year", "hazard"], how).select(
        "country", "year", "hazard", "affected", "death")


def read_damage(spark: SparkSession, raw: RawPaths) -> DataFrame:
    """Wide damage file → ``country, year, <hazard columns>``."""
    w = IO.read_wide_damage(spark, raw.damage, DAMAGE_COLUMNS)
    return w.select(F.col("Entity").alias("country"), F.col("Year").alias("year"),
                    *DAMAGE_COLUMNS)


def build_analysis(spark: SparkSession, raw: RawPaths, binned: bool = False,
                   out: str | None = None, fmt: str = "parquet") -> DataFrame:
    """E1 (yearly: full joins) or E4 (5-year bins: inner joins, left
    assembly): per-capita files feed the impacts, total-count files the
    totals. Written to ``out`` when given (full overwrite)."""
    how = "inner" if binned else "full"
    impact_m = read_measures(spark, raw, how, totals=False)
    total_m = read_measures(spark, raw, how, totals=True)
    damage = read_damage(spark, raw)
    if binned:
        table = A.analysis_set_binned(impact_m, damage, total_measures=total_m)
    else:
        table = A.analysis_set_yearly(impact_m, damage, total_measures=total_m)
    if out:
        IO.write_table(table, out, fmt=fmt)
        return IO.read_table(spark, out) if fmt == "parquet" else table
    return table


def build_totals(spark: SparkSession, raw: RawPaths, binned: bool = False) -> DataFrame:
    """The per-hazard totals table (C4) the page's share view reads."""
    how = "inner" if binned else "full"
    return B.totals_table(B.merge_totals(B.hazard_total(
        read_measures(spark, raw, how, totals=True), period_size=5 if binned else None)))


def train_and_predict(spark: SparkSession, analysis: DataFrame, out_dir: str,
                      cutoff: int = 2023, lo: int = 2020, hi: int = 2025,
                      n_iter: int = 20, use_cache: bool = True,
                      excluded=EXCLUDED_ENTITIES) -> dict[str, DataFrame]:
    """Features → composite index → forecast → re-scored rows and
    importance, published together under ``out_dir`` and reused while the analysis
    table and the parameters stay the same."""
    paths = {"predictions": f"{out_dir}/predictions", "importance": f"{out_dir}/importance"}

    def build() -> dict[str, DataFrame]:
        # Read by the statistics, the medians, the training rows and the result.
        ft = stage(FE.feature_table(analysis, cutoff, excluded), "features")
        stats = FE.component_stats(ft, cutoff)
        cli = FE.apply_components(ft, stats)
        pin = FE.prediction_input(cli, cutoff, lo, hi)
        pred, imp, _, _ = M.forecast(spark, cli, pin, cutoff, n_iter=n_iter)
        scored = FE.score_latest(pred.drop(*FE.COMPONENTS, "CLI"), stats, excluded)
        return {"predictions": scored, "importance": imp}
    inputs = IO.fingerprint([analysis], (cutoff, lo, hi, n_iter, list(excluded)))
    return IO.read_or_build(spark, paths, build, use_cache, inputs)


def page_views(analysis: DataFrame, totals: DataFrame,
               predictions: DataFrame | None = None,
               importance: DataFrame | None = None) -> dict[str, DataFrame]:
    """The page's queries, for every period / entity at once."""
    views = {
        "period_bounds": V.selected_period(analysis),
        "period_ranking": V.period_ranking(analysis),
        "dominant_hazard": V.dominant_hazard(analysis),
        "entity_trend": V.entity_trend(analysis),
        "hazard_share": V.hazard_share(totals),
    }
    if predictions is not None:
        views["ranked_scores"] = V.rank_scores(predictions)
        views["top20"] = V.top_scores(views["ranked_scores"], 20)
    if importance is not None:
        views["top_importance"] = importance.orderBy(F.col("importance").desc()).limit(10)
    return views


def main(argv: list[str] | None = None) -> None:
    """``python -m perilscope.plans.jobs build|train --paths raw.json --out DIR``"""
    from ..session import local_session
    ap = argparse.ArgumentParser(prog="perilscope")
    ap.add_argument("job", choices=["build", "build-binned", "train"])
    ap.add_argument("--paths", help="JSON file with RawPaths fields (build)")
    ap.add_argument("--analysis", help="analysis table (train)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--master", default="local[*]")
    a = ap.parse_args(argv)
    spark = local_session(a.master.removeprefix("local[").removesuffix("]") or "*") \
        if a.master.startswith("local") else SparkSession.builder.master(a.master).getOrCreate()
    if a.job in ("build", "build-binned"):
        build_analysis(spark, RawPaths.from_json(a.paths), binned=a.job == "build-binned",
                       out=a.out)
    else:
        train_and_predict(spark, IO.read_table(spark, a.analysis), a.out)


if __name__ == "__main__":
    main()
