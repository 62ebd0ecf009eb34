"""Names, weights and thresholds shared by all operators.

Everything here is a parameter default: every operator takes column names and
lists as arguments, so the same code runs on any entity / period / measure set.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# These must equal the reference's for the same results.
# ---------------------------------------------------------------------------

# Hazards in impact-column order; totals spell the storm hazard "storm".
HAZARDS = ["flood", "drought", "storms", "extreme_temp"]
TOTAL_NAMES = {"flood": "flood", "drought": "drought", "storms": "storm",
               "extreme_temp": "extreme_temp"}
# Order in which the totals table is merged and summed.
TOTAL_ORDER = ["extreme_temp", "drought", "flood", "storms"]
# Hazard columns of the wide economic-damage table, in melt order.
DAMAGE_COLUMNS = ["drought", "flood", "storm", "extreme_temp"]

# Column headers of the per-hazard input files.
PER_CAPITA_AFFECTED = {
    "drought": "Total number of people affected by drought per 100,000",
    "flood": "Total number of people affected by floods per 100,000",
    "storms": "Total number of people affected by storms per 100,000",
    "extreme_temp": "Total number of people affected by extreme temperatures per 100,000",
}
PER_CAPITA_DEATH = {
    "drought": "Death rates from drought",
    "flood": "Death rates from floods",
    "storms": "Death rates from storms",
    "extreme_temp": "Death rates from extreme temperatures",
}
TOTAL_AFFECTED_COLUMN = {
    "drought": "total_affected_drought",
    "flood": "total_affected_flood",
    "storms": "total_affected_storm",
    "extreme_temp": "total_affected_temperature",
}
TOTAL_DEATHS_COLUMN = {
    "drought": "deaths_drought",
    "flood": "deaths_flood",
    "storms": "deaths_storm",
    "extreme_temp": "deaths_temperature",
}

# Aggregate rows that are not countries; removed on the forecast path only.
EXCLUDED_ENTITIES = [
    "Asia", "Africa", "Europe", "North America", "South America", "Oceania",
    "USSR", "Soviet Union", "Czechoslovakia", "Yugoslavia",
    "World", "Low-income countries", "Lower-middle-income countries",
    "Upper-middle-income countries", "High-income countries",
    "European Union", "EU",
]

# Composite index: human burden, persistence, climate intensity, structural.
CLI_WEIGHTS = [0.50, 0.25, 0.15, 0.10]

# Risk buckets over a dense rank: upper bounds and labels, then the rest.
RISK_BOUNDS = [10, 20, 50, 100]
RISK_LABELS = ["1-10", "11-20", "21-50", "51-100"]
RISK_REST = ">100"

# Dominant-hazard labels per impact column.
DOMINANT_LABELS = {
    "flood_impact": "Flood-prone",
    "drought_impact": "Drought-prone",
    "storms_impact": "Storm-prone",
    "extreme_temp_impact": "Extreme-temperature-prone",
}

# Hazard-share labels per totals column.
SHARE_LABELS = {
    "Floods": "flood_total_affected",
    "Droughts": "drought_total_affected",
    "Storms": "storm_total_affected",
    "Extreme Temperature": "extreme_temp_total_affected",
}

# Selectable period range of the ranking view.
PERIOD_CLAMP = (1960, 2020)

# Forecast feature sets.
FEATURES_IMPROVED = [
    "flood_impact", "drought_impact", "storms_impact", "extreme_temp_impact",
    "climate_impact_index", "country_mean_impact", "impact_lag1",
    "impact_3yr_avg", "impact_trend_5yr", "impact_std_5yr",
    "country_recent_deviation", "log_total_affected", "log_total_death",
    "log_total_affected_3yr_avg", "log_total_death_3yr_avg",
    "absolute_impact_trend", "hazard_count", "economic_damage_pct_gdp",
]
FEATURES_BINNED = [
    "country_mean_impact", "impact_lag1", "flood_impact", "drought_impact",
    "storms_impact", "extreme_temp_impact", "hazard_count",
    "economic_damage_pct_gdp",
]
FEATURES_CONTINUOUS = [
    "country_mean_impact", "flood_impact", "drought_impact", "storms_impact",
    "extreme_temp_impact", "hazard_count", "economic_damage_pct_gdp",
]
TARGET = "impact_rebased_next"

# Search spaces of the forecast and the model bake-off (fixed values).
GRID_FOREST_FORECAST = {
    "n_estimators": [200, 300],
    "max_depth": [5, 10, 15, None],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2"],
}
GRID_FOREST_BAKEOFF = {**GRID_FOREST_FORECAST, "n_estimators": [200, 300, 500]}
GRID_BOOSTED = {
    "n_estimators": [100, 200, 300],
    "learning_rate": [0.05, 0.1, 0.2],
    "max_depth": [2, 3, 4],
    "min_samples_leaf": [1, 3, 5],
    "subsample": [0.6, 0.8, 1.0],
}
GRID_BOOSTED_HIST = {
    "n_estimators": [100, 200, 300, 500],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "max_depth": [3, 4, 5, 6, 7],
    "min_child_weight": [1, 3, 5],
    "subsample": [0.6, 0.8, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "gamma": [0, 0.1, 0.2],
    "reg_alpha": [0, 0.1, 0.5],
    "reg_lambda": [1, 1.5, 2],
}
SEED = 42

# Machine epsilon of float64, used by the constant-column test of the scaler.
FLOAT64_EPS = 2.220446049250313e-16

# Scores are ranked at this many decimal places, so that the last bits of a
# sum do not split a tie. Used by the views and the registered queries alike.
RANK_PLACES = 9
