"""Job parameters and the fixed values of the business rules.

The values under "Fixed values" must stay equal to the behaviour being
rebuilt: band edges, colours, floors, multipliers, default fills.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (rule constants; do not tune)
# ---------------------------------------------------------------------------
HIGH_RISK_SEVERITY = 0.4          # high-risk districts, public high-risk list
ALERT_P_OUTBREAK = 0.5            # active alerts (independent of the run threshold)
STAGE1_THRESHOLD = 0.5            # default gate for stage 2
DEFAULT_POPULATION = 1_000_000    # population used when none is known
UNKNOWN_STATE = "Unknown"         # state written for an unresolved place
FALLBACK_STATE = "India"          # state when a candidate has no state fields
STOCK_UNITS_PER_ROW = 10_000      # total stock units = rows x this
STOCK_FULFILMENT_PCT = 80         # constant fulfilment shown on the pharma view
DEMAND_DIVISOR = 100_000          # demand units = total x share / this
STOCK_BASE_FACTOR = 0.001         # stock base = population x severity x this
# run-time stock sizing: base floored first, then derived
RUN_STOCK_BASE_FLOOR = 50
RUN_STOCK_SHARES = {"ors": 0.8, "antibiotics": 0.6, "iv_fluids": 0.3}
# view recommendation: each quantity floored after deriving
VIEW_STOCK_FLOORS = {"paracetamol": 50, "ors": 30, "antibiotics": 20, "iv_fluids": 10}
# demand shares per drug, evaluated as total x share first
DEMAND_SHARES = [("Paracetamol", 0.5), ("ORS Packets", 0.3), ("Antibiotics", 0.15), ("IV Fluids", 0.05)]
# map bands: (lower edge, label, colour), checked top-down
MAP_BANDS = [(0.6, "Critical", "#EF4444"), (0.4, "High", "#F97316"), (0.2, "Moderate", "#F59E0B")]
MAP_BAND_LOW = ("Low", "#10B981")
# priority-list badges over high-risk rows
PRIORITY_BADGES = [(0.7, "CRITICAL", "#EF4444"), (0.5, "HIGH", "#F97316")]
PRIORITY_BADGE_LOW = ("ELEVATED", "#F59E0B")
# public search bands with advice text
PUBLIC_BANDS = [
    (0.4, "HIGH RISK", "#EF4444", "#FEE2E2",
     "High risk detected. Take immediate precautions and seek medical help if symptomatic."),
    (0.2, "MODERATE RISK", "#F59E0B", "#FEF3C7",
     "Moderate risk level. Be vigilant and follow preventive measures."),
]
PUBLIC_BAND_LOW = ("LOW RISK", "#10B981", "#D1FAE5",
                   "Low risk currently. Continue following regular hygiene practices.")
# stock card colours: (lower edge, fill, border)
CARD_BANDS = [(0.6, "#FEE2E2", "#EF4444"), (0.4, "#FED7AA", "#F97316")]
CARD_BAND_LOW = ("#FEF3C7", "#F59E0B")
# map circle geometry
MAP_OPACITY_BASE, MAP_OPACITY_SLOPE = 0.4, 0.6
MAP_FILL_FACTOR = 0.5
MAP_PEOPLE_PER_KM2 = 5000
MAP_RADIUS_MIN_M, MAP_RADIUS_MAX_M = 2000, 20000
MAP_RADIUS_DEFAULT_BASE_M, MAP_RADIUS_DEFAULT_SLOPE_M = 3000, 7000
# population estimate from a place candidate
POP_TYPES_LARGE = ["city", "town", "municipality"]
POP_TYPES_SMALL = ["village", "suburb", "locality"]
POP_FACTOR_LARGE, POP_FACTOR_SMALL, POP_FACTOR_OTHER = 15_000_000, 5_000_000, 10_000_000
POP_MIN_ESTIMATE = 50_000
DEFAULT_IMPORTANCE = 0.5
# candidate preference
PREFERRED_PLACE_TYPES = ["city", "town", "municipality", "administrative"]
PREFERRED_OSM_TYPE = "relation"
# text tokens read as missing on CSV ingest (pandas default NA set)
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]
# stage 2 training-row minimums
STAGE2_PREFERRED_MIN_ROWS = 20
STAGE2_MIN_ROWS = 10
# "none" fever type for rows below the stage 1 threshold
NO_FEVER_TYPE = "None"
# placeholder shown when a card has no data
NOT_AVAILABLE = "N/A"
# joined view: defaults for absent prediction fields (metadata and stock stay null)
VIEW_PREDICTION_DEFAULTS = {"p_outbreak": 0.0, "fever_type": "", "p_type": 0.0, "severity_index": 0.0, "ts": ""}
# classification report: summary rows
REPORT_SUMMARY_ROWS = ["accuracy", "macro avg", "weighted avg"]


@dataclass(frozen=True)
class JobConfig:
    """What a scoring run needs to know; the names of the command-line options are fixed values."""

    # columns
    order_col: str = "row_seq"
    region_col: str = "Region"
    label_outbreak: str = "outbreak_label"
    label_type: str = "fever_type"
    extra_excluded: tuple = field(default_factory=tuple)
    # split and gate
    test_size: float = 0.2
    random_state: int = 42
    threshold: float = STAGE1_THRESHOLD
    # training rows that fit the outbreak model and the forest, at most about: a hash sample, weighted; small classes keep this
    # many rows.  Bounds the trees that the driver assembles; boosted trees, splits, statistics, evaluation and scoring cover all rows
    max_fit_rows: int = 1_000_000
    min_fit_rows_per_class: int = 10_000
    # models
    use_boosting: bool = False
    lr_max_iter: int = 200
    lr_tolerance: float = 1e-12
    rf_num_trees: int = 400
    rf_max_depth: int = 30
    gbt_rounds: int = 250
    gbt_max_depth: int = 4
    gbt_step: float = 0.08
    gbt_subsample: float = 0.9
