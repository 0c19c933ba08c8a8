"""The preprocessing chain: impute mean -> IQR clip -> features -> residual fill -> standard scale.

Three aggregate jobs (means; quartiles; fill+scale statistics), each one
output row applied as literals, and one window.  The returned frame is a flat
projection over the source scan.  For training, materialise it once
(``checkpoint`` to the shared checkpoint dir or write Parquet).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import model_columns, numeric_columns
from ..operators.clean import clip_iqr, impute_mean_with_counts
from ..operators.features import RATIOS, engineer_features
from ..functions.sqlexpr import dcol, dlit, q
from ..functions.stats import fit_row
from ..operators.scale import ScalerModel, scale_stat_aggs
from .order import DEFAULT_BUCKET_WIDTHS


#: Columns of stored rows in one aggregate: it stays below the 100 fields up to which Spark compiles it whole.
STAT_COLUMNS = 12


@dataclass
class Preprocessed:
    df: DataFrame
    scaler: ScalerModel
    roles: list[str]
    label_col: str = "status"
    time_col: str = "timestamp"
    original_columns: list[str] = field(default_factory=list)

    @property
    def new_features(self) -> list[str]:
        orig = set(self.original_columns)
        return [c for c in self.df.columns if c not in orig]

    def feature_columns(self, target_col: str = "cpu_utilization", drop_leaky: bool = False) -> list[str]:
        """Numeric model columns minus label, time, target and roles.  Target-derived
        rolling/lag/ratio columns stay in unless ``drop_leaky``."""
        ex = {self.label_col, self.time_col, target_col, *self.roles}
        cols = model_columns(self.df, exclude=ex)
        if drop_leaky:
            leaky = {n for n, a, b in RATIOS if target_col in (a, b)}
            cols = [c for c in cols if not c.startswith(target_col + "_") and c not in leaky]
        return cols


def preprocess(df: DataFrame, entity_cols: Sequence[str] = ("host_id",), order_col: str = "row_key",
               label_col: str = "status", time_col: str = "timestamp", iqr_threshold: float = 1.5,
               method: str = "standard", window: int = 3, exact: bool = True,
               bucket_widths=DEFAULT_BUCKET_WIDTHS,
               store: Callable[[DataFrame], DataFrame] | None = None) -> Preprocessed:
    """``store`` writes the rows with their features and reads them back: the statistics and the readers of the
    result then need no window of their own."""
    entity_cols = list(entity_cols)
    roles = [*entity_cols, order_col]
    num = numeric_columns(df, exclude=roles)               # includes the label
    s1, counts = impute_mean_with_counts(df, num)       # pass 1: means (+ counts for pass 2)
    s2 = clip_iqr(s1, cols=num, threshold=iqr_threshold, exact=exact, known_counts=counts)
    s3 = engineer_features(s2, entity_cols, order_col, cols=[c for c in num if c != label_col],
                           roles=roles, window=window, bucket_widths=bucket_widths)
    if store is not None:
        s3 = store(s3)
    num_all = numeric_columns(s3, exclude=roles)
    scale_cols = [c for c in num_all if c not in (label_col, time_col)]
    fill_only = [c for c in num_all if c not in scale_cols]
    # Pass 3: residual mean fill and scaler statistics of the filled columns, one aggregate; of stored rows one
    # for each few columns.
    st, step = {}, STAT_COLUMNS if store is not None else max(1, len(num_all))
    for at in range(0, len(num_all), step):
        some = num_all[at:at + step]
        aggs = scale_stat_aggs([c for c in some if c in scale_cols], method, fill_mean=True)
        means = some if method != "standard" else [c for c in some if c in fill_only]
        aggs += [F.avg(F.col(c).cast("double")).alias(f"__mu_{c}") for c in means]
        st |= fit_row(s3, aggs)

    def p(name):
        return dlit(st.get(name))
    out = []
    for c in s3.columns:
        if c in num_all:
            filled = f"coalesce({dcol(c)}, {p(f'__mu_{c}')})"
            if c in scale_cols:
                sc = f"({filled} - {p(f'__mu_{c}')}) / {p(f'__sc_{c}')}" if method == "standard" \
                    else f"{filled} * {p(f'__sc_{c}')} + {p(f'__mn_{c}')}"
                out.append(f"{sc} AS {q(c)}")
            else:
                out.append(f"{filled} AS {q(c)}")
        else:
            out.append(q(c))
    params = {k: v for k, v in st.items() if any(k == f"{q}{c}" for c in scale_cols for q in ("__mu_", "__sc_", "__mn_"))}
    return Preprocessed(s3.selectExpr(*out), ScalerModel(method, scale_cols, params), roles,
                        label_col, time_col, list(df.columns))
