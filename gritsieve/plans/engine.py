"""The facade: one table, its profile, two passes of detectors and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.functions import profile
from gritsieve.functions.profile import Roles
from gritsieve.operators import categories, completeness, duplicates, neighbours, numeric, typos
from gritsieve.plans import ledger as ledgers
from gritsieve.plans.ledger import IDX
from gritsieve.plans.storage import materialize
from gritsieve.sources import tables

#: Older spellings of parameters, accepted as well.
ALIASES = {
    "thresh_unique": "tresh_unique", "thresh_typo_frequency": "tresh_typo_frequency", "thresh_order": "tresh_order", "thresh_uniqueness": "thres_uniqueness",
    "thresh_unique_str": "thres_unique_str", "thresh_unique_nbr": "thres_unique_nbr", "unique_thresh": "unique_tresh",
}


def _named(params: dict) -> dict:
    return {ALIASES.get(k, k): v for k, v in params.items()}


class DataQuality:
    """Finds suspicious rows of one table.

    Roles, uniqueness and correlation are found once, when they are first needed, and may be
    set beforehand.  Each check adds to the ledger; a check that is called twice adds twice.
    ``semantics`` is ``reference`` or ``strict``; it differs for the pairing of duplicates,
    for columns without deviation and for extremes inside categories.
    """

    FIRST = ("duplication", "typo", "extreme_value", "completeness")
    SECOND = ("tendency", "outlier", "logic", "mixed_logic")

    def __init__(self, df: DataFrame, drop_first_col: bool = True, index_col: str | None = None, semantics: str = "reference", persist: bool = False):
        if semantics not in ("reference", "strict"):
            raise ValueError("semantics must be 'reference' or 'strict'")
        self.semantics = semantics
        self.spark: SparkSession = df.sparkSession
        data = tables.prepare(df, drop_first_col, index_col)
        self.data = materialize(data) if persist else data
        self._roles: Roles | None = None
        self._uniq: dict[str, float] | None = None
        self._corr: dict[str, list[str]] | None = None
        self._ledger: DataFrame | None = None
        self._good: DataFrame | None = None
        self._groups: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, drop_first_col: bool = True, index_col: str | None = None, semantics: str = "reference", persist: bool = False, **options) -> DataQuality:
        return cls(tables.read(spark, path, **options), drop_first_col, index_col, semantics, persist)

    # profile

    @property
    def roles(self) -> Roles:
        if self._roles is None:
            self._roles = profile.roles(self.data)
        return self._roles

    @roles.setter
    def roles(self, value: Roles) -> None:
        self._roles, self._uniq, self._corr = value, None, None

    @property
    def str_col(self) -> list[str]:
        return self.roles.strings

    @str_col.setter
    def str_col(self, value: list[str]) -> None:
        self.roles.strings = list(value)

    @property
    def nbr_col(self) -> list[str]:
        return self.roles.numbers

    @nbr_col.setter
    def nbr_col(self, value: list[str]) -> None:
        self.roles.numbers = list(value)
        self.roles.dates = [c for c in self.roles.dates if c in value]

    @property
    def uniq_col(self) -> dict[str, float]:
        if self._uniq is None:
            r = self.roles
            columns = [c for c in profile.data_columns(self.data) if c in r.strings or c in r.numbers]
            self._uniq = profile.uniqueness(profile.converted(self.data, r), columns)
        return self._uniq

    @uniq_col.setter
    def uniq_col(self, value: dict[str, float]) -> None:
        self._uniq = dict(value)

    @property
    def corr_col(self) -> dict[str, list[str]]:
        if self._corr is None:
            self._corr = self.compute_corr_str()
        return self._corr

    @corr_col.setter
    def corr_col(self, value: dict[str, list[str]]) -> None:
        self._corr = {k: list(v) for k, v in value.items()}

    def compute_corr_str(self, threshold: float = 0.5) -> dict[str, list[str]]:
        return categories.correlated(self.data, self.roles, self.uniq_col, threshold)

    def metadata(self) -> DataFrame:
        return profile.kinds_table(self.data)

    @property
    def groups(self) -> DataFrame:
        """Rows that occur more than once; found once for all checks."""
        if self._groups is None:
            self._groups = materialize(duplicates.repeated(self.data))
        return self._groups

    @property
    def first_rows(self) -> DataFrame:
        return duplicates.deduplicated(self.data, self.groups)

    # state

    @property
    def bad_index(self) -> DataFrame:
        return ledgers.empty(self.spark) if self._ledger is None else self._ledger

    @bad_index.setter
    def bad_index(self, value: DataFrame | None) -> None:
        self._ledger = value

    def push_bad_index(self, rows: DataFrame) -> None:
        """Adds ledger rows; kept for older callers."""
        self._add(rows)

    @property
    def good_index(self) -> DataFrame:
        """``_idx`` of the rows that the first pass hasn't flagged."""
        return self.data.select(IDX) if self._good is None else self._good

    @good_index.setter
    def good_index(self, value: DataFrame | list[int]) -> None:
        new = value.select(IDX) if isinstance(value, DataFrame) else self.spark.createDataFrame([(int(x),) for x in value], f"{IDX} long")
        if new.count() > self.data.count():
            raise ValueError("more good rows than rows")
        self._good = new

    def _add(self, found: DataFrame) -> DataFrame:
        self._ledger = found if self._ledger is None else self._ledger.unionByName(found)
        return found

    def good_rows(self) -> DataFrame:
        return self.data if self._good is None else self.data.join(self._good, IDX, "left_semi")

    # checks

    def check_duplication(self) -> DataFrame:
        return self._add(duplicates.check_duplication(self.data, self.semantics, self.groups))

    def check_typo(self, **params) -> DataFrame:
        return self._add(typos.check_typo(self.data, self.roles, self.uniq_col, rows=self.first_rows, **_named(params)))

    def check_extreme_value(self, thresh_std: float = 6, thresh_unique1: float = 0.99, thresh_unique2: float = 0.0001) -> DataFrame:
        return self._add(numeric.check_extreme_value(self.data, self.roles, self.uniq_col, thresh_std, thresh_unique1, thresh_unique2, self.semantics, self.first_rows))

    def check_completeness(self, thresh_row_1: float = 0.7, thresh_row_2: float = 0.5, thresh_col: float = 0.8) -> DataFrame:
        return self._add(completeness.check_completeness(self.data, thresh_row_1, thresh_row_2, thresh_col, self.first_rows))

    def check_tendency(self, **params) -> DataFrame:
        return self._add(numeric.check_tendency(self.data, self.roles, **_named(params)))

    def check_outlier(self, **params) -> DataFrame:
        return self._add(neighbours.check_outlier(self.data, self.roles, rows=self.first_rows, **params))

    def check_logic(self, **params) -> DataFrame:
        return self._add(categories.check_logic(self.good_rows(), self.roles, self.uniq_col, self.corr_col, **_named(params)))

    def check_mixed_logic(self, **params) -> DataFrame:
        return self._add(categories.check_mixed_logic(self.good_rows(), self.roles, self.uniq_col, semantics=self.semantics, **_named(params)))

    def _run(self, allowed: tuple[str, ...], methods: tuple[str, ...]) -> None:
        for m in methods or allowed:
            if m not in allowed:
                raise KeyError(f"{m}: none of {', '.join(allowed)}")
        for m in methods or allowed:
            getattr(self, f"check_{m}")()

    def firstpass(self, *methods: str) -> DataFrame:
        """Runs the checks of the first pass; what they flag leaves the good rows."""
        self._run(self.FIRST, methods)
        self._ledger = materialize(self.bad_index)
        self._good = self.good_index.join(self._ledger.select(F.col("idx").alias(IDX)).distinct(), IDX, "left_anti")
        return self._ledger

    def secondpass(self, *methods: str) -> DataFrame:
        """Runs the checks of the second pass; the good rows stay as they are."""
        self._run(self.SECOND, methods)
        return self.bad_index

    # others

    def imputation(self, impute_k: int = 10) -> DataFrame:
        return neighbours.knn_impute(self.data, self.roles, impute_k, self.first_rows)

    def outlier_lof(self, **params) -> DataFrame:
        return neighbours.outlier_lof(self.data, self.roles, rows=self.first_rows, **params)

    def col_combined_result(self, col1_name: str, col2_name: str, first_pass: bool = False) -> DataFrame:
        """Two columns without rows that were flagged for them; ``first_pass`` runs the first pass before."""
        if first_pass:
            self.firstpass()
        return categories.combined_columns(self.data, self.bad_index, col1_name, col2_name)

    def dual_hist(self, col1_name: str, col2_name: str, unique_tresh: float = 0.7, first_pass: bool = False) -> DataFrame:
        return categories.dual_hist(self.col_combined_result(col1_name, col2_name, first_pass), self.uniq_col, col1_name, col2_name, unique_tresh)

    def report(self) -> DataFrame:
        return ledgers.report(self.bad_index)

    def save_result(self, path: str, **options) -> None:
        tables.save(self.bad_index, path, **options)
