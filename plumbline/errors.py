"""Exceptions of the panel engine."""

from __future__ import annotations


class PanelError(ValueError):
    """Base of all errors about inputs."""


class MissingDateColumnError(PanelError):
    def __init__(self, frame: str, column: str = "date"):
        super().__init__(f"{frame} has no column '{column}'")
        self.frame, self.column = frame, column


class ShapeMismatchError(PanelError):
    def __init__(self, prices: tuple[int, int], mu: tuple[int, int]):
        super().__init__(f"prices have the shape {prices}, mu has {mu}")
        self.prices, self.mu = prices, mu


class ColumnMismatchError(PanelError):
    def __init__(self, prices: set[str], mu: set[str]):
        super().__init__(f"only in prices: {sorted(prices - mu)}; only in mu: {sorted(mu - prices)}")


class DuplicateTimestampError(PanelError):
    def __init__(self, n: int):
        super().__init__(f"{n} timestamps occur more than once")


class AssetError(PanelError):
    """An error about one asset's prices."""

    def __init__(self, asset: str, what: str):
        super().__init__(f"asset '{asset}': {what}")
        self.asset = asset


class NonPositivePricesError(AssetError):
    def __init__(self, asset: str):
        super().__init__(asset, "prices must be positive")


class ExcessiveNullsError(AssetError):
    def __init__(self, asset: str, fraction: float, most: float):
        super().__init__(asset, f"a share of {fraction:.2%} is missing, at most {most:.2%} may be")
        self.fraction, self.most = fraction, most


class MonotonicPricesError(AssetError):
    def __init__(self, asset: str):
        super().__init__(asset, "prices never change direction")


class LinearAlgebraError(ArithmeticError):
    """Base of errors about matrices."""


class DimensionMismatchError(LinearAlgebraError):
    def __init__(self, got: int, wanted: int):
        super().__init__(f"the right-hand side has length {got}, not {wanted}")


class NonSquareMatrixError(LinearAlgebraError):
    def __init__(self, shape: tuple[int, ...]):
        super().__init__(f"a square matrix is needed, not one of shape {shape}")


class SingularMatrixError(LinearAlgebraError):
    def __init__(self, what: str = "matrix"):
        super().__init__(f"the {what} is singular")


class InsufficientDataError(PanelError):
    """Too few finite values for a computation."""

    def __init__(self, detail: str = "too few finite values for the computation"):
        super().__init__(detail)


class FactorModelError(PanelError):
    """Loadings, factor covariance and idiosyncratic variances do not fit together."""


class StateFormatError(PanelError):
    """A saved stream state has another version or lacks columns."""


class ConditionWarning(RuntimeWarning):
    """A matrix is close to singular."""
