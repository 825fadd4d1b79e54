"""The detectors; importing this package registers all of them."""

from oddledger.operators.detectors import base, correlation, iforest, timeseries, weekend, zscore
from oddledger.operators.detectors.base import (
    Detector,
    Transactions,
    get,
    list_detectors,
    register,
    unregister,
)

__all__ = [
    "Detector",
    "Transactions",
    "base",
    "correlation",
    "get",
    "iforest",
    "list_detectors",
    "register",
    "timeseries",
    "unregister",
    "weekend",
    "zscore",
]
