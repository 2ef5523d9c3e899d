"""Iterative fits as Spark jobs."""

from penfit.plans.config import BENCHMARK, FitConfig
from penfit.plans.evaluators import CellEvaluator, DenseEvaluator, GramEvaluator, make_evaluator
from penfit.plans.fit import (COEF_SCHEMA, HISTORY_SCHEMA, FitResult, fit, fit_accelerated,
                              fit_gradient_descent)

__all__ = ["BENCHMARK", "FitConfig", "CellEvaluator", "DenseEvaluator", "GramEvaluator",
           "make_evaluator", "COEF_SCHEMA", "HISTORY_SCHEMA", "FitResult", "fit",
           "fit_accelerated", "fit_gradient_descent"]
