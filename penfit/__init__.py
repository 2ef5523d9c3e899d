"""penfit: penalised least-squares fits on Spark DataFrames.

Design tables in, coefficient and history tables out; all work on rows runs
in Spark, only coefficient-length vectors live on the driver.

    from penfit import FitConfig, fit_accelerated, price_design
    fit = fit_accelerated(design, lam=500.0, cfg=FitConfig(max_iter=200))
    fit.coefficients(spark).show(); fit.history_table(spark).show()
"""

__version__ = "0.1.0"

from penfit.functions import L1Penalty, NoPenalty, SquaredError  # noqa: E402
from penfit.operators.compare import (relative_difference, rmse, same_iterations,  # noqa: E402
                                      timing_table)
from penfit.operators.generate import make_lasso_data, read_or_make_lasso  # noqa: E402
from penfit.plans import (BENCHMARK, FitConfig, FitResult, fit, fit_accelerated,  # noqa: E402
                          fit_gradient_descent)
from penfit.session import local_session, ship_package  # noqa: E402
from penfit.sources import (design_from_columns, embedding_design, price_design,  # noqa: E402
                            read_design, read_or_generate, to_cells, validate_design,
                            write_design)

__all__ = ["L1Penalty", "NoPenalty", "SquaredError", "relative_difference", "rmse",
           "same_iterations", "timing_table", "make_lasso_data", "read_or_make_lasso",
           "BENCHMARK", "FitConfig", "FitResult", "fit", "fit_accelerated",
           "fit_gradient_descent", "local_session", "ship_package", "design_from_columns",
           "embedding_design", "price_design", "read_design", "read_or_generate", "to_cells",
           "validate_design", "write_design"]
