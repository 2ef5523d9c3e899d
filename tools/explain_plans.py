"""Print the formatted physical plans of the main single-pass operators and
of one Arrow pass over a cached design (scan pruning, pushed filters, join
strategy, partial aggregation, the mapInArrow stage)."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np  # noqa: E402

from penfit.operators import linalg, passes  # noqa: E402
from penfit.session import local_session  # noqa: E402
from penfit.sources.design import to_cells  # noqa: E402
from penfit.sources.tables import embedding_design, price_design  # noqa: E402


def main(sf: str = "/root/testdata/sf0.01"):
    spark = local_session(8)
    price = price_design(spark, sf)
    emb = embedding_design(spark, sf)
    cases = {
        "column norms of the price design (SQL form)": linalg.column_norms(price),
        "transpose product at fixed weights (SQL form)":
            linalg.transpose_product(linalg.residuals(emb, [0.1] * 64)),
        "cell layout prediction (broadcast weights table)":
            linalg.predict_cells(*to_cells(emb), linalg.vector_table(spark, np.ones(64))),
        "blockified design (the cached form of a fit)": passes.blockify(price, 6),
    }
    for title, df in cases.items():
        print(f"===== {title}")
        df.explain("formatted")


if __name__ == "__main__":
    main(*sys.argv[1:])
