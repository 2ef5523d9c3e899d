"""Design tables: schemas, validation, storage, and designs built from the
driver's tables (O1-O7, O13, J1)."""

from penfit.sources.design import (DESIGN_SCHEMA, DesignInfo, align, design_from_columns,
                                   peek, read_design, read_or_generate, read_param, row_count,
                                   select_features, select_label, to_cells, validate_design,
                                   write_design, write_param)
from penfit.sources.results import read_results, write_results
from penfit.sources.tables import embedding_design, load_table, price_design

__all__ = ["DESIGN_SCHEMA", "DesignInfo", "align", "design_from_columns", "peek", "read_design",
           "read_or_generate", "read_param", "row_count", "select_features", "select_label",
           "to_cells", "validate_design", "write_design", "write_param", "read_results",
           "write_results", "embedding_design", "load_table", "price_design"]
