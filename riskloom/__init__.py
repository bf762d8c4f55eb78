"""Credit-scoring analytics on Spark DataFrames."""

from .operators.association import chi2_test, cramers_v, cramers_v_matrix
from .operators.binning import (
    build_bin_description,
    extract_thresholds,
    transform_categorical_column,
    transform_dataframe,
    transform_numeric_column,
)
from .operators.cleaning import impute_missing_values
from .operators.drift import psi_table
from .operators.encoding import build_dummies, get_dummies, get_test_dummies
from .operators.folds import boosted_tree_search, stratified_folds
from .operators.graph import graph_edges, graph_nodes
from .operators.levels import frequency_table, modality_order, monthly_table, target_table
from .operators.ranks import class_tests, numeric_summary, score_metrics
from .operators.regression import fit_logit_and_metrics
from .operators.scorecard import summarize_model
from .operators.selection import gini_evolution, stepwise_selection_categorical
from .operators.woe import information_value, iv_by_variable, woe_by_variable, woe_table
from .plans.categorical import analyse_categorielle
from .plans.quantitative import analyse_quantitative

__all__ = [
    "analyse_categorielle",
    "analyse_quantitative",
    "boosted_tree_search",
    "build_bin_description",
    "build_dummies",
    "chi2_test",
    "class_tests",
    "cramers_v",
    "cramers_v_matrix",
    "extract_thresholds",
    "fit_logit_and_metrics",
    "frequency_table",
    "get_dummies",
    "get_test_dummies",
    "gini_evolution",
    "graph_edges",
    "graph_nodes",
    "impute_missing_values",
    "information_value",
    "iv_by_variable",
    "modality_order",
    "monthly_table",
    "numeric_summary",
    "psi_table",
    "score_metrics",
    "stepwise_selection_categorical",
    "stratified_folds",
    "summarize_model",
    "target_table",
    "transform_categorical_column",
    "transform_dataframe",
    "transform_numeric_column",
    "woe_by_variable",
    "woe_table",
]
